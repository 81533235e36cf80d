"""Monthly sums of a stream, kept in few parts: micro-batches write parts, and compactions fold them into the months they touch.

Layout of a folder: parts/batch=N, the partial sums of a micro-batch; months/version=N/month=M, a month's sums as the compaction of
batch N left them; manifest/version=N, which version each month has and that all batches up to N are in. A compaction writes its
months first and its manifest last, so a manifest names only what is complete; what a compaction that failed has left is no
manifest's and is overwritten when the batch runs again. A batch that is run again writes its own part again, or nothing if a
manifest already holds it. Readers take the last manifest's months and the parts after it: at most `every` parts and a file set a
month, however many batches there were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.diagnostics import merge_sums


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers N of the folders name=N whose write was finished."""
    files, at = _fs(spark, folder)
    if not files.exists(at):
        return []
    done = (s.getPath() for s in files.listStatus(at) if s.getPath().getName().startswith(f"{name}="))
    return sorted(int(p.getName().split("=")[1]) for p in done if files.exists(_fs(spark, f"{p}/_SUCCESS")[1]))


class MonthlySums:
    """keys hold `month`, a date; partial makes sums of a batch, with n and columns that end in _sum or _sum2."""

    def __init__(self, spark: SparkSession, path: str, partial: Callable[[DataFrame], DataFrame], keys: list[str], every: int = 4):
        if "month" not in keys:
            raise ValueError("the keys must hold the month")
        self.spark, self.path, self.partial, self.keys, self.every = spark, path, partial, keys, every

    def manifest(self) -> tuple[int, dict[str, int]]:
        """(last batch that is folded, -1 without one; version of each month)."""
        versions = _numbers(self.spark, f"{self.path}/manifest", "version")
        if not versions:
            return -1, {}
        rows = self.spark.read.parquet(f"{self.path}/manifest/version={versions[-1]}").collect()  # a row a month
        return versions[-1], {r["month"]: r["version"] for r in rows}

    def parts(self, after: int) -> list[int]:
        return [n for n in _numbers(self.spark, f"{self.path}/parts", "batch") if n > after]

    def _read(self, months: dict[str, int], parts: list[int], schema: StructType | None = None) -> DataFrame:
        paths = [f"{self.path}/months/version={v}/month={m}" for m, v in sorted(months.items())] + [f"{self.path}/parts/batch={n}" for n in parts]
        if not paths:
            raise ValueError(f"{self.path} holds no sums")
        return self.spark.read.parquet(*paths) if schema is None else self.spark.read.schema(schema).parquet(*paths)

    def put(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        folded, months = self.manifest()
        if number <= folded:
            return
        self.partial(batch).write.mode("overwrite").parquet(f"{self.path}/parts/batch={number}")
        parts = [n for n in self.parts(folded) if n <= number]
        if len(parts) >= self.every:
            self.compact(folded, months, parts)

    def compact(self, folded: int, months: dict[str, int], parts: list[int]) -> None:
        """Fold parts into the months that they touch; their manifest has the number of the last part."""
        version, new = parts[-1], self._read({}, parts)
        touched = {str(r[0]) for r in new.select("month").distinct().collect()}  # a row a month
        held = {m: v for m, v in months.items() if m in touched}
        merged = merge_sums(self._read(held, parts, new.schema), self.keys).withColumn("__month", F.col("month").cast("string"))
        merged.write.mode("overwrite").partitionBy("__month").parquet(f"{self.path}/months/version={version}")
        self._rename(version, touched)
        listed = [(m, v) for m, v in ({**months, **dict.fromkeys(touched, version)}).items()]
        self.spark.createDataFrame(listed, "month string, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        self._forget(folded)

    def _rename(self, version: int, touched: set[str]) -> None:
        files, _ = _fs(self.spark, self.path)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for m in touched:
            files.rename(path(f"{self.path}/months/version={version}/__month={m}"), path(f"{self.path}/months/version={version}/month={m}"))

    def _forget(self, folded: int) -> None:
        """Parts that the manifest before already held: a reader that began with that one is done with the parts before it."""
        files, _ = _fs(self.spark, self.path)
        for n in [n for n in _numbers(self.spark, f"{self.path}/parts", "batch") if n <= folded]:
            files.delete(_fs(self.spark, f"{self.path}/parts/batch={n}")[1], True)

    def run(self, stream: DataFrame) -> None:
        stream.writeStream.option("checkpointLocation", f"{self.path}/log").trigger(availableNow=True).foreachBatch(self.put).start().awaitTermination()

    def read(self) -> DataFrame:
        folded, months = self.manifest()
        return merge_sums(self._read(months, self.parts(folded)), self.keys)
