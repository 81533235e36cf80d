"""Centroid clustering in whole numbers, nearest centroids found by a tournament of bisectors.

A vector's components become floor(SCALE * x), so that all that follows is exact. For two centroids the points nearer to the
one than to the other are told by a linear test: with the normal 2 (c_j - c_i) and the threshold |c_j|^2 - |c_i|^2, x is nearer
to j where normal . x > threshold. Normals and thresholds of all pairs are made once a round; each vector then meets the
centroids in the order of their numbers, k - 1 sign tests in which the loser goes and a zero favours the smaller number. Only
the winner's distance is computed.

A round sends k x dims sums a task through one aggregate; the centroids, k x dims whole numbers, go through the driver.

Cases: vectors of another length, and null vectors or those with null or non-finite components, aren't kept and are in no
result. A null id keeps its vector, but never starts a centroid. Repeated rows count each for itself; of rows that share an
id, the least vector starts a centroid first. Fewer vectors than k start as many centroids as there are; without any the result
is empty. Components beyond 2^27 after scaling are computed as unbounded integers; a distance or an inertia that no long holds
is null. A centroid of an empty cluster stays. Columns other than id and vector don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Below this, sums of products of 64 components fit in 64 bits.
SAFE = 1 << 27
_LONG = 1 << 63


@dataclass
class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    centroids: list[list[int]]

    def __post_init__(self):
        wide = any(abs(x) > SAFE for c in self.centroids for x in c) or (self.centroids and len(self.centroids[0]) > 64)
        self.kind = object if wide else np.int64
        c = np.array(self.centroids, self.kind)
        squares = (c * c).sum(1)
        self.normals = 2 * (c[None, :, :] - c[:, None, :])  # [i, j]
        self.thresholds = squares[None, :] - squares[:, None]
        self.points = c

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the nearest centroids, squared distances) of the rows of x."""
        if x.dtype == object or self.kind is object:
            x = x.astype(object)
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.points)):
            side = (x * self.normals[best, j]).sum(1) - self.thresholds[best, j]
            best[(side > 0).astype(bool)] = j
        apart = x - self.points[best]
        return best, (apart * apart).sum(1)


def _whole(column: pa.Array, dims: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of rows, their whole numbers) of the small vectors, 64-bit, and then of the others, unbounded."""
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(over="ignore"):
        scaled = np.floor(x * float(scale))
    small = (np.abs(scaled) <= SAFE).all(1)
    if small.any():
        yield np.flatnonzero(small), scaled[small].astype(np.int64)
    if not small.all():
        # Doubles from 2^53 on are whole; where the product is beyond doubles, the factor is taken afterwards.
        rows = [[int(s) if math.isfinite(s) else int(v) * scale for s, v in zip(*pair, strict=True)] for pair in zip(scaled[~small], x[~small], strict=True)]
        yield np.flatnonzero(~small), np.array(rows, object).reshape(-1, dims)


def kept_vectors(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """Rows whose vector has `dims` components, none null or non-finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return df.where((F.size(vector) == dims) & finite)


def first_centroids(df: DataFrame, key: str, vector: str, k: int, dims: int, scale: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:key`, in the order of the hashes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    rows = df.where(F.col(key).isNotNull()).select(digest.alias("h"), F.transform(vector, lambda v: v.cast("double")).alias("x")).orderBy("h", "x").limit(k).collect()
    out = []
    for r in rows:
        ((_, x),) = _whole(pa.array([r.x], pa.list_(pa.float64())), dims, scale)
        out.append([int(v) for v in x[0]])
    return out


#: Sums travel as digits to this base, so that any size fits.
_BASE = 10**15


def _digits(v: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of v to the base, all with v's sign; the last place always."""
    sign, v, at = (1 if v >= 0 else -1), abs(v), 0
    while v or not at:
        v, d = divmod(v, _BASE)
        yield at, sign * d
        at += 1


def _sums(df: DataFrame, vector: str, bisectors: Bisectors, dims: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Per cluster that has vectors: their number and componentwise sums. A row for each cluster, component and digit leaves a task."""
    shared = df.sparkSession.sparkContext.broadcast(bisectors)

    def run(batches):
        found = shared.value
        n = np.zeros(len(found.points), np.int64)
        total = np.zeros((len(found.points), dims), object)
        for batch in batches:
            for _, x in _whole(batch.column(0), dims, scale):
                best, _ = found.assign(x)
                for c in np.unique(best):
                    mine = x[best == c]
                    n[c] += len(mine)
                    total[c] += np.array([int(v) for v in mine.sum(0)], object)
        rows = [(int(c), p, at, int(n[c]) if not at else 0, d) for c in np.flatnonzero(n) for p in range(dims) for at, d in _digits(int(total[c][p]))]
        for first in range(0, len(rows), 4096):
            columns = zip(*rows[first : first + 4096], strict=True)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["cluster", "component", "place", "n", "digit"])

    parts = df.select(vector).mapInArrow(run, "cluster int, component int, place int, n long, digit long")
    digit = F.sum(F.col("digit").cast("decimal(28,0)")).alias("digit")  # 10^15 a task overflow a long from 9000 tasks on
    rows = parts.groupBy("cluster", "component", "place").agg(F.sum("n").alias("n"), digit).collect()
    shared.unpersist()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: r.place):  # the first place has the numbers
        out.setdefault(r.cluster, (r.n, [0] * dims))[1][r.component] += int(r.digit) * _BASE**r.place
    return out


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """One row a kept vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    kept = written(kept_vectors(df.select(key, vector), vector, dims), "vectors")
    centroids = first_centroids(kept, key, vector, k, dims, scale, seed)
    for _ in range(rounds if centroids else 0):
        for c, (n, total) in _sums(kept, vector, Bisectors(centroids), dims, scale).items():
            centroids[c] = [v // n for v in total]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    shared = df.sparkSession.sparkContext.broadcast(Bisectors(centroids)) if centroids else None
    kind = kept.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches if shared else ():
            for at, x in _whole(batch.column(1), dims, scale):
                best, far = shared.value.assign(x)
                held = [int(v) if v < _LONG else None for v in far]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(best, pa.int32()), pa.array(held, pa.int64())], [key, "cluster", "distance"])

    placed = written(kept.select(key, vector).mapInArrow(run, f"{key} {kind}, cluster int, distance long"), "clusters")
    # One row a cluster, k at most; a cluster with a distance that no long holds has no inertia.
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    inertia = {r.cluster: r.exact for r in placed.groupBy("cluster").agg(whole.alias("exact")).collect()}
    fits = lambda v: None if v is None or int(v) >= _LONG else int(v)
    total = None if None in inertia.values() else sum(int(v) for v in inertia.values())
    of = spark_rows(df.sparkSession, [(c, fits(v), fits(total), digests[c]) for c, v in sorted(inertia.items())])
    return placed.join(F.broadcast(of), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def spark_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A row a cluster, k at most."""
    return spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds one after the other, each over rows (vector, place, component); distances of all pairs, hugeint throughout."""
    near = """(SELECT v, arg_min(c, ROW(d, c)) AS c, min(d) AS d FROM
      (SELECT x.v, c.c, CAST(sum((x.x - c.x) * (x.x - c.x)) AS BIGINT) AS d FROM flat x JOIN {} c USING (p) GROUP BY x.v, c.c) GROUP BY v)"""
    parts = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS v, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS xs FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        "flat AS MATERIALIZED (SELECT v, unnest(range(64)) AS p, unnest(xs) AS x FROM kept)",
        f"first AS (SELECT row_number() OVER (ORDER BY h, xs) - 1 AS c, xs FROM (SELECT sha256('3:' || vec_id) AS h, xs FROM kept WHERE vec_id IS NOT NULL ORDER BY h, xs LIMIT {k}))",
        "c0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS p, unnest(xs) AS x FROM first)",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED {near.format(f'c{r}')}")
        parts.append(
            f"""c{r + 1} AS MATERIALIZED (SELECT c.c, c.p, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN
              (SELECT c, p, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM a{r} JOIN flat USING (v) GROUP BY c, p) m ON m.c = c.c AND m.p = c.p)"""
        )
    parts.append(f"last AS MATERIALIZED {near.format(f'c{rounds}')}")
    return f"""WITH {', '.join(parts)}
    SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, s AS centroid_sha256
    FROM last JOIN kept USING (v) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS s FROM c{rounds} GROUP BY c) USING (c)"""


SQL = _sql()
