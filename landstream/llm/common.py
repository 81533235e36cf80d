"""Session helpers of the corpus operators: tables, shared folders, cut lineage, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset, as in local tests, a temporary folder of this machine is taken; on a cluster, where each machine
    has folders of its own, a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors don't lose it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of the largest bitmap of ids (16 MB). With more than some ten million ids it leaves out fewer rows; it never loses one.
BITMAP_BITS = 1 << 27


def marked(df: DataFrame, column: str, ids: DataFrame, name: str = "__maybe") -> DataFrame:
    """df with `name`: false only where `column` is not among ids, a table of one column.

    A bitmap of hashes, 64 bits an id and BITMAP_BITS at most, goes to all tasks, so that long rows that aren't wanted needn't be
    shuffled for a join. Rows that it lets through are a few more than those that are wanted, and still have to be joined.
    """
    bits = min(BITMAP_BITS, 1 << max(15, (64 * ids.count() - 1).bit_length()))
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    number, at = F.bitmap_bucket_number(spot(ids.columns[0])), F.bitmap_bit_position(spot(ids.columns[0]))
    maps = ids.select(number.alias("__map"), at.alias("__at")).groupBy("__map").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    at = F.bitmap_bit_position(spot(column))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("__map", F.bitmap_bucket_number(spot(column))).join(F.broadcast(maps), "__map", "left")
    return found.withColumn(name, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("__map", "__bits")


#: Rows of an Arrow batch. Texts are long: Spark's default of 10,000 rows makes batches that a task holds several times over.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Make Arrow batches of at most BATCH_ROWS rows in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def hash_below(share: float) -> int:
    """The largest value of a 64-bit hash that a draw of this share of all rows takes."""
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))


def empty(df: DataFrame) -> bool:
    return not df.take(1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), for nodes that have an edge.

    component is the smallest node that can be reached. Each round hangs every node under its smallest neighbour, follows
    the pointers to the roots by doubling, and contracts the edges to the roots; so a round at least halves the nodes that
    still have edges, and long chains need few rounds. Only joins and min() aggregates are used: a node with very many
    edges is combined before it is shuffled, and nothing goes through the driver. Null ends and loops are ignored.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = written(links.select(high.alias("x"), low.alias("y")).distinct(), "links")
    found = None
    while not empty(links):
        # Each node hangs under its smallest neighbour if that is smaller; others are roots of this round.
        parent = written(links.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("root")), "parent")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            nxt = written(parent.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "parent")
            moved = not empty(nxt.where("moved"))
            parent = nxt.select("node", "root")
            if not moved:
                break
        roots = parent.select(F.col("node").alias("at"), F.col("root").alias("to"))
        links = (
            links.join(roots, F.col("x") == F.col("at"), "left").select(F.coalesce("to", "x").alias("x"), "y")
            .join(roots, F.col("y") == F.col("at"), "left").select("x", F.coalesce("to", "y").alias("y"))
            .where("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        )
        links = written(links, "links")
        if found is None:
            found = parent
        else:
            moved_on = found.join(roots, F.col("root") == F.col("at"), "left").select("node", F.coalesce("to", "root").alias("root"))
            found = written(moved_on.unionByName(parent.join(found.select("node"), "node", "left_anti")), "found")
    if found is None:
        return links.select(F.col("x").alias("node"), F.col("y").alias("component"))
    # Roots are their own component.
    pairs = found.select("node", F.col("root").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
