"""Mixing sources to target weights by systematic sampling.

Each source gets a target in words. Within a source, each document is expected target / source size times; the prefix sums of
these expected copies, plus one random offset of the source, cross integers, and each crossing emits the document once.
Documents stand in order of size, so that crossings are spread evenly over short and long ones and the words taken come near
the target.

Cases: a null or empty text has size 0; a null source is a source of its own, ordered last; null ids and repeated rows are
sampled each for itself; an empty table gives an empty result. Columns of the input keep their names; helper columns start
with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> with target and the source's random offset.

    Sources in order of code points, null last, weigh `weights`, repeating, and share the sum of all sizes. A target stops at
    cap times its source's size; the excess goes to the others by weight. The level at which that ends is found by standing
    the sources in the order in which they are capped. One row per source: this window is small however many documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    full = sizes.withColumn("__weight", weight).withColumn("__most", F.col("source_size") * F.lit(cap))
    filled = Window.orderBy(F.col("__most") / F.col("__weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("__most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything).cast("double") - before) / rest
    full = full.withColumn("__level", level)
    holds = F.when(F.col("__level") <= F.col("__most") / F.col("__weight"), F.struct(F.col("__most") / F.col("__weight"), "__level"))
    full = full.withColumn("__level", F.min(holds).over(everything)["__level"])
    target = F.least("__most", F.col("__level") * F.col("__weight"))
    return full.select("source", "source_size", target.alias("target"))


def offset(seed: int, source: Column) -> Column:
    """A number from 0 to 1 that depends on the seed and the source alone, so that reruns agree."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, size: Column, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """docs (with doc_id and source) with __size, __source_size, __target and __copies. size: a document's, as a column.

    The rows are range-partitioned by (source, size, doc_id), so that a large source spreads over many tasks, and are written
    once: the ranks are local row numbers plus the counts of the ranges before.
    """
    # Rows that agree in size and id, but not in the rest, have an order too.
    sized = docs.withColumn("__size", size).withColumn("__tie", F.xxhash64(*docs.columns))
    ranged = sized.repartitionByRange(F.col("source").asc_nulls_last(), "__size", "doc_id", "__tie")
    ranged = written(ranged.withColumn("__range", F.spark_partition_id()), "mix")
    parts = ranged.groupBy("__range", "source").agg(F.count("*").alias("__n"), F.sum("__size").alias("__words"))
    sizes = parts.groupBy("source").agg(F.sum("__words").alias("source_size"))
    targets = source_targets(sizes, weights, cap)
    ahead = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
    known = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select(
        F.col("p.__range").alias("__at"), F.col("p.source").alias("__of"), "p.__ahead", F.col("t.source_size").alias("__source_size"), F.col("t.target").alias("__target")
    )
    rank = F.row_number().over(Window.partitionBy("__range", "source").orderBy("__size", "doc_id", "__tie"))
    ranked = ranged.withColumn("__rank", rank).join(known, (F.col("__range") == F.col("__at")) & F.col("source").eqNullSafe(F.col("__of")))
    rank = F.col("__ahead") + F.col("__rank")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    shift = offset(seed, F.col("source"))
    copies = F.floor(rank * rate + shift) - F.floor((rank - 1) * rate + shift)
    return ranked.select(*docs.columns, "__size", "__source_size", "__target", copies.cast("long").alias("__copies"))


def emitted(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: each document once per integer crossed, with the number of the copy."""
    mixed = mix_sources(docs, word_count(text), **options).where("__copies > 0")
    return mixed.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("copy"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("n_words"))
    # Written first: both the bounds of the ranges and the ranges themselves are made from the words counted once.
    mixed = mix_sources(written(sized, "sized"), F.col("n_words"))
    return mixed.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *, source_size * CAST(3 AS DOUBLE) AS most, source_size * CAST(3 AS DOUBLE) / weight AS full_at FROM sources
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(most) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM filled
), targets AS (
  SELECT source, source_size, least(most, weight * (SELECT arg_min(level, full_at) FROM levels WHERE level <= full_at)) AS target FROM levels
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS rank,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(CAST('0x' || substr(md5('17:' || coalesce(s.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS shift
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rank * rate + shift) - floor((rank - 1) * rate + shift) AS BIGINT) AS taken
FROM ranked
"""
