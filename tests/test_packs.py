"""All pairs of points and tiles in an ellipse are written out from packs: what moves follows the tables, not the pairs."""

from pyspark.sql import functions as F

from landstream.operators import spatial as S


def test_pairs_do_not_move(spark):
    """Nothing is shuffled between the packs and the rows of the result."""
    p = spark.range(400).select(F.col("id").alias("obs_id"), (F.col("id") % 2).cast("double").alias("lon"), F.lit(0.0).alias("lat"))
    t = spark.range(300).select((F.col("id") + 7).alias("tile"), F.lit(0.5).alias("com_lon"), (F.col("id") % 3).cast("double").alias("com_lat"))
    out = S.in_ellipse(p, t, 1.0, 0.5)
    assert out.count() == 400 * 100 == out.distinct().count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("Generate")].count("Exchange") + plan[plan.index("Generate") : plan.index("ObjectHashAggregate")].count("Exchange hashpartitioning")
    assert after == 0, "packs were shuffled once more, or rows after they were written out"


def test_packs_of_a_crowded_place_and_of_none(spark):
    df = spark.sql("SELECT id AS obs_id, CASE WHEN id = 0 THEN NULL ELSE -0.0 + (id % 3 = 1)::int * 0D END AS lon, 1D AS lat FROM range(0, 1000)").unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS obs_id, 5D AS lon, 1D AS lat"))
    packs, places = S.in_packs(df, ["lon", "lat"], "__p")
    sizes = [len(r["__p"]) for r in packs.collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 3 * S.PACK and places.count() == 2
    assert any(x.obs_id is None for r in packs.collect() for x in r["__p"])


def test_rows_that_repeat_stay(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 1.0, 0.0), (None, 0.0, 0.0)], "obs_id long, lon double, lat double")
    t = spark.createDataFrame([(9, 0.3, 0.0), (9, 0.3, 0.0)], "tile long, com_lon double, com_lat double")
    got = sorted((r.obs_id or 0, r.tile, r.lon, r.d2) for r in S.in_ellipse(p, t, 1.0, 1.0, finish=lambda c: F.round(c, 1)).collect())
    assert got == [(0, 9, 0.0, 0.1)] * 2 + [(1, 9, 0.0, 0.1)] * 4 + [(2, 9, 1.0, 0.5)] * 2
