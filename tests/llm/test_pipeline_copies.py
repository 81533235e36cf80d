"""The pipeline's second stage: near copies go, and documents that surely stay aren't shuffled."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_go_without_a_shuffle_of_the_rest(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join([*base[: 199 - i % 3], f"v{i}"]), "en", "web", 1) for i in range(5)] + [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(50)), "en", "web", 1) for i in range(10, 300)]
    docs = spark.createDataFrame([*rows, (None, rows[0][1], "en", "web", 1), (None, None, None, None, None)], DOCS)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    got = sorted(r.doc_id for r in out.where(F.col("doc_id").isNotNull()).collect())
    assert got == [0, *range(10, 300)] and out.where("doc_id IS NULL").count() == 2 and out.columns == docs.columns
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kept = plan[plan.index("Union") :].split("Join LeftAnti")
    assert len(kept) == 2 and "LeftOuter" in kept[0], "most documents pass by the bitmap alone"
