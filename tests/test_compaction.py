"""Compacted sums against sums of all rows: few parts, replays that change nothing, and failures between the two phases."""

import random

import pytest
from pyspark.sql import functions as F

from landstream.sources.paths import shared
from landstream.streaming.compaction import MonthlySums


def partial(df):
    return df.groupBy("month", "k").agg(F.count("*").alias("n"), F.sum("v").alias("v_sum"))


def batches(n):
    rng = random.Random(n)
    return [[(f"2024-{rng.randint(1, 4):02d}-01", rng.randrange(3), float(rng.randrange(100))) for _ in range(20)] for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "month string, k int, v double").withColumn("month", F.to_date("month"))


def plain(made):
    out = {}
    for m, k, v in (r for b in made for r in b):
        n, s = out.get((m, k), (0, 0.0))
        out[m, k] = n + 1, s + v
    return out


def read(sums):
    return {(str(r.month), r.k): (r.n, r.v_sum) for r in sums.read().collect()}


def test_few_parts_and_replays(spark):
    sums, made = MonthlySums(spark, shared(spark, "c"), partial, ["month", "k"], every=3), batches(8)
    for i, rows in enumerate(made):
        sums.put(frame(spark, rows), i)
        folded, months = sums.manifest()
        assert len(sums.parts(folded)) < 3 and len(months) <= 4
        assert read(sums) == plain(made[: i + 1])
    for i in (7, 6, 0, 7):  # a part that waits is written again, a folded one is left
        sums.put(frame(spark, made[i]), i)
        assert read(sums) == plain(made)
    assert sums.manifest()[0] == 5 and sums.parts(-1) == [3, 4, 5, 6, 7]


def test_failure_before_the_manifest(spark, monkeypatch):
    """Months that are written without a manifest don't count, and the batch that runs again folds them."""
    sums, made = MonthlySums(spark, shared(spark, "c"), partial, ["month", "k"], every=2), batches(4)
    for i in range(3):
        sums.put(frame(spark, made[i]), i)

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(sums, "_rename", fail)
    with pytest.raises(RuntimeError):
        sums.put(frame(spark, made[3]), 3)
    monkeypatch.undo()
    assert sums.manifest()[0] == 1 and read(sums) == plain(made)
    sums.put(frame(spark, made[3]), 3)
    assert sums.manifest()[0] == 3 and read(sums) == plain(made)


def test_months_are_wanted(spark):
    with pytest.raises(ValueError, match="month"):
        MonthlySums(spark, "x", partial, ["k"])
    with pytest.raises(ValueError, match="no sums"):
        MonthlySums(spark, shared(spark, "c"), partial, ["month", "k"]).read()
