"""Recursive state in event time: streams of micro-batches that arrive out of order, against batch folds of the rows in time."""

import math
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from landstream.plans.streams import publish
from landstream.sources.paths import shared
from landstream.streaming import events as E
from landstream.streaming import state as T
from landstream.streaming import windows as W

T0 = datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "k int, n long, ts timestamp, a double, b double, c array<double>, batch int"
DELAY = 3600


def rows(seed=1, batches=5, n=160):
    """Rows of six hours a batch; some come a batch or two later, some have no time or no value."""
    rng, out = random.Random(seed), []
    for i in range(n):
        us = rng.randrange(batches * 6 * 3600 * 10) * 100_000 + 1
        late = rng.choice((0, 0, 0, 0, 1, 2))
        ts = None if rng.random() < 0.03 else T0 + timedelta(microseconds=us)
        a = None if rng.random() < 0.1 else rng.uniform(-3, 3)
        out.append((rng.choice((1, 2, None)), i, ts, a, rng.uniform(-3, 3), [rng.uniform(-1, 1), rng.uniform(-1, 1)], us // (6 * 3600 * 10**6) + late))
    return out


def in_time(made):
    """(rows not late, the last watermark) by Spark's rule: a batch's late rows aren't after the watermark that the batch before had."""
    micros = lambda t: (t - T0) // timedelta(microseconds=1)
    tops, seen, held = [], None, []
    for batch in sorted({r[6] for r in made}):
        seen = max(tops[:-1]) // 1000 * 1000 - DELAY * 10**6 if tops[:-1] else None
        mine = [r for r in made if r[6] == batch and r[2] is not None]
        held += [r for r in mine if seen is None or micros(r[2]) > seen]
        tops.append(max([micros(r[2]) for r in mine], default=-(10**18)))
    last = max(tops) // 1000 * 1000 - DELAY * 10**6
    return held, [r for r in held if micros(r[2]) <= last]


def columns(df):
    return df.select("k", "n", "ts", F.unix_seconds("ts").alias("t"), F.col("a").alias("obs"), F.col("a").alias("x"), F.col("a").alias("eps"), F.col("b").alias("pred"), F.col("b").alias("increment"), F.col("b").alias("fcst"),
                     (F.col("b") / 2).alias("ana"), F.lit(1.0).alias("fcstvar"), F.lit(2.0).alias("obsvar"), "c", F.lit(True).alias("assim"))


FOLDS = {
    "obs_bias": (T.obs_bias(600, 7200.0, 20000), "obs double, bias double, assim boolean"),
    "state_bias": (T.state_bias(600.0, 7200.0, 0.1, 2), "x double, flux double"),
    "adaptive_factors": (T.adaptive_factors(0.1, 0.2), "p_factor double, r_factor double"),
    "ar1": (T.ar1_series(0.8), "x double"),
}


def plain(found):
    return {r.n: tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in found}


def same(got, want):
    got, want = plain(got), plain(want)
    assert got.keys() == want.keys()
    close = lambda x, y: math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) if isinstance(x, float) and isinstance(y, float) else x == y
    for n, row in want.items():
        assert all(map(close, got[n], row)), (got[n], row)


def stream_of(spark, made, path):
    df = spark.createDataFrame(made, SCHEMA)
    publish(df, path)
    return W.replay(spark, f"{path}/batch=*", df.drop("batch").schema)


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_stream_is_the_batch_fold_of_rows_in_time(spark, name):
    step, results = FOLDS[name]
    made = rows()
    held, done = in_time(made)
    assert len(held) < sum(r[2] is not None for r in made) and len(done) < len(held)
    schema = f"n long, {results}"
    out = E.fold_events(columns(stream_of(spark, made, shared(spark, "t"))), ["k"], "ts", ["n"], step, schema, ["n"], "1 hour")
    got = W.run_to_table(out, shared(spark, "t")).collect()
    want = T.fold(columns(spark.createDataFrame(done, SCHEMA)), ["k"], ["ts", "n"], step, f"k int, {schema}", ["n"]).collect()
    same(got, want)


def test_start_restart_and_saved_state(spark):
    """Batch, then a stream that is stopped and goes on, then its state: all as one fold."""
    step, results = FOLDS["obs_bias"]
    schema = f"n long, {results}"
    made = rows(2)
    past = [(k, 1000 + n, T0 - timedelta(hours=30 - n), 1.0 + n, 0.5, [0.0, 0.0], 0) for n in range(20) for k in (1, None, 9)]
    _, done = in_time(made)
    start = T.last_state(columns(spark.createDataFrame(past, SCHEMA)), ["k"], ["ts", "n"], step, "k int")
    files, path, setting = shared(spark, "t"), shared(spark, "t"), "spark.sql.streaming.noDataMicroBatches.enabled"
    try:
        for i, part in enumerate(([r for r in made if r[6] < 3], [r for r in made if r[6] >= 3])):
            spark.conf.set(setting, str(bool(i)).lower())
            df = spark.createDataFrame(part, SCHEMA)
            publish(df, f"{files}/{i}")
            stream = W.replay(spark, f"{files}/*/batch=*", df.drop("batch").schema)
            out = W.run_to_table(E.fold_events(columns(stream), ["k"], "ts", ["n"], step, schema, ["n"], "1 hour", start=start), path)
    finally:
        spark.conf.set(setting, "true")
    both = columns(spark.createDataFrame(past + done, SCHEMA))
    same(out.collect(), [r for r in T.fold(both, ["k"], ["ts", "n"], step, f"k int, {schema}", ["n"]).collect() if r.n < 1000])
    held = {r.k: step.load(r.state) for r in E.saved_state(spark, f"{path}/log", ["k"], "k int").collect()}
    for r in T.last_state(both, ["k"], ["ts", "n"], step, "k int").collect():
        want = step.load(r.state)
        assert all(float(held[r.k][c]) == pytest.approx(float(want[c]), nan_ok=True) for c in want)
    waiting, _ = in_time(made)
    assert sorted(r.n for r in E.held_rows(spark, f"{path}/log", ["k"], "k int").collect()) == sorted({r[1] for r in waiting} - {r[1] for r in done})


def test_late_split_keeps_every_row_once(spark):
    made = rows(3)
    held, _ = in_time(made)
    path = shared(spark, "t")
    main, side = E.late_split(stream_of(spark, made, shared(spark, "t")), path, late="1 hour")
    ids = sorted(r[1] for r in held) + sorted(r[1] for r in made if r[2] is None)
    assert sorted(r.n for r in main.collect()) == sorted(ids) and len(side.take(1)) == 1
    assert sorted(r.n for r in main.unionByName(side).collect()) == sorted(r[1] for r in made)


def test_reserved_columns_are_refused(spark):
    with pytest.raises(ValueError, match="underscore"):
        E.fold_events(spark.createDataFrame([], "k int, _n long, ts timestamp"), ["k"], "ts", [], FOLDS["ar1"][0], "x double", [])


def test_keys_share_the_state_of_a_group(spark):
    """2,000 keys have no more states than groups, and each its own fold."""
    step, results = FOLDS["ar1"]
    made = [(n % 2000, n, T0 + timedelta(seconds=n), float(n % 7), 0.0, [0.0, 0.0], n // 4000) for n in range(8000)]
    path = shared(spark, "t")
    schema = f"n long, {results}"
    out = W.run_to_table(E.fold_events(columns(stream_of(spark, made, shared(spark, "t"))), ["k"], "ts", ["n"], step, schema, ["n"], "1 hour", groups=16), path).collect()
    states = spark.read.format("statestore").option("stateVarName", "state").load(f"{path}/log")
    assert 0 < states.count() <= 16
    done = [r for r in made if r[1] <= 7999 - DELAY]
    want = T.fold(columns(spark.createDataFrame(done, SCHEMA)), ["k"], ["ts", "n"], step, f"k int, {schema}", ["n"]).collect()
    same(out, want)
    assert E.saved_state(spark, f"{path}/log", ["k"], "k int").count() == len({r[0] for r in done})
