"""Order statistics by refinement against sorted lists, and what they shuffle."""

import math
import random

import pytest
from pyspark.sql import functions as F

from landstream.operators import climatology as C
from landstream.operators import ensemble as E
from landstream.operators.order_stats import FINER, cell, order_statistics

RANKS = {"low": lambda n: F.lit(1), "mid": lambda n: F.ceil(n / 2), "high": lambda n: n, "none": lambda n: n + 1}


def by_loops(rows):
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    order = lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v)
    out = {}
    for k, vs in groups.items():
        vs = sorted(vs, key=order)
        out[k] = (len(vs), vs[0], vs[-(-len(vs) // 2) - 1], vs[-1], None)
    return out


@pytest.mark.parametrize("kind", ["wide", "narrow", "ties", "odd"])
def test_ranks_by_loops(spark, kind):
    rng = random.Random(kind)
    draw = {
        "wide": lambda: rng.choice((-1, 1)) * math.exp(rng.uniform(-600, 600)),
        "narrow": lambda: 280.0 + rng.gauss(0, 1e-9),
        "ties": lambda: float(rng.randrange(3)),
        "odd": lambda: rng.choice((0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, math.inf, -math.inf, None, 1.0)),
    }[kind]
    rows = [(rng.choice(("hot", "hot", "hot", "b", None)), draw()) for _ in range(2000)] + [("nulls", None), ("one", 2.5)]
    if kind == "odd":
        rows += [("hot", math.nan)] * 3
    got = order_statistics(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", RANKS).collect()
    # One zero, and NaN equal to itself.
    plain = lambda row: [repr(x + 0.0) if x is not None else None for x in row]
    assert {r.k: plain(tuple(r)[1:]) for r in got} == {k: plain(v) for k, v in by_loops(rows).items()}


def test_whole_numbers_keep_their_type(spark):
    df = spark.createDataFrame([("a", 2**62 + i) for i in range(50)], "`a.b` string, v long")
    r = order_statistics(df, ["a.b"], "v", RANKS).first()
    assert (r.low, r.mid, r.high) == (2**62, 2**62 + 24, 2**62 + 49)


def test_cells_are_nested_and_in_order(spark):
    rng = random.Random(3)
    values = sorted(rng.choice((-1, 1)) * math.exp(rng.uniform(-700, 700)) for _ in range(3000)) + [math.inf, math.nan]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", cell(F.col("v"), 0).alias("a"), cell(F.col("v"), 1).alias("b"))
    rows = df.orderBy("i").collect()
    assert all(x.a <= y.a and x.b <= y.b for x, y in zip(rows, rows[1:], strict=False))
    assert all(r.b // FINER == r.a for r in rows)


def test_windows_around_the_year(spark):
    """Percentiles and sums of circular windows with one hot tile, by loops over copies of the samples."""
    rng = random.Random(8)
    rows = [(rng.choice((1, 1, 1, 1, 2, None)), 60_000 * rng.randrange(1440 * 365), rng.choice((None, rng.gauss(300, 9), 295.0))) for _ in range(3000)]
    df = spark.createDataFrame([(t, ms / 1000, v) for t, ms, v in rows], "tile int, s double, v double").select("tile", F.timestamp_seconds(F.col("s") + 1672531200).alias("time"), "v")
    pools = {}
    for tile, ms, v in rows:
        if v is not None:
            p = ms // 86_400_000 // 5
            for d in (-2, -1, 0, 1, 2):
                pools.setdefault((tile, (p + d) % 73 + 1), []).append(v)
    percents = list(range(1, 100))
    got = {(r.tile, r.pentad): tuple(r)[2:] for r in C.clim_percentiles(df, ["tile"], "v", percents).collect()}
    assert got == {k: (len(v), *(sorted(v)[max((p * len(v) + 50) // 100, 1) - 1] for p in percents)) for k, v in pools.items()}
    for r in C.clim_stats(df, ["tile"], "v").collect():
        v = pools[r.tile, r.pentad]
        mean = math.fsum(v) / len(v)
        sd = math.sqrt(math.fsum((x - mean) ** 2 for x in v) / (len(v) - 1)) if len(v) > 1 else None
        assert (r.n, r.min, r.max) == (len(v), min(v), max(v)) and r.mean == pytest.approx(mean, rel=1e-12)
        assert r.stdv == (None if sd is None else pytest.approx(sd, rel=1e-9, abs=1e-9))


def test_five_numbers_of_no_rows(spark):
    assert E.five_number(spark.createDataFrame([], "k int, x double"), ["k"], "x").collect() == []


def test_shuffled_rows_follow_the_cells(spark):
    """Ten times the samples of the same spread: counts of cells move in place of samples."""

    def moved(n):
        df = spark.range(n, numPartitions=2).select((F.col("id") % 2).alias("k"), (F.lit(270.0) + F.rand(1) * 30).alias("v"))
        out = order_statistics(df, ["k"], "v", {"mid": lambda n: F.ceil(n / 2)})
        assert out.count() == 2
        nodes, written = [out._jdf.queryExecution().executedPlan()], []
        out.collect()
        while nodes:
            node = nodes.pop()
            name = node.nodeName()
            if name == "AdaptiveSparkPlan":
                nodes.append(node.executedPlan())
            elif name.endswith("QueryStage"):
                nodes.append(node.plan())
            else:
                if name == "Exchange":
                    written.append(node.metrics().apply("shuffleRecordsWritten").value())
                children = node.children()
                nodes += [children.apply(i) for i in range(children.size())]
        return max(written)

    assert moved(300_000) <= 300_000 / 50
