"""Windows over ranges, with one key that has nearly all rows, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from landstream.functions.grid import curve
from landstream.operators import analysis as A
from landstream.operators import forcing as W
from landstream.operators import spatial as S
from landstream.operators.ranges import in_ranges


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables would otherwise be one range."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def keyed(rng, n):
    return [(rng.choice(("hot", "hot", "hot", "hot", "b", None)), rng.randrange(500), rng.choice((None, float(rng.randrange(9))))) for _ in range(n)]


def test_asof_of_a_hot_key(spark):
    rng = random.Random(6)
    times, records = keyed(rng, 400), keyed(rng, 60) + [("only", 3, 1.0)]
    df = lambda rows: spark.createDataFrame(rows, "k string, time int, v double")
    got = sorted(((r.k, r.time, r.prv_time, r.v_prv, r.nxt_time, r.v_nxt) for r in W.bracket_asof(df(times), df(records), ["k"], "v").collect()), key=repr)
    want, rank = [], lambda r: (r[1], r[2] is not None, r[2] or 0.0)
    for k, t, _ in times:
        mine = sorted((r for r in records if r[0] == k), key=rank)
        prv = [r for r in mine if r[1] <= t][-1:] or [(None,) * 3]
        nxt = [r for r in mine if r[1] > t][:1] or [(None,) * 3]
        want.append((k, t, *prv[0][1:], nxt[0][1], None))
    assert sorted((g[:5] for g in got), key=repr) == sorted((w[:5] for w in want), key=repr)
    for k, t, _, _, after, v in got:
        assert after is None or v in {r[2] for r in records if r[0] == k and r[1] == after}


def test_a_hot_key_is_in_many_ranges(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("k"), "id")
    ranged = in_ranges(rows, ["k"], ["id"])
    assert ranged.select("__range").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions")) and ranged.count() == 4000


def test_next_tile_over_borders(spark):
    rng = random.Random(7)
    rows = [(k, t, rng.uniform(0, 1), rng.uniform(0, 1), rng.choice((None, 1.0 * t))) for k in ("hot", None) for t in rng.sample(range(3000), 600)]
    got = {(r.k, r.tile): r.v for r in W.fill_from_next_tile(spark.createDataFrame(rows, "k string, tile int, lon double, lat double, v double"), ["k"], "v", 0.6).collect()}
    for k in ("hot", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for a, b in zip(mine, [*mine[1:], None], strict=True):
            near = b is not None and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 0.36
            assert got[k, a[1]] == (a[4] if a[4] is not None else b[4] if near else None)
    assert len(got) == len(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, time int, v double")
    assert W.bracket_asof(none, none, ["k"], "v").count() == 0


def test_blocks_have_equal_work_and_follow_place(spark):
    """Blocks by prefix sums along the curve: none has more than twice the median's pairs, and an observation is in few of them."""
    rng = random.Random(9)
    tiles = [(rng.randrange(10**9), rng.gauss(0, 40) % 360 - 180, max(-89.0, min(89.0, rng.gauss(20, 25)))) for _ in range(3000)]
    obs = [(i, rng.gauss(0, 40) % 360 - 180, max(-89.0, min(89.0, rng.gauss(20, 25)))) for i in range(4000)]
    t = spark.createDataFrame(tiles, "tile long, com_lon double, com_lat double")
    met = S.local_obs(t, spark.createDataFrame(obs, "obs_id int, lon double, lat double"), 3.0, 3.0).select("tile", "obs_id").cache()
    made = A.blocks(t, met, 512).collect()
    counts = {r[0]: r[1] for r in met.groupBy("tile").count().collect()}
    assert {r.tile: r.n for r in made} == counts
    work = {}
    for r in made:
        work[r.block] = work.get(r.block, 0) + r.n
    inner = sorted(v for k, v in work.items() if k != max(work))  # the last block is what is left
    assert len(work) > 20 and inner[-1] <= 2 * inner[len(inner) // 2]
    of = {r.tile: r.block for r in made}
    shared, by_number, ordered = {}, {}, sorted(of)
    place = {x: i // (len(ordered) // len(work)) for i, x in enumerate(ordered)}
    for r in met.collect():
        shared.setdefault(r.obs_id, set()).add(of[r.tile])
        by_number.setdefault(r.obs_id, set()).add(place[r.tile])
    mean = lambda d: sum(map(len, d.values())) / len(d)
    assert mean(shared) < 5 and mean(shared) < mean(by_number) / 2


def test_the_curve_interleaves_bits(spark):
    row = spark.range(1).select(curve(F.lit(-180.0 + 360 * 5 / 8), F.lit(-90.0 + 180 * 3 / 8), 3).alias("a"), curve(F.lit(180.0), F.lit(90.0)).alias("b"), curve(F.lit(-180.0), F.lit(-90.0)).alias("c")).first()
    assert row.a == 0b011011 and row.b == (1 << 40) - 1 and row.c == 0
