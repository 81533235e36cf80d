"""The data source of raw observation files: bytes written here by hand, and which files are opened."""

import struct
from datetime import datetime, timedelta, timezone

import pytest

from landstream.sources import obs_source as O
from landstream.sources.ingest import _OBS, read_obs_fcst_ana


def raw(when, n, order="<"):
    def rec(data):
        return struct.pack(f"{order}i", len(data)) + data + struct.pack(f"{order}i", len(data))

    out = rec(struct.pack(f"{order}9i", n, when.year, when.month, when.day, when.hour, when.minute, when.second, 1, 0))
    for at, (name, kind) in enumerate(_OBS):
        values = [-9999.0 if name in ("ana", "obs") else at + i for i in range(n)]
        out += rec(struct.pack(f"{order}{n}{'i' if kind == 'i4' else 'f'}", *values))
    return out


def name(exp, day):
    return f"{exp}.ens_avg.obs.202001{day:02d}_0300z.bin"


@pytest.fixture
def folder(tmp_path):
    for exp in ("a", "b"):
        for day in range(1, 11):
            when = datetime(2020, 1, day, 3, 0, 30)
            d = tmp_path / exp / "M01"
            d.mkdir(parents=True, exist_ok=True)
            (d / name(exp, day)).write_bytes(raw(when, day % 3))
    return tmp_path


def test_a_window_opens_only_its_files(spark, folder):
    whole = O.read_window(spark, str(folder), columns=["time", "assim", "obs"])
    assert whole.rdd.getNumPartitions() == 20 and whole.columns == ["time", "assim", "obs"]
    some = O.read_window(spark, str(folder), datetime(2020, 1, 3, 3, 0, 30), datetime(2020, 1, 8, 3, 0, 30), ["b"], ["exp", "obs", "ana", "assim"])
    # The time of the file of the 3rd is on the border, and its name leaves out the seconds.
    assert some.rdd.getNumPartitions() == 6
    for day in (1, 2, 9, 10):
        (folder / "b" / "M01" / name("b", day)).write_bytes(b"broken")
    rows = some.collect()
    assert len(rows) == sum(d % 3 for d in range(4, 9)) and {r.exp for r in rows} == {"b"}
    assert all(r.obs == -9999.0 and r.ana is None for r in rows) and sum(r.assim for r in rows) == 2
    with pytest.raises(Exception, match="broken record"):
        whole.count()


def test_filters_of_one_query_stay_in_it(spark, folder):
    """With pushed filters on, and with zones in the window's times."""
    key, zone = "spark.sql.python.filterPushdown.enabled", timezone(timedelta(hours=-5))
    spark.conf.set(key, "true")
    try:
        df = O.read_window(spark, str(folder))
        assert df.where("exp = 'b'").count() == 10 and df.count() == 20
        assert df.where("exp = 'a'").unionByName(df.where("exp = 'b'")).count() == 20
        late = O.read_window(spark, str(folder), after=datetime(2020, 1, 7, 22, 0, 29, tzinfo=zone), until=datetime(2020, 1, 7, 22, 0, 30, tzinfo=zone))
        assert late.count() == 4 and late.rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset(key)


def test_rows_are_those_of_the_plain_reader(spark, folder):
    columns = ["time", "exp", *(n for n, _ in _OBS)]
    got = O.read_window(spark, str(folder), columns=columns, exp="e")
    want = read_obs_fcst_ana(spark, str(folder), "e").select(columns)
    assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 20


def test_empty_folders_and_foreign_names(spark, tmp_path):
    assert O.read_window(spark, f"file:{tmp_path}").collect() == []
    (tmp_path / "noname.bin").write_bytes(raw(datetime(2020, 5, 1), 2))
    read = lambda **k: O.read_window(spark, str(tmp_path), **k).count()
    assert (read(after=datetime(2019, 1, 1)), read(until=datetime(2019, 1, 1)), read(exps=["x"]), read(exps=["x"], exp="x")) == (2, 0, 0, 2)
    (tmp_path / "noname.bin").write_bytes(raw(datetime(2020, 5, 1), 2, ">"))
    assert read(order=">") == 2


def test_names_against_windows():
    exp, when = O.named("/x/e1.z.20200103_0300z.bin")
    assert (exp, when) == ("e1", datetime(2020, 1, 3, 3)) and O.named("20200103_0300z.bin") == (None, when)
    assert O.named("e.20201399_0300z.bin") == (None, None) == O.named("other.bin")
    second = timedelta(seconds=1)
    for off in (-61, -60, -59, -1, 0, 1, 58, 59, 60, 61):
        edge = when + off * second
        assert O.may_hold(when, None, edge, None, None) == any(when + s * second > edge for s in range(60))
        assert O.may_hold(when, None, None, edge, None) == any(when + s * second <= edge for s in range(60))
    assert not O.may_hold(when, "e1", None, None, ["e2", "e3"]) and O.may_hold(when, "e1", None, None, ["e1"])
