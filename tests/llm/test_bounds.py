"""Bounds that must hold at any size: shares, depths, files, folders, and the trees' recall at real depth."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from landstream.llm import common, embedding_dedup, language_id, token_counts, warc


def test_shares_of_very_many_rows_are_not_nothing():
    for n in (10**6, 10**9, 10**12, 10**15):
        for share in (embedding_dedup.sampling_share(n), language_id.sampling([("x", n), ("y", 5)])[0][1]):
            assert share > -(1 << 63) + 1000
    assert embedding_dedup.sampling_share(5) == (1 << 63) - 1
    assert len(language_id.sampling([(str(i), 10**12) for i in range(500)])) == 500


def test_depth_follows_the_largest_label():
    assert embedding_dedup.tree_depth(300, 20_000) == 0
    assert embedding_dedup.tree_depth(400 * 256, 20_000) == 8
    assert embedding_dedup.tree_depth(10**12, 20_000) == 11


def test_vectors_whose_squares_overflow_or_vanish():
    rows = [[1e200, 2e200], [1e-200, 2e-200], [0.0, 0.0], [np.inf, 1.0], [np.nan, 1.0], [3.0, 4.0], []]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    good, unit = embedding_dedup.unit_vectors(offsets, np.array([x for r in rows for x in r]))
    assert good.tolist() == [True, True, False, False, False, True, False]
    assert np.allclose(unit[[0, 1, 2, 3]], np.tile([1, 2], 2) / np.sqrt(5)) and np.allclose(unit[10:12], [0.6, 0.8])


def planted(kind, n, pairs, seed, d=64):
    """Unit vectors, of which `pairs` have a partner at cosine 0.98 to 0.985 further on: isotropic, about a common mean, or with a
    spectrum that falls off."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    if kind == "spectrum":
        x *= np.arange(1, d + 1) ** -0.5
        x += 2.6 * np.eye(d)[0]
    elif kind:
        common = np.ones(d) / np.sqrt(d)
        x = np.sqrt(1 - kind) * x / np.linalg.norm(x, axis=1, keepdims=True) + np.sqrt(kind) * common
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal((pairs, d)) if kind != "spectrum" else rng.standard_normal((pairs, d)) * np.arange(1, d + 1) ** -0.5
    off -= (off * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = rng.uniform(0.98, 0.985, (pairs, 1))
    return x, cosine * x[:pairs] + np.sqrt(1 - cosine**2) * off


@pytest.mark.parametrize("depth", [8, 11])
@pytest.mark.parametrize("kind", [0, 0.9, 0.94, "spectrum"])
def test_recall_of_the_forest_at_depth(kind, depth):
    x, near = planted(kind, 20_000, 600, depth)
    forest = embedding_dedup.grow(x, depth)
    both = np.concatenate([x[:4000], near])
    row, leaf = forest.leaves(both)
    leaves = [set() for _ in range(len(both))]
    for r, v in zip(row.tolist(), leaf.tolist(), strict=True):
        leaves[r].add(v)
    assert sum(bool(leaves[i] & leaves[4000 + i]) for i in range(600)) >= 0.9 * 600
    if kind == 0:  # leaves do prune: unrelated vectors seldom share one
        assert np.mean([bool(leaves[i] & leaves[i + 1500]) for i in range(2000)]) < 0.5


def test_vectors_that_are_all_near_one_another_stay_together():
    """All pairs are links: hardly a node is split, and all pairs but few meet, at any depth."""
    rng = np.random.default_rng(1)
    x = np.ones((5000, 32)) + 0.01 * rng.standard_normal((5000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = embedding_dedup.grow(x, 6)
    row, leaf = forest.leaves(x)
    leaves = [set() for _ in range(5000)]
    for r, v in zip(row.tolist(), leaf.tolist(), strict=True):
        leaves[r].add(v)
    assert np.isinf(forest.bounds).mean() > 0.8
    assert np.mean([bool(leaves[i] & leaves[i + 2500]) for i in range(2500)]) >= 0.95


@pytest.mark.parametrize("kind", [0, 0.9, "spectrum"])
def test_whole_job_at_depth_against_all_pairs(spark, monkeypatch, kind):
    """near_duplicates() with splits: at least 0.9 of the links of all pairs, and none else; components from them."""
    monkeypatch.setattr(embedding_dedup, "LEAF", 20)
    x, near = planted(kind, 2500, 400, 3)
    rows = np.concatenate([x, near])
    assert embedding_dedup.tree_depth(len(rows), len(rows), 64) >= 7
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    close = rows @ rows.T >= 0.98
    np.fill_diagonal(close, False)
    want = close.sum(1)
    assert len(got) == len(rows) and all(got[i].n_links <= want[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.9 * want.sum() > 0
    linked = {i for i in got if got[i].component_id != i}
    assert all(want[i] for i in linked) and all(got[i].kept == (i not in linked) for i in got)


def test_a_shared_folder_is_needed_on_a_cluster():
    class Elsewhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="must name a folder"):
        common.shared_path(Elsewhere, "x")


def test_archives_are_bounded_by_bytes_and_read_by_parts(spark, monkeypatch):
    monkeypatch.setattr(warc, "BYTES_PER_FILE", 40_000)
    monkeypatch.setattr(warc, "CHUNK", 1000)
    rows = [(i, "u", chr(97 + i) * (9000 + i)) for i in range(10)] + [(20, "v", "\r\n\r\nWARC/1.1\r\n\r\n" * 50)]
    path = common.shared_path(spark, "bounded")
    pages = spark.createDataFrame(rows, "page_id long, url string, payload string").withColumn("record_type", F.lit("clash")).coalesce(1)
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.deduplicate_pages(pages, path, date="2030-02-03T00:00:00Z").collect()}
    assert back == {i: p for i, _, p in rows}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()
    sizes = [len(gzip.decompress(bytes(f["content"]))) for f in files]
    assert max(sizes) < 45_000 and b"WARC-Date: 2030-02-03T00:00:00Z" in gzip.decompress(bytes(files[0]["content"]))
    whole = [gzip.decompress(bytes(f["content"])) for f in files]
    several = b"".join(gzip.compress(w) for w in whole)  # one member after the other, as other writers do
    assert len(list(warc.parse_archive(warc._inflated(several)))) == len(rows)
    with pytest.raises(ValueError):
        list(warc.parse_archive(warc._inflated(several[:-30])))


def test_words_are_counted_once_a_task(monkeypatch):
    pieces = token_counts.PieceTable({b"a": -1.0, b"ab": -1.5, "▁".encode(): -1.0, "▁ab".encode(): -1.2})
    known, seen = token_counts.KnownWords(), []
    inner = pieces.terminal_counts
    pieces.terminal_counts = lambda starts, sizes, raw: seen.append(len(starts)) or inner(starts, sizes, raw)
    for t, want in ((b"ab abab a", [1 + 2 + 2]), (b"abab a ab ab", [2 + 2 + 1 + 1]), (b"ab b", [1 + 2])):
        assert token_counts.count_group(pieces, np.array([0, len(t)]), np.frombuffer(t, np.uint8), known).tolist() == want
    assert seen == [3, 1]
    monkeypatch.setattr(token_counts, "MAX_WORDS", 2)
    assert token_counts.count_group(pieces, np.array([0, 9]), np.frombuffer(b"ab abab a", np.uint8), known).tolist() == [5]


def test_a_long_page_leaves_other_files_full(spark, tmp_path):
    """One page of 50 MB among 3000 of 4 bytes or less: the others stay in one file for each task."""
    long = spark.range(1).select(F.lit(-1).cast("long").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("0123456789"), 5_000_000).alias("payload"))
    short = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("payload"))
    path = tmp_path / "archives"
    back = warc.deduplicate_pages(short.unionByName(long), str(path))
    assert back.agg(F.count("*"), F.sum("payload_bytes"), F.countDistinct("page_id")).first()[:] == (3001, 50_000_000 + 10 + 180 + 2700 + 8000, 3001)
    counts = sorted(sum(1 for _ in warc.parse_archive(warc._inflated(f.read_bytes()))) for f in path.glob("*.gz"))
    # Up to four tasks write the short ones; a task without rows may leave an empty file.
    assert sum(counts) == 3001 and counts.count(1) == 1 and len([n for n in counts if n > 1]) <= 4


@pytest.mark.parametrize("n", [None, 0, 1, 107_374, 107_375, 214_748, 214_749, 2**31 - 1])
def test_classes_bound_the_bytes_of_files(spark, n):
    k = warc.size_classes(spark.createDataFrame([(n,)], "n long"))[0]
    assert max(1, warc.RECORDS_PER_FILE >> k) * (n or 0) <= warc.BYTES_PER_FILE or warc.RECORDS_PER_FILE >> k <= 1
    assert k == 0 or (n or 0) > (warc.BYTES_PER_FILE // warc.RECORDS_PER_FILE) << (k - 1)
