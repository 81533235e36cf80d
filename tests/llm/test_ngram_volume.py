"""The n-gram join: what it sends doesn't grow with its fragments, and sets that only share a passage aren't compared."""

import random

import pytest

from landstream.llm import common, ngram_join

DOCS = "doc_id long, text string"


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def written_bytes(docs, fragment_bytes, monkeypatch):
    """Bytes of all tables that the join writes, but for Parquet's footers."""
    monkeypatch.setattr(ngram_join, "FRAGMENT_BYTES", fragment_bytes)
    sizes = []

    def watched(df, name="table"):
        out = common.written(df, name)
        sizes.append(sum(len(v) for row in out.collect() for v in row if isinstance(v, bytes | bytearray)))
        return out

    monkeypatch.setattr(ngram_join, "written", watched)
    ngram_join.ngram_components(docs).collect()
    return sum(sizes)


def test_more_fragments_write_no_more(spark, monkeypatch):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 300))) for i in range(60)], DOCS).coalesce(1)
    few, many = (written_bytes(docs, size, monkeypatch) for size in (1 << 20, 1 << 10))
    assert many <= 1.2 * few + 1000


def test_bytes_a_shingle_of_the_sift(spark):
    """With as many fragments as a set has shingles, a shingle takes its 4 bytes, its owner's 2 and a length."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 400))) for i in range(50)], DOCS).coalesce(1)
    plan = ngram_join.sift(docs, 5, 75, 200, 1)
    assert plan.collect() == []
    owners, lengths = ngram_join._runs(ngram_join.np.repeat([3, 7, 9], [1, 600, 2]))
    assert (len(owners), len(lengths)) == (2 * 5, 5)
    assert ngram_join.np.repeat(ngram_join.np.frombuffer(owners, "u2"), ngram_join.np.frombuffer(lengths, "u1")).tolist() == [3] + [7] * 600 + [9] * 2


def test_a_shared_passage_is_no_pair(spark):
    """Sets that share a tenth meet in their prefixes, but too seldom to link; near copies stay pairs."""
    rng = random.Random(3)
    passage = words(rng, 20)
    texts = [passage + words(rng, 180) for _ in range(12)]
    texts += [[*texts[0][:-4], *words(rng, 4)]]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS)
    sets = ngram_join.document_sets(rows, 5)
    keyed = sets.join(rows, "doc_id").select("key", "text")
    postings = ngram_join.prefixes(ngram_join.segments(keyed, 5, 4), 75, 4)
    known = spark.createDataFrame([], "node long, component long")
    found = [(a, b) for r in ngram_join.rest(postings, known, 75, 4).collect() for a, b in zip(ngram_join.np.frombuffer(r.a, "i8"), ngram_join.np.frombuffer(r.b, "i8"), strict=True)]
    key = {r.doc_id: r.key for r in sets.collect()}
    assert found == [tuple(sorted((key[0], key[12])))]


@pytest.mark.parametrize("seed", [4, 5])
def test_links_about_the_threshold(spark, seed, monkeypatch):
    """Sets of other sizes and overlaps about the threshold, with common passages: components as by all pairs."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(seed)
    passages, texts = [words(rng, 30) for _ in range(3)], []
    for _ in range(25):
        base = words(rng, rng.randrange(5, 120)) + rng.choice(passages)
        for _ in range(4):
            cut, t = rng.randrange(0, len(base) // 5 + 2), list(base)
            at = rng.randrange(len(t))
            t[at : at + cut] = words(rng, rng.choice([0, cut]))
            texts.append(t)
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    least = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS)).collect()}
    assert got == dict(enumerate(least))


def test_rows_are_left_out_but_none_is_lost(spark, monkeypatch):
    df = spark.createDataFrame([(i,) for i in range(3000)] + [(None,)], "doc_id long")
    ids = spark.range(0, 3000, 10).select("id")
    kept = [r.doc_id for r in common.marked(df, "doc_id", ids).where("__maybe").collect()]
    assert set(range(0, 3000, 10)) <= set(kept) and len(kept) < 500
    assert common.marked(df, "doc_id", ids).count() == 3001
    monkeypatch.setattr(common, "BITMAP_BITS", 256)
    assert {r.doc_id for r in common.marked(df, "doc_id", ids).where("__maybe").collect()} >= set(range(0, 3000, 10))
    assert common.marked(df, "doc_id", ids.limit(0)).where("__maybe").count() == 0
