"""Cases of the corpus operators that an earlier form of them lost."""

import numpy as np
import pytest

import corpus_pipeline
from landstream.llm import decontamination, language_id, toxicity

from .test_small_tables import DOCS, ITEMS, brute_items, text


# Decontamination
def test_items_of_one_word_are_found(spark):
    docs = [(1, "x supercalifragilistic y"), (2, "supercalifragilistic"), (3, "unsupercalifragilistics"), (4, "x supercalfragilistik y"), (5, text(1, 50)), (6, ITEMS[0][1])]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert got == brute_items(docs) == {(1, 5), (2, 5), (3, 5), (4, 5), (6, 1)}


def test_items_without_spaces_are_found_inside_longer_text(spark):
    item = "東京都の人口は世界で最も多いと言われている"
    docs = [(1, f"はじめに{item}終わり"), (2, item.replace("最も", "一番")), (3, "東京都の天気"), (4, item)]
    got = {r["doc_id"]: r["distance"] for r in decontamination.find_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[1] == got[4] == 0 and 0 < got[2] <= len(item.encode()) // 10 and 3 not in got


@pytest.mark.parametrize("words,letters", [(3, (2, 4)), (12, (1, 4)), (35, (2, 9)), (90, (2, 9)), (1, (30, 31))])
def test_all_items_at_the_edit_limit_are_found(words, letters):
    rng = np.random.default_rng(words)
    items = [(i, " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(*letters))) for _ in range(words)) + " zyxwvutsrqp") for i in range(40)]
    block, within = decontamination.Items(items), 0
    for i, t in items:
        body = list(t)
        # As many edits as may be, spread so that each pair of words is touched if there are enough of them.
        k = len(t) // 10
        for p in (np.arange(k) + 0.5) * len(t) // k:
            body[int(p)] = str(rng.choice(["", "Q", body[int(p)] + "q"]))
        raw = np.frombuffer(f"{text(i, 30)} {''.join(body)} {text(i + 7, 30)}".encode(), np.uint8)
        got = {r[1]: r[2:] for r in decontamination.find_in_group(block, np.array([0, len(raw)]), raw)}
        want = decontamination.part_distance(t.encode(), decontamination.plain(raw))
        # A deleted word of one letter takes a space with it, which may be over the limit.
        within += want[0] <= k
        assert got.get(i) == (want if want[0] <= k else None)
    assert within >= 36


def test_an_edit_in_the_only_long_word_loses_nothing():
    item = "a is to be in on at it as extraordinariness of or by we he me up so no go"
    block = decontamination.Items([(1, item)])
    raw = np.frombuffer(b"x " + item.replace("dinari", "denari").encode() + b" y", np.uint8)
    assert decontamination.find_in_group(block, np.array([0, len(raw)]), raw) == [(0, 1, 1, len(item) + 2)]


def test_part_distance_is_the_edit_distance():
    rng = np.random.default_rng(9)
    for _ in range(60):
        item, whole = (bytes(rng.integers(97, 100, n).tolist()) for n in (rng.integers(1, 90), rng.integers(0, 120)))
        row = [0] * (len(whole) + 1)
        for i, c in enumerate(item):
            new = [i + 1]
            for j, x in enumerate(whole):
                new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1))
            row = new
        assert decontamination.part_distance(item, whole) == (min(row), row.index(min(row)))


# Toxicity
def test_every_window_is_compressed_with_both_dictionaries(spark):
    """Lengths, counts and scores of the query's model against plain loops over the windows."""
    import zstandard

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert len(model.ordinary) == len(model.toxic) == toxicity.TRAINED_BYTES
    odd = [(-1, None), (-2, ""), (-3, "x"), (-4, "y" * 64), (-5, "z " * 33), (-6, "long text " * 20_000)]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()][:60] + odd
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(spark.createDataFrame(rows, DOCS), model).collect()}
    how = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=19, chain_log=16, hash_log=16, search_log=3, min_match=4, target_length=16,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    length = []
    for trained in (model.ordinary, model.toxic):
        held = zstandard.ZstdCompressionDict(trained + model.base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        length.append(zstandard.ZstdCompressor(dict_data=held, compression_params=how))
    for doc, t in rows:
        body = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in (t or "").encode())
        saved, at = [], 0
        while at < len(body):
            piece = body[at : at + 64]
            saved.append(len(length[0].compress(piece)) - len(length[1].compress(piece)))
            if at + 64 >= len(body):
                break
            at += 48
        z = model.weights[0] + sum(w * min(6, sum(s >= x for s in saved)) for w, x in zip(model.weights[1:], model.thresholds, strict=True))
        assert got[doc] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_strings_of_one_class_alone_are_trained_on():
    texts = [f"{text(i, 30)} zorkblat {text(i + 100, 30)}".encode() for i in range(10)], [f"{text(i + 200, 60)} plainly".encode() for i in range(10)]
    counts = [toxicity.text_counts(x) for x in texts]
    passages = toxicity.own_passages(texts[0], counts[0], counts[1])
    assert len(passages) >= 10 and all(b"orkbla" in p for p in passages) and max(map(len, passages)) < 20
    assert toxicity.own_passages(texts[0], counts[0], counts[0]) == [] and toxicity.own_passages([b"", b"short"], counts[0], counts[1]) == []
    assert b"zorkbla" in toxicity.train_dictionary(passages) and len(toxicity.train_dictionary([])) == toxicity.TRAINED_BYTES


def test_a_long_document_does_not_end_the_training(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_BYTES", 60_000)
    rows = [(i, f"{text(i, 12)} {'zorkblat quxwhiff vexgrump' if i % 3 == 0 else 'plain'}") for i in range(300)]
    rows += [(1000 + i, text(5000 + i, 20_000)) for i in range(8)]
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i < 1000 and i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert model is not None
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert sum((got[i] >= 0.3) != (i % 3 == 0) for i in range(300)) <= 3


def test_bounds_of_training_texts():
    assert toxicity.text_bounds({0: [10, 10_000, 30], 1: [5]}, 100) == {1: 5, 0: 55}
    assert toxicity.text_bounds({0: [10, 20], 1: []}, 100) == {1: 0, 0: 20}
    assert toxicity.even_parts(b"ab" * 5000, 3000).count(b" ") == 1 and toxicity.even_parts(b"ab", 2) == b"ab" and len(toxicity.even_parts(b"ab" * 50, 7)) == 7


# Language
def test_large_languages_are_sampled():
    drawn = {lang: most + (1 << 63) for lang, most in language_id.sampling([("en", 10**13), ("de", 10**9), ("fr", 2)])}
    assert drawn["en"] / 2**64 * 10**13 == pytest.approx(1000, rel=0.01) and drawn["de"] / 2**64 * 10**9 == pytest.approx(1000, rel=0.01)
    assert drawn["fr"] == 2**64 - 1


def test_more_than_a_hundred_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "linear_svm", lambda x, y: (np.zeros(x.shape[1]), 0.0))
    docs = spark.createDataFrame([(i, text(i, 3), f"x{i % 130}") for i in range(1300)], "doc_id long, text string, lang string")
    assert len(language_id.fit(docs).languages) == 130


def test_without_a_model_documents_pass(spark):
    docs = spark.createDataFrame([(1, "words here", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.tell_language(spark, docs, "").collect()] == [1]
