"""Queries that SQL can't express, by plain loops over the query's own model or vocabulary."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from landstream.llm import language_id, token_counts


def trigrams(text):
    """Counts of the lower-cased byte trigrams of a text; bytes that are no letters are spaces, and a trigram that ends in two of them does not count."""
    folded = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in text.encode()]
    out = Counter()
    for k in range(2, len(folded)):
        a, b, c = folded[k - 2 : k + 1]
        if not (b == 32 and c == 32):
            out[(((c << 16) | (b << 8) | a) * 0x9E3779B1 % (1 << 32)) >> 20] += 1
    return out


def told(model, text):
    """(language, score) of a text by the machines' weights: the family with the largest margin, then votes within it."""
    counts = trigrams(text)
    total = max(1, sum(counts.values()))
    margin = [(sum(n * float(model.weights[f, k]) for f, n in counts.items()) / total + model.bias[k]) * model.steep[k] for k in range(len(model.bias))]
    sure = [1 / (1 + math.exp(-min(max(m, -30), 30))) for m in margin]
    family = max(range(len(model.families)), key=lambda f: (margin[f], -f))
    mine = [i for i, x in enumerate(model.languages) if language_id.FAMILIES.get(x, x) == model.families[family]]
    votes, lean = dict.fromkeys(mine, 0.0), dict.fromkeys(mine, 1.0)
    for k, (i, j) in enumerate(model.pairs, len(model.families)):
        if i in votes:
            votes[i] += sure[k]
            votes[j] += 1 - sure[k]
            lean[i], lean[j] = min(lean[i], sure[k]), min(lean[j], 1 - sure[k])
    best = max(mine, key=lambda i: (votes[i], -i))
    return model.languages[best], sure[family] * lean[best]


def test_language_query_by_plain_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = language_id.op4_language_id(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        lang, score = told(model, text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6)


def test_machines_part_their_sample(spark, sf_dir):
    """The machines are linear separators of what they learned from: support vectors are few, and errors on the sample rare."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(200, 6)) + 1.5, rng.normal(size=(60, 6)) - 1.5])
    x = np.column_stack([x, np.full(260, language_id.ONE)])
    y = np.repeat([1.0, -1.0], [200, 60])
    w, bias = language_id.linear_svm(x, y)
    assert bias == pytest.approx(w[-1] * language_id.ONE) and np.mean(np.sign(x @ w) == y) > 0.98

    def loss(v):
        cost = np.where(y > 0, 260 / 400, 260 / 120)
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()

    # No small step improves the loss that is minimised.
    assert all(loss(w) <= loss(w + 0.02 * d) + 1e-3 for d in rng.normal(size=(200, 7)))


def test_token_counts_of_the_query_s_vocabulary(spark, sf_dir):
    """Some hundred words of the table, segmented with the query's own pieces by plain dynamic programming."""
    pieces = token_counts.read_vocabulary(token_counts.VOCABULARY)
    words = sorted({w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect() for w in (r.text or "").split()})[::7][:400]

    def plain(word):
        raw = token_counts.MARK + word.encode()
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(raw)
        for end in range(1, len(raw) + 1):
            options = [(best[end - 1][0] + token_counts.UNKNOWN, -(best[end - 1][1] + 1))]
            for start in range(max(0, end - 64), end):
                score = pieces.get(raw[start:end])
                if score is not None:
                    options.append((best[start][0] + score, -(best[start][1] + 1)))
            top = max(options)
            best[end] = top[0], -top[1]
        return best[-1][1]

    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, pieces).collect()}
    assert len(words) >= 200 and got == {i: plain(w) for i, w in enumerate(words)}
