"""The filter audit against plain sets, and its merge against Python's set operations."""

import random
import re
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from landstream.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, id long, good int"
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """(doc_id, text, source) and (doc_id, quality, toxic) rows -> sorted result rows."""
    texts = {}
    for i, t, _ in docs:
        if i is not None:
            texts[t or ""] = min(texts.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for n, (i, t, s) in enumerate(docs):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and texts.get(t, i) < i,
        }
        parts.setdefault(s or "", []).append((n, {f for f, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                now = [r for r in rows if f in r[1] and r[0] not in gone]
                again = sum(f in r[1] and r[0] in gone for r in rows)
                gone |= {r[0] for r in now}
                total[f] += len(now)
                found.append((f, (part, "".join(order), step, len(rows) - len(gone), len(now), again, sum(r[1] == {f} for r in rows), sum(r[2] for r in now), sum(r[3] for r in now))))
        out += [(*row, total[f]) for f, row in found]
    return sorted(out)


def got(spark, docs, labels):
    df = spark.createDataFrame([(i, t, "en", s, 1, "x", 7, 1) for i, t, s in docs], DOCS)
    return sorted(tuple(r) for r in A.filter_audit(df, spark.createDataFrame(labels, LABELS)).drop("filter").collect())


def test_odd_rows(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(90)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((3, 49, 50, 51, 120)))) + rng.choice(("", " #", " A B C D E F", " x")), rng.choice(("a", "b", "", None))) for i in range(200)]
    docs += [(200 + i, docs[i % 7][1], docs[i][2]) for i in range(60)] + [(5, docs[5][1], "a"), (5, docs[5][1], "a"), (5, "other", "a")]
    docs += [(None, docs[3][1], "b"), (None, None, None), (300, None, "a"), (301, "", "a"), (302, " \t\n", "b"), (303, "one", "lonely")]
    docs += [(304, "x " * 200_000, "long"), (-1, docs[9][1], "c")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 260, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    assert got(spark, docs, labels) == plain(docs, labels)


def test_blocks_don_t_matter(spark, monkeypatch):
    docs = [(i, ("a b " * 30 if i % 3 else "short") + ("#" if i % 5 == 0 else ""), "hot" if i % 4 else "b") for i in range(300)]
    monkeypatch.setattr(A, "BLOCK", 7)
    lists = ["A", "B", "C", "D", "E", "good", "toxic"]
    df = spark.createDataFrame([(i, t, "en", s, 1, "x", 7, 1) for i, t, s in docs], DOCS)
    postings = A.posting_lists(A.flags(df, spark.createDataFrame([(3, 1, 1)], LABELS)), lists)
    assert postings.agg({"n": "sum"}).first()[0] == 300
    assert got(spark, docs, [(3, 1, 1)]) == plain(docs, [(3, 1, 1)])


def test_empty_tables(spark):
    assert got(spark, [], []) == []
    assert got(spark, [(1, "x", "s")], []) == plain([(1, "x", "s")], [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60)), min_size=1, max_size=7))
def test_merge_against_sets(sets):
    found = A.regions([sorted(s) for s in sets])
    want = {}
    for x in set().union(*sets):
        mask = sum(1 << i for i, s in enumerate(sets) if x in s)
        want[mask] = want.get(mask, 0) + 1
    assert found == want


@given(st.lists(st.integers(0, 500), unique=True), st.integers(0, 500), st.integers(0, 30))
def test_gallop(ids, limit, at):
    ids.sort()
    at = min(at, max(len(ids) - 1, 0))
    if ids and ids[at] < limit:
        assert A.gallop(ids, at, limit) == next((i for i in range(at, len(ids)) if ids[i] >= limit), len(ids))
