"""How filters interact: sorted posting lists of the rows that fail each filter, merged by galloping.

Rows are dealt in ranges of (part, id) and sorted; each block of a range keeps, for each part in it, the sorted list of the rows
that fail each filter, and those of each label. Unions and differences come from one k-way merge of a block's lists: the list
with the least head gallops (steps that double, then a binary search) to the next list's head, and all that it passes is in
no other list; equal heads go on together. That gives the size of every region of the lists' diagram, without a row being
looked at that no list holds. Sizes are summed over the blocks of a part, and what each order of the filters removes follows
from sizes of unions: after the filters S, n - |union S| rows are kept.

A part of any size spreads over many ranges; a block is at most BLOCK rows; a part leaves a row for each region (2 to the
number of lists, at most) to each task's sums.

Cases: a null text is empty; an empty one has no words, so it is under any least number of words and no share of it is too
small or too large. A null part and an empty one are one part, the empty string. Repeated rows count each for itself; rows that
share an id are different rows. A null id, and an id without labels, has no label; an id with several label rows has a label
that one of them gives. A null id isn't larger than any, so such a row is no copy; null ids aren't smaller than any either. Empty
tables give no rows. Columns other than those named don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Rows of a block of posting lists.
BLOCK = 16_384
WORD = r"([^\x20\x09-\x0D]+)"


def too_short(text: Column, least: int = 50) -> Column:
    return F.regexp_count(text, F.lit(WORD)) < least


def too_repetitive(text: Column, percent: int = 65) -> Column:
    words = F.regexp_extract_all(text, F.lit(WORD))
    return F.size(F.array_distinct(words)) * 100 < F.size(words) * percent


def too_many_capitals(text: Column, percent: int = 5) -> Column:
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return capitals.cast("long") * 100 > F.length(text).cast("long") * percent


def has_symbols(text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


def flags(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(key, part, fails A to E, good, toxic), a row a document; texts are read once and don't leave their task."""
    body = F.coalesce(F.col(text), F.lit(""))
    told = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("__digest"),
        too_short(body).alias("A"), too_repetitive(body).alias("B"), too_many_capitals(body).alias("C"), has_symbols(body).alias("D"),
    )
    told = written(told, "flags")
    # Written, so that both sides of the join have an exchange of their own and Spark can split a text with very many copies.
    first = written(told.groupBy("__digest").agg(F.min("id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").select("__digest", "__first"), "copied")
    marked = told.join(first, "__digest", "left").withColumn("E", F.coalesce(F.col("id") > F.col("__first"), F.lit(False)))
    label = labels.groupBy(F.col(key).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = marked.join(label, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return marked.select("id", "part", "A", "B", "C", "D", "E", "good", "toxic")


def posting_lists(marked: DataFrame, lists: list[str], key: str = "id", part: str = "part") -> DataFrame:
    """A row a part and block of an id range: its rows' number, first and last key, and for each list the sorted row numbers.

    Row numbers count a block's rows in the order of the key, so rows that share a key, or have none, are told apart.
    """
    kind = marked.schema[key].dataType.simpleString()
    ranged = marked.repartitionByRange(part, key, F.xxhash64(*lists)).sortWithinPartitions(part, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                block = batch.slice(first, BLOCK)
                parts = np.array(block.column(part).to_pylist(), object)
                starts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
                out = []
                for a, b in zip(starts, np.append(starts[1:], len(parts)), strict=True):
                    keys = block.column(key).slice(a, b - a)
                    held = {c: np.flatnonzero(block.column(c).slice(a, b - a).to_numpy(zero_copy_only=False)).tolist() for c in lists}
                    out.append({part: parts[a], "n": b - a, "first": keys[0].as_py(), "last": keys[-1].as_py(), **held})
                yield pa.RecordBatch.from_pylist(out, pa.schema([(part, pa.string()), ("n", pa.int64()), ("first", block.schema.field(key).type), ("last", block.schema.field(key).type), *((c, pa.list_(pa.int32())) for c in lists)]))

    return ranged.select(key, part, *lists).mapInArrow(run, f"{part} string, n long, first {kind}, last {kind}, " + ", ".join(f"{c} array<int>" for c in lists))


def gallop(ids: list[int], at: int, limit: int) -> int:
    """The first place from `at` on whose id isn't below `limit`: steps that double, then halves."""
    step, low = 1, at
    while at + step < len(ids) and ids[at + step] < limit:
        low = at + step
        step *= 2
    high = min(at + step, len(ids))
    while low < high:
        middle = (low + high) // 2
        if ids[middle] < limit:
            low = middle + 1
        else:
            high = middle
    return low


def regions(lists: list[list[int]]) -> dict[int, int]:
    """How many ids are in exactly the lists of each mask, by one k-way merge of sorted lists."""
    places = [0] * len(lists)
    live = [i for i, ids in enumerate(lists) if ids]
    out: dict[int, int] = {}
    while live:
        heads = sorted((lists[i][places[i]], i) for i in live)
        least = heads[0][0]
        if len(heads) == 1 or heads[1][0] > least:
            i = heads[0][1]
            to = gallop(lists[i], places[i], heads[1][0]) if len(heads) > 1 else len(lists[i])
            out[1 << i] = out.get(1 << i, 0) + to - places[i]
            places[i] = to
        else:
            mask = 0
            for head, i in heads:
                if head != least:
                    break
                mask |= 1 << i
                places[i] += 1
            out[mask] = out.get(mask, 0) + 1
        live = [i for i in live if places[i] < len(lists[i])]
    return out


def region_sizes(postings: DataFrame, lists: list[str], part: str = "part") -> DataFrame:
    """(part, mask, n): rows of a part that are in exactly the lists of the mask; mask 0 has those in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, totals = batch.column(part).to_pylist(), batch.column("n").to_pylist()
            columns = [batch.column(c).to_pylist() for c in lists]
            rows: dict[tuple[str, int], int] = {}
            for name, total, *held in zip(names, totals, *columns, strict=True):
                found = regions(held)
                found[0] = total - sum(found.values())
                for mask, n in found.items():
                    rows[name, mask] = rows.get((name, mask), 0) + n
            yield pa.RecordBatch.from_pylist([{part: p, "mask": m, "n": n} for (p, m), n in rows.items()], pa.schema([(part, pa.string()), ("mask", pa.int32()), ("n", pa.int64())]))

    return postings.select(part, "n", *lists).mapInArrow(run, f"{part} string, mask int, n long").groupBy(part, "mask").agg(F.sum("n").alias("n"))


def union_sizes(found: dict[int, int], filters: int, within: int = 0) -> list[int]:
    """For each set of filters the number of rows that fail one of them; of rows in the list `within` (a bit) alone, if given."""
    out = [0] * (1 << filters)
    for mask, n in found.items():
        if not within or mask & within:
            for s in range(1 << filters):
                if mask & s:
                    out[s] += n
    return out


def audit(sizes: DataFrame, filters: str, labels: tuple[str, ...], part: str = "part") -> DataFrame:
    """A row for each part, order of the filters and step. sizes: of region_sizes() over the filters' lists and the labels'."""
    k, full = len(filters), (1 << len(filters)) - 1
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(filters[i] for i in order), step, f, before))
            before |= 1 << f
    names = [part, "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", *(f"{c}_lost" for c in labels), "shapley"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), *[pa.int64()] * (len(names) - 4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, regions_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {r["mask"]: r["n"] for r in regions_}
                u, total = union_sizes(found, k), sum(found.values())
                lost = [union_sizes(found, k, 1 << k + i) for i in range(len(labels))]
                every = [0] * k
                for _, _, f, before in steps:
                    every[f] += u[before | 1 << f] - u[before]
                rows = []
                for order, step, f, before in steps:
                    after, gone = before | 1 << f, u[before | 1 << f] - u[before]
                    rows.append((name, order, step, filters[f], total - u[after], gone, u[1 << f] - gone, u[full] - u[full ^ 1 << f], *(v[after] - v[before] for v in lost), every[f]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    whole = sizes.groupBy(part).agg(F.collect_list(F.struct("mask", "n")).alias("regions"))  # a row a region, 2 to the number of lists at most
    schema = f"{part} string, filter_order string, step int, filter string, " + ", ".join(f"{c} long" for c in names[4:])
    return whole.mapInArrow(run, schema)


FILTERS, LABELS = "ABCDE", ("good", "toxic")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    lists = [*FILTERS, *LABELS]
    postings = written(posting_lists(flags(docs, labels), lists), "postings")
    return audit(region_sizes(postings, lists), FILTERS, LABELS)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


SQL = r"""
WITH told AS (
  SELECT doc_id, coalesce(source, '') AS part, text AS body, len(words) < 50 AS A, 100 * len(list_distinct(words)) < 65 * len(words) AS B,
         100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D
  FROM (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)
), label AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), marked AS MATERIALIZED (
  SELECT t.part, t.A, t.B, t.C, t.D, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t.body), FALSE) AS E,
         coalesce(l.good, FALSE) AS good, coalesce(l.toxic, FALSE) AS toxic
  FROM told t LEFT JOIN label l ON l.doc_id = t.doc_id
), masks AS (
  SELECT part, A::INT + B::INT * 2 + C::INT * 4 + D::INT * 8 + E::INT * 16 AS mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM marked GROUP BY ALL
), letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
  SELECT filter_order, s AS step, bits[s] AS bit, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INT) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), counted AS (
  SELECT p.part, filter_order, step, bit, CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN g ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN t ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM masks p, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counted
"""
