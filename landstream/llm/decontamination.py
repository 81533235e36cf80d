"""Benchmark decontamination by random-walk embeddings and bit sampling, with exact verification by edit distance.

A walk reads a text from some first byte: at each step it takes the letter it stands at, and a random function of the step and
the letter says whether it moves on to the next. Two strings within a few edits are read by the same walk into sequences that
agree in most steps, since walks that an edit has set apart meet again. So edit distance becomes Hamming distance, for which
hashes of some sampled steps are a locality-sensitive index.

Item-sized windows of the texts are embedded at every offset. The random functions repeat after `steps` steps, so what a walk
reads in a block of so many steps depends only on the place where the block begins; all windows whose walks come to a place share
it, and the blocks of all windows of a text are made in `steps` passes over its bytes, however long the items are. A hash samples
letters of one block of the embedding. Items are embedded from each of their first FIRST bytes. Several walks (repetitions) are
made, for items of at least 64 bytes, and for shorter ones with shorter blocks. Where a block of a text and one of an item agree, the window that begins as far before it is compared: first a section
of at most 64 bytes of the item about the block, by a bit-parallel edit distance for many places at once (SECTION_EDITS of its 64
bytes may differ, or the whole item's limit if that is less), then the whole item, exactly. A text holds an item if some part of
it is within `edits` of the item's length from it.

Items are a stated query set: they are broadcast in blocks of at most BLOCK_BYTES, each against all documents. Nothing else is
shuffled.

Texts are compared as bytes, with A-Z lower-cased and each run of white space as one space. Cases: null or blank texts hold
nothing; null or blank items are held by nothing; an item of fewer bytes than allow an edit is looked for as it stands; repeated
rows are found each for itself; an empty table gives an empty result; other columns pass through decontaminate() untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table
from .textkit import _LOWER, groups, utf8

EDITS = 0.1
BLOCK_BYTES = 16 << 20
#: Bytes of a section (one machine word has a bit for each), and how many of them may differ.
SECTION, SECTION_EDITS = 64, 20
#: By the least bytes of an item: steps of a block, sampled steps, and repetitions. Chosen on evenly spread edits at the limit.
WALKS = {64: (24, 14, 2), 16: (14, 14, 2), 10: (6, 6, 3), 8: (8, 8, 1), 4: (4, 4, 1), 2: (2, 2, 1), 1: (1, 1, 1)}
#: First bytes from which an item is embedded.
FIRST = 8
#: Bytes that a walk takes at once: its arrays stay in a processor's cache.
STRETCH = 1 << 14
#: Places that are expanded or compared at once.
PLACES, LANES = 1 << 16, 2048

_ODD = np.uint32(0x9E3779B1)


def plain(raw: np.ndarray) -> bytes:
    """A-Z lower-cased, each run of white space as one space, none at the ends."""
    return b" ".join(_LOWER[raw].tobytes().split())


@dataclass
class Walk:
    """One repetition: `moves` has a bit for each step and letter, `codes` a number for each letter that is hashed."""

    steps: int
    sampled: list[bool]
    moves: np.ndarray
    codes: np.ndarray

    @classmethod
    def draw(cls, steps: int, samples: int, seed: int) -> Walk:
        rng = np.random.default_rng([steps, seed])
        at = set(rng.choice(steps, samples, replace=False).tolist())
        return cls(steps, [j in at for j in range(steps)], rng.integers(0, 1 << 32, 256, dtype=np.uint32), rng.integers(0, 1 << 32, 256, dtype=np.uint32))

    def hashes(self, body: np.ndarray) -> np.ndarray:
        """Hash of the sampled letters of the block that begins at each byte, but for the last `steps` bytes.

        The last step's is made first, for all places; a step before it takes that of its own place or of the next.
        """
        moves, codes = self.moves[body].view(np.int32), self.codes[body]
        out, mask, other = np.zeros(len(body), np.uint32), np.zeros(len(body), np.int32), np.zeros(len(body), np.uint32)
        for j in range(self.steps - 1, -1, -1):
            np.left_shift(moves, 31 - j, out=mask)
            np.right_shift(mask, 31, out=mask)
            np.bitwise_xor(out[:-1], out[1:], out=other[:-1])
            np.bitwise_and(other, mask.view(np.uint32), out=other)
            np.bitwise_xor(out, other, out=out)
            if self.sampled[j]:
                np.multiply(out, _ODD, out=out)
                np.add(out, codes, out=out)
        return (out * _ODD)[: len(body) - self.steps]

    def goes(self, body: bytes, at: int) -> int:
        """Where the block that begins at a place ends."""
        for j in range(self.steps):
            if at >= len(body):
                return len(body) + 1
            at += int(self.moves[body[at]]) >> j & 1
        return at

    def blocks(self, body: bytes, first: int) -> list[int]:
        """Places at which the blocks of an item's embeddings begin; a block reads nothing beyond the item."""
        places = set()
        for at in range(min(first, len(body))):
            while at not in places:
                end = self.goes(body, at)
                if end > len(body):
                    break
                places.add(at)
                if end == at:  # a walk that doesn't move would read the same block for ever
                    end += 1
                at = end
        return sorted(places)


@dataclass
class Index:
    """The blocks of all items that one walk reads, in the order of their hashes: place in the item, and section."""

    walk: Walk
    values: np.ndarray
    inside: np.ndarray
    section: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.values, kind="stable")
        self.values, self.inside, self.section = self.values[order], self.inside[order], self.section[order]
        self.bits = min(24, max(12, (16 * len(order)).bit_length()))
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self.values >> np.uint32(32 - self.bits)] = True

    def places(self, body: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Place in body (padded by the walk's steps) and number of each block that agrees, some at a time."""
        steps, held, size = self.walk.steps, [], 0
        for low in range(0, len(body) - steps, STRETCH):
            value = self.walk.hashes(body[low : low + STRETCH + steps])
            at = np.flatnonzero(self.filter[value >> np.uint32(32 - self.bits)])
            first, end = (np.searchsorted(self.values, value[at], side) for side in ("left", "right"))
            at, first, end = (x[first < end] for x in (at + low, first, end))
            if not len(at):
                continue
            held.append((at, first, end))
            size += int((end - first).sum())
            if size >= PLACES:
                yield from _expanded(held)
                held, size = [], 0
        if held:
            yield from _expanded(held)


def _expanded(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place and number of each block of the ranges first..end at the places, about PLACES at a time."""
    at, first, end = (np.concatenate(x) for x in zip(*held, strict=True))
    total = np.concatenate([[0], np.cumsum(end - first)])
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(total, total[a] + PLACES, "right")) - 1)
        many = end[a:b] - first[a:b]
        yield np.repeat(at[a:b], many), np.repeat(first[a:b] - (total[a:b] - total[a]), many) + np.arange(total[b] - total[a])
        a = b


class Items:
    """A block of items: the sections that are compared first, and an index of the blocks of their embeddings for each walk."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS):
        self.ids, self.texts, self.limits = [], [], []
        sections, found, begin, n = [], {}, 0, 0
        walks = {least: [Walk.draw(steps, samples, seed) for seed in range(times)] for least, (steps, samples, times) in WALKS.items()}
        for i, text in items:
            body = plain(np.frombuffer((text or "").encode(), np.uint8))
            if not body:
                continue
            size, k = len(body), min(int(edits * len(body)), len(body) - 1)
            last = max(0, size - SECTION)
            inside = np.append(np.arange(0, last, SECTION // 2), last)
            sections.append(np.stack([inside, np.full(len(inside), min(size, SECTION)), np.full(len(inside), min(k, SECTION_EDITS)), np.full(len(inside), len(self.ids)), np.full(len(inside), begin)], 1))
            least = next(x for x in WALKS if x <= size)
            raw = np.frombuffer(body + bytes(WALKS[least][0]), np.uint8)
            for seed, walk in enumerate(walks[least]):
                at = np.array(walk.blocks(body, FIRST if least >= SECTION else size), np.int64)
                middle = np.clip((at - SECTION // 4) // (SECTION // 2), 0, len(inside) - 1)
                found.setdefault((least, seed), []).append((walk.hashes(raw)[at], at, n + middle))
            n, begin = n + len(inside), begin + size
            self.ids.append(i)
            self.texts.append(body)
            self.limits.append(k)
        self.raw = np.frombuffer(b"".join(self.texts) + bytes(8), np.uint8)
        #: Of a section: its place in the item, bytes, edits allowed, item, and where the item begins in `raw`.
        self.sections = np.concatenate(sections) if sections else np.zeros((0, 5), np.int64)
        self.indexes = [Index(walks[least][seed], *(np.concatenate(x) for x in zip(*parts, strict=True))) for (least, seed), parts in sorted(found.items())]

    def near_sections(self, section: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray, body: np.ndarray) -> np.ndarray:
        """Whether the section is within its edits of some part of the text low..high about the place where it would begin."""
        out = np.ones(len(section), bool)
        check = np.argsort(self.sections[section, 1], kind="stable")
        for a in range(0, len(check), LANES):
            part = check[a : a + LANES]
            used, row = np.unique(section[part], return_inverse=True)
            inside, size, edits, _, start = self.sections[used].T
            bit = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            equal = np.zeros((len(used), 256), np.uint64)
            np.bitwise_or.at(equal, (np.repeat(np.arange(len(used)), size), self.raw[np.repeat(start + inside, size) + bit]), np.uint64(1) << bit.astype(np.uint64))
            equal[:, 255] = 0  # no byte of UTF-8: outside the text
            equal, row = equal.ravel(), row * 256
            size, edits = size[row // 256], edits[row // 256]
            at, lo, hi, top = begin[part] - edits, low[part], high[part], (size - 1).astype(np.uint64)
            one = np.uint64(1)
            up, down, score = np.full(len(part), ~np.uint64(0)), np.zeros(len(part), np.uint64), size.copy()
            best = score.copy()
            for j in range(int((size + 2 * edits).max())):
                p = at + j
                letter = np.where((p >= lo) & (p < hi), body[np.minimum(np.maximum(p, 0), len(body) - 1)], 255)
                x = equal[row + letter] | down
                d = (((x & up) + up) ^ up) | x
                less, more = up & d, down | ~(up | d)
                score += ((more >> top) & one).astype(np.int64) - ((less >> top) & one).astype(np.int64)
                more <<= one
                down, up = more & d, (less << one) | ~(more | d)
                np.minimum(best, score, out=best)
            out[part] = best <= edits
        return out


def part_distance(item: bytes, text: bytes) -> tuple[int, int]:
    """Edit distance of the item to the part of the text that is nearest, and where that part ends (the first, of several)."""
    if (at := text.find(item)) >= 0:
        return 0, at + len(item)
    equal: dict[int, int] = {}
    for i, c in enumerate(item):
        equal[c] = equal.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score = full, 0, len(item)
    best = score, 0
    for j, c in enumerate(text, 1):
        x = equal.get(c, 0) | down
        d = (((x & up) + up) ^ up | x) & full
        less, more = up & d, down | full & ~(up | d)
        score += (1 if more & top else 0) - (1 if less & top else 0)
        more = more << 1 & full
        down, up = more & d, (less << 1 | ~(more | d)) & full
        if score < best[0]:
            best = score, j
    return best


def find_in_group(items: Items, offsets: np.ndarray, raw: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, distance, end) for each text of a group and item that it holds, at its nearest part."""
    texts = [plain(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    edge = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    body = np.frombuffer(b"".join(texts) + bytes(SECTION), np.uint8)
    wanted = set()
    for index in items.indexes:
        for at, block in index.places(body):
            doc = np.searchsorted(edge, at, "right") - 1
            inside = doc < len(texts)
            at, block, doc = at[inside], block[inside], doc[inside]
            # Blocks of one section that say the same begin are one place.
            begin = at - index.inside[block]
            _, once = np.unique(index.section[block] * (2 * len(body) + len(items.raw)) + begin + len(items.raw), return_index=True)
            section, begin, doc = index.section[block][once], begin[once], doc[once]
            near = items.near_sections(section, begin + items.sections[section, 0], edge[doc], edge[doc + 1], body)
            item = items.sections[section[near], 3]
            step = np.maximum(16, np.array([items.limits[i] for i in item.tolist()], np.int64))
            wanted.update(zip(doc[near].tolist(), item.tolist(), ((begin[near] - edge[doc[near]]) // step).tolist(), step.tolist(), strict=True))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for t, i, b, step in sorted(wanted):
        k, n = items.limits[i], len(items.texts[i])
        if best.get((t, i), (1,))[0] == 0:
            continue
        low = max(0, b * step - k)
        distance, end = part_distance(items.texts[i], texts[t][low : max(0, (b + 1) * step + n + k)])
        if distance <= k:
            best[t, i] = min(best.get((t, i), (distance, low + end)), (distance, low + end))
    return [(t, items.ids[i], d, e) for (t, i), (d, e) in best.items()]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> doc_id, item_id, distance, end: a row for each text and item that it holds."""
    spark = docs.sparkSession
    bound_batches(spark)
    out = None
    for block in _blocks(benchmark):
        held = spark.sparkContext.broadcast(Items(block, edits))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, (offsets, raw) = batch.column(0).to_pylist(), utf8(batch.column(1))
                for a, b in groups(offsets):
                    rows = find_in_group(held.value, offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[a + r[0]] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3))],
                        names=["doc_id", "item_id", "distance", "end"],
                    )

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, distance long, end long")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, distance long, end long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """docs without those that hold an item. Rows pass whole through the tasks that judge them; nothing is joined."""
    bound_batches(docs.sparkSession)
    out, at = docs, docs.columns.index("text")
    for block in _blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(Items(block, edits))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                offsets, raw = utf8(batch.column(at))
                for a, b in groups(offsets):
                    for r in find_in_group(held.value, offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]]):
                        clean[a + r[0]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
