"""Removal of long repeated strings by a distributed merge sort of suffixes that knows common prefixes.

A string of LENGTH bytes that starts in two places holds the same minimizer in both: the leftmost smallest hash of its SEED-byte
strings. So only suffixes that begin at minimizers are sorted, about one in 77, and of these only those whose seed occurs twice.

1. Each text's minimizers are counted by seed hash, packed, in buckets of the hash; those of one seed in two places are marked.
   A seed that a task meets twice is marked there and sent on once, so a very common one doesn't fill its bucket.
2. Texts meet their marks. Each task sorts the suffixes at its marks into runs, in the order (seed hash, bytes after the seed),
   and front-codes them: each entry says how many bytes it shares with the one before, and gives the rest. Equal entries of a
   run are sent once. Runs are exchanged by ranges of the seed hash.
3. Each range (or pair of blocks of a large one) is merged by a loser tree whose nodes keep the common prefix with the last winner: entries are told apart by
   those lengths alone unless they are equal, and then compared only beyond them. The merge yields neighbours' common prefixes.
4. For each number l of bytes before the seed, the string from there is repeated if two suffixes share the rest of LENGTH bytes
   after it (one stretch of the order with common prefixes at least as long) and the l bytes before it. The lengths l for which
   that holds give the covered bytes around each seed.
5. Intervals return to their texts, are united, and cut out.

Only the texts' exchange holds whole texts, and the two joins with it are made by one key, so that Spark can use it twice. Of
equal texts one takes part; its copies stay where they are, since every byte of a text of LENGTH bytes or more with a copy goes.

Cases: a null text is empty: 0 bytes, nothing removed; texts shorter than LENGTH never change; repeated rows are copies of each
other; a null doc_id is a row like others; an empty table gives an empty result. Exact up to collisions of 64-bit hashes of seeds and of the bytes
before them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, partitions, table, written
from .textkit import groups, mix, prefix_hash, range_hash, utf8

LENGTH, SEED = 200, 48
#: Bytes of text whose minimizers make a bucket of the first step, and bytes of text for a range of the merge.
BUCKET_BYTES, RANGE_BYTES = 64 << 20, 24 << 20
#: Bytes of text that a run is made from.
RUN_BYTES = 16 << 20
#: Entries that a task merges, of each of its two blocks.
BLOCK = 150_000


def minimizers(offsets: np.ndarray, raw: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Positions and seed hashes of the minimizers of every string of `length` bytes inside one text."""
    n = len(raw) - seed + 1
    wide = length - seed + 1
    none = np.zeros(0, np.int64)
    if n < wide:
        return none, none.view(np.uint64)
    start = np.arange(n)
    hashes = range_hash(prefix_hash(raw), start, start + seed)
    mask = np.uint64((1 << int(n).bit_length()) - 1)
    value = (hashes & ~mask) | start.astype(np.uint64)  # the position in the low bits: the leftmost of equals wins
    full = np.full(-(-n // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = value
    blocks = full.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    first = np.arange(n - wide + 1)
    at = (np.minimum(behind[first], ahead[first + wide - 1]) & mask).astype(np.int64)
    # Windows that lie inside one text.
    inside = np.zeros(len(first) + 1, np.int8)
    long_ = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][long_], 1)
    np.add.at(inside, offsets[1:][long_] - length + 1, -1)
    at = at[np.cumsum(inside[:-1]) > 0]
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]
    at = at[keep]
    return at, mix(hashes[at] ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def _share(value: np.ndarray, n: int) -> np.ndarray:
    return (((value >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(schema))], schema=schema)


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()] or [np.zeros(0, kind)])


def _by_owner(owner: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Each owner with its packed places."""
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    who, at = np.unique(owner, return_index=True)
    for w, i, j in zip(who, at, [*at[1:], len(owner)][: len(who)], strict=True):
        yield int(w), place[i:j].astype("i4").tobytes()


def marks(docs: DataFrame, length: int, seed: int, buckets: int) -> DataFrame:
    """(key, text) -> (key, positions): the minimizers whose seed is in two places, packed."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, (offsets, raw) = batch.column(0).to_pylist(), utf8(batch.column(1))
            for a, b in groups(offsets):
                base = offsets[a]
                at, value = minimizers(offsets[a : b + 1] - base, raw[base : offsets[b]], length, seed)
                owner = np.searchsorted(offsets[a : b + 1] - base, at, "right") - 1
                place = at - (offsets[a:b] - base)[owner]
                seen: dict[bytes, int] = {}
                first = np.array([seen.setdefault(keys[i], i - a) for i in range(a, b)])
                once = first[owner] == owner  # copies of a text are one
                owner, place, value = owner[once], place[once], value[once]
                order = np.lexsort((place, owner, value))
                owner, place, value = owner[order], place[order], value[order]
                new = np.ones(len(value), bool)
                new[1:] = value[1:] != value[:-1]
                # Seeds that are in two places here are marked here, and one of the places stands for them in the count.
                here = np.zeros(len(value), bool)
                here[:-1] |= ~new[1:]
                here[1:] |= ~new[1:]
                out = [(-1 - at_ % buckets, keys[a + who], None, part, None) for at_, (who, part) in enumerate(_by_owner(owner[here], place[here]))]
                owner, place, value = owner[new], place[new], value[new]
                bucket = _share(value, buckets)
                order = np.lexsort((place, owner, bucket))
                owner, place, value, bucket = owner[order], place[order], value[order], bucket[order]
                bounds = np.searchsorted(bucket, np.arange(buckets + 1))
                for f in np.flatnonzero(np.diff(bounds)):
                    s = slice(bounds[f], bounds[f + 1])
                    who, many = np.unique(owner[s], return_counts=True)
                    out.append((int(f), b"".join(keys[a + i] for i in who), many.astype("i4").tobytes(), place[s].astype("i4").tobytes(), value[s].tobytes()))
                yield _batch(out, schema)

    def repeated(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() < 0:
            return pa.table({"key": group.column("keys"), "positions": group.column("places")})
        keys, many = _joined(group.column("keys"), "V16"), _joined(group.column("many"), "i4")
        place, value = _joined(group.column("places"), "i4"), _joined(group.column("values"), "u8")
        names, owner = np.unique(keys, return_inverse=True)
        owner = np.repeat(owner, many)
        order = np.lexsort((place, owner, value))
        owner, place, value = owner[order], place[order], value[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
        owner, place, value = owner[new], place[new], value[new]  # copies of a text are one
        same = value[1:] == value[:-1]
        twice = np.zeros(len(value), bool)
        twice[1:] |= same
        twice[:-1] |= same
        parts = list(_by_owner(owner[twice], place[twice]))
        return pa.table({"key": pa.array([names[w].tobytes() for w, _ in parts], pa.binary()), "positions": pa.array([x for _, x in parts], pa.binary())})

    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("keys", "many", "places", "values"))])
    packed = docs.mapInArrow(collect, "bucket int, keys binary, many binary, places binary, values binary")
    found = packed.groupBy("bucket").applyInArrow(repeated, "key binary, positions binary")
    return found.groupBy("key").agg(F.collect_list("positions").alias("positions"))


RUN = "span int, entries int, shared binary, lengths binary, tails binary, before binary, lefts binary, many binary, keys binary, places binary"


def runs(marked: DataFrame, key_at: int, text_at: int, length: int, seed: int, spans: int) -> DataFrame:
    """Rows with a key, a text and last positions -> front-coded sorted runs of suffixes, by range of the seed hash.

    Other columns are there only so that Spark sees one exchange of the texts for both joins.
    """
    side = length - seed

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in _gathered(batches, text_at):
            keys, lists = batch.column(key_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            offsets, raw = utf8(batch.column(text_at))
            for a, b in groups(offsets, 2 * RUN_BYTES):
                use = [i for i in range(a, b) if keys[i] != (keys[i - 1] if i else last)]  # copies stand together
                places = [np.unique(np.concatenate([np.frombuffer(x, "i4") for x in lists[i]])).astype(np.int64) for i in use]
                if places:
                    owner = np.repeat(use, [len(p) for p in places])
                    yield _batch(one_run(keys, offsets, raw, owner, np.concatenate(places)), schema)
            last = keys[-1] if keys else last

    def one_run(keys: list[bytes], offsets: np.ndarray, raw: np.ndarray, owner: np.ndarray, place: np.ndarray) -> list[tuple]:
        at, end, begin = offsets[owner] + place, offsets[owner + 1], offsets[owner]
        value = np.concatenate([_seed_hash(raw, part, seed) for part in np.array_split(at, max(1, len(at) // 10_000))])
        right, left = np.minimum(end - at - seed, side), np.minimum(place, side)
        steps = np.arange(side)
        # seed hash, bytes after the seed and their number; then the bytes before it, read backwards, and their number
        text = np.zeros((len(at), 8 + side + 1 + side + 1), np.uint8)
        text[:, :8] = value.astype(">u8").view(np.uint8).reshape(-1, 8)
        for s in range(0, len(at), 10_000):
            part = slice(s, s + 10_000)
            p, r, q = at[part, None], right[part, None], left[part, None]
            text[part, 8 : 8 + side] = np.where(steps < r, raw[np.minimum(p + seed + steps, len(raw) - 1)], 0)
            text[part, 9 + side : 9 + 2 * side] = np.where(steps < q, raw[np.maximum(p - 1 - steps, 0)], 0)
        text[:, 8 + side], text[:, 9 + 2 * side] = right, left
        order = np.argsort(text.view(f"S{text.shape[1]}").ravel(), kind="stable")
        text, owner, place, span = text[order], owner[order], place[order], _share(value[order], spans)
        differs = text[1:] != text[:-1]
        new = np.ones(len(text), bool)
        new[1:] = differs.any(1)
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(text)))
        text, span_of = text[first], span[first]
        lengths = 8 + text[:, 8 + side].astype(np.int64)
        shared = np.zeros(len(text), np.int64)
        if len(text) > 1:
            apart = text[1:, : 8 + side] != text[:-1, : 8 + side]
            shared[1:] = np.where(apart.any(1), apart.argmax(1), 8 + side)
            shared[1:] = np.minimum(shared[1:], np.minimum(lengths[1:], lengths[:-1]))
        bounds, refs, out = np.searchsorted(span_of, np.arange(spans + 1)), np.append(first, len(owner)), []
        for f in np.flatnonzero(np.diff(bounds)):
            i, j = bounds[f], bounds[f + 1]
            part, sh, n = text[i:j], shared[i:j].copy(), lengths[i:j]
            sh[0] = 0
            columns = np.arange(8 + side)
            tails = part[:, : 8 + side][(columns >= sh[:, None]) & (columns < n[:, None])]
            before = part[:, 9 + 2 * side]
            lefts = part[:, 9 + side : 9 + 2 * side][steps < before[:, None]]
            who = owner[refs[i] : refs[j]]
            out.append((
                int(f), int(j - i), sh.astype("u1").tobytes(), n.astype("u1").tobytes(), tails.tobytes(), before.tobytes(), lefts.tobytes(), many[i:j].astype("i4").tobytes(),
                b"".join(keys[w] for w in who), place[refs[i] : refs[j]].astype("i4").tobytes(),
            ))
        return out

    schema = pa.schema([("span", pa.int32()), ("entries", pa.int32()), *((n, pa.binary()) for n in ("shared", "lengths", "tails", "before", "lefts", "many", "keys", "places"))])
    return marked.mapInArrow(make, RUN)


def _gathered(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.Table]:
    """Batches put together until they hold RUN_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text_at).nbytes
        if size >= RUN_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _seed_hash(raw: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the seeds at some positions."""
    value = np.zeros(len(at), np.uint64)
    for k in range(0, seed, 8):
        word = np.zeros((len(at), 8), np.uint8)
        n = min(8, seed - k)
        word[:, :n] = raw[at[:, None] + k + np.arange(n)]
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64).ravel() + np.uint64(1))
    return value


def _decoded(shared: bytes, lengths: bytes, tails: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for s, n in zip(shared, lengths, strict=True):
        last = last[:s] + tails[at : at + n - s]
        at += n - s
        out.append(last)
    return out


def _meet(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def merge_runs(entries: list[list[bytes]], shared: list[bytes]) -> tuple[list[int], list[int]]:
    """Merge sorted runs: for each entry in order, its run, and the prefix it shares with the entry before it.

    A loser tree. lcp[r] is what run r's head shares with the last winner. Of two heads, the one that shares more with the last
    winner comes first; only equals are compared, beyond what they share. shared[r][i] is what entry i shares with entry i - 1.
    """
    k = 1
    while k < len(entries):
        k *= 2
    heads = [0] * k
    sizes = [len(e) for e in entries] + [0] * (k - len(entries))
    entries = [*entries, *([] for _ in range(k - len(entries)))]
    lcp = [0] * k
    tree = [0] * k
    order, common = [], []

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's lcp becomes what it shares with the winner if they had to be compared."""
        if heads[a] >= sizes[a]:
            return b, a
        if heads[b] >= sizes[b]:
            return a, b
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y = entries[a][heads[a]], entries[b][heads[b]]
        m = _meet(x, y, lcp[a])
        if m == len(x) or (m < len(y) and x[m] < y[m]):
            lcp[b] = m
            return a, b
        lcp[a] = m
        return b, a

    winners = list(range(k))
    level = k
    nodes = winners
    while level > 1:
        nxt = []
        for i in range(0, level, 2):
            w, tree[(level + i) // 2] = play(nodes[i], nodes[i + 1])
            nxt.append(w)
        nodes, level = nxt, level // 2
    top = nodes[0]
    for _ in range(sum(sizes)):
        order.append(top)
        common.append(lcp[top])
        heads[top] += 1
        if heads[top] < sizes[top]:
            lcp[top] = shared[top][heads[top]]
        node = (top + k) // 2
        while node:
            top, tree[node] = play(top, tree[node])
            node //= 2
    return order, common


def covered(spans: DataFrame, length: int, seed: int) -> DataFrame:
    """Runs -> (key, starts, ends): packed intervals of covered bytes.

    A span of more than BLOCK entries, as one seed with very many contexts makes it, is dealt out in blocks of runs, and each pair
    of blocks is merged by a task of its own: any two entries meet in one of them.
    """
    side = length - seed

    def combine(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        entries = [_decoded(r["shared"], r["lengths"], r["tails"]) for r in rows]
        order, common = merge_runs(entries, [r["shared"] for r in rows])
        order = np.array(order, np.int64)
        sizes = np.array([len(e) for e in entries])
        start = np.cumsum(sizes) - sizes
        # The i-th time that a run comes in the order, it gives its i-th entry.
        entry = np.empty(len(order), np.int64)
        entry[np.argsort(order, kind="stable")] = np.arange(len(order))
        common = np.array(common, np.int64) - 8  # bytes after the seed
        right = (np.concatenate([np.frombuffer(r["lengths"], "u1") for r in rows]).astype(np.int64) - 8)[entry]
        before = np.concatenate([np.frombuffer(r["before"], "u1") for r in rows]).astype(np.int64)
        lefts = np.frombuffer(b"".join(r["lefts"] for r in rows), np.uint8)
        many = np.concatenate([np.frombuffer(r["many"], "i4") for r in rows]).astype(np.int64)
        at = (np.cumsum(before) - before)[entry]
        left = before[entry]
        twice = many[entry] > 1
        n = len(entry)
        most, least = np.full(n, -1, np.int64), np.full(n, side + 1, np.int64)
        hashed = np.zeros(n, np.uint64)
        del start
        for k in range(side + 1):
            if k:
                some = left >= k
                hashed[some] = hashed[some] * np.uint64(0x9E3779B97F4A7C15) + lefts[at[some] + k - 1].astype(np.uint64) + np.uint64(1)
            fits = (left >= k) & (right >= side - k)
            # A stretch of the order in which all share the bytes that are still needed.
            stretch = np.cumsum(common < side - k)
            i = np.flatnonzero(fits)
            code = mix(hashed[i] ^ mix(stretch[i].astype(np.uint64) + np.uint64(7)))
            by = np.argsort(code)
            same = code[by][1:] == code[by][:-1]
            again = np.zeros(len(i), bool)
            again[1:] |= same
            again[:-1] |= same
            hit = np.zeros(n, bool)
            hit[i[by[again]]] = True
            hit |= fits & twice
            most[hit] = k
            least[hit & (least > k)] = k
        # Back to the places, in the order of the runs.
        back = np.empty(n, np.int64)
        back[entry] = np.arange(n)
        most, least = np.repeat(most[back], many), np.repeat(least[back], many)
        keys = np.frombuffer(b"".join(r["keys"] for r in rows), "V16")
        place = np.concatenate([np.frombuffer(r["places"], "i4") for r in rows]).astype(np.int64)
        hit = most >= 0
        keys, begin, end = keys[hit], (place - most)[hit], (place + seed + side - least)[hit]
        names, who = np.unique(keys, return_inverse=True)
        by = np.lexsort((begin, who))
        who, begin, end = who[by], begin[by], end[by]
        cuts = np.searchsorted(who, np.arange(len(names) + 1))
        parts = [(names[w].tobytes(), begin[i:j].astype("i4").tobytes(), end[i:j].astype("i4").tobytes()) for w, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))]
        return pa.Table.from_batches([_batch(parts, schema)])

    schema = pa.schema([("key", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])
    sizes = spans.groupBy(F.col("span").alias("__span")).agg(F.ceil(F.sum("entries") / F.lit(BLOCK)).cast("int").alias("__blocks"))
    dealt = spans.join(sizes, F.col("span") == F.col("__span")).withColumn("__mine", F.pmod(F.xxhash64("keys", "places"), F.col("__blocks")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    # One name for span and blocks: dealing rows out by the span alone doesn't do for it.
    pair = F.concat_ws("/", "span", F.least("__mine", "__other"), F.greatest("__mine", "__other"))
    found = dealt.select(*spans.columns, pair.alias("__pair")).groupBy("__pair").applyInArrow(combine, "key binary, starts binary, ends binary")
    return found.groupBy("key").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs; those that touch are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, bytes_only: bool = False) -> DataFrame:
    """docs (with text) with what is left as text, and __n_bytes, __n_removed, __n_spans and __sha256 (of the bytes left).

    Bytes of characters that were cut apart are left out of the new text; a text that loses nothing stays as it is. bytes_only
    gives a null text. Any doc_id is untouched; equal texts are treated alike.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, spans = (max(partitions(spark), total // n) for n in (BUCKET_BYTES, RANGE_BYTES))
    names = docs.columns
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    several = keyed.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("__key").alias("__same"))
    several, same = written(several, "copies"), F.col("__key") == F.col("__same")
    copies = keyed.join(several, same, "left_semi")
    # One row a text goes on: those that have no copy, and one for each group of copies.
    first = copies.groupBy("__key").agg(F.first("text").alias("__text"))
    blank = [(F.col("__text") if f.name == "text" else F.lit(None).cast(f.dataType)).alias(f.name) for f in docs.schema]
    one = keyed.join(several, same, "left_anti").withColumn("__single", F.lit(True)).unionByName(first.select(*blank, "__key", F.lit(False).alias("__single")))
    found = marks(one.select(F.col("__key").alias("key"), "text"), length, seed, buckets)
    exchanged = one.repartition(max(partitions(spark), total // (64 << 20)), "__key")
    text_at = names.index("text")
    found = found.select(F.col("key").alias("__mark"), F.col("positions").alias("__positions"))
    marked = exchanged.join(found, F.col("__key") == F.col("__mark")).select(*names, "__key", "__single", "__positions")
    spread = written(runs(marked, len(names), text_at, length, seed, spans), "runs")
    holes = covered(spread, length, seed).select(F.col("key").alias("__hole"), F.col("starts").alias("__starts"), F.col("ends").alias("__ends"))
    alone = exchanged.join(holes, F.col("__key") == F.col("__hole"), "left").select(*names, "__single", F.lit(False).alias("__copied"), "__starts", "__ends")
    nothing = F.lit(None).cast("array<binary>")
    copied = copies.select(*names, F.lit(True).alias("__single"), F.lit(True).alias("__copied"), nothing.alias("__starts"), nothing.alias("__ends"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Rows that stand for groups of copies leave here, and not before, so that both joins see one exchange.
            batch = batch.filter(batch.column(len(names)))
            offsets, raw = utf8(batch.column(text_at))
            copied, starts, ends = (batch.column(len(names) + i).to_pylist() for i in (1, 2, 3))
            kept, numbers = [], []
            for i in range(batch.num_rows):
                text = raw[offsets[i] : offsets[i + 1]]
                n = len(text)
                if copied[i] and n >= length:
                    s, e = np.zeros(1, np.int64), np.full(1, n, np.int64)
                elif starts[i]:
                    s, e = united(*(np.concatenate([np.frombuffer(x, "i4") for x in part]).astype(np.int64) for part in (starts[i], ends[i])))
                else:
                    s = e = np.zeros(0, np.int64)
                rest = text[np.repeat(np.tile([True, False], len(s) + 1)[: 2 * len(s) + 1], np.diff(np.concatenate([[0], np.stack([s, e], 1).ravel(), [n]])))].tobytes() if len(s) else text.tobytes()
                kept.append(None if bytes_only else rest.decode("utf-8", "ignore") if len(s) else batch.column(text_at)[i].as_py())
                numbers.append((n, n - len(rest), len(s), hashlib.sha256(rest).hexdigest()))
            columns = [pa.array([x[k] for x in numbers], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            out = [*batch.columns[: len(names)], *columns]
            out[text_at] = pa.array(kept, out[text_at].type)
            yield pa.RecordBatch.from_arrays(out, names=[*names, "__n_bytes", "__n_removed", "__n_spans", "__sha256"])

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema = base + ", __n_bytes long, __n_removed long, __n_spans long, __sha256 string"
    return alone.mapInArrow(cut, schema).unionByName(copied.mapInArrow(cut, schema))


SQL = """
WITH bodies AS MATERIALIZED (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), texts AS (
  SELECT doc_id, n, hex(b) AS h FROM bodies
), starts AS MATERIALIZED (
  SELECT doc_id, i, md5_number(substr(h, CAST(2 * i + 1 AS INT), 400)) AS v FROM (SELECT doc_id, h, unnest(range(n - 199)) AS i FROM texts WHERE n >= 200)
), again AS (
  SELECT v FROM starts GROUP BY v HAVING count(*) > 1
), hits AS (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS fresh FROM starts SEMI JOIN again USING (v)
), spans AS MATERIALIZED (
  SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hits) GROUP BY doc_id, k
), kept AS (
  SELECT doc_id, s AS place, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS begins, s AS ends FROM spans
  UNION ALL SELECT doc_id, n, max(e), n FROM spans JOIN bodies USING (doc_id) GROUP BY doc_id, n
), rests AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * begins + 1 AS INT), CAST(2 * (ends - begins) AS INT)), '' ORDER BY place) AS h FROM kept JOIN texts USING (doc_id) GROUP BY doc_id
), sums AS (
  SELECT doc_id, sum(e - s) AS gone, count(*) AS many FROM spans GROUP BY doc_id
)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, CAST(coalesce(s.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(s.many, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(r.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN sums s ON s.doc_id = t.doc_id LEFT JOIN rests r ON r.doc_id = t.doc_id
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), bytes_only=True)
    return done.select(
        "doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"), F.col("__n_spans").alias("n_spans"), F.col("__sha256").alias("kept_sha256")
    )
