"""N-gram Jaccard join by vertical partitioning.

A document's set holds its distinct word shingles, as 64-bit hashes. The global order of all shingles is cut into fragments;
each document's set falls into one segment a fragment, partial overlaps are counted in each fragment by itself, and the counts
are summed per pair. What is compared are distinct sets; equal sets are one class, named by a 64-bit digest.

1. Sift: of each distinct set one document is taken. Each fragment of half of the order counts, per set, the shingles that no other
   set has; those that several sets of one chunk of documents have are known to it, and it sends them once. A set goes by its number
   in its chunk, 2 bytes, not by its key, as with many fragments each shingle brings its set along. A set with a partner misses at
   most (100 - threshold) % of its own size, so sets that miss more are done. Nothing with a link is lost.
2. Prefixes: for the sets that are left, shingles stand in the order (number of sets that have it, hash), rarest first. Two sets
   that link share one of their first n - ceil(threshold * n) + 1 shingles: the prefix. So only sets that meet in a prefix
   shingle are compared.
3. Stars: in each such meeting the sets are compared with one hub only; links found merge into components.
4. Rest: in each meeting the sets that are still in different components are compared with each other. Sets that are in one
   component already need no comparison, since only components are returned; so a large group of near copies costs a star, not
   all its pairs. A meeting of more than BLOCK sets is split into pairs of blocks that go to different tasks. Meetings of a pair
   are counted, and of the pairs only those that meet often enough are compared (_unique_pairs()): sets that share a passage don't.

Texts move only where they may be wanted: rows are left out by a bitmap of ids before they are joined (common.marked()).

Cases: a null or blank text has an empty set, is linked with nothing and its own component; a null doc_id gets its n_shingles,
links with nothing and has a null component; rows that repeat a doc_id are one node with the links of all of them; an empty
table gives an empty result. Sets are exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, components, marked, partitions, table, written
from .textkit import digest, groups, mix, shingles, utf8

WIDTH = 5
#: Link when 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: Bytes of all text for a fragment of the sift, and shingles of the sets that are left for one of theirs, so that a fragment fits a task.
FRAGMENT_BYTES, LEFT_SHINGLES = 32 << 20, 1_400_000
#: Members of a meeting that one task compares with each other.
BLOCK = 256
#: Rows of meetings that one task compares, about, and rows of meetings with one hub that stay together.
MEETING_ROWS, HUB_ROWS = 2000, 100_000
#: Bytes of text for a bucket of sets or pairs.
BUCKET_BYTES = 128 << 20
#: Pairs that a task counts at once.
PAIRS_AT_ONCE = 2_000_000


def set_key(values: np.ndarray) -> int:
    return int.from_bytes(digest(values)[:8], "little", signed=True)


def _sets(batch: pa.RecordBatch | pa.Table, text: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per group of documents: number of the first, and size, owner and value arrays of their sets."""
    offsets, raw = utf8(batch.column(text))
    for a, b in groups(offsets):
        owner, value = shingles(offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]], width)
        yield a, np.bincount(owner, minlength=b - a), owner, value


def _fragment(value: np.ndarray, n: int) -> np.ndarray:
    """Number of the fragment of the order of hashes, 0 to n - 1."""
    return ((value >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _packed(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()] or [np.zeros(0, kind)])


IDS = "doc_id long, n int, key long"


def document_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, size of its set, key of its set) of every row of (doc_id, text); an empty set has no key."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for a, sizes, _, value in _sets(batch, 1, width):
                ends = np.cumsum(sizes)
                keys = [set_key(value[e - n : e]) if n else None for e, n in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(sizes)), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64())], ["doc_id", "n", "key"])

    return docs.select("doc_id", "text").mapInArrow(read, IDS)


def _runs(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted small numbers as runs: number (2 bytes) and length (1 byte); a longer run is several."""
    number, length = np.unique(numbers, return_counts=True)
    rows = -(-length // 255)
    out = np.full(rows.sum(), 255)
    out[np.cumsum(rows) - 1] = length - 255 * (rows - 1)
    return _packed(np.repeat(number, rows), "u2"), _packed(out, "u1")


#: Owner of a shingle that several sets of a chunk have.
MANY = (1 << 16) - 1
SIFT = "fragment int, chunk long, owners binary, lengths binary, tails binary, keys binary, sizes binary"


def sift(texts: DataFrame, width: int, threshold: int, fragments: int, buckets: int) -> DataFrame:
    """(key) of the sets that may have a partner. texts: (doc_id, text), a row for each distinct set; more rows of a set only let it pass.

    Sets go by their number in their chunk, a task's group of documents, so that what a shingle costs doesn't grow with the fragments.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for _, sizes, owner, value in _sets(batch, 1, width):
                chunk += 1
                ends = np.cumsum(sizes)
                keys = np.array([set_key(value[e - n : e]) if n else 0 for e, n in zip(ends, sizes, strict=True)], np.int64)
                out = [(-1, chunk, None, None, None, _packed(keys, "i8"), _packed(sizes, "i4"))]
                low = value < np.uint64(1 << 63)
                owner, value = _met_here(owner[low], value[low] << np.uint64(1))
                part = _fragment(value, fragments).astype(np.int64)
                order = np.lexsort((owner, part))
                owner, value, part = owner[order], value[order], part[order]
                tails = (value >> np.uint64(8)).astype(np.uint32)
                bounds = np.searchsorted(part, np.arange(fragments + 1))
                for f in np.flatnonzero(np.diff(bounds)):
                    s = slice(bounds[f], bounds[f + 1])
                    out.append((int(f), chunk, *_runs(owner[s]), _packed(tails[s], "u4"), None, None))
                yield _batch(out, cut_schema)

    def count(group: pa.Table) -> pa.Table:
        """Per chunk, the sets whose shingles nobody else has in this fragment, a run each."""
        if group.column("fragment")[0].as_py() < 0:
            return group
        chunks, owners, lengths, tails = (group.column(c).to_pylist() for c in ("chunk", "owners", "lengths", "tails"))
        tails = [np.frombuffer(x, "u4") for x in tails]
        _, to, held = np.unique(np.concatenate(tails), return_inverse=True, return_counts=True)
        alone, at, out = (held == 1)[to], 0, []
        for chunk, who, runs, tail in zip(chunks, owners, lengths, tails, strict=True):
            owner = np.repeat(np.frombuffer(who, "u2"), np.frombuffer(runs, "u1"))
            missed = owner[alone[at : at + len(tail)] & (owner != MANY)]
            at += len(tail)
            if len(missed):
                out.append((-1, chunk, *_runs(missed), None, None, None))
        return pa.Table.from_batches([_batch(out, cut_schema)])

    def total(group: pa.Table) -> pa.Table:
        group, left = group.sort_by("chunk"), [np.zeros(0, np.int64)]
        chunks = group.column("chunk").to_numpy()
        starts = np.flatnonzero(np.diff(chunks, prepend=-1))
        for at, end in zip(starts, np.append(starts[1:], len(chunks)), strict=True):
            rows = group.slice(at, end - at)
            keys, sizes = (_joined(rows.column(c).drop_null(), k) for c, k in (("keys", "i8"), ("sizes", "i4")))
            owners, lengths = (_joined(rows.column(c).drop_null(), k) for c, k in (("owners", "u2"), ("lengths", "u1")))
            missed = np.bincount(owners, weights=lengths, minlength=len(keys))
            left.append(keys[(sizes > 0) & (100 * missed <= (100 - threshold) * sizes.astype(np.int64))])
        return pa.table({"key": pa.array(np.unique(np.concatenate(left)), pa.int64())})

    cut_schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SIFT.split(", "))])
    rows = texts.select("doc_id", "text").mapInArrow(cut, SIFT)
    # What names a chunk's sets needs no counting, but it goes the same way, so that texts are read once.
    rows = rows.withColumn("fragment", F.when(F.col("fragment") < 0, -1 - F.pmod(F.xxhash64("chunk"), F.lit(buckets))).otherwise(F.col("fragment")).cast("int"))
    rows = rows.groupBy("fragment").applyInArrow(count, SIFT)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("chunk"), F.lit(buckets))).groupBy("bucket").applyInArrow(total, "key long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(schema))], schema=schema)


def _met_here(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sets of this chunk have are not missed by any of them: each is sent once, owned by MANY.

    So a shingle that very many documents have is sent once a chunk, not once a document.
    """
    found, to, held = np.unique(value, return_inverse=True, return_counts=True)
    one, common = (held == 1)[to], found[held > 1]
    return np.concatenate([owner[one], np.full(len(common), MANY)]), np.concatenate([value[one], common])


def segments(texts: DataFrame, width: int, fragments: int) -> DataFrame:
    """(key, text) -> (fragment, keys, sizes, lengths, values): the sets, cut into fragments and packed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            for a, sizes, owner, value in _sets(batch, 1, width):
                ends = np.cumsum(sizes)
                keys = np.array([set_key(value[e - n : e]) if n else 0 for e, n in zip(ends, sizes, strict=True)], np.int64)
                right = np.array([n > 0 and k == wanted[a + i] for i, (n, k) in enumerate(zip(sizes, keys, strict=True))], bool)
                keep = right[owner]
                owner, value = owner[keep], value[keep]
                part = _fragment(value, fragments).astype(np.int64)
                order = np.lexsort((owner, part))
                owner, value, part = owner[order], value[order], part[order]
                bounds, out = np.searchsorted(part, np.arange(fragments + 1)), []
                for f in np.flatnonzero(np.diff(bounds)):
                    s = slice(bounds[f], bounds[f + 1])
                    who, lengths = np.unique(owner[s], return_counts=True)
                    out.append((int(f), _packed(keys[who], "i8"), _packed(sizes[who], "i4"), _packed(lengths, "i4"), _packed(value[s], "u8")))
                yield _batch(out, schema)

    schema = pa.schema([("fragment", pa.int32()), *((n, pa.binary()) for n in ("keys", "sizes", "lengths", "values"))])
    return texts.select("key", "text").mapInArrow(cut, "fragment int, keys binary, sizes binary, lengths binary, values binary")


class _Segments:
    """The segments of one fragment, sorted by key; rows that repeat a key count once."""

    def __init__(self, group: pa.Table):
        keys, sizes, lengths = (_joined(group.column(c), k) for c, k in (("keys", "i8"), ("sizes", "i4"), ("lengths", "i4")))
        values = _joined(group.column("values"), "u8")
        at = np.cumsum(lengths, dtype=np.int64) - lengths
        self.keys, one = np.unique(keys, return_index=True)
        self.sizes, self.lengths, at = sizes[one], lengths[one].astype(np.int64), at[one]
        self.start = np.cumsum(self.lengths) - self.lengths
        self.values = values[np.repeat(at - self.start, self.lengths) + np.arange(int(self.lengths.sum()))]
        self.tokens, self.token, self.held = np.unique(self.values, return_inverse=True, return_counts=True)


def prefixes(cut: DataFrame, threshold: int, buckets: int) -> DataFrame:
    """(token, key, n): each set's prefix in the order (sets that have it, hash), without shingles that one set has."""

    def count(group: pa.Table) -> pa.Table:
        s, out = _Segments(group), []
        bucket = (mix(s.keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        owner = np.repeat(bucket, s.lengths)
        for b in np.unique(bucket):
            m, mine = bucket == b, owner == b
            out.append((int(b), _packed(s.keys[m], "i8"), _packed(s.sizes[m], "i4"), _packed(s.lengths[m], "i4"), _packed(s.values[mine], "u8"), _packed(s.held[s.token[mine]], "u4")))
        return pa.Table.from_batches([_batch(out, schema)])

    def first(group: pa.Table) -> pa.Table:
        keys, sizes, lengths, values, held = (_joined(group.column(c), k) for c, k in (("keys", "i8"), ("sizes", "i4"), ("lengths", "i4"), ("values", "u8"), ("held", "u4")))
        key, n = np.repeat(keys, lengths), np.repeat(sizes, lengths).astype(np.int64)
        order = np.lexsort((values, held, key))
        key, n, values, held = key[order], n[order], values[order], held[order]
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(start)
        rank = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
        keep = (rank <= n - (threshold * n + 99) // 100) & (held > 1)
        return pa.table({"token": pa.array(values[keep].view(np.int64)), "key": pa.array(key[keep]), "n": pa.array(n[keep].astype(np.int32))})

    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("keys", "sizes", "lengths", "values", "held"))])
    packed = cut.groupBy("fragment").applyInArrow(count, "bucket int, keys binary, sizes binary, lengths binary, values binary, held binary")
    return packed.groupBy("bucket").applyInArrow(first, "token long, key long, n int")


PAIRS = "bucket int, chunk int, a binary, b binary, na binary, nb binary"
_PAIRS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), *((n, pa.binary()) for n in ("a", "b", "na", "nb"))])
_MEETINGS = pa.schema([*_PAIRS, ("times", pa.binary())])


def verified(pairs: DataFrame, cut: DataFrame, threshold: int, fragments: int, buckets: int) -> DataFrame:
    """Packed distinct pairs -> links (a, b) that span the components of the pairs that link.

    Each fragment counts the overlaps of all its segments; the sums per pair decide.
    """

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            s = _Segments(left)
            seen = np.full(len(s.tokens), -1, np.int64)
            for row in right.to_pylist():
                a, b = (np.frombuffer(row[c], "i8") for c in "ab")
                ia, ib = (np.minimum(np.searchsorted(s.keys, x), len(s.keys) - 1) for x in (a, b))
                have = np.flatnonzero((s.keys[ia] == a) & (s.keys[ib] == b))
                have = have[np.argsort(ia[have], kind="stable")]
                counts = np.zeros(len(a), np.int64)
                bounds = np.flatnonzero(np.diff(ia[have], prepend=-1))
                for at, end in zip(bounds, [*bounds[1:], len(have)][: len(bounds)], strict=True):
                    i, mine = ia[have[at]], have[at:end]
                    seen[s.token[s.start[i] : s.start[i] + s.lengths[i]]] = i
                    j = ib[mine]
                    lengths = s.lengths[j]
                    begin = np.cumsum(lengths) - lengths
                    hit = seen[s.token[np.repeat(s.start[j] - begin, lengths) + np.arange(int(lengths.sum()))]] == i
                    counts[mine] = np.add.reduceat(hit, begin, dtype=np.int64)
                    seen[s.token[s.start[i] : s.start[i] + s.lengths[i]]] = -1
                out.append((row["bucket"], row["chunk"], None, None, None, None, _packed(counts, "u4")))
        return pa.Table.from_batches([_batch(out, schema)])

    def total(group: pa.Table) -> pa.Table:
        sums: dict[int, np.ndarray] = {}
        rows = {}
        for row in group.to_pylist():
            k = row["chunk"]
            if row["counts"] is None:
                rows[k] = [np.frombuffer(row[c], kind).astype(np.int64) for c, kind in (("a", "i8"), ("b", "i8"), ("na", "i4"), ("nb", "i4"))]
            else:
                sums[k] = sums.get(k, 0) + np.frombuffer(row["counts"], "u4").astype(np.int64)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        out = []
        for k, (a, b, na, nb) in rows.items():
            both = sums.get(k, np.zeros(len(a), np.int64))
            linked = 100 * both >= threshold * (na + nb - both)
            for x, y in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
                if (rx := root(x)) != (ry := root(y)):
                    up[ry] = rx
                    out.append((x, y))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    schema = pa.schema([*_PAIRS, ("counts", pa.binary())])
    # One task holds a fragment's segments and a share of the pairs; more pairs take more shares.
    dealt = pairs.select("bucket", "chunk", "a", "b").withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))))
    shares = max(1, int(pairs.agg(F.sum(F.octet_length("a"))).first()[0] or 0) // 8 // PAIRS_AT_ONCE)
    dealt = dealt.withColumn("share", F.pmod("bucket", F.lit(shares)))
    spread = cut.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    keys = ["fragment", "share"]
    counted = spread.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(lambda left, right: count(left, right), f"{PAIRS}, counts binary")
    both = counted.unionByName(pairs.withColumn("counts", F.lit(None).cast("binary")))
    return both.groupBy("bucket").applyInArrow(total, "a long, b long")


def _unique_pairs(packed: DataFrame, threshold: int | None = None) -> DataFrame:
    """Packed pairs, equal ones once; chunks of a bucket are numbered.

    threshold: of pairs with the times that they meet, those that meet too seldom to link go. A prefix leaves ceil(threshold * n) - 1
    shingles, and where the prefix that ends first ends, the other has no more of them to come than its own prefix; so two sets
    with an overlap of least shingles have least - max(ceil(threshold * n)) + 1 in both prefixes.
    """

    def once(group: pa.Table) -> pa.Table:
        parts = [_joined(group.column(c), kind) for c, kind in (("a", "i8"), ("b", "i8"), ("na", "i4"), ("nb", "i4"))]
        order = np.lexsort((parts[1], parts[0]))
        parts = [x[order] for x in parts]
        starts = np.ones(len(order), bool)
        starts[1:] = (parts[0][1:] != parts[0][:-1]) | (parts[1][1:] != parts[1][:-1])
        one = np.flatnonzero(starts)
        if threshold is not None and len(one):
            times = np.add.reduceat(_joined(group.column("times"), "u4")[order].astype(np.int64), one)
            na, nb = (x[one].astype(np.int64) for x in parts[2:])
            least, most = -(-threshold * (na + nb) // (100 + threshold)), -(-threshold * np.maximum(na, nb) // 100)
            one = one[times >= least - most + 1]
        bucket, out = group.column("bucket")[0].as_py(), []
        for i, at in enumerate(range(0, len(one), 50_000)):
            k = one[at : at + 50_000]
            out.append((bucket, i, *(x[k].tobytes() for x in parts)))
        return pa.Table.from_batches([_batch(out, _PAIRS)])

    return packed.groupBy("bucket").applyInArrow(once, PAIRS)


def _bucketed(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, buckets: int, times: np.ndarray | None = None) -> list[tuple]:
    """Pairs by a hash of both ends, so that a hub's pairs spread over all buckets."""
    bucket, out = (mix(a.view(np.uint64) ^ mix(b.view(np.uint64))) % np.uint64(buckets)).astype(np.int64), []
    for x in np.unique(bucket):
        m = bucket == x
        out.append((int(x), 0, _packed(a[m], "i8"), _packed(b[m], "i8"), _packed(na[m], "i4"), _packed(nb[m], "i4"), *(() if times is None else (_packed(times[m], "u4"),))))
    return out


def stars(postings: DataFrame, threshold: int, buckets: int) -> DataFrame:
    """Packed pairs of each meeting's hub with its other members."""
    hubs = postings.groupBy("token").agg(F.min(F.struct(F.xxhash64("key").alias("h"), "key", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    met = postings.join(hubs.select("token", F.col("hub.key").alias("a"), F.col("hub.n").alias("na")), "token").where(
        (F.col("a") != F.col("key")) & (100 * F.least("n", "na") >= threshold * F.greatest("n", "na"))
    )
    pairs = met.select("a", F.col("key").alias("b"), "na", "n").distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch(_bucketed(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)), buckets), _PAIRS)

    return _unique_pairs(pairs.mapInArrow(pack, PAIRS))


def rest(postings: DataFrame, known: DataFrame, threshold: int, buckets: int) -> DataFrame:
    """Packed pairs of sets that meet and are in different components."""
    placed = postings.join(known.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    hub = F.min(F.xxhash64("key")).alias("hub")
    open_ = placed.groupBy("token").agg(F.count("*").alias("m"), F.min("component").alias("c1"), F.max("component").alias("c2"), hub).where("c1 != c2").select("token", "m", "hub")
    blocks = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("m") / F.lit(BLOCK), F.lit(1))))).cast("int")
    open_ = written(open_.withColumn("blocks", blocks), "open")
    rows = open_.agg(F.sum(F.col("m") * F.col("blocks"))).first()[0] or 0
    # Shingles of one passage mostly have one hub, so a pair's meetings in them are counted in one task and leave it once.
    shares = open_.groupBy("hub").agg(F.ceil(F.sum(F.col("m") * F.col("blocks")) / F.lit(HUB_ROWS)).alias("shares"))
    met = placed.join(open_.join(shares, "hub").withColumn("share", F.pmod(F.xxhash64("token"), F.col("shares"))).drop("m", "shares"), "token")
    met = met.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    met = met.withColumn("task", F.pmod(F.xxhash64("hub", "share", "lo", "hi"), F.lit(max(buckets, rows // MEETING_ROWS))).cast("int"))

    def cross(group: pa.Table) -> pa.Table:
        token, key, n, component, mine, lo, hi = (group.column(c).to_numpy() for c in ("token", "key", "n", "component", "mine", "lo", "hi"))
        sets, one, at_set = np.unique(key, return_index=True, return_inverse=True)
        order = np.lexsort((hi, lo, token))
        bounds = np.flatnonzero(np.diff(token[order], prepend=token[order[0]] - 1) | np.diff(lo[order], prepend=-1) | np.diff(hi[order], prepend=-1))
        found, held, out, times = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def added() -> tuple[np.ndarray, np.ndarray]:
            new = np.concatenate([np.zeros(0, np.int64), *found])
            pairs, to = np.unique(np.concatenate([out, new]), return_inverse=True)
            return pairs, np.bincount(to, weights=np.concatenate([times, np.ones(len(new))]), minlength=len(pairs)).astype(np.int64)

        for at, end in zip(bounds, np.append(bounds[1:], len(order)), strict=True):
            i = order[at:end]
            left, right = (i, i) if lo[i[0]] == hi[i[0]] else (i[mine[i] == lo[i[0]]], i[mine[i] != lo[i[0]]])
            x, y = n[left].astype(np.int64), n[right].astype(np.int64)
            fit = (component[left][:, None] != component[right][None, :]) & (100 * np.minimum(x[:, None], y) >= threshold * np.maximum(x[:, None], y))
            p, q = np.nonzero(np.triu(fit, 1) if left is right else fit)
            p, q = at_set[left[p]], at_set[right[q]]
            found.append(np.minimum(p, q) * len(sets) + np.maximum(p, q))
            held += len(p)
            if held > 2_000_000:
                out, times = added()
                found, held = [], 0
        out, times = added()
        a, b = one[out // len(sets)], one[out % len(sets)]
        return pa.Table.from_batches([_batch(_bucketed(key[a], key[b], n[a], n[b], buckets, times), _MEETINGS)])

    met = met.select("task", "token", "key", "n", "component", "mine", "lo", "hi").groupBy("task").applyInArrow(cross, f"{PAIRS}, times binary")
    return _unique_pairs(met, threshold)


def ngram_components(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text) -> one row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    bound_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    buckets = max(partitions(spark), total // BUCKET_BYTES)
    ids = written(document_sets(docs, width), "sets")
    named = ids.where("doc_id IS NOT NULL AND key IS NOT NULL")
    docs = docs.select("doc_id", "text")
    reps = named.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    first = marked(docs, "doc_id", reps.select("doc_id")).where("__maybe")
    left = sift(first, width, threshold, max(buckets, total // FRAGMENT_BYTES), buckets)
    reps = written(reps.join(left, "key", "left_semi"), "left")
    parts = max(4, (reps.agg(F.sum("n")).first()[0] or 0) // LEFT_SHINGLES)
    texts = marked(docs, "doc_id", reps.select("doc_id")).where("__maybe").join(reps.select("key", "doc_id"), "doc_id")
    cut = written(segments(texts, width, parts), "segments")
    postings = written(prefixes(cut, threshold, buckets), "postings")
    links = written(verified(written(stars(postings, threshold, buckets), "stars"), cut, threshold, parts, buckets), "links")
    known = components(links)
    more = verified(written(rest(postings, known, threshold, buckets), "rest"), cut, threshold, parts, buckets)
    # Documents with one set are linked through it, and rows with one doc_id are one node.
    known = components(links.unionByName(more).unionByName(_same_document(named)))
    placed = named.join(known, named.key == known.node, "left").select("doc_id", F.coalesce("component", "key").alias("component"))
    first = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named_ids = placed.join(first, "component").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return ids.join(named_ids, "doc_id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _same_document(named: DataFrame) -> DataFrame:
    """Links between the sets of rows that repeat a doc_id."""
    first = named.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("__last")).where("a != __last").select("doc_id", "a")
    return named.join(first, "doc_id").where("key != a").select("a", F.col("key").alias("b"))


SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT doc_id, hash(s) AS s FROM (SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(len(w) - 4, least(len(w), 1))), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS s FROM worded)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_ AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_ r ON r.a = d.doc_id
"""


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
