"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Equal vectors of one label are one class; only classes are compared. Each tree splits the unit vectors again and again by the
median of a random projection; vectors within a margin of the threshold go to both sides. Two unit vectors of the threshold's
cosine differ by s = sqrt(2 - 2 cosine), and the projection of that difference on a random direction of d dimensions deviates by
s / sqrt(d), wherever the vectors lie; from it and from how densely a node's vectors lie at its split follows how many such pairs a margin
loses. Each node takes the least margin that keeps the share that RECALL over all trees asks of it, and isn't split where that margin
would send most of its vectors to both sides. The splits are fitted on a bounded sample, as deep as the largest label asks for and the
sample allows, and every vector descends every tree. Classes of one label that share a leaf
are compared exactly, in double precision; a pair that shares several leaves counts in the first of them only, which both sides
can tell from their own lists of leaves. So links are counted and merged inside the leaves, and no list of pairs is made. Leaves
with more than BLOCK classes are split into pairs of blocks that go to different tasks.

Cases: a vector that is null, zero or holds null or non-finite components, or has a null label, links with nothing; vectors of
other lengths are only compared with their like; a null vec_id is counted as a vector but never names a component; rows that
repeat a vec_id are vectors of their own that share their row of the result's id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, hash_below, table, written

COSINE = 0.98
TREES = 6
#: The share of pairs at the threshold that meet in a leaf of at least one tree, by the splits' own estimate; closer pairs meet more often.
RECALL = 0.95
#: A node isn't split if its children would take more than this share of it each.
MOST = 0.85
#: Vectors that the splits of a length are fitted on, at most, and bytes of the sample and of all splits of a length.
SAMPLE, BYTES = 20_000, 64 << 20
#: Lengths of vectors that have trees, those with the largest labels; of others all pairs of a label are compared.
LENGTHS = 16
#: Classes of a leaf that the depth of the trees aims at, and that one task compares with each other at most.
LEAF, BLOCK = 400, 1500


@dataclass
class Forest:
    """Splits in heap order, a row for each inner node: node i has children 2i + 1 and 2i + 2."""

    normals: np.ndarray  # trees, inner nodes, dimensions
    bounds: np.ndarray  # trees, inner nodes
    margins: np.ndarray  # trees, inner nodes
    depth: int

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf, numbered over all trees, for each leaf that each unit vector is in."""
        rows, out = [], []
        for t in range(len(self.normals)):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x[row], self.normals[t][node]) - self.bounds[t][node]
                left, right = side < self.margins[t][node], side >= -self.margins[t][node]
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            rows.append(row)
            out.append(node - ((1 << self.depth) - 1) + (t << self.depth))
        return np.concatenate(rows), np.concatenate(out)


def _lost(side: np.ndarray, bound: float, margin: float, apart: np.ndarray) -> float:
    """The share of pairs, with projections `apart`, whose lower one is by `side` (sorted) and that a split with this margin parts."""
    below = np.searchsorted(side, bound - margin)
    from_ = np.searchsorted(side, bound + margin - apart)
    return float(np.maximum(below - from_, 0).mean()) / len(side)


#: Quantiles of the half-normal distribution, in the middle of 16 equal shares.
_HALF = np.array([NormalDist().inv_cdf(0.5 + (k + 0.5) / 32) for k in range(16)])


def grow(sample: np.ndarray, depth: int, trees: int = TREES, cosine: float = COSINE, recall: float = RECALL, seed: int = 5) -> Forest:
    """Splits fitted on unit vectors; a node that isn't split sends all to its left child."""
    rng = np.random.default_rng(seed)
    inner, d = (1 << depth) - 1, sample.shape[1]
    normals = rng.standard_normal((trees, inner, d))
    normals /= np.linalg.norm(normals, axis=2, keepdims=True)
    bounds, margins = np.full((trees, inner), np.inf), np.zeros((trees, inner))
    apart = np.sqrt(max(0.0, 2 - 2 * cosine) / d) * _HALF
    # A tree may lose so much that all of them together reach the recall, and each of its levels a part of that.
    allowed = 1 - (1 - (1 - recall) ** (1 / trees)) ** (1 / max(depth, 1))
    for t in range(trees):
        held = {0: np.arange(len(sample))}
        for node in range(inner):
            i = held.pop(node)
            children = 2 * node + 1, 2 * node + 2
            held[children[0]], held[children[1]] = i, i[:0]
            if len(i) < 8:
                continue
            side = sample[i] @ normals[t, node]
            ranked = np.sort(side)
            bound = ranked[len(ranked) // 2]
            low, high = 0.0, float(apart[-1]) / 2  # at the upper end no pair is lost
            for _ in range(7):
                middle = (low + high) / 2
                low, high = (low, middle) if _lost(ranked, bound, middle, apart) <= allowed else (middle, high)
            margin = (0.0 if _lost(ranked, bound, 0.0, apart) <= allowed else high) + 1e-12
            left, right = side - bound < margin, side - bound >= -margin
            if max(left.sum(), right.sum()) > MOST * len(i):
                continue
            bounds[t, node], margins[t, node] = bound, margin
            held[children[0]], held[children[1]] = i[left], i[right]
    return Forest(normals, bounds, margins, depth)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and components of a list column in double precision; null components are NaN, null lists are empty."""
    if not pa.types.is_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), values + 0.0  # one zero


def unit_vectors(offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have a direction, and all components over their vector's length.

    A vector is first divided by its largest component, so that no square overflows or vanishes.
    """
    sizes = np.diff(offsets)
    some = np.flatnonzero(sizes > 0)
    most = np.zeros(len(sizes))
    if len(some):
        most[some] = np.maximum.reduceat(np.abs(values), offsets[some])
    good = np.isfinite(most) & (most > 0)
    scaled = values / np.repeat(np.where(good, most, 1.0), sizes)
    norm = np.zeros(len(sizes))
    if len(some):
        norm[some] = np.sqrt(np.add.reduceat(np.where(np.repeat(good, sizes), scaled, 0.0) ** 2, offsets[some]))
    return good, scaled / np.repeat(np.where(good, norm, 1.0), sizes)


def sampling_share(n: int, sample: int = SAMPLE) -> int:
    """The largest 64-bit hash that a draw of about `sample` of n classes takes."""
    return hash_below(min(1.0, sample / max(1, n)))


def tree_depth(largest: int, sampled: int, d: int = 1, trees: int = TREES) -> int:
    """Levels that bring the classes of the largest label down to LEAF in a leaf, as far as the sample has 8 vectors for each, and
    as the splits' normals fit in BYTES."""
    fits = int(np.log2(max(1.0, BYTES / (8 * d * trees))))
    return max(0, min(int(np.ceil(np.log2(max(1, largest / LEAF)))), int(np.log2(max(2, sampled / 8))), fits))


def classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) -> with `class`, a hash of label and exact vector; null where nothing may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = _flat(batch.column(1))
            good, _ = unit_vectors(offsets, values)
            labels, keys, whole = batch.column(2).to_pylist(), [], values.tobytes()
            for i, (ok, label) in enumerate(zip(good.tolist(), labels, strict=True)):
                if not ok or label is None:
                    keys.append(None)
                    continue
                h = hashlib.blake2b(whole[8 * offsets[i] : 8 * offsets[i + 1]] + repr(label).encode(), digest_size=8).digest()
                keys.append(int.from_bytes(h, "little", signed=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["vec_id", "embedding", "label", "class"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{fields}, class long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, embedding, label) -> one row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    named = written(classes(vectors.select("vec_id", "embedding", "label")), "classes")
    sizes = named.where("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("size"), F.min("vec_id").alias("first"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    sizes = written(sizes.withColumn("d", F.size("embedding")), "classes")
    # Lengths whose labels are all small need no trees; a row for each of the others, LENGTHS at most.
    labels = sizes.groupBy("d", "label").agg(F.count("*").alias("n")).groupBy("d").agg(F.max("n").alias("largest"), F.sum("n").alias("n"))
    forests = {}
    for r in labels.where(F.col("largest") > LEAF).orderBy(F.desc("largest"), "d").limit(LENGTHS).collect():
        d, most = r["d"], max(1, min(sample, BYTES // (8 * r["d"])))
        drawn = sizes.where((F.col("d") == d) & (F.xxhash64("class") <= sampling_share(r["n"], most))).select("embedding").limit(2 * most)
        rows = [x[0] for x in drawn.collect()] or [[1.0] * d]
        x = unit_vectors(np.arange(len(rows) + 1) * d, np.array(rows, np.float64).ravel())[1].reshape(-1, d)
        forests[d] = grow(x, tree_depth(r["largest"], len(x), d, trees), trees, cosine)
    held = spark.sparkContext.broadcast(forests)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = _flat(batch.column(2))
            unit, lengths = unit_vectors(offsets, values)[1], np.diff(offsets)
            keys, label = batch.column(0).to_numpy(), [repr(x) for x in batch.column(3).to_pylist()]
            for d in np.unique(lengths).tolist():
                i = np.flatnonzero(lengths == d)
                x = unit[offsets[i][:, None] + np.arange(d)]
                row, leaf = held.value[d].leaves(x) if d in held.value else (np.arange(len(i)), np.zeros(len(i), np.int64))
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                at = np.searchsorted(row, np.arange(len(i) + 1))
                data = [x[r].tobytes() for r in range(len(i))]
                lists = [leaf[a:b].astype("i4").tobytes() for a, b in zip(at, at[1:], strict=False)]
                groups = [f"{label[i[r]]}/{d}/{v}" for r, v in zip(row, leaf, strict=True)]
                sizes = batch.column(1).to_numpy()[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(groups), pa.array(leaf.astype(np.int32)), pa.array(keys[i][row]), pa.array(sizes[row]), pa.array([data[r] for r in row], pa.binary()), pa.array([lists[r] for r in row], pa.binary())],
                    names=["group", "leaf", "class", "size", "x", "leaves"],
                )

    in_leaves = sizes.select("class", "size", "embedding", "label").mapInArrow(descend, "group string, leaf int, class long, size long, x binary, leaves binary")
    in_leaves = written(in_leaves, "leaves")
    large = in_leaves.groupBy("group").agg(F.count("*").alias("m")).where("m > 1")
    dealt = in_leaves.join(large, "group").withColumn("blocks", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, lo, hi = key
        left, right = (group, group) if lo == hi else (group[group["mine"] == lo], group[group["mine"] == hi])
        if left.empty or right.empty:
            return pd.DataFrame({"class": [], "links": [], "root": []})
        a, b = (np.frombuffer(b"".join(g["x"]), np.float64).reshape(len(g), -1) for g in (left, right))
        close = a @ b.T >= cosine
        if lo == hi:
            np.fill_diagonal(close, False)
        i, j = np.nonzero(close)
        # Leaves come in order; a pair counts where its first common leaf is this one.
        lists = [[np.frombuffer(v, "i4") for v in g["leaves"]] for g in (left, right)]
        here, (la, lb) = int(group["leaf"].iloc[0]), (_padded(x) for x in lists)
        first = np.zeros(len(i), bool)
        for at in range(0, len(i), 100_000):
            s = slice(at, at + 100_000)
            p, q = la[i[s]], lb[j[s]]
            first[s] = ~((p[:, :, None] == q[:, None, :]) & (p[:, :, None] < here) & (p[:, :, None] >= 0)).any((1, 2))
        i, j = i[first], j[first]
        na = np.bincount(i, weights=right["size"].to_numpy()[j], minlength=len(left))
        ca, cb = left["class"].to_numpy(), right["class"].to_numpy()
        parts = [(ca, na)]
        if lo != hi:
            parts.append((cb, np.bincount(j, weights=left["size"].to_numpy()[i], minlength=len(right))))
        names = np.concatenate([c for c, _ in parts])
        links = np.concatenate([n for _, n in parts]).astype(np.int64)
        places = {c: k for k, c in enumerate(names.tolist())}
        up = np.arange(len(names))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            rx, ry = root(x), root(places[int(cb[y])])
            if rx != ry:
                up[ry] = rx
        roots = np.array([root(k) for k in range(len(names))], np.int64)
        keep = (links > 0) | (roots != np.arange(len(names)))
        return pd.DataFrame({"class": names[keep], "links": links[keep], "root": names[roots[keep]]})

    found = dealt.select("group", "lo", "hi", "leaf", "class", "size", "x", "leaves", "mine").groupBy("group", "lo", "hi").applyInPandas(compare, "class long, links long, root long")
    found = written(found, "found")
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    known = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    placed = sizes.join(known, sizes["class"] == known["node"], "left").select("class", "size", "first", F.coalesce("component", "class").alias("component"))
    firsts = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = placed.join(firsts, "component").join(counts, "class", "left").select(
        "class", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"
    )
    out = named.select("vec_id", "class").join(placed, "class", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _padded(lists: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists))), -1, np.int32)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


SQL = """
WITH RECURSIVE plain AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), good AS MATERIALIZED (
  SELECT vec_id, label, list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda u: u * u)))) AS x FROM plain
  WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND list_sum(list_transform(x, lambda v: v * v)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) >= 0.98
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE a = vec_id) AS BIGINT) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
       vec_id <= coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id) AS kept
FROM embeddings
"""


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
