"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window.

Two dictionaries of equal size are trained by zstandard, one on toxic and one on ordinary training texts: on the passages made of
strings that recur in texts of the class (LEAST_TEXTS of them or more) and that the other class hasn't. Before compressing, both
are followed by the same sample of ordinary text, so that what both classes share costs the same and lengths differ by what is
one class's own. Every window of every text is compressed with both; a window's evidence is how many bytes less it takes with the
toxic dictionary. Thresholds on that difference are calibrated on training texts that were not used for the dictionaries: the
differences that one in a hundred, a thousand and ten thousand ordinary windows exceed, and a few fixed ones. A text's score is a
logistic function, fitted on the same texts, of how many of its windows pass each threshold.

Cases: a null or empty text has no windows; a training set without toxic or without ordinary texts gives a score of 0 to all
texts; labels that are null are not learned from; repeated labels of a document count once each; an empty table gives an empty
result. Texts are scored one by one, so nothing is shuffled for it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bound_batches, hash_below, table
from .textkit import groups, utf8

WINDOW, STRIDE = 64, 48
#: Bounds of the training sample: documents of each kind, and bytes of all of them.
MAX_TOXIC, MAX_ORDINARY, MAX_BYTES = 3000, 4500, 48 << 20
#: Bytes of the ordinary text that follows both dictionaries, and of each dictionary.
BASE_BYTES, TRAINED_BYTES = 400_000, 4096
#: Strings that are looked for in both classes have GRAM bytes; those that LEAST_TEXTS texts of one class alone have are trained on.
GRAM, LEAST_TEXTS = 6, 4
#: Passages that a dictionary is trained on, at most.
MAX_PASSAGES = 60_000
#: Bytes of the parts that are drawn from a training text that is over its class's share.
PART = 1024
#: Differences in bytes that are thresholds beside the calibrated ones, and windows that are counted beyond one.
FIXED, MOST = (1, 2, 4), 6
PREDICT_AT = 0.3
#: Windows that are compressed in one call.
CALL = 20_000

_GRAM_BITS = 22
#: Letters A-Z to lower case, all else of ASCII but letters to spaces; other bytes stay.
_PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint8)


def _lower(text: bytes) -> bytes:
    return _PLAIN[np.frombuffer(text, np.uint8)].tobytes()


def _gram_codes(text: bytes) -> np.ndarray:
    """Hashes of all strings of GRAM bytes."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) < GRAM:
        return np.zeros(0, np.int64)
    code = np.zeros(len(raw) - GRAM + 1, np.uint32)
    for i in range(GRAM):
        code = code * np.uint32(0x01000193) ^ raw[i : len(raw) - GRAM + 1 + i]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - _GRAM_BITS)).astype(np.int64)


def text_counts(texts: list[bytes]) -> np.ndarray:
    """In how many texts each string of GRAM bytes stands, by its hash."""
    out = np.zeros(1 << _GRAM_BITS, np.uint16)
    for t in texts:
        out[_gram_codes(t)] += 1  # a place that is named twice counts once
    return out


def own_passages(texts: list[bytes], own: np.ndarray, other: np.ndarray) -> list[bytes]:
    """Passages of the texts that are covered by strings of their class alone; a text's equal passages count once."""
    out = []
    for t in texts:
        codes = _gram_codes(t)
        at = np.flatnonzero((own[codes] >= LEAST_TEXTS) & (other[codes] == 0))
        if len(at):
            new = np.append(True, at[1:] > at[:-1] + GRAM)
            begins, ends = at[new], at[np.append(new[1:], True)] + GRAM
            out.extend(dict.fromkeys(t[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)))
    return out


def train_dictionary(passages: list[bytes]) -> bytes:
    """What zstandard trains on the passages, of TRAINED_BYTES; if they are too few to train on, the passages themselves."""
    if len(passages) > MAX_PASSAGES:
        passages = [passages[i] for i in sorted(np.random.default_rng(7).choice(len(passages), MAX_PASSAGES, replace=False).tolist())]
    try:
        made = zstandard.train_dictionary(TRAINED_BYTES, passages, k=12, d=6).as_bytes()
    except zstandard.ZstdError:
        made = b" ".join(dict.fromkeys(passages))
    return made[-TRAINED_BYTES:].rjust(TRAINED_BYTES, b"\0")


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of every window of texts that follow each other, and the number of the text it is of."""
    sizes = np.diff(offsets)
    many = np.where(sizes > 0, 1 + np.maximum(-(-(sizes - WINDOW) // STRIDE), 0), 0)
    of = np.repeat(np.arange(len(sizes)), many)
    begin = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return np.stack([offsets[:-1][of] + begin, np.minimum(WINDOW, sizes[of] - begin)], 1), of


@dataclass
class ToxicModel:
    base: bytes
    ordinary: bytes
    toxic: bytes
    thresholds: tuple[int, ...] = FIXED
    weights: np.ndarray | None = None

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def _compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        if self._ready is None:
            self._ready = self._compressor(self.ordinary), self._compressor(self.toxic)
        return self._ready

    def _compressor(self, trained: bytes) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=19, chain_log=16, hash_log=16, search_log=3, min_match=4, target_length=16,
            strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        # The trained part stands first, where its strings are no nearer, and so no cheaper, than those of the common text.
        held = zstandard.ZstdCompressionDict(trained + self.base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=how)

    def differences(self, raw: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """How many bytes less each window (begin, length) takes with the toxic dictionary."""
        out = np.zeros(len(parts), np.int64)
        for a in range(0, len(parts), CALL):
            some = parts[a : a + CALL]
            low, high = int(some[0, 0]), int(some[-1].sum())
            data = zstandard.BufferWithSegments(_PLAIN[raw[low:high]].tobytes(), (some - [low, 0]).astype(np.uint64).tobytes())
            plain, toxic = (c.multi_compress_to_buffer(data) for c in self._compressors())
            out[a : a + CALL] = [len(plain[i]) - len(toxic[i]) for i in range(len(some))]
        return out

    def evidence(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Per text and threshold: how many windows pass it, up to MOST."""
        parts, of = windows(offsets)
        return self._counts(self.differences(raw, parts), of, len(offsets) - 1)

    def _counts(self, differences: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        return np.column_stack([np.minimum(np.bincount(of[differences >= x], minlength=n), MOST) for x in self.thresholds])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = _features(evidence) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(evidence: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(evidence)), evidence])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(texts: list[bytes], toxic: list[int], share: dict[int, float]) -> ToxicModel | None:
    """share: the part of each class that is in the sample, so that scores are right for all documents."""
    texts = [_lower(t) for t in texts]
    y = np.array(toxic)
    if not 0 < y.sum() < len(y):
        return None
    fit = np.arange(len(y)) % 3 != 2
    by = [list(dict.fromkeys(t for t, k, f in zip(texts, toxic, fit, strict=True) if f and k == kind)) for kind in (0, 1)]
    counts = [text_counts(x) for x in by]
    trained = [train_dictionary(own_passages(by[k], counts[k], counts[1 - k])) for k in (0, 1)]
    base, size = [], 0
    for t in by[0]:  # parts of many texts rather than a few whole ones
        base.append(even_parts(t, 2 * PART + 1))
        size += len(base[-1])
        if size > BASE_BYTES:
            break
    model = ToxicModel(b" ".join(base)[:BASE_BYTES], *trained)
    held = np.flatnonzero(~fit)
    parts = [texts[i] for i in held]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in parts], dtype=np.int64)])
    spans, of = windows(offsets)
    differences = model.differences(np.frombuffer(b"".join(parts), np.uint8), spans)
    ordinary = differences[y[held][of] == 0]
    passed = [int(np.quantile(ordinary, q)) + 1 for q in (0.99, 0.999, 0.9999)] if len(ordinary) else []
    model.thresholds = tuple(sorted({*FIXED, *(x for x in passed if x > 0)}))
    evidence = model._counts(differences, of, len(held))
    model.weights = _logistic(_features(evidence), y[held], np.array([1 / share[k] for k in y[held]]))
    return model


def learnable(doc_id: str = "doc_id"):
    """Rows whose crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def text_bounds(sizes: dict[int, list[int]], most: int | None = None) -> dict[int, int]:
    """Bytes up to which texts of each class are taken whole, so that all stay within `most`; a class leaves what it doesn't need."""
    left, out = MAX_BYTES if most is None else most, {}
    for i, k in enumerate(sorted(sizes, key=lambda k: sum(sizes[k]))):
        room, n = left // (len(sizes) - i), len(sizes[k])
        out[k] = max(sizes[k], default=0)
        for size in sorted(sizes[k]):
            if size * n > room:
                out[k] = room // n
                break
            room, n = room - size, n - 1
        left -= sum(min(x, out[k]) for x in sizes[k])
    return out


def even_parts(text: bytes, most: int) -> bytes:
    """The text, or parts of PART bytes drawn evenly from all of it that have `most` bytes at most together."""
    if len(text) <= most:
        return text
    n = max(1, (most + 1) // (PART + 1))
    size = min(PART, most)
    return b" ".join(text[a : a + size] for a in (np.arange(n) * (len(text) - size) // max(1, n - 1)).tolist())


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel | None:
    """Learn from a bounded sample of the labelled texts; which ones depends on a hash of the id."""
    known = labels.where("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.where(learnable())
    bound_batches(docs.sparkSession)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, most / max(1, counts.get(k, 0))) for k, most in ((0, MAX_ORDINARY), (1, MAX_TOXIC))}
    draw = F.xxhash64("doc_id", F.lit(7))
    picked = known.where(draw <= F.when(F.col("toxic") == 1, F.lit(hash_below(share[1]))).otherwise(F.lit(hash_below(share[0]))))
    picked = picked.orderBy(F.xxhash64("doc_id")).limit(2 * (MAX_TOXIC + MAX_ORDINARY))
    sample = F.broadcast(picked).join(docs.where("text IS NOT NULL").select("doc_id", "text"), "doc_id")
    sizes = defaultdict(list)
    for row in sample.select("toxic", F.octet_length("text").alias("n")).collect():
        sizes[row["toxic"]].append(row["n"])
    bound = text_bounds(sizes)
    texts, toxic = [], []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [even_parts((t or "").encode(), bound[k]) for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), batch.column(1), batch.column(2)], names=["text", "toxic", "doc"])

    cut = sample.select("text", "toxic", F.xxhash64("doc_id").alias("doc"))
    cut = cut.mapInArrow(run, "text binary, toxic int, doc long").orderBy("doc", "text", "toxic")
    for row in cut.select("text", "toxic").toLocalIterator():
        texts.append(bytes(row["text"]))
        toxic.append(row["toxic"])
    return train(texts, toxic, share)


def score_toxicity(docs: DataFrame, model: ToxicModel | None) -> DataFrame:
    """docs (with text) with score; a column of that name is replaced."""
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "score"]
    docs = docs.select(*kept)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if held.value is not None:
                offsets, raw = utf8(batch.column(at))
                for a, b in groups(offsets):
                    score[a:b] = held.value.score(held.value.evidence(offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*kept, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    held_out = F.coalesce(~learnable(), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
