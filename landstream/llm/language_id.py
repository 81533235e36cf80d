"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

Features are hashed byte trigrams of the whole lower-cased text, as shares of all its trigrams. A family is told by linear
machines, one for each family against the others; within the family, one machine for each pair of languages votes. All machines are
tables of one weight a feature, so a text's margins are means of looked-up weights.

Learning takes a bounded sample: SAMPLE documents, shared equally by the languages, but LEAST_EACH of each language at least,
drawn by a hash of doc_id. All languages are learned.

Cases: a text that is null or has no letter is `und` with score 0; if nothing can be learned from, every text is `und`; a null
doc_id is predicted but not learned from; rows with a null lang are not learned from; an empty table gives an empty result. Input
columns named lang_pred or score are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, hash_below, table
from .textkit import groups, utf8

#: The family of languages by ISO 639-1 code. A language that isn't listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "tr": "turkic", "az": "turkic", "hi": "indic", "bn": "indic", "ar": "semitic", "he": "semitic",
}
FEATURES = 1 << 12
SAMPLE = 3000
#: Documents that the sample has of each language (or all it has), however many languages there are.
LEAST_EACH = 30
UNKNOWN = "und"
#: Shares are small: in training they are multiplied by SCALE, and the constant feature, whose weight is the bias, is ONE.
SCALE, ONE = 10, 0.05

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint32)


def _trigrams(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature of the trigram that ends at each byte, and whether it counts: inside one text and not just spaces."""
    x = _FOLD[raw]
    code = np.zeros(len(raw), np.uint32)
    code[2:] = (x[2:] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[:-2]
    feature = (code * np.uint32(0x9E3779B1)) >> np.uint32(20)
    use = np.ones(len(raw), bool)
    use[1:] = (x[1:] != 32) | (x[:-1] != 32)
    for k in (0, 1):
        at = offsets[:-1] + k
        use[at[(at < len(raw)) & (at < offsets[1:])]] = False
    return feature, use


def features(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Shares of each feature, a row for each text."""
    offsets, raw = utf8(texts)
    out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    for a, b in groups(offsets):
        piece = raw[offsets[a] : offsets[b]]
        feature, use = _trigrams(offsets[a : b + 1] - offsets[a], piece)
        for i in range(a, b):
            s = slice(offsets[i] - offsets[a], offsets[i + 1] - offsets[a])
            counts = np.bincount(feature[s][use[s]], minlength=FEATURES)
            out[i] = counts / max(1, counts.sum())
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, rounds: int = 30, c: float = 1.0, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights of all columns, and bias, of the L2-regularised hinge loss by dual coordinate descent; y is -1 or 1, the last column of x is ONE."""
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    norm = np.einsum("ij,ij->i", x, x) + 1e-12
    # Both sides weigh the same.
    most = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] + (1 - y[i] * (x[i] @ w)) / norm[i], 0.0), most[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w, float(w[-1] * ONE)


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[str]
    weights: np.ndarray  # features by machines: those of the families, then those of the pairs
    bias: np.ndarray
    steep: np.ndarray
    pairs: list[tuple[int, int]] = field(default_factory=list)

    def margins(self, texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
        offsets, raw = utf8(texts)
        out = np.zeros((len(offsets) - 1, len(self.bias)))
        for a, b in groups(offsets):
            piece, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            feature, use = _trigrams(at, piece)
            n = np.concatenate([[0], np.cumsum(use)])
            hits = feature[use]
            count = np.maximum(1, n[at[1:]] - n[at[:-1]])
            for k in range(len(self.bias)):
                sums = np.concatenate([[0], np.cumsum(self.weights[:, k][hits], dtype=np.float64)])
                out[a:b, k] = (sums[n[at[1:]]] - sums[n[at[:-1]]]) / count
        return (out + self.bias) * self.steep

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sure = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
        nf = len(self.families)
        family = margins[:, :nf].argmax(1)
        of = np.array([self.families.index(FAMILIES.get(x, x)) for x in self.languages])
        votes = np.zeros((len(margins), len(self.languages)))
        lean = np.ones_like(votes)
        for k, (i, j) in enumerate(self.pairs, nf):
            votes[:, i] += sure[:, k]
            votes[:, j] += 1 - sure[:, k]
            lean[:, i] = np.minimum(lean[:, i], sure[:, k])
            lean[:, j] = np.minimum(lean[:, j], 1 - sure[:, k])
        votes[of[None, :] != family[:, None]] = -1
        best = votes.argmax(1)
        rows = np.arange(len(margins))
        return best, sure[rows, family] * lean[rows, best]


def train(shares: np.ndarray, lang: np.ndarray) -> LanguageModel | None:
    """The machines; the sample is held once as it is given and once in single precision, as the driver has little memory."""
    languages = sorted(set(lang.tolist()))
    if not languages:
        return None
    families = sorted({FAMILIES.get(x, x) for x in languages})
    of = np.array([FAMILIES.get(v, v) for v in lang])
    x = np.empty((len(shares), shares.shape[1] + 1), np.float32)
    x[:, :-1], x[:, -1] = shares, ONE
    x[:, :-1] *= SCALE
    machines, pairs = [], []
    for f in families:
        machines.append(linear_svm(x, np.where(of == f, 1.0, -1.0)) if len(families) > 1 else (np.zeros(x.shape[1]), 1.0))
    for i, j in combinations(range(len(languages)), 2):
        if FAMILIES.get(languages[i], languages[i]) == FAMILIES.get(languages[j], languages[j]):
            m = (lang == languages[i]) | (lang == languages[j])
            machines.append(linear_svm(x[m], np.where(lang[m] == languages[i], 1.0, -1.0)))
            pairs.append((i, j))
    weights, bias = np.column_stack([w for w, _ in machines])[:-1], np.array([b for _, b in machines])
    margins = np.concatenate([np.abs(x[at : at + 256, :-1] @ weights + bias) for at in range(0, len(x), 256)])
    return LanguageModel(languages, families, (weights * SCALE).astype(np.float32), bias, 4 / np.maximum(np.median(margins, axis=0), 1e-9), pairs)


def learnable(doc_id: str = "doc_id"):
    """Rows whose crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def sampling(counts: list, sample: int = SAMPLE) -> list[tuple[str, int]]:
    """(lang, n) of each language -> lang and the largest 64-bit hash that is drawn: the same number of documents of each."""
    share = max(sample / len(counts), LEAST_EACH)
    return [(lang, hash_below(min(1.0, share / n))) for lang, n in counts]


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    bound_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable()).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return None
    most = docs.sparkSession.createDataFrame(sampling(counts, sample), "lang string, __most long")
    draw = F.xxhash64("doc_id", F.lit(4))
    picked = known.join(F.broadcast(most), "lang").where(draw <= F.col("__most")).limit(2 * max(sample, LEAST_EACH * len(counts)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                x = features(pa.array(part["text"], pa.string())).astype(np.float16)
                yield pd.DataFrame({"lang": part["lang"].to_numpy(), "doc_id": part["doc_id"].to_numpy(), "x": [r.tobytes() for r in x]})

    rows = picked.mapInPandas(run, "lang string, doc_id long, x binary").toPandas().sort_values(["doc_id", "x"])
    if rows.empty:
        return None
    lang, shares = rows["lang"].to_numpy(), np.frombuffer(b"".join(rows.pop("x")), np.float16).reshape(-1, FEATURES)
    return train(shares, lang)


def identify_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs (with text) with lang_pred and score. Nothing is shuffled."""
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "__letter")]
    at = kept.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*kept, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            letter = batch.column(len(kept)).to_numpy(zero_copy_only=False)
            if model is None:
                lang, score = np.full(len(letter), UNKNOWN, object), np.zeros(len(letter))
            else:
                best, score = model.predict(model.margins(batch.column(at)))
                lang = np.where(letter, np.array(model.languages, object)[best], UNKNOWN)
                score = np.where(letter, score, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return source.mapInArrow(run, docs.select(*kept).schema.add("lang_pred", "string").add("score", "double"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "lang_pred", "score")
