"""Token counts under a unigram vocabulary, by dynamic programming that words share in a trie.

A pre-token is the word mark followed by a word. Its tokens are the pieces of the segmentation with the largest sum of piece
scores; bytes that no piece covers cost UNKNOWN each and count one token each, like a byte fallback. Of segmentations with equal
sums, the one with fewer tokens counts. Scores are the vocabulary file's. The public file that the query takes is of a model
that merges pairs, and its scores are ranks of merges: the counts are those of the segmentation with the best sum of these, and
not what that model's own encoder gives.

Each task handles a group of texts at once: its distinct new words become a trie, built depth by depth, in which a node is a
distinct prefix; the best score and count of a prefix are computed once, from its ancestors, for all words that begin with it. The
counts of the nodes where words end are stored for all the task's further texts (MAX_WORDS of them). The texts' counts are sums of
those. A group is bounded in bytes, so the trie is; nothing is shuffled, and a word that is in all texts costs each task one path.

Cases: a null, empty or blank text has 0 tokens; a word of any length is one path; repeated rows are counted each for itself; an
empty table gives an empty result; other columns pass through, and an input column n_tokens is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bound_batches, table
from .textkit import groups, mix, prefix_hash, range_hash, utf8, words

#: Vocabulary of a public tokenizer; its path is a parameter.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
#: Score of a byte that no piece covers: below every piece of the vocabulary.
UNKNOWN = -100_000.0
GROUP_BYTES = 8 << 20
#: The vocabulary is broadcast; this bounds it.
MAX_PIECES = 2_000_000
#: Distinct words whose counts a task keeps.
MAX_WORDS = 2_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, float]:
    """Normal pieces of a sentencepiece model and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return {model.id_to_piece(i).encode(): model.get_score(i) for i in range(model.get_piece_size()) if not skip(i)}


class PieceTable:
    """Pieces as hashes of their bytes, with a filter of their last four bytes and length before the search."""

    def __init__(self, pieces: dict[bytes, float]):
        if len(pieces) > MAX_PIECES:
            raise ValueError(f"{len(pieces)} pieces; at most {MAX_PIECES} are broadcast")
        self.longest = max((len(p) for p in pieces), default=1)
        hashes = np.array([_hash_of(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array(list(pieces.values()))[order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        self.lengths = sorted({len(p) for p in pieces})

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are pieces, and the scores of those."""
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[maybe]
        return maybe[hit], self.scores[at[hit]]

    def terminal_counts(self, starts: np.ndarray, sizes: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Tokens of each of the distinct byte strings raw[start : start + size]."""
        mark = len(MARK)
        node = np.zeros(len(starts), np.int64)  # of each word, at the depth reached
        counts = np.zeros(len(starts), np.int64)
        # Per depth, of its nodes: prefix hash, best score, tokens, and the node above.
        prefix, best, tokens, above = [np.zeros(1, np.uint64)], [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        alive = np.arange(len(starts))
        powers = [np.uint64(pow(int(_STEP), k, 1 << 64)) for k in range(self.longest + 1)]
        depth = 0
        while len(alive):
            if depth < mark:
                byte = np.full(len(alive), MARK[depth], np.uint64)
            else:
                byte = raw[starts[alive] + depth - mark].astype(np.uint64)
            child, name, node_of = np.unique((node[alive].astype(np.uint64) << np.uint64(8)) | byte, return_index=True, return_inverse=True)
            node[alive] = node_of
            up = (child >> np.uint64(8)).astype(np.int64)
            depth += 1
            prefix.append(prefix[-1][up] * _STEP + byte[name] + np.uint64(1))
            above.append(up)
            score, many = best[-1][up] + UNKNOWN, tokens[-1][up] + 1
            ancestor = np.arange(len(child))
            for length in range(1, min(depth, self.longest) + 1):
                ancestor = above[depth - length + 1][ancestor]
                hashes = mix(prefix[-1] - prefix[depth - length][ancestor] * powers[length] + np.uint64(length))
                hit, value = self.find(hashes)
                total = best[depth - length][ancestor[hit]] + value
                n = tokens[depth - length][ancestor[hit]] + 1
                better = (total > score[hit]) | ((total == score[hit]) & (n < many[hit]))
                score[hit[better]], many[hit[better]] = total[better], n[better]
            best.append(score)
            tokens.append(many)
            if depth > self.longest:  # older depths are out of any piece's reach
                old = depth - self.longest - 1
                prefix[old] = best[old] = tokens[old] = above[old] = None
            ends = sizes[alive] + mark == depth
            counts[alive[ends]] = many[node[alive[ends]]]
            alive = alive[~ends]
        return counts


def _hash_of(piece: bytes) -> int:
    h = np.uint64(0)
    for b in piece:
        h = np.uint64((int(h) * int(_STEP) + b + 1) & 0xFFFFFFFFFFFFFFFF)
    return int(mix(np.array([(int(h) + len(piece)) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


class KnownWords:
    """Terminal counts of the distinct words that a task has met, by hash; begun anew beyond MAX_WORDS."""

    def __init__(self):
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def counts_of(self, pieces: PieceTable, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Tokens of distinct words, in order of their hashes; only new ones go through the trie."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        old = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        out = np.zeros(len(hashes), np.int64)
        out[old] = self.counts[at[old]]
        new = ~old
        if new.any():
            out[new] = pieces.terminal_counts(starts[new], sizes[new], raw)
            if len(self.hashes) + int(new.sum()) > MAX_WORDS:
                self.hashes, self.counts = hashes, out
            else:
                place = np.searchsorted(self.hashes, hashes[new])
                self.hashes, self.counts = np.insert(self.hashes, place, hashes[new]), np.insert(self.counts, place, out[new])
        return out


def count_group(pieces: PieceTable, offsets: np.ndarray, raw: np.ndarray, known: KnownWords | None = None) -> np.ndarray:
    """Tokens of each text of a group."""
    start, end, doc = words(offsets, raw)
    if not len(start):
        return np.zeros(len(offsets) - 1, np.int64)
    hashes, first, which = np.unique(range_hash(prefix_hash(raw), start, end), return_index=True, return_inverse=True)
    counts = (known or KnownWords()).counts_of(pieces, hashes, start[first], (end - start)[first], raw)
    return np.bincount(doc, weights=counts[which], minlength=len(offsets) - 1).astype(np.int64)


def count_tokens(docs: DataFrame, vocabulary: dict[bytes, float]) -> DataFrame:
    """docs (with text) with n_tokens."""
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "n_tokens"]
    docs = docs.select(*kept)
    at = kept.index("text")
    held = docs.sparkSession.sparkContext.broadcast(PieceTable(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KnownWords()
        for batch in batches:
            offsets, raw = utf8(batch.column(at))
            counts = np.zeros(batch.num_rows, np.int64)
            for a, b in groups(offsets, GROUP_BYTES):
                counts[a:b] = count_group(held.value, offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]], known)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], names=[*kept, "n_tokens"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("n_tokens", LongType())]))


def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, read_vocabulary(vocabulary)).select("doc_id", F.col("n_tokens"))
