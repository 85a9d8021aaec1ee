"""Token counts of a unigram tokenizer by dynamic programming over a trie of pre-tokens.

A task collects the distinct pre-tokens of its texts, walks their trie depth first (sorted order, going back to the
shared prefix), and computes the best segmentation's score and length once for each trie node; the length at a
pre-token's last node is its token count. Texts then sum the counts of their pre-tokens; nothing is shuffled.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, find_words, hash_spans, small_batches, text_slices

#: A public piece vocabulary; another path may be given.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MOST_PIECES = 1_000_000
#: Distinct pre-tokens that a task remembers.
REMEMBERED = 1_000_000
MARK, UNKNOWN = "▁", 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Log probability of each piece; a character that is no piece costs `unknown` and counts as its UTF-8 bytes."""

    scores: dict[str, float]
    longest: int
    unknown: float


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """The normal pieces of a sentencepiece model, with Zipf log probabilities by their order.

    The public file has merge ranks only and no tokenizer is trained here, so these scores stand in for those of a fitted
    unigram model: counts compare texts with each other and with budgets, they are not those of the file's own encoder.
    A vocabulary with fitted scores can be given to `token_counts` instead.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [p.id_to_piece(i) for i in range(p.vocab_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) and p.get_score(i) > -1e8]
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"{len(pieces)} pieces; at most {MOST_PIECES} are broadcast")
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    scores = {x: -math.log(r + 1) - total for r, x in enumerate(pieces)}
    return Vocabulary(scores, max(map(len, pieces)), min(scores.values()) - UNKNOWN)


def count_tokens(words: list[str], vocabulary: Vocabulary) -> list[int]:
    """Tokens of each word's best segmentation, words in ascending order: nodes of shared prefixes are computed once.

    Of equally good segmentations that whose last piece is the longest is taken, at every node.
    """
    scores, longest, unknown = vocabulary.scores, vocabulary.longest, vocabulary.unknown
    get, lone = scores.get, [len(c.encode("utf-8", "replace")) for c in map(chr, range(128))]
    best, size, before, out = [0.0], [0], "", []
    for word in words:
        shared = len(os.path.commonprefix((before, word)))
        del best[shared + 1 :], size[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, n = -math.inf, 0
            for start in range(max(0, end - longest), end):
                s = get(word[start:end])
                if s is not None and best[start] + s > top:
                    top, n = best[start] + s, size[start] + 1
            if word[end - 1] not in scores and best[end - 1] + unknown > top:
                c = word[end - 1]
                top, n = best[end - 1] + unknown, size[end - 1] + (lone[ord(c)] if c < "\x80" else len(c.encode("utf-8", "replace")))
            best.append(top), size.append(n)
        out.append(size[len(word)])
        before = word
    return out


def _count_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    vocabulary = shared.value
    known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        n_words, n_tokens = [], []
        for a, b, data, offsets in text_slices(batch.column(1), 4 << 20):
            starts, ends, text = find_words(data, offsets, SPACED)
            keys, first, at = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
            new = np.flatnonzero(~np.isin(keys, known, assume_unique=True))
            if len(new):
                if len(known) + len(new) > REMEMBERED:
                    known, counts, new = known[:0], counts[:0], np.arange(len(keys))
                raw = data.tobytes()
                words = [MARK + raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
                order = sorted(range(len(words)), key=words.__getitem__)
                got = np.empty(len(words), np.int64)
                got[order] = count_tokens([words[i] for i in order], vocabulary)
                known, counts = np.concatenate([known, keys[new]]), np.concatenate([counts, got])
                by = np.argsort(known)
                known, counts = known[by], counts[by]
            each = counts[np.searchsorted(known, keys)][at] if len(keys) else np.zeros(0, np.int64)
            n_words.append(np.bincount(text, minlength=b - a))
            n_tokens.append(np.bincount(text, each, b - a).astype(np.int64))
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n_words, n_tokens)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=["_id", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words (pre-tokens), n_tokens of the whole text.

    Pre-tokens are words [^\\x20\\x09-\\x0D]+ with the word mark before them. Null and empty texts have none, empty tables
    give no rows. Rows are counted one by one: repeats, null ids and other columns do not matter. About 4 MB of texts are
    read at a time, or one longer text alone; a word's time grows with its length times that of the longest piece. A word
    met again is told by 64 bits of hash.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())  # at most MOST_PIECES pieces
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    return rows.mapInArrow(lambda b: _count_batches(b, shared), f"_id {kind}, n_words long, n_tokens long").withColumnRenamed("_id", id_col)
