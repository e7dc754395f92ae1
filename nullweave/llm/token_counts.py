"""Token counts of a unigram tokenizer.

Method: trie-shared dynamic programming.  The distinct pre-tokens of a block are
inserted into a trie of bytes (walked in sorted order, the path kept as a
stack); the unigram forward score of a node, the best sum of piece scores that
spells its prefix, is computed once for all pre-tokens below it, and each
terminal stores its token count.  A document's count is the sum over its
pre-tokens.

Scores: a piece of rank r of the public byte-level vocabulary has the score
-log((r + 1) * H), H = sum of 1 / (r + 1): Zipf's law over the ranks.  Among
equal scores the segmentation with fewer pieces counts, so counts are unique.

Defined cases: a null or empty text has no pre-tokens and no tokens; every row
gives one row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import os

import numpy as np
from pyspark.sql import DataFrame

from .bpe import load_ranks
from .common import blocks, plain, trimmed
from .pretokens import Indexer, Splitter


def piece_scores(path: str) -> dict[bytes, float]:
    ranks = load_ranks(path)
    h = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - h for piece, r in ranks.items()}


def trie_counts(words: list[bytes], scores: dict[bytes, float]) -> dict[bytes, tuple[float, int]]:
    """(forward score, tokens) of each distinct word; a shared prefix is scored once."""
    longest, out = max(map(len, scores)), {}
    best, count = [0.0], [0]
    last = b""
    for word in sorted(words):
        keep = len(os.path.commonprefix((last, word)))
        del best[keep + 1 :], count[keep + 1 :]
        for end in range(keep + 1, len(word) + 1):
            top, n = -math.inf, 0
            for start in range(max(0, end - longest), end):
                piece = scores.get(word[start:end])
                if piece is not None:
                    s = best[start] + piece
                    if s > top or s == top and count[start] + 1 < n:
                        top, n = s, count[start] + 1
            best.append(top)
            count.append(n)
        out[word] = (best[-1], count[-1])
        last = word
    return out


def token_counts(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score (sum of the best segmentations' scores) of every whole text."""

    def run(batches):
        import pyarrow as pa

        index, scores = Indexer(Splitter(pattern)), piece_scores(path)
        known: list[np.ndarray] = [np.zeros((0, 2))]
        for part in blocks(batches):
            reset, new, flat, lengths = index.block(part.column("text").to_pylist())
            if reset:
                known = [np.zeros((0, 2))]
            raw = [w.encode("utf-8", "surrogatepass") for w in new]
            got = trie_counts(raw, scores)
            known = [np.concatenate([known[0], np.array([got[w] for w in raw]).reshape(-1, 2)])]
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            sums = np.concatenate([np.zeros((1, 2)), np.cumsum(known[0][flat], axis=0)])
            tokens = sums[cuts[1:], 1] - sums[cuts[:-1], 1]
            score = [math.fsum(known[0][flat[a:b], 0].tolist()) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(lengths), pa.array(tokens.astype(np.int64)), pa.array(score, pa.float64())],
                ["doc_id", "n_pretokens", "n_tokens", "score"],
            )

    return plain(documents, doc_id="doc_id", text="text").mapInArrow(trimmed(run), "doc_id bigint, n_pretokens bigint, n_tokens bigint, score double")
