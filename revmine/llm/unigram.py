"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of all documents (``wordtable``) go, sorted, into a trie of bytes. A node's forward
score is the best log probability of any segmentation of its prefix into pieces; it depends on the prefix
alone, so it is computed once for all words that share it. A terminal node's token count is stored for its
word and goes back to the batches by position.

The unigram model is the vocabulary itself: piece k in order of rank has probability in proportion to
1 / (k + 1). Log probabilities are rounded to millionths and summed as integers, so sums are exact in any
order and ties are true ties; they go to the segmentation with fewer tokens. All bytes are pieces, so that
every text has a segmentation. Added tokens count as one.

Defined cases: null or empty text has 0 tokens and score 0; repeated rows give one result each; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common, wordtable

#: Nodes of a trie before it is started anew; words come sorted, so little sharing is lost.
TRIE_NODES = 1_500_000
#: Decimal digits of a piece's log probability.
DIGITS = 6
UNIT = 10**DIGITS


def scores(vocabulary: str) -> dict[bytes, float]:
    ranked = sorted(bpe.pieces(vocabulary).items())
    total = math.log(sum(1 / (k + 1) for k in range(len(ranked))))
    return {piece: round(-math.log(k + 1) - total, DIGITS) for k, (_, piece) in enumerate(ranked)}


class Trie:
    """Words in a trie of bytes; score (in 1 / UNIT) and count of the best segmentation at every node."""

    def __init__(self, piece_scores: dict[bytes, float], added: list[bytes]):
        self.of, self.added = {piece: round(s * UNIT) for piece, s in piece_scores.items()}, set(added)
        self.longest = [0] * 256
        for piece in piece_scores:
            self.longest[piece[-1]] = max(self.longest[piece[-1]], len(piece))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = [0], [0]

    def add(self, word: bytes) -> tuple[int, int]:
        if word in self.added:
            return self.of[word], 1
        if len(self.score) > TRIE_NODES:
            self.clear()
        node, path, child, of, score, count = 0, [0], self.child, self.of, self.score, self.count
        for d, byte in enumerate(word, 1):
            key = node << 8 | byte
            node = child.get(key, 0)
            if not node:
                best, fewest = None, 0
                for a in range(max(0, d - self.longest[byte]), d):
                    piece = of.get(word[a:d])
                    if piece is not None:
                        s, n = score[path[a]] + piece, count[path[a]] + 1
                        if best is None or s > best or (s == best and n < fewest):
                            best, fewest = s, n
                node = child[key] = len(score)
                score.append(best)
                count.append(fewest)
            path.append(node)
        return score[node], count[node]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, batch_chars: int = wordtable.BATCH_CHARS) -> DataFrame:
    """Per row of docs: doc_id, n_words (pre-tokens), n_tokens, score (natural log of the best segmentation)."""
    spark, vocabulary = docs.sparkSession, bpe.vocabulary_text(vocabulary_path)
    folder, shipped, added = common.shared_folder(spark, "unigram"), spark.sparkContext.broadcast(vocabulary), bpe.added_tokens(vocabulary)
    slim = docs.select(common.id_of(docs, id_col).alias("id"), common.text_of(docs, text_col).alias("text"), F.lit(False).alias("flag"))

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, value = Trie(scores(shipped.value), [x.encode() for x in added]), None, (0, 0)

        def found() -> Iterator[tuple[np.ndarray, ...]]:
            nonlocal last, value
            for rows in batches:
                coded = rows.column("word").fill_null("").dictionary_encode()
                values = []
                for word in coded.dictionary.to_pylist():
                    if word != last:
                        last, value = word, trie.add(word.encode())
                    values.append(value)
                table = np.array(values, np.int64).reshape(-1, 2)[coded.indices.to_numpy()]
                yield rows.column("batch").to_numpy(), rows.column("pos").to_numpy(), table[:, 1], table[:, 0]

        yield from wordtable.parcels(found())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in common.runs(batches, "batch"):
            whole = wordtable.unpack(common.read_bytes(wordtable.batch_file(folder, batch)))
            n, score = (wordtable.sums(whole, x.astype(np.float64)[whole.words]) for x in wordtable.opened(rows.column("data")))
            out = pa.RecordBatch.from_arrays([whole.ids, pa.array(whole.sizes), pa.array(n.astype(np.int64)), pa.array(score / UNIT)], [id_col, "n_words", "n_tokens", "score"])
            yield from common.in_parts(out, 20_000)

    words = wordtable.split_batches(slim, lambda: bpe.splitter(added), folder, batch_chars).select("batch", "pos", "word")
    counted = words.repartition("word").sortWithinPartitions("word").mapInArrow(insert, "batch long, data binary")
    return wordtable.by_batch(counted).mapInArrow(gather, f"`{id_col}` {common.id_kind(docs, id_col)}, n_words long, n_tokens long, score double")
