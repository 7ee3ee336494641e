"""BPE encoding and decoding over a table of distinct words.

Documents become batch dictionaries of pre-tokens (``wordtable``). The distinct words of all batches meet
in one sorted table, where each is encoded once by the tokenizers library; its ids go back to the batches
by position. Decoding joins the distinct ids of each batch with the table of id and piece (bounded by the
vocabulary, so broadcast) and puts the pieces' bytes together.

Why words can stand alone: the byte-level pre-tokenizer cuts before merging, never merges across cuts, and
cuts a word that stands alone the same way. Added tokens (here <|endoftext|>) are cut out of the text first
and are words of their own.

Defined cases: null text is an empty text (no ids, decodes to ""); repeated rows and ids give one result
a row; a null id stays null; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordtable

_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
#: The byte-level pre-tokenizer's pattern, spelled out for texts up to U+024F, and in full.
_LATIN = f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_FULL = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Characters on whose kinds all Unicode versions agree; a text with others is cut by the library itself.
_SURE = r"\x00-\u024f\u0388-\u038a\u038c\u038e-\u03a1\u03a3-\u0481\u2010-\u2027\u2030-\u205e\u20ac\u3000-\u3003\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_text(path: str | None) -> str:
    with open(path or default_vocabulary(), encoding="utf-8") as file:
        return file.read()


def splitter(added: list[str]) -> Callable[[str], list[str]]:
    """text -> pre-tokens, in order and without loss."""
    from tokenizers.pre_tokenizers import ByteLevel

    beyond, latin, full = re.compile("[^\x00-ɏ]").search, re.compile(_LATIN).findall, regex.compile(_FULL).findall
    unsure, library = re.compile(f"[^{_SURE}]").search, ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    whole = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None

    def plain(text: str) -> list[str]:
        if not beyond(text):
            return latin(text)
        return [text[a:b] for _, (a, b) in library(text)] if unsure(text) else full(text)

    def cut(text: str) -> list[str]:
        if whole is None or not any(x in text for x in added):
            return plain(text)
        return [w for k, part in enumerate(whole(text)) for w in ([part] if k % 2 else plain(part))]

    return cut


def added_tokens(vocabulary: str) -> list[str]:
    return [x["content"] for x in json.loads(vocabulary)["added_tokens"]]


def checked(vocabulary: str) -> None:
    """Words stand alone only under a byte-level pre-tokenizer that cuts by its pattern, without a normalizer or a prefix space."""
    data = json.loads(vocabulary)
    cut = data.get("pre_tokenizer") or {}
    if data.get("normalizer") or data["model"].get("type", "BPE") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError("the vocabulary must be a byte-level BPE without a normalizer or a prefix space")


def tokenizer(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    checked(vocabulary)
    made = Tokenizer.from_str(vocabulary)
    made.no_truncation()
    made.no_padding()
    return made


class WordEncoder:
    """Ids of pre-tokens, many at once: (starts, counts, values); word k has values[starts[k] : starts[k] + counts[k]].

    Words that begin with one space are put after each other into texts of JOINED words, which the pre-tokenizer cuts
    exactly where they meet; how many bytes each id stands for tells whose it is. Other words are encoded alone.
    """

    JOINED = 256

    def __init__(self, vocabulary: str):
        self.encode, known = tokenizer(vocabulary).encode_batch_fast, pieces(vocabulary)
        self.bytes_of = np.zeros(max(known) + 1, np.int64)
        self.bytes_of[list(known)] = [len(x) for x in known.values()]

    def _flat(self, texts: list[str]) -> tuple[list[int], np.ndarray]:
        found = [x.ids for x in self.encode(texts, add_special_tokens=False)]
        return [len(x) for x in found], np.fromiter(chain.from_iterable(found), np.int32)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        easy = np.fromiter((x[:1] == " " and x[1:2].strip() != "" for x in words), bool, len(words))
        counts, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        together = [words[k] for k in np.flatnonzero(easy).tolist()]
        values = self._flat(["".join(together[a : a + self.JOINED]) for a in range(0, len(together), self.JOINED)])[1]
        ends = np.cumsum(pc.binary_length(pa.array(together, pa.string())).to_numpy(), dtype=np.int64)
        after = np.cumsum(self.bytes_of[values])
        last = np.searchsorted(after, ends)
        if len(after) != (last[-1] + 1 if len(last) else 0) or (after[last] != ends).any():
            raise ValueError("the vocabulary's pieces do not add up to the text: it is no plain byte-level one")
        counts[easy] = np.diff(last, prepend=-1)
        starts[easy] = last + 1 - counts[easy]
        sizes, more = self._flat([words[k] for k in np.flatnonzero(~easy).tolist()])
        counts[~easy] = sizes
        starts[~easy] = len(values) + np.cumsum(sizes, dtype=np.int64) - sizes
        return starts, counts, np.concatenate([values, more])


def gathered(starts: np.ndarray, counts: np.ndarray, values: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sequence of word numbers, one word after the other, and where each word's end."""
    n = counts[words]
    ends = np.cumsum(n)
    return values[np.repeat(starts[words] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], ends


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pieces(vocabulary: str) -> dict[int, bytes]:
    data, of = json.loads(vocabulary), _bytes_of()
    found = {i: bytes(of[c] for c in piece) for piece, i in data["model"]["vocab"].items()}
    return found | {x["id"]: x["content"].encode() for x in data["added_tokens"]}


def piece_table(spark: SparkSession, vocabulary: str) -> DataFrame:
    """(id, piece): as many rows as the vocabulary has."""
    return spark.createDataFrame(pa.table({"id": pa.array(list(ids := pieces(vocabulary)), pa.int32()), "piece": pa.array(list(ids.values()), pa.binary())}))


def word_ids(occurrences: DataFrame, vocabulary) -> DataFrame:
    """(batch, pos, word) -> (batch, pos, ids); rows are sorted by word, so each distinct word is encoded once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, last_ids = WordEncoder(vocabulary.value), None, np.zeros(0, np.int32)
        for rows in batches:
            coded = rows.column("word").fill_null("").dictionary_encode()
            words = coded.dictionary.to_pylist()
            known = bool(words) and words[0] == last
            starts, counts, values = encode(words[known:])
            if known:
                starts, counts, values = np.append(len(values), starts), np.append(len(last_ids), counts), np.concatenate([values, last_ids])
            if words:
                last, last_ids = words[-1], values[starts[-1] : starts[-1] + counts[-1]]
            ids, ends = gathered(starts, counts, values, coded.indices.to_numpy())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([rows.column("batch"), rows.column("pos"), lists], ["batch", "pos", "ids"])
        del encode
        common.give_back()

    return occurrences.select("batch", "pos", "word").repartition("word").sortWithinPartitions("word").mapInArrow(task, "batch long, pos int, ids array<int>")


def _documents(whole: wordtable.Numbered, offsets: np.ndarray, values: np.ndarray) -> Iterator[np.ndarray]:
    """The ids of each document of a batch; word w has values[offsets[w]:offsets[w + 1]]."""
    at, counts = 0, np.diff(offsets)
    for size in whole.sizes.tolist():
        yield gathered(offsets, counts, values, whole.words[at : at + size])[0]
        at += size


def _rows(ids: pa.Array, tokens: list[np.ndarray], texts: list[str], id_col: str) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
    flat = pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int32), pa.int32())
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(texts, pa.string())], [id_col, "ids", "decoded"])


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, batch_chars: int = wordtable.BATCH_CHARS) -> DataFrame:
    """Per row of docs: doc_id, ids (array<int>), decoded (the text that the ids give)."""
    spark, vocabulary = docs.sparkSession, vocabulary_text(vocabulary_path)
    folder, shipped, added = common.shared_folder(spark, "bpe"), spark.sparkContext.broadcast(vocabulary), added_tokens(vocabulary)
    slim = docs.select(common.id_of(docs, id_col).alias("id"), common.text_of(docs, text_col).alias("text"), F.lit(False).alias("flag"))
    words = common.written(word_ids(wordtable.split_batches(slim, lambda: splitter(added), folder, batch_chars), shipped), folder, "words")
    used = words.select("batch", F.explode("ids").alias("id")).distinct()
    decoded = used.join(F.broadcast(piece_table(spark, vocabulary)), "id")
    both = words.select("batch", F.lit(1).alias("kind"), "pos", "ids", F.lit(None).cast("binary").alias("piece")).unionByName(decoded.select("batch", F.lit(0).alias("kind"), F.col("id").alias("pos"), F.lit(None).cast("array<int>").alias("ids"), "piece"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in common.runs(batches, "batch"):
            whole = wordtable.unpack(common.read_bytes(wordtable.batch_file(folder, batch)))
            n = len(rows) - int(np.count_nonzero(rows.column("kind").to_numpy()))
            piece_of = dict(zip(rows.column("pos").slice(0, n).to_pylist(), rows.column("piece").slice(0, n).to_pylist())).__getitem__
            lists = pa.concat_arrays(rows.column("ids").slice(n).chunks)
            offsets, values = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))), lists.flatten().to_numpy()
            done, tokens, texts, held = 0, [], [], 0
            for found in _documents(whole, offsets, values):
                tokens.append(found)
                texts.append(b"".join(map(piece_of, found.tolist())).decode("utf-8", "replace"))
                held += len(found)
                if held > 500_000:
                    yield _rows(whole.ids[done : done + len(texts)], tokens, texts, id_col)
                    done, tokens, texts, held = done + len(texts), [], [], 0
            yield _rows(whole.ids[done:], tokens, texts, id_col)
            del whole, lists, offsets, values, tokens, texts, piece_of, rows
            common.give_back()

    return wordtable.by_batch(both, "kind", "pos").mapInArrow(task, f"`{id_col}` {common.id_kind(docs, id_col)}, ids array<int>, decoded string")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary_path: str | None = None, batch_ids: int = 8_000_000) -> DataFrame:
    """Per row of encoded: doc_id, decoded. Null ids count as none; an unknown id is left out, as the library does."""
    spark, vocabulary = encoded.sparkSession, vocabulary_text(vocabulary_path)
    folder = common.shared_folder(spark, "bpe-decode")
    slim = encoded.select(common.id_of(encoded, id_col).alias("id"), F.coalesce(common.quoted(ids_col).cast("array<string>"), F.array().cast("array<string>")).alias("ids"))
    joined = slim.select("id", F.concat_ws(" ", "ids").alias("text"), F.lit(False).alias("flag"))
    numbers = wordtable.split_batches(joined, lambda: str.split, folder, 4 * batch_ids)
    table = piece_table(spark, vocabulary).select(F.col("id").cast("string").alias("word"), "piece")
    values = numbers.join(F.broadcast(table), "word", "left").select("batch", "pos", "piece")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in common.runs(batches, "batch"):
            whole = wordtable.unpack(common.read_bytes(wordtable.batch_file(folder, batch)))
            piece_of = [x or b"" for x in rows.column("piece").to_pylist()].__getitem__
            at = 0
            for k, size in enumerate(whole.sizes.tolist()):
                text = b"".join(map(piece_of, whole.words[at : at + size].tolist())).decode("utf-8", "replace")
                at += size
                yield pa.RecordBatch.from_arrays([whole.ids[k : k + 1], pa.array([text], pa.string())], [id_col, "decoded"])

    return wordtable.by_batch(values, "pos").mapInArrow(task, f"`{id_col}` {common.id_kind(encoded, id_col)}, decoded string")


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
