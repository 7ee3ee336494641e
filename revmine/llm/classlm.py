"""Language-model scores from a Brown class-based bigram.

Every text is scored; training documents supply the counts. Words travel as batch dictionaries
(``wordtable``); a word's training count is summed over all batches. Every training word is clustered, into
a number of classes that grows with the vocabulary (``class_count``):

1. Seeds. Each of the most frequent words is a unit; all other words share units by their last bytes, for now. Exchange
   clustering moves one unit at a time to the class that gains most likelihood of the unit bigrams, until a
   pass moves none (or ``passes``). This settles the frequent words.
2. Rounds. Each other training word, however rare, goes to the class that gives its own bigrams, counted over
   all training documents, most likelihood (``votes``); all words of a round choose by the classes of the round
   before. Rounds go on while the likelihood of the class bigrams rises (or ``ROUNDS``).

Only a word that training never saw, which has no bigrams to go by, keeps the class of its last bytes' unit,
and only as context. Words are told apart by 64 bits of XXH64 once they are counted. Then

    p(w | before) = KNOWN * P(class(w) | class(before)) * c(w) / c(class(w)) + (1 - KNOWN) * base(w)

with base(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). A word without a count is one outcome, UNK, in both parts;
words counted once lend half of their count to it, and as context it stands for its unit's class. Both
parts sum to 1 over the vocabulary, the end token and UNK.

What reaches the driver is bounded by the model: units x units and classes x classes bigram counts. Counts
cover all training documents at every size; the bigrams of words stay in the tasks.

Defined cases: null or empty text is one end token; a text is scored whole, however long (a batch of its own); without training documents UNK has probability 1;
repeated rows count each and get equal scores; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, wordtable

#: Units of the seeds: the end token, the most frequent words, and one for each hash of the last TAIL bytes.
WORD_UNITS, TAIL_UNITS, TAIL = 767, 256, 3
UNITS = 1 + WORD_UNITS + TAIL_UNITS
CLASSES, PASSES, KNOWN, PRIOR = 64, 12, 0.9, 20.0
#: Rounds of assignment; likelihoods as integers of 1 / SCALE, so that sums do not depend on their order; a class that no word may take.
ROUNDS, SCALE, NEVER = 2, 1 << 20, -(1 << 32)
#: Contexts beyond which a word's votes are a row of a matrix product, occurrences up to which that is exact, and up to which sums fit 32 bits.
MANY, EXACT, FEW = 24, 1 << 26, 32
END = b""


def words(text: str) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space, and the end token."""
    return [*text.encode().lower().split(), END]


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(common.quoted(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def with_units(counts: DataFrame, frequent: DataFrame) -> DataFrame:
    """(batch, pos, unit, c, key) of (batch, pos, word, c), with frequent(frequent_key, rank): words as 64-bit keys and unit numbers, so that the words themselves stay behind."""
    tail = 1 + WORD_UNITS + F.crc32(F.substring(F.col("word").cast("binary"), -TAIL, TAIL)) % TAIL_UNITS
    met = counts.withColumn("key", F.xxhash64("word")).join(F.broadcast(frequent), F.col("key") == F.col("frequent_key"), "left")
    unit = F.when(F.coalesce("word", F.lit("")) == "", 0).otherwise(F.coalesce("rank", tail))
    return met.select("batch", "pos", unit.cast("short").alias("unit"), "c", "key")


def class_count(vocabulary: int) -> int:
    """Classes for a training vocabulary: CLASSES at least, and the cube root of its size beyond."""
    return max(CLASSES, round(vocabulary ** (1 / 3)))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """pairs[u, v]: how often unit v follows unit u -> class of each unit. Unit 0 (the end) keeps class 0 for itself."""
    n = len(pairs)
    weight = pairs.sum(0) + pairs.sum(1)
    of = np.zeros(n, np.int64)
    ranked = [u for u in np.lexsort((np.arange(n), -weight)) if u]
    for k, u in enumerate(ranked):
        of[u] = 1 + k % (classes - 1)
    table = np.zeros((classes, classes))
    np.add.at(table, (of[:, None].repeat(n, 1), of[None, :].repeat(n, 0)), pairs)
    active = [u for u in ranked if weight[u]]
    for _ in range(passes):
        moved = 0
        for u in active:
            now, self_ = of[u], pairs[u, u]
            row, column = pairs[u].astype(float), pairs[:, u].astype(float)
            row[u] = column[u] = 0
            out, into = np.bincount(of, row, classes), np.bincount(of, column, classes)
            table[now] -= out
            table[:, now] -= into
            table[now, now] -= self_
            left, right = table.sum(1), table.sum(0)
            gain = (_xlogx(table + out) - _xlogx(table)).sum(1) + (_xlogx(table + into[:, None]) - _xlogx(table)).sum(0)
            own = np.diagonal(table)
            gain += _xlogx(own + out + into + self_) - _xlogx(own + out) - _xlogx(own + into) + _xlogx(own)
            gain -= _xlogx(left + out.sum() + self_) - _xlogx(left) + _xlogx(right + into.sum() + self_) - _xlogx(right)
            gain[0] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[now] + 1e-9:
                best = now
            table[best] += out
            table[:, best] += into
            table[best, best] += self_
            moved += best != now
            of[u] = best
        if not moved:
            break
    return of


class Model(NamedTuple):
    of: np.ndarray  # class of each unit
    follows: np.ndarray  # (classes, classes + 1): P(class | class before); the last column is UNK
    mass: np.ndarray  # counts of each class, without what its words lend to UNK
    tokens: int
    vocabulary: int

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1))


def model_of(pairs: np.ndarray, once: np.ndarray, tokens: int, vocabulary: int, classes: int = CLASSES, passes: int = PASSES) -> Model:
    """once[u, v]: the share of pairs[u, v] whose second word has count 1."""
    of = exchange(pairs, classes, passes)
    return class_model(of, by_class(pairs, of, classes), by_class(once, of, classes), tokens, vocabulary)


def by_class(pairs: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    """Bigrams of units as bigrams of classes."""
    rows, out = np.zeros((classes, pairs.shape[1])), np.zeros((classes, classes))
    np.add.at(rows, of, pairs)
    np.add.at(out.T, of, rows.T)
    return out


def class_model(of: np.ndarray, pairs: np.ndarray, once: np.ndarray, tokens: int, vocabulary: int) -> Model:
    """The model of bigrams of classes; of: class of each unit, for words without one of their own."""
    classes = len(pairs)
    joint = np.column_stack([pairs - 0.5 * once, 0.5 * once.sum(1)])
    total = joint.sum(0)
    overall = total / total.sum() if total.sum() else np.eye(classes + 1)[classes]
    return Model(of, (joint + PRIOR * overall) / (joint.sum(1, keepdims=True) + PRIOR), total[:classes], tokens, vocabulary)


def likelihood(pairs: np.ndarray) -> float:
    """Of the bigrams of classes, but for what no clustering changes."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(0)).sum() - _xlogx(pairs.sum(1)).sum())


def votes(pairs: np.ndarray) -> np.ndarray:
    """[context, class]: what a bigram of a word adds to the likelihood if the word is in the class, in 1 / SCALE.

    Contexts 0 to classes - 1 are the class before the word, the others that after it.
    """
    left, right = pairs.sum(1), pairs.sum(0)
    follows = np.log(np.maximum((pairs + PRIOR * right / max(1.0, right.sum())) / (left[:, None] + PRIOR), 1e-300))
    out = np.rint(SCALE * np.concatenate([follows - np.log(np.maximum(right, 1)), follows.T])).astype(np.int64)
    out[:, right == 0] = NEVER
    out[:, 0] = NEVER  # the end token's
    return out


def chosen(starts: np.ndarray, context: np.ndarray, n: np.ndarray, vote: np.ndarray, most: int = 1 << 22, many: int = MANY) -> np.ndarray:
    """Best class of words whose contexts begin at starts and occur n times each; of equal ones the least.

    Words of more than ``many`` contexts are rows of a dense matrix that is multiplied with the votes (in doubles, exact below
    2 ** 53, which EXACT occurrences keep to); others add up the votes of their contexts one by one, in narrower integers if few occur.
    """
    out, ends = np.zeros(len(starts), np.int64), np.append(starts[1:], len(context))
    some = np.flatnonzero(vote[0] > NEVER)
    if not len(starts) or not len(some):
        return out
    votes_, sizes, times = np.ascontiguousarray(vote[:, some]), ends - starts, np.add.reduceat(n, starts)
    dense = (sizes > many) & (times <= EXACT)
    few = (sizes <= many) & (times <= FEW) & (np.abs(votes_).max() < (1 << 31) // FEW)
    step = max(1, most // max(votes_.shape))
    at = np.flatnonzero(dense)
    for a in range(0, len(at), step):
        part = at[a : a + step]
        taken = np.repeat(starts[part] - np.cumsum(sizes[part]) + sizes[part], sizes[part]) + np.arange(int(sizes[part].sum()))
        row = np.repeat(np.arange(len(part)), sizes[part])
        counts = np.bincount(row * len(votes_) + context[taken], n[taken], len(part) * len(votes_)).reshape(len(part), -1)
        out[part] = (counts @ votes_.astype(np.float64)).argmax(1)
    for at, table in ((np.flatnonzero(few), votes_.astype(np.int32)), (np.flatnonzero(~dense & ~few), votes_)):
        a, before = 0, np.cumsum(sizes[at])
        while a < len(at):  # contexts of some words at a time, or of a part of one word
            begin = int(before[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(before, begin + step, "right")))
            part = at[a:b]
            if b > a + 1 or sizes[part[0]] <= step:
                taken = np.repeat(starts[part] - np.cumsum(sizes[part]) + sizes[part], sizes[part]) + np.arange(int(sizes[part].sum()))
                total = np.add.reduceat(table[context[taken]] * n[taken, None].astype(table.dtype), np.cumsum(sizes[part]) - sizes[part], axis=0)
            else:
                cuts = range(int(starts[part[0]]), int(ends[part[0]]), step)
                total = sum((table[context[c : min(c + step, ends[part[0]])]] * n[c : min(c + step, ends[part[0]]), None]).sum(0, keepdims=True) for c in cuts)
            out[part] = total.argmax(1)
            a = b
    return some[out]


def _values_file(folder: str, batch: int) -> str:
    return f"{folder}/values/{batch}.zst"


def _classes_file(folder: str, turn: int, batch: int) -> str:
    return f"{folder}/classes-{turn}/{batch}.zst"


def _values(folder: str, batch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's words: unit, training count, key."""
    raw = zstandard.ZstdDecompressor().decompress(common.read_bytes(_values_file(folder, batch)))
    n = len(raw) // 18
    return np.frombuffer(raw, "<i2", n), np.frombuffer(raw, "<i8", n, 2 * n), np.frombuffer(raw, "<i8", n, 10 * n)


def _classes(folder: str, turn: int, batch: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(common.read_bytes(_classes_file(folder, turn, batch))), "<i4")


def _contexts(whole: wordtable.Numbered, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents a to b: words, which of them are first, and the documents' starts."""
    ends = whole.ends
    begin = int(ends[a] - whole.sizes[a])
    found = whole.words[begin : int(ends[b - 1])]
    starts = ends[a:b] - whole.sizes[a:b] - begin
    first = np.zeros(len(found), bool)
    first[starts] = True
    return found, first, starts


def _slices(whole: wordtable.Numbered, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``most`` words."""
    a, ends = 0, whole.ends
    while a < len(ends):
        before = int(ends[a] - whole.sizes[a])
        b = max(a + 1, int(np.searchsorted(ends, before + most, "right")))
        yield a, b
        a = b


def counted(occurrences: DataFrame) -> DataFrame:
    """Adds c, a word's count in all training documents, and first, true for one row of each word. A word has at most a row a batch."""
    by_word = Window.partitionBy("word")
    return occurrences.withColumns({"c": F.sum("n").over(by_word), "first": F.row_number().over(by_word.orderBy("batch")) == 1})


def clustered(batches: DataFrame, of: np.ndarray, joint: np.ndarray, folder: str, rounds: int | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Rounds of assignment, from units' classes ``of`` with class bigrams ``joint``: the round taken, its class bigrams, and those whose second word has count 1.

    The seeds themselves are taken only if rounds is 0.
    """
    spark, classes = batches.sparkSession, len(joint)
    buckets = max(batches.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def gather(turn: int):
        """The contexts of each word that has no unit of its own, packed by bucket of words."""

        def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (x for r in rows for x in r.column(0).to_pylist()):
                whole = wordtable.unpack(common.read_bytes(wordtable.batch_file(folder, batch)))
                unit, count, key = _values(folder, batch)
                class_ = of[unit] if turn == 0 else _classes(folder, turn, batch).astype(np.int64)
                moves, codes = (unit > WORD_UNITS) & (count > 0), np.zeros(0, np.int64)
                n = np.zeros(0, np.int64)
                for a, b in _slices(whole):
                    found, first, _ = _contexts(whole, a, b)
                    at = np.flatnonzero(moves[found] & np.repeat(whole.flags[a:b], whole.sizes[a:b]))
                    near = class_[found]
                    before = np.where(first[at], 0, near[at - 1])
                    mine = found[at].astype(np.int64) * (2 * classes)
                    got, times = np.unique(np.concatenate([mine + before, mine + classes + near[at + 1]]), return_counts=True)
                    codes, back = np.unique(np.concatenate([codes, got]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([n, times]), len(codes)).astype(np.int64)
                pos, context = codes // (2 * classes), codes % (2 * classes)
                # Words that are only held out here have no contexts here, but need their class as well.
                heads = np.flatnonzero(moves)
                bucket = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                heads = heads[np.argsort(bucket[heads], kind="stable")]
                order = np.argsort(bucket[pos], kind="stable")
                sizes, pos, context, n = np.bincount(pos, minlength=len(unit)), pos[order], context[order], n[order]
                some = np.unique(bucket[heads])
                ends = [(np.searchsorted(bucket[x], some), np.searchsorted(bucket[x], some, "right")) for x in (heads, pos)]
                packed = []
                for k, a, b, c, d in zip(*(x.tolist() for x in (some, *ends[0], *ends[1]))):
                    part = heads[a:b]
                    packed.append((k, wordtable.squeeze([np.diff(part, prepend=0), key[part], sizes[part]]), wordtable.squeeze([context[c:d], n[c:d]])))
                for a in range(0, len(packed), 256):
                    part = packed[a : a + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([batch] * len(part), pa.int64()), pa.array([x[1] for x in part], pa.binary()), pa.array([x[2] for x in part], pa.binary())], ["bucket", "batch", "words", "contexts"])
            common.give_back()

        return task

    def choose(vote: np.ndarray):
        """The class of each word of a bucket, for each batch that has it."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found() -> Iterator[tuple[np.ndarray, ...]]:
                for _, rows in common.runs(batches, "bucket"):
                    heads = [wordtable.unsqueeze(x.as_py()) for x in rows.column("words")]
                    batch = np.repeat(rows.column("batch").to_numpy(), [len(x[0]) for x in heads])
                    pos, (key, size) = np.concatenate([np.cumsum(x[0]) for x in heads]), (np.concatenate([x[k] for x in heads]) for k in (1, 2))
                    context, n = (np.concatenate(x) for x in zip(*(wordtable.unsqueeze(x.as_py()) for x in rows.column("contexts"))))
                    words_, word = np.unique(key, return_inverse=True)
                    owner = np.repeat(word, size)
                    order = np.argsort(owner, kind="stable")
                    starts = np.flatnonzero(np.diff(owner[order], prepend=-1))
                    yield batch, pos, chosen(starts, context[order], n[order], vote)[word]

            yield from wordtable.parcels(found())
            common.give_back()

        return task

    def settle(turn: int):
        """Writes the classes of a batch's words and counts the bigrams of classes."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, rows in common.runs(batches, "batch"):
                whole = wordtable.unpack(common.read_bytes(wordtable.batch_file(folder, batch)))
                unit, count, _ = _values(folder, batch)
                class_, data = of[unit], rows.column("data").drop_null()
                if len(data):
                    (own,) = wordtable.opened(data)
                    class_[: len(own)] = np.where(own > 0, own, class_[: len(own)])
                common.write_bytes(_classes_file(folder, turn, batch), zstandard.ZstdCompressor(level=1).compress(class_.astype("<i4").tobytes()))
                pairs, once = np.zeros(classes * classes, np.int64), np.zeros(classes * classes, np.int64)
                for a, b in _slices(whole):
                    found, first, _ = _contexts(whole, a, b)
                    now = class_[found]
                    before = np.concatenate(([0], now[:-1]))
                    before[first] = 0
                    train, key = np.repeat(whole.flags[a:b], whole.sizes[a:b]), before * classes + now
                    pairs += np.bincount(key[train], minlength=classes * classes)
                    once += np.bincount(key[train & (count[found] == 1)], minlength=classes * classes)
                some = np.flatnonzero(pairs)
                yield from common.in_parts(pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(pairs[some]), pa.array(once[some])], ["pair", "n", "once"]), 100_000)
            common.give_back()

        return task

    def counted_pairs(values: DataFrame, turn: int) -> tuple[np.ndarray, np.ndarray]:
        rows = values.unionByName(batches.select("batch", F.lit(None).cast("binary").alias("data")))
        seen = wordtable.by_batch(rows).mapInArrow(settle(turn), "pair int, n long, once long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("once").alias("once")).toArrow()
        out = np.zeros((2, classes * classes))
        out[:, seen["pair"].to_numpy()] = seen["n"].to_numpy(), seen["once"].to_numpy()
        return out[0].reshape(classes, classes), out[1].reshape(classes, classes)

    best = None
    rounds = ROUNDS if rounds is None else rounds
    if not rounds:
        return (0, *counted_pairs(spark.createDataFrame([], "batch long, data binary"), 0))
    for turn in range(1, rounds + 1):
        packed = wordtable.by_batch(batches).mapInArrow(gather(turn - 1), "bucket long, batch long, words binary, contexts binary")
        dealt = packed.repartitionById(int(spark.conf.get("spark.sql.shuffle.partitions")), F.pmod("bucket", F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))).cast("int")).sortWithinPartitions("bucket", "batch")
        now = counted_pairs(dealt.mapInArrow(choose(votes(joint)), "batch long, data binary"), turn)
        if best is not None and likelihood(now[0]) <= likelihood(joint):
            break
        best, joint = (turn, *now), now[0]
    return best


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outside: Column | None = None, batch_chars: int = wordtable.BATCH_CHARS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    outside: true for documents that are not learned from (by default the contract's tenth).
    """
    spark = docs.sparkSession
    folder = common.shared_folder(spark, "classlm")
    slim = docs.select(common.id_of(docs, id_col).alias("id"), common.text_of(docs, text_col).alias("text"), (~(held_out(id_col) if outside is None else outside)).alias("flag"))
    table = common.written(counted(wordtable.split_batches(slim, lambda: words, folder, batch_chars)).select("batch", "pos", "word", "c", "first"), folder, "counts")
    totals = table.filter("first").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    frequent_rows = table.filter((F.col("first")) & (F.col("c") > 0) & (F.col("word") != "")).orderBy(F.desc("c"), "word").limit(WORD_UNITS).select(F.xxhash64("word").alias("key")).collect()
    frequent = spark.createDataFrame([(r["key"], k) for k, r in enumerate(frequent_rows, 1)], "frequent_key long, rank long")
    classes = class_count(totals["v"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in common.runs(batches, "batch"):
            whole = wordtable.unpack(common.read_bytes(wordtable.batch_file(folder, batch)))
            unit, count, key = (rows.column(c).to_numpy() for c in ("unit", "c", "key"))
            common.write_bytes(_values_file(folder, batch), zstandard.ZstdCompressor(level=1).compress(unit.astype("<i2").tobytes() + count.astype("<i8").tobytes() + key.astype("<i8").tobytes()))
            pairs = np.zeros(UNITS * UNITS, np.int64)
            for a, b in _slices(whole):
                found, first, _ = _contexts(whole, a, b)
                now = unit[found].astype(np.int64)
                before = np.concatenate(([0], now[:-1]))
                before[first] = 0
                pairs += np.bincount((before * UNITS + now)[np.repeat(whole.flags[a:b], whole.sizes[a:b])], minlength=UNITS * UNITS)
            some = np.flatnonzero(pairs)
            yield from common.in_parts(pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(pairs[some])], ["pair", "n"]), 100_000)

    seen = wordtable.by_batch(with_units(table, frequent), "pos").mapInArrow(pair, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(UNITS * UNITS)
    pairs[seen["pair"].to_numpy()] = seen["n"].to_numpy()
    of = exchange(pairs.reshape(UNITS, UNITS), classes)
    batches_ = common.written(table.select("batch").distinct(), folder, "batch_keys")
    turn, joint, once = clustered(batches_, of, by_class(pairs.reshape(UNITS, UNITS), of, classes), folder)
    model = class_model(of, joint, once, totals["n"], totals["v"])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for rows in batches for x in rows.column(0).to_pylist()):
            whole = wordtable.unpack(common.read_bytes(wordtable.batch_file(folder, batch)))
            count, class_ = _values(folder, batch)[1], _classes(folder, turn, batch)
            known, base = count > 0, model.base(count)
            emit = np.where(known, (count - 0.5 * (count == 1)) / np.maximum(model.mass[class_], 0.5), 1.0)
            target = np.where(known, class_, model.follows.shape[1] - 1)
            log_base = np.log10(base)
            for a, b in _slices(whole):
                found, first, starts = _contexts(whole, a, b)
                before = np.concatenate(([0], class_[found[:-1]]))
                before[first] = 0
                p = KNOWN * model.follows[before, target[found]] * emit[found] + (1 - KNOWN) * base[found]
                size, total = whole.sizes[a:b], np.add.reduceat(np.log10(p), starts)
                columns = [whole.ids[a:b], pa.array(~whole.flags[a:b]), pa.array(size), pa.array(np.add.reduceat(known[found].astype(np.int64), starts)), pa.array(np.full(b - a, model.tokens)), pa.array(np.add.reduceat(log_base[found], starts)), pa.array(total), pa.array(10 ** (-total / size))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    schema = f"`{id_col}` {common.id_kind(docs, id_col)}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return wordtable.by_batch(batches_).mapInArrow(rate, schema)
