"""Bloom filters, rows taken out by key, and what the operators do with long, repeated and unlearned rows."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revmine.llm import bloom, bpe, classlm, exact, idfile, mixing, quality, rows, simhash

from .fixtures import LONG, TEXTS, awkward, by_id, crc, words


@pytest.mark.parametrize("slots", [64, 1 << 10, 1 << 16])
def test_a_filter_never_misses(spark, slots):
    df = spark.range(3000).select((F.col("id") % 2000).alias("v"), F.xxhash64(F.col("id") % 2000).alias("h"))
    twice = bloom.marked(df, F.col("h"), bloom.hit_twice(df, "h", slots), slots, "may").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.bool_and("may").alias("may")).collect()
    assert all(r["may"] for r in twice if r["n"] > 1)
    once = [r["may"] for r in twice if r["n"] == 1]
    assert slots < 1 << 16 or sum(once) < 0.2 * len(once)  # where two rows in three repeat, words with three hits of a slot are not rare
    other = spark.range(5000, 6000).select(F.xxhash64("id").alias("h"))
    found = bloom.marked(df.unionByName(other.withColumn("v", F.lit(-1).cast("long"))), F.col("h"), bloom.hit(df, "h", slots), slots, "may").groupBy("v").agg(F.bool_and("may").alias("all"), F.avg(F.col("may").cast("int")).alias("share")).collect()
    assert all(r["all"] for r in found if r["v"] >= 0)
    assert slots < 1 << 16 or next(r["share"] for r in found if r["v"] == -1) < 0.05


def test_three_copies_are_hit_twice(spark):
    """Three hits of a slot are odd, as one is."""
    for n in range(2, 8):
        df = spark.range(n).select(F.xxhash64(F.lit("same")).alias("h"))
        assert bloom.marked(df, F.col("h"), bloom.hit_twice(df, "h", 64), 64, "may").filter("may").count() == n


def test_pass_one_shuffles_fewer_rows_than_documents(spark):
    hashes = spark.range(0, 40_000, 1, 4).select(F.xxhash64("id").alias("h"))
    words_ = bloom.hit_twice(hashes, "h", bloom.slots_for(40_000))
    words_.collect()
    plan = words_._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") <= 2 and "Generate" not in plan  # once in the final plan, once in the first


def test_rows_go_through_a_filter_beyond_a_broadcast(spark, monkeypatch):
    docs = awkward(spark, TEXTS + [(200 + i, f"copy number {i % 7}", "s") for i in range(60)])
    want = [by_id(f(docs).collect()) for f in (exact.dedup, simhash.near_dedup, mixing.mix)]
    monkeypatch.setattr(rows, "BROADCAST_ROWS", 0)
    assert [by_id(f(docs).collect()) for f in (exact.dedup, simhash.near_dedup, mixing.mix)] == want


def test_equal_texts_of_one_id_in_other_cases_leave_one_row(spark):
    docs = awkward(spark, [(1, "Same", "a"), (1, "SAME", "a"), (1, "same", "a"), (1, "same", "a"), (0, "same", "a"), (2, "other", "a")])
    assert sorted(r["doc_id"] for r in exact.dedup(docs).collect()) == [1, 2]


def test_a_budget_that_ends_among_equal_rows_takes_some_of_them(spark):
    docs = awkward(spark, [(7, "one two three four", "s")] * 5 + [(8, "a b", "s"), (9, "c", "t")])
    table, taken = mixing.mix_table(docs).collect(), Counter()
    for r in table:
        taken[r["doc_id"]] += r["epochs"] + (r["taken"] > r["epochs"] * r["size"])
    assert Counter(r["doc_id"] for r in mixing.mix(docs).collect()) == +taken


def test_the_mix_may_be_weighed_by_the_classifier(spark):
    """A weight is any column: here the score of a trained model, so that better documents come first."""
    good, bad = "Plain sentences of words that people read. " * 8, "zzz 000 ### qqq !!! xxx 111 $$$ " * 12
    docs = awkward(spark, [(i, f"{good if i % 2 else bad} {i}", "hot" if i < 400 else f"s{i % 3}") for i in range(460)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    scored = quality.scored(docs, quality.fit(docs, labels), score_col="quality_score")
    table = mixing.mix_table(scored, weight=F.col("quality_score") + 0.001).filter("source_size > 0 AND taken > epochs * size").collect()
    odd = [r["doc_id"] % 2 for r in table if r["doc_id"] < 400]
    assert not odd or np.mean(odd) > 0.6


def test_long_labelled_texts_are_learned_from_in_pieces_of_the_whole(spark):
    text = "".join(chr(97 + i * 26 // 200_000) for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["b"]) for r in docs.select("doc_id", quality.drawn(F.coalesce("text", F.lit("")), 26_000).alias("b")).collect()}
    assert got[2] == b"short" and got[3] == b"" and 25_000 < len(got[1]) <= 26_000
    assert got[1][0] == ord("a") and got[1][-1] == ord("z") and len(set(got[1])) > 15
    ids = [i for i in range(100) if crc(str(i)) % 3 != 1][:4]
    docs = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    found, ones = quality.sample_of(docs, labels, "doc_id", "text", "quality", 10, 1000)
    assert len(found) == 4 and sum(ones) == 2 and all(900 < len(x) <= 1000 for x in found)


def test_without_training_rows_every_score_is_that_of_certainty(spark):
    docs = awkward(spark)
    assert all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in classlm.score(docs, outside=F.lit(True)).collect())


def test_token_files_are_the_same_when_the_table_of_words_is_cleared(monkeypatch):
    vocabulary = bpe.vocabulary_text(None)
    texts = [t or "" for _, t, _ in TEXTS] + [LONG]
    whole = idfile.CachedEncoder(vocabulary)(texts)
    monkeypatch.setattr(idfile, "CACHE_WORDS", 3)
    encode = idfile.CachedEncoder(vocabulary)
    assert [encode([t])[0] for t in texts] == whole
    assert whole == [np.array(x.ids, "<u4").tobytes() for x in bpe.tokenizer(vocabulary).encode_batch(texts, add_special_tokens=False)]


_ENCODER = []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30) | st.sampled_from([" a", " the", "'s", " '", "\n\n", "  ", " 12", "<|endoftext|>", " \x85x", " é", " 日本", "\x1c"]), max_size=40))
def test_words_encoded_together_get_the_ids_of_words_alone(parts):
    if not _ENCODER:
        vocabulary = bpe.vocabulary_text(None)
        _ENCODER.extend([bpe.WordEncoder(vocabulary), bpe.splitter(bpe.added_tokens(vocabulary)), bpe.tokenizer(vocabulary)])
    encode, cut, library = _ENCODER
    found = sorted(set(cut("".join(parts).encode("utf-8", "replace").decode())))
    starts, counts, values = encode(found)
    assert [values[a : a + n].tolist() for a, n in zip(starts.tolist(), counts.tolist())] == [library.encode(w, add_special_tokens=False).ids for w in found]


def test_a_vocabulary_that_is_not_byte_level_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        bpe.tokenizer(bpe.vocabulary_text(public_tokenizers.path("word_bpe_49k.json")))


def test_words_are_the_brute_force_ones():
    assert all(classlm.words(t) == [w.encode() for w in words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))] + [b""] for _, t, _ in TEXTS if t)
