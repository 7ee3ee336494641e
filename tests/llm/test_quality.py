import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from revmine.llm import common, quality, queries

from .fixtures import LONG, awkward, crc, empty


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_chunks_cover_every_byte():
    for n in (0, 1, 7, 8, 9, quality.HOP, quality.CHUNK, quality.CHUNK + 1, 5 * quality.HOP + 3):
        data = bytes(1 + i % 255 for i in range(n))
        cut = quality.chunks(data)
        whole = bytearray((len(cut) - 1) * quality.HOP + quality.CHUNK)
        for i, row in enumerate(cut):
            whole[i * quality.HOP : i * quality.HOP + quality.CHUNK] = row.tobytes()
        assert bytes(whole[:n]) == data and not any(whole[n:])


def direct(model, data):
    """The network, one response at a time, as defined."""
    tops = []
    for row in quality.chunks(data):
        vectors = model.vectors[row]
        responses = [vectors[p * quality.STRIDE : p * quality.STRIDE + quality.WIDTH].reshape(-1) @ model.filters for p in range(quality.POSITIONS)]
        tops.append(np.maximum(np.max(responses, axis=0) + model.offsets, 0))
    logit = np.max(tops, axis=0) @ model.largest + np.mean(tops, axis=0) @ model.mean + model.bias[0]
    return 1 / (1 + np.exp(-logit))


def test_scores_match_the_definition():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 5, 300, 3000, 40_000)]
    model = quality.train(texts * 4, np.array([0, 1, 0, 1, 1] * 4, np.float32), epochs=1)
    assert quality.probabilities(model, texts) == pytest.approx([direct(model, x) for x in texts], abs=1e-5)


def test_gradients_reduce_the_loss():
    texts = [f"clean sentence number {i} about rivers and towns".encode() for i in range(60)] + [f"buy $$$ now !!! click {i} &&& %%%".encode() for i in range(60)]
    y = np.array([1] * 60 + [0] * 60, np.float32)
    p = quality.probabilities(quality.train(texts, y, epochs=4), texts)
    assert ((p >= 0.5) == y).mean() > 0.95


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_quality_classifier(spark, sf).collect()
    known = {r["doc_id"]: r["quality"] for r in common.table(spark, sf, "labels").collect()}
    assert len(got) == common.table(spark, sf, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (crc(str(r["doc_id"])) % 3 == 1) for r in got)
    right = [r["predicted"] == known[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in known]
    assert np.mean(right) > 0.93


def test_held_out_labels_and_other_columns_have_no_influence(spark, sf):
    docs, known = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    a = {r["doc_id"]: r["score"] for r in quality.classify(docs, known).collect()}
    flipped = known.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(1))
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string"), "score": F.lit(3)})
    b = {r["doc_id"]: r["score"] for r in quality.classify(other, flipped).collect()}
    assert a == b


def test_awkward_tables(spark):
    docs = awkward(spark)
    got = quality.classify(docs, labels(spark, [(1, 1, 0), (5, 0, 0), (5, 1, 0), (None, 1, 0), (8, None, 0)])).collect()
    scores = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == docs.count() and scores[4] == scores[5] and all(0 <= s <= 1 for s in scores.values())
    assert quality.classify(empty(spark), labels(spark, [])).collect() == []
    assert {r["score"] for r in quality.classify(docs, labels(spark, [])).collect()} == {0.5}
    one = [(i, 1, 0) for i in range(1, 11) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert all(r["score"] > 0.99 for r in quality.classify(docs, labels(spark, one)).collect())


def test_keep_returns_the_columns_of_docs(spark, sf):
    docs = common.table(spark, sf, "documents")
    kept = quality.keep(docs, common.table(spark, sf, "labels"))
    want = {r["doc_id"] for r in quality.classify(docs, common.table(spark, sf, "labels")).filter("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want
    assert len(LONG) > quality.MAX_BYTES
