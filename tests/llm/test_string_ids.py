"""Ids that are strings (content keys, say) give the results of the numbers that they stand for."""

from pyspark.sql import functions as F

from revmine.llm import bpe, classlm, exact, idfile, mixing, ogg, quality, simhash, unigram

from .fixtures import awkward


def test_every_operator_takes_string_ids(spark):
    plain = awkward(spark).filter("doc_id IS NOT NULL AND doc_id <> 10")
    named = plain.withColumn("doc_id", F.format_string("k%02d", "doc_id"))
    labels = spark.createDataFrame([(f"k{i:02d}", i % 2) for i in (1, 5, 8, 12, 13)], "doc_id string, quality int")

    def rows(df, ids):
        out = []
        for r in df.collect():
            out.append(tuple(int(v[1:]) if c in ids and ids[c] and v is not None else v for c, v in r.asDict().items()))
        return sorted(out, key=repr)

    never = F.lit(False)
    for f, ids in (
        (exact.label, ["doc_id", "keep_id"]), (simhash.label, ["doc_id", "component_id"]), (lambda d: bpe.digests(bpe.encode_decode(d)), ["doc_id"]),
        (lambda d: bpe.decode(bpe.encode_decode(d)), ["doc_id"]), (unigram.count_tokens, ["doc_id"]), (lambda d: classlm.score(d, outside=never), ["doc_id"]),
        (idfile.round_trip, ["doc_id"]), (ogg.round_trip, ["doc_id"]), (exact.dedup, ["doc_id"]), (simhash.near_dedup, ["doc_id"]),
    ):
        assert rows(f(named), dict.fromkeys(ids, True)) == rows(f(plain), {})
    assert quality.classify(named, labels).count() == quality.keep(named, labels).count() + quality.classify(named, labels).filter("predicted = 0").count() == plain.count()
    assert mixing.mix_table(named).count() == plain.count() and set(mixing.mix(named).columns) == set(named.columns)
