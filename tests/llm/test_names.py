"""Columns of the input that are named as an operator's own results or steps."""

from pyspark.sql import functions as F

import corpus_pipeline
from revmine.llm import bpe, classlm, exact, idfile, mixing, ogg, quality, simhash, unigram

from .fixtures import awkward, by_id

NAMES = "keep_id group_size kept text_sha256 fingerprint component_id node root least u v size source_size target taken epochs extra partly bucket words before s w score predicted held_out ids decoded n_tokens start feature media n_bytes flag pos term i y d t rank".split()
#: Names of steps' own columns, and beginnings that steps may choose.
NAMES += "__id __sha __key __score __size __copy __copies __rank __row_key __w0 __hit0 __keep_id __w __before __row __may __word __bits __s __parts __n ___id _____key __ parts n sha hash may row key_ end_bucket first `tick` a.b".split()


def clashing(spark):
    return awkward(spark).withColumns({n: F.lit(f"own {n}") for n in NAMES})


def test_results_do_not_depend_on_other_columns(spark):
    plain, odd = awkward(spark), clashing(spark)
    for f in (exact.label, lambda d: simhash.label(d), mixing.mix_table, lambda d: bpe.digests(bpe.encode_decode(d)), unigram.count_tokens, classlm.score, lambda d: idfile.round_trip(d).drop("first_ids"), ogg.round_trip):
        assert by_id(f(odd).collect()) == by_id(f(plain).collect())
    labels = spark.createDataFrame([(1, 1), (5, 0), (8, 1), (12, 0)], "doc_id long, quality int")
    assert by_id(quality.classify(odd, labels).collect()) == by_id(quality.classify(plain, labels).collect())


def test_stages_pass_such_columns_through(spark, sf):
    odd, plain = clashing(spark), awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert all(r.asDict()[n] == f"own {n}" for r in rows for n in NAMES), name
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in stage(spark, plain, sf).collect()), name
