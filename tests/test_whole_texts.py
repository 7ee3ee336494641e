from pyspark.sql import functions as F

from revmine.plans import catalog, inputs


def test_prefix_parsing_keeps_the_tail_of_a_comment(spark, sf):
    """The payload is the key of the whole comment, not of its first 50 characters."""
    assert "substr(comment_text, 1, 50)" not in catalog.ORACLES["prefix_parsing"]
    long = inputs.comments(spark, sf).filter("comment_id % 9 <> 0 AND length(comment_text) > 50 AND comment_id % 3 <> 0").select("comment_id", F.md5(F.rtrim("comment_text").cast("binary")).alias("want"))
    got = catalog.QUERIES["prefix_parsing"](spark, sf).join(long, "comment_id").select("payload", "want").collect()
    assert got and sum(r["payload"] == r["want"] for r in got) > 0.9 * len(got)


def test_every_whole_text_is_a_comment(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + inputs.WHOLE).alias("comment_id"), F.col("text").alias("comment_text"))
    c = inputs.comments(spark, sf).select("comment_id", "comment_text")
    assert c.count() == 2 * docs.count() and docs.exceptAll(c).isEmpty()
    assert "substr" not in inputs.COMMENT
