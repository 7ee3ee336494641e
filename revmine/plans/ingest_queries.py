"""Plans over joins, scans, dedup and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ingest, ranking
from ..sources import readers, sinks, work
from . import inputs as sql
from .registry import query


def _pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = readers.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("pr_id"), F.col("o_custkey").alias("pr_number"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("labels"), F.col("o_orderdate").alias("created_at"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = readers.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("pr_id"), F.expr("'f' || CAST(l_linenumber AS STRING)").alias("filename"), F.expr("l_returnflag || l_linestatus").alias("diff_text"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = readers.table(spark, sf_dir, "events")
    return e.select("event_id", F.expr("event_id * 3 + 1").alias("pr_id"), F.expr("CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'f' || CAST(user_id % 4 AS STRING) END").alias("file_path"), F.col("event_type").alias("comment_text"))


_SQL = """p AS (SELECT o_orderkey AS pr_id, o_custkey AS pr_number, o_orderstatus AS state, o_orderpriority AS labels, o_orderdate AS created_at FROM orders),
f AS (SELECT l_orderkey AS pr_id, 'f' || l_linenumber::STRING AS filename, l_returnflag || l_linestatus AS diff_text FROM lineitem),
m AS (SELECT event_id, event_id * 3 + 1 AS pr_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'f' || (user_id % 4)::STRING END AS file_path, event_type AS comment_text FROM events)"""


@query(f"WITH {_SQL} SELECT m.event_id, p.pr_id, p.pr_number, p.labels, f.filename, f.diff_text, m.comment_text FROM p JOIN f ON f.pr_id = p.pr_id JOIN m ON m.pr_id = p.pr_id AND m.file_path = f.filename WHERE length(m.comment_text) >= 5")
def pr_file_comment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews: pulls, files and comments on pull and path, without very short comments."""
    notes = ingest.long_enough(_notes(spark, sf_dir), "comment_text")
    return ingest.reviews(_pulls(spark, sf_dir), _files(spark, sf_dir), notes).select("event_id", "pr_id", "pr_number", "labels", "filename", "diff_text", "comment_text")


@query(f"WITH {_SQL} SELECT m.event_id, p.pr_id, p.state FROM p JOIN m ON m.pr_id = p.pr_id WHERE m.file_path IS NULL")
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.orphans(_pulls(spark, sf_dir), _notes(spark, sf_dir)).select("event_id", "pr_id", "state")


@query(f"WITH {_SQL} SELECT pr_id, created_at FROM p WHERE created_at BETWEEN TIMESTAMP '1996-02-01' AND TIMESTAMP '1996-03-31'")
def date_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulls of a closed range of days, newest first; the last day counts to its midnight."""
    return ingest.in_range(_pulls(spark, sf_dir), "created_at", "1996-02-01", "1996-03-31").select("pr_id", "created_at").orderBy(F.desc("created_at"), "pr_id")


@query(f"WITH {_SQL} SELECT p.pr_id, f.filename, f.diff_text FROM p JOIN f ON f.pr_id = p.pr_id WHERE p.pr_number = 17")
def files_of_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.of_pull(_pulls(spark, sf_dir), _files(spark, sf_dir), "17").select("pr_id", "filename", "diff_text")


_RAW = "CASE comment_id % 11 WHEN 0 THEN comment_text || chr(13) || 'tail' WHEN 1 THEN comment_text || '<CODESPLIT>' ELSE comment_text END"


@query(f"""WITH {sql.COMMENTS}, r AS (SELECT comment_id, string_split(replace({_RAW}, chr(10), ' '), chr(13))[1] AS t FROM c)
SELECT comment_id::STRING AS pr_number, 1 AS label, md5({sql.gsub('t', rf'[{text.SPACE}]+' + chr(92) + 'z')}) AS comment_key FROM r WHERE NOT contains(t, '<CODESPLIT>')""")
def codesplit_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled text written and read again: a carriage return ends a line, and a line with another number of fields is dropped."""
    c = sql.comments(spark, sf_dir)
    rows = c.select(F.lit(1).alias("label"), F.col("comment_id").alias("pr_number"), "commenter", F.lit("d").alias("diff"), F.expr(_RAW).alias("comment"))
    path = f"{work.shared_folder(spark, 'codesplit')}/rows"
    sinks.labelled(rows, path)
    return readers.with_int_label(readers.labelled(spark, path)).select("pr_number", "label", text.content_key("comment").alias("comment_key"))


@query(f"""WITH {sql.COMMENTS}, l AS (SELECT comment_id, 1 AS label, CASE WHEN comment_id % 13 = 0 THEN 'x' ELSE ((comment_id % 9) - 4)::STRING END AS z FROM c)
SELECT comment_id::STRING AS pr_number, round(1 / (1 + exp(-z::DOUBLE)), 6) AS p FROM l WHERE z <> 'x'""")
def logits_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with two logits, written, read again without the malformed ones, and turned into probabilities."""
    c = sql.comments(spark, sf_dir)
    rows = c.select(F.lit(1).alias("label"), F.col("comment_id").alias("pr_number"), "commenter", F.lit("d").alias("diff"), F.lit("c").alias("comment"), F.lit("0.0").alias("logit0"), F.expr("CASE WHEN comment_id % 13 = 0 THEN 'x' ELSE CAST((comment_id % 9) - 4 AS STRING) END").alias("logit1"))
    path = f"{work.shared_folder(spark, 'logits')}/rows"
    sinks.logits(rows, path)
    return readers.logits(spark, path).select("pr_number", F.round(text.softmax_positive(F.col("logit0"), F.col("logit1")), 6).alias("p"))


@query(f"WITH {sql.COMMENTS}, k AS (SELECT comment_id, {sql.canonical('comment_text')} AS n FROM c) SELECT min(comment_id) AS comment_id, md5(n) AS key FROM k GROUP BY n")
def exact_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first comment of each content key."""
    c = sql.comments(spark, sf_dir).select("comment_id", text.content_key(text.canonical("comment_text")).alias("key"))
    return ingest.first_of(c, F.col("key"), "comment_id")


@query(f"WITH {sql.COMMENTS}, k AS (SELECT comment_id, md5(comment_text) AS id FROM c) SELECT DISTINCT id FROM k WHERE id NOT IN (SELECT id FROM k WHERE comment_id % 3 = 0)")
def incremental_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that an index of a third of the comments lacks."""
    c = sql.comments(spark, sf_dir).select("comment_id", text.content_key("comment_text").alias("id"))
    return ingest.not_indexed(c.select("id"), c.filter("comment_id % 3 = 0").select("id"))


@query("""WITH d AS (SELECT doc_id, sha256(text) AS key FROM documents), k AS (SELECT d.key, any_value(e.label) AS label FROM embeddings e JOIN d ON d.doc_id = e.vec_id WHERE e.vec_id % 2 = 0 GROUP BY d.key)
SELECT d.doc_id, d.key, d.key IN (SELECT key FROM k) AS hit FROM d""")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents find their embedding in the cache, by the checksum of their text."""
    d = readers.table(spark, sf_dir, "documents").select("doc_id", "text")
    e = readers.table(spark, sf_dir, "embeddings").filter("vec_id % 2 = 0")
    cache = d.join(e, F.col("doc_id") == F.col("vec_id")).select(text.checksum("text").alias("key"), "embedding", "vec_id")
    return ingest.cached(d, ingest.first_of(cache, F.col("key"), "vec_id"), "text").select("doc_id", "key", "hit")


@query("""WITH v AS (SELECT c_nationkey AS key, c_custkey AS version, c_name AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_nationkey, c_custkey, upper(c_name) FROM customer WHERE c_custkey % 2 = 1)
SELECT key, max(version) AS version, arg_max(value, version) AS value FROM v GROUP BY key""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each key of a table and of rows that come in."""
    c = readers.table(spark, sf_dir, "customer")
    rows = lambda value, odd: c.filter(F.col("c_custkey") % 2 == odd).select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("version"), value.alias("value"))
    return ingest.upserted(rows(F.col("c_name"), 0), rows(F.upper("c_name"), 1), "key", "version")


@query("SELECT conv_id, turn, md5(replace(text, chr(1), '')) AS text_key FROM conversations AS x WHERE turn < (SELECT max(turn) FROM conversations AS y WHERE y.conv_id = x.conv_id)")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of JSON arrays that were cut off within their last record."""
    t = readers.table(spark, sf_dir, "conversations")
    one = F.to_json(F.struct("conv_id", "turn", F.translate("text", "{}", "()").alias("text")))
    whole = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("j")))), lambda x: x["j"]), ",\n").alias("body"))
    cut = whole.select(F.concat(F.lit(" [\n"), F.expr("substr(body, 1, length(body) - 3)"), F.lit("\x01")).alias("content"))
    return readers.from_salvaged(cut, "content", "conv_id long, turn long, text string").select("conv_id", "turn", text.content_key("text").alias("text_key"))


@query("SELECT conv_id AS pr_id, turn, role FROM conversations")
def nested_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments that came nested in their pull, as rows."""
    t = readers.table(spark, sf_dir, "conversations")
    pulls = t.groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(F.struct("turn", "role")).alias("comments"))
    return ingest.nested(pulls, "comments")


@query(f"WITH {sql.COMMENTS} SELECT count(*) AS visited, count(*) FILTER (length({sql.strip('comment_text')}) >= 5) AS kept FROM c")
def visited_and_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many comments a scan visited and kept, observed while it ran."""
    kept, seen = ingest.counted(sql.comments(spark, sf_dir), F.length(text.strip("comment_text")) >= text.SHORTEST)
    kept.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["visited"], seen.get["kept"])], "visited long, kept long")


@query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42-' || doc_id::STRING), doc_id) - 1 AS row_no FROM documents) SELECT doc_id, row_no, 'train-' || row_no::STRING AS guid FROM n")
def hash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact row numbers in a seeded hash order, and the names made of them."""
    d = readers.table(spark, sf_dir, "documents").select("doc_id")
    placed, _ = ranking.numbered(d, ranking.hash_key(42, F.col("doc_id")), "doc_id")
    return placed.withColumn("guid", F.concat(F.lit("train-"), F.col("row_no").cast("string")))
