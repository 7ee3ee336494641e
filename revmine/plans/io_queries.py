"""Plans over sources and sinks: rows written by a sink and read again by its reader, and readable blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ranking
from ..sources import readers, sinks, work
from . import inputs as sql
from .registry import query
from .text_queries import _REGEX

_QUOTED = "'\"' || c_name || '\", x' || chr(92)"
_SHOWN = "CASE WHEN labels = '' THEN '(none)' ELSE labels END"
_RIGHT = sql.gsub("diff_text", rf"[{text.SPACE}]+\z")


@query(f"WITH {sql.COMMENTS} SELECT comment_id AS pr_number, commenter, filename, labels, title IS NULL AS untitled, md5(diff_text) AS diff_key, md5(comment_text) AS comment_key, md5(suggestion_text) AS suggestion_key FROM (SELECT *, NULL AS title FROM c)")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review records as JSON lines and back; a field that is not there is null."""
    path = f"{work.shared_folder(spark, 'records')}/rows"
    sinks.records(sql.comments(spark, sf_dir).select(F.col("comment_id").alias("pr_number"), "filename", "diff_text", "commenter", "comment_text", "suggestion_text", "labels"), path)
    r = readers.records(spark, path, lines=True)
    return r.select("pr_number", "commenter", "filename", "labels", F.col("title").isNull().alias("untitled"), text.content_key("diff_text").alias("diff_key"), text.content_key("comment_text").alias("comment_key"), text.content_key("suggestion_text").alias("suggestion_key"))


@query("SELECT conv_id AS pr_number, 'turn ' || turn::STRING AS title, md5(text) AS comment_key FROM conversations")
def json_array_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays of records, an array in a line, as chunks that tasks read apart."""
    path = f"{work.shared_folder(spark, 'arrays')}/rows"
    t = readers.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pr_number"), F.concat(F.lit("turn "), F.col("turn")).alias("title"), F.col("text").alias("comment_text"))
    t.groupBy("pr_number").agg(F.to_json(F.collect_list(F.struct("pr_number", "title", "comment_text"))).alias("value")).select("value").write.mode("overwrite").text(path)
    return readers.records(spark, path, lines=True).select("pr_number", "title", text.content_key("comment_text").alias("comment_key"))


@query(f"SELECT c_custkey, {_QUOTED} AS name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows as CSV and back, with quotes, commas and backslashes in them."""
    path = f"{work.shared_folder(spark, 'csv')}/rows"
    sinks.csv(readers.table(spark, sf_dir, "customer").select("c_custkey", F.expr(_QUOTED.replace("'\"'", "chr(34)").replace("'\", x'", "chr(34) || ', x'")).alias("name"), "c_acctbal", "c_mktsegment"), path)
    return readers.csv(spark, path, "c_custkey long, name string, c_acctbal double, c_mktsegment string")


@query("SELECT event_id::STRING AS event_id, event_type || ' ü' AS event_type, props FROM events")
def sheets_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables as sheets without control characters; one of them read back as strings."""
    folder, e = work.shared_folder(spark, "sheets"), readers.table(spark, sf_dir, "events")
    rows = e.select("event_id", F.expr("event_type || chr(1) || ' ü' || chr(31)").alias("event_type"), "props")
    sinks.sheets({"events": rows, "types": rows.select("event_type").distinct()}, folder)
    return readers.csv(spark, f"{folder}/events", "event_id string, event_type string, props string")


@query("SELECT event_type, count(*) AS n, sum(value) > 0 AS some, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def appended_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that two writers append to, in a folder for each type."""
    path, e = f"{work.shared_folder(spark, 'append')}/events", readers.table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    for odd in (0, 1):
        sinks.append(e.filter(F.col("event_id") % 2 == odd), path, "event_type")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), (F.sum("value") > 0).alias("some"), F.count_distinct("user_id").alias("users"))


@query("SELECT 'added' AS state, vec_id, label FROM embeddings UNION ALL SELECT 'rebuilt', vec_id, label FROM embeddings WHERE label = 1")
def index_add_and_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector table that grows by two batches, and one that is rebuilt."""
    folder, e = work.shared_folder(spark, "index"), readers.table(spark, sf_dir, "embeddings")
    for odd in (0, 1):
        sinks.index(e.filter(F.col("vec_id") % 2 == odd), f"{folder}/added")
        sinks.index(e.filter(F.col("label") == odd), f"{folder}/rebuilt", rebuild=True)
    state = lambda name: spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("state"), "vec_id", "label")
    return state("added").unionByName(state("rebuilt"))


@query("SELECT 'run-' || (user_id % 3)::STRING AS run, 'acc = ' || event_type AS value, count(*) AS n FROM events GROUP BY 1, 2")
def metric_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines appended to the logs of three runs, read with the run of each."""
    folder, e = work.shared_folder(spark, "logs"), readers.table(spark, sf_dir, "events")
    for k in range(3):
        sinks.metrics(e.filter(F.col("user_id") % 3 == k).select(F.concat(F.lit("acc = "), "event_type").alias("value")), f"{folder}/run-{k}")
    return readers.metric_logs(spark, f"{folder}/*").groupBy("run", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH l AS (SELECT {sql.gsub('unnest(string_split(text, chr(10)))', rf'[{text.SPACE}]+' + chr(92) + 'z')} AS line FROM documents WHERE NOT contains(text, chr(13))) SELECT md5(line) AS line_key, count(*) AS n FROM l WHERE line <> '' GROUP BY 1")
def non_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text files without the blank ones and without white space at their ends (texts without carriage returns, which end a line in a text file too)."""
    path = f"{work.shared_folder(spark, 'lines')}/rows"
    readers.table(spark, sf_dir, "documents").filter("NOT contains(text, chr(13))").select(F.concat("text", F.lit("  \n \t")).alias("value")).write.mode("overwrite").text(path)
    return readers.lines(spark, path).groupBy(text.content_key("value").alias("line_key")).agg(F.count(F.lit(1)).alias("n"))


_PASTED = "CASE doc_id % 4 WHEN 0 THEN text || chr(10) || ' EOF ' || chr(10) || 'the rest' WHEN 1 THEN text || chr(10) || 'eof' WHEN 2 THEN 'EOF' || chr(10) || text ELSE text END"
_LINES = "string_split(t, chr(10))"
_AT = f"list_position(list_transform({_LINES}, lambda l: upper(trim(l, ' ' || chr(9) || chr(13)))), 'EOF')"


@query(f"""WITH p AS (SELECT doc_id, {_PASTED} AS t FROM documents), q AS (SELECT doc_id, CASE WHEN {_AT} > 0 THEN array_to_string(list_slice({_LINES}, 1, {_AT} - 1), chr(10)) ELSE t END AS query FROM p)
SELECT doc_id, md5(query) AS query_key FROM q WHERE {sql.has('query', f'[^{text.SPACE}]')}""")
def pasted_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before the end marker of each pasted query."""
    pasted = readers.table(spark, sf_dir, "documents").select("doc_id", F.expr(_PASTED).alias("value"))
    return readers.typed_queries(pasted).select("doc_id", text.content_key("query").alias("query_key"))


@query(f"""WITH {sql.COMMENTS} SELECT comment_id, md5('===== TP (PR ' || pr_number::STRING || ' • window #' || comment_id::STRING || ') =====' || chr(10) || 'FILE  : ' || filename || chr(10) || 'LABEL : ' || {_SHOWN} || chr(10)
 || repeat('-', 40) || ' DIFF' || chr(10) || {_RIGHT} || chr(10) || repeat('-', 15) || ' COMMENT' || chr(10) || {sql.strip('comment_text')} || chr(10) || repeat('=', 60)) AS block_key FROM c""")
def readable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each comment, as people read them."""
    c = sql.comments(spark, sf_dir)
    block = sinks.block(F.col("comment_id"), F.lit("TP"), F.col("pr_number"), F.col("filename"), F.col("labels"), F.col("diff_text"), F.col("comment_text"))
    return c.select("comment_id", text.content_key(block).alias("block_key"))


_TAGGED = "'[FILE]' || filename || ' [LABEL]' || labels || ' ' || diff_text"


@query(f"""WITH {sql.COMMENTS}, t AS (SELECT comment_id, comment_text, {_TAGGED} AS t FROM c)
SELECT comment_id, md5(repeat('=', 60) || chr(10) || 'Example #' || comment_id::STRING || chr(10) || 'True   : 1' || chr(10) || 'Pred   : 0   (p_pos=' || printf('%.3f', (comment_id % 9) / 8.0) || ')' || chr(10) || chr(10)
 || 'FILE   : ' || {sql.strip(f'regexp_extract(t, {_REGEX}, 1)')} || chr(10) || 'LABEL  : ' || {sql.strip(f'regexp_extract(t, {_REGEX}, 2)')} || chr(10) || chr(10) || repeat('-', 60) || ' DIFF' || chr(10)
 || {sql.gsub(f'regexp_extract(t, {_REGEX}, 3)', rf'[{text.SPACE}]+' + chr(92) + 'z')} || chr(10) || chr(10) || repeat('-', 60) || ' COMMENT' || chr(10) || {sql.strip('comment_text')}) AS block_key FROM t WHERE regexp_matches(t, {_REGEX})""")
def scored_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each scored row, its file and labels taken from the tags before the diff."""
    c = sql.comments(spark, sf_dir).select("comment_id", "comment_text", text.with_prefix("filename", "labels", "diff_text").alias("t"))
    block = sinks.example(F.col("comment_id"), F.lit(1), F.lit(0), (F.col("comment_id") % 9) / F.lit(8.0), F.col("t"), F.col("comment_text"))
    return c.select("comment_id", text.content_key(block).alias("block_key"))


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY value DESC, event_id) - 1 AS row_no, event_id, event_type FROM events)
SELECT event_id, row_no, md5(repeat('=', 60) || chr(10) || 'Example #' || row_no::STRING || chr(10) || 'True   : 1' || chr(10) || 'Pred   : 0   (p_pos=0.500)' || chr(10) || chr(10) || 'FILE   : ' || chr(10) || 'LABEL  : ' || chr(10) || chr(10)
 || repeat('-', 60) || ' DIFF' || chr(10) || event_type || chr(10) || chr(10) || repeat('-', 60) || ' COMMENT' || chr(10) || event_type) AS block_key FROM e""")
def numbered_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of a table in an order, numbered from 0."""
    placed = ranking.ordered(readers.table(spark, sf_dir, "events").select("event_id", "event_type", "value"), F.desc("value"), "event_id")
    block = sinks.example(F.col("row_no"), F.lit(1), F.lit(0), F.lit(0.5), F.col("event_type"), F.col("event_type"))
    return placed.select("event_id", "row_no", text.content_key(block).alias("block_key"))


@query("SELECT event_type, count(DISTINCT user_id) AS n, md5(string_agg(DISTINCT 'user ' || user_id::STRING, '|' ORDER BY 'user ' || user_id::STRING)) AS lines_key FROM events GROUP BY event_type")
def routed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, one of each key, in a folder for each route; read back as lines."""
    path, e = f"{work.shared_folder(spark, 'routed')}/blocks", readers.table(spark, sf_dir, "events")
    sinks.blocks(e, F.concat(F.lit("user "), F.col("user_id").cast("string")), path, "event_type", "user_id", routed="event_type")
    found = spark.read.text(path).groupBy("event_type").agg(F.array_sort(F.collect_list("value")).alias("lines"))
    return found.select("event_type", F.size("lines").cast("long").alias("n"), text.content_key(F.array_join("lines", "|")).alias("lines_key"))
