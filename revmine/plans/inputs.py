"""Review data made from the given tables, as expressions that Spark and DuckDB both take, and pieces of twin SQL.

Documents serve as comments and diffs: each gets, by its id, one of the shapes that the operators tell apart
(approvals, thanks, suggestion blocks, code references, questions, symbols, long prose). Beside that comment, each document's
whole text is a comment of its own, so that every comment query sees every text from its first to its last character.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import diff, text
from ..sources import readers

COMMENT = """CASE doc_id % 16
 WHEN 0 THEN 'LGTM!'
 WHEN 1 THEN 'Thanks, ' || text
 WHEN 2 THEN 'nit: ' || text
 WHEN 3 THEN 'Could you rename this to `' || lang || '_name`?'
 WHEN 4 THEN text || chr(10) || '```suggestion' || chr(10) || ' int ' || source || ' = ' || CAST(doc_id AS STRING) || '; ' || chr(10) || '```'
 WHEN 5 THEN '```Suggestion (applies)' || chr(10) || lang || '::run();' || chr(10) || '```' || chr(10) || 'or' || chr(10) || '```suggestion' || chr(10) || '```'
 WHEN 6 THEN ' +1 '
 WHEN 7 THEN '!!! ' || chr(9) || '...'
 WHEN 8 THEN 'Why not use ' || lang || '.' || source || '() here'
 WHEN 9 THEN 'Good catch, ' || text
 WHEN 10 THEN 'makes sens'
 WHEN 11 THEN 'Fixed  in ' || source
 WHEN 12 THEN 'thank you!!'
 WHEN 13 THEN 'Please fix the formating of this line'
 ELSE text END"""
FILENAME = "CASE doc_id % 5 WHEN 0 THEN 'lib/' || lang || '/' || source || '.cpp' WHEN 1 THEN './lib//' || source || '.H' WHEN 2 THEN '/usr/include/' || source || '.h' WHEN 3 THEN source || '.py' ELSE 'docs/' || lang || '/' || source || '/a b.md' END"
LABELS = "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'lang:' || lang ELSE 'backend,' || lang END"
DIFF = """CASE doc_id % 7 WHEN 0 THEN text
 WHEN 1 THEN '@@ -1,2 +1,3 @@ ' || source || chr(10) || '+++ b/' || source || chr(10) || '+' || replace(text, chr(10), chr(10) || '+') || chr(10) || '@@ -9 +9 @@' || chr(10) || '-old' || chr(10) || '+new line'
 WHEN 2 THEN '--- a/' || source || chr(10) || '@@ -1 +1 @@' || chr(10) || ' ' || replace(text, '. ', '.' || chr(10) || '+') || chr(10) || '@@' || chr(10) || '-gone'
 ELSE '@@ -1 +1 @@' || chr(10) || '+' || text END"""


#: Ids of the comments that are whole documents begin here; their diffs are short.
WHOLE = 1_000_000_000
WHOLE_DIFF = "'@@ -1 +1 @@' || chr(10) || '+' || source"


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(comment_id, pr_number, commenter, filename, labels, diff_text, comment_text, suggestion_text)."""
    docs = readers.table(spark, sf_dir, "documents")
    made = docs.select(F.col("doc_id").alias("comment_id"), F.expr("doc_id % 97").alias("pr_number"), F.col("source").alias("commenter"), F.expr(FILENAME).alias("filename"), F.expr(LABELS).alias("labels"), F.expr(DIFF).alias("diff_text"), F.expr(COMMENT).alias("comment_text"))
    whole = docs.select((F.col("doc_id") + WHOLE).alias("comment_id"), F.expr("doc_id % 97").alias("pr_number"), F.col("source").alias("commenter"), F.expr(FILENAME).alias("filename"), F.expr(LABELS).alias("labels"), F.expr(WHOLE_DIFF).alias("diff_text"), F.col("text").alias("comment_text"))
    return made.unionByName(whole).withColumn("suggestion_text", text.suggestion("comment_text"))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quoted(pattern)})"


def gsub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def strip(x: str) -> str:
    return gsub(x, rf"^[{text.SPACE}]+|[{text.SPACE}]+\z")


def words_only(x: str) -> str:
    return f"lower(trim({gsub(x, f'[^{text.WORD}]+', ' ')}))"


def canonical(x: str) -> str:
    return f"lower(trim({gsub(x, f'[{text.SPACE}]+', ' ')}))"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {quoted(f'[^{text.SPACE}]+')})"


def suggestion(x: str) -> str:
    blocks = f"regexp_extract_all({x}, {quoted(text.SUGGESTION_BLOCK)}, 1)"
    return f"coalesce(array_to_string(list_transform({blocks}, lambda b: {strip('b')}), chr(10) || chr(10)), '')"


def is_trivial_train(x: str) -> str:
    s = strip(x)
    return f"(length({s}) < {text.SHORTEST} OR NOT {has(s, '[A-Za-z0-9]')} OR {has(s, text.TRIVIAL_TRAIN)})"


def has_signal(x: str) -> str:
    return f"({has(x, text.TECHNICAL)} OR {has(x, text.SUGGESTING)} OR {has(x, text.DESIGN)})"


def lcs(a: str, pattern: str) -> str:
    """LCS of a text and a pattern of up to 62 characters."""
    full = f"((1::BIGINT << length({pattern})) - 1)"
    mask = f"list_sum(list_transform(range(length({pattern})), lambda i: CASE WHEN {pattern}[i + 1] = ch THEN 1::BIGINT << i ELSE 0::BIGINT END))::BIGINT"
    masks = f"list_transform(string_split({a}, ''), lambda ch: {mask})"
    step = f"list_reduce(list_prepend({full}, {masks}), lambda v, u: ((v + (v & u)) | (v - (v & u))) & {full})"
    return f"(CASE WHEN length({pattern}) = 0 OR length({a}) = 0 THEN 0 ELSE length({pattern}) - bit_count({step}) END)"


def ratio(a: str, pattern: str) -> str:
    return f"(CASE WHEN length({a}) + length({pattern}) = 0 THEN 100.0 ELSE 200.0 * {lcs(a, pattern)} / (length({a}) + length({pattern})) END)"


#: Comments in DuckDB: table c.
COMMENTS = f"""c0 AS (SELECT doc_id AS comment_id, doc_id % 97 AS pr_number, source AS commenter, {FILENAME} AS filename, {LABELS} AS labels, {DIFF} AS diff_text, {COMMENT} AS comment_text FROM documents
 UNION ALL SELECT doc_id + {WHOLE}, doc_id % 97, source, {FILENAME}, {LABELS}, {WHOLE_DIFF}, text FROM documents),
c AS (SELECT *, {suggestion('comment_text')} AS suggestion_text FROM c0)"""


def split_tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


#: Hunks of diff_text, as a list (no look-ahead here: marked by a control character first).
HUNKS = "list_filter(string_split(regexp_replace(diff_text, chr(10) || '(@@)', chr(1) || '\\1', 'g'), chr(1)), lambda h: {})".format(has("h", f"[^{text.SPACE}]"))
ADDED = "array_to_string(list_transform(list_filter(regexp_split_to_array(diff_text, {}), lambda l: starts_with(l, '+') AND NOT starts_with(l, '+++')), lambda l: substr(l, 2)), chr(10))".format(quoted(diff.LINE_BREAK))
