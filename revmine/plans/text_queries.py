"""Plans over comment text and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import diff, text
from ..operators import generic
from ..sources import readers
from . import inputs as sql
from .registry import query

_S = sql.strip("comment_text")
_PHRASES = ", ".join(f"({sql.quoted(p)}, {'NULL' if cap is None else cap})" for p, cap in generic.PHRASES)
#: Normalised phrases (p, cap, m, d) and normalised comments (n), then the comments that a phrase makes generic.
_PHRASE_CTE = f"""ph AS (SELECT p, cap, length(p) AS m, greatest(2, least(4, floor(length(p) * 0.2)::INT)) AS d FROM
  (SELECT {sql.words_only('phrase')} AS p, max(cap::INT) AS cap FROM (VALUES {_PHRASES}) AS v(phrase, cap) GROUP BY 1)),
nn AS (SELECT DISTINCT {sql.words_only('comment_text')} AS n FROM c)"""
_X, _Y, _I = "array_to_string(list_sort(list_filter(tn, lambda w: NOT list_contains(tp, w))), ' ')", "array_to_string(list_sort(list_filter(tp, lambda w: NOT list_contains(tn, w))), ' ')", "length(array_to_string(list_sort(list_filter(tn, lambda w: list_contains(tp, w))), ' '))"
_GENERIC_CTE = f"""{_PHRASE_CTE},
pairs AS (SELECT n, p, m, d, length(n) AS ln FROM nn JOIN ph ON length(n) <= greatest(m + d, floor(m * 108 / 92)) AND length(n) >= m - d),
tok AS (SELECT *, list_distinct({sql.split_tokens('n')}) AS tn, list_distinct({sql.split_tokens('p')}) AS tp FROM pairs WHERE abs(ln - m) <= d),
sets AS (SELECT n, tn, tp, {_X} AS x, {_Y} AS y, {_I} AS i FROM tok),
tsr AS (SELECT n, CASE WHEN len(tn) = 0 OR len(tp) = 0 THEN 0.0 WHEN i > 0 AND (x = '' OR y = '') THEN 100.0
  ELSE greatest(100.0 * (1 - (length(x) + length(y) - 2 * {sql.lcs('x', 'y')}) / (length(x) + length(y) + 2 * (i + (i > 0)::INT))::DOUBLE),
    CASE WHEN i > 0 THEN 100.0 * (1 - (1 + length(x)) / (2 * i + 1 + length(x))::DOUBLE) ELSE 0 END, CASE WHEN i > 0 THEN 100.0 * (1 - (1 + length(y)) / (2 * i + 1 + length(y))::DOUBLE) ELSE 0 END) END AS score FROM sets),
gen AS (SELECT n FROM nn JOIN ph ON n = p UNION SELECT n FROM nn JOIN ph ON cap IS NOT NULL AND p <> '' AND length(n) <= cap AND list_contains(string_split(n, ' '), p)
  UNION SELECT n FROM tsr WHERE score >= {generic.NEAR} UNION SELECT n FROM pairs WHERE ln > m + d AND {sql.ratio('n', 'p')} >= {generic.STRICT})"""


@query(f"""WITH {sql.COMMENTS}
SELECT comment_id, (length({_S}) < 5 AND {sql.suggestion(_S)} = '') OR {sql.has(_S, text.TRIVIAL_PREP)} OR NOT {sql.has(_S, '[A-Za-z0-9]')} AS prep, {sql.is_trivial_train('comment_text')} AS train, {sql.has(_S, text.TRIVIAL_PHRASE)} AS phrase,
  CASE WHEN suggestion_text <> '' OR {sql.has(_S, text.REQUEST)} OR ends_with({_S}, '?') THEN false ELSE len({sql.tokens('comment_text')}) < 8 OR {sql.has(_S, text.TRIVIAL_PHRASE)} OR {sql.has(_S, text.TRIVIAL_OPENING)} OR NOT {sql.has(_S, '[A-Za-z0-9]')} END AS intent,
  CASE WHEN suggestion_text <> '' THEN false ELSE len({sql.tokens('comment_text')}) < 5 OR NOT {sql.has(_S, '[A-Za-z0-9]')} END AS short
FROM c""")
def trivial_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five policies on what is a trivial comment."""
    c = sql.comments(spark, sf_dir)
    return c.select("comment_id", text.is_trivial_prep("comment_text").alias("prep"), text.is_trivial_train("comment_text").alias("train"), text.is_trivial_phrase("comment_text").alias("phrase"), text.is_trivial_intent("comment_text", "suggestion_text").alias("intent"), text.is_trivial_short("comment_text", "suggestion_text").alias("short"))


@query(f"WITH {sql.COMMENTS} SELECT comment_id, suggestion_text, md5(CASE WHEN suggestion_text <> '' THEN suggestion_text ELSE comment_text END) AS payload_key FROM c")
def suggestion_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested code, and the payload (suggestion before comment)."""
    return sql.comments(spark, sf_dir).select("comment_id", "suggestion_text", text.content_key(text.payload("comment_text", "suggestion_text")).alias("payload_key"))


@query(f"""WITH {sql.COMMENTS} SELECT comment_id, {sql.has('comment_text', text.TECHNICAL)} AS technical, {sql.has('comment_text', text.SUGGESTING)} AS suggesting, {sql.has('comment_text', text.DESIGN)} AS design FROM c""")
def comment_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sql.comments(spark, sf_dir)
    return c.select("comment_id", text.is_technical("comment_text").alias("technical"), text.is_suggestion("comment_text").alias("suggesting"), text.is_design("comment_text").alias("design"))


@query(f"""WITH {sql.COMMENTS} SELECT comment_id, md5({sql.words_only('comment_text')}) AS n1, md5({sql.gsub(sql.gsub(f"lower({_S})", f'[^a-z0-9{text.SPACE}]+'), f'[{text.SPACE}]+', ' ')}) AS n2, md5({sql.canonical('comment_text')}) AS n3, sha256(comment_text) AS checksum FROM c""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three normal forms and the checksum of a comment."""
    c = sql.comments(spark, sf_dir)
    return c.select("comment_id", text.content_key(text.words_only("comment_text")).alias("n1"), text.content_key(text.merge_key("comment_text")).alias("n2"), text.content_key(text.canonical("comment_text")).alias("n3"), text.checksum("comment_text").alias("checksum"))


@query(f"""WITH {sql.COMMENTS}, {_GENERIC_CTE} SELECT comment_id, {sql.words_only('comment_text')} IN (SELECT n FROM gen) AS generic FROM c""")
def generic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments that a stock phrase makes generic."""
    return generic.with_generic(sql.comments(spark, sf_dir).select("comment_id", "comment_text"), generic.default_phrases(spark), "comment_text").select("comment_id", "generic")


@query(f"""WITH {sql.COMMENTS}, {_GENERIC_CTE}, g AS (SELECT *, {sql.words_only('comment_text')} IN (SELECT n FROM gen) AS generic FROM c)
SELECT comment_id, NOT {sql.is_trivial_train('comment_text')} AND NOT generic AND (length(comment_text) <= 59 OR {sql.has_signal('comment_text')}) AS keep_a,
  suggestion_text <> '' OR (comment_text <> '' AND NOT {sql.is_trivial_train('comment_text')} AND NOT generic AND (length(comment_text) > 59 OR {sql.has_signal('comment_text')})) AS keep_b FROM g""")
def keep_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule A (training) and rule B (retrieval), side by side."""
    c = generic.with_generic(sql.comments(spark, sf_dir).select("comment_id", "comment_text", "suggestion_text"), generic.default_phrases(spark), "comment_text")
    return c.select("comment_id", text.keep_for_training("comment_text", F.col("generic")).alias("keep_a"), text.keep_for_retrieval("comment_text", "suggestion_text", F.col("generic")).alias("keep_b"))


@query(f"""WITH {sql.COMMENTS}, {_PHRASE_CTE}, far AS (SELECT max(d) AS d FROM ph),
best AS (SELECT n, max({sql.ratio('n', 'p')}) AS score FROM nn JOIN ph ON length(n) BETWEEN ceil(m * 80 / 120) AND floor(m * 120 / 80) WHERE length(n) >= 3 AND m > 0 GROUP BY n)
SELECT n, round(score, 6) AS score FROM best WHERE score >= {generic.NEAR} AND (score >= {generic.STRICT} OR EXISTS (SELECT 1 FROM ph, far WHERE abs(length(n) - m) <= far.d))""")
def phrase_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that the fast rule finds generic, with their best ratio to a phrase."""
    texts = sql.comments(spark, sf_dir).select(text.words_only("comment_text").alias("n")).distinct()
    return generic.audit(texts, generic.default_phrases(spark)).select("n", F.round("score", 6).alias("score"))


@query(f"""WITH {sql.COMMENTS}, {_PHRASE_CTE}, far AS (SELECT max(d) AS d FROM ph),
best AS (SELECT n, max({sql.ratio('n', 'p')}) AS score FROM nn JOIN ph ON length(n) BETWEEN ceil(m * 80 / 120) AND floor(m * 120 / 80) WHERE length(n) >= 3 AND m > 0 GROUP BY n),
hit AS (SELECT n, score FROM best WHERE score >= {generic.NEAR} AND (score >= {generic.STRICT} OR EXISTS (SELECT 1 FROM ph, far WHERE abs(length(n) - m) <= far.d))),
t AS (SELECT unnest([93, 90, 85, 80]) AS threshold), r AS (SELECT threshold, n, score, row_number() OVER (PARTITION BY threshold ORDER BY md5('42-' || n), n) AS rn, count(*) OVER (PARTITION BY threshold) AS total FROM hit JOIN t ON score >= threshold)
SELECT threshold, total, n AS sampled FROM r WHERE rn <= 10""")
def phrase_audit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts each threshold would drop, with ten samples in hash order."""
    from pyspark.sql import Window

    texts = sql.comments(spark, sf_dir).select(text.words_only("comment_text").alias("n")).distinct()
    met = generic.audit(texts, generic.default_phrases(spark)).withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, (93, 90, 85, 80))), lambda t: F.col("score") >= t)))
    totals = met.groupBy("threshold").agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy("threshold").orderBy(F.md5(F.concat(F.lit("42-"), "n").cast("binary")), "n")
    first = met.withColumn("rn", F.row_number().over(order)).filter("rn <= 10")
    return first.join(totals, "threshold").select("threshold", "total", F.col("n").alias("sampled"))


@query(f"""WITH {sql.COMMENTS}, f AS (SELECT comment_id, {sql.words_only('comment_text')} AS n FROM c), b AS (SELECT *, 'fixed' AS p FROM f WHERE list_contains(string_split(n, ' '), 'fixed') OR abs(length(n) - 5) <= 2)
SELECT comment_id, length(n) <= 7 AS short, n = p OR (abs(length(n) - 5) <= 2 AND {sql.ratio('n', 'p')} >= 80) OR (length(n) > 7 AND {sql.ratio('n', 'p')} >= 92) AS dropped FROM b""")
def one_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-match rule for one phrase, over the comments that have its word or about its length."""
    n = sql.comments(spark, sf_dir).select("comment_id", text.words_only("comment_text").alias("n"))
    near = n.filter(F.array_contains(F.split("n", " "), "fixed") | (F.abs(F.length("n") - 5) <= 2))
    return near.select("comment_id", (F.length("n") <= 7).alias("short"), generic.is_near_phrase("n", "fixed").alias("dropped"))


_PARTS = "list_filter(string_split(filename, '/'), lambda x: x <> '' AND x <> '.')"
_ROOTED = f"CASE WHEN starts_with(filename, '/') THEN list_prepend('/', {_PARTS}) ELSE {_PARTS} END"
_PLACE = f"CASE WHEN len({_ROOTED}) > 0 THEN 'SUBDIR:' || array_to_string(list_slice({_ROOTED}, 1, 2), '/') ELSE '' END"


@query(f"""WITH {sql.COMMENTS} SELECT comment_id, filename, {_PLACE} AS subdir, {sql.has('lower(filename)', r'\.(?:c|cc|cpp|h|hpp)$')} AS c_family FROM c""")
def subdir_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sql.comments(spark, sf_dir)
    return c.select("comment_id", "filename", text.subdir_token("filename").alias("subdir"), text.is_c_family("filename").alias("c_family"))


@query(f"""WITH d AS (SELECT page_id, chr(1) || html || chr(9) || chr(31) || url || chr(12) AS t FROM pages) SELECT page_id, length(t) - length({sql.gsub('t', text.CONTROL)}) AS removed, md5({sql.gsub('t', text.CONTROL)}) AS cleaned FROM d""")
def control_char_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = readers.table(spark, sf_dir, "pages").select("page_id", F.expr("chr(1) || html || chr(9) || chr(31) || url || chr(12)").alias("t"))
    return t.select("page_id", (F.length("t") - F.length(text.without_controls("t"))).alias("removed"), text.content_key(text.without_controls("t")).alias("cleaned"))


_PREFIXED = "'[FILE]' || filename || ' [LABEL]' || labels || ' ' || comment_text"
_REGEX = sql.quoted(rf"(?s)^\[FILE\](.*?)[{text.SPACE}]+\[LABEL\](.*?)[{text.SPACE}]+(.*)")


@query(f"""WITH {sql.COMMENTS}, p AS (SELECT comment_id, CASE WHEN comment_id % 9 = 0 THEN comment_text ELSE {_PREFIXED} END AS t FROM c),
q AS (SELECT *, regexp_matches(t, {_REGEX}) AS ok, string_split(regexp_replace(t, '(?s)^.*?\\[FILE\\]', ''), ' ') AS w, contains(t, '[FILE]') AS tagged FROM p)
SELECT comment_id, CASE WHEN ok THEN {sql.strip(f'regexp_extract(t, {_REGEX}, 1)')} ELSE '' END AS file, CASE WHEN ok THEN {sql.strip(f'regexp_extract(t, {_REGEX}, 2)')} ELSE '' END AS label,
  md5(CASE WHEN ok THEN {sql.gsub(f'regexp_extract(t, {_REGEX}, 3)', rf'[{text.SPACE}]+' + chr(92) + 'z')} ELSE {sql.strip('t')} END) AS payload,
  CASE WHEN tagged AND len(w) >= 3 THEN w[1] ELSE '(unknown)' END AS split_file, CASE WHEN tagged AND len(w) >= 3 THEN replace(w[2], '[LABEL]', '') ELSE '' END AS split_label,
  md5(CASE WHEN tagged AND len(w) >= 3 THEN array_to_string(list_slice(w, 3, len(w)), ' ') ELSE t END) AS split_payload FROM q""")
def prefix_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File and label tags, built around whole comments and parsed again in both ways."""
    t = sql.comments(spark, sf_dir).select("comment_id", F.when(F.expr("comment_id % 9 = 0"), F.col("comment_text")).otherwise(text.with_prefix("filename", "labels", "comment_text")).alias("t"))
    a, b = text.parse_prefix("t"), text.split_prefix("t")
    return t.select("comment_id", a["file"].alias("file"), a["label"].alias("label"), text.content_key(a["payload"]).alias("payload"), b["file"].alias("split_file"), b["label"].alias("split_label"), text.content_key(b["payload"]).alias("split_payload"))


@query(f"""WITH {sql.COMMENTS} SELECT comment_id, substr(string_split(comment_text, chr(10))[1], 1, 120) AS first_line, substr(replace(comment_text, chr(10), ' '), 1, 200) AS preview, md5(array_to_string(list_slice(string_split(diff_text, chr(10)), 1, 20), chr(10))) AS first_lines, md5(replace(comment_text, chr(10), ' {text.MARK} ')) AS one_line FROM c""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sql.comments(spark, sf_dir)
    return c.select("comment_id", text.first_line("comment_text").alias("first_line"), text.preview("comment_text").alias("preview"), text.content_key(text.first_lines("diff_text")).alias("first_lines"), text.content_key(text.one_line("comment_text")).alias("one_line"))


@query(f"""WITH {sql.COMMENTS}, h AS (SELECT comment_id, {sql.HUNKS} AS hs, diff_text FROM c), g AS (SELECT comment_id, CASE WHEN len(hs) > 0 THEN hs ELSE [diff_text] END AS hs FROM h)
SELECT comment_id, i AS hunk_no, md5(hs[i]) AS hunk FROM (SELECT comment_id, hs, unnest(range(1, len(hs) + 1)) AS i FROM g)""")
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sql.comments(spark, sf_dir).select("comment_id", F.posexplode(diff.hunks("diff_text")).alias("k", "hunk"))
    return c.select("comment_id", (F.col("k") + 1).cast("long").alias("hunk_no"), text.content_key("hunk").alias("hunk"))


@query(f"WITH {sql.COMMENTS} SELECT comment_id, md5({sql.ADDED}) AS added FROM c")
def added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql.comments(spark, sf_dir).select("comment_id", text.content_key(diff.added("diff_text")).alias("added"))


@query(f"""WITH {sql.COMMENTS}, t AS (SELECT comment_id, {sql.tokens('diff_text')} AS tk FROM c), w AS (SELECT *, unnest(range(1, CASE WHEN len(tk) <= 200 THEN 2 ELSE ceil((len(tk) - 200) / 150.0)::INT + 2 END)) AS w FROM t)
SELECT comment_id, w AS window_no, len(list_slice(tk, (w - 1) * 150 + 1, (w - 1) * 150 + 200)) AS n_tokens, md5(coalesce(array_to_string(list_slice(tk, (w - 1) * 150 + 1, (w - 1) * 150 + 200), ' '), '')) AS window_key FROM w""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 200 tokens that overlap by 50."""
    w = diff.windows(sql.comments(spark, sf_dir).select("comment_id", "diff_text"), "diff_text")
    return w.select("comment_id", F.col("window_no").cast("long").alias("window_no"), F.col("window_tokens").cast("long").alias("n_tokens"), text.content_key("window_text").alias("window_key"))


_BODY = "CASE WHEN suggestion_text <> '' THEN suggestion_text ELSE comment_text END"


@query(f"""WITH {sql.COMMENTS} SELECT comment_id, md5({sql.strip(f"{_PLACE} || chr(10) || diff_text || chr(10) || '' || chr(10) || {_BODY}")}) AS index_key,
 md5(filename || ' ||| ' || '' || ' ||| ' || '' || ' ||| ' || labels || ' ||| ' || diff_text || chr(10) || '[AST]' || chr(10) || '[SUGGESTION]' || suggestion_text || chr(10) || '[COMMENT]' || comment_text) AS record_key,
 md5({sql.strip(f"{_PLACE} || chr(10) || diff_text || chr(10) || ''")}) AS query_key FROM c""")
def built_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the documents that go into an index, and of a query's document."""
    c, none = sql.comments(spark, sf_dir), F.lit("")
    body = text.payload("comment_text", "suggestion_text")
    return c.select("comment_id", text.content_key(text.index_document("filename", "diff_text", none, body)).alias("index_key"), text.content_key(text.record_document("filename", none, none, "labels", "diff_text", none, "suggestion_text", "comment_text")).alias("record_key"), text.content_key(text.query_document("diff_text", none, "filename")).alias("query_key"))
