"""Plans that make training data, train and score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import declarations, diff, text
from ..operators import classify, dataset, generic, knn, pairs, retrieval
from ..sources import readers, work
from . import inputs as sql
from .registry import query
from .text_queries import _GENERIC_CTE


def _positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = generic.with_generic(sql.comments(spark, sf_dir), generic.default_phrases(spark), "comment_text")
    return dataset.positives(c.withColumnRenamed("comment_id", "record_id"))


_D, _SG, _C = sql.strip("diff_text"), sql.strip("suggestion_text"), sql.strip("comment_text")
_POSITIVES = f"""{sql.COMMENTS}, {_GENERIC_CTE},
r AS (SELECT comment_id AS record_id, pr_number::STRING AS pr_number, commenter, filename, labels, {sql.tokens(_D)} AS tk, {_SG} AS s, {_C} AS t, {sql.words_only('comment_text')} IN (SELECT n FROM gen) AS generic FROM c WHERE {_D} <> ''),
k AS (SELECT *, t <> '' AND t <> s AND NOT {sql.is_trivial_train('t')} AND NOT generic AND (length(t) <= 59 OR {sql.has_signal('t')}) AS stays FROM r),
w AS (SELECT *, unnest(range(1, CASE WHEN len(tk) <= 200 THEN 2 ELSE ceil((len(tk) - 200) / 150.0)::INT + 2 END)) AS window_no FROM k),
x AS (SELECT *, '[FILE]' || filename || ' [LABEL]' || labels || ' ' || coalesce(array_to_string(list_slice(tk, (window_no - 1) * 150 + 1, (window_no - 1) * 150 + 200), ' '), '') AS diff FROM w),
pos AS (SELECT record_id, window_no, copy_no, pr_number, commenter, diff, s AS comment FROM x, (SELECT unnest([1, 2]) AS copy_no) AS two WHERE s <> '' UNION ALL SELECT record_id, window_no, 0, pr_number, commenter, diff, t FROM x WHERE stays)"""
_ORDER = "md5('42-' || record_id::STRING || '-' || window_no::STRING || '-' || copy_no::STRING)"
_IDS = ["record_id", "window_no", "copy_no"]


def _slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives with the keys of diff and comment in their place, for plans whose results have keys: texts are neither written nor shuffled."""
    rows = _positives(spark, sf_dir)
    return rows.withColumns({"diff": text.content_key("diff"), "comment": text.content_key("comment")})


@query(f"WITH {_POSITIVES} SELECT record_id, window_no, copy_no, 1 AS label, pr_number, commenter, md5(diff) AS diff_key, md5(comment) AS comment_key FROM pos")
def make_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of diff window and kept text for each window; suggestions twice."""
    return _positives(spark, sf_dir).select(*_IDS, "label", "pr_number", "commenter", text.content_key("diff").alias("diff_key"), text.content_key("comment").alias("comment_key"))


@query(f"""WITH {_POSITIVES}, num AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}, record_id, window_no, copy_no) - 1 AS row_no FROM pos),
dr AS (SELECT record_id, window_no, copy_no, pr_number, diff, row_no, unnest(range(0, 12)) AS k FROM num),
jj AS (SELECT i.*, ('0x' || substr(md5('42n' || k::STRING || '-' || i.row_no::STRING), 1, 13))::BIGINT % (SELECT count(*) FROM num) AS j FROM dr AS i),
ok AS (SELECT jj.*, p.commenter AS theirs, p.comment AS said, row_number() OVER (PARTITION BY jj.row_no ORDER BY k) AS nth FROM jj JOIN num AS p ON p.row_no = jj.j WHERE p.pr_number <> jj.pr_number)
SELECT record_id, window_no, copy_no, 0 AS label, pr_number, theirs AS commenter, md5(diff) AS diff_key, md5(said) AS comment_key FROM ok WHERE nth = 1""")
def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each positive the same diff with a text of another review."""
    return dataset.negatives(_slim(spark, sf_dir), _IDS).select(*_IDS, "label", "pr_number", "commenter", F.col("diff").alias("diff_key"), F.col("comment").alias("comment_key"))


@query(f"""WITH {_POSITIVES}, num AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}, record_id, window_no, copy_no) - 1 AS row_no, count(*) OVER () AS n FROM pos)
SELECT record_id, window_no, copy_no, row_no, CASE WHEN row_no < floor(n * 0.8) THEN 'train' WHEN row_no < floor(n * 0.8) + floor(n * 0.1) THEN 'dev' ELSE 'test' END AS part FROM num""")
def split_80_10_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.split(_positives(spark, sf_dir).select(_IDS), _IDS).select(*_IDS, "row_no", "part")


_FA = "CASE WHEN a + b <= m THEN a ELSE greatest(least(a, ceil(m / 2.0)::INT), m - b) END"


@query(f"WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS a, (l_partkey % 60)::INT AS b, (l_suppkey % 70)::INT AS m FROM lineitem) SELECT l_orderkey, l_linenumber, {_FA} AS left_a, CASE WHEN a + b <= m THEN b ELSE m - ({_FA}) END AS left_b FROM p")
def truncate_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of two sequences after the longer one lost tokens until both fit."""
    p = readers.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("a"), F.expr("CAST(l_partkey % 60 AS INT)").alias("b"), F.expr("CAST(l_suppkey % 70 AS INT)").alias("m"))
    a, b = diff.pair_lengths(F.col("a"), F.col("b"), F.col("m"))
    return p.select("l_orderkey", "l_linenumber", a.alias("left_a"), b.alias("left_b"))


_IDL = "list_transform({}, lambda w: length(w) + 200)"
_A, _B = _IDL.format(f"list_slice({sql.tokens('diff_text')}, 1, 50)"), _IDL.format(sql.tokens("comment_text"))


@query(f"""WITH {sql.COMMENTS}, t AS (SELECT comment_id, {_A} AS a, {_B} AS b FROM c), l AS (SELECT *, CASE WHEN len(b) = 0 THEN least(len(a), 126) WHEN len(a) + len(b) <= 125 THEN len(a) ELSE greatest(least(len(a), 63), 125 - len(b)) END AS la FROM t),
f AS (SELECT *, CASE WHEN len(a) + len(b) <= 125 OR len(b) = 0 THEN len(b) ELSE 125 - la END AS lb FROM l),
g AS (SELECT comment_id, la, lb, list_concat(list_concat(list_concat([101], list_slice(a, 1, la)), [102]), CASE WHEN lb > 0 THEN list_concat(list_slice(b, 1, lb), [102]) ELSE [] END) AS ids FROM f)
SELECT comment_id, md5(array_to_string(list_concat(ids, list_transform(range(0, 128 - len(ids)), lambda i: 0)), ',')) AS ids_key, len(ids) AS n_real, 1 + CASE WHEN lb > 0 THEN lb + 1 ELSE 0 END AS n_second FROM g""")
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model inputs of (diff, comment) pairs at length 128; token ids are word lengths here."""
    c = sql.comments(spark, sf_dir)
    ids = lambda t, n: F.transform(text.tokens(t, n), lambda w: (F.length(w) + 200).cast("int"))
    f = c.select("comment_id", diff.pair_features(ids("diff_text", 50), ids("comment_text", diff.decisive(128)), 128).alias("f"))
    total = lambda name: F.aggregate(F.col(f"f.{name}"), F.lit(0), lambda acc, x: acc + x)
    return f.select("comment_id", F.md5(F.array_join("f.input_ids", ",").cast("binary")).alias("ids_key"), total("input_mask").alias("n_real"), total("segment_ids").alias("n_second"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = readers.table(spark, sf_dir, "documents"), readers.table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "text", F.col("quality").alias("label"))


@query()
def classifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(keep) of every document from a classifier trained on the labelled ones of an 80 % split."""
    rows = dataset.split(_labelled(spark, sf_dir), ["doc_id"])
    model = classify.train(rows.filter("part = 'train'"))
    return classify.score(model, readers.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "logit0", "logit1", "p_keep")


@query()
def classifier_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a small grid of runs on the held-out part."""
    folder = work.shared_folder(spark, "sweep")
    rows = work.written(dataset.split(_labelled(spark, sf_dir), ["doc_id"]).select("doc_id", "text", "label", "part"), f"{folder}/rows")
    return classify.sweep(rows.filter("part = 'train'"), rows.filter("part <> 'train'"), classify.grid([0.001, 0.1], [10], [1 << 12]))


_CODE = """CASE doc_id % 4 WHEN 0 THEN 'namespace ' || lang || ' { class ' || source || ' : public Base { public: ' || source || '(int a); int size() const { int n = 1; return n; } double ratio, w; }; }'
 WHEN 1 THEN 'static int ' || source || '(const char *p, unsigned n) { for (int i = 0; i < n; ++i) { call(p); } return 0; } // ' || lang
 WHEN 2 THEN 'typedef struct node { int x; int y; } point; enum color { red, green = 3 }; using id = int; template <typename T> T first(T a);'
 ELSE '/* ' || replace(text, '*/', '') || ' */ int ' || source || ' = 1;' END"""
#: What the shapes of _CODE declare, worked out by hand: (shape, place, depth, kind, name); the names of the language and the source stand for themselves.
_DECLARED = """VALUES (0, 1, 0, 'NAMESPACE', 'lang'), (0, 2, 1, 'CLASS_DECL', 'source'), (0, 3, 2, 'CONSTRUCTOR', 'source'), (0, 4, 3, 'PARM_DECL', 'a'), (0, 5, 2, 'CXX_METHOD', 'size'),
 (0, 6, 3, 'VAR_DECL', 'n'), (0, 7, 2, 'FIELD_DECL', 'ratio'), (0, 8, 2, 'FIELD_DECL', 'w'),
 (1, 1, 0, 'FUNCTION_DECL', 'source'), (1, 2, 1, 'PARM_DECL', 'p'), (1, 3, 1, 'PARM_DECL', 'n'), (1, 4, 1, 'VAR_DECL', 'i'),
 (2, 1, 0, 'STRUCT_DECL', 'node'), (2, 2, 1, 'FIELD_DECL', 'x'), (2, 3, 1, 'FIELD_DECL', 'y'), (2, 4, 0, 'TYPEDEF_DECL', 'point'), (2, 5, 0, 'ENUM_DECL', 'color'), (2, 6, 1, 'ENUM_CONSTANT_DECL', 'red'),
 (2, 7, 1, 'ENUM_CONSTANT_DECL', 'green'), (2, 8, 0, 'TYPE_ALIAS_DECL', 'id'), (2, 9, 0, 'FUNCTION_DECL', 'first'), (2, 10, 1, 'PARM_DECL', 'a'), (3, 1, 0, 'VAR_DECL', 'source')"""
_ROWS = f"d AS (SELECT doc_id, place, depth, kind, CASE name WHEN 'lang' THEN lang WHEN 'source' THEN source ELSE name END AS name FROM documents JOIN ({_DECLARED}) AS v(shape, place, depth, kind, name) ON doc_id % 4 = shape)"


@query(f"""WITH {_ROWS}, p AS (SELECT doc_id, string_agg('(' || kind || ':' || name || ')', ' ' ORDER BY place) AS projection, string_agg('(CursorKind.' || kind || ':' || name || ')', ' ' ORDER BY place) AS related FROM d GROUP BY doc_id)
SELECT doc_id, CASE WHEN regexp_matches(lower({sql.FILENAME}), '\\.(?:c|cc|cpp|h|hpp)$') THEN projection ELSE '' END AS projection, related FROM p JOIN documents USING (doc_id)""")
def declaration_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of C-family code as text, behind the suffix gate."""
    d = readers.table(spark, sf_dir, "documents").select("doc_id", F.expr(sql.FILENAME).alias("filename"), F.expr(_CODE).alias("code"))
    return d.select("doc_id", declarations.gated(F.col("code"), text.is_c_family("filename")).alias("projection"), declarations.related_projection(F.col("code")).alias("related"))


@query(f"WITH {_ROWS} SELECT doc_id, depth, kind, name FROM d")
def declaration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as rows (depth, kind, name)."""
    d = readers.table(spark, sf_dir, "documents").select("doc_id", F.expr(_CODE).alias("code"))
    return d.select("doc_id", F.inline(declarations.found("code")))


@query(f"""WITH {_POSITIVES}, num AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}, record_id, window_no, copy_no) - 1 AS row_no FROM pos),
dr AS (SELECT record_id, window_no, copy_no, pr_number, row_no, unnest(range(0, 12)) AS k FROM num),
jj AS (SELECT i.*, ('0x' || substr(md5('42n' || k::STRING || '-' || i.row_no::STRING), 1, 13))::BIGINT % (SELECT count(*) FROM num) AS j FROM dr AS i),
ok AS (SELECT jj.*, p.comment AS said, row_number() OVER (PARTITION BY jj.row_no ORDER BY k) AS nth FROM jj JOIN num AS p ON p.row_no = jj.j WHERE p.pr_number <> jj.pr_number),
u AS (SELECT record_id, window_no, copy_no, 1 AS label, comment FROM pos UNION ALL SELECT record_id, window_no, copy_no, 0, said FROM ok WHERE nth = 1),
z AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || record_id::STRING || '-' || window_no::STRING || '-' || copy_no::STRING || '-' || label::STRING), record_id, window_no, copy_no, label) - 1 AS row_no, count(*) OVER () AS n FROM u)
SELECT record_id, window_no, copy_no, label, md5(comment) AS comment_key, row_no, CASE WHEN row_no < floor(n * 0.8) THEN 'train' WHEN row_no < floor(n * 0.8) + floor(n * 0.1) THEN 'dev' ELSE 'test' END AS part FROM z""")
def split_with_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives and negatives together, in hash order, cut 80 : 10 : 10."""
    rows = dataset.with_negatives(_slim(spark, sf_dir), _IDS).select(*_IDS, "label", F.col("comment").alias("comment_key"))
    return dataset.split(rows, [*_IDS, "label"]).select(*_IDS, "label", "comment_key", "row_no", "part")


@query(f"""WITH k AS (SELECT doc_id, md5(text || '|{classify.FEATURES}') AS key FROM documents), h AS (SELECT DISTINCT key FROM k WHERE doc_id % 2 = 0)
SELECT doc_id, key, key IN (SELECT key FROM h) AS hit FROM k""")
def feature_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all documents, from a cache that the even ones have filled; the others are computed and added."""
    path, d = f"{work.shared_folder(spark, 'features')}/cache", readers.table(spark, sf_dir, "documents").select("doc_id", "text")
    classify.cached_features(d.filter("doc_id % 2 = 0"), path)
    return classify.cached_features(d, path).select("doc_id", "key", "hit")


@query()
def recommender_with_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommender's gate by a trained P(keep): ten times k neighbours, filters, classifier, first hits, 15 best."""
    model = classify.train(_labelled(spark, sf_dir))
    c = generic.with_generic(sql.comments(spark, sf_dir), generic.default_phrases(spark), "comment_text").withColumn("payload", text.payload("comment_text", "suggestion_text"))
    e = readers.table(spark, sf_dir, "embeddings")
    near = knn.nearest(e, e.filter("vec_id % 50 = 0"), 15 * retrieval.FETCH_FEEDBACK)
    met = classify.score(model, near.join(c, F.col("id") == F.col("comment_id")), "payload")
    kept = retrieval.first_hits(met, F.col("payload"), text.keep_for_retrieval("comment_text", "suggestion_text", F.col("generic")) & (F.col("p_keep") >= retrieval.P_KEEP))
    return retrieval.ranked(kept, F.asc("rank")).filter("place <= 15").select("query_id", "id", F.round("p_keep", 6).alias("p_keep"), "place")


@query()
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(the comment belongs to the diff) of held-out pairs, by a scorer trained on positives and negatives."""
    met = pairs.features(dataset.with_negatives(_positives(spark, sf_dir), _IDS)).drop("pr_number", "commenter", "diff", "comment")
    rows = dataset.split(met, [*_IDS, "label"])
    rows = work.written(rows, f"{work.shared_folder(spark, 'pairs')}/rows")
    model = pairs.train(rows.filter("part = 'train'"))
    return pairs.score(model, rows.filter("part <> 'train'")).select(*_IDS, "label", F.round("p_pair", 6).alias("p_pair"))
