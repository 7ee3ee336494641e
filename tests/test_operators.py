import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revmine.functions import declarations, fuzzy, text
from revmine.operators import ann, classify, dataset, encode, evaluate, generic, ingest, knn, pairs, ranking, retrieval, tfidf
from revmine.plans import catalog


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(row[-1], old[j + 1]))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc d", max_size=90), st.text("abc d", max_size=90))
def test_bit_parallel_count(a, b):
    assert fuzzy.common_length(a, b) == longest(a, b)


def test_native_ratios_match_python(spark):
    rng = np.random.default_rng(0)
    words = ["fix", "the", "test", "please", "naïve", "a", "ok", "thanks", "typo"]
    texts = ["", "a", "fixed", "fixd", "thank you"] + [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(60)]
    pairs = [(x, y) for x in texts[:12] for y in texts if min(len(x), len(y)) <= fuzzy.NATIVE]
    df = spark.createDataFrame(pairs, "n string, p string")
    for r in df.select("n", "p", fuzzy.ratio("n", "p").alias("r"), fuzzy.token_set_ratio("n", "p").alias("t"), fuzzy.ratio_long("n", "p").alias("rl"), fuzzy.token_set_ratio_long("n", "p").alias("tl")).collect():
        total = len(r["n"]) + len(r["p"])
        assert r["r"] == pytest.approx(200 * longest(r["n"], r["p"]) / total if total else 100) == r["rl"]
        assert r["t"] == pytest.approx(fuzzy.token_set_ratio_of(r["n"], r["p"])) == r["tl"]


def test_token_set_ratio_by_hand():
    f = fuzzy.token_set_ratio_of
    assert f("", "a") == 0 and f("a b", "a") == 100 and f("b a a", "a b") == 100
    assert f("abc", "abd") == pytest.approx(100 * 4 / 6)
    assert f("fix test", "fix tests") == pytest.approx(max(100 * (1 - 1 / 17), 100 * (1 - 5 / (3 + 8)), 100 * (1 - 6 / (3 + 9))))


def is_generic(t, phrases):
    for p, cap in phrases.items():
        d = max(2, min(4, int(len(p) * 0.2)))
        if (cap and p in t.split() and len(t) <= cap) or t == p or (abs(len(t) - len(p)) <= d and fuzzy.token_set_ratio_of(t, p) >= 80) or (len(t) > len(p) + d and fuzzy.ratio_of(t, p) >= 92):
            return True
    return False


def test_generic_matches_the_rules(spark):
    rng = np.random.default_rng(1)
    phrases = [("Thanks", 30), ("please fix this typo", None), ("x" * 70, None), ("", None), ("this is a much longer phrase that has more than sixty two characters in it", None), ("ok", 10), ("ok", 12)]
    table = {"thanks": 30, "please fix this typo": None, "x" * 70: None, "": None, phrases[4][0]: None, "ok": 12}
    base = ["thanks", "please fix this typo", "x" * 70, phrases[4][0], "ok then", "nothing of the kind", ""]
    texts = {"".join(c for c in b if rng.random() > drop) + more for b in base for drop in (0, 0.05, 0.15, 0.3) for more in ("", " s", " and so on", "x")} | {"ok" + " y" * n for n in range(9)}
    texts = {" ".join(t.split()) for t in texts}
    df = spark.createDataFrame([(t,) for t in texts] * 2, "c string")
    got = generic.with_generic(df, spark.createDataFrame(phrases, "phrase string, cap int"), "c").collect()
    assert len(got) == 2 * len(texts) and all(r["generic"] == is_generic(r["c"], table) for r in got)
    none = generic.with_generic(df, spark.createDataFrame([], "phrase string, cap int"), "c")
    assert not any(r["generic"] for r in none.collect())


def test_generic_has_no_product_of_texts_and_phrases(spark):
    df = generic.with_generic(spark.range(5).select(F.col("id").cast("string").alias("c")), generic.default_phrases(spark), "c")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def brute(vectors, queries, k, metric):
    out = []
    for q in queries:
        far = []
        for i, v in vectors.items():
            a, b = np.array(vectors[q]), np.array(v)
            far.append((round(1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), 9) + 0.0 if metric == "cosine" else round(float(((a - b) ** 2).sum()), 9), i))
        out += [(q, i, d, r) for r, (d, i) in enumerate(sorted(far)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
def test_nearest_matches_brute_force(spark, metric, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = {i: rng.standard_normal(6).tolist() for i in range(200)} | {200 + i: [1.0] + [0.0] * 5 for i in range(30)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(5)
    odd = spark.createDataFrame([(900, None), (901, [1.0]), (None, [1.0] * 6)], df.schema)
    monkeypatch.setattr(knn, "MATRIX_CELLS", 70)
    asked = df.filter("vec_id % 23 = 0 OR vec_id = 205")
    names = sorted(r["vec_id"] for r in asked.collect())
    for size in (1 << 20, 100):
        got = sorted(tuple(r[c] for c in ("query_id", "id", "distance", "rank")) for r in knn.nearest(df.unionByName(odd), asked, 7, metric=metric, block_bytes=size).collect())
        assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in brute(vectors, names, 7, metric)]
    assert knn.nearest(df, df.filter("false"), 3).collect() == [] and knn.nearest(df.filter("false"), asked, 3).collect() == []


def test_nearest_takes_string_ids_and_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(8)
    vectors = {f"k{i:03d}": rng.standard_normal(4 if i % 3 else 6).tolist() for i in range(90)}
    df = spark.createDataFrame(list(vectors.items()), "id string, embedding array<double>").repartition(4)
    asked = df.filter("id LIKE '%7'")
    want = []
    for q in [r["id"] for r in asked.collect()]:
        same = {i: v for i, v in vectors.items() if len(v) == len(vectors[q])}
        want += [(a, b, d) for a, b, _, d in brute(same, [q], 5, "cosine")]
    for size in (1 << 20, 100):
        got = knn.nearest(df, asked, 5, id_col="id", query_id="id", block_bytes=size).collect()
        assert sorted((r["query_id"], r["id"], r["rank"]) for r in got) == sorted(want)


def test_index_finds_nine_in_ten_and_all_with_all_cells(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.filter("vec_id % 50 = 0")
    want = {(r["query_id"], r["id"]) for r in knn.nearest(e, q, 10).collect()}
    index = ann.build(e)
    assert index.rows.count() == e.count() and 1 <= index.probes <= len(index.centres) and len(index.centres) > 10
    found = {(r["query_id"], r["id"]) for r in ann.search(index, q, 10).collect()}
    assert len(found & want) >= 0.9 * len(want)
    whole = ann.search(index, q, 10, probes=len(index.centres), block_bytes=5000)
    assert {(r["query_id"], r["id"]) for r in whole.collect()} == want
    rng = np.random.default_rng(3)  # with clusters, few cells do
    centre = rng.standard_normal((25, 16))
    rows = spark.createDataFrame([(i, (centre[i % 25] + 0.15 * rng.standard_normal(16)).tolist()) for i in range(1500)], "vec_id long, embedding array<double>")
    index, q_ = ann.build(rows), rows.filter("vec_id % 50 = 0")
    want = {(r["query_id"], r["id"]) for r in knn.nearest(rows, q_, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in ann.search(index, q_, 10).collect()}
    assert len(found & want) >= 0.9 * len(want) and index.probes <= len(index.centres) // 4
    none = e.filter("false")
    assert ann.search(ann.build(none), q, 3).collect() == [] and ann.search(index, none, 3).collect() == []


def test_new_rows_replace_cached_ones_of_their_version(spark):
    cache = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old"), (None, 1, "old")], "key string, version int, value string")
    new = spark.createDataFrame([("new", 1, "a"), ("new", 4, "b"), ("new", 2, None), ("new", 1, "c")], "value string, version int, key string")
    got = {r["key"]: (r["version"], r["value"]) for r in ingest.upserted(cache, new, "key", "version").collect()}
    assert got == {"a": (1, "new"), "b": (5, "old"), None: (2, "new"), "c": (1, "new")}


def test_features_come_from_the_cache_once_they_are_there(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, "a b a"), (4, None)], "i int, text string")
    first = classify.cached_features(df.filter("i <= 1"), f"{tmp_path}/cache").collect()
    again = {r["i"]: (r["hit"], r["features"]) for r in classify.cached_features(df, f"{tmp_path}/cache").collect()}
    assert not first[0]["hit"] and {i: h for i, (h, _) in again.items()} == {1: True, 2: False, 3: True, 4: False}
    assert again[1][1] == again[3][1] == first[0]["features"] and again[1][1].values.sum() == 3
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 3


def test_filtered_search_falls_back(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.0, 1.0], "a")], "vec_id long, embedding array<double>, place string")
    q = spark.createDataFrame([(10, [1.0, 0.1], "b"), (11, [1.0, 0.1], "zzz"), (12, [1.0, 0.1], None)], df.schema)
    got = {(r["query_id"], r["id"], r["matched"]) for r in knn.nearest_or_any(df, q, 2, "place").collect()}
    assert {x for x in got if x[0] == 10} == {(10, 2, True)} and len({x for x in got if x[0] in (11, 12)}) == 4 and not any(x[2] for x in got if x[0] in (11, 12))


def test_first_hit_is_the_first_that_passes(spark):
    rows = [(1, 10, 1, "Same text", False), (1, 11, 2, "same  TEXT", True), (1, 12, 3, "same text", True), (1, 13, 4, "", True), (2, 10, 1, "same text", True)]
    df = spark.createDataFrame(rows, "query_id long, id long, rank int, said string, ok boolean")
    assert sorted((r["query_id"], r["id"]) for r in retrieval.first_hits(df, F.col("said"), F.col("ok")).collect()) == [(1, 11), (2, 10)]


def pad(items, k):
    """Sequential model: (sim, rank) items in rank order."""
    top = sorted((s for s, _ in items), reverse=True)[:10]
    limit = max(0.75, np.mean(top) + 0.7 * np.std(top))
    kept = [i for i in items if i[0] >= limit]
    for i in items:
        if len(kept) >= k:
            break
        if i not in kept:
            kept.append(i)
    return [r for _, r in kept[:k]]


def test_adaptive_threshold_and_padding(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for q in range(25):
        items = [(float(s), r) for r, s in enumerate(rng.uniform(0.5, 1, rng.integers(1, 16)), 1)]
        rows += [(q, r, s) for s, r in items]
        want[q] = pad(items, 5)
    got = {}
    for r in retrieval.adaptive(spark.createDataFrame(rows, "query_id long, rank int, similarity double"), 5).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["rank"])
    assert got == want


def test_boost_and_feedback(spark):
    df = spark.createDataFrame([("src/Foo.cpp", "a,Bug", 0.5), ("x.py", None, 0.5)], "f string, l string, similarity double")
    got = [r[0] for r in df.select(retrieval.boost(F.col("f"), F.lit("foo"), F.col("l"), F.lit("bug"))).collect()]
    assert got == pytest.approx([0.15, 0.0])
    assert [r[0] for r in df.select(retrieval.boost(F.col("f"), F.lit(""), F.col("l"), None)).collect()] == [0, 0]
    fav = spark.createDataFrame([("src/Foo.cpp", 7)], "key string, fav_count long")
    met = {r["f"]: (r["fav_count"], round(r["final"], 6)) for r in retrieval.with_feedback(df, fav, F.col("f")).collect()}
    assert met == {"src/Foo.cpp": (7, 0.507), "x.py": (0, 0.5)}


def test_row_numbers_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 7)
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3).alias("part"))
    placed, n = ranking.numbered(df, ranking.hash_key(1, F.col("id")), "id")
    got = sorted((r["row_no"], r["id"]) for r in placed.collect())
    order = [r["id"] for r in df.orderBy(ranking.hash_key(1, F.col("id")), "id").collect()]
    assert n == 3000 and ranking.digits_for(3000) >= 2 and [i for _, i in got] == order and [k for k, _ in got] == list(range(3000))


def test_negatives_of_a_hot_review_and_of_one_review(spark):
    rows = [(i, 1, 0, 1, "hot" if i % 3 else f"p{i}", f"c{i}", f"d{i}", f"t{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "record_id long, window_no int, copy_no int, label int, pr_number string, commenter string, diff string, comment string")
    keys = ["record_id", "window_no", "copy_no"]
    got = dataset.negatives(df, keys).collect()
    review = {r[7]: (r[4], r[5]) for r in rows}
    assert len(got) == 90 and all(r["label"] == 0 and review[r["comment"]][0] != r["pr_number"] and review[r["comment"]][1] == r["commenter"] for r in got)
    with pytest.raises(ValueError):
        dataset.negatives(df.filter("pr_number = 'hot'"), keys)


def test_split_sizes_are_exact(spark):
    for n in (0, 1, 9, 10, 101):
        count = Counter(r["part"] for r in dataset.split(spark.range(n).withColumnRenamed("id", "k"), ["k"]).collect())
        assert (count["train"], count["dev"], count["test"]) == (int(n * 0.8), int(n * 0.1), n - int(n * 0.8) - int(n * 0.1))
    named = dataset.examples(dataset.split(spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("label")), ["k"]), "test").first()
    assert named["label"] == "0" and named["guid"].startswith("test-")


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, predicted int")
    row = evaluate.summary(df).first()
    assert (row["acc"], row["precision"], row["recall"], row["f1"], row["acc_and_f1"]) == (1.0, 0.0, 0.0, 0.0, 0.5)
    assert evaluate.best(evaluate.sweep(df.withColumn("prob", F.lit(0.3)))).first()["threshold"] == 0.0
    assert evaluate.confusion_matrix(df).collect()[0].asDict() == {"label": 0, "predicted_0": 2, "predicted_1": 0}


def test_sweep_at_exact_thresholds(spark):
    probs = [i / 100 for i in range(101)] + [0.29, 0.57, 0.58, 1.0, 0.0, -0.5, 1.5]
    df = spark.createDataFrame([(i % 2, p) for i, p in enumerate(probs)], "label int, prob double")
    for r in evaluate.sweep(df).collect():
        assert r["tp"] == sum(i % 2 == 1 and p > r["threshold"] for i, p in enumerate(probs)) and r["fp"] == sum(i % 2 == 0 and p > r["threshold"] for i, p in enumerate(probs))


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "Red fish the blue fish"), (2, "blue fish"), (3, "green a tree"), (4, None)], "doc_id long, text string")
    terms = {1: ["red", "fish", "blue", "fish", "red fish", "fish blue", "blue fish"], 2: ["blue", "fish", "blue fish"], 3: ["green", "tree", "green tree"], 4: []}
    df_ = Counter(t for ts in terms.values() for t in set(ts))
    w = {}
    for d, ts in terms.items():
        raw = {t: n * (math.log(5 / (1 + df_[t])) + 1) for t, n in Counter(ts).items()}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1
        w[d] = {t: x / norm for t, x in raw.items()}
    got = [(r["query_id"], r["doc_id"], r["score"]) for r in tfidf.similar(docs, F.col("doc_id") == 1, 5).collect()]
    assert got == [(1, 2, pytest.approx(sum(w[1][t] * w[2].get(t, 0) for t in w[1]), abs=1e-8))]
    assert sorted(map(tuple, tfidf.similar(docs, F.lit(True), 5, block_bytes=100).select("query_id", "doc_id").collect())) == [(1, 2), (2, 1)]
    assert tfidf.similar(docs.filter("false"), F.lit(True), 5).collect() == []
    assert [r["term"] for r in tfidf.vocabulary(docs.select(tfidf.words("text").alias("words")), 2).collect()] == ["fish", "blue"]


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,)], "w array<string>")
    rows = [r[0] for r in df.select(encode.hashed(F.col("w"), 8)).collect()]
    assert np.linalg.norm(rows[0]) == pytest.approx(1) and max(rows[0]) == pytest.approx(2 / math.sqrt(5)) and not any(rows[1]) and not any(rows[2])
    assert df.select(encode.dual(F.array(F.lit(1.0)), None, 2)).first()[0] == [1.0, 0.0, 0.0]


def test_classifier_learns_saves_and_loads(spark, tmp_path):
    rows = [(i, f"please fix number {i}" if i % 2 else f"thanks all good {i}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, text string, label int")
    model = classify.train(df)
    scored = classify.score(model, df.drop("label")).collect()
    assert all((r["p_keep"] >= 0.5) == bool(r["i"] % 2) for r in scored)
    assert all(r["p_keep"] == pytest.approx(1 / (1 + math.exp(r["logit0"] - r["logit1"]))) for r in scored)
    assert classify.losses(model)[0] > classify.losses(model)[-1]
    assert df.select(classify.feature_key("text")).distinct().count() == 60
    assert df.select(retrieval.combined(F.lit(0.5), F.lit(0.25))).first()[0] == 0.75
    folder = f"file://{tmp_path}"
    assert classify.save_best({"one": model, "two": model}, {"one": 0.9, "two": 0.9}, folder) == "one"
    assert classify.score(classify.load(folder), df).count() == 60
    runs = classify.grid([0.1, 1.0], [5], [64])
    swept = classify.sweep(df, df, runs, {"regular0.1_passes5_features64"}).collect()
    assert [r["run"] for r in swept] == ["regular1.0_passes5_features64"]


def test_upsert_cache_and_anti_join(spark):
    cache = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "key string, v int, embedding string")
    new = spark.createDataFrame([("a", 2, "new"), ("c", 1, "new")], cache.schema)
    assert {(r["key"], r["embedding"]) for r in ingest.upserted(cache, new, "key", "v").collect()} == {("a", "new"), ("b", "old"), ("c", "new")}
    ids = spark.createDataFrame([("a",), ("a",), ("z",)], "id string")
    assert [r["id"] for r in ingest.not_indexed(ids, spark.createDataFrame([("a",)], "id string")).collect()] == ["z"]
    with pytest.raises(ValueError):
        ingest.of_pull(ids, ids, "12a")


CODE = """#include <x>
namespace app { // a namespace
class Foo : public Base {
 public:
  Foo(int a, const char *b = "x;{");
  ~Foo();
  int size() const { int n = 1; return n; }
 private:
  double w_, h_;
};
enum Color { Red, Green = 3 };
typedef struct point { int x; } point_t;
template <typename T> T first(T a) { return a; }
}
static int count = 0;
"""


def test_declarations():
    got = list(declarations.declarations(CODE))
    assert (0, "NAMESPACE", "app") in got and (1, "CLASS_DECL", "Foo") in got and (2, "CONSTRUCTOR", "Foo") in got and (2, "DESTRUCTOR", "~Foo") in got
    assert (2, "CXX_METHOD", "size") in got and (3, "VAR_DECL", "n") in got and (2, "FIELD_DECL", "w_") in got and (2, "FIELD_DECL", "h_") in got
    assert (1, "ENUM_DECL", "Color") in got and (2, "ENUM_CONSTANT_DECL", "Red") in got and (2, "ENUM_CONSTANT_DECL", "Green") in got
    assert (1, "FUNCTION_DECL", "first") in got and (2, "PARM_DECL", "a") in got and (0, "VAR_DECL", "count") in got
    assert declarations.projected("int x;") == "" and declarations.projected("int xyz = 1;") == "(VAR_DECL:xyz)" and declarations.related("int xyz = 1;") == "(CursorKind.VAR_DECL:xyz)"


@settings(max_examples=200, deadline=None)
@given(st.text("abc(){};,=<>:~ \n\"'/*#struct", max_size=80))
def test_broken_code_does_not_fail(code):
    list(declarations.declarations(code))
    declarations.related(code)


def test_the_pair_scorer_learns_which_comments_belong(spark):
    rng = np.random.default_rng(7)
    topics = [[f"{t}{i}name" for i in range(12)] for t in "abcdefgh"]
    draw = lambda t, n: " ".join(rng.choice(topics[t] + ["the", "of", "a"], n))
    rows = []
    for i in range(300):
        t, other = int(rng.integers(8)), int(rng.integers(1, 8))
        rows.append((i, i % 2, draw(t, 20), draw(t if i % 2 else (t + other) % 8, 8)))
    df = spark.createDataFrame(rows + [(900, None, None, None)], "i int, label int, diff string, comment string")
    model = pairs.train(df.filter("i < 200"))
    got = pairs.score(model, df.filter("i >= 200"))
    right = [(r["p_pair"] >= 0.5) == bool(r["label"]) for r in got.collect() if r["label"] is not None]
    assert got.columns == [*df.columns, "p_pair"] and np.mean(right) > 0.9 and got.count() == 101


def test_a_fitted_encoder_weighs_rare_words_more(spark):
    df = spark.createDataFrame([(["the", f"w{i}"],) for i in range(20)] + [([],), (None,)], "w array<string>")
    encode_ = encode.fitted(df, F.col("w"), 32)
    common, rare = (spark.createDataFrame([(x,) for x in ([a], ["the", "w3"])], "w array<string>").select(encode_(F.col("w"))).collect() for a in ("the", "w3"))
    near = lambda rows: abs(float(np.dot(rows[0][0], rows[1][0])))
    assert near(rare) > near(common) and not any(df.select(encode_(F.col("w"))).collect()[-1][0])


def test_equal_vectors_are_searched_once_and_met_k_at_a_time(spark):
    """Many copies on both sides: each query keeps its own rows, ties go to the smallest ids, and few candidates are ranked."""
    rng = np.random.default_rng(11)
    kinds = rng.standard_normal((5, 6))
    vectors = {i: kinds[i % 5].tolist() if i % 3 else rng.standard_normal(6).tolist() for i in range(900)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(3)
    asked = [*range(0, 900, 7)]
    for size in (1 << 20, 200):
        got = knn.nearest(df, df.filter(F.col("vec_id").isin(asked)), 4, block_bytes=size).collect()
        assert sorted((r["query_id"], r["id"], r["rank"]) for r in got) == sorted((a, b, d) for a, b, _, d in brute(vectors, asked, 4, "cosine"))
    assert len(knn.least_ids(np.ones((5000, 6)), np.arange(5000)[::-1].copy(), None, 4)) == 4


def test_rows_that_cannot_be_near_get_no_distance(monkeypatch):
    rng = np.random.default_rng(5)
    queries, rows = rng.standard_normal((8, 16)), rng.standard_normal((3000, 16))
    for metric in ("cosine", "l2sq"):
        m = knn.Metric(queries, metric)
        exact, right, error = m.factors(rows)
        q, r = (x.ravel() for x in np.indices((8, 3000)))
        far = m.pairs(q, exact, r).reshape(8, 3000)
        kth = np.sort(far, axis=1)[:, 4]
        met = m.left @ right.T >= (m.least(kth) - error).astype(m.left.dtype)[:, None]
        assert (met >= (far <= kth[:, None])).all() and met.sum() < 8 * 10


def test_generic_texts_are_met_in_one_pass_or_shuffled_alike(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["LGTM!", "thanks", "a long text " * 40, None, "Fixed in a", "nothing of note"])], "i int, t string")
    run = lambda: generic.with_generic(df, generic.default_phrases(spark), "t")
    once = run()
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "BroadcastHashJoin" in plan and once.columns == ["i", "t", "generic"]
    want = sorted(map(tuple, once.select("i", "generic").collect()))
    monkeypatch.setattr(generic, "FOUND", -1)
    assert sorted(map(tuple, run().select("i", "generic").collect())) == want and any(g for _, g in want)


def test_tfidf_scores_with_and_without_columns(spark, monkeypatch):
    """Random texts and many copies of one: the same results as brute force over the weights, and the copies do not all get a score."""
    rng = np.random.default_rng(3)
    said = {i: " ".join(f"w{int(w)}" for w in rng.zipf(1.4, 30) if w < 400) for i in range(240)} | {i: "copied words here" for i in range(300, 360)}
    docs = spark.createDataFrame(list(said.items()), "doc_id long, text string").repartition(3)
    lists = pa.array([re.findall(r"\w{2,}", t) for t in said.values()], pa.list_(pa.string()))
    d, t, x, names = tfidf.counted(lists, tfidf.STOP_WORDS)
    known = tfidf.vocabulary(docs.select(tfidf.words("text").alias("words")), 500).toArrow()
    d, t, x = tfidf.weigh(lists, known["term"].combine_chunks(), np.log((1 + len(said)) / (1 + known["df"].to_numpy())) + 1)
    m = np.zeros((len(said), 500))
    m[d, t] = x
    ids, want = list(said), []
    for q in (i for i in ids if i % 10 == 0):
        score = np.round(m @ m[ids.index(q)], 9)
        best = sorted((-s, i) for s, i in zip(score, ids) if s > 0 and i != q)[:3]
        want += [(q, i, pytest.approx(-s, abs=2e-9)) for s, i in best]
    for columns, size in ((512, 1 << 20), (7, 4000), (1, 1 << 20)):
        monkeypatch.setattr(tfidf, "COLUMNS", columns)
        got = tfidf.similar(docs, F.col("doc_id") % 10 == 0, 3, most=500, block_bytes=size).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["doc_id"], r["score"]) for r in got] == want


def test_negatives_are_drawn_on_slim_rows(spark, tmp_path, monkeypatch):
    """Texts are written once, with the rows; what the rounds write has numbers and reviews only."""
    seen, own = [], dataset.work.written
    monkeypatch.setattr(dataset.work, "written", lambda df, path: seen.append((path.rsplit("/", 1)[1], df.columns)) or own(df, path))
    rows = [(i, f"p{i % 7}", f"c{i}", f"d{i}", f"t{i}", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, pr_number string, commenter string, diff string, comment string, label int")
    got = dataset.with_negatives(df, ["k"]).collect()
    assert len(got) == 120 and [n for n, c in seen if "diff" in c or "comment" in c] == ["rows"] and any(n.startswith("round") for n, _ in seen)
    assert all(r["diff"] == f"d{r['k']}" and (r["comment"] == f"t{r['k']}") == bool(r["label"]) for r in got)


def test_pair_features_may_come_without_their_texts(spark):
    df = spark.createDataFrame([(i, i % 2, "alpha beta gamma", "alpha beta" if i % 2 else "delta") for i in range(40)], "i int, label int, diff string, comment string")
    model = pairs.train(df)
    slim = pairs.features(df).drop("diff", "comment")
    assert sorted(map(tuple, pairs.score(model, slim).select("i", "p_pair").collect())) == sorted(map(tuple, pairs.score(model, df).select("i", "p_pair").collect()))
    assert pairs.score(model, slim).columns == ["i", "label", "p_pair"] and pairs.train(slim).stages[1].coefficients == model.stages[1].coefficients


@pytest.mark.parametrize("most", [0, 3, 400_000])
def test_merged_keys_are_those_of_merged(spark, most):
    """Digests of what merged(frequencies()) gives, with null, blank, repeated and clashing texts, however the shared ones are met."""
    texts = [None, None, "", " ", "!!!", "LGTM", "lgtm!", "lgtm!", "L G T M", "l  g\tt\u3000m", "L\xa0g T m.", "only once", "twice", "twice", "\xe9a", "a", "a|b", "a\u2028\x85b", "a b", "\u4e00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = evaluate.merged(evaluate.frequencies(df, "t"), text.merge_key("comment")).select(text.content_key("norm"), "total_count", text.content_key(F.array_join("variants", "|")))
    got = evaluate.merged_keys(df, "t", text.merge_key("t"), most)
    assert got.columns == ["norm_key", "total_count", "variants_key"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    once = evaluate.merged_keys(df.filter("t like '%once'"), "t", text.merge_key("t"), most).collect()
    assert [r["total_count"] for r in once] == [1]


def test_near_dup_merge_does_not_order_whole_texts(spark, sf):
    """Digests are counted and merged, so texts of all comments are neither sorted nor collected."""
    plan = catalog.QUERIES["near_dup_merge"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and plan.count("collect_list") <= 1
