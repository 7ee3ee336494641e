import math
from collections import Counter, defaultdict

import duckdb
import pytest

from revmine.llm import mixing, queries

from .fixtures import awkward, by_id, empty, words


def targets(sizes):
    """The definition: weights 5, 2, 1 in turn; excess over twice a source reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return out | {s: rate * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(docs, got):
    sizes, count = defaultdict(int), Counter()
    for r in docs:
        sizes[r["source"]] += len(words(r["text"]))
    want = targets(sizes)
    source = {}
    for r in docs:
        source[r["doc_id"]] = (r["source"], len(words(r["text"])))
    for r in got:
        s, n = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[s]) and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * n
        count[s] += r["taken"]
    for s in sizes:
        assert count[s] == math.floor(want[s] + 1e-6) or count[s] == math.floor(want[s] - 1e-6)


def test_awkward_table(spark):
    docs = awkward(spark)
    got = mixing.mix_table(docs).collect()
    assert len(got) == docs.count()
    check(docs.collect(), got)
    assert mixing.mix_table(empty(spark)).collect() == [] and mixing.mix(empty(spark)).collect() == []


def test_query_matches_sql_and_reruns_agree(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = queries.op7_source_mixing(spark, sf)
    cols = ["doc_id", "size", "source_size", "taken", "epochs"]
    got = by_id(rows.select(cols).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({mixing.ORACLE})").fetchall(), key=repr)
    assert got == by_id(queries.op7_source_mixing(spark, sf).select(cols).collect())
    check(spark.read.parquet(f"{sf}/documents.parquet").collect(), rows.collect())


def test_epochs_before_fractions_and_quality_weights(spark):
    rows = [(i, "word " * 10 if i % 2 else "longerword " * 60, "a" if i < 400 else "b") for i in range(800)]
    docs = awkward(spark, rows)
    got = {r["doc_id"]: r for r in mixing.mix_table(docs).collect()}
    for source in ("a", "b"):
        own = [got[i] for i, _, s in rows if s == source]
        assert len({r["epochs"] for r in own}) == 1
        partly = [r for r in own if r["epochs"] * r["size"] < r["taken"] < (r["epochs"] + 1) * r["size"]]
        assert len(partly) <= 1
        extra = [r["taken"] - r["epochs"] * r["size"] > 0 for r in own]
        heavy, light = [e for e, r in zip(extra, own) if r["size"] == 60], [e for e, r in zip(extra, own) if r["size"] == 10]
        if any(extra) and not all(extra):
            assert sum(heavy) / len(heavy) > sum(light) / len(light)


def test_mix_gives_rows_by_epoch(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["doc_id"]: r["epochs"] + (r["taken"] > r["epochs"] * r["size"]) for r in mixing.mix_table(docs).collect()}
    got = mixing.mix(docs)
    count = Counter(r["doc_id"] for r in got.collect())
    assert got.columns == docs.columns
    assert all(count[i] == n for i, n in want.items() if n) and sum(count.values()) == sum(want.values())


def test_no_python_on_the_way(spark):
    plan = mixing.mix_table(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
