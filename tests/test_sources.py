import json

import pytest
from pyspark.sql import functions as F

from revmine.sources import readers, sinks
from revmine.streaming import index


def test_delimited_files_drop_other_arities(spark, tmp_path):
    lines = ["1<CODESPLIT>7<CODESPLIT>me<CODESPLIT>d<CODESPLIT>c", "x<CODESPLIT>7<CODESPLIT>me<CODESPLIT>d<CODESPLIT>", "1<CODESPLIT>too<CODESPLIT>few", "0<CODESPLIT>1<CODESPLIT>2<CODESPLIT>3<CODESPLIT>4<CODESPLIT>5", ""]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    got = readers.with_int_label(readers.labelled(spark, str(tmp_path))).orderBy("comment").collect()
    assert [tuple(r) for r in got] == [(0, "7", "me", "d", ""), (1, "7", "me", "d", "c")]


def test_logits(spark, tmp_path):
    good, bad, few = "1<CODESPLIT>p<CODESPLIT>m<CODESPLIT>d<CODESPLIT>c<CODESPLIT>-1.5<CODESPLIT> 800", "1<CODESPLIT>p<CODESPLIT>m<CODESPLIT>d<CODESPLIT>c<CODESPLIT>x<CODESPLIT>2", "1<CODESPLIT>p"
    (tmp_path / "a.txt").write_text("\n".join([good, bad, few]))
    assert [(r["logit0"], r["logit1"]) for r in readers.logits(spark, str(tmp_path)).collect()] == [(-1.5, 800.0)]
    with pytest.raises(Exception, match="too few fields"):
        readers.logits(spark, str(tmp_path), strict=True).collect()


def test_records_and_salvage(spark, tmp_path):
    rows = [{"pr_number": 1, "title": "a", "comment_text": "ü {x}"}, {"pr_number": 2, "labels": "l"}, {"pr_number": 3}]
    (tmp_path / "whole.json").write_text(json.dumps(rows))
    assert sorted(r["pr_number"] for r in readers.records(spark, str(tmp_path / "whole.json")).collect()) == [1, 2, 3]
    (tmp_path / "cut.json").write_bytes((" \n" + json.dumps(rows, ensure_ascii=False)[:-4]).encode() + b"\x01\xff")
    got = readers.salvage(spark, str(tmp_path / "cut.json")).orderBy("pr_number").collect()
    assert [(r["pr_number"], r["comment_text"]) for r in got] == [(1, "ü {x}"), (2, None)]
    (tmp_path / "none.json").write_text("nothing here")
    assert readers.salvage(spark, str(tmp_path / "none.json")).collect() == []


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\x01b\nc", None), (2, "ü\"q\"", "y")], "i int, t string, u string")
    sinks.records(df, f"{tmp_path}/json")
    assert sorted(map(tuple, spark.read.schema(df.schema).json(f"{tmp_path}/json").collect())) == sorted(map(tuple, df.collect()))
    sinks.sheets({"one": df.filter("i = 2")}, f"{tmp_path}/sheets")
    assert [tuple(r) for r in readers.csv(spark, f"{tmp_path}/sheets/one", "i int, t string, u string").collect()] == [(2, "ü\"q\"", "y")]
    sinks.blocks(df.withColumn("cell", F.lit("fp")), F.col("t"), f"{tmp_path}/blocks", "t", routed="cell")
    assert (tmp_path / "blocks" / "cell=fp").is_dir()
    sinks.index(df, f"{tmp_path}/index")
    sinks.index(df, f"{tmp_path}/index")
    assert spark.read.parquet(f"{tmp_path}/index").count() == 4
    sinks.index(df, f"{tmp_path}/index", rebuild=True)
    assert spark.read.parquet(f"{tmp_path}/index").count() == 2
    sinks.append(df, f"{tmp_path}/parts", "i")
    sinks.csv(df.drop("t"), f"{tmp_path}/csv")
    assert (tmp_path / "parts" / "i=1").is_dir() and readers.csv(spark, f"{tmp_path}/csv", "i int, u string").count() == 2


def test_logs_lines_settings_and_queries(spark, tmp_path):
    for run in ("r1", "r2"):
        sinks.metrics(spark.createDataFrame([(f"acc = 0.{run[1]}",), ("  ",)], "value string"), f"{tmp_path}/logs/{run}")
    assert {(r["run"], r["value"].strip()) for r in readers.metric_logs(spark, f"{tmp_path}/logs/*").collect()} == {("r1", "acc = 0.1"), ("r2", "acc = 0.2"), ("r1", ""), ("r2", "")}
    assert readers.lines(spark, f"{tmp_path}/logs/r1").count() == 1
    (tmp_path / "c.ini").write_text("[range]\nstart = 2025-03-25\n")
    assert readers.settings(str(tmp_path / "c.ini")) == {"range": {"start": "2025-03-25"}}
    with pytest.raises(FileNotFoundError):
        readers.settings(str(tmp_path / "missing.ini"))
    pasted = spark.createDataFrame([("a\nb\nEOF\nc",), ("x\neof",), ("EOF",), ("all of it",)], "value string")
    assert [r["query"] for r in readers.typed_queries(pasted).collect()] == ["a\nb", "x", "all of it"]
    assert [r["query"] for r in readers.typed_queries(pasted, exact=True).collect()] == ["a\nb", "x\neof", "all of it"]


def test_index_stream_adds_each_key_once(spark, tmp_path):
    for k, ids in enumerate((["a", "b"], ["b", "c", "c"])):
        spark.createDataFrame([(i, k) for i in ids], "id string, k int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    like = spark.read.parquet(f"{tmp_path}/in")
    for checkpoint in ("one", "two"):
        index.grow_index(index.source(spark, f"{tmp_path}/in", like), f"{tmp_path}/index", f"{tmp_path}/{checkpoint}").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/index").collect()) == ["a", "b", "c"]
    index.count_feedback(index.source(spark, f"{tmp_path}/in", like), "id", f"{tmp_path}/counts", f"{tmp_path}/three").awaitTermination()
    assert {r["key"]: r["fav_count"] for r in index.latest_counts(spark, f"{tmp_path}/counts").collect()} == {"a": 1, "b": 2, "c": 2}


def test_a_relational_store_is_read_by_a_query_in_parts(spark):
    """An embedded store in this JVM stands for a server."""
    url, driver = "jdbc:derby:memory:reviews;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    try:
        spark._jvm.java.lang.Class.forName(driver)
    except Exception:
        pytest.skip("no embedded store at hand")
    spark.range(100).selectExpr("id", "CAST(id % 7 AS INT) AS pr").write.mode("overwrite").format("jdbc").options(url=url, dbtable="notes", driver=driver).save()
    parts = {"partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "4"}
    got = readers.database(spark, url, 'SELECT * FROM notes WHERE "id" < 90', driver=driver, **parts)
    assert got.rdd.getNumPartitions() == 4 and sorted(r[0] for r in got.collect()) == list(range(90))


def test_windows_drop_rows_that_are_too_late(spark, tmp_path):
    """The third batch brings one row of a window that the watermark had passed before the batch ahead of it, and one of an open window."""
    from datetime import datetime

    at = lambda h, m: datetime(2024, 1, 1, h, m)
    for k, times in enumerate(([at(10, 0), at(12, 0)], [at(12, 5)], [at(10, 5), at(12, 30)])):
        spark.createDataFrame([(t, "x") for t in times], "ts timestamp, kind string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    like = spark.read.parquet(f"{tmp_path}/in/0")
    counts = index.windowed_counts(index.source(spark, f"{tmp_path}/in/*", like), "ts", "kind")
    index.keep_changes(counts, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = {r["hour"]: r["n"] for r in index.latest(spark, f"{tmp_path}/out", "window", "key").select(F.hour("window.start").alias("hour"), "n").collect()}
    assert got == {10: 1, 12: 3}
