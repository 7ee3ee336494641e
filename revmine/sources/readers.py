"""Sources of review data. Every reader gives a DataFrame and leaves splitting, pruning and pushdown to Spark."""

from __future__ import annotations

import configparser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

# Fixed value: the delimiter of labelled text files.
DELIMITER = "<CODESPLIT>"
PULLS = "id long, pr_number long, title string, description string, author string, created_at timestamp, merged_at timestamp, state string, labels string"
FILES = "id long, pr_id long, filename string, diff_text string"
COMMENTS = "id long, pr_id long, commenter string, comment_text string, file_path string, line_number int, created_at timestamp"
RECORD = "pr_number long, title string, description string, filename string, diff_text string, commenter string, comment_text string, suggestion_text string, comment_file_path string, comment_line_num int, comment_created_at string, labels string"
FIELDS = ("label", "pr_number", "commenter", "diff", "comment")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of a relational store; partitionColumn, lowerBound, upperBound and numPartitions split it."""
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) AS q", **options).load()


def records(spark: SparkSession, path: str, schema: str = RECORD, lines: bool = False) -> DataFrame:
    """Review records of JSON arrays (a file is one task) or, better, JSON lines (splittable). Missing fields are null."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def salvaged(content: Column) -> Column:
    """The readable part of a JSON array that was cut off: up to the last '}', without control characters, closed with ']'. Null where there is no array or no '}'."""
    kept = F.regexp_replace(F.regexp_extract(text.without_controls(F.regexp_replace(content, "�", "")), r"(?s)^(.*\})", 1), rf"[{text.SPACE}]+\z", "")
    return F.when(kept.rlike(rf"^[{text.SPACE}]*\["), F.concat(kept, F.lit("\n]")))


def salvage(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records of cut-off JSON arrays. Bytes that are not UTF-8 are dropped; a last record that is incomplete is lost."""
    return from_salvaged(spark.read.option("wholetext", True).text(path), "value", schema)


def from_salvaged(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A row for each record of the arrays in a column."""
    return df.select(F.explode(F.from_json(salvaged(F.col(column)), f"array<struct<{_ddl(schema)}>>")).alias("r")).select("r.*")


def _ddl(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (x.strip().split(" ", 1) for x in schema.split(",")))


def fields(lines: Column, arity: int) -> Column:
    """The delimited fields of a line, or null if there are not ``arity`` of them."""
    parts = F.split(lines, DELIMITER, -1)
    return F.when(F.size(parts) == arity, parts)


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """(label, pr_number, commenter, diff, comment), all strings; lines with another number of fields are dropped. A carriage return ends a line too."""
    return labelled_lines(spark.read.text(path))


def labelled_lines(lines: DataFrame) -> DataFrame:
    cut = lines.select(F.explode(F.split("value", "\r\n|\r")).alias("line")).select(fields(F.regexp_replace("line", rf"^[{text.SPACE}]+|[{text.SPACE}]+\z", ""), len(FIELDS)).alias("f")).filter("f is not null")
    return cut.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(FIELDS)])


def with_int_label(rows: DataFrame) -> DataFrame:
    """Labels as integers, what is none as 0."""
    return rows.withColumn("label", F.coalesce(F.expr("try_cast(label AS int)"), F.lit(0)))


def logits(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Labelled rows with logit0 and logit1. Malformed lines are dropped, or raise if strict."""
    arity = len(FIELDS) + 2
    parts = F.split("value", DELIMITER, -1)
    lines = spark.read.text(path)
    if strict:
        lines = lines.filter(F.assert_true(F.size(parts) >= arity, F.lit("a line has too few fields")).isNull())
    rows = lines.filter(F.size(parts) >= arity).select(parts.alias("f")).select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate((*FIELDS, "logit0", "logit1"))])
    numbers = {"label": "int", "logit0": "double", "logit1": "double"}
    cast = rows.withColumns({n: F.expr(f"try_cast(trim({n}) AS {kind})") for n, kind in numbers.items()})
    return cast.filter(" AND ".join(f"{n} IS NOT NULL" for n in numbers))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines without the blank ones, trailing white space removed."""
    return spark.read.text(path).select(F.regexp_replace("value", rf"[{text.SPACE}]+\z", "").alias("value")).filter("value <> ''")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, escape='"')


def metric_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """(run, value): lines of log files, named by their folder."""
    return spark.read.text(pattern).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"), "value")


def settings(path: str) -> dict[str, dict[str, str]]:
    """An INI file, on the driver."""
    parser = configparser.ConfigParser()
    if not parser.read(path, encoding="utf-8"):
        raise FileNotFoundError(path)
    return {name: dict(parser[name]) for name in parser.sections()}


def typed_queries(pasted: DataFrame, column: str = "value", marker: str = "EOF", exact: bool = False) -> DataFrame:
    """Pasted queries, many at once: what stands before the first line that is the end marker (in any case, unless exact)."""
    end = rf"(?s{'' if exact else 'i'})(?:^|\n)[ \t\r]*{marker}[ \t\r]*(?:\n.*)?\z"
    return pasted.withColumn("query", F.regexp_replace(text.text(column), end, "")).filter(F.regexp_replace("query", f"[{text.SPACE}]", "") != "")
