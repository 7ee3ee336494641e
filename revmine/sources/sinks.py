"""Sinks of review data; committers make every write atomic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .readers import DELIMITER


def append(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Rebuild: whatever was there goes."""
    df.write.mode("overwrite").parquet(path)


def records(df: DataFrame, path: str) -> None:
    """JSON lines; null fields are kept, other scripts stay readable."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def delimited(df: DataFrame, *flattened: str, columns: list[str] | None = None) -> DataFrame:
    """(value): the columns of a row with delimiters between, line feeds in the flattened ones as spaces."""
    return df.select(F.concat_ws(DELIMITER, *[F.replace(text.text(c), F.lit("\n"), F.lit(" ")) if c in flattened else text.text(c) for c in columns or df.columns]).alias("value"))


def labelled(rows: DataFrame, path: str) -> None:
    delimited(rows, "diff", "comment", columns=["label", "pr_number", "commenter", "diff", "comment"]).write.mode("overwrite").text(path)


def logits(rows: DataFrame, path: str) -> None:
    delimited(rows, "diff", "comment", columns=["label", "pr_number", "commenter", "diff", "comment", "logit0", "logit1"]).write.mode("overwrite").text(path)


def sheets(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables for spreadsheets: a CSV folder each, control characters removed from strings."""
    for name, df in tables.items():
        clean = df.select(*[F.regexp_replace(c, text.CONTROL, "").alias(c) if kind == "string" else F.col(c).cast("string").alias(c) for c, kind in df.dtypes])
        clean.write.mode("overwrite").csv(f"{folder}/{name}", header=True, escape='"')


# The layouts of the readable blocks below.
def block(number: Column, tag: Column, pull: Column, file: Column, labels: Column, window: Column, comment: Column) -> Column:
    """A readable block: heading, file, label, diff and comment."""
    head = F.format_string("===== %s (PR %s • window #%s) =====", tag, pull.cast("string"), number.cast("string"))
    shown = F.when(text.text(labels) == "", "(none)").otherwise(text.text(labels))
    right = F.regexp_replace(text.text(window), rf"[{text.SPACE}]+\z", "")
    return F.concat_ws("\n", head, F.concat(F.lit("FILE  : "), text.text(file)), F.concat(F.lit("LABEL : "), shown), F.lit("-" * 40 + " DIFF"), right, F.lit("-" * 15 + " COMMENT"), text.strip(comment), F.lit("=" * 60))


def example(number: Column, label: Column, predicted: Column, probability: Column, diff: Column, comment: Column) -> Column:
    """A readable block of a scored row; file and label come from the diff's prefix."""
    p = text.parse_prefix(diff)
    return F.concat_ws(
        "\n", F.lit("=" * 60), F.format_string("Example #%s", number.cast("string")), F.format_string("True   : %s", label.cast("string")), F.format_string("Pred   : %s   (p_pos=%.3f)", predicted.cast("string"), probability), F.lit(""),
        F.concat(F.lit("FILE   : "), p["file"]), F.concat(F.lit("LABEL  : "), p["label"]), F.lit(""), F.lit("-" * 60 + " DIFF"), p["payload"], F.lit(""), F.lit("-" * 60 + " COMMENT"), text.strip(comment),
    )


def blocks(df: DataFrame, value: Column, path: str, *keys: str, routed: str | None = None) -> None:
    """Readable blocks, one of each key; routed names a column whose values become folders."""
    once = df.dropDuplicates(list(keys)) if keys else df
    out = once.select(value.alias("value"), *([routed] if routed else []))
    writer = out.write.mode("overwrite")
    (writer.partitionBy(routed) if routed else writer).text(path)


def index(rows: DataFrame, path: str, rebuild: bool = False) -> None:
    """Add (id, embedding, document, metadata) rows to a vector table, or rebuild it."""
    rows.write.mode("overwrite" if rebuild else "append").parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def metrics(run_lines: DataFrame, path: str) -> None:
    """Append log lines (value) to a run's folder."""
    run_lines.select("value").write.mode("append").text(path)
