"""Unified diffs: hunks, added lines and overlapping token windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
# Fixed values of the token windows.
WINDOW, OVERLAP = 200, 50


def hunks(c: Column | str) -> Column:
    """Pieces that begin at lines with '@@', and what stands before the first; blank pieces go, and a diff without a piece is one piece."""
    found = F.filter(F.split(text.text(c), "\n(?=@@)"), lambda x: x.rlike(f"[^{text.SPACE}]"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(text.text(c)))


def added(c: Column | str) -> Column:
    """The added lines without their marker; file headers are no added lines."""
    lines = F.filter(F.split(text.text(c), LINE_BREAK), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.array_join(F.transform(lines, lambda x: F.substr(x, F.lit(2))), "\n")


def window_count(n: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    step = window - overlap
    return F.when(n <= window, 1).otherwise(F.floor((n - window + step - 1) / step).cast("int") + 1)


def windows(df: DataFrame, column: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """A row for each window of white-space tokens: window_no (from 1), window_text and window_tokens (their number). The last window reaches the end; a blank text has one empty window.

    A text is tokenised once, and only window texts are exploded: no row carries all the tokens.
    """
    step = window - overlap
    joined = lambda w: F.struct(F.array_join(w, " ").alias("text"), F.size(w).alias("n"))
    part = lambda tokens: lambda k: text.let(F.slice(tokens, (k - 1) * step + 1, F.lit(window)), joined)
    cut = text.let(text.tokens(column), lambda tokens: F.transform(F.sequence(F.lit(1), window_count(F.size(tokens), window, overlap)), part(tokens)))
    out = df.select("*", F.posexplode(cut).alias("window_no", "window_text"))
    return out.withColumns({"window_no": F.col("window_no") + 1, "window_text": F.col("window_text.text"), "window_tokens": F.col("window_text.n")})


def pair_lengths(a: Column, b: Column, most: Column) -> tuple[Column, Column]:
    """Lengths left when the longer of two sequences loses one token at a time (b on ties) until both fit into ``most``."""
    half = F.ceil(most / 2).cast("int")
    left = F.when(a + b <= most, a).otherwise(F.greatest(F.least(a, half), most - b))
    return left, F.when(a + b <= most, b).otherwise(most - left)


def decisive(length: int) -> int:
    """How many ids of b decide pair_features: ``length - 3`` ids of both fit, and one more tells that b does not."""
    return length - 2


def pair_features(a: Column, b: Column, length: int, most_a: int = 50, cls: int = 101, sep: int = 102, pad: int = 0, left_pad: bool = False, cls_last: bool = False) -> Column:
    """Struct (input_ids, input_mask, segment_ids) of two id arrays: [CLS] a [SEP] b [SEP], or CLS last, padded to ``length``.

    An empty b leaves its separator out; the CLS token is of segment 1.
    """
    empty = F.array().cast("array<int>")

    def made(s: Column) -> Column:
        some = lambda ids, n: F.slice(ids, F.lit(1), n)
        tail = F.when(s["lb"] > 0, 1).otherwise(0)
        ids = F.concat(some(s["a"], s["la"]), F.array(F.lit(sep)), F.when(s["lb"] > 0, F.concat(some(s["b"], s["lb"]), F.array(F.lit(sep)))).otherwise(empty))
        segments = F.concat(F.array_repeat(F.lit(0), s["la"] + 1), F.array_repeat(F.lit(1), s["lb"] + tail))
        place = (lambda x, one: F.concat(x, F.array(F.lit(one)))) if cls_last else (lambda x, one: F.concat(F.array(F.lit(one)), x))
        ids, segments = place(ids, cls), place(segments, 1)
        real = s["la"] + s["lb"] + tail + 2
        full = (lambda x, fill: F.concat(F.array_repeat(F.lit(fill), length - real), x)) if left_pad else (lambda x, fill: F.concat(x, F.array_repeat(F.lit(fill), length - real)))
        return F.struct(full(ids, pad).alias("input_ids"), full(F.array_repeat(F.lit(1), real), 0).alias("input_mask"), full(segments, 0).alias("segment_ids"))

    def sized(s: Column) -> Column:
        none, n = F.size(s["b"]) == 0, F.size(s["a"])
        la, lb = pair_lengths(n, F.size(s["b"]), F.lit(length - 3))
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), F.when(none, F.least(n, F.lit(length - 2))).otherwise(la).alias("la"), F.when(none, 0).otherwise(lb).alias("lb"))

    return text.let(F.struct(F.slice(a, 1, most_a).alias("a"), b.alias("b")), lambda s: text.let(sized(s), made))
