"""Indel similarity and token-set similarity of strings.

The longest common subsequence is counted bit-parallel: a pattern of up to 62 characters is one long, and the
text is folded over it with ``aggregate``. Longer patterns go through an Arrow UDF with the same method on
Python integers. Both sides may be swapped, so the shorter one is the pattern.

Expressions are SQL text over two SQL operands: one parse makes what would be hundreds of Column calls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

NATIVE = 62


def let(name: str, value: str, body: str) -> str:
    """body, with value evaluated once however often it is named."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence; the shorter string may have NATIVE characters at most."""
    letters = lambda c: f"filter(split({c}, ''), x -> x <> '')"
    places = "map_from_entries(transform(array_distinct(t.short), c -> struct(c, aggregate(transform(t.short, (x, i) -> if(x = c, shiftleft(1L, i), 0L)), 0L, (bits, one) -> bits | one))))"
    step = let("u", "v & coalesce(element_at(p.places, c), 0L)", "((v + u) | (v - u)) & p.whole")
    folded = let("p", f"struct({places} AS places, shiftleft(1L, size(t.short)) - 1L AS whole)", f"size(t.short) - bit_count(aggregate(t.long, p.whole, (v, c) -> {step}))")
    ordered = "if(size(s.a) > size(s.b), struct(s.b AS short, s.a AS long), struct(s.a AS short, s.b AS long))"
    return let("s", f"struct({letters(a)} AS a, {letters(b)} AS b)", let("t", ordered, f"if(size(t.short) = 0, 0, {folded})"))


def ratio(a: str, b: str) -> Column:
    """Normalised Indel similarity, 0 to 100 (100 for two empty strings), for a shorter side of up to NATIVE characters."""
    return F.expr(f"CASE WHEN length({a}) + length({b}) = 0 THEN 100D ELSE 200D * {lcs(a, b)} / (length({a}) + length({b})) END")


def token_set_ratio(a: str, b: str) -> Column:
    """Token-set similarity, 0 to 100, of two texts with single spaces: what they share counts once; 0 if a side is empty."""
    words = lambda c: f"array_sort(array_distinct(filter(split({c}, ' '), x -> x <> '')))"
    parts = "struct(array_join(array_intersect(w.one, w.two), ' ') AS both, array_join(array_except(w.one, w.two), ' ') AS x, array_join(array_except(w.two, w.one), ' ') AS y)"
    sizes = f"struct(length(q.both) AS i, if(q.both = '', 0, 1) AS gap, length(q.x) AS lx, length(q.y) AS ly, {lcs('q.x', 'q.y')} AS common)"
    shared = lambda n: f"100D * (1 - (z.gap + {n}) / (2 * z.i + z.gap + {n}))"
    best = f"greatest(100D * (1 - (z.lx + z.ly - 2 * z.common) / (z.lx + z.ly + 2 * (z.i + z.gap))), if(z.gap = 1, {shared('z.lx')}, 0D), if(z.gap = 1, {shared('z.ly')}, 0D))"
    scored = let("q", parts, f"CASE WHEN q.both <> '' AND (q.x = '' OR q.y = '') THEN 100D ELSE {let('z', sizes, best)} END")
    return F.expr(let("w", f"struct({words(a)} AS one, {words(b)} AS two)", f"CASE WHEN size(w.one) = 0 OR size(w.two) = 0 THEN 0D ELSE {scored} END"))


def common_length(a: str, b: str) -> int:
    """The bit-parallel count on Python integers, for patterns of any length."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio_of(a: str, b: str) -> float:
    """ratio() of Python strings of any length."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio_of(a: str, b: str) -> float:
    """token_set_ratio() of Python strings of any length."""
    one, two = set(a.split(" ")) - {""}, set(b.split(" ")) - {""}
    if not one or not two:
        return 0.0
    both, x, y = (" ".join(sorted(z)) for z in (one & two, one - two, two - one))
    if both and not (x and y):
        return 100.0
    i, gap = len(both), int(bool(both))
    apart = 100.0 * (1 - (len(x) + len(y) - 2 * common_length(x, y)) / (len(x) + len(y) + 2 * (i + gap)))
    return max([apart] + [100.0 * (1 - (gap + n) / (2 * i + gap + n)) for n in (len(x), len(y)) if both])


@F.pandas_udf(DoubleType())
def ratio_long(a, b):
    import pandas as pd

    return pd.Series([ratio_of(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_set_ratio_long(a, b):
    import pandas as pd

    return pd.Series([token_set_ratio_of(x or "", y or "") for x, y in zip(a, b)], dtype="float64")
