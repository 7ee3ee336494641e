"""Text kernel for review comments: Column functions that stay inside Catalyst.

Patterns are written with explicit character classes, so that the JVM's and an RE2 engine agree on them:
``WORD`` is a letter, digit or underscore of any script and ``SPACE`` is the white space that a Unicode-aware
``strip`` removes. Null text counts as an empty text in every function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_BEYOND = r"\x{100}-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}"


def _class(latin: Callable[[str], bool], beyond: str) -> str:
    """A class of the characters up to U+00FF that ``latin`` picks and of ``beyond``. Java looks single ones up in a table of bits, but calls a test for each range and negation."""
    bits = "".join(rf"\x{i:02X}" for i in range(256) if latin(chr(i)))
    return rf"[[{bits}][\x{{100}}-\x{{10FFFF}}&&[{beyond}]]]"


#: Characters outside SPACE, for Java.
OTHER = _class(lambda c: c not in SPACES, _BEYOND)
_BLANK = _class(lambda c: c in SPACES, r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
#: A run of SPACE that is not one plain blank, characters outside WORD, and characters that merge_key drops.
_UNEVEN = f"{_BLANK}(?:{_BLANK}+|(?<! ))"
_NO_WORD = _class(lambda c: not (c.isalpha() or c.isnumeric() or c == "_"), r"^\p{L}\p{N}")
_NO_KEY = _class(lambda c: c not in SPACES and c not in "abcdefghijklmnopqrstuvwxyz0123456789", _BEYOND)
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
MARK = "⏎"

# Comment length up to which rule A keeps and rule B asks for a signal; shortest comment; and the phrases of the named filters.
SHORT_COMMENT = 59
SHORTEST = 5
TRIVIAL_PREP = (
    rf"(?i)^(?:lgtm[{SPACE}]*[.!]*|looks[{SPACE}]+good[{SPACE}]+to[{SPACE}]+me[{SPACE}]*[.!]*|approved[{SPACE}]*[.!]*|ship[{SPACE}]+it[{SPACE}]*[.!]*"
    rf"|thanks[,!.]*|thank[{SPACE}]+you[,!.]*|done[,!.]*|nit(?:[^{WORD}\n][^\n]*)?|\+1)\z"
)
TRIVIAL_TRAIN = r"(?i)^(?:lgtm|ship it|\+1|thanks?|thank you)[.!]*\z"
TRIVIAL_PHRASE = rf"(?i)^(?:thanks|thank you|lgtm|looks good to me|done|nit|\+1)[{SPACE}!.]*\z"
TRIVIAL_OPENING = rf"(?i)^(?:good catch(?:[^{WORD}\n][^\n]*)?|ah[, ]*great[.!]*|due to(?:[^{WORD}\n][^\n]*)?)\z"
REQUEST = rf"(?i)(?:^|[^{WORD}])(?:please|could you|would you|can you|shall we|let['\x{{2019}}]s)(?:[^{WORD}]|\z)"
SUGGESTING = (
    rf"(?i)(?:^|[^{WORD}])(?:please|can you|ensure|should|could|recommend|consider|need to|we can|can|let'?s|remove|add|refactor|update|optimi[sz]e)(?:[^{WORD}]|\z)"
)
TECHNICAL = rf"[`{WORD}]\.[{WORD}]|`[^`]+`|/[{WORD}]|::|(?:^|[^{WORD}])[A-Za-z_][{WORD}]*\(\)"
DESIGN = rf"(?i)(?:^|[^{WORD}])(?:is it really worth|why can'?t|do we need|should we|perhaps we should|why not)(?:[^{WORD}]|\z)"
C_FAMILY = ("c", "cc", "cpp", "h", "hpp")
SUGGESTION_BLOCK = r"(?is)```suggestion.*?\n(.*?)```"


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.btrim(text(c), F.lit(SPACES))


def tokens(c: Column | str, first: int | None = None) -> Column:
    """White-space tokens; none for a blank text. With ``first``, the first so many of them: no further one is cut out."""
    s = text(c) if first is None else F.regexp_extract(text(c), f"^{_BLANK}*(?:{OTHER}+{_BLANK}+){{0,{first - 1}}}+{OTHER}*", 0)
    return F.array_remove(F.split(even(s), " "), "")


def token_count(c: Column | str) -> Column:
    return F.regexp_count(text(c), F.lit(f"{OTHER}+"))


def even(c: Column | str) -> Column:
    """Runs of white space become one blank."""
    return F.regexp_replace(text(c), _UNEVEN, " ")


def has_alnum(c: Column | str) -> Column:
    return text(c).rlike("[A-Za-z0-9]")


def suggestion(c: Column | str) -> Column:
    """The fenced suggestion blocks, each stripped, with a blank line between; '' if there are none."""
    found = F.regexp_extract_all(text(c), F.lit(SUGGESTION_BLOCK), F.lit(1))
    return F.array_join(F.transform(found, strip), "\n\n")


def is_trivial_prep(c: Column | str) -> Column:
    """Policy T1: under five characters without a suggestion, a stock phrase, or no ASCII letter or digit."""
    s = strip(c)
    return ((F.length(s) < SHORTEST) & (suggestion(s) == "")) | s.rlike(TRIVIAL_PREP) | ~has_alnum(s)


def is_trivial_train(c: Column | str) -> Column:
    """Policy T2: under five characters, no ASCII letter or digit, or thanks and approvals."""
    s = strip(c)
    return (F.length(s) < SHORTEST) | ~has_alnum(s) | s.rlike(TRIVIAL_TRAIN)


def is_trivial_phrase(c: Column | str) -> Column:
    """Policy T3: nothing but a stock phrase."""
    return strip(c).rlike(TRIVIAL_PHRASE)


def is_trivial_intent(c: Column | str, suggested: Column | str) -> Column:
    """Policy T4: a suggestion, a request or a question stays; then short, stock and symbol-only texts go."""
    s = strip(c)
    kept = (text(suggested) != "") | s.rlike(REQUEST) | s.endswith("?")
    return F.when(kept, False).otherwise((token_count(s) < 8) | s.rlike(TRIVIAL_PHRASE) | s.rlike(TRIVIAL_OPENING) | ~has_alnum(s))


def is_trivial_short(c: Column | str, suggested: Column | str) -> Column:
    """Policy T5: a suggestion stays; then texts under five words or without letter or digit go."""
    s = strip(c)
    return F.when(text(suggested) != "", False).otherwise((token_count(s) < 5) | ~has_alnum(s))


def words_only(c: Column | str) -> Column:
    """N1: runs of non-word characters become one space; stripped; lower case."""
    return F.lower(F.trim(F.regexp_replace(text(c), f"{_NO_WORD}+", " ")))


def merge_key(c: Column | str) -> Column:
    """N2: lower case, stripped, ASCII letters, digits and spaces only, white space collapsed (and not stripped again)."""
    return even(F.regexp_replace(F.lower(strip(c)), f"{_NO_KEY}+", ""))


def canonical(c: Column | str) -> Column:
    """N3: white space collapsed, lower case; punctuation stays."""
    return F.lower(F.trim(even(c)))


def is_suggestion(c: Column | str) -> Column:
    return text(c).rlike(SUGGESTING)


def is_technical(c: Column | str) -> Column:
    return text(c).rlike(TECHNICAL)


def is_design(c: Column | str) -> Column:
    return text(c).rlike(DESIGN)


def has_signal(c: Column | str) -> Column:
    return is_technical(c) | is_suggestion(c) | is_design(c)


def keep_for_training(c: Column | str, generic: Column) -> Column:
    """Rule A: short texts stay as they are, long ones need a signal."""
    return ~is_trivial_train(c) & ~generic & ((F.length(text(c)) <= SHORT_COMMENT) | has_signal(c))


def keep_for_retrieval(c: Column | str, suggested: Column | str, generic: Column) -> Column:
    """Rule B: a suggestion stays; short texts need a signal, long ones stay."""
    s = text(c)
    plain = (s != "") & ~is_trivial_train(s) & ~generic & ((F.length(s) > SHORT_COMMENT) | has_signal(s))
    return (text(suggested) != "") | plain


def payload(c: Column | str, suggested: Column | str) -> Column:
    return F.when(text(suggested) != "", text(suggested)).otherwise(text(c))


def path_parts(c: Column | str) -> Column:
    """Parts of a POSIX path: '.' and empty parts go, a root is a part of its own."""
    p = text(c)
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    root = F.when(p.rlike("^//(?:[^/]|$)"), "//").when(p.startswith("/"), "/")
    return F.when(root.isNull(), parts).otherwise(F.concat(F.array(root), parts))


def subdir_token(c: Column | str) -> Column:
    """'SUBDIR:' and the first two parts of the path; '' for an empty path."""
    parts = path_parts(c)
    return F.when(F.size(parts) > 0, F.concat(F.lit("SUBDIR:"), F.array_join(F.slice(parts, 1, 2), "/"))).otherwise("")


def without_controls(c: Column | str) -> Column:
    return F.regexp_replace(text(c), CONTROL, "")


def one_line(c: Column | str) -> Column:
    """Line feeds as visible marks."""
    return F.replace(text(c), F.lit("\n"), F.lit(f" {MARK} "))


def with_prefix(file: Column | str, labels: Column | str, window: Column | str) -> Column:
    return F.concat(F.lit("[FILE]"), text(file), F.lit(" [LABEL]"), text(labels), F.lit(" "), text(window))


def parse_prefix(c: Column | str) -> Column:
    """Struct (file, label, payload) by pattern; without a prefix the stripped text is the payload."""
    pattern, s = rf"(?s)^\[FILE\](.*?)[{SPACE}]+\[LABEL\](.*?)[{SPACE}]+(.*)", text(c)
    at = lambda k: F.regexp_extract(s, pattern, k)
    found = s.rlike(pattern)
    return F.struct(
        F.when(found, strip(at(1))).otherwise("").alias("file"),
        F.when(found, strip(at(2))).otherwise("").alias("label"),
        F.when(found, F.regexp_replace(at(3), rf"[{SPACE}]+\z", "")).otherwise(strip(s)).alias("payload"),
    )


def split_prefix(c: Column | str) -> Column:
    """Struct (file, label, payload) by cutting at single spaces; '(unknown)' where a cut is missing."""
    s = text(c)
    rest = F.split(F.regexp_replace(s, r"(?s)^.*?\[FILE\]", ""), " ", 3)
    found = s.contains("[FILE]") & (F.size(rest) == 3)
    return F.struct(
        F.when(found, F.get(rest, 0)).otherwise("(unknown)").alias("file"),
        F.when(found, F.replace(F.get(rest, 1), F.lit("[LABEL]"), F.lit(""))).otherwise("").alias("label"),
        F.when(found, F.get(rest, 2)).otherwise(s).alias("payload"),
    )


def first_line(c: Column | str, most: int = 120) -> Column:
    return F.substring(F.substring_index(text(c), "\n", 1), 1, most)


def preview(c: Column | str, most: int = 200) -> Column:
    """The first characters, line feeds as spaces."""
    return F.substring(F.replace(text(c), F.lit("\n"), F.lit(" ")), 1, most)


def first_lines(c: Column | str, most: int = 20) -> Column:
    return F.substring_index(text(c), "\n", most)


def is_c_family(c: Column | str, suffixes: tuple[str, ...] = C_FAMILY) -> Column:
    return F.lower(text(c)).rlike(rf"\.(?:{'|'.join(suffixes)})\z")


def content_key(c: Column | str, *more: Column | str) -> Column:
    """md5 of the text (and of what follows it) in UTF-8."""
    return F.md5(F.concat(text(c), *map(text, more)).cast("binary"))


def checksum(c: Column | str) -> Column:
    return F.sha2(text(c).cast("binary"), 256)


def index_document(file: Column | str, diff: Column | str, declarations: Column | str, body: Column | str) -> Column:
    """The retrieval document: directory token, diff, declarations and payload, line by line, stripped."""
    return strip(F.concat_ws("\n", subdir_token(file), text(diff), text(declarations), text(body)))


def record_document(file: Column | str, title: Column | str, description: Column | str, labels: Column | str, diff: Column | str, declarations: Column | str, suggested: Column | str, comment: Column | str) -> Column:
    """The long document: metadata and diff between bars, then declarations, suggestion and comment behind their tags."""
    head = F.concat_ws(" ||| ", text(file), text(title), text(description), text(labels), text(diff))
    tagged = [F.concat(F.lit(f"[{name}]"), text(c)) for name, c in (("AST", declarations), ("SUGGESTION", suggested), ("COMMENT", comment))]
    return F.concat_ws("\n", head, *tagged)


def query_document(diff: Column | str, declarations: Column | str = "", file: Column | str | None = None) -> Column:
    """A query holds no comment: directory token (if a file is named), diff and declarations."""
    ast = F.lit("") if isinstance(declarations, str) and not declarations else text(declarations)
    return strip(F.concat_ws("\n", *([subdir_token(file)] if file is not None else []), text(diff), ast))


def softmax_positive(logit0: Column, logit1: Column) -> Column:
    """P(class 1) of two logits, without overflow at either end."""
    gap = logit0 - logit1
    return F.when(gap >= 0, F.exp(-gap) / (1 + F.exp(-gap))).otherwise(1 / (1 + F.exp(gap)))


def sigmoid(logit: Column) -> Column:
    return F.when(logit >= 0, 1 / (1 + F.exp(-logit))).otherwise(F.exp(logit) / (1 + F.exp(logit)))
