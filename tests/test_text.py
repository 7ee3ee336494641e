import re

import pytest
from pyspark.sql import functions as F

from revmine.functions import diff, text
from revmine.sources import sinks

COMMENTS = [None, "", "  ", "+1", "ok", "LGTM", "lgtm...", "Looks  good to me !", "ship it", "thanks", "Thanks,!", "thank you!!", "done.", "nit", "nit: x", "nit: x\nsecond", "nitpick this name", "👍👍", "?!?!?", "abcd", "abcde",
            "Good catch, this was wrong for a long time already", "ah, great!", "due to the change above nothing happens here now", "please rename", "Could you explain?", "let’s go", "x" * 59, "x" * 60, "see `foo` here", "a.b", "café.x", "x² ½ value", "path/to", "std::move", "call()", "is this right?",
            "Is it really worth the cost", "why cant we", "unshouldered", "```suggestion\nint a;\n```", "```Suggestion (x)\n  a\n```\ntext\n```suggestion\nb\n```", "```suggestion\nopen", "a b c", "tab\tand\nline"]


def column(spark, expression, values=COMMENTS):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expression.alias("x")).collect()]


def suggested(t):
    return "\n\n".join(b.strip() for b in re.findall(r"```suggestion.*?\n(.*?)```", t or "", re.S | re.I))


def test_suggestion(spark):
    assert column(spark, text.suggestion("c")) == [suggested(t) for t in COMMENTS]


def test_strip_tokens_and_normal_forms(spark):
    assert column(spark, text.strip("c")) == [(t or "").strip() for t in COMMENTS]
    assert column(spark, text.tokens("c")) == [(t or "").split() for t in COMMENTS]
    assert column(spark, text.token_count("c")) == [len((t or "").split()) for t in COMMENTS]
    assert column(spark, text.canonical("c")) == [" ".join((t or "").split()).lower() for t in COMMENTS]
    assert column(spark, text.words_only("c")) == [re.sub(r"\W+", " ", t or "").strip().lower() for t in COMMENTS]


def test_trivial_policies(spark):
    """The policies as plain patterns of Python's engine."""
    stock = [r"lgtm\s*[.!]*", r"looks\s+good\s+to\s+me\s*[.!]*", r"approved\s*[.!]*", r"ship\s+it\s*[.!]*", r"thanks[,!.]*", r"thank\s+you[,!.]*", r"done[,!.]*", r"nit\b.*", r"\+1"]
    alnum = lambda s: re.search("[A-Za-z0-9]", s)
    full = lambda p, s: re.fullmatch(p, s, re.I)
    phrase = r"(thanks|thank you|lgtm|looks good to me|done|nit|\+1)[\s!.]*"
    for t, prep, train, short_phrase, intent, short in zip(COMMENTS, *(column(spark, e) for e in (text.is_trivial_prep("c"), text.is_trivial_train("c"), text.is_trivial_phrase("c"), text.is_trivial_intent("c", text.suggestion("c")), text.is_trivial_short("c", text.suggestion("c"))))):
        s, block = (t or "").strip(), suggested(t)
        assert prep == bool((len(s) < 5 and not suggested(s)) or any(full(p, s) for p in stock) or not alnum(s)), t
        assert train == bool(len(s) < 5 or not alnum(s) or full(r"(?:lgtm|ship it|\+1|thanks?|thank you)[.!]*", s)), t
        assert short_phrase == bool(full(phrase, s)), t
        asked = block or re.search(r"\b(please|could you|would you|can you|shall we|let['’]s)\b", s, re.I) or s.endswith("?")
        opening = any(full(p, s) for p in (r"good catch\b.*", r"ah[, ]*great[.!]*", r"due to\b.*"))
        assert intent == bool(not asked and (len(s.split()) < 8 or full(phrase, s) or opening or not alnum(s))), t
        assert short == bool(not block and (len(s.split()) < 5 or not alnum(s))), t


def test_signals(spark):
    for t, technical, suggesting, design in zip(COMMENTS, *(column(spark, e) for e in (text.is_technical("c"), text.is_suggestion("c"), text.is_design("c")))):
        s = t or ""
        assert technical == bool(re.search(r"[`\w]+\.\w+|`[^`]+`|/\w+|::|\b[A-Za-z_]\w*\(\)", s)), t
        assert suggesting == bool(re.search(r"\b(please|can you|ensure|should|could|recommend|consider|need to|we can|can|let'?s|remove|add|refactor|update|optimi[sz]e)\b", s, re.I)), t
        assert design == bool(re.search(r"\b(is it really worth|why can'?t|do we need|should we|perhaps we should|why not)\b", s, re.I)), t


def test_keep_rules_have_opposite_length_polarity(spark):
    values = ["short plain words here", "short but please change", "a long text without any signal word that goes on and on and on for sixty", "thanks"]
    no = F.lit(False)
    assert column(spark, text.keep_for_training("c", no), values) == [True, True, False, False]
    assert column(spark, text.keep_for_retrieval("c", F.lit(""), no), values) == [False, True, True, False]
    assert column(spark, text.keep_for_retrieval("c", F.lit("int x;"), F.lit(True)), values) == [True] * 4
    assert column(spark, text.keep_for_training("c", F.lit(True)), values) == [False] * 4


def test_paths(spark):
    import pathlib

    paths = ["", ".", "a", "a/b", "a/b/c.cpp", "/a/b", "//a/b", "///a", "a//b", "./a/./b", "x.H", "x.cc", "x.hxx"]
    want = [(lambda p: f"SUBDIR:{'/'.join(p)}" if p else "")(pathlib.PurePosixPath(p).parts[:2]) for p in paths]
    assert column(spark, text.subdir_token("c"), paths) == want
    assert column(spark, text.is_c_family("c"), paths) == [False, False, False, False, True, False, False, False, False, False, True, True, False]


def test_prefix(spark):
    values = ["[FILE]a.c [LABEL]x,y the  window\n ", "[FILE]a b.c [LABEL]x w", "no tags", "[FILE]f [LABEL]two words w", ""]
    assert [tuple(r) for r in column(spark, text.parse_prefix("c"), values)] == [("a.c", "x,y", "the  window"), ("a b.c", "x", "w"), ("", "", "no tags"), ("f", "two", "words w"), ("", "", "")]
    assert [tuple(r) for r in column(spark, text.split_prefix("c"), values)] == [("a.c", "x,y", "the  window\n "), ("a", "b.c", "[LABEL]x w"), ("(unknown)", "", "no tags"), ("f", "two", "words w"), ("(unknown)", "", "")]


def test_controls_previews_and_probabilities(spark):
    values = ["a\x00b\x08c\td\ne\x0bf\x1f", "one\ntwo\nthree", None]
    assert column(spark, text.without_controls("c"), values) == ["abc\td\nef", "one\ntwo\nthree", ""]
    assert column(spark, text.first_line("c", 2), values)[1] == "on" and column(spark, text.first_lines("c", 2), values)[1] == "one\ntwo"
    assert column(spark, text.preview("c", 6), values)[1] == "one tw" and column(spark, text.one_line("c"), values)[1] == "one ⏎ two ⏎ three"
    pairs = spark.createDataFrame([(0.0, 0.0), (800.0, -800.0), (-800.0, 800.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in pairs.select(text.softmax_positive(F.col("a"), F.col("b"))).collect()] == pytest.approx([0.5, 0.0, 1.0, 0.7310585786])
    assert [r[0] for r in pairs.select(text.sigmoid(F.col("b"))).collect()] == pytest.approx([0.5, 0.0, 1.0, 0.880797078])


def test_hunks_and_added_lines(spark):
    values = ["", "no hunk", "pre\n@@ -1 +1 @@\n+a\n@@ -2 @@\n-b", "@@ x\n \n\n@@ y", "+a\n+++ b/file\n-c\n+\n++d\r\n+e", None]
    assert column(spark, diff.hunks("c"), values) == [[""], ["no hunk"], ["pre", "@@ -1 +1 @@\n+a", "@@ -2 @@\n-b"], ["@@ x\n \n", "@@ y"], [values[4]], [""]]
    assert column(spark, diff.added("c"), values)[4] == "a\n\n+d\ne"


def slide(tokens, size=200, step=150):
    if len(tokens) <= size:
        return [" ".join(tokens)]
    out = []
    for s in range(0, len(tokens), step):
        out.append(" ".join(tokens[s : s + size]))
        if s + size >= len(tokens):
            break
    return out


def test_windows(spark):
    counts = [0, 1, 199, 200, 201, 349, 350, 351, 500, 501, 1000]
    df = spark.createDataFrame([(n, " ".join(f"t{i}" for i in range(n))) for n in counts], "n int, d string")
    got = {}
    for r in diff.windows(df, "d").orderBy("n", "window_no").collect():
        got.setdefault(r["n"], []).append(r["window_text"])
    assert got == {n: slide([f"t{i}" for i in range(n)]) for n in counts}


def pop_longer(a, b, most):
    while a + b > most:
        if a > b:
            a -= 1
        else:
            b -= 1
    return a, b


def test_pair_lengths_of_all_small_cases(spark):
    cases = [(a, b, m) for a in range(12) for b in range(12) for m in range(14)]
    df = spark.createDataFrame(cases, "a int, b int, m int")
    x, y = diff.pair_lengths(F.col("a"), F.col("b"), F.col("m"))
    assert all(tuple(r[3:]) == pop_longer(*r[:3]) for r in df.select("a", "b", "m", x, y).collect())


def test_pair_features(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5]), ([1] * 60, [9] * 60), ([7], [])], "a array<int>, b array<int>")
    rows = [r["f"] for r in df.select(diff.pair_features(F.col("a"), F.col("b"), 12).alias("f")).collect()]
    assert rows[0]["input_ids"] == [101, 1, 2, 3, 102, 4, 5, 102, 0, 0, 0, 0] and rows[0]["segment_ids"] == [1, 0, 0, 0, 0, 1, 1, 1, 0, 0, 0, 0] and rows[0]["input_mask"] == [1] * 8 + [0] * 4
    assert rows[1]["input_ids"] == [101, 1, 1, 1, 1, 1, 102, 9, 9, 9, 9, 102] and rows[2]["input_ids"] == [101, 7, 102] + [0] * 9
    last = df.select(diff.pair_features(F.col("a"), F.col("b"), 10, left_pad=True, cls_last=True).alias("f")).first()["f"]
    assert last["input_ids"] == [0, 0, 1, 2, 3, 102, 4, 5, 102, 101] and last["segment_ids"] == [0, 0, 0, 0, 0, 0, 1, 1, 1, 1]


def test_readable_blocks(spark):
    df = spark.createDataFrame([(3, "POS", 12, "a.c", "", "win  ", " said ")], "n int, tag string, pr int, f string, l string, w string, c string")
    got = df.select(sinks.block(*map(F.col, ("n", "tag", "pr", "f", "l", "w", "c")))).first()[0].split("\n")
    assert got[0] == "===== POS (PR 12 • window #3) =====" and got[1:3] == ["FILE  : a.c", "LABEL : (none)"] and got[4] == "win" and got[6] == "said"
    shown = df.select(sinks.example(F.col("n"), F.lit(1), F.lit(0), F.lit(0.25), text.with_prefix("f", F.lit("x"), "w"), F.col("c"))).first()[0]
    assert "Example #3" in shown and "(p_pos=0.250)" in shown and "FILE   : a.c" in shown and "LABEL  : x" in shown


def test_white_space_by_single_characters_is_that_of_the_class(spark):
    """strip, tokens and merge_key against the class that the twins use, on every character that could matter and on long runs of white space."""
    points = [*range(0x3100), 0xD7FF, 0xE000, 0xFEFF, 0xFFFD, 0x1F600, 0x10FFFF]
    space = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", text.SPACE) + "]")
    assert {chr(p) for p in points if space.match(chr(p))} == set(text.SPACES)
    texts = [f"{chr(p)}a{chr(p)}B{chr(p)}" for p in points] + [" " * 3000 + "x" + " " * 3000 + "\u3000y\x85", " " * 50, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rx = f"^[{text.SPACE}]+|[{text.SPACE}]+\\z"
    old = F.regexp_replace(text.text("t"), rx, "")
    want = [old, F.regexp_extract_all(text.text("t"), F.lit(f"[^{text.SPACE}]+"), F.lit(0)), F.regexp_replace(F.regexp_replace(F.lower(old), f"[^a-z0-9{text.SPACE}]+", ""), f"[{text.SPACE}]+", " ")]
    got = df.select("t", text.strip("t").alias("s"), text.tokens("t").alias("k"), text.merge_key("t").alias("m"), text.token_count("t").alias("n"), *[w.alias(f"w{i}") for i, w in enumerate(want)]).collect()
    assert all((r["s"], r["k"], r["m"], r["n"]) == (r["w0"], r["w1"], r["w2"], len(r["w1"])) for r in got)
    assert "[^" not in text.OTHER


def test_first_tokens_are_those_of_the_whole_text(spark):
    """tokens(c, n) is the beginning of tokens(c), whatever stands between and around tokens and however long one is; nothing behind is cut out."""
    texts = [None, "", " \u3000\n", "a", " a", "a ", "\x85a\u2028b\xa0\x1fc\u200bd\t", "x" * 50000, "x" * 50000 + " y z", " " * 50000 + "a b", "\U0001f600 \xe9\xff \u4e00\u3000\u4e8c w v", "a b c" + " " * 50000, "a b " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.orderBy("i").select("t", *[text.tokens("t", n).alias(f"k{n}") for n in (1, 2, 3, 126)]).collect()
    for r in got:
        for n in (1, 2, 3, 126):
            assert r[f"k{n}"] == (r["t"] or "").split()[:n]


def test_pair_features_are_decided_by_few_tokens(spark):
    """Over all sizes around the cuts: ids of the first decisive() tokens give what the ids of all tokens give, and the plan takes no others."""
    sizes = [(a, b) for a in (0, 1, 2, 3, 4, 5, 6, 9) for b in range(15)]
    ids = F.transform(F.sequence(F.lit(1), F.col("b")), lambda x: x.cast("int"))
    some = spark.createDataFrame(sizes, "a int, b int").withColumns({"x": F.array_repeat(F.lit(7), F.col("a")), "y": F.when(F.col("b") > 0, ids).otherwise(F.array().cast("array<int>"))})
    for length, most in ((10, 4), (9, 6), (8, 3)):
        assert some.filter(diff.pair_features(F.col("x"), F.slice("y", 1, diff.decisive(length)), length, most) != diff.pair_features(F.col("x"), F.col("y"), length, most)).isEmpty()
        assert some.filter(diff.pair_features(F.slice("x", 1, most), F.col("y"), length, most) != diff.pair_features(F.col("x"), F.col("y"), length, most)).isEmpty()


def test_windows_count_their_tokens(spark, sf):
    """window_tokens is what a count over window_text gives, and the plan does not cut the texts of windows into tokens again."""
    from revmine.plans import catalog

    texts = [None, "", "\u2003", "a", "a\n\nb\x85c  d", " ".join("w" * (i % 5 + 1) for i in range(23)), " x\t" * 8]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for window, overlap in ((8, 2), (5, 0), (200, 50)):
        got = diff.windows(df, "t", window, overlap).withColumn("want", text.token_count("window_text")).collect()
        assert len(got) > len(texts) - 1 and all(r["window_tokens"] == r["want"] and r["window_text"].split(" ") == (r["window_text"].split() or [""]) for r in got)
    plan = catalog.QUERIES["token_windows"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_normal_forms_by_tables_of_bits_are_those_of_the_classes(spark):
    """words_only, even and canonical against the classes that the twins use, on every character that could matter, alone, in runs and between letters; no range or negation is tested for Latin-1."""
    points = [*range(0x3100), 0xD7FF, 0xE000, 0xFEFF, 0xFFFD, 0x10400, 0x1D7CE, 0x1F600, 0x10FFFF]
    texts = [f"{chr(p)}a{chr(p)}{chr(p)}B {chr(p)}c{chr(p)} d  e{chr(p)}" for p in points] + [" " * 3000 + "x" + " \n" * 3000 + "y", "  ", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    spaced = F.regexp_replace(text.text("t"), f"[{text.SPACE}]+", " ")
    want = [F.lower(F.trim(F.regexp_replace(text.text("t"), f"[^{text.WORD}]+", " "))), spaced, F.lower(F.trim(spaced))]
    got = df.select(F.array(text.words_only("t"), text.even("t"), text.canonical("t")).alias("got"), F.array(*want).alias("want"))
    assert got.filter("got <> want").isEmpty()
    shown = df.select(text.words_only("t"), text.canonical("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert f"[^{text.WORD}]" not in shown and f"[{text.SPACE}]" not in shown
