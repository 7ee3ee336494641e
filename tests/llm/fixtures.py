"""Small awkward tables, and how results are compared."""

from __future__ import annotations

import hashlib
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, fp string, batch double, word string"
LONG = "Long words keep coming, and then some more of them. " * 4000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "b"),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank today", "b"),
    (3, "the quick brown fox jumps over the lazy dog near the river bank todaY", None),
    (4, None, "a"),
    (5, "", "a"),
    (6, "   \t\n ", "a"),
    (7, "Überraschung: ÄÖÜ naïve café — 北京 日本語 \U0001f600 <|endoftext|> end", "c"),
    (8, LONG, "hot"),
    (9, LONG + "end", "hot"),
    (10, "a", "b"),
    (10, "a", "b"),
    (None, "no id here at all", "b"),
    (12, "don't we'll they've  two  spaces nbsp　wide 123 4567 !!!", "c"),
    (13, "\x00 control \x0b chars \x1c here\r\nand there", "c"),
    (14, "zero width ​ joiner ‍ and combining é marks ퟿", "a"),
]


def awkward(spark, rows=TEXTS):
    made = [(i, t, "en", s, 0, "x", 7, "f", 1.5, "w") for i, t, s in rows]
    return spark.createDataFrame(made, DOCS)


def empty(spark):
    return awkward(spark, [])


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    out, now = [], ""
    for c in text or "":
        if c == " " or "\t" <= c <= "\r":
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return out + [now] if now else out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(text):
    return zlib.crc32(text.encode())


def by_id(rows, name="doc_id"):
    """Rows as a sorted list of plain tuples with the id first."""
    return sorted((tuple(r[c] for c in [name] + [c for c in r.asDict() if c != name]) for r in rows), key=repr)
