"""Declarations of C-family code, by a tolerant scanner.

No compiler front end is needed or asked for: a scanner cuts code at ';', '{' and '}', keeps a stack of scopes
and names what each piece declares. It is an approximation: templates are skipped over, macros are not
expanded, and broken code gives what can be recognised. The scanner is the one part of the text kernel
that runs in Python (Arrow batches); everything before and after it stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|^[ \t]*#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S | re.M)
_TOKEN = re.compile(r"[A-Za-z_]\w*|::|\d[\w.]*|[{}();,=~:<>\[\]]|[^\s\w]")
_NAME = re.compile(r"[A-Za-z_]\w*")
_TYPES = {"class": "CLASS_DECL", "struct": "STRUCT_DECL", "union": "UNION_DECL"}
_ACCESS = {"public", "private", "protected"}
_STATEMENTS = {"return", "if", "else", "for", "while", "do", "switch", "case", "default", "break", "continue", "goto", "throw", "delete", "new", "try", "catch", "using", "friend", "template", "operator", "sizeof", "static_assert"}
SHORTEST = 10


def _without_templates(tokens: list[str]) -> list[str]:
    """Drop 'template <...>' in front."""
    while tokens and tokens[0] == "template":
        depth, at = 0, 1
        while at < len(tokens):
            depth += (tokens[at] == "<") - (tokens[at] == ">")
            at += 1
            if not depth:
                break
        tokens = tokens[at:]
    return tokens


def _groups(tokens: list[str]) -> list[list[str]]:
    """Tokens between commas that stand outside brackets."""
    out, depth = [[]], 0
    for t in tokens:
        depth += (t in "([<") - (t in ")]>")
        if t == "," and depth <= 0:
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


def _declared(tokens: list[str]) -> str | None:
    """The name that 'type name [= value]' declares."""
    head = tokens[: tokens.index("=")] if "=" in tokens else tokens
    head = head[: head.index("[")] if "[" in head else head
    names = [t for t in head if _NAME.fullmatch(t) and t not in ("const", "static", "constexpr", "inline", "mutable", "extern", "volatile")]
    return names[-1] if len(names) >= 2 and head and head[-1] == names[-1] and not _STATEMENTS & set(names) else None


def _function(tokens: list[str]) -> tuple[str, list[str]] | None:
    """Name and parameter tokens of 'type name(...)'."""
    if "(" not in tokens:
        return None
    at = tokens.index("(")
    if not at or not _NAME.fullmatch(tokens[at - 1]) or tokens[at - 1] in _STATEMENTS or "=" in tokens[:at] or _STATEMENTS & set(tokens[:at]):
        return None
    depth, end = 0, at
    while end < len(tokens):
        depth += (tokens[end] == "(") - (tokens[end] == ")")
        if not depth:
            break
        end += 1
    name = tokens[at - 1]
    return ("~" if at > 1 and tokens[at - 2] == "~" else "") + name, tokens[at + 1 : end]


def declarations(code: str) -> Iterator[tuple[int, str, str]]:
    """(depth, kind, name), outer before inner."""
    pending: list[str] = []
    scopes: list[tuple[str, str]] = []  # (kind of scope, name)
    named_after: list[bool] = []  # whether a typedef's name follows the scope
    tokens = _TOKEN.findall(_NOISE.sub(" ", code or ""))
    at, parens = 0, 0

    def header(piece: list[str], opens: bool) -> Iterator[tuple[int, str, str]]:
        depth, (inside, owner) = len(scopes), scopes[-1] if scopes else ("file", "")
        piece = _without_templates(piece)
        while len(piece) > 1 and piece[0] in _ACCESS and piece[1] == ":":
            piece = piece[2:]
        first = piece[0] if piece else ""
        names = [t for t in piece if _NAME.fullmatch(t)]
        if first == "namespace":
            yield depth, "NAMESPACE", names[1] if len(names) > 1 else ""
            return
        if first == "typedef" and not opens and names:
            pointed = [piece[k + 2] for k in range(len(piece) - 2) if piece[k : k + 2] == ["(", "*"] and piece[k + 2] in names]
            yield depth, "TYPEDEF_DECL", pointed[0] if pointed else names[-1]
            return
        if first == "typedef":  # of a type that is declared in place; its name comes after the body
            piece = piece[1:]
        if first == "for" and "(" in piece:
            head = piece[piece.index("(") + 1 :]
            ends = [head.index(t) for t in (";", ":") if t in head]
            if ends and (name := _declared(head[: min(ends)])) is not None:
                yield depth, "VAR_DECL", name
            return
        if first == "using" and "=" in piece and len(names) > 1:
            yield depth, "TYPE_ALIAS_DECL", names[1]
            return
        kind = next((t for t in piece[:3] if t in _TYPES or t == "enum"), None)
        if kind and "(" not in piece and (opens or len(names) == 2):
            after = [t for t in piece[piece.index(kind) + 1 :] if t not in _TYPES]
            named = after[0] if after and _NAME.fullmatch(after[0]) else ""
            yield depth, "ENUM_DECL" if kind == "enum" else _TYPES[kind], named
            return
        found = _function(piece)
        if found and (inside != "function" or opens):
            name, parameters = found
            in_type = inside in _TYPES
            kind = "DESTRUCTOR" if name.startswith("~") else "CONSTRUCTOR" if in_type and name == owner else "CXX_METHOD" if in_type or "::" in piece[: piece.index("(")] else "FUNCTION_DECL"
            if len(piece) and (kind != "FUNCTION_DECL" or piece.index("(") > 1):
                yield depth, kind, name
                for group in _groups(parameters):
                    if (name := _declared(group)) is not None:
                        yield depth + 1, "PARM_DECL", name
            return
        if not opens and not found:
            parts = _groups(piece)
            if parts and (name := _declared(parts[0])) is not None:
                kind = "FIELD_DECL" if inside in _TYPES else "VAR_DECL"
                yield depth, kind, name
                for more in parts[1:]:
                    if more and _NAME.fullmatch(more[0]):
                        yield depth, kind, more[0]

    while at < len(tokens):
        t = tokens[at]
        at += 1
        parens += (t == "(") - (t == ")")
        if t == "{" and parens <= 0:
            found = list(header(pending, True))
            yield from found
            kind, name = (found[0][1], found[0][2]) if found else ("", "")
            if kind == "ENUM_DECL":
                end = tokens.index("}", at) if "}" in tokens[at:] else len(tokens)
                for group in _groups(tokens[at:end]):
                    if _NAME.fullmatch(group[0]):
                        yield len(scopes) + 1, "ENUM_CONSTANT_DECL", group[0]
                at = end
            scope = {v: k for k, v in _TYPES.items()}.get(kind, "namespace" if kind == "NAMESPACE" else "file" if kind == "ENUM_DECL" else "function")
            scopes.append((scope, name))
            named_after.append(pending[:1] == ["typedef"])
            pending, parens = [], 0
        elif t == "}":
            pending, parens = [], 0
            if scopes:
                scopes.pop()
                pending = ["typedef"] if named_after.pop() else []
        elif t == ";" and parens <= 0:
            yield from header(pending, False)
            pending, parens = [], 0
        else:
            pending.append(t)
    if pending and parens <= 0:
        yield from header(pending, False)


def projected(code: str | None, shortest: int = SHORTEST) -> str:
    return " ".join(f"({kind}:{name})" for _, kind, name in declarations(code)) if code and len(code) >= shortest else ""


def related(code: str | None) -> str:
    """Declarations that name an identifier of the code, and what encloses them, with qualified kinds."""
    if not code or not code.strip():
        return ""
    known, found = set(_NAME.findall(code)), list(declarations(code))
    keep, open_ = set(), []
    for k, (depth, _, name) in enumerate(found):
        open_ = [x for x in open_ if found[x][0] < depth] + [k]
        if name.removeprefix("~") in known:
            keep.update(open_)
    return " ".join(f"(CursorKind.{kind}:{name})" for k, (_, kind, name) in enumerate(found) if k in keep)


@F.pandas_udf(StringType())
def projection(code):
    """Column of '(KIND:name)' for every declaration, outer before inner."""
    return code.map(projected)


@F.pandas_udf(StringType())
def related_projection(code):
    return code.map(related)


@F.pandas_udf(ArrayType(StructType().add("depth", IntegerType()).add("kind", StringType()).add("name", StringType())))
def found(code):
    """Column of arrays with a (depth, kind, name) for each declaration."""
    return code.map(lambda c: list(declarations(c or "")))


def gated(code: Column, wanted: Column) -> Column:
    """The projection of rows that are wanted (by file suffix); '' for the others, which the scanner never sees."""
    return F.when(wanted, projection(F.when(wanted, code))).otherwise("")
