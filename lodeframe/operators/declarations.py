"""Nested declarations with their extent and first line, by a stack of open scopes.

Strings and comments are blanked out first. Python's scopes are lines' indents (of lines that start no
continuation), those of C#, JavaScript and TypeScript are braces. A declaration waits for its body: the next brace at
its own depth of parentheses, or the end of its statement. What a scope is tells methods from functions, and a call
from a declaration: a name before parentheses declares only as the first one of a member of a class.

Texts are read as a whole, one at a time; a literal regular expression with quotes or braces in it may
mislead the scanner for the rest of its text. Unclosed scopes end with the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.operators import symbols
from lodeframe.shipping import ship

LANGUAGES = ("python", "csharp", "aspnet", "javascript", "typescript")


class Declaration(NamedTuple):
    name: str
    kind: str
    namespace: str | None
    line_start: int
    line_end: int
    signature: str


_PYTHON_BLANKS = re.compile(r'"{3}(?:\\.|[^\\])*?(?:"{3}|\Z)|\'{3}(?:\\.|[^\\])*?(?:\'{3}|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|#[^\n]*', re.DOTALL)
_BRACE_BLANKS = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|@"(?:[^"]|"")*"?|`(?:\\.|[^`\\])*`?|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?', re.DOTALL)
_DEFINED = re.compile(r"[^\S\n]*(?:async\s+)?(def|class)\s+(\w+)")


def python_declarations(text: str) -> list[Declaration]:
    # a line that begins inside a string is marked, so that it is neither blank nor a statement
    hide = lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "#" else re.sub(r"\n", "\n\x01", re.sub(r"[^\n]", "~", m[0]))
    shown, given = _PYTHON_BLANKS.sub(hide, text).split("\n"), text.split("\n")
    out: list[list] = []
    open_: list[tuple[int, list]] = []
    depth, last, joined = 0, 0, False
    for i, line in enumerate(shown):
        starts = depth == 0 and not joined and not line.startswith("\x01") and line.strip() != ""
        if starts:
            indent = len(line) - len(line.lstrip())
            while open_ and open_[-1][0] >= indent:
                open_.pop()[1][3] = last
            if m := _DEFINED.match(line):
                kind = "class" if m[1] == "class" else "method" if indent else "function"
                out.append([m[2], kind, i + 1, i + 1, given[i].strip()])
                open_.append((indent, out[-1]))
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
        joined = line.rstrip().endswith("\\")
        if line.strip():
            last = i + 1
    for _, own in open_:
        own[3] = last
    return [Declaration(n, k, None, a, b, s) for n, k, a, b, s in out]


_TOKEN = re.compile(
    r"(?P<mark>[{}()\[\];=\n])|\bnamespace\s+(?P<space>[A-Za-z_][\w.]*)|\b(?P<kind>class|interface|struct|enum)\s+(?P<type>[A-Za-z_$][\w$]*)"
    r"|\btype\s+(?P<alias>[A-Za-z_$][\w$]*)(?=[^=;{}()\n]*=)|\bfunction\b\s*\*?\s*(?P<function>[A-Za-z_$][\w$]*)|(?P<call>[A-Za-z_$#~][\w$]*)\s*(?:<[^<>(){};=\n]*>\s*)?(?=\()|[A-Za-z_$][\w$]*|\S"
)
#: What may stand before a declaration of JavaScript and TypeScript in its statement; anything else makes it an expression.
_BEFORE = re.compile(r"\s*(?:(?:export|default|declare|abstract|async|const)\s+)*\Z")
#: A statement goes on in the next line after these.
_OPERATORS = set("=+-*/%,.(&|?:<[{!")
_CONTROL = {"if", "for", "foreach", "while", "switch", "catch", "return", "new", "using", "lock", "fixed", "throw", "typeof", "nameof", "await", "super", "base", "this"}


def brace_declarations(text: str, language: str) -> list[Declaration]:
    sharp = language in ("csharp", "aspnet")
    hide = lambda m: re.sub(r"[^\n]", " " if m[0][0] == "/" else "~", m[0])
    code, given = _BRACE_BLANKS.sub(hide, text), text.split("\n")
    out: list[list] = []
    scopes: list[tuple[str, list | None]] = []  # of braces: what it is, and what it declares
    waiting: tuple[str, list | None, int] | None = None  # a declaration whose body is to come, and its depth of parentheses
    namespace, round_, line, start, start_line, value, before = None, 0, 1, 0, 0, False, "{"

    def declare(name: str, kind: str, at: int, scope: str) -> None:
        nonlocal waiting
        out.append([name, kind, at, at, given[at - 1].strip()])
        waiting = (scope, out[-1], round_)

    def ended() -> None:
        """A statement ends here."""
        nonlocal start, start_line, value
        start, start_line, value = m.end(), 0, False

    for m in _TOKEN.finditer(code):
        if not start_line and m[0] != "\n":
            start_line = line
        mark, inside = m["mark"], scopes[-1][0] if scopes else ""
        if mark == "\n":
            goes_on = before in _OPERATORS
            if not sharp and not round_ and not goes_on and waiting and waiting[0] == "alias":
                waiting[1][3], waiting = line, None
            if not sharp and not round_ and not goes_on and not waiting and inside in ("class", ""):
                ended()
            line += 1
            continue
        if mark in ("(", "["):
            round_ += 1
        elif mark in (")", "]"):
            round_ = max(0, round_ - 1)
        elif mark == "{":
            if waiting and waiting[2] == round_ and waiting[0] != "alias":
                scopes.append((waiting[0], waiting[1]))
                waiting = None
            else:
                scopes.append(("block", None))
            scopes[-1] = (*scopes[-1], round_, waiting)  # parentheses and a declaration that go on behind it
            round_, waiting = 0, None
            ended()
        elif mark == "}":
            if scopes:
                _, own, round_, waiting = scopes.pop()
                if own:
                    own[3] = line
            if not round_ and not waiting:
                ended()
        elif mark == ";" and not round_:
            if waiting and waiting[1]:
                if waiting[0] == "method" and not sharp:
                    out.remove(waiting[1])  # a signature without a body
                else:
                    waiting[1][3] = line
            waiting = None
            ended()
        elif mark == "=":
            value = value or not round_
            if sharp and waiting and waiting[0] == "method" and not round_ and code[m.end() : m.end() + 1] != ">":
                waiting = None
        elif m["space"] and sharp:
            namespace = namespace or m["space"]
            waiting = ("namespace", None, round_)
        elif m["type"] and not waiting and (sharp and m["kind"] != "type" or _BEFORE.match(code[start : m.start()])):
            declare(m["type"], m["kind"], start_line if sharp else line, "class" if m["kind"] != "enum" else "block")
        elif m["alias"] and language == "typescript" and not waiting and _BEFORE.match(code[start : m.start()]):
            declare(m["alias"], "type", line, "alias")
        elif m["function"] and not sharp and not waiting and _BEFORE.match(code[start : m.start()]):
            declare(m["function"], "function", line, "function")
        elif m["call"] and inside == "class" and not round_ and not waiting and not value and m["call"] not in _CONTROL:
            owner = scopes[-1][1]
            if sharp or owner[1] == "class":
                declare(m["call"], "method", start_line, "method")
        before = m[0][-1]
    for _, own, *_ in scopes:
        if own:
            own[3] = line
    return [Declaration(n, k, namespace if sharp else None, a, b, s) for n, k, a, b, s in out]


def declarations(text: str | None, language: str) -> list[Declaration]:
    """The declarations of a text in their order, each name, kind and line once."""
    found = python_declarations(text or "") if language == "python" else brace_declarations(text or "", language)
    return list({(d.name, d.kind, d.line_start): d for d in reversed(found)}.values())[::-1]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_columns - 2
        lists = [declarations(t, lang) for t, lang in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
        at = pa.array([i for i, own in enumerate(lists) for _ in own], pa.int64())
        flat = [d for own in lists for d in own]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        made = [pa.array([d[k] for d in flat], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(n)), *made], names=[*batch.schema.names[:n], *Declaration._fields])


def extract_declarations(docs: DataFrame, keys: list[str], text: str = "text", language: str = "language") -> DataFrame:
    """One row per symbol, as ``symbols.extract_symbols``: with extent and signature in LANGUAGES, by patterns in others."""
    ship(docs.sparkSession)
    lang = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    known = docs.where(lang.isin(*LANGUAGES)).select(*keys, F.col(language).alias("language"), F.col(text).alias("_t"), lang.alias("_l"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema if f.name not in ("_t", "_l"))
    found = known.mapInArrow(_extract, f"{kinds}, name string, kind string, namespace string, line_start int, line_end int, signature string")
    columns = [*keys, "name", "kind", "namespace", "line_start", "line_end", "signature", "language"]
    return found.select(*columns).unionByName(symbols.extract_symbols(docs.where(~lang.isin(*LANGUAGES)), keys, text, language).select(*columns))
