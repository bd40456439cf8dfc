"""Symbols, call sites and code headers, from built-in regular expression functions.

A match's line needs its offset, which regular expression functions don't give: the gaps between
the same matches do, by a running count of line ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import text as tx
from lodeframe.functions.arrays import bound, running
from lodeframe.operators.chunking import LINE

SYMBOL = "array<struct<name:string,kind:string,namespace:string,line_start:int>>"


@dataclass(frozen=True)
class Form:
    """A kind of declaration: the languages it is looked for in, its pattern, the groups of its name
    and of what tells its kind (0: always ``kind``)."""

    languages: tuple[str, ...]
    pattern: str
    name: int
    kind_from: int = 0
    kind: str = ""
    namespaced: bool = False


# fixed values: the declarations of each language, in order; "" is a text of unknown language
_CS, _TS, _PY, _JS = ("", "csharp", "aspnet"), ("", "typescript"), ("", "python"), ("", "javascript", "typescript")
NAMESPACE = r"(?Umd)^\s*namespace\s+([A-Za-z_][\w\.]*)"
FORMS = (
    Form(_CS, r"(?Umd)^\s*(?:(?:public|private|protected|internal|sealed|abstract|static|partial)\s+)*(class|interface|struct|enum)\s+([A-Za-z_]\w*)", 2, 1, namespaced=True),
    Form(_CS, r"(?Umd)^\s*(?:public|private|protected|internal)\s+(?:static\s+)?(?:async\s+)?[\w<>\[\],\s]+\s+([A-Za-z_]\w*)\s*\(", 1, kind="method", namespaced=True),
    Form(_TS, r"(?Umd)^\s*(?:export\s+)?(class|interface|enum|type)\s+([A-Za-z_]\w*)", 2, 1),
    Form(_PY, r"(?Umd)^([^\S\n]*)class\s+([A-Za-z_]\w*)\s*(?:\(|:)", 2, kind="class"),
    Form(_PY, r"(?Umd)^([^\S\n]*)(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(", 2, kind="function"),
    Form(_JS, r"(?Umd)^\s*(?:export\s+)?class\s+([A-Za-z_$][\w$]*)", 1, kind="class"),
    Form(_JS, r"(?Umd)^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(", 1, kind="function"),
    Form(_JS, r"(?Umd)^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)", 1, kind="function"),
)
INDENTED = 4  # the form whose kind is "method" when indented
CALL = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]{3,})\s*\("
SKIP_ALL = ["if", "for", "while", "class", "catch", "switch", "with"]
SKIP = {
    "python": [
        "print", "isinstance", "hasattr", "getattr", "setattr", "delattr", "range", "enumerate", "sorted", "reversed",
        "filter", "super", "property", "staticmethod", "classmethod", "abstractmethod",
    ],
    "csharp": ["foreach", "while", "switch", "return", "nameof", "typeof", "sizeof", "checked", "unchecked", "default"],
    "javascript": ["function", "return", "typeof", "instanceof", "require", "console"],
}
SKIP |= {"aspnet": SKIP["csharp"], "typescript": SKIP["javascript"]}


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _found(matches: str, text: Column, form: Form, namespace: Column) -> Column:
    """Symbols of a form from its matches in a text. Names and kinds are read from the matches themselves: the patterns look at
    nothing outside of what they match but the start of a line, so that a match by itself has the same groups."""
    m = F.col(matches)
    # what lies between a match and the one before; of split the pattern would be compiled anew for each text
    gaps = F.regexp_extract_all(text, F.lit(rf"\G((?s:.*?))(?:{form.pattern})"), F.lit(1))
    # the line behind each match: line ends of the gaps and matches so far
    after = running(F.arrays_zip(m.alias("m"), gaps.alias("g")), F.lit(1), lambda line, x: line + _newlines(x["g"]) + _newlines(x["m"]), "int")
    part = lambda x, group: F.regexp_extract(x, form.pattern, group)

    def one(x: Column) -> Column:
        kind = F.lower(part(x["m"], form.kind_from)) if form.kind_from else F.when(F.length(part(x["m"], 1)) > 0, "method").otherwise(form.kind) if form is FORMS[INDENTED] else F.lit(form.kind)
        return F.struct(part(x["m"], form.name).alias("name"), kind.alias("kind"), (namespace if form.namespaced else F.lit(None).cast("string")).alias("namespace"), (x["after"] - _newlines(x["m"])).cast("int").alias("line_start"))

    both = F.arrays_zip(m.alias("m"), after.alias("after"))
    return F.transform(both, one).cast(SYMBOL)


def extract_symbols(docs: DataFrame, keys: list[str], text: str = "text", language: str = "language") -> DataFrame:
    """One row per symbol: keys, name, kind, namespace, line_start, line_end, signature, language."""
    t, lang = F.col(text), F.lower(F.trim(F.coalesce(language, F.lit(""))))
    cut = [F.when(lang.isin(*f.languages), F.regexp_extract_all(t, F.lit(f.pattern), F.lit(0))).alias(f"_f{i}") for i, f in enumerate(FORMS)]
    namespace = F.when(lang.isin(*_CS), F.nullif(F.regexp_extract(t, NAMESPACE, 1), F.lit("")))
    wide = docs.select(*keys, language, t.alias("_text"), namespace.alias("_ns"), *cut)
    # a form that is not found is looked for once only
    each = [F.when(F.size(f"_f{i}") > 0, _found(f"_f{i}", F.col("_text"), f, F.col("_ns"))).otherwise(F.array().cast(SYMBOL)) for i, f in enumerate(FORMS)]
    listed = wide.select(*keys, language, F.concat(*each).alias("_all"))
    # of equal names, kinds and lines the first one counts: neighbours once they are sorted
    key = lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"), s["line_start"].alias("line_start"))
    order = F.sort_array(F.transform("_all", lambda s, i: F.struct(key(s).alias("key"), i.alias("i"), s["namespace"].alias("namespace"))))
    once = bound(order, lambda o: F.filter(o, lambda s, i: (i == 0) | (F.get(o, i - 1)["key"] != s["key"])))
    # outer: no filter on the array's size is inferred and pushed to the scan
    rows = listed.select(*keys, language, F.explode_outer(once).alias("s")).where("s IS NOT NULL").select(*keys, F.col(language).alias("language"), "s.key", "s.namespace")
    return rows.select(*keys, "key.name", "key.kind", "namespace", "key.line_start", F.lit(None).cast("int").alias("line_end"), F.lit(None).cast("string").alias("signature"), "language")


def extract_call_sites(docs: DataFrame, keys: list[str], text: str = "text", language: str = "language") -> DataFrame:
    """One row per callee and line: keys, callee_name, line, language."""
    lang = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    skip = F.array(*map(F.lit, SKIP_ALL))
    for name, more in SKIP.items():
        skip = F.when(lang == name, F.array(*map(F.lit, sorted({*more, *SKIP_ALL})))).otherwise(skip)
    rows = docs.where(F.contains(text, F.lit("("))).select(*keys, F.col(language).alias("language"), skip.alias("_skip"), F.posexplode_outer(F.regexp_extract_all(text, F.lit(LINE), F.lit(0))).alias("_i", "_line"))
    names = rows.where(F.contains("_line", F.lit("("))).select(*keys, "language", "_skip", (F.col("_i") + 1).alias("line"), F.explode_outer(F.array_distinct(F.regexp_extract_all("_line", F.lit(CALL), F.lit(1)))).alias("callee_name"))
    return names.where(F.col("callee_name").isNotNull() & ~F.array_contains("_skip", F.lower("callee_name"))).select(*keys, "callee_name", "line", "language")


# --- code headers ---------------------------------------------------------------------------

_HEADS = ("CLASSES", "INTERFACES", "STRUCTS", "ENUMS", "TYPES", "METHODS", "FUNCTIONS")
_HEAD_OF_KIND = {"class": "CLASSES", "interface": "INTERFACES", "struct": "STRUCTS", "enum": "ENUMS", "type": "TYPES", "method": "METHODS", "function": "FUNCTIONS"}
# fixed values: how many names of each form are looked at, and how many of each head are shown
_LOOKED_AT = {1: 80, 3: 60, 4: 120, 5: 60, 6: 120, 7: 120}
_SHOWN = {"METHODS": 40, "FUNCTIONS": 40}


def _of_kind(pairs: Column, kind: str) -> Column:
    return F.transform(F.filter(pairs, lambda p: F.lower(p["k"]) == kind), lambda p: p["n"])


def code_headers(docs: DataFrame, keys: list[str], text: str = "text", path: str = "path", language: str = "language") -> DataFrame:
    """keys and ``header``: a code file's path, language, names and path tokens as a text to index."""
    t, lang = F.col(text), F.lower(F.trim(F.coalesce(language, F.lit(""))))
    heads: dict[str, list[Column]] = {h: [] for h in _HEADS}
    none = F.array().cast("array<string>")
    for i, f in enumerate(FORMS):
        names = F.regexp_extract_all(t, F.lit(f.pattern), F.lit(f.name))
        if f.kind_from:
            pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(f.pattern), F.lit(f.kind_from)).alias("k"), names.alias("n"))
            for kind, head in _HEAD_OF_KIND.items():
                if kind in f.pattern:
                    heads[head].append(F.when(lang.isin(*f.languages), _of_kind(pairs, kind)).otherwise(none))
        else:
            heads[_HEAD_OF_KIND[f.kind]].append(F.when(lang.isin(*f.languages), F.slice(names, 1, _LOOKED_AT[i])).otherwise(none))
    p = F.col(path)
    split = F.filter(F.split(F.trim(p), r"[\\/]+"), lambda s: s != "")
    folders = F.slice(F.when(F.contains(F.element_at(split, -1), F.lit(".")), F.slice(split, 1, F.greatest(F.size(split) - 1, F.lit(0)))).otherwise(split), 1, 4)
    tokens = F.slice(F.filter(F.split(p, r"(?U)[\\/_.\-\s]+"), lambda s: s != ""), 1, 30)
    namespace = F.when(lang.isin(*_CS), F.nullif(F.regexp_extract(t, NAMESPACE, 1), F.lit("")))
    line = lambda head, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{head}: "), value))
    shown = [line(h, F.array_join(F.slice(F.array_distinct(F.concat(*columns)), 1, _SHOWN.get(h, 30)), ", ")) for h, columns in heads.items()]
    every = [F.concat(F.lit("FILE: "), p), line("LANGUAGE", lang), line("PROJECT", F.get(folders, F.lit(0))), line("SUBPROJECT", F.get(folders, F.lit(1))), line("NAMESPACE", namespace), *shown, line("TOKENS", F.array_join(tokens, " "))]
    return docs.select(*keys, tx.stripped(F.concat_ws("\n", *every)).alias("header"))
