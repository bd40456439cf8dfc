"""Text primitives as Column expressions: they stay in the JVM and fuse into scans."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeframe.functions.arrays import bound

#: White space as Python's str.strip sees it: Java's \s with (?U), and the four separators it lacks.
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"(?U)\w+"
FTS_WORD = r"(?U)[\p{L}\p{N}]+"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(_WHITE))


def is_blank(c: Column) -> Column:
    return F.length(stripped(c)) == 0


def normalized(c: Column) -> Column:
    """Line ends as \\n, no white space around: the form that is hashed."""
    return stripped(F.regexp_replace(c, "\r\n?", "\n"))


def content_hash(c: Column) -> Column:
    return F.sha2(normalized(c), 256)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def fts_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(FTS_WORD), F.lit(0))


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("int")


def trim_newlines(c: Column) -> Column:
    return F.btrim(c, F.lit("\n"))


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def line_at(text: Column, position: Column) -> Column:
    """1-based line of a code point offset; only \\n ends a line."""
    head = F.substring(text, F.lit(1), position.cast("int"))
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")


def hash_bucket(token: Column, dim: int) -> Column:
    """The first 64 bits of a token's SHA-256, as an unsigned number modulo ``dim``."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(dim).cast("decimal(20,0)")).cast("int")


DOCUMENT_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "lodeframe.document")


def uuid5(name: Column, namespace: uuid.UUID = DOCUMENT_NAMESPACE) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8).cast("bigint")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def terms(c: Column) -> Column:
    """Distinct lower-case terms of three and more ASCII word characters, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[A-Za-z0-9_]{3,}"), F.lit(0)))


def mapped(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(pairs, c), F.lit(default)) if default is not None else F.try_element_at(pairs, c)


# fixed values: suffixes and what they stand for
SOURCE_TYPES = {
    ".md": "md", ".txt": "text", ".py": "code", ".js": "code", ".ts": "code", ".cs": "code", ".aspx": "code", ".ashx": "code",
    ".json": "config", ".yaml": "config", ".yml": "config", ".toml": "config",
}
LANGUAGES = {
    ".cs": "csharp", ".csx": "csharp", ".js": "javascript", ".ts": "typescript", ".py": "python", ".md": "markdown", ".html": "html", ".htm": "html",
    ".css": "css", ".json": "config", ".yaml": "config", ".yml": "config", ".toml": "config", ".config": "config", ".aspx": "aspnet", ".ashx": "aspnet", ".asp": "aspnet",
}
DOC_TYPES = {"md": "markdown", "code": "code", "config": "config"}


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot, empty if the name has none (a leading dot starts no suffix)."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^/.]+)$", 1))


def source_type(path: Column) -> Column:
    return F.coalesce(mapped(suffix(path), SOURCE_TYPES), F.lit("text"))


def language(path: Column) -> Column:
    return mapped(suffix(path), LANGUAGES)


def doc_type(kind: Column) -> Column:
    return F.coalesce(mapped(kind, DOC_TYPES), F.lit("text"))


def snippet(text: Column, query: Column | None = None, size: int = 300) -> Column:
    """A text's passage around the longest query term found in it (ties: alphabetical), else its start."""
    short, cut = F.length(text) <= size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))
    if query is None:
        return F.when(short, text).otherwise(cut)
    long_words = F.filter(F.array_distinct(words(query)), lambda w: F.length(w) >= 3)
    ranked = F.transform(F.sort_array(F.transform(long_words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    # a question may be a whole document: its words are looked for up to the first one found, in a text lower-cased once
    found = lambda low: F.aggregate(ranked, F.lit(0), lambda at, w: F.when(at > 0, at).otherwise(F.instr(low, w)), lambda at: F.when(at > 0, at))
    hit = bound(F.lower(text), found)

    def around(at: Column) -> Column:
        end = F.least(F.length(text), F.greatest(F.lit(0), at - 1 - size // 2) + size)
        start = F.greatest(F.lit(0), end - size)
        body = stripped(F.substring(text, start + 1, end - start))
        whole = F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise(""))
        return F.when(at.isNull() | (F.length(body) == 0), cut).otherwise(whole)

    return F.when(short, text).otherwise(bound(hit, around))
