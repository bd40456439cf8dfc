"""Path scopes: given prefixes, files, paths in a question, and keywords that name a part of the tree."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: what a path in a text may end with
PATH_IN_TEXT = re.compile(r"(?:[A-Za-z]:\\)?[\w\-/\\ .]+\.(?:cs|csproj|js|ts|md|txt|json|yaml|yml|toml|html|aspx|ashx|asp|config)", re.IGNORECASE)


def to_posix(value: str) -> str:
    """Forward slashes, without ``./`` in front."""
    return re.sub(r"^(?:\./)+", "", value.replace("\\", "/"))


def with_aliases(path: str, aliases: dict[str, str] | None) -> str:
    for source, target in (aliases or {}).items():
        if to_posix(str(source)):
            path = path.replace(to_posix(str(source)), to_posix(str(target)))
    return path


def prefix(value: str | None, aliases: dict[str, str] | None = None) -> str | None:
    return (with_aliases(to_posix(value), aliases) or None) if value else None


def prefix_of_file(path: str, aliases: dict[str, str] | None = None) -> str | None:
    """A file is its own prefix; a folder gets its slash; absolute paths become relative if they can."""
    found = prefix(path, aliases)
    if not found:
        return None
    at = Path(found)
    if at.is_absolute() and at.resolve().is_relative_to(Path.cwd().resolve()):
        at = at.resolve().relative_to(Path.cwd().resolve())
    text = at.as_posix()
    return text if Path(text).suffix else text + "/"


def prefix_in_text(text: str | None, aliases: dict[str, str] | None = None) -> str | None:
    found = PATH_IN_TEXT.findall(text or "")
    return prefix(max(found, key=len), aliases) if found else None


def prefix_of_keywords(text: str | None, scopes: dict[str, list[str]], aliases: dict[str, str] | None = None) -> str | None:
    """The scope with the longest keyword in the text; of equally long ones the first."""
    low = (text or "").lower()
    known = [(k.lower().strip(), p) for p, ks in scopes.items() for k in ks]
    found = [(k, p) for k, p in known if k and k in low]
    return prefix(max(found, key=lambda x: len(x[0]))[1], aliases) if found else None


def resolve(path_prefix: str | None, file: str | None, text: str | None, auto: bool, scopes: dict[str, list[str]], aliases: dict[str, str] | None = None) -> str | None:
    """By priority: the prefix given, the file given, a path in the text, the text's keywords."""
    if path_prefix:
        return prefix(path_prefix, aliases)
    if file:
        return prefix_of_file(file, aliases)
    return prefix_in_text(text, aliases) or (prefix_of_keywords(text, scopes, aliases) if auto else None)


def resolve_batch(queries: DataFrame, scopes: dict[str, list[str]], text: str = "query_text") -> DataFrame:
    """``queries`` with ``scope``: ``prefix_of_keywords`` as one expression over a literal map."""
    known = [(k.lower().strip(), p, i) for i, (p, k) in enumerate((p, k) for p, ks in scopes.items() for k in ks) if k.strip()]
    if not known:
        return queries.withColumn("scope", F.lit(None).cast("string"))
    every = F.array(*(F.struct(F.lit(-len(k)).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(prefix(p)).alias("p")) for k, p, i in known))
    low = F.lower(F.coalesce(text, F.lit("")))
    return queries.withColumn("scope", F.array_min(F.filter(every, lambda x: F.contains(low, x["k"])))["p"])


def normalized(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def starts_with(path_norm: Column, given: str) -> Column:
    """A literal prefix test that the Parquet scan evaluates."""
    return F.startswith(path_norm, F.lit(given.replace("\\", "/").lower()))
