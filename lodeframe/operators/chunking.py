"""Chunkers as array expressions: a document's chunks are one array column, then exploded.

No window or shuffle is needed: the all-or-nothing length filter, the heading stack and the code
accumulator are folds over a document's own lines. Offsets are code points of the raw text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import text as tx
from lodeframe.functions.arrays import bound, running

CHUNK = "array<struct<char_start:int,char_end:int,section_path:string,body:string>>"

# fixed values: what ends a line, and where a code chunk may begin
_ENDS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
LINE = rf"[^{_ENDS}]*(?:\r\n|[{_ENDS}])|[^{_ENDS}]+"
HEADING = r"(?U)^\s*(#{1,6})\s+([^\n]+)"
BOUNDARY = (
    r"(?U)^\s*(?:"
    r"(?:def |class |function |export function|export class)"
    r"|(?:(?:public|private|protected|internal|sealed|abstract|static|partial)\s+)*(?:class|interface|struct|enum)\s+\w+"
    r"|(?:public|private|protected|internal)\s+(?:static\s+)?(?:async\s+)?[\w<>\[\],\s]+\s+\w+\s*\()"
)


def lines(c: Column) -> Column:
    """The lines of a text with their ends."""
    return F.regexp_extract_all(c, F.lit(LINE), F.lit(0))


def _chunk(start: Column, end: Column, section: Column, body: Column) -> Column:
    return F.struct(start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), section.alias("section_path"), body.alias("body"))


def long_enough(chunks: Column, least: int, body: Callable[[Column], Column] = lambda x: x["body"]) -> Column:
    """Non-blank chunks of ``least`` characters or more; if there is none, all non-blank ones."""
    measured = F.transform(chunks, lambda x: F.struct(x.alias("x"), F.length(tx.stripped(body(x))).alias("n")))
    plain = lambda found: F.transform(found, lambda m: m["x"])

    def kept(solid: Column) -> Column:
        return bound(F.filter(solid, lambda m: m["n"] >= least), lambda long: F.when(F.size(long) > 0, plain(long)).otherwise(plain(solid)))

    return bound(F.filter(measured, lambda m: m["n"] > 0), kept)


def fixed_windows(text: Column, size: int, overlap: int, base: Column | None = None, section: Column | None = None) -> Column:
    """Windows of ``size`` characters, each starting ``overlap`` before the last one's end.

    The text is cut once into pieces from start to start, of which windows are joined: a substring is looked for from
    the text's start, so that windows by substrings cost the square of a long text."""
    base = F.lit(0) if base is None else base
    section = F.lit("") if section is None else section
    n = F.length(text)
    if size <= 0:
        return F.array(_chunk(base, base + n, section, text)).cast(CHUNK)
    overlap = max(0, min(overlap, size - 1))
    step = size - overlap
    last = F.greatest(F.ceil((n - overlap) / F.lit(step)).cast("int") - 1, F.lit(0))
    pieces, span = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), -(-size // step)
    body = lambda own, i: F.substring(F.array_join(F.slice(own, i + 1, F.lit(span)), ""), F.lit(1), F.lit(size))
    # a length is counted from a text's start too
    made = lambda own, n: F.transform(F.sequence(F.lit(0), last), lambda i: _chunk(base + i * step, base + F.least(n, i * step + size), section, body(own, i)))
    windows = bound(n, lambda n: bound(pieces, lambda own: made(own, n)))
    return F.when(n > 0, windows.cast(CHUNK)).otherwise(F.array().cast(CHUNK))


def sections(text: Column, own_lines: Column) -> Column:
    """Parts between headings: array<struct<start, first, path>>; a path joins the open headings, first is a line's number."""
    kind = "struct<start:int,pos:int,line:int,head:boolean,stack:array<struct<level:int,title:string>>>"

    def step(s: Column, line: Column) -> Column:
        level = F.length(F.regexp_extract(line, HEADING, 1))
        head = F.struct(level.cast("int").alias("level"), tx.stripped(F.regexp_extract(line, HEADING, 2)).alias("title"))
        open_ = F.when(level > 0, F.concat(F.filter(s["stack"], lambda h: h["level"] < level), F.array(head))).otherwise(s["stack"])
        return F.struct(s["pos"].alias("start"), (s["pos"] + F.length(line)).cast("int").alias("pos"), (s["line"] + 1).alias("line"), (level > 0).alias("head"), open_.alias("stack"))

    zero = F.lit(0)
    begin = F.struct(zero.alias("start"), zero.alias("pos"), F.lit(-1).alias("line"), F.lit(False).alias("head"), F.array().cast("array<struct<level:int,title:string>>").alias("stack"))
    opened = F.filter(running(own_lines, begin, step, kind), lambda s, i: s["head"] | (i == 0))
    return F.transform(opened, lambda s: F.struct(s["start"].alias("start"), s["line"].alias("first"), F.array_join(F.transform(s["stack"], lambda h: h["title"]), " > ").alias("path")))


def _joined(own_lines: Column, first: Column, end: Column) -> Column:
    """Lines as a text. A text's substring is looked for from its start, which in long texts costs far more."""
    return F.array_join(F.slice(own_lines, first + 1, end - first), "")


def markdown_chunks(text: Column, own_lines: Column, parts: Column, size: int, overlap: int, least: int) -> Column:
    def cut(p: Column, i: Column) -> Column:
        end = F.coalesce(F.get(parts, i + 1)["start"], F.length(text))
        made = _joined(own_lines, p["first"], F.coalesce(F.get(parts, i + 1)["first"], F.size(own_lines)))
        return bound(made, lambda body: chunks_of(p, end, body))

    def chunks_of(p: Column, end: Column, body: Column) -> Column:
        whole = F.array(_chunk(p["start"], end, p["path"], body)).cast(CHUNK)
        return F.when(F.length(body) <= size, whole).otherwise(long_enough(fixed_windows(body, size, overlap, p["start"], p["path"]), least))

    return F.flatten(F.transform(parts, cut))


def code_spans(own_lines: Column, size: int, least: int) -> Column:
    """Runs of lines: array<struct<start, end, first, last>>, the latter two lines' numbers. A line may end the run
    before it, and its own."""
    span = "array<struct<start:int,end:int,first:int,last:int>>"
    kind = f"struct<pos:int,line:int,start:int,first:int,held:int,ended:{span}>"

    def one(start: Column, end: Column, first: Column, last: Column) -> Column:
        return F.array(F.struct(start.alias("start"), end.alias("end"), first.alias("first"), last.alias("last"))).cast(span)

    # what is asked of a line is found once, outside the fold
    marks = F.transform(own_lines, lambda line: F.struct(F.length(line).alias("n"), line.rlike(BOUNDARY).alias("head")))

    def step(s: Column, line: Column) -> Column:
        n = line["n"]
        cut = line["head"] & (s["held"] >= least)
        start, first = (F.when(cut | (s["held"] == 0), s[now]).otherwise(s[kept]) for now, kept in (("pos", "start"), ("line", "first")))
        held = F.when(cut, n).otherwise(s["held"] + n)
        full = ~cut & (held >= size)
        before = F.when(cut & (s["held"] > 0), one(s["start"], s["pos"], s["first"], s["line"])).otherwise(F.array().cast(span))
        ended = F.when(full, F.concat(before, one(start, s["pos"] + n, first, s["line"] + 1))).otherwise(before)
        return F.struct((s["pos"] + n).alias("pos"), (s["line"] + 1).alias("line"), start.alias("start"), first.alias("first"), F.when(full, 0).otherwise(held).alias("held"), ended.alias("ended"))

    zero = F.lit(0)
    begin = F.struct(zero.alias("pos"), zero.alias("line"), zero.alias("start"), zero.alias("first"), zero.alias("held"), F.array().cast(span).alias("ended"))

    def finish(states: Column) -> Column:
        last = F.element_at(states, -1)
        rest = F.when(F.size(states) == 0, F.array().cast(span)).when(last["held"] > 0, one(last["start"], last["pos"], last["first"], last["line"])).otherwise(F.array().cast(span))
        return F.concat(F.flatten(F.transform(states, lambda s: s["ended"])), rest)

    return bound(running(marks, begin, step, kind), finish)


def _finished(docs: DataFrame, keys: list[str], chunks: str, text: str, least: int) -> DataFrame:
    """Explode chunk arrays, without the short ones, to rows with lines and trimmed texts.

    Lines are counted from chunk to chunk, in the body of the one before where it reaches the next one, so that the whole text is
    not read for each. The outer explode: of an inner one Spark infers a filter on the array's size, pushes it to the scan and
    so evaluates all that made the array once more, inside lambdas even once per element."""
    cs = F.col(chunks)

    def gap(c: Column, i: Column) -> Column:
        prev = F.get(cs, i - 1)
        between = tx.newlines(prev["body"]) + tx.newlines(F.substring(F.col(text), prev["char_end"] + 1, c["char_start"] - prev["char_end"]))
        shared = tx.newlines(F.when(c["char_start"] == prev["char_end"], prev["body"]).otherwise(F.substring(prev["body"], F.lit(1), c["char_start"] - prev["char_start"])))
        return F.when(i == 0, tx.newlines(F.substring(F.col(text), F.lit(1), c["char_start"]))).when(c["char_start"] <= prev["char_end"], shared).otherwise(between)

    lined = docs.select(*keys, F.arrays_zip(cs.alias("c"), running(F.transform(cs, gap), F.lit(1), lambda a, x: a + x, "int").alias("line")).alias("_both"))
    kept = lined.select(*keys, long_enough(F.col("_both"), least, lambda x: x["c"]["body"]).alias("_kept"))
    rows = kept.select(*keys, F.posexplode_outer("_kept").alias("chunk_index", "_one")).where("chunk_index IS NOT NULL").select(*keys, "chunk_index", "_one.c", F.col("_one.line").alias("_first"))
    first = F.col("_first")
    return rows.select(
        *keys,
        "chunk_index",
        F.col("c.char_start").alias("char_start"),
        F.col("c.char_end").alias("char_end"),
        first.alias("line_start"),
        (first + tx.newlines(F.substring(F.col("c.body"), F.lit(1), F.length("c.body") - 1))).alias("line_end"),
        F.col("c.section_path").alias("section_path"),
        tx.trim_newlines(F.col("c.body")).alias("text"),
        F.lit(False).alias("is_header"),
    )


def chunk_fixed(docs: DataFrame, keys: list[str], size: int = 1200, overlap: int = 300, least: int = 200, text: str = "text") -> DataFrame:
    made = docs.select(*keys, text, fixed_windows(F.col(text), size, overlap).alias("_all"))
    return _finished(made, keys, "_all", text, least)


def chunk_markdown(docs: DataFrame, keys: list[str], size: int = 1600, overlap: int = 300, least: int = 200, text: str = "text") -> DataFrame:
    t = F.col(text)
    made = bound(lines(t), lambda own: bound(sections(t, own), lambda parts: markdown_chunks(t, own, parts, size, overlap, least)))
    return _finished(docs.select(*keys, text, made.alias("_all")), keys, "_all", text, least)


def chunk_code(docs: DataFrame, keys: list[str], size: int = 2500, least: int = 200, text: str = "text") -> DataFrame:
    def chunk(s: Column, own: Column) -> Column:
        return _chunk(s["start"], s["end"], F.lit(""), _joined(own, s["first"], s["last"]))

    made = bound(lines(F.col(text)), lambda own: F.transform(code_spans(own, size, least), lambda s: chunk(s, own)).cast(CHUNK))
    return _finished(docs.select(*keys, text, made.alias("_all")), keys, "_all", text, least)


def chunk_documents(docs: DataFrame, keys: list[str], sizes: dict[str, int], overlap: int, least: int, headers: DataFrame | None = None) -> DataFrame:
    """Every document by its source type (column ``kind``: md, code, config, text), code with its
    header chunk first: ``headers`` has the keys and ``header``."""
    made = chunk_markdown(docs.where("kind = 'md'"), keys, sizes["md"], overlap, least)
    made = made.unionByName(chunk_fixed(docs.where("kind NOT IN ('md', 'code')"), keys, sizes["text"], overlap, least))
    code = chunk_code(docs.where("kind = 'code'"), keys, sizes["code"], least)
    if headers is not None:
        code = code.withColumn("chunk_index", F.col("chunk_index") + 1)
        zero, one = F.lit(0), F.lit(1)
        top = headers.where("header <> ''").select(*keys, zero.alias("chunk_index"), zero.alias("char_start"), zero.alias("char_end"), one.alias("line_start"), one.alias("line_end"), F.lit("").alias("section_path"), F.col("header").alias("text"), F.lit(True).alias("is_header"))
        code = top.unionByName(code)
    return made.unionByName(code)
