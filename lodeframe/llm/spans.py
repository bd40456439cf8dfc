"""Regular-expression spans with code point offsets, from built-in functions only.

``split`` with the pattern of ``regexp_extract_all`` gives the gaps between the same matches, so
the offsets are running sums over gaps and matches. A fold copies what it holds at each step; ``running``
therefore holds numbers only and folds over blocks of BLOCK elements, so that a text with hundreds of
thousands of matches costs little more for each than one with ten.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,match:string,before:string,after:string>>"
#: Code points of the gaps beside a match that context words are looked for in.
CONTEXT_BEFORE, CONTEXT_AFTER = 48, 32
#: Elements of a block of ``running``.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A kind of span: where it may occur at all, its pattern, and which matches stay."""

    name: str
    pattern: str
    worth: Callable[[Column], Column]
    keep: Callable[[Column], Column] | None = None


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_blocks(xs: Column, size: int = BLOCK) -> Column:
    """An array as an array of slices; an empty one has a single empty slice."""

    def cut(own: Column) -> Column:
        last = F.floor((F.greatest(F.size(own), F.lit(1)) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(own, k * size + 1, F.lit(size)))

    return bound(xs, cut)


def running(xs: Column, start: int, step: Callable[[Column, Column], Column]) -> Column:
    """The state (a bigint) of a fold after each element of ``xs``, as an array of the same length."""
    some = "struct<s:bigint,out:array<bigint>>"

    def one(acc: Column, x: Column) -> Column:
        after = step(acc["s"], x)
        return F.struct(after.cast("bigint").alias("s"), F.concat(acc["out"], F.array(after.cast("bigint"))).alias("out"))

    def block(acc: Column, own: Column) -> Column:
        begun = F.struct(acc["cur"]["s"].alias("s"), F.array().cast("array<bigint>").alias("out"))
        return F.struct(F.aggregate(own, begun, one).alias("cur"), F.concat(acc["done"], F.array(acc["cur"]["out"])).alias("done"))

    none = F.struct(F.lit(start).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("out")).cast(some)
    begin = F.struct(none.alias("cur"), F.array().cast("array<array<bigint>>").alias("done"))
    return F.aggregate(in_blocks(xs), begin, block, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["cur"]["out"]))))


def pieces(text: Column, kind: Kind) -> Column:
    """Matches and gaps of a text as ``struct<m, g>``; g has one element more than m."""
    none = F.struct(F.array().cast("array<string>").alias("m"), F.array(text).alias("g"))
    some = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("g"))
    return F.when(kind.worth(text), some).otherwise(none)


def located(cut: str, kind: Kind, rank: int) -> Column:
    """The spans of ``pieces`` held in column ``cut``, in order of start."""
    m, g = F.col(f"{cut}.m"), F.col(f"{cut}.g")
    n = F.size(m)
    before, after = F.slice(g, 1, n), F.slice(g, 2, n)
    ends = running(F.arrays_zip(m.alias("m"), before.alias("g")), 0, lambda pos, x: pos + F.length(x["g"]) + F.length(x["m"]))

    def span(x: Column) -> Column:
        return F.struct(
            (x["e"] - F.length(x["m"])).alias("start"),
            F.lit(rank).alias("rank"),
            x["e"].alias("end"),
            F.lit(kind.name).alias("kind"),
            x["m"].alias("match"),
            F.lower(F.substring(x["g"], -CONTEXT_BEFORE, CONTEXT_BEFORE)).alias("before"),
            F.lower(F.substring(x["h"], 1, CONTEXT_AFTER)).alias("after"),
        )

    found = F.transform(F.arrays_zip(m.alias("m"), before.alias("g"), after.alias("h"), ends.alias("e")), span)
    spans = F.when(n == 0, F.array().cast(SPAN)).otherwise(found.cast(SPAN))
    return F.filter(spans, kind.keep) if kind.keep else spans


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def apart(spans: Column, others: Column, kind: str) -> Column:
    """The spans (structs of type ``kind`` with start and end) that overlap none of the others, by start.

    A sweep in both directions over all ends: the furthest end of what starts before a span or with it,
    and the nearest start of what comes after it."""
    event = f"struct<start:bigint,own:int,end:bigint,span:{kind}>"
    own = F.transform(spans, lambda s: F.struct(s["start"].cast("bigint").alias("start"), F.lit(1).alias("own"), s["end"].cast("bigint").alias("end"), s.cast(kind).alias("span")))
    other = F.transform(others, lambda s: F.struct(s["start"].cast("bigint").alias("start"), F.lit(0).alias("own"), s["end"].cast("bigint").alias("end"), F.lit(None).cast(kind).alias("span")))

    def swept(events: Column) -> Column:
        reach = running(events, -1, lambda r, e: F.when(e["own"] == 0, F.greatest(r, e["end"])).otherwise(r))
        next_ = F.reverse(running(F.reverse(events), 2**62, lambda n, e: F.when(e["own"] == 0, e["start"]).otherwise(n)))
        free = F.filter(F.arrays_zip(events.alias("e"), reach.alias("r"), next_.alias("n")), lambda x: (x["e"]["own"] == 1) & (x["e"]["start"] >= x["r"]) & (x["e"]["end"] <= x["n"]))
        return F.transform(free, lambda x: x["e"]["span"])

    free = bound(F.array_sort(F.concat(own.cast(f"array<{event}>"), other.cast(f"array<{event}>"))), swept)
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans.cast(f"array<{kind}>")).otherwise(free)
