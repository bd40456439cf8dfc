"""Array expressions that compute a value once and fold in linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of ``running``, and how often its blocks are put into blocks again.
BLOCK, LEVELS = 32, 3


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_blocks(xs: Column, size: int = BLOCK) -> Column:
    """An array as an array of slices; an empty one has a single empty slice."""

    def cut(own: Column) -> Column:
        last = F.floor((F.greatest(F.size(own), F.lit(1)) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(own, k * size + 1, F.lit(size)))

    return bound(xs, cut)


def running(xs: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The state (of type ``kind``) of a fold after each element of ``xs``. A fold copies all that it holds at each step, so
    that blocks of results are held, and blocks of these: an element costs as little in a long array as in a short one."""

    def single(own: Column, begun: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            return bound(step(acc["s"], x).cast(kind), lambda after: F.struct(after.alias("s"), F.concat(acc["out"], F.array(after)).alias("out")))

        return F.aggregate(own, F.struct(begun.alias("s"), F.array().cast(f"array<{kind}>").alias("out")), one)

    def level(own: Column, begun: Column, n: int) -> Column:
        """The last state and all states of an array, by blocks of BLOCK**n elements."""
        if not n:
            return single(own, begun)

        def block(acc: Column, part: Column) -> Column:
            return bound(level(part, acc["s"], n - 1), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["done"], F.array(r["out"])).alias("done")))

        none = F.struct(begun.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("done"))
        return F.aggregate(in_blocks(own, BLOCK**n), none, block, lambda acc: F.struct(acc["s"].alias("s"), F.flatten(acc["done"]).alias("out")))

    first = start.cast(kind)
    return bound(xs, lambda own: F.when(F.size(own) <= BLOCK, single(own, first)["out"]).otherwise(level(own, first, LEVELS)["out"]))
