"""SQL with numbered placeholders, run with values that never become part of its text."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: A placeholder: fixed spelling, numbered from 0.
PLACEHOLDER = re.compile(r"@Valore(\d+)")


def bound(statement: str, values: list[Any]) -> tuple[str, dict[str, Any]]:
    """The statement with Spark's named parameters, and their values. A number may stand anywhere and
    repeat; numbers start at 0 without gaps, and each has a value."""
    used = {int(n) for n in PLACEHOLDER.findall(statement)}
    if used != set(range(len(used))):
        raise ValueError(f"placeholders must be contiguous and start at @Valore0: {statement}")
    if len(values) != len(used):
        raise ValueError(f"the statement takes {len(used)} values, {len(values)} were given")
    return PLACEHOLDER.sub(r":valore\1", statement), {f"valore{n}": x for n, x in enumerate(values)}


def run(spark: SparkSession, statement: str, values: list[Any]) -> DataFrame:
    text, args = bound(statement, values)
    return spark.sql(text, args=args)
