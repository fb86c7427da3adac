"""Small helpers for higher-order expressions on arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    Without this, a column that a lambda refers to is computed anew for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def upto(n: Column) -> Column:
    """1, 2, ... n; empty when n is below 1 (sequence() would count down)."""
    return F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, size of ``group``).

    Starts and ends count code points.  The pieces between matches, from split(), give the
    places; a text without a match is scanned once only.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    kind = "array<struct<start:int,end:int,size:int>>"

    def place(m: Column) -> Column:
        rows = F.arrays_zip(
            F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(m)), F.length).alias("gap"),
            F.transform(m, F.length).alias("len"),
            F.transform(sizes, F.length).alias("size"),
        )
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

        def step(acc: Column, r: Column) -> Column:
            begin = acc["at"] + r["gap"]
            return F.struct(
                (begin + r["len"]).alias("at"),
                F.array_append(acc["out"], F.struct(begin.alias("start"), (begin + r["len"]).alias("end"), r["size"].alias("size"))).alias("out"),
            )

        return F.aggregate(rows, start, step)["out"]

    return let(found, lambda m: F.when(F.size(m) > 0, place(m)).otherwise(F.array().cast(kind)))
