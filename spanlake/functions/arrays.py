"""Array expressions that stay linear or nearly so in the array's length (JVM-side, inside the row)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUM_BLOCK = 16  # elements summed together before blocks are laid end to end


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once: a lambda variable is not inlined again where it is used."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def evaluated(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds ``cols``, each computed once per row whatever is done with them later.

    A filter on a computed column is moved below it with the whole expression
    written out at every place that names it; generated columns stay as they are.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def span(lo: Column, hi: Column) -> Column:
    """Integers ``lo .. hi - 1`` (none if ``hi <= lo``)."""
    return F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))


def prefix_sums(values: Column) -> Column:
    """Running sums of an int array.

    An accumulator that grows by one element a step is copied each time, so
    sums are taken per block of ``SUM_BLOCK`` and the blocks joined: copies are
    ``n * SUM_BLOCK / 2 + n * n / (2 * SUM_BLOCK)`` instead of ``n * n / 2``.
    """
    empty = F.array().cast("array<int>")

    def state(at: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), out.alias("out"))

    def inside(s: Column, v: Column) -> Column:
        return state(s["at"] + v, F.concat(s["out"], F.array(s["at"] + v)))

    def of(v: Column) -> Column:
        def block(s: Column, b: Column) -> Column:
            own = F.aggregate(F.slice(v, b * SUM_BLOCK + 1, F.lit(SUM_BLOCK)), state(s["at"], empty), inside)
            return let(own, lambda x: state(x["at"], F.concat(s["out"], x["out"])))

        blocks = span(F.lit(0), F.ceil(F.size(v) / SUM_BLOCK).cast("int"))
        return F.aggregate(blocks, state(F.lit(0), empty), block, lambda s: s["out"])

    return let(values, of)


def first_above(values: Column, x: Column) -> Column:
    """Index (from 0) of the first element of an ascending array that exceeds ``x``; the size if none does."""
    def of(a: Column) -> Column:
        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            right = F.get(a["v"], mid) <= a["x"]
            done = s["lo"] >= s["hi"]
            return F.struct(F.when(done | ~right, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(done | right, s["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(0).alias("lo"), F.size(a["v"]).alias("hi")), halve, lambda s: s["lo"])

    return let(F.struct(values.alias("v"), x.alias("x")), of)
