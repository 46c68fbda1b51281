"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it.

    A lambda that names an outer expression would compute it for each element
    once projections are collapsed; a lambda's own variable is a value.
    """
    return F.transform(F.array(value), body)[0]


#: Values that a running total takes in one go.
_RUN = 128


def running(values: Column, op: Callable[[Column, Column], Column], kind: str = "bigint") -> Column:
    """For each of ``values``, all before it combined by ``op``, from 0.

    An array that grows by one copies itself, so runs of a fixed length are
    combined first, and then the values of each run.
    """
    none = F.array().cast(f"array<{kind}>")

    def totals(x: Column, first: Column) -> Column:
        begin = F.struct(first.cast(kind).alias("at"), none.alias("before"))
        return F.aggregate(x, begin, lambda a, v: F.struct(op(a["at"], v).cast(kind).alias("at"), F.array_append(a["before"], a["at"]).alias("before")), lambda a: a["before"])

    def of_runs(runs: Column) -> Column:
        whole = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast(kind), lambda a, v: op(a, v).cast(kind)))
        return let(totals(whole, F.lit(0)), lambda firsts: F.flatten(F.transform(runs, lambda r, i: totals(r, F.get(firsts, i)))))

    def of_values(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(_RUN))
        return let(F.transform(starts, lambda k: F.slice(x, k + 1, _RUN)), of_runs)

    return let(values, of_values)
