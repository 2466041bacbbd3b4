"""Array expressions: placing values between sorted cuts, interpolation, finite filters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FAN = 16


def with_coarse_cuts(cuts: Column, fan: int = FAN) -> Column:
    """Struct of all cuts and every ``fan``-th of them, for two-step placement."""
    return F.struct(
        cuts.alias("fine"), F.filter(cuts, lambda _, i: (i + 1) % fan == 0).alias("coarse")
    )


def count_below(cuts: str, value: Column, fan: int = FAN) -> Column:
    """Number of cuts strictly below ``value``: at most ``len / fan + fan`` comparisons."""
    block = F.size(F.filter(F.col(f"{cuts}.coarse"), lambda c: c < value)) * F.lit(fan)
    inside = F.slice(F.col(f"{cuts}.fine"), block + F.lit(1), F.lit(fan))
    return block + F.size(F.filter(inside, lambda c: c < value))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Plain column reuse would be inlined by the optimizer when a filter is pushed through
    a chain of projections, multiplying long array expressions; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, array_sum(values) / F.size(values))


def array_std(values: Column, mean: Column) -> Column:
    """Population standard deviation around a given mean."""
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(F.size(values) > 0, F.sqrt(squares / F.size(values)))


def value_finite(x: Column) -> Column:
    """Finite test for array elements; NULL and NaN count as not finite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
