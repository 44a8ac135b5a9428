"""Numeric and vector column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def finite(value: Column) -> Column:
    """NULL for NaN and for the infinities, else the value."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(None).cast("double")).otherwise(value)


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def safe_div(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def pair_label(a: Column, b: Column) -> Column:
    return F.concat_ws(" / ", a, b)


def erfc(x: Column) -> Column:
    """Complementary error function of numbers from zero on, to the last digits: the power
    series where it converges fast, else the continued fraction from its 60th term back."""
    falling = F.exp(-x * x)

    def term(state: Column, n: Column) -> Column:
        next_term = state["term"] * (x * x * 2 / (n * 2 + 1))
        return F.struct(next_term.alias("term"), (state["total"] + next_term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("term"), x.alias("total")), term)["total"]
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda below, k: x + k / 2 / below)
    return F.when(x < 2.5, 1 - F.lit(2 / math.sqrt(math.pi)) * falling * series).otherwise(
        falling / (F.lit(math.sqrt(math.pi)) * fraction))


def bp_p_value(lm: Column) -> Column:
    """Upper tail of a chi-square with one degree of freedom."""
    return erfc(F.sqrt(lm / 2))


# ---- arrays as vectors --------------------------------------------------

def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def unit_vector(v: Column) -> Column:
    """v / |v|; a zero vector stays zero."""
    norm = vector_norm(v)
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def left_pad(values: Column, width: int) -> Column:
    zeros = F.array_repeat(F.lit(0.0).cast("double"), F.lit(width) - F.size(values))
    return F.concat(zeros, values)
