"""Exact arithmetic on doubles in column expressions: error-free products, rounding by products, and texts of the exact binary value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves of at most 26 bits each.
HALVES = float(2**27 + 1)
#: From here on doubles have no fraction, and from SHORTEST on texts are the shortest that read as the value.
NO_FRACTION, SHORTEST = float(2**52), 1e21
MOST_DIGITS = 15


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_product(a: Column, b: float, body: Callable[[Column, Column], Column]) -> Column:
    """body(p, e) with p the rounded product and p + e the exact one, short of over- and underflow (Dekker)."""
    c = b * HALVES
    b_high = c - (c - b)
    b_low = b - b_high

    def error(p: Column, x: Column, high: Column) -> Column:
        low = x - high
        e = (high * b_high - p) + low * b_high
        return e if b_low == 0 else ((high * b_high - p) + high * b_low + low * b_high) + low * b_low

    return let(a, lambda x: let(let(x * HALVES, lambda c: c - (c - x)), lambda high: let(x * b, lambda p: body(p, error(p, x, high)))))


def rounded_product(v: Column, digits: int) -> Column:
    """v to `digits` places as round(v * 10**digits) / 10**digits in doubles, ties of the product away from zero.

    SQL engines and C programs round like this; F.round goes by the shortest decimal text and gives another last digit
    where the product falls on the other side of a tie (3.22875 to 4 places: 3.2287 here, 3.2288 there). Where that is
    not finite, v itself.
    """
    unit = float(10**digits)

    def whole(p: Column) -> Column:
        size = F.abs(p)
        down = F.floor(F.when(size < NO_FRACTION, size)).cast("double")
        return F.when(size < NO_FRACTION, F.signum(p) * (down + F.when(size - down >= 0.5, 1.0).otherwise(0.0))).otherwise(p)

    return let(v * unit, lambda p: let(whole(p) / unit, lambda r: F.when(F.abs(r) < float("inf"), r).otherwise(v)))


def _all_digits(whole: Column) -> Column:
    """The digits of a double without a fraction, below SHORTEST."""
    high = F.floor(whole / float(2**32))
    low = F.floor(whole - high.cast("double") * float(2**32))
    return (high.cast("decimal(12,0)") * F.lit(2**32).cast("decimal(10,0)") + low.cast("decimal(10,0)")).cast("string")


def exact_fixed(v: Column, digits: int) -> Column:
    """Decimal text of the exact binary value with 0 to 15 digits, ties away from zero.

    From 1e21 on the platform's shortest text that reads as the value ("1e+21"); "Infinity", "-Infinity" and "NaN"; null for null.
    A negative number keeps its sign ("-0"), zero has none. A native format goes by the shortest decimal text and would
    round 1.005 up. The fraction times 10**digits is taken as a product and its exact error, which decides the side of
    a tie; both are below 2**53, so nothing is lost.
    """
    if not 0 <= digits <= MOST_DIGITS:
        raise ValueError(f"digits must be 0 to {MOST_DIGITS}")
    unit = 10**digits
    size = F.abs(v)

    def text(part: Column) -> Column:
        """part is the rounded fraction in units of its last digit."""
        whole = F.when(size < NO_FRACTION, (F.floor(size) + F.when(part >= unit, 1).otherwise(0)).cast("string")).otherwise(_all_digits(size))
        return F.concat(whole, F.lit("."), F.lpad((part % unit).cast("string"), digits, "0")) if digits else whole

    fraction = F.when(size < NO_FRACTION, size - F.floor(size)).otherwise(0.0)
    if digits:
        fixed = let(with_product(fraction, float(unit), lambda p, e: F.floor(p) + F.when(((p - F.floor(p).cast("double")) - 0.5) + e >= 0, 1).otherwise(0)), text)
    else:
        fixed = text(F.when(fraction >= 0.5, 1).otherwise(0))
    shortest = F.regexp_replace(F.regexp_replace(size.cast("string"), r"\.0E", "E"), "E", "e+")
    fixed = F.when(F.isnan(v), "NaN").when(size == float("inf"), "Infinity").when(size >= SHORTEST, shortest).otherwise(fixed)
    return F.when(v.isNotNull(), F.concat(F.when(v < 0, "-").otherwise(""), fixed))
