"""Column expressions: rounding, clamping, parsing and the geometry of depth maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low, high) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(lit(low), F.least(lit(high), x))


def to_byte(x: Column) -> Column:
    """A share of 1 as 0..255, halves to even."""
    return F.rint(clamp(x * 255.0, 0, 255)).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def requested_dimension(size: Column, factor: Column | float) -> Column:
    """A scaled dimension, halves up, 1 at least."""
    return F.greatest(F.lit(1), F.floor(size * factor + 0.5).cast("int"))


def padded_dimension(size: Column, multiple: int = 14) -> Column:
    return (F.ceil(size / multiple) * multiple).cast("int")


def fitted_dimension(size: Column, longest: Column, target: int = 504, multiple: int = 14) -> Column:
    """A dimension scaled so that the longest is ``target``, at the nearest multiple (ties up)."""
    scaled = F.rint(size * (F.lit(float(target)) / longest))
    return F.greatest(F.lit(multiple), F.floor(scaled / multiple + 0.5) * multiple).cast("int")


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor: Euclid's steps, folded over as many as 64-bit numbers need."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, 0).otherwise(s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, step, lambda s: s["a"])


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def nearest_fraction(num: Column, den: Column, limit: int = 10_000) -> Column:
    """The fraction (num, den) nearest to ``num / den`` with a denominator of ``limit`` at most: its continued fraction, folded.

    Ends at the last convergent, or at the fraction between the last two if that is nearer.
    """
    long = lambda c: c.cast("long")
    names = ("p0", "q0", "p1", "q1", "n", "d")
    start = F.struct(*[long(F.lit(v)).alias(k) for k, v in zip(names, (0, 1, 1, 0), strict=False)], long(F.abs(num)).alias("n"), long(den).alias("d"))

    def step(s, _):
        a = F.when(s["d"] > 0, F.floor(F.try_divide(s["n"] - F.pmod(s["n"], F.greatest(s["d"], F.lit(1))), s["d"]))).otherwise(0)

        def next_of(a):
            more = (s["d"] > 0) & (s["q0"] + a * s["q1"] <= limit)
            new = (s["p1"], s["q1"], s["p0"] + a * s["p1"], s["q0"] + a * s["q1"], s["d"], s["n"] - a * s["d"])
            return F.struct(*[long(F.when(more, v).otherwise(s[k])).alias(k) for k, v in zip(names, new, strict=True)])

        return once(long(a), next_of)

    def finish(s):
        k = long(F.floor((F.lit(limit) - s["q0"]) / F.greatest(s["q1"], F.lit(1))))
        p, q = s["p0"] + k * s["p1"], s["q0"] + k * s["q1"]
        x = F.abs(num).cast("double") / den.cast("double")
        other = (s["d"] > 0) & (F.abs(p / q - x) < F.abs(s["p1"] / s["q1"] - x))
        sign = F.when(num < 0, -1).otherwise(1)
        return F.struct(long(sign * F.when(other, p).otherwise(s["p1"])).alias("num"), long(F.when(other, q).otherwise(s["q1"])).alias("den"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, step, finish)


def fraction(text: Column) -> Column:
    """``a/b``, reduced, or a decimal as the nearest fraction with a denominator of 10,000 at most; null if there is none.

    Decimals are read to nine places: fractions of such denominators differ by more.
    """
    parts = F.split(F.trim(text), "/")
    whole = F.size(parts) == 1
    value = parts.getItem(0).try_cast("double")
    decimal = F.when(whole & (F.abs(value) < 1e9), F.rint(value * 1e9).cast("long"))
    num, den = parts.getItem(0).try_cast("long"), F.when(F.size(parts) == 2, parts.getItem(1).try_cast("long"))
    good = num.isNotNull() & den.isNotNull() & (den != 0)
    divisor = F.greatest(F.lit(1).cast("long"), gcd(F.abs(num), F.abs(den))) * F.when(den < 0, -1).otherwise(1)
    reduced = once(divisor, lambda g: F.struct((num / g).cast("long").alias("num"), (den / g).cast("long").alias("den")))
    return F.when(whole, F.when(decimal.isNotNull(), nearest_fraction(decimal, F.lit(1_000_000_000).cast("long")))).when(good, reduced)


def is_positive_fraction(text: Column) -> Column:
    """Whether :func:`fraction` is greater than 0 (null if there is none), without its folds.

    The nearest fraction of a decimal is 0 up to half of 1/10,000.
    """
    parts = F.split(F.trim(text), "/")
    whole = F.size(parts) == 1
    value = parts.getItem(0).try_cast("double")
    decimal = F.when(whole & (F.abs(value) < 1e9), F.rint(value * 1e9).cast("long"))
    num, den = parts.getItem(0).try_cast("long"), F.when(F.size(parts) == 2, parts.getItem(1).try_cast("long"))
    good = num.isNotNull() & den.isNotNull() & (den != 0)
    return F.when(whole, decimal > 50_000).when(good, (num != 0) & ((num > 0) == (den > 0)))


def rate_or(text: Column, default: float = 30.0) -> Column:
    """``a/b`` or a number as a positive rate, else ``default``."""
    parts = F.split(F.trim(text), "/")
    value = F.when(F.size(parts) == 2, F.try_divide(parts.getItem(0).try_cast("double"), parts.getItem(1).try_cast("double"))).otherwise(parts.getItem(0).try_cast("double"))
    return F.when(value > 0, value).otherwise(F.lit(default))
