"""Column functions on numbers and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_number(text: Column) -> Column:
    """The first 32 bits of the MD5 of a text, as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def seeded_key(seed: int, identifier: Column) -> Column:
    """A reproducible pseudo-random sort key of a row."""
    return F.md5(F.concat(F.lit(f"{seed}:"), identifier.cast("string")))


def two_digit_scientific(value: Column) -> Column:
    """``a × 10^b`` with the mantissa rounded to two decimals; zero stays zero."""
    v = value.cast("double")
    exponent = F.floor(F.log10(F.abs(v)))
    mantissa = F.round(v / F.pow(F.lit(10.0), exponent), 2)
    return F.when(v == 0, F.lit(0.0)).otherwise(mantissa * F.pow(F.lit(10.0), exponent))


def bind(value: Column, body) -> Column:
    """``body`` applied to a value that is computed once per row.

    Written out inside a higher-order function, an array expression would be computed again
    for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def score_to_probability(score: Column) -> Column:
    return (score + 1.0) / 2.0


def probability_to_score(probability: Column) -> Column:
    return probability * 2.0 - 1.0


def sign_class(score: Column, tie_positive: bool = True) -> Column:
    """+1 / −1 by the sign of the score; ``tie_positive`` decides where zero goes."""
    positive = score >= 0 if tie_positive else score > 0
    return F.when(positive, F.lit(1)).otherwise(F.lit(-1))


def gray_level(value: Column, norm: Column) -> Column:
    """Grey 0–255 of a map value relative to a normaliser."""
    return F.least(255.0 * value / norm, F.lit(255.0)).cast("int")


def zscore(features: Column, mean: Column, std: Column) -> Column:
    """Centred and scaled; null where the deviation is zero."""
    centred = F.zip_with(features, mean, lambda f, m: f.cast("double") - m)
    return F.zip_with(centred, std, lambda f, s: F.try_divide(f, s.cast("double")))


def unzscore(features: Column, mean: Column, std: Column) -> Column:
    scaled = F.zip_with(features, std, lambda f, s: f.cast("double") * s)
    return F.zip_with(scaled, mean, lambda f, m: f + m)


def log2_edges(low: float, high: float, count: int) -> Column:
    """``count`` edges from 2^low to 2^high, evenly spaced in the exponent."""
    step = (high - low) / (count - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda i: F.when(i == count - 1, F.lit(2.0**high)).otherwise(F.pow(F.lit(2.0), low + i * step)),
    )


def repeat_value(value: Column, times: int) -> Column:
    return F.array_repeat(value, times)


def arrays_equal(a: Column, b: Column) -> Column:
    """Element by element comparison, null-safe."""
    return a.eqNullSafe(b)


def pick_elements(values: Column, positions: Column) -> Column:
    """The elements at zero-based positions."""
    return F.transform(positions, lambda i: F.get(values, i))


def elements_where(values: Column, flags: Column) -> Column:
    """The elements whose flag is true."""
    pairs = F.filter(F.arrays_zip(values.alias("v"), flags.alias("f")), lambda p: p["f"])
    return F.transform(pairs, lambda p: p["v"])
