"""Colour and texture work on pixel tables (slide, object_id, px, py, r, g, b)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelquarry.operators.ranks import median, single_row

# Colour matrices, discriminants and stains.
RGB_TO_LMS = (
    (0.3811, 0.5783, 0.0402),
    (0.1967, 0.7244, 0.0782),
    (0.0241, 0.1288, 0.8444),
)
LMS_TO_RGB = (
    (4.4687, -3.5887, 0.1196),
    (-1.2197, 2.3831, -0.1626),
    (0.0585, -0.2611, 1.2057),
)
LAB_ROWS = ((1, 1, 1), (1, 1, -2), (1, -1, 0))
LAB_SCALES = (1 / math.sqrt(3), 1 / math.sqrt(6), 1 / math.sqrt(2))
BACKGROUND_DISCRIMINANT = (-0.154, 0.035, 0.549, -45.718)
FOREGROUND_DISCRIMINANT = (-0.057, -0.817, 1.170, -49.887)
STAIN_COLOURS = ((0.650, 0.072, 0.0), (0.704, 0.990, 0.0), (0.0, 0.0, 0.0))
SINGLE_EPSILON = 2.0**-52
AREA_LIMITS_FIRST = (10, 1000)
AREA_LIMITS_SECOND = (20, 1000)


def _combine(weights, columns: list[Column]) -> Column:
    total = None
    for w, c in zip(weights, columns):
        term = c * F.lit(float(w))
        total = term if total is None else total + term
    return total


def rgb_to_lab(df: DataFrame) -> DataFrame:
    """Columns lab_l, lab_a, lab_b from r, g, b in 0–255; black gives null (its logarithm is −∞)."""
    rgb = [F.col(c) / 255.0 for c in ("r", "g", "b")]
    logs = [F.log10(_combine(row, rgb)) for row in RGB_TO_LMS]
    lab = [_combine(row, logs) * F.lit(scale) for row, scale in zip(LAB_ROWS, LAB_SCALES)]
    return df.withColumns(dict(zip(("lab_l", "lab_a", "lab_b"), lab)))


def lab_to_rgb(df: DataFrame) -> DataFrame:
    """Columns r, g, b (0–1 scale) from lab; undefined values become zero before mixing."""
    scaled = [F.col(c) * F.lit(s) for c, s in zip(("lab_l", "lab_a", "lab_b"), LAB_SCALES)]
    columns = np.array(LAB_ROWS).T
    lms = [F.coalesce(F.pow(F.lit(10.0), _combine(row, scaled)), F.lit(0.0)) for row in columns]
    return df.withColumns(dict(zip(("r", "g", "b"), [_combine(row, lms) for row in LMS_TO_RGB])))


def is_foreground(r: Column, g: Column, b: Column) -> Column:
    def side(m):
        return _combine(m[:3], [r.cast("double"), g.cast("double"), b.cast("double")]) + F.lit(m[3])

    return side(BACKGROUND_DISCRIMINANT) < side(FOREGROUND_DISCRIMINANT)


def foreground(df: DataFrame) -> DataFrame:
    return df.where(is_foreground(F.col("r"), F.col("g"), F.col("b")))


def color_stats(pixels: DataFrame) -> DataFrame:
    """Mean and sample deviation of the foreground in lab space per slide; undefined pixels do
    not count."""
    lab = rgb_to_lab(foreground(pixels)).where(
        F.col("lab_l").isNotNull() & F.col("lab_a").isNotNull() & F.col("lab_b").isNotNull()
    )
    channels = ("lab_l", "lab_a", "lab_b")
    return lab.groupBy("slide").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in channels], *[F.stddev_samp(c).alias(f"std_{c}") for c in channels]
    )


def transfer_colors(lab_pixels: DataFrame, own: DataFrame, target: DataFrame) -> DataFrame:
    """Lab pixels shifted and scaled from their slide's statistics (``own``, one row per slide)
    to those of ``target`` (one row); null where the slide's deviation is zero."""
    joined = lab_pixels.join(own, "slide").withColumn("_target", single_row(target))
    changes = {}
    for c in ("lab_l", "lab_a", "lab_b"):
        mean_t, std_t = F.col(f"_target.mean_{c}"), F.col(f"_target.std_{c}")
        changes[c] = (F.col(c) - F.col(f"mean_{c}")) * F.try_divide(std_t, F.col(f"std_{c}")) + mean_t
    return joined.withColumns(changes).select(*lab_pixels.columns)


def optical_density(value: Column) -> Column:
    return -(255.0 * F.log(value / 255.0)) / math.log(255.0)


def from_optical_density(density: Column) -> Column:
    return F.exp(-(density - 255.0) * math.log(255.0) / 255.0)


def stain_matrix(stains=STAIN_COLOURS) -> np.ndarray:
    """Unit stain columns; a missing third stain is completed from the first two."""
    m = np.array(stains, dtype=float)
    for i in range(3):
        length = np.linalg.norm(m[:, i])
        if length >= SINGLE_EPSILON:
            m[:, i] /= length
    if np.linalg.norm(m[:, 2]) < SINGLE_EPSILON:
        rest = 1.0 - m[:, 0] ** 2 - m[:, 1] ** 2
        m[:, 2] = np.sqrt(np.clip(rest, 0.0, None))
        m[:, 2] /= np.linalg.norm(m[:, 2])
    return m


def unmix_stains(df: DataFrame, stains=STAIN_COLOURS) -> DataFrame:
    """Columns stain1 and stain2: the stain intensities behind each colour."""
    inverse = np.linalg.inv(stain_matrix(stains))
    densities = [optical_density(F.col(c).cast("double") + SINGLE_EPSILON) for c in ("r", "g", "b")]
    return df.withColumns({
        f"stain{i + 1}": from_optical_density(_combine(inverse[i], densities)) for i in range(2)
    })


def remix_stains(df: DataFrame, stains=STAIN_COLOURS) -> DataFrame:
    """Columns r, g, b (0–255, rounded) from the three stain intensities stain1 … stain3."""
    m = stain_matrix(stains)
    densities = [optical_density(F.col(f"stain{i}").cast("double")) for i in (1, 2, 3)]
    level = lambda row: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(from_optical_density(_combine(row, densities)))))
    return df.withColumns({c: level(m[i]).cast("int") for i, c in enumerate("rgb")})


def area_filter(pixels: DataFrame, limits: tuple[int, int] = AREA_LIMITS_FIRST) -> DataFrame:
    """Objects whose pixel count lies strictly between the limits."""
    low, high = limits
    return pixels.groupBy("slide", "object_id").agg(F.count(F.lit(1)).alias("area")).where(
        (F.col("area") > low) & (F.col("area") < high)
    )


def object_intensity(pixels: DataFrame, value: str = "value") -> DataFrame:
    """Mean, mean − median, maximum, minimum and sample deviation per object."""
    keys = ["slide", "object_id"]
    moments = pixels.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"),
        F.stddev_samp(value).alias("std"),
    )
    return moments.join(median(pixels, keys, value), keys).select(
        *keys, "mean", (F.col("mean") - F.col("median")).alias("mean_median_difference"), "max", "min", "std"
    )


def object_texture(pixels: DataFrame, value: str = "value") -> DataFrame:
    """Entropy (bits) and energy of the 256-level histogram, skewness and (not excess) kurtosis.

    Pixels are counted per (object, value) first, and moments come from the counts.
    """
    keys = ["slide", "object_id"]
    tally = pixels.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    v, n = F.col(value).cast("double"), F.col("n").cast("double")
    level = F.least(F.greatest(F.round(v), F.lit(0.0)), F.lit(255.0)).cast("int")
    histogram = tally.groupBy(*keys, level.alias("_level")).agg(
        F.sum("n").alias("_n"), F.sum(n * v).alias("_s1"),
    )
    size = histogram.groupBy(*keys).agg(
        F.sum("_n").alias("_size"), (F.sum("_s1") / F.sum("_n")).alias("_mean"),
        (F.log2(F.sum("_n")) - F.sum(F.col("_n") * F.log2("_n")) / F.sum("_n")).alias("entropy"),
        (F.sum(F.pow(F.col("_n").cast("double"), F.lit(2))) / F.pow(F.sum("_n").cast("double"), F.lit(2))).alias("energy"),
    )
    off = v - F.col("_mean")
    central = tally.join(size, keys).groupBy(*keys, "entropy", "energy").agg(
        *[(F.sum(n * F.pow(off, F.lit(k))) / F.sum(n)).alias(f"_m{k}") for k in (2, 3, 4)]
    )
    return central.select(
        *keys, "entropy", "energy",
        F.try_divide(F.col("_m3"), F.pow("_m2", F.lit(1.5))).alias("skewness"),
        F.try_divide(F.col("_m4"), F.pow("_m2", F.lit(2))).alias("kurtosis"),
    )


def gradient_magnitude(pixels: DataFrame, value: str = "value", image: tuple[str, ...] = ("slide",)) -> DataFrame:
    """Column ``value`` replaced by the size of the gradient: central differences inside the
    image (named by the ``image`` columns), one-sided ones at its edge.

    Each pixel sends its value to its four neighbours and itself, so one aggregation per
    pixel position collects what a pixel needs; no row or column is ordered as a whole.
    """
    v = F.col(value).cast("double")
    moves = F.array(*[
        F.struct(F.lit(role).alias("role"), (F.col("px") + dx).alias("px"), (F.col("py") + dy).alias("py"))
        for role, dx, dy in (("own", 0, 0), ("left", 1, 0), ("right", -1, 0), ("up", 0, 1), ("down", 0, -1))
    ])
    carried = [c for c in ("slide", "object_id") if c not in image]
    sent = pixels.select(*image, *carried, v.alias("_v"), F.inline(moves))
    take = lambda role, c="_v": F.max(F.when(F.col("role") == role, F.col(c)))
    met = sent.groupBy(*image, "px", "py").agg(
        *[take(r).alias(f"_{r}") for r in ("own", "left", "right", "up", "down")],
        *[take("own", c).alias(c) for c in carried],
    ).where("_own IS NOT NULL")

    def slope(low, high):
        a, b, own = F.col(low), F.col(high), F.col("_own")
        return F.coalesce((b - a) / 2.0, b - own, own - a, F.lit(0.0))

    gx, gy = slope("_left", "_right"), slope("_up", "_down")
    return met.select("slide", "object_id", "px", "py", F.sqrt(gx * gx + gy * gy).alias(value))


def object_gradient(pixels: DataFrame, value: str = "value", image: tuple[str, ...] = ("slide",)) -> DataFrame:
    """Mean, deviation, entropy, energy, skewness and kurtosis of the gradient size per object."""
    size = gradient_magnitude(pixels, value, image)
    spread = size.groupBy("slide", "object_id").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    return spread.join(object_texture(size, value), ["slide", "object_id"])
