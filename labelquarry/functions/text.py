"""Column functions on text, polygons and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelquarry.schemas import POINTS


def fixed_point(value: Column, digits: int = 1) -> Column:
    """The number with a fixed count of decimals, as text."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


def position_key(x: Column, y: Column) -> Column:
    """The text key ``x_y`` of a position, one decimal each."""
    return F.concat_ws("_", fixed_point(x), fixed_point(y))


def position_decimal(value: Column) -> Column:
    """A coordinate as the decimal(10,1) that positions are joined on (the cast rounds half up)."""
    return value.cast("decimal(10,1)")


def polygon_points(text: Column, separator: str = " ") -> Column:
    """``x,y x,y …`` (or ``x,y;x,y;…``) to an array of points; empty parts are skipped, and a
    coordinate that is no number is null."""
    parts = F.filter(F.split(F.trim(text), separator), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.split_part(p, F.lit(","), F.lit(1)).try_cast("double").alias("x"),
            F.split_part(p, F.lit(","), F.lit(2)).try_cast("double").alias("y"),
        ),
    ).cast(POINTS)


def polygon_text(points: Column, separator: str = ";", digits: int = 1) -> Column:
    """Points to ``x,y;x,y;…`` with a closing separator."""
    parts = F.transform(
        points, lambda p: F.concat(fixed_point(p["x"], digits), F.lit(","), fixed_point(p["y"], digits))
    )
    return F.concat(F.array_join(parts, separator), F.lit(separator))


def compact_polygon(text: Column) -> Column:
    """Semicolon polygon text to space separated whole-number coordinates (decimals dropped)."""
    return F.array_join(
        F.filter(
            F.split(F.regexp_replace(text, r"\.\d", ""), ";"), lambda p: F.trim(p) != ""
        ),
        " ",
    )


def slide_from_directory(path: Column) -> Column:
    """Name of the directory a file lies in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def name_stem(name: Column) -> Column:
    """Text before the first dot."""
    return F.substring_index(name, ".", 1)


def last_path_part(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def clean_header(name: str) -> str:
    """A CSV header name without carriage returns and outer blanks."""
    return name.replace("\r", "").strip()
