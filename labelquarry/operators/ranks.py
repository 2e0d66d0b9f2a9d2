"""Exact ranks and running totals that do not send a whole group to one task.

Rows come already aggregated per (group, value). :func:`place` cuts each group into buckets of about
equally many rows at values drawn from the data; totals per bucket place each bucket, and only the rows
of one bucket are ordered together. A group holding most of the data is therefore spread over its
buckets, however narrow or lopsided its values are. The cuts decide where work is done, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"
ROWS_PER_BUCKET = 32768  # aimed at, while the table has fewer than MOST_DRAWN / DRAWN_PER_BUCKET times as many rows
DRAWN_PER_BUCKET = 16
MOST_DRAWN = 1 << 19  # rows drawn of a table of any size; a sixteenth of them are sent to every task as cuts
_FAN = 128  # cuts that a row is compared with at once
_HASHES = 1 << 30


def reading_all(grouped, df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregates that read every column of ``df``.

    Without the (always true) condition on all columns the optimizer would prune this branch
    differently from the one that keeps the rows, and everything below would run twice
    instead of sharing an exchange.
    """
    others = [c for c in df.columns if c not in keys]
    out = grouped.agg(*aggregates, F.bit_xor(F.hash(*others)).alias("_read"))
    return out.where("_read IS NOT NULL").drop("_read")


def _located(cuts: Column, value: Column) -> Column:
    """How many of at most 255 ascending cuts are not above the value, by halving; 0 without cuts or value."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(8))])
    at = lambda pos, step: F.get(cuts, pos + step - 1)
    return F.aggregate(steps, F.lit(0), lambda pos, step: pos + F.when(at(pos, step) <= value, step).otherwise(F.lit(0)))


def cuts_of(df: DataFrame, keys: Sequence[str], order: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per group the ascending cuts in two levels: ``_coarse``, and ``_fine`` with the cuts between two coarse ones."""
    total = reading_all(df.groupBy(), df, [], F.count(F.lit(1)).alias("_total")).select("_total").scalar()
    share = F.least(F.lit(DRAWN_PER_BUCKET / rows_per_bucket), F.lit(float(MOST_DRAWN)) / total)
    # The random term is zero; with it the draw is not pushed below the shared exchange.
    drawn = df.where(F.pmod(F.xxhash64(order), F.lit(_HASHES)) < share * _HASHES + F.rand(0) * 0)
    lists = reading_all(drawn.groupBy(*keys), df, keys, F.array_sort(F.collect_list(order)).alias("_drawn"))
    every = lists.select(*keys, F.filter("_drawn", lambda x, i: (i + 1) % DRAWN_PER_BUCKET == 0).alias("_all")).where(F.size("_all") > 0)
    chunked = every.withColumn("_chunk", F.ceil((F.size("_all") + 1) / _FAN).cast("int"))
    coarse = F.filter("_all", lambda x, i: (i + 1) % F.col("_chunk") == 0)
    fine = F.transform(
        F.sequence(F.lit(0), F.size("_coarse")), lambda j: F.slice("_all", j * F.col("_chunk") + 1, F.greatest(F.col("_chunk") - 1, F.lit(0))))
    return chunked.withColumn("_coarse", coarse).withColumn("_fine", fine).select(*keys, "_coarse", "_fine")


def place(df: DataFrame, keys: Sequence[str], order: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``_bucket``, a number that never falls as ``order`` rises within a group.

    ``df`` has one row per (keys, order). The cuts of a group are every 16th of its drawn values; values are drawn by
    their hash, so a repeated run draws the same. A bucket holds more than three times the rows aimed at with a
    probability below 1e-6. A group too small to have cuts has one bucket. Values may be numbers, times or texts; null
    comes first and NaN last, as in Spark's order.
    """
    return place_by(df, cuts_of(df, keys, order, rows_per_bucket), keys, order)


def place_by(df: DataFrame, cuts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """As :func:`place`, by cuts of another table with the same groups and values; here several rows may share a value."""
    keys = list(keys)
    if keys:
        placed = df.join(F.broadcast(cuts), keys, "left")  # at most MOST_DRAWN / DRAWN_PER_BUCKET values in all
    else:
        placed = df.withColumns({"_coarse": cuts.select("_coarse").scalar(), "_fine": cuts.select("_fine").scalar()})
    first = _located(F.col("_coarse"), F.col(order))
    placed = placed.withColumn("_first", first)
    second = _located(F.get("_fine", F.col("_first")), F.col(order))
    return placed.select(*df.columns, F.coalesce(F.col("_first").cast("long") * 256 + second, F.lit(0)).alias(BUCKET))


def _placed(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows with their buckets, dealt by them: window and totals per bucket share this exchange."""
    return _refusing_null(df if BUCKET in df.columns else place(df, keys, order), keys).repartition(*keys, BUCKET)


def _refusing_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fails on null keys, whose rows the joins below would lose.

    The last alternative is never reached, but makes the key one that can't be null: a join on it then adds no filter to
    one of two equal subplans, and the exchange below them is reused.
    """
    def guard(k: str) -> Column:
        kind = df.schema[k].dataType
        refused = F.raise_error(F.lit(f"null in {k}")).cast(kind)
        if isinstance(kind, T.StringType):
            return F.coalesce(F.col(k), refused, F.lit(""))
        if isinstance(kind, (T.NumericType, T.BooleanType)):
            return F.coalesce(F.col(k), refused, F.lit(0).cast(kind))
        return F.coalesce(F.col(k), refused)

    return df.withColumns({k: guard(k) for k in keys if df.schema[k].nullable}) if keys else df


def _per_bucket(binned: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    by = [*keys, BUCKET]
    return reading_all(binned.groupBy(*by), binned, by, *aggregates)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    totals: dict[str, str],
    falling: bool = False,
) -> DataFrame:
    """Inclusive running sums per ``keys`` in the order of a column, or from its largest value down if ``falling``.

    ``totals`` maps output names to the columns to sum. ``df`` has one row per (keys, order)
    and no null keys; if it went through :func:`place`, its buckets are used and kept.
    """
    keys = list(keys)
    binned = _placed(df, keys, order)
    turn = lambda c: F.desc(c) if falling else F.asc(c)
    before = Window.partitionBy(*keys).orderBy(turn("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        _per_bucket(binned, keys, *[F.sum(c).alias(f"_sum_{out}") for out, c in totals.items()])
        .select(
            *keys,
            "_bucket",
            *[F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_off_{out}") for out in totals],
        )
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = binned.select("*", *[F.sum(c).over(inside).alias(f"_in_{out}") for out, c in totals.items()])
    return local.join(offsets, [*keys, "_bucket"]).select(
        *df.columns, *[(F.col(f"_in_{out}") + F.col(f"_off_{out}")).alias(out) for out in totals]
    )


def previous_values(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Column ``previous``: the value of the row before, per ``keys`` in the order of a
    column; null on the first row. ``df`` has one row per (keys, order), and may be placed."""
    keys = list(keys)
    binned = _placed(df, keys, order)
    ends = _per_bucket(binned, keys, F.max_by(value, order).alias("_end")).withColumn(
        "_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_bucket"))
    ).drop("_end")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    local = binned.withColumns(
        {"_local": F.lag(value).over(inside), "_first": F.row_number().over(inside) == 1}
    )
    return local.join(ends, [*keys, "_bucket"]).select(
        *df.columns, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_local")).alias("previous")
    )


def values_at_ranks(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Callable[[Column], Column],
) -> DataFrame:
    """The value at given zero-based ranks of each group.

    ``counts`` has one row per (keys, value) with a count ``n``, and may be placed. ``wanted`` turns the group
    size into an array of ``struct<label, rank>``. Returns ``keys, value, label, rank,
    tie_rank``, where ``tie_rank`` counts from the first row that shares the value.
    """
    keys = list(keys)
    binned = _placed(counts.select(*keys, value, "n", *[c for c in counts.columns if c == BUCKET]), keys, value)
    ordered = Window.partitionBy(*keys).orderBy("_bucket")
    per_bucket = (
        _per_bucket(binned, keys, F.sum("n").alias("_in"))
        .withColumn("_upto", F.sum("_in").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_size", F.sum("_in").over(Window.partitionBy(*keys)))
        .withColumn(
            "_wanted",
            F.filter(
                wanted(F.col("_size")),
                lambda t: (t["rank"] >= F.col("_upto") - F.col("_in")) & (t["rank"] < F.col("_upto")),
            ),
        )
        .where(F.size("_wanted") > 0)
        .select(*keys, "_bucket", (F.col("_upto") - F.col("_in")).alias("_before"), "_wanted")
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        binned.join(per_bucket, [*keys, "_bucket"])
        .withColumn("_upto", F.col("_before") + F.sum("n").over(inside))
        .withColumn(
            "_hit",
            F.filter(
                "_wanted", lambda t: (t["rank"] >= F.col("_upto") - F.col("n")) & (t["rank"] < F.col("_upto"))
            ),
        )
        .select(*keys, value, F.explode("_hit").alias("_t"), (F.col("_upto") - F.col("n")).alias("_from"))
        .select(
            *keys,
            value,
            F.col("_t.label").alias("label"),
            F.col("_t.rank").alias("rank"),
            (F.col("_t.rank") - F.col("_from")).alias("tie_rank"),
        )
    )


def single_row(df: DataFrame) -> Column:
    """The columns of a one-row table as a struct, read by one scalar subquery."""
    return df.select(F.struct(*df.columns)).scalar()


def ranks(**by_label: Column) -> Column:
    """An array of ``struct<label, rank>`` for :func:`values_at_ranks`."""
    return F.array(
        *[F.struct(F.lit(k).alias("label"), v.cast("long").alias("rank")) for k, v in by_label.items()]
    )


def _counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The exact median per group (mean of the two middle values), column ``median``."""
    middle = values_at_ranks(
        _counted(df, keys, value), keys, value, lambda n: ranks(low=F.floor((n - 1) / 2), high=F.floor(n / 2)))
    return middle.groupBy(*keys).agg(F.avg(value).alias("median"))


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The element ⌊n/2⌋ of the ascending values per group, column ``median``."""
    return upper_median_of_counts(_counted(df, keys, value), keys, value)


def upper_median_of_counts(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """As :func:`upper_median`, from one row per (keys, value) with a count ``n``."""
    return values_at_ranks(counts, keys, value, lambda n: ranks(median=F.floor(n / 2))).select(
        *keys, F.col(value).alias("median")
    )
