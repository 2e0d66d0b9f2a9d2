"""How quality filters interact: what each removes in every order in which they could be applied.

Each text is reduced to a mask of the filters that it fails, and rows to counts per (part, mask, labels). Each
such cell folds across the array of all orders by SQL functions (``aggregate`` within an order, ``transform``
over the orders), which gives one weighted struct for each of the 120 x 5 (order, step) places; the cells of a
part are then merged by adding the structs place by place.

A text is grouped by its SHA-256, as (digest, id) pairs, so that neither a text with very many copies nor a very
common text gathers in one task.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelquarry.llm.common import map_text

# The names of the filters and their limits.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3
SYMBOLS = b"#$%&*|"

_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(raw: bytes) -> int:
    """Bits 0 to 3: whether a text (UTF-8) fails filters A to D."""
    words = raw.split()
    few = len(words) < LEAST_WORDS
    repeating = 100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    shouting = 100 * capitals > MOST_CAPITALS_PERCENT * len(raw.translate(None, _CONTINUED))
    symbols = len(raw.translate(None, SYMBOLS)) < len(raw)
    return few + 2 * repeating + 4 * shouting + 8 * symbols


def text_masks(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``_mask`` (filters A to D) and ``_digest`` of each text; null counts as empty."""
    def start():
        def work(raws: list) -> list:
            raws = [r or b"" for r in raws]
            return [[text_mask(r) for r in raws], [hashlib.sha256(r).digest() for r in raws]]

        return work

    return map_text(docs, text, T.StructType([T.StructField("_mask", T.IntegerType()), T.StructField("_digest", T.BinaryType())]), start, keep)


def mask_cells(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """Rows (part, mask, quality, toxic, n): how many documents share part, failed filters (bit 4: E) and labels.

    A row fails E if a smaller id has the same text. Rows with a null id fail no E and are no smaller id; repeated rows of
    one id don't repeat each other. A document with several labels counts as good or toxic if one of them says so.
    """
    slim = docs.select(F.col(f"`{text}`").alias("_text"), F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"))
    rows = text_masks(slim, "_text", ["_id", "part"]).groupBy("_digest", "_id", "part", "_mask").agg(F.count(F.lit(1)).alias("_n"))
    first = rows.groupBy("_digest").agg(F.min("_id").alias("_id")).filter("_id is not null").withColumn("_first", F.lit(True))
    flag = lambda c: F.max((F.col(f"`{c}`") == 1).cast("int"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(flag("quality").alias("_good"), flag("toxic").alias("_toxic"))
    repeats = F.col("_id").isNotNull() & F.col("_first").isNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        rows.join(first, ["_digest", "_id"], "left").join(marks, "_id", "left")
        .groupBy("part", (F.col("_mask") + F.when(repeats, 16).otherwise(0)).alias("mask"), zero("_good").alias("quality"), zero("_toxic").alias("toxic"))
        .agg(F.sum("_n").alias("n"))
    )


def order_array(filters: str = FILTERS) -> Column:
    """All orders of the filters, each as an array of bit numbers."""
    return F.array(*[F.array(*[F.lit(filters.index(f)) for f in order]) for order in permutations(filters)])


def fold_orders(mask: Column, n: Column, quality: Column, toxic: Column, orders: Column) -> Column:
    """One struct of weighted counts per (order, step), in the order of the orders and steps."""
    fails = lambda b: F.call_function("getbit", mask.cast("long"), b) == 1

    def step(state: Column, b: Column) -> Column:
        now, gone = fails(b), state["gone"]
        goes = now & ~gone
        weight = lambda c: F.when(c, n).otherwise(F.lit(0).cast("long"))
        counts = F.struct(
            weight(~gone & ~now).alias("kept"), weight(goes).alias("removed"), weight(now & gone).alias("redundant"),
            weight(mask == F.call_function("shiftleft", F.lit(1), b)).alias("unique_fails"),
            weight(goes & (quality == 1)).alias("good_lost"), weight(goes & (toxic == 1)).alias("toxic_lost"),
        )
        return F.struct((gone | now).alias("gone"), F.concat(state["out"], F.array(counts)).alias("out"))

    empty = F.lit([]).cast("array<struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">>")
    start = F.struct(F.lit(False).alias("gone"), empty.alias("out"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["out"])))


def audit_orders(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts of each part for all orders and steps of the filters, from its mask cells.

    Returns (part, filter_order, step) with ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``,
    ``toxic_lost`` and ``shapley`` (what the step's filter removes, summed over all orders). A part has at most
    2^filters x 4 cells, so cells and results don't grow with the documents. No cells give no rows.
    """
    orders = cells.sparkSession.range(1).select(order_array(filters)).scalar()  # sent to every task once: 120 x 5 numbers, whatever the input
    folded = cells.withColumn("_orders", orders).select(
        "part", F.posexplode(fold_orders(F.col("mask"), F.col("n"), F.col("quality"), F.col("toxic"), F.col("_orders"))).alias("_place", "_counts"),
    )
    merged = folded.groupBy("part", "_place").agg(*[F.sum(f"_counts.{c}").alias(c) for c in COUNTS])
    names = F.array(*[F.lit("".join(o)) for o in permutations(filters)])
    steps = len(filters)
    placed = merged.select(
        "part", F.element_at(names, (F.floor(F.col("_place") / steps) + 1).cast("int")).alias("filter_order"),
        (F.col("_place") % steps + 1).cast("int").alias("step"), *COUNTS,
    )
    filter_of = F.substring("filter_order", F.col("step"), F.lit(1))
    same_filter = Window.partitionBy("part", filter_of)  # as many rows as there are orders
    return placed.withColumn("shapley", F.sum("removed").over(same_filter))
