"""Choosing objects to label next. Pools are large; picks are few."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelquarry.functions.numbers import hash_number, seeded_key
from labelquarry.operators.ranks import BUCKET, ranks, values_at_ranks

# Objects per labelling round, and the upper edges of the score bins.
BATCH_SIZE = 8
SCORE_EDGES = (-0.5, -0.25, 0.0, 0.1, 0.25, 0.3, 0.5, 1.0)


class Strategy(Protocol):
    def select(self, pool: DataFrame, k: int, seed: int) -> DataFrame: ...


def unlabeled_pool(objects: DataFrame, labeled: DataFrame, key: str = "object_id") -> DataFrame:
    return objects.join(labeled.select(key), key, "left_anti")


def uncertain(pool: DataFrame, k: int = BATCH_SIZE, key: str = "object_id") -> DataFrame:
    """The k objects closest to the decision boundary; equal certainty goes by id."""
    return pool.orderBy(F.abs("score"), key).limit(k)


def uncertain_spread(pool: DataFrame, k: int = BATCH_SIZE, seed: int = 0, key: str = "object_id") -> DataFrame:
    """As :func:`uncertain`, with a seeded random choice among equally certain objects."""
    return pool.orderBy(F.abs("score"), seeded_key(seed, F.col(key)), key).limit(k)


def uncertain_weighted(pool: DataFrame, labeled: DataFrame, k: int = BATCH_SIZE,
                       key: str = "object_id") -> DataFrame:
    """Certainty plus the slide's share of the objects chosen so far, so slides take turns."""
    per_slide = labeled.groupBy("slide").agg(F.count(F.lit(1)).alias("_taken"))
    total = per_slide.agg(F.sum("_taken")).scalar()
    weight = F.coalesce(F.col("_taken") / total, F.lit(0.0))
    return (
        pool.join(per_slide, "slide", "left")
        .withColumn("weighted", F.abs("score") + weight)
        .drop("_taken")
        .orderBy("weighted", key)
        .limit(k)
    )


def most_uncertain(pool: DataFrame, key: str = "object_id") -> DataFrame:
    return uncertain(pool, 1, key)


def random_sample(pool: DataFrame, k: int, seed: int = 0, key: str = "object_id") -> DataFrame:
    """k objects in seeded hash order, without replacement; a smaller pool gives fewer rows."""
    return pool.orderBy(seeded_key(seed, F.col(key)), key).limit(k)


def uncertain_subsample(pool: DataFrame, k: int = BATCH_SIZE, share: float = 0.1, seed: int = 0,
                        key: str = "object_id") -> DataFrame:
    """The most uncertain objects of a seeded random share of the pool."""
    drawn = hash_number(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))) < int(share * 2**32)
    return uncertain(pool.where(drawn), k, key)


def with_score_bin(df: DataFrame) -> DataFrame:
    """Zero-based score bin by upper edges; the last bin is open."""
    chain = F.when(F.col("score") <= SCORE_EDGES[0], F.lit(0))
    for i, edge in enumerate(SCORE_EDGES[1:-1], start=1):
        chain = chain.when(F.col("score") <= edge, F.lit(i))
    return df.withColumn("bin", chain.otherwise(F.lit(len(SCORE_EDGES) - 1)))


def bin_samples(pool: DataFrame, per_bin: int = 1, seed: int = 0, key: str = "object_id") -> DataFrame:
    """One random object (or ``per_bin``) from each score bin.

    An empty bin borrows from the next filled one, cyclically, and takes the next object
    there. The rank filter is applied before the shuffle, so a bin sends few rows however
    full it is.
    """
    bins = len(SCORE_EDGES)
    slots = bins * per_bin
    by_hash = Window.partitionBy("bin").orderBy("_h", key)
    candidates = (
        with_score_bin(pool)
        .withColumn("_h", seeded_key(seed, F.col(key)))
        .withColumn("_pick", F.row_number().over(by_hash))
        .where(F.col("_pick") <= slots)
        .drop("_h")
    )
    filled = candidates.select(F.col("bin").alias("source")).distinct()
    spark = pool.sparkSession
    asked = spark.range(2 * bins).select(F.col("id").cast("int").alias("_slot")).withColumn(
        "_bin", F.col("_slot") % bins
    )
    ahead = Window.orderBy("_slot").rowsBetween(0, Window.unboundedFollowing)
    sources = (
        asked.join(filled, F.col("_bin") == F.col("source"), "left")
        .withColumn("source", F.first("source", ignorenulls=True).over(ahead))
        .where((F.col("_slot") < bins) & F.col("source").isNotNull())
        .select(F.col("_slot").alias("asked_bin"), "source", F.explode(F.sequence(F.lit(1), F.lit(per_bin))).alias("_rep"))
    )
    turn = Window.partitionBy("source").orderBy("_rep", "asked_bin")
    sources = sources.withColumn("_pick", F.row_number().over(turn)).drop("_rep")
    return candidates.withColumnRenamed("bin", "source").join(sources, ["source", "_pick"]).drop("_pick")


def display_strata(pool: DataFrame, strata: int, groups: int, key: str = "object_id") -> DataFrame:
    """Samples spread over the score range of each class.

    Scores ascend within the negative and the positive class. With n objects of a class,
    stratum 0 starts at rank 0, stratum i at ⌊i·n/(S−1)⌋ and the last one at n − G − 1; group g
    takes the rank g places on. One stratum takes the most uncertain objects of each class.
    Equal scores are ordered by the hash of the id. Rows carry ``position``, counting group by
    group, negatives before positives.
    """
    signed = pool.withColumn("positive", (F.col("score") >= 0).cast("int"))

    def starts(n):
        if strata == 1:
            return [F.when(F.col("positive") == 1, F.lit(0)).otherwise(n - groups)]
        inner = [F.floor((F.lit(i) * n) / (strata - 1)) for i in range(1, strata - 1)]
        return [F.lit(0), *inner, n - groups - 1]

    def wanted(n):
        return F.array(*[
            F.struct(F.struct(F.lit(s).alias("stratum"), F.lit(g).alias("grp")).alias("label"),
                     (start + g).cast("long").alias("rank"))
            for g in range(groups) for s, start in enumerate(starts(n))
        ])

    counts = signed.groupBy("positive", "score").agg(F.count(F.lit(1)).alias("n"))
    hits = values_at_ranks(counts, ["positive"], "score", wanted)
    # A handful of picks: one list per (class, score) that was hit.
    asked = hits.groupBy("positive", "score").agg(
        F.collect_list(F.struct("label", F.col("tie_rank").alias("rank"))).alias("_asked")
    )
    ties = (
        signed.join(asked, ["positive", "score"])
        .withColumn("_h", F.md5(F.col(key).cast("string")))
    )
    # Hashes lie evenly, so their first letters are even buckets.
    tie_counts = ties.groupBy("positive", "score", "_asked", "_h").agg(F.count(F.lit(1)).alias("n")).withColumn(
        BUCKET, F.conv(F.substring("_h", 1, 3), 16, 10).cast("long"))
    picks = values_at_ranks(
        tie_counts, ["positive", "score", "_asked"], "_h", lambda n: F.col("_asked"),
    ).select("positive", "score", "_h", "label.stratum", "label.grp")
    position = (
        F.col("grp") * (2 * strata) + F.col("positive") * strata + F.col("stratum")
    )
    return (
        ties.drop("_asked").join(picks, ["positive", "score", "_h"])
        .withColumn("position", position).drop("_h")
    )


class UncertaintyStrategy:
    """Most uncertain first; ``spread`` breaks ties at random."""

    def __init__(self, spread: bool = False):
        self.spread = spread

    def select(self, pool: DataFrame, k: int = BATCH_SIZE, seed: int = 0) -> DataFrame:
        return uncertain_spread(pool, k, seed) if self.spread else uncertain(pool, k)


class RandomStrategy:
    def select(self, pool: DataFrame, k: int = BATCH_SIZE, seed: int = 0) -> DataFrame:
        return random_sample(pool, k, seed)


class SubsampleStrategy:
    def __init__(self, share: float = 0.1):
        self.share = share

    def select(self, pool: DataFrame, k: int = BATCH_SIZE, seed: int = 0) -> DataFrame:
        return uncertain_subsample(pool, k, self.share, seed)


class BinStrategy:
    """Random picks dealt over the score bins in turn, ``k`` in all (or the whole pool, if it is smaller)."""

    def select(self, pool: DataFrame, k: int = BATCH_SIZE, seed: int = 0) -> DataFrame:
        by_hash = Window.partitionBy("bin").orderBy(seeded_key(seed, F.col("object_id")), "object_id")
        dealt = with_score_bin(pool).withColumn("_pick", F.row_number().over(by_hash)).where(F.col("_pick") <= k)
        return dealt.orderBy("_pick", "bin").limit(k).drop("_pick", "bin")
