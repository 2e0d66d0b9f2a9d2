"""Near-duplicate vectors by NN-descent.

Equal vectors form one class. A neighbour graph starts from groups of vectors that lie on the same side
of random planes. Then, round by round, the neighbours of each vector are compared with each other and
better ones replace worse, until the number of links hardly grows. Edges below ``floor`` are not kept: two
neighbours that link to the same vector are never further apart.

A list that is full of links may have lost some. Those inside its component are found by comparing the members of each
component in blocks, which counts links without making a row of each. For those to other components a second graph is built, whose
lists hold only vectors of other components; the links in it join components, until no such link is left.
The number of tables of planes follows the number of planes, so that even two vectors that only have each other meet in one.
An audit compares a bounded random set of vectors with all by brute force; below the wanted recall for vectors of few, some or
many links, the graph gets as many tables again and more rounds. If that does not help, there is an error and no answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelquarry.llm.common import groups, matrix, store
from labelquarry.llm.graph import components

THRESHOLD = 0.9
NEIGHBOURS = 10
TABLES = 8  # sets of random planes for the start, at least
DEEP = 24  # further planes that split crowded sides, at most
PASSES = 4  # each doubles the tables
GROUP = 64  # vectors in a group, on average
ROUNDS = 4
GROWTH = 0.001  # of the number of links, below which rounds end
AUDIT = 512  # vectors compared with all, of those with no, few and many links found
FEW = 10
RECALL = 0.99  # wanted
BLOCK = 512  # vectors in a block of a component


def _classes(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, cls) and classes (cls, vec: unit vector, many: number of rows, low: smallest id). Unfit vectors have no class."""
    value = F.transform(F.col(f"`{embedding}`"), lambda x: x.cast("double"))
    fit = value.isNotNull() & (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.when(fit, value).alias("v"))
    # Scaled by the largest component first, so that no square overflows or vanishes.
    largest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    scaled = F.expr("transform(v, x -> x / big)")
    length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("big", largest).withColumn("s", scaled).withColumn("len", length).withColumn("u", F.expr("transform(s, x -> x / len)"))
    key = F.when(F.col("v").isNotNull(), F.unhex(F.md5(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string"))))))
    rows = store(rows.select("vec_id", "u", key.alias("cls")), "vectors")
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.first("u").alias("vec"), F.count("*").alias("many"), F.min("vec_id").alias("low"))
    return rows.select("vec_id", "cls"), store(classes, "vector-classes")


def _best(numbers: np.ndarray, names: list, keep: int, floor: float, homes: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows (a, b, cosine) of each vector's ``keep`` nearest in this group; with ``homes``, of those with another home."""
    near = numbers @ numbers.T
    np.fill_diagonal(near, -2)
    if homes is not None:
        near[homes[:, None] == homes[None]] = -2
    keep = min(keep, len(names) - 1)
    if keep < 1:
        return
    top = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
    for i, row in enumerate(top):
        for j in row:
            if near[i, j] >= floor:
                yield names[i], names[j], float(near[i, j])


def _compare(grouped: DataFrame, keys: int, keep: int, floor: float) -> DataFrame:
    """Edges (a, b, near) inside groups of (keys..., cls, vec); if a column ``home`` follows, only between different homes."""
    apart = len(grouped.columns) > keys + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for _, table in groups(batches, keys):
            seen = dict(zip(table.column(keys).to_pylist(), range(table.num_rows), strict=True))  # a class may come twice
            at = list(seen.values())
            homes = None
            if apart:
                own = table.column(keys + 2).to_pylist()
                homes = np.unique([own[k] for k in at], return_inverse=True)[1]
                if homes.max() == 0:
                    continue
            rows += _best(matrix(table.column(keys + 1))[at], list(seen), keep, floor, homes)
            if len(rows) > 20_000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["a", "b", "near"])

    by = grouped.columns[:keys]
    return grouped.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a binary, b binary, near double")


def _lists(edges: DataFrame, keep: int) -> DataFrame:
    """(a, list of (away, b)): the ``keep`` nearest of each vector."""
    nearest = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("near")).alias("away"), "b"))), 1, keep)
    return edges.groupBy("a").agg(nearest.alias("list"))


def _tables(bits: int, threshold: float, recall: float) -> int:
    """Tables of ``bits`` planes after which two vectors at the threshold have met, but for a quarter of the loss that ``recall`` allows."""
    together = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    lost = max((1 - recall) / 4, 1e-4)
    return 1 if together >= 1 - lost else math.ceil(math.log(lost) / math.log1p(-together))


def _planes(classes: DataFrame, tables: range, bits: int, seed: int) -> DataFrame:
    """(table, side, deep, cls): the sides of random planes on which each vector lies, for each table, and those of further planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, vectors = batch.column(0), batch.column(1)
            sizes = np.array([len(x) for x in vectors])
            for d in np.unique(sizes):
                pick = pa.array(np.flatnonzero(sizes == d))
                numbers = matrix(vectors.take(pick))
                for t in tables:
                    above = numbers @ np.random.default_rng([seed, t, int(d)]).normal(size=(d, bits + DEEP)) > 0
                    side = above[:, :bits] @ (1 << np.arange(bits)) + (int(d) << 32)
                    deep = above[:, bits:] @ (1 << np.arange(DEEP))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(side), t, np.int32)), pa.array(side.astype(np.int64)), pa.array(deep.astype(np.int64)), names.take(pick)], names=["t", "side", "deep", "cls"])

    return classes.select("cls", "vec").mapInArrow(run, "t int, side long, deep long, cls binary")


def _shape(classes: DataFrame) -> list[str]:
    return [c for c in ("cls", "vec", "home") if c in classes.columns]


def _start(classes: DataFrame, tables: range, bits: int, seed: int, keep: int, floor: float) -> DataFrame:
    """Edges inside groups of vectors on the same side of planes. A crowded side is split by further planes, which part near
    vectors less often than far ones; what is crowded still is dealt over groups, another way in each table."""
    sides = store(_planes(classes, tables, bits, seed), "sides")
    groups_of = F.ceil(F.count("*") / (2 * GROUP))
    crowd = sides.groupBy("t", "side").agg(F.least(F.ceil(F.log2(groups_of)), F.lit(DEEP)).cast("int").alias("more"))
    split = sides.join(crowd, ["t", "side"]).select("t", "side", F.expr("deep & (shiftleft(1L, more) - 1)").alias("deep"), "cls")
    rest = split.groupBy("t", "side", "deep").agg(groups_of.cast("int").alias("n"))
    dealt = split.join(rest, ["t", "side", "deep"]).select("t", "side", "deep", F.pmod(F.xxhash64("cls", "t"), F.col("n")).cast("int").alias("part"), "cls")
    return _compare(dealt.join(classes, "cls").select("t", "side", "deep", "part", *_shape(classes)), 4, keep, floor)


def _round(edges: DataFrame, classes: DataFrame, keep: int, floor: float) -> DataFrame:
    """Edges between the neighbours, in both directions, of each vector; a vector with many is dealt over groups. ``edges``: a, b."""
    both = store(edges.select(F.col("a").alias("centre"), F.col("b").alias("cls")).union(edges.select("b", "a")).distinct(), "neighbours")
    crowd = both.groupBy("centre").agg(F.count("*").alias("k")).filter("k > 1").select("centre", F.ceil(F.col("k") / (2 * GROUP)).cast("int").alias("n"))
    crowd = store(crowd, "centres")
    dealt = both.join(crowd, "centre").select("centre", F.pmod(F.xxhash64("cls", "centre"), F.col("n")).cast("int").alias("part"), "cls")
    return _compare(dealt.join(classes, "cls").select("centre", "part", *_shape(classes)), 2, keep, floor)


def _edges(lists: DataFrame) -> DataFrame:
    return lists.select("a", F.explode("list").alias("e")).select("a", "e.b", (-F.col("e.away")).alias("near"))


def _descend(edges: DataFrame, classes: DataFrame, keep: int, floor: float, rounds: int, threshold: float, beside: DataFrame | None = None) -> DataFrame:
    """The lists of ``edges`` (a, b, near) after NN-descent. ``beside``: edges (a, b) that lead to neighbours, but are in no list."""
    links_in = F.sum(F.size(F.filter("list", lambda x: x["away"] <= -threshold)))
    lists = store(_lists(edges, keep), "neighbour-lists")
    links = lists.agg(links_in).first()[0]  # null without any edge
    for _ in range(rounds):
        if links is None:
            break
        known = _edges(lists)
        ways = known.select("a", "b") if beside is None else known.select("a", "b").union(beside.select("a", "b"))
        lists = store(_lists(known.unionByName(_round(ways, classes, keep, floor)), keep), "neighbour-lists")
        before, links = links, lists.agg(links_in).first()[0]
        if links - before <= GROWTH * before:
            break
    return lists


def _bits(n: int) -> int:
    return max(0, min(24, math.ceil(math.log2(max(n, 1) / GROUP))))


def _joined(lists: DataFrame, bridges: DataFrame | None, classes: DataFrame, tables: range, seed: int, neighbours: int, floor: float, rounds: int, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """(cls, component) of all vectors with links, and ``bridges``: links (a, b) between what were components by the lists alone.

    Only components with more members than a list holds may have full lists on both ends of a lost link. As long as
    vectors of such components have links to other ones, these join them. A component that has any finds some, so
    components at least halve and loops are few.
    """
    known = _edges(lists)
    linked = known.filter(F.col("near") >= threshold).select("a", "b")
    keep = max(2, neighbours // 2)
    while True:
        found = store(components(linked if bridges is None else linked.union(bridges)).withColumnRenamed("node", "cls"), "vector-components")
        full = found.groupBy("component").agg(F.count("*").alias("k")).filter(F.col("k") > keep).select("component")
        if full.limit(2).count() < 2:
            return found, bridges
        apart = store(found.join(full, "component").join(classes, "cls").select("cls", "vec", F.col("component").alias("home")), "full-components")
        start = _start(apart, tables, _bits(apart.count()), seed, keep, floor)
        across = _edges(_descend(start, apart, neighbours, floor, rounds, threshold, known))
        new = store(across.filter(F.col("near") >= threshold).select("a", "b"), "bridges")
        if new.isEmpty():
            return found, bridges
        bridges = new if bridges is None else bridges.union(new)


def _inside(members: DataFrame, threshold: float) -> DataFrame:
    """(cls, found): links of each class inside its component, counted in rows. ``members``: component, cls, vec, many."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    dealt = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("n")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = pairs.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "vec", "many")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), table in groups(batches, 3):
            own, many = table.column(3).to_numpy(), table.column(6).to_numpy()
            numbers = matrix(table.column(5))
            near = numbers @ numbers.T >= threshold
            np.fill_diagonal(near, False)
            if i != j:
                near &= own[:, None] != own[None]
            yield pa.RecordBatch.from_arrays([table.column(4).combine_chunks(), pa.array((near @ many).astype(np.int64))], names=["cls", "found"])

    ordered = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return ordered.mapInArrow(run, "cls binary, found long").groupBy("cls").agg(F.sum("found").alias("found"))


def audit(classes: DataFrame, found: DataFrame, threshold: float = THRESHOLD, sample: int = AUDIT) -> float:
    """The mean share of a vector's links that was found, for vectors of one, few or many links: the least of the three.

    Links are found by comparing vectors with all others. At most ``sample`` are taken of the vectors for which no, few and many
    links were found, and each stands for as many as were not taken; so neither hot components nor vectors without links hide the rest.
    """
    shares = store(classes.select("cls").join(found, "cls", "left").select("cls", F.coalesce("found", F.lit(0)).alias("found")), "audited")
    band = F.when(F.col("found") == 0, 0).when(F.col("found") <= FEW, 1).otherwise(2)
    shares = shares.withColumn("band", band)
    sizes_of = {r.band: r["count"] for r in shares.groupBy("band").count().collect()}
    asked_for = None
    for k in sizes_of:
        some = shares.filter(F.col("band") == k).orderBy(F.xxhash64("cls", F.lit(1)), "cls").limit(sample)
        asked_for = some if asked_for is None else asked_for.union(some)
    if asked_for is None:
        return 1.0
    picked = asked_for.join(classes.select("cls", "vec"), "cls").collect()
    taken: dict[int, int] = {}
    by_size: dict[int, list] = {}
    for row in picked:
        taken[row.band] = taken.get(row.band, 0) + 1
        by_size.setdefault(len(row.vec), []).append(row)
    asked = {d: (np.array([r.vec for r in rows]), [bytes(r.cls) for r in rows]) for d, rows in by_size.items()}
    sent = classes.sparkSession.sparkContext.broadcast(asked)  # at most three times ``sample`` vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {name: 0 for _, names in sent.value.values() for name in names}
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(1)])
            for d in np.unique(sizes):
                if d in sent.value:
                    numbers, names = sent.value[d]
                    pick = np.flatnonzero(sizes == d)
                    others = matrix(batch.column(1).take(pa.array(pick))).T
                    own = [batch.column(0)[int(k)].as_py() for k in pick]
                    many = batch.column(2).to_numpy(zero_copy_only=False)[pick]
                    place = {n: k for k, n in enumerate(own)}
                    for at in range(0, len(names), BLOCK):
                        near = numbers[at : at + BLOCK] @ others >= threshold
                        for r, name in enumerate(names[at : at + BLOCK]):
                            total[name] += int(near[r] @ many) - (int(many[place[name]]) * bool(near[r, place[name]]) if name in place else 0)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["cls", "true"])

    truth = classes.select("cls", "vec", "many").mapInArrow(run, "cls binary, true long").groupBy("cls").agg(F.sum("true").alias("true"))
    true = {bytes(r.cls): r.true for r in truth.collect()}
    weights, got = [0.0] * 3, [0.0] * 3
    for r in picked:
        links = true[bytes(r.cls)]
        if links:
            degree, weight = (links > 1) + (links > FEW), sizes_of[r.band] / taken[r.band]
            weights[degree] += weight
            got[degree] += weight * min(r.found, links) / links
    return min((g / w for g, w in zip(got, weights, strict=True) if w), default=1.0)


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS, tables: int = TABLES, rounds: int = ROUNDS, recall: float = RECALL, seed: int = 17) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id``, ``n_links`` (other rows at cosine >= ``threshold``), ``component_id`` (smallest id
    reachable) and ``kept`` (whether it is the row's own).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of different
    lengths. Equal vectors link. Repeated rows count as different vectors; a null id is the smallest only if
    there is no other. An error tells that the wanted recall was not reached.
    """
    floor = 2 * threshold * threshold - 1  # cosine of twice the angle: what shares a link is at least this near
    rows, classes = _classes(vectors, vec_id, embedding)
    n = classes.count()
    bits = _bits(n)
    tables = max(tables, _tables(bits, threshold, recall))
    lists, bridges, done = None, None, 0
    for last in range(1, PASSES + 1):
        made = range(done, max(tables, 2 * done))
        edges = _start(classes, made, bits, seed, max(2, neighbours // 2), floor)
        done = made.stop
        if lists is not None:
            edges = edges.unionByName(_edges(lists))
        lists = _descend(edges, classes, neighbours, floor, rounds, threshold)
        found, bridges = _joined(lists, bridges, classes, made, seed, neighbours, floor, rounds, threshold)
        members = found.join(classes, "cls").select("component", "cls", "vec", "many")
        counts = store(_inside(members, threshold), "link-counts")
        share = 1.0 if n < 2 else audit(classes, counts, threshold)
        if share >= recall:
            break
        if last == PASSES:
            raise RuntimeError(f"{share:.4f} of the links of sampled vectors were found with {done} tables, {recall} are wanted")
    named = classes.select("cls", "many", "low").join(found, "cls", "left").select("cls", "many", "low", F.coalesce("component", "cls").alias("component"))
    named = store(named.join(counts, "cls", "left"), "named")
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    answer = store(named.join(lowest, "component").select("cls", (F.coalesce("found", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id"), "vector-answer")
    out = rows.join(answer, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
