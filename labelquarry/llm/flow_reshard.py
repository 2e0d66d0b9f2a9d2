"""Resharding by minimum-cost flow.

Rows belong to blocks, and blocks lie in old shards. From the bytes in each old shard and the capacity of
each new one, a minimum-cost flow says how many bytes go from where to where; staying costs nothing,
every byte moved costs one. Blocks then carry the flow out, largest first. Shards that neither give
nor take a block are left as they are; the others are written anew.

A block is a hash range of texts, so that equal texts stay together. A text whose copies would make up more than
``split`` of a shard is dealt out over blocks by the row's id, since no shard could take it otherwise. Sums
over blocks, and the texts that are dealt out, are bounded by parameters, not by the data.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelquarry.llm.common import store
from labelquarry.session import scratch_path

OLD_SHARDS = 20
NEW_SHARDS = 24
BLOCKS = 1024  # of an old shard
SPLIT = 0.5  # of a new shard: copies of one text above it are dealt out
SLOTS = 64  # parts of a shard that are numbered on their own

SIZE_OVERHEAD = 8


def size_of(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + SIZE_OVERHEAD).cast("long")


def minimum_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> np.ndarray:
    """Integer flow from sources to sinks that ships all supply at the least cost, by successive shortest paths with
    potentials. Capacities must add up to the supply or more."""
    m, n = len(supply), len(capacity)
    source, sink = m + n, m + n + 1
    graph: list[list[list[int]]] = [[] for _ in range(m + n + 2)]  # edge: to, room, cost, index of its reverse

    def link(a: int, b: int, room: int, price: int) -> list[int]:
        forward, backward = [b, room, price, len(graph[b])], [a, 0, -price, len(graph[a])]
        graph[a].append(forward)
        graph[b].append(backward)
        return forward

    for i, s in enumerate(supply):
        link(source, i, s, 0)
    edges = [[link(i, m + j, supply[i], cost[i][j]) for j in range(n)] for i in range(m)]
    for j, c in enumerate(capacity):
        link(m + j, sink, c, 0)
    left, potential = sum(supply), [0] * len(graph)
    while left:
        distance, way = {source: 0}, {}
        heap, done = [(0, source)], set()
        while heap:
            d, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            for edge in graph[a]:
                b, room, price, _ = edge
                if room and b not in done and (new := d + price + potential[a] - potential[b]) < distance.get(b, 1 << 62):
                    distance[b], way[b] = new, (a, edge)
                    heapq.heappush(heap, (new, b))
        if sink not in distance:
            raise ValueError("the capacities are too small")
        far = max(distance.values())
        potential = [p + distance.get(a, far) for a, p in enumerate(potential)]
        amount, at = left, sink
        while at != source:
            at, edge = way[at]
            amount = min(amount, edge[1])
        at = sink
        while at != source:
            before, edge = way[at]
            edge[1] -= amount
            graph[at][edge[3]][1] += amount
            at = before
        left -= amount
    return np.array([[supply[i] - edges[i][j][1] for j in range(n)] for i in range(m)], dtype=object)


def carry_out(flow: np.ndarray, blocks: dict[int, list[tuple[int, int]]]) -> dict[int, int]:
    """New shard of each block. ``blocks``: (bytes, block) by old shard. The largest block goes first, each to where most of the
    flow is still open, so that shards end up within about one small block of the plan."""
    out = {}
    behind = np.zeros(flow.shape[1])  # what earlier old shards sent a new shard less than planned
    for i in range(len(flow)):
        open_ = flow[i].astype(float)
        wanted = open_ > 0
        open_ = np.where(wanted, open_ + behind, -np.inf)
        planned = flow[i].astype(float)
        for size, block in sorted(blocks.get(i, ()), reverse=True):
            j = int(np.argmax(open_)) if wanted.any() else i % flow.shape[1]
            open_[j] -= size
            planned[j] -= size
            out[block] = j
        behind += planned
    return out


class Plan:
    """``target``: new shard by block; ``affected``: new shards that must be written."""

    def __init__(self, target: list[int], old_shards: int, new_shards: int, hot: list[int], moved_bytes: int):
        self.target, self.old_shards, self.new_shards, self.hot, self.moved_bytes = target, old_shards, new_shards, hot, moved_bytes
        moving = [(b % old_shards, t) for b, t in enumerate(target) if b % old_shards != t]
        self.affected = sorted({x for pair in moving for x in pair if x < new_shards} | set(range(old_shards, new_shards)))


def with_block(docs: DataFrame, text: str, doc_id: str, hot: list[int], total_blocks: int) -> DataFrame:
    """Adds ``_block``. ``hot``: hashes of the texts that are dealt out (a bounded list)."""
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    dealt = F.xxhash64(key, F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    chosen = F.when(F.array_contains(F.array(*map(F.lit, hot)), key), dealt).otherwise(key) if hot else key
    return docs.withColumn("_block", F.pmod(chosen, F.lit(total_blocks)).cast("int"))


def plan_reshard(docs: DataFrame, text: str, doc_id: str, old_shards: int, new_shards: int, blocks: int, split: float) -> Plan:
    total_blocks = old_shards * blocks
    sized = docs.select(text, doc_id, size_of(text).alias("_size"))
    total = sized.agg(F.sum("_size")).first()[0] or 0
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    large = sized.groupBy(key.alias("_key")).agg(F.sum("_size").alias("bytes"), F.count("*").alias("n"))
    # At most new_shards / split texts can be that large, whatever the size of the data.
    hot = sorted(r._key for r in large.filter((F.col("bytes") > split * total / new_shards) & (F.col("n") > 1)).select("_key").collect())
    sums = with_block(sized, text, doc_id, hot, total_blocks).groupBy("_block").agg(F.sum("_size").alias("bytes")).collect()
    by_old: dict[int, list[tuple[int, int]]] = {}
    for row in sums:
        by_old.setdefault(row._block % old_shards, []).append((row.bytes, row._block))
    supply = [sum(s for s, _ in by_old.get(i, ())) for i in range(old_shards)]
    capacity = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    flow = minimum_cost_flow(supply, capacity, [[int(i != j) for j in range(new_shards)] for i in range(old_shards)])
    chosen = carry_out(flow, by_old)
    target = [chosen.get(b, b % old_shards) for b in range(total_blocks)]
    moved = sum(s for i, rows in by_old.items() for s, b in rows if target[b] != i)
    return Plan(target, old_shards, new_shards, hot, moved)


def reshard(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS, blocks: int = BLOCKS, split: float = SPLIT, path: str | None = None) -> tuple[DataFrame, Plan]:
    """Moves the rows of ``docs`` from ``old_shards`` (block modulo their number) to ``new_shards`` of nearly equal bytes.

    Writes the affected shards as Parquet below ``path`` (``_shard=N`` folders, several files each; the shared scratch folder if none is
    given) and returns all rows, read from there, with ``_size`` and ``_shard``, together with the plan. Rows of shards that are not
    affected come from ``docs``. Null texts count as empty, null ids as the empty id; repeated
    rows lie in one shard. Columns of ``docs`` named ``_size``, ``_shard`` or ``_block`` are replaced.
    """
    docs = docs.drop("_size", "_shard", "_block")
    plan = plan_reshard(docs, f"`{text}`", f"`{doc_id}`", old_shards, new_shards, blocks, split)
    targets = docs.sparkSession.createDataFrame(list(enumerate(plan.target)), "_block int, _shard int")
    blocked = with_block(docs, f"`{text}`", f"`{doc_id}`", plan.hot, old_shards * blocks).withColumn("_size", size_of(f"`{text}`"))
    placed = blocked.join(F.broadcast(targets), "_block")  # as many rows as there are blocks
    stays = placed.filter(~F.col("_shard").isin(plan.affected)).drop("_block")
    moved = placed.filter(F.col("_shard").isin(plan.affected))
    spread = moved.drop("_block").hint("rebalance", "_shard")  # adaptive execution splits large shards into files
    folder = path or scratch_path(docs.sparkSession, "shards")
    spread.write.partitionBy("_shard").parquet(folder)
    schema = T.StructType([f for f in spread.schema if f.name != "_shard"] + [spread.schema["_shard"]])
    written = docs.sparkSession.read.schema(schema).parquet(folder)
    return written.unionByName(stays) if len(plan.affected) < new_shards else written, plan


def number_slots(rows: DataFrame, shard: str = "_shard", order: tuple[str, ...] = ("doc_id",), parts: int = SLOTS, slot: str = "slot") -> DataFrame:
    """Numbers the rows of each shard without gaps from 0: parts of a shard are counted first, then numbered on their own from
    the sum of the parts before. Parts are dealt by hash of the order columns."""
    parted = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    parted = store(parted, "slots")
    counts = parted.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows a shard
    counts = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(shard, "_part").orderBy(*order)
    numbered = parted.withColumn("_own", F.row_number().over(own))
    # As many rows as shards times parts.
    return numbered.join(F.broadcast(counts), [shard, "_part"]).withColumn(slot, F.col("_own") + F.col("_before") - 1).drop("_own", "_before", "_part")
