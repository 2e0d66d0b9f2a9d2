"""Removal of passages that occur more than once, found by super-k-mer partitioning.

A window is ``window`` consecutive words of one text. Every window has a minimiser, the smallest
hash among its runs of ``m`` words, and consecutive windows that share it form a super-k-mer, which
travels as one packed string to the bucket of its minimiser. There the windows are cut out, sorted
as exact byte strings and counted.

What keeps the shuffles small and even:

* Equal texts are processed once. A text that occurs twice has only repeated windows.
* A window can occur twice only if its minimiser occurs twice. So (minimiser, text key) pairs go
  first, 24 bytes each, and only super-k-mers whose minimiser is met again are packed and sent.
* A minimiser whose windows are too many for one bucket is dealt over several by place. Each sorts and
  counts its windows; one representative of every distinct window goes on, with its place if it is the
  only one there, to a second level of buckets, whose minimisers are runs as long as the window. There
  equal windows stand side by side, one of each first bucket. A passage with very many copies is thus
  counted in parts, a common phrase with very many neighbours is spread by them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelquarry.llm.common import free_name, map_text, store

WINDOW = 35
M = 8
HOT = 4096  # windows in a bucket of the first level
LONGEST_RUN = 256  # windows in one packed string


class Splitter:
    """Cuts texts (bytes) into words and super-k-mers."""

    def __init__(self, window: int, m: int, known: int = 300_000):
        if not 1 <= m <= window:
            raise ValueError("m must be between 1 and the window")
        self.window, self.m, self.known = window, m, known
        self.hashes: dict[bytes, int] = {}
        self.factors = (np.random.default_rng(7).integers(1, 2**63, m, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def grams(self, words: list[bytes]) -> np.ndarray:
        """A hash of each run of ``m`` words."""
        known, digest = self.hashes, xxhash.xxh3_64_intdigest
        if len(known) > self.known:
            known.clear()
        values = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            values.append(h)
        word = np.array(values, np.uint64)
        n = len(word) - self.m + 1
        runs = np.zeros(n, np.uint64)
        for j in range(self.m):
            runs += word[j : j + n] * self.factors[j]
        runs ^= runs >> np.uint64(31)
        runs *= np.uint64(0x9E3779B97F4A7C15)
        return runs ^ (runs >> np.uint64(29))

    def minimisers(self, runs: np.ndarray) -> np.ndarray:
        """The smallest hash of ``m`` words in each window."""
        width, have = self.window - self.m + 1, 1  # smallest of each `width` runs, by doubling
        low = runs
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        return low

    def runs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Minimiser (as signed), first window and number of windows of each super-k-mer."""
        return self.cut(self.minimisers(self.grams(words)))

    def repeated_minimisers(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct minimisers, whether the words behind each occur twice or more in this text, and the number of windows with it."""
        grams = self.grams(words)
        values, count = np.unique(grams, return_counts=True)
        mini, windows = np.unique(self.minimisers(grams), return_counts=True)
        return mini.view(np.int64), count[np.searchsorted(values, mini)] > 1, windows

    def cut(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        count = np.diff(np.append(at, len(low)))
        if count.max() > LONGEST_RUN:
            pieces = -(-count // LONGEST_RUN)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            count = np.minimum(np.repeat(count, pieces) - nth * LONGEST_RUN, LONGEST_RUN)
            at = np.repeat(at, pieces) + nth * LONGEST_RUN
        return low[at].view(np.int64), at, count


def with_key(docs: DataFrame, text: str) -> DataFrame:
    """A 128-bit key of the text as two columns; null counts as empty."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumn("_k1", F.xxhash64(whole)).withColumn("_k2", F.xxhash64(F.lit(1), whole))


def minimiser_places(keyed: DataFrame, text: str, window: int, m: int) -> DataFrame:
    """A row (minimiser, text key, whether its words occur twice in the text, windows with it) for each minimiser of each text. Equal texts met by one task give rows once."""
    source = keyed.select(F.col(f"`{text}`").cast("binary"), "_k1", "_k2")
    names = ["_mini", "_k1", "_k2", "_twice", "_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, seen = Splitter(window, m), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256).to_pydict()
                minis, k1s, k2s, twice, counts = [], [], [], [], []
                for raw, k1, k2 in zip(*piece.values(), strict=True):
                    words = raw.split() if raw else ()
                    if len(words) < window or (k1, k2) in seen:
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add((k1, k2))
                    mini, again, windows = splitter.repeated_minimisers(words)
                    minis.append(mini)
                    k1s.append(np.full(len(mini), k1))
                    k2s.append(np.full(len(mini), k2))
                    twice.append(again)
                    counts.append(windows)
                if minis:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (minis, k1s, k2s, twice, counts)], names=names)

    return source.mapInArrow(run, "_mini long, _k1 long, _k2 long, _twice boolean, _n long")


def packed_runs(candidates: DataFrame, window: int, m: int) -> DataFrame:
    """Packed super-k-mers of the texts whose minimiser is among the text's ``_minis``, each with its bucket: the minimiser,
    the number of parts that it is dealt over, and one of them, by text and place."""
    names = ["_mini", "_parts", "_part", "_packed", "_k1", "_k2", "_at"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(window, m)
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                piece = batch.slice(begin, 64).to_pydict()
                rows: list[tuple] = []
                for raw, k1, k2, minis in zip(*piece.values(), strict=True):
                    words, parts = raw.split(), {x["_mini"]: x["_parts"] for x in minis}
                    for mini, at, count in zip(*[x.tolist() for x in splitter.runs(words)], strict=True):
                        if dealt := parts.get(mini):
                            part = xxhash.xxh3_64_intdigest(f"{k1}:{at}") % dealt if dealt > 1 else 0
                            rows.append((mini, dealt, part, b" ".join(words[at : at + count + window - 1]), k1, k2, at))
                    if len(rows) > 20_000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    source = candidates.select(F.col("_text").cast("binary"), "_k1", "_k2", "_minis")
    return source.mapInArrow(run, "_mini long, _parts int, _part int, _packed binary, _k1 long, _k2 long, _at int")


def windows_of(packed: bytes, window: int) -> list[bytes]:
    data = np.frombuffer(packed, np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data)).tolist()
    starts = [0] + [e + 1 for e in ends[:-1]]
    return [packed[starts[i] : ends[i + window - 1]] for i in range(len(ends) - window + 1)]


def counted_in_buckets(packed: DataFrame, window: int) -> DataFrame:
    """Sorts and counts the windows of each bucket of the first level.

    Rows are ranges of windows (``_from``, ``_to``) that are met again in their bucket, and, where a minimiser is dealt
    over several buckets, a representative of each distinct window (``_window``) with its place ``_from`` and whether it
    is ``_alone``.
    """
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    names = ["_k1", "_k2", "_from", "_to", "_window", "_alone"]

    def counted(parts: int, group: list[tuple]) -> list[tuple]:
        if parts == 1 and len(group) == 1 and group[0][0].count(b" ") < window:
            return []
        windows, places = [], []
        for member, (packed_words, _, _, _) in enumerate(group):
            cut = windows_of(packed_words, window)
            windows += cut
            places += [(member, i) for i in range(len(cut))]
        order = sorted(range(len(windows)), key=windows.__getitem__)
        again = set()
        for a, b in zip(order, order[1:], strict=False):
            if windows[a] == windows[b]:
                again |= {a, b}
        out: list[list] = []
        for member, i in sorted(places[j] for j in again):
            _, k1, k2, at = group[member]
            if out and out[-1][6] == member and out[-1][3] == at + i:
                out[-1][3] = at + i + 1
            else:
                out.append([k1, k2, at + i, at + i + 1, None, None, member])
        rows = [tuple(x[:6]) for x in out]
        if parts > 1:
            for n, j in enumerate(order):
                if n == 0 or windows[order[n - 1]] != windows[j]:
                    (member, i), (_, k1, k2, at) = places[j], group[places[j][0]]
                    rows.append((k1, k2, at + i, None, windows[j], j not in again))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, group, rows = None, [], []
        for batch in batches:
            for mini, parts, part, *member in zip(*batch.to_pydict().values(), strict=True):
                if (mini, part) != (bucket and bucket[:2]):
                    if group:
                        rows += counted(bucket[2], group)
                    bucket, group = (mini, part, parts), []
                    if len(rows) > 10_000:
                        yield table_of(rows)
                        rows = []
                group.append(tuple(member))
        if group:
            rows += counted(bucket[2], group)
        if rows:
            yield table_of(rows)

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    ordered = packed.repartition("_mini", "_part").sortWithinPartitions("_mini", "_part")
    return ordered.mapInArrow(run, "_k1 long, _k2 long, _from int, _to int, _window binary, _alone boolean")


def met_in_other_buckets(representatives: DataFrame) -> DataFrame:
    """Ranges of the windows that are alone in their bucket of the first level but not in all of them.

    Windows come sorted, so a row is compared with the one before and nothing is collected.
    """
    names = ["_k1", "_k2", "_from", "_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, None  # the window before, and its place while nothing equal has come
        for batch in batches:
            rows = []
            for text, alone, k1, k2, at in zip(*[batch.column(c).to_pylist() for c in ("_window", "_alone", "_k1", "_k2", "_from")], strict=True):
                place = (k1, k2, at, at + 1) if alone else None
                if text == last:
                    rows += [x for x in (waiting, place) if x]
                    waiting = None
                else:
                    last, waiting = text, place
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 2 + [pa.int32()] * 2, strict=True)], names=names)

    keyed = representatives.select(F.xxhash64("_window").alias("_key"), "_window", "_alone", "_k1", "_k2", "_from")
    return keyed.repartition("_key").sortWithinPartitions("_key", "_window").mapInArrow(run, "_k1 long, _k2 long, _from int, _to int")


def repeated_windows(keyed: DataFrame, text: str, window: int, m: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Candidate texts (key, ``_text``) and, per text key, lists of ranges of windows that start elsewhere too."""
    places = store(minimiser_places(keyed, text, window, m), "minimisers")
    met = places.groupBy("_mini").agg(F.min("_k1").alias("a"), F.max("_k1").alias("b"), F.max("_twice").alias("twice"), F.sum("_n").alias("n"))
    parts = F.ceil(F.col("n") / max(hot, 1)).cast("int")
    met = store(met.filter("a != b or twice").select("_mini", parts.alias("_parts")), "met-again")
    mine = places.join(met, "_mini").groupBy("_k1", "_k2").agg(F.collect_set(F.struct("_mini", "_parts")).alias("_minis"))
    texts = keyed.groupBy("_k1", "_k2").agg(F.first(f"`{text}`").alias("_text"))
    candidates = store(texts.join(mine, ["_k1", "_k2"]), "candidates")
    counted = store(counted_in_buckets(store(packed_runs(candidates, window, m), "super-k-mers"), window), "windows")
    first = counted.filter("_window is null").select("_k1", "_k2", "_from", "_to")
    second = met_in_other_buckets(counted.filter("_window is not null"))
    ranges = first.unionByName(second).groupBy("_k1", "_k2").agg(F.collect_list(F.struct("_from", "_to")).alias("_ranges"))
    return candidates.select("_k1", "_k2", "_text"), ranges


def drop_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, m: int = M, hot: int = HOT, texts: bool = True) -> DataFrame:
    """Removes every word covered by a window whose words also start anywhere else in the table, the same document included.

    Returns the rows of ``docs`` with ``n_words``, ``n_removed`` and ``kept_sha256`` (of the words that stay, one blank
    between). ``text`` loses the words (texts that lose none stay as they are; null stays null); with ``texts=False`` the
    column is left out, which saves a shuffle of the texts. Words are runs of bytes other than ASCII blanks; null has none.
    ``hot`` is the number of windows from which a minimiser's bucket is dealt over several. A row is never dropped, and every row counts as a place: equal rows repeat each other, and null or repeated ids need
    no care. Other columns of ``docs`` with the names of results are replaced.
    """
    held = free_name(docs, "_held")
    results = {"n_words", "n_removed", "kept_sha256", text.lower()}
    stay = [c for c in docs.columns if c.lower() not in results]
    keyed = with_key(docs.select(F.col(f"`{text}`").alias(held), *[F.col(f"`{c}`") for c in stay]), held)
    candidates, ranges = repeated_windows(keyed.select(held, "_k1", "_k2"), held, window, m, hot)

    def removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                removed, digests, left = [], [], []
                for raw, spans in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    words = raw.split()
                    edges = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edges, [s["_from"] for s in spans], 1)
                    np.add.at(edges, [s["_to"] + window - 1 for s in spans], -1)
                    gone = np.cumsum(edges)[:-1] > 0
                    kept = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])
                    removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    left.append(kept if texts else None)
                columns = [piece.column(2), piece.column(3), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["_k1", "_k2", "_n", "_sha", "_left"])

    found = candidates.join(ranges, ["_k1", "_k2"]).select(F.col("_text").cast("binary"), "_ranges", "_k1", "_k2")
    part = found.mapInArrow(removal, "_k1 long, _k2 long, _n long, _sha string, _left binary")
    copies = keyed.groupBy("_k1", "_k2").agg(F.count("*").alias("_copies")).filter("_copies > 1")
    changed = store(part.join(copies, ["_k1", "_k2"], "full_outer"), "changed")

    shape = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("_sha_of_all", T.StringType())])

    def start():
        def work(raws: list) -> list:
            words = [raw.split() if raw else [] for raw in raws]
            return [[len(w) for w in words], [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]]

        return work

    counted = map_text(keyed, held, shape, start, [c for c in keyed.columns if texts or c != held])
    joined = counted.join(changed, ["_k1", "_k2"], "left")
    all_gone = F.col("_copies").isNotNull() & (F.col("n_words") >= window)
    columns = {
        "n_removed": F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("_n", F.lit(0))),
        "kept_sha256": F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_sha", "_sha_of_all")),
    }
    if texts:
        columns[text] = F.when(all_gone, F.lit("")).when(F.col("_n") > 0, F.col("_left").cast("string")).otherwise(F.col(f"`{held}`"))
    back = {c: F.col(f"`{c}`") for c in docs.columns if c in stay} | {"n_words": F.col("n_words")} | columns
    order = [c for c in docs.columns if c in back] + ["n_words", "n_removed", "kept_sha256"]
    return joined.select(*[back[c].alias(c) for c in dict.fromkeys(order)])
