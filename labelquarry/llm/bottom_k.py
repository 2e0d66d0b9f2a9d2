"""Near-duplicate documents by bottom-k sketches from one hash function.

Documents with equal shingle sets form one class; all that follows works on classes. A
class's sketch holds the ``K`` smallest hashes of its set. Inverted lists of retained values generate overlaps:
of two classes that reach the threshold, at least ``LEAST`` of the ``K`` smallest hashes of the union
are in both sketches (probability of fewer: below 1e-9 at similarity 0.75, far less above; sets of up to
``K`` shingles are whole, and the bound is exact). So two of them must meet in one of their
``size - LEAST + 1`` rarest retained values, and only these are listed; values that one class holds
alone list nothing. This leaves frequent passages unlisted unless they make up most of a document, without
missing a link.

Lists of up to ``SMALL`` classes give all their pairs. Longer ones are mostly large groups of near
copies, whose links are wanted for the components only. For their classes the shingles that no other such class has are
counted; they bound how similar a class can be to any other, so that strongly changed copies drop out. Each list's
pairs with one hub, the class with the fewest own shingles, are verified; lists that then lie in one component are
done, and the members of the others are compared in blocks as far as the bound allows a link, without making rows of
pairs. So each candidate pair is verified, already connected or known to be too far apart.

A pair is filtered by set sizes, then by the union-sketch estimate, then verified exactly on both
full sets, which come from the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelquarry.llm.common import groups, map_text, store
from labelquarry.llm.graph import components

WORDS = 5  # of a shingle
PERCENT = 75  # least similarity
K = 64  # hashes in a sketch
LEAST = 24  # of them shared, at the threshold
SMALL = 16  # classes in a list that gives all its pairs
BLOCK = 256  # classes of a family of open lists that are compared with as many others at once


_PAIR = ("a", "b", "n_a", "n_b", "m_a", "m_b")


class Shingler:
    """Sets of 64-bit shingle hashes of texts (bytes), sorted."""

    def __init__(self, words: int = WORDS, known: int = 300_000):
        self.words, self.known = words, known
        self.hashes: dict[bytes, int] = {}
        self.factors = (np.random.default_rng(11).integers(1, 2**63, words, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def set_of(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # bytes: lowers A-Z only, splits at ASCII blanks only
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
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
        n = len(word) - self.words + 1
        grams = np.zeros(n, np.uint64)
        for j in range(self.words):
            grams += word[j : j + n] * self.factors[j]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(32)
        return np.unique(grams)


def sketched(docs: DataFrame, text: str, keep: list[str], words: int = WORDS, k: int = K) -> DataFrame:
    """Adds ``n_shingles``, the class ``_class`` (128-bit hash of the set; null for an empty set) and the sketch ``_sketch``."""
    shape = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("_class", T.BinaryType()), T.StructField("_sketch", T.ArrayType(T.LongType()))])

    def start():
        shingler = Shingler(words)

        def work(texts: list) -> list:
            sets = [shingler.set_of(t) for t in texts]
            return [
                [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                [s[:k].view(np.int64) for s in sets],
            ]

        return work

    return map_text(docs, text, shape, start, keep)


def _lists(classes: DataFrame, percent: int, k: int, least: int) -> DataFrame:
    """(value, class, n): each class in the lists of its rarest retained values."""
    postings = classes.select("_class", "n", F.explode("_sketch").alias("value"))
    met = store(postings.groupBy("value").agg(F.count("*").alias("held")).filter("held > 1"), "met-values")
    mine = postings.join(met, "value").groupBy("_class").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("held", "value"))).alias("values"))
    size = F.least(F.col("n"), F.lit(k))
    shared = F.least(F.ceil(F.col("n") * percent / 100), F.lit(least))
    listed = F.greatest(size - shared + 1 - (size - F.size("values")), F.lit(0)).cast("int")
    return mine.select("_class", "n", F.explode(F.slice("values", F.lit(1), listed)).alias("v")).select("v.value", "_class", "n")


def _may_link(percent: int):
    """Whether sets of ``n`` shingles, of which others have ``m``, can reach the threshold: they share at most the smaller ``m``."""
    shared = F.least("m_a", "m_b")
    return shared * 100 >= (F.col("n_a") + F.col("n_b") - shared) * percent


def _shared_shingles(members: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(class, n, m) of the classes in ``members``: shingles, and how many of them another of these classes has."""
    chosen = store(members.select("_class", "n").distinct(), "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for i in range(batch.num_rows):
                found = shingler.set_of(batch.column(1)[i].as_py())
                owner = pa.array([batch.column(0)[i].as_py()], pa.binary()).take(pa.array(np.zeros(len(found), np.int32)))
                yield pa.RecordBatch.from_arrays([owner, pa.array(found.view(np.int64))], names=["_class", "s"])

    rows = texts.join(chosen, "_class", "left_semi").select("_class", F.col("_text").cast("binary")).mapInArrow(run, "_class binary, s long")
    own = rows.groupBy("s").agg(F.count("*").alias("k"), F.min("_class").alias("_class")).filter("k = 1").groupBy("_class").agg(F.count("*").alias("own"))
    return chosen.join(own, "_class", "left").select("_class", (F.col("n") - F.coalesce("own", F.lit(0))).alias("m"))


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, words: int, k: int, least: int) -> DataFrame:
    """Of distinct pairs (a, b) of classes those that reach the threshold."""
    of_a = classes.select(F.col("_class").alias("a"), F.col("_sketch").alias("s_a"))
    of_b = classes.select(F.col("_class").alias("b"), F.col("_sketch").alias("s_b"))
    union = F.slice(F.array_sort(F.array_union(F.transform("s_a", _unsigned), F.transform("s_b", _unsigned))), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(union, F.transform("s_a", _unsigned)), F.transform("s_b", _unsigned)))
    close = pairs.join(of_a, "a").join(of_b, "b").filter(both * 100 >= F.least(F.lit(100 * least), F.size(union) * 100 * least / k)).select("a", "b")
    close = store(close, "estimated")
    of_a = texts.select(F.col("_class").alias("a"), F.col("_text").cast("binary").alias("t_a"))
    of_b = texts.select(F.col("_class").alias("b"), F.col("_text").cast("binary").alias("t_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, set_a = Shingler(words), None, None
        for batch in batches:
            hits = []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                if a != last:
                    last, set_a = a, shingler.set_of(batch.column(2)[i].as_py())
                set_b = shingler.set_of(batch.column(3)[i].as_py())
                shared = len(np.intersect1d(set_a, set_b, assume_unique=True))
                if shared * 100 >= (len(set_a) + len(set_b) - shared) * percent:
                    hits.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(hits, pa.int64())) for c in batch.columns[:2]], names=["a", "b"])

    # Neither pairs nor texts have a bound, so neither is broadcast.
    full = close.hint("merge").join(of_b, "b").hint("merge").join(of_a, "a").select("a", "b", "t_a", "t_b")
    return full.mapInArrow(run, "a binary, b binary")


def _unsigned(x):
    """Orders signed hashes as the unsigned ones they stand for."""
    return x.bitwiseXOR(F.lit(-(2**63)))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, words: int = WORDS, k: int = K, least: int = LEAST, small: int = SMALL) -> DataFrame:
    """One row per row of ``docs``: the id (as ``doc_id``), ``n_shingles``, ``component_id``, ``kept`` and the class ``_class``.

    A text's set holds its distinct shingles of ``words`` words (lower-cased A-Z, split at ASCII
    blanks); a shorter text is one shingle; a null or blank one has none and links with nothing. Texts are
    linked if 100 * intersection >= ``percent`` * union. ``component_id`` is the smallest id among all rows
    whose texts are connected, ``kept`` says whether it is the row's own. Rows of one id with
    different texts are judged by their texts; repeated rows stay together. A null id is the smallest only if there is no
    other (``component_id`` null, kept).
    """
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    key = [F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(1), "text").alias("_k2")]
    rows = store(sketched(source.select("*", *key), "text", ["doc_id", "_k1", "_k2"], words, k), "sketches")
    classes = store(rows.filter("_class is not null").groupBy("_class").agg(
        F.first("n_shingles").alias("n"), F.first("_sketch").alias("_sketch"), F.min("doc_id").alias("low"), F.min(F.struct("_k1", "_k2")).alias("rep")), "classes")
    lists = store(_lists(classes.select("_class", "n", "_sketch"), percent, k, least), "lists")
    sizes = lists.groupBy("value").agg(F.count("*").alias("size")).filter("size > 1")
    lists = store(lists.join(sizes, "value"), "lists")

    listed = lists.select("_class").distinct()
    known = store(classes.join(listed, "_class", "left_semi"), "listed")
    wanted = store(known.select("rep._k1", "rep._k2", "_class"), "wanted")
    # What is wanted grows with the data, so it is never broadcast.
    texts = store(source.select("text", *key).join(wanted.hint("merge"), ["_k1", "_k2"]).groupBy("_class").agg(F.first("text").alias("_text")), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        chosen = pairs.filter(_may_link(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return store(_verified(chosen, known, texts, percent, words, k, least), "links")

    few = lists.filter(F.col("size") <= small)
    left = few.select("value", F.col("_class").alias("a"), F.col("n").alias("n_a"), F.col("n").alias("m_a"))
    right = few.select("value", F.col("_class").alias("b"), F.col("n").alias("n_b"), F.col("n").alias("m_b"))
    pairs = left.join(right, "value").filter("a < b").select(*_PAIR)
    many = lists.filter(F.col("size") > small)
    many = many.join(_shared_shingles(many, texts, words), "_class").filter(F.col("m") * 100 >= F.col("n") * percent).select("value", "_class", "n", "m")
    many = store(many, "long-lists")
    hub = many.groupBy("value").agg(F.min(F.struct((1 - F.col("m") / F.col("n")).alias("x"), "_class", "n", "m")).alias("h"))
    links = verified(pairs.unionByName(_with_hub(many, hub)))
    found = components(links)
    open_ = _open_lists(many, found)
    if not open_.isEmpty():
        links = links.unionByName(store(_in_blocks(open_, texts, percent, words), "more-links"))
        found = components(links)

    labelled = classes.select("_class", "low").join(found.withColumnRenamed("node", "_class"), "_class", "left").select("_class", "low", F.coalesce("component", "_class").alias("label"))
    labelled = store(labelled, "labelled")
    lowest = store(labelled.groupBy("label").agg(F.min("low").alias("component_id")), "lowest")
    answer = store(labelled.join(lowest, "label").select("_class", "component_id"), "answer")
    out = rows.select("doc_id", "n_shingles", "_class").join(answer, "_class", "left")
    component = F.when(F.col("_class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "_class")


def _with_hub(lists: DataFrame, hub: DataFrame) -> DataFrame:
    """Each member of a list with the list's hub."""
    joined = lists.join(hub, "value").filter("_class != h._class")
    return joined.select(F.col("_class").alias("a"), F.col("h._class").alias("b"), F.col("n").alias("n_a"), F.col("h.n").alias("n_b"), F.col("m").alias("m_a"), F.col("h.m").alias("m_b"))


def _open_lists(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Members, with their component, of the lists that more than one component shares."""
    labelled = store(lists.join(found.withColumnRenamed("node", "_class"), "_class", "left").select("value", "_class", "n", "m", F.coalesce("component", "_class").alias("label")), "labels")
    split = store(labelled.groupBy("value").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("value"), "open")
    return store(labelled.join(split, "value", "left_semi"), "open-lists")


def _in_blocks(lists: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Links between different components in families of lists that share members: members are compared block against block, exactly
    and on full sets, and of the links in a pair of blocks only those that connect something are given."""
    lowest = lists.groupBy("value").agg(F.min("_class").alias("b"))
    family = components(lists.join(lowest, "value").select(F.col("_class").alias("a"), "b")).withColumnRenamed("node", "_class").withColumnRenamed("component", "family")
    members = store(lists.select("_class", "n", "m", "label").distinct().join(family, "_class"), "families")
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("_class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "_class", "n", "m", "label")
    rows = rows.join(texts, "_class").select("family", "i", "j", "own", "_class", "n", "m", "label", F.col("_text").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for (_, i, j), table in groups(batches, 3):
            own, n, m = (table.column(c).to_numpy() for c in (3, 5, 6))
            labels = np.unique(np.array(table.column(7).to_pylist(), object), return_inverse=True)[1]
            least = np.minimum(m[:, None], m[None])
            allowed = (labels[:, None] != labels[None]) & (least * 100 >= (n[:, None] + n[None] - least) * percent)
            if i != j:
                allowed &= own[:, None] != own[None]
            busy = np.flatnonzero(allowed.any(axis=1))
            if not len(busy):
                continue
            sets = [shingler.set_of(table.column(8)[int(x)].as_py()) for x in busy]
            shared = _intersections(sets)
            size = n[busy]
            linked = allowed[np.ix_(busy, busy)] & (shared * 100 >= (size[:, None] + size[None] - shared) * percent)
            parent = labels[busy].copy()
            a_list, b_list = [], []
            for x, y in zip(*np.nonzero(np.triu(linked)), strict=True):
                if parent[x] != parent[y]:
                    parent[parent == parent[y]] = parent[x]
                    a_list.append(int(busy[x]))
                    b_list.append(int(busy[y]))
            names = table.column(4).combine_chunks()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(k, pa.int64())) for k in (a_list, b_list)], names=["a", "b"])

    return rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(run, "a binary, b binary")


def _intersections(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections, some thousand shared values at a time."""
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = count > 1
    number = np.cumsum(often) - 1
    keep = often[place]
    owner, place = owner[keep], number[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(often.sum()), columns):
        begin, end = np.searchsorted(place, [at, at + columns])
        held = np.zeros((len(sets), columns), np.float32)
        held[owner[begin:end], place[begin:end] - at] = 1
        total += (held @ held.T).astype(np.int64)
    return total


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, of which :func:`near_duplicates` says ``kept``."""
    gone = near_duplicates(docs, text, doc_id, **options).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("_class").alias("_c")).distinct()
    gone = store(gone, "gone")
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    names = numbered.columns
    t, d = (f"c{docs.columns.index(x)}" for x in (text, doc_id))
    marked = sketched(numbered.withColumn("_again", F.col(t)), "_again", names, options.get("words", WORDS), 0).drop("_sketch")
    stays = marked.join(gone, F.col(d).eqNullSafe(F.col("_id")) & (F.col("_class") == F.col("_c")), "left_anti")
    return stays.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
