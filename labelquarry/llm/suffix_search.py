"""Benchmark decontamination by suffix arrays over the training texts.

A shard is a run of texts of about a million words inside a Spark task. Its words become numbers (those
that no item has become 0), and the suffixes that start a run of item words long enough for some
window are sorted by their first words: the shard's suffix array. Every suffix of every item is then
looked up by binary search, all at once. The places found are joined along their diagonals to the longest
verbatim matches. Nothing is shuffled: items go to the shards, in blocks of bounded size, one
pass over the texts per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelquarry.llm.common import free_name

WINDOW = 10
BLOCK_BYTES = 4 << 20  # of item text in one broadcast block
SHARD_WORDS = 1_000_000

#: Bytes of words: digits, lower-case letters (capitals are lowered) and everything outside ASCII.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class Items:
    """One block of items, ready for look-ups. ``rows``: pairs of item id (text) and text (bytes)."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int):
        self.window = window
        by_words: dict[tuple[bytes, ...], set[str]] = {}
        for name, text in rows:
            if words := tuple(words_of(text)):
                by_words.setdefault(words, set()).add(name)
        self.names = [sorted(v) for v in by_words.values()]  # equal texts are looked up once
        vocabulary = sorted({w for words in by_words for w in words})
        self.numbers = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.packed = 4 if len(vocabulary) < 2**16 - 1 else 2  # words in one key
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, words in enumerate(by_words):
            ids = [self.numbers[w] for w in words]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1):
                found.setdefault(tuple(ids[at : at + size]), []).append((item, at))
        windows = list(found)
        self.sizes = np.array([len(w) for w in windows], np.int64)
        self.shortest = int(self.sizes.min()) if windows else 0
        places = [p for w in windows for p in found[w]]
        self.first = np.cumsum([0] + [len(found[w]) for w in windows])
        self.place_item = np.array([p[0] for p in places], np.int64)
        self.place_at = np.array([p[1] for p in places], np.int64)
        n_keys = -(-window // self.packed)
        low, high = (np.full((len(windows), n_keys * self.packed), x, np.uint64) for x in (0, 2 ** (64 // self.packed) - 1))
        for i, w in enumerate(windows):
            low[i, : len(w)] = high[i, : len(w)] = w
        self.low, self.high = self._keys(low), self._keys(high)

    def _keys(self, words: np.ndarray) -> list[np.ndarray]:
        bits = 64 // self.packed
        return [
            sum((words[:, k + j] << np.uint64(bits * (self.packed - 1 - j)) for j in range(self.packed)), np.zeros(len(words), np.uint64))
            for k in range(0, words.shape[1], self.packed)
        ]

    def search(self, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window number and place of every occurrence of every window in ``sequence`` (numbers, 0 for other words)."""
        n, none = len(sequence), np.zeros(0, np.int64)
        if not len(self.sizes) or n < self.shortest:
            return none, none
        zero = np.where(sequence == 0, np.arange(n), n)
        room = np.minimum.accumulate(zero[::-1])[::-1] - np.arange(n)  # item words from here on
        starts = np.flatnonzero(room >= self.shortest)
        if not len(starts):
            return none, none
        bits, padded = 64 // self.packed, np.append(sequence, np.zeros(len(self.low) * self.packed, sequence.dtype)).astype(np.uint64)
        keys = []
        for k in range(len(self.low)):
            key = np.zeros(len(starts), np.uint64)
            for j in range(self.packed):
                key |= padded[starts + (k * self.packed + j)] << np.uint64(bits * (self.packed - 1 - j))
            keys.append(key)
        order = np.lexsort(keys[::-1])  # the suffix array
        keys, array = [k[order] for k in keys], starts[order]
        begin, end = self._bound(keys, self.low, False), self._bound(keys, self.high, True)
        count = end - begin
        which = np.repeat(np.arange(len(count)), count)
        rank = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        return which, array[rank]

    @staticmethod
    def _bound(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of all wanted suffixes: the first place not below (or, ``after``, above) each."""
        low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
        while (open_ := low < high).any():
            middle = np.minimum((low + high) // 2, len(keys[0]) - 1)
            less, same = np.zeros(len(low), bool), np.ones(len(low), bool)
            for key, want in zip(keys, wanted, strict=True):
                less |= same & (key[middle] < want)
                same &= key[middle] == want
            up = open_ & (less | same if after else less)
            low, high = np.where(up, middle + 1, low), np.where(open_ & ~up, middle, high)
        return low

    def matches(self, which: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Item, word of the item, place and length of the longest verbatim matches that the window occurrences form."""
        count = self.first[which + 1] - self.first[which]
        spread = np.repeat(np.arange(len(which)), count)
        source = np.arange(len(spread)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[which], count)
        item, at, pos, size = self.place_item[source], self.place_at[source], place[spread], self.sizes[which[spread]]
        order = np.lexsort((pos, pos - at, item))
        item, at, pos, size = item[order], at[order], pos[order], size[order]
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (pos[1:] - at[1:] != pos[:-1] - at[:-1]) | (pos[1:] != pos[:-1] + 1)
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(item)) - 1 if len(item) else begin
        return item[begin], at[begin], pos[begin], pos[last] - pos[begin] + size[last]


_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("_hit_from_", T.ArrayType(T.IntegerType())),
    T.StructField("_hit_to_", T.ArrayType(T.IntegerType())),
    T.StructField("_hit_items_", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(T.StructType([
        T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()),
        T.StructField("doc_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()),
    ]))),
])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds to each row what it shares with ``items``: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``
    and ``matches`` (longest verbatim matches: item, its word, the document's word, number of words).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
    window. Items without id count under the empty id; items without words match nothing. Rows are neither joined nor
    moved, so null or repeated ids, repeated rows and empty texts need no care. Null has no words. Input columns
    with the names of results are replaced.

    Items are a query set. Their size is measured first and they are broadcast in blocks of at most
    ``block_bytes`` of text (a longer item is a block of its own), each of which passes over all texts.
    """
    made = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches", *_RESULT.names}
    held = free_name(docs, "_held")
    stay = [c for c in docs.columns if c.lower() not in made]
    frame = docs.select(F.col(f"`{text}`").cast("binary").alias(held), *[F.col(f"`{c}`") for c in stay])
    for number, block in enumerate(_blocks(items, item_id, item_text, block_bytes)):
        frame = _pass(frame, held, docs.sparkSession.sparkContext.broadcast(block), window, number > 0)
    names = F.array_sort(F.array_distinct("_hit_items_"))
    frame = frame.withColumn("_hit_items_", names).withColumn("n_hit", F.expr("aggregate(zip_with(_hit_from_, _hit_to_, (a, b) -> b - a), 0L, (s, x) -> s + x)"))
    return frame.select(
        *[F.col(f"`{c}`") for c in stay], "n_words", "n_hit", F.size("_hit_items_").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_hit_items_"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "matches",
    )


def _blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    rows = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{item_text}`").cast("binary").alias("t")).filter("t is not null")
    total = rows.agg(F.sum(F.octet_length("t") + F.octet_length("i") + 64)).first()[0] or 0
    parts = max(1, -(-total * 2 // block_bytes))
    for part in range(parts):
        block, size = [], 0
        for row in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).toLocalIterator():
            if block and size + len(row.t) > block_bytes:
                yield block
                block, size = [], 0
            block.append((row.i, bytes(row.t)))
            size += len(row.t)
        if block or part == 0:
            yield block


def _pass(frame: DataFrame, held: str, block, window: int, earlier: bool) -> DataFrame:
    """Looks up one block in all texts; adds to what earlier passes found."""
    stay = [c for c in frame.columns if c != held and not (earlier and c in _RESULT.names)]
    read = frame.select(held, *[F.col(f"`{c}`") for c in stay], *(_RESULT.names if earlier else []))
    schema = T.StructType([frame.schema[held], *[frame.schema[c] for c in stay], *_RESULT])
    match = pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(match)]

    def look_up(index: Items, texts: list[list[bytes]]) -> list[tuple]:
        get = index.numbers.get
        starts = np.cumsum([0] + [len(w) + 1 for w in texts])
        sequence = np.zeros(starts[-1], np.int32)
        for at, words in zip(starts, texts, strict=False):
            sequence[at : at + len(words)] = [get(w, 0) for w in words]
        which, place = index.search(sequence)
        item, item_word, pos, size = index.matches(which, place)
        doc = np.searchsorted(starts, pos, "right") - 1
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for d, i, a, p, n in zip(doc.tolist(), item.tolist(), item_word.tolist(), (pos - starts[doc]).tolist(), size.tolist(), strict=True):
            found.setdefault(d, []).append((i, a, p, n))
        out = []
        for d, words in enumerate(texts):
            rows = sorted(found.get(d, ()), key=lambda r: (r[2], r[0], r[1]))
            spans = _merged([(p, p + n) for _, _, p, n in rows])
            names = sorted({x for i, _, _, _ in rows for x in index.names[i]})
            longest = [{"item_id": x, "item_word": a, "doc_word": p, "n_words": n} for i, a, p, n in rows for x in index.names[i]]
            out.append((len(words), [a for a, _ in spans], [b for _, b in spans], names, longest))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(block.value, window)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, begin = [], 0, at
                column = batch.column(0)
                while at < batch.num_rows and size < SHARD_WORDS:
                    texts.append(words_of(column[at].as_py()))
                    size += len(texts[-1])
                    at += 1
                piece = batch.slice(begin, at - begin)
                made = look_up(index, texts)
                if earlier:
                    before = [piece.column(1 + len(stay) + k).to_pylist() for k in range(len(kinds))]
                    made = [_joined(old, new) for old, new in zip(zip(*before, strict=True), made, strict=True)]
                arrays = [piece.column(k) for k in range(1 + len(stay))] + [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return read.mapInArrow(run, schema)


def _joined(old: tuple, new: tuple) -> tuple:
    spans = _merged([*zip(old[1], old[2], strict=True), *zip(new[1], new[2], strict=True)])
    return new[0], [a for a, _ in spans], [b for _, b in spans], sorted({*old[3], *new[3]}), old[4] + new[4]


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window of an item."""
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    found = find_items(numbered, items, text=f"c{docs.columns.index(text)}", **options).filter(~F.col("contaminated"))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
