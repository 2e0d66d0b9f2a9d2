"""Toxicity classifier: a small convolutional network over hashed word embeddings.

A word's embedding is the sum of the hashed embeddings of the word and of its first letters (three to seven bytes), so that
inflected forms share what is learned; filters of several widths slide over the whole text, each filter's largest
response is kept, and a logistic layer scores them. Training is plain numpy (Adagrad) over a bounded
sample of labelled documents: at most ``SAMPLE`` rows, those with the smallest hash of the id.
Embeddings start from how much likelier a toxic training document holds the word or the letters, so that max pooling looks at the
right words from the first step. A fifth of the sample is set aside; on it the score's scale is fitted (the
best threshold becomes 0.7). The threshold of each language is fitted on every labelled row that the network did not
learn from, however many, in Spark. Scoring runs in tasks, where each filter tap is a table of responses by word.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelquarry.llm.common import free_name, map_text, release_in_worker, store
from labelquarry.llm.labelled import held_out, training_labels
from labelquarry.operators.ranks import BUCKET, place, ranks, running_totals, values_at_ranks

SAMPLE = 8_000  # labelled rows to learn from, at most
HASHES = 1 << 18  # word hashes
PREFIXES = (3, 4, 5, 6, 7)
PARTS = 1 + len(PREFIXES)
KNOWN = 150_000  # words a task keeps responses of
FEW = 4  # training documents that must hold a word, else it has the empty embedding
SIZE = 8  # of an embedding
FILTERS = 8  # of each width
WIDTHS = (1, 2, 3)
EPOCHS = 8
BATCH = 64
THRESHOLD = 0.7
LEAST_THRESHOLD, MOST_THRESHOLD = 0.5, 0.9  # of a language
MARKS = 25  # log2 of the bits that tell which texts may be labelled: 4 MB
READ_AT_ONCE = 64  # texts
SCORES_PER_BUCKET = 1024  # aimed at, when the scores of a language are put in order

#: Bytes of words: letters (capitals are lowered), digits, everything outside ASCII.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Lexicon(dict):
    """Number of each word met, from 0, and the hashes of its parts; 0 hashes stand for no part."""

    def __init__(self):
        super().__init__()
        self.parts = array("i")  # PARTS hashes a word

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.parts) // PARTS
        parts = [word] * bool(word) + [word[:n] + b"-" for n in PREFIXES if n < len(word)]
        hashes = [1 + xxhash.xxh3_64_intdigest(p) % (HASHES - 1) for p in parts]
        self.parts.extend(hashes + [0] * (PARTS - len(hashes)))
        return number

    def since(self, number: int = 0) -> np.ndarray:
        """Hashes of the parts of each word from ``number`` on."""
        return np.array(self.parts[number * PARTS :], np.int32).reshape(-1, PARTS)

    def text(self, text: bytes | None) -> np.ndarray:
        return np.array([self[w] for w in text.translate(_WORD_BYTES).split()] if text else [], np.int32)


class Network:
    """``slot``: embedding row by hash of a word part; row 0 is the empty embedding."""

    def __init__(self, slot: np.ndarray, start: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.slot = slot
        self.parts = rng.normal(scale=0.02, size=(len(start), SIZE)).astype(np.float32)
        self.parts[:, 0] = start
        self.parts[0] = 0
        self.filters = [rng.normal(scale=0.2, size=(w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, 0] = 1.0 / len(f)
        self.shift = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
        self.constant = np.zeros(1, np.float32)
        self.scale, self.offset = 1.0, 0.0

    def taps(self, slots: np.ndarray) -> np.ndarray:
        """Responses of every filter tap to words given by the slots of their parts."""
        words = self.parts[slots].sum(axis=1)
        return np.hstack([words @ f[j] for f in self.filters for j in range(len(f))])

    def responses(self, taps: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
        """Of each width at each word of ``numbers``; ``taps``: responses by word number."""
        out, n, at = [], len(numbers) - max(WIDTHS) + 1, 0
        for k, width in enumerate(WIDTHS):
            total = np.tile(self.shift[k], (len(numbers), 1))
            for j in range(width):
                total[:n] += taps[:, at : at + FILTERS][numbers[j : n + j]]
                at += FILTERS
            out.append(total)
        return out

    @staticmethod
    def flat(texts: list[np.ndarray], empty: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, each followed by empty words, and where each begins."""
        gap = np.full(max(WIDTHS), empty, np.int32)
        starts = np.cumsum([0] + [len(t) + len(gap) for t in texts])[:-1]
        return np.concatenate([p for t in texts for p in (t, gap)]), starts

    def logits(self, texts: list[np.ndarray], taps: np.ndarray, empty: int) -> np.ndarray:
        numbers, starts = self.flat(texts, empty)
        best = [np.maximum.reduceat(r, starts, axis=0) for r in self.responses(taps, numbers)]
        return np.maximum(np.hstack(best), 0) @ self.out + self.constant[0]

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits * self.scale + self.offset, -30, 30)))

    def train(self, texts: list[np.ndarray], y: np.ndarray, slots: np.ndarray, empty: int, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-4, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        values = [self.parts, *self.filters, *self.shift, self.out, self.constant]
        memory = [np.full_like(v, 0.1) for v in values]
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                self._step([texts[i] for i in pick], y[pick], slots, empty, values, memory, rate, decay)

    def _step(self, texts, y, slots, empty, values, memory, rate, decay) -> None:
        numbers, starts = self.flat(texts, empty)
        used, numbers = np.unique(numbers, return_inverse=True)
        words = self.parts[slots[used]].sum(axis=1)
        responses = self.responses(self.taps(slots[used]), numbers)
        ends = np.append(starts[1:], len(numbers))
        where = [np.array([r[a:b].argmax(axis=0) + a for a, b in zip(starts, ends, strict=True)]) for r in responses]
        best = np.hstack([np.take_along_axis(r, w, axis=0) for r, w in zip(responses, where, strict=True)])
        hidden = np.maximum(best, 0)
        error = (1 / (1 + np.exp(-np.clip(hidden @ self.out + self.constant[0], -30, 30))) - y).astype(np.float32) / len(y)
        grad = [np.zeros_like(v) for v in values[1:]]
        touched, pulls = [], []
        back = error[:, None] * self.out * (best > 0)
        for k, width in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            grad[len(WIDTHS) + k] += g.sum(axis=0)
            for j in range(width):
                ids = numbers[np.minimum(where[k] + j, len(numbers) - 1)]  # documents x filters
                grad[k][j] += np.einsum("bfs,bf->sf", words[ids], g)
                parts = slots[used[ids.ravel()]]
                touched.append(parts.ravel())
                pulls.append(np.repeat((g[:, :, None] * self.filters[k][j].T[None]).reshape(-1, SIZE), parts.shape[1], axis=0))
        grad[2 * len(WIDTHS)] += hidden.T @ error
        grad[-1] += error.sum()
        for v, m, g in zip(values[1:], memory[1:], grad, strict=True):
            g = g + decay * v
            m += g * g
            v -= rate * g / np.sqrt(m)
        ids, place = np.unique(np.concatenate(touched), return_inverse=True)
        pull = np.zeros((len(ids), SIZE), np.float32)
        np.add.at(pull, place.ravel(), np.concatenate(pulls))
        memory[0][ids] += pull * pull
        self.parts[ids] -= rate * pull / np.sqrt(memory[0][ids])
        self.parts[0] = 0


class Reader:
    """Scores texts of one task; keeps the responses of words met before."""

    def __init__(self, network: Network):
        self.network = network
        self._forget()

    def _forget(self) -> None:
        self.lexicon = Lexicon()
        self.empty = self.lexicon[b""]
        self.taps = np.zeros((0, FILTERS * sum(WIDTHS)), np.float32)
        self.known = 0

    def scores(self, raws: list) -> np.ndarray:
        if self.known > KNOWN:
            self._forget()
        texts = [self.lexicon.text(r) for r in raws]
        met = len(self.lexicon)
        if met > self.known:
            if met > len(self.taps):
                grown = np.zeros((2 * met, self.taps.shape[1]), np.float32)
                grown[: self.known] = self.taps[: self.known]
                self.taps = grown
            self.taps[self.known : met] = self.network.taps(self.network.slot[self.lexicon.since(self.known)])
            self.known = met
        return self.network.scores(self.network.logits(texts, self.taps, self.empty).astype(np.float64))


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap that gives the best F1; of equally good ones the middle one."""
    order = np.argsort(-logits)
    s, hit = logits[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + hit[-1])
    f1[:-1][s[:-1] == s[1:]] = 0
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    i = top[len(top) // 2]
    return float(s[i] if i + 1 == len(s) else (s[i] + s[i + 1]) / 2)


def best_thresholds(counts: DataFrame) -> DataFrame:
    """(lang, threshold) as by :func:`best_threshold`, from rows (lang, score, n, hits); the scores of a language are spread
    over tasks. Languages without rows of both labels have none."""
    # What is broadcast has one row per language, like the result.
    totals = counts.groupBy("lang").agg(F.sum("n").alias("_rows"), F.sum("hits").alias("_hits")).where("_hits > 0 and _hits < _rows")
    fitted = place(counts.join(F.broadcast(totals.drop("_rows")), "lang"), ["lang"], "score", SCORES_PER_BUCKET)
    upto = running_totals(fitted, ["lang"], "score", {"_n": "n", "_hit": "hits"}, falling=True)
    rated = store(upto.select("lang", "score", BUCKET, (2 * F.col("_hit") / (F.col("_n") + F.col("_hits"))).alias("f1")), "rated")
    best = rated.groupBy("lang").agg(F.max("f1").alias("_best"))
    top = rated.join(F.broadcast(best), "lang").where("f1 >= _best - 1e-12").select("lang", "score", BUCKET, F.lit(1).alias("n"))
    middle = store(values_at_ranks(top, ["lang"], "score", lambda n: ranks(middle=F.floor((n - 1) / 2))).select("lang", F.col("score").alias("_middle")), "middle")
    below = rated.join(F.broadcast(middle), "lang").where("score <= _middle").groupBy("lang", "_middle").agg(F.max(F.when(F.col("score") < F.col("_middle"), F.col("score"))).alias("_below"))
    return below.select("lang", ((F.col("_middle") + F.coalesce("_below", "_middle")) / 2).alias("threshold"))


class Model:
    """A trained network with its scale and the thresholds of the score by language."""

    def __init__(self, network: Network | None, thresholds: dict[str, float]):
        self.network, self.thresholds = network, thresholds


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", label: str = "toxic", sample: int = SAMPLE, seed: int = 3) -> Model:
    """Learns from at most ``sample`` labelled rows whose crc32(id as text) mod 3 is not 1; thresholds by language are fitted on all
    such rows. Without both labels the model is empty."""
    known = training_labels(labels, label)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "label")
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    # The sample is bounded: ``sample`` rows of two numbers are broadcast, their texts come back.
    mine = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    rows = sorted(mine.withColumn("text", F.col("text").cast("binary")).collect(), key=lambda r: r.doc_id)
    if len({r.label for r in rows}) < 2:
        return Model(None, {})
    network, ids = _fit(rows, seed)
    del rows
    learned = docs.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([mine.schema["doc_id"]]))
    return Model(network, language_thresholds(texts, known, learned, network))


def _fit(rows: list, seed: int) -> tuple[Network, list]:
    """A network trained on four fifths of the rows, its scale fitted on the last fifth, and the ids it learned from."""
    y = np.array([r.label for r in rows], np.float32)
    lexicon = Lexicon()
    empty = lexicon[b""]
    words = [lexicon.text(bytes(r.text) if r.text else None) for r in rows]
    ids = [r.doc_id for r in rows]
    parts = lexicon.since()
    aside = np.array([xxhash.xxh3_64_intdigest(str(i), seed=5) % 5 == 0 for i in ids])
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(ids), bool)
    fit = np.flatnonzero(~aside)
    held = [np.zeros(HASHES), np.zeros(HASHES)]
    for i in fit:
        held[int(y[i])][np.unique(parts[words[i]])] += 1
    n = [max((y[fit] == k).sum(), 1) for k in (0, 1)]
    often = np.flatnonzero(held[0] + held[1] >= FEW)
    often = often[often > 0]
    slot = np.zeros(HASHES, np.int32)
    slot[often] = np.arange(1, len(often) + 1)
    expected = (held[0] + held[1])[often] * n[1] / (n[0] + n[1])
    start_values = np.append(0, np.clip(np.log((held[1][often] + 2) / (expected + 2)), -2, 2))
    network = Network(slot, start_values, seed)
    slots = slot[parts]
    network.train([words[i] for i in fit], y[fit], slots, empty, seed=seed)
    check = np.flatnonzero(aside) if aside.any() else fit
    taps = network.taps(slots)
    logits = np.concatenate([network.logits([words[i] for i in check[k : k + 256]], taps, empty) for k in range(0, len(check), 256)])
    best = best_threshold(logits, y[check])
    spread = np.abs(logits - best).mean() or 1.0
    network.scale = 3.0 / spread
    network.offset = float(np.log(THRESHOLD / (1 - THRESHOLD)) - network.scale * best)
    return network, [ids[i] for i in fit]


def language_thresholds(texts: DataFrame, known: DataFrame, learned: DataFrame, network: Network) -> dict[str, float]:
    """The best threshold of every language in ``texts`` (doc_id, lang, text) with labelled rows (``known``: doc_id, label) of
    both labels, at least 0.5 and at most 0.9.

    It is fitted on all labelled rows but those in ``learned`` (doc_id, at most a sample); a language that lacks a label
    among them is fitted on all its labelled rows. Only scores are shuffled: which texts may be labelled is told by bits
    of a bounded number, chosen by the id's hash, and the labels meet the scores.
    """
    spark = texts.sparkSession
    known = known.select(F.col("doc_id").cast(texts.schema["doc_id"].dataType).alias("doc_id"), "label")
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MARKS))
    buckets = known.select((mark / 32768).cast("int").alias("bucket"), (mark % 32768).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    marks = np.zeros((1 << MARKS) // 8, np.uint8)
    for row in buckets.collect():
        marks[row.bucket * 4096 : (row.bucket + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    sent = spark.sparkContext.broadcast((network, marks))

    def run(batches):
        release_in_worker()
        network, marks = sent.value
        reader = Reader(network)
        for batch in batches:
            at = batch.column("_mark").to_numpy()
            batch = batch.filter(pa.array(marks[at >> 3] >> (at & 7) & 1 == 1))
            for start in range(0, batch.num_rows, READ_AT_ONCE):
                piece = batch.slice(start, READ_AT_ONCE)
                scores = reader.scores(piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("lang"), pa.array(scores, pa.float64())], names=["doc_id", "lang", "score"])

    shape = T.StructType([texts.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    sources = texts.where("doc_id is not null and lang is not null").select("doc_id", "lang", F.col("text").cast("binary").alias("text"), mark.alias("_mark"))
    one = sources.mapInArrow(run, shape).groupBy("doc_id").agg(F.min(F.struct("lang", "score")).alias("_one")).select("doc_id", "_one.*")
    flags = F.broadcast(learned.select("doc_id", F.lit(True).alias("_learned")))
    rows = one.join(known, "doc_id").join(flags, "doc_id", "left").withColumn("_learned", F.col("_learned").isNotNull())
    counts = store(rows.groupBy("lang", "_learned", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits")), "thresholds")
    fresh = lambda c: F.sum(F.when(~F.col("_learned"), F.col(c)).otherwise(0))
    lacking = counts.groupBy("lang").agg(fresh("n").alias("_n"), fresh("hits").alias("_h")).select("lang", ((F.col("_h") == 0) | (F.col("_h") == F.col("_n"))).alias("_lacks"))
    used = counts.join(F.broadcast(lacking), "lang").where(F.col("_lacks") | ~F.col("_learned")).groupBy("lang", "score").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    used = store(used, "used")
    return {r.lang: min(max(r.threshold, LEAST_THRESHOLD), MOST_THRESHOLD) for r in best_thresholds(used).orderBy("lang").collect()}


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Adds ``held_out``, ``score``, ``predicted`` (1 if score >= 0.7), ``threshold`` (of the row's language; 0.7 for unknown ones
    and null) and ``rejected`` (score >= threshold) to the rows of ``docs``.

    Only the whole text is an input of the score; null and empty texts share one. With an empty
    model scores are 0. Rows are neither moved nor dropped. Input columns with the names of results are replaced.
    """
    shape = T.StructType([T.StructField("score", T.DoubleType())])
    made = ["held_out", "score", "predicted", "threshold", "rejected"]
    stay = [c for c in docs.columns if c.lower() not in made]
    held = free_name(docs, "_held")
    sent = docs.sparkSession.sparkContext.broadcast(model.network)

    def start():
        reader = Reader(sent.value) if sent.value else None
        return lambda raws: [reader.scores(raws).tolist() if reader else [0.0] * len(raws)]

    source = docs.select(F.col(f"`{text}`").alias(held), *[F.col(f"`{c}`") for c in stay])
    scored = map_text(source, held, shape, start, stay, rows_at_once=READ_AT_ONCE)
    threshold = F.lit(THRESHOLD)
    for one, value in model.thresholds.items():
        threshold = F.when(F.col(f"`{lang}`") == one, value).otherwise(threshold)
    scored = scored.withColumn("held_out", held_out(doc_id)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    return scored.withColumn("threshold", threshold).withColumn("rejected", F.col("score") >= F.col("threshold"))
