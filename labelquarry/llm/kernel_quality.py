"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each document is described by a few statistics of its bytes, words and lines. Random Fourier features
approximate a Gaussian kernel over them. Ridge scores come from normal equations that tasks
sum over their rows and a tree of sums brings together; only sums of fixed size reach the
driver. The scores are calibrated by isotonic regression over out-of-fold scores: each of the two training folds is
scored with the weights of the other.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelquarry.llm.common import map_text, store
from labelquarry.llm.labelled import held_out, training_labels

FEATURES = 256  # random Fourier features
GAMMA = 0.05  # of the kernel exp(-gamma |x - y|^2) over standardised statistics
RIDGE = 1e-3  # times the number of rows
BINS = 2000  # of scores, for calibration
FAN_IN = 64  # partial sums added up by one task

#: Byte classes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 blank, 5 line end, 6 sentence mark, 7 other ASCII mark, 8 outside ASCII.
_CLASS = np.zeros(256, np.int64)
for _codes, _class in ((range(33, 127), 7), (b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\r", 4), (b"\n", 5), (b".,;:?'\"()-", 6), (range(128, 256), 8)):
    _CLASS[list(_codes)] = _class
STATISTICS = 22


def statistics(text: bytes | None) -> list[float]:
    """Statistics of one whole text; an empty or null one gives zeros and a mark."""
    text = text or b""
    words = text.split()
    if not words:
        return [1.0] + [0.0] * (STATISTICS - 1)
    size, n = len(text), len(words)
    byte = np.frombuffer(text, np.uint8)
    each = np.bincount(byte, minlength=256)
    kind = np.bincount(_CLASS, weights=each, minlength=9) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    count = Counter(words)
    top = count.most_common(3)
    lines = [x for x in text.split(b"\n") if x.strip()]
    marks = each[33:127] * (_CLASS[33:127] == 7)
    ended = sum(c for w, c in count.items() if w[-1] < 128 and _CLASS[w[-1]] == 7)
    alone = sum(c for w, c in count.items() if len(w) == 1 and _CLASS[w[0]] == 7)
    upper = sum(c for w, c in count.items() if w.isupper())
    share = each[each > 0] / size
    return [
        0.0, math.log(size), math.log(n), *kind[1:9].tolist(), lengths.mean(), math.log(lengths.max()), lengths.std(),
        len(count) / n ** 0.8, top[0][1] / n, sum(c for _, c in top) / n, len(set(lines)) / len(lines), marks.max() / size, ended / n, alone / n + upper / n,
        float(-(share * np.log(share)).sum()),
    ]


class Features:
    """Standardised, clipped statistics to random Fourier features with a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, size: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.turn = rng.normal(scale=math.sqrt(2 * gamma), size=(len(mean), size))
        self.phase = rng.uniform(0, 2 * math.pi, size)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.deviation, -6, 6)
        z = np.cos(x @ self.turn + self.phase) * math.sqrt(2 / len(self.phase))
        return np.hstack([z, np.ones((len(z), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _equations(rows: DataFrame, features: Features) -> dict[int, np.ndarray]:
    """By fold: the matrix that sums the outer products of (features, label)."""
    width = len(features.phase) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                folds = batch.column(2).to_numpy(zero_copy_only=False)
                z = np.hstack([features(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)[:, None]])
                for fold in np.unique(folds).tolist():
                    part = z[folds == fold]
                    sums[fold] = sums.get(fold, 0) + part.T @ part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["fold", "sums"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s) for s in part["sums"]], axis=0)
        return pd.DataFrame({"fold": [part["fold"].iloc[0]], "sums": [total.tobytes()]})

    partial = rows.select("statistics", "label", "fold").mapInArrow(run, "fold int, sums binary")
    groups = rows.rdd.getNumPartitions()
    while groups > FAN_IN:
        groups = -(-groups // FAN_IN)
        partial = partial.groupBy("fold", F.pmod(F.spark_partition_id(), F.lit(groups)).alias("_group")).applyInPandas(add, "fold int, sums binary")
    out: dict[int, np.ndarray] = {}
    for row in partial.toLocalIterator():
        out[row.fold] = out.get(row.fold, 0) + np.frombuffer(row.sums).reshape(width, width)
    return out


def _weights(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Of the normal equations; the constant is not penalised."""
    a, b, n = sums[:-1, :-1].copy(), sums[:-1, -1], max(sums[-2, -2], 1.0)
    a[np.diag_indices(len(a) - 1)] += ridge * n
    a[-1, -1] += 1e-9
    return np.linalg.solve(a, b)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over points in order of ``x``; the centre and value of each block."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, weight, strict=True):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", features: int = FEATURES, gamma: float = GAMMA, ridge: float = RIDGE, seed: int = 1) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per row of ``docs``.

    Learns from all labelled rows whose crc32(id as text) mod 3 is not 1; only the text is an input of a score. Whole texts
    are read; null and empty ones share one score. A null id is never labelled nor held out; repeated rows get equal
    scores. Without any labelled row all scores are 0.5.
    """
    shape = T.StructType([T.StructField("statistics", T.ArrayType(T.DoubleType()))])
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = store(map_text(source, "text", shape, lambda: lambda texts: [[statistics(t) for t in texts]], ["doc_id"]), "statistics")
    known = rows.join(training_labels(labels, label), "doc_id").select("statistics", F.col("label").cast("double").alias("label"), "fold")
    known = store(known, "known")
    result = rows.select("doc_id", held_out("doc_id").alias("held_out"), "statistics")
    each = [F.col("statistics")[i] for i in range(STATISTICS)]
    moments = known.agg(F.count("*"), *[F.avg(x) for x in each], *[F.stddev_pop(x) for x in each]).first()
    if not moments[0]:
        return result.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    mean, deviation = np.array(moments[1 : 1 + STATISTICS]), np.array(moments[1 + STATISTICS :])
    make = Features(mean, deviation, features, gamma, seed)
    sums = _equations(known, make)
    whole = _weights(sum(sums.values()), ridge)
    other = {f: _weights(sums[2 - f], ridge) if 2 - f in sums else whole for f in sums}  # folds are 0 and 2

    @F.pandas_udf("double")
    def out_of_fold(statistics: pd.Series, fold: pd.Series) -> pd.Series:
        z = make(np.stack(statistics.to_numpy()))
        scores = np.zeros(len(z))
        for f, w in other.items():
            mine = (fold == f).to_numpy()
            scores[mine] = z[mine] @ w
        return pd.Series(scores)

    # Ridge scores lie about 0 to 1; the outermost bins take the rest.
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((out_of_fold("statistics", "fold") + 0.5) / 2 * BINS))).cast("int")
    bins = known.select(bin_.alias("bin"), "label").groupBy("bin").agg(F.count("*").alias("n"), F.avg("label").alias("y")).orderBy("bin").collect()
    centre = np.array([(b.bin + 0.5) / BINS * 2 - 0.5 for b in bins])
    x, y = isotonic(centre, np.array([b.y for b in bins]), np.array([float(b.n) for b in bins]))

    @F.pandas_udf("double")
    def score(statistics: pd.Series) -> pd.Series:
        raw = make(np.stack(statistics.to_numpy())) @ whole
        # The small slope keeps the order of scores inside a calibrated block.
        return pd.Series(np.clip(0.999 * np.interp(raw, x, y) + 0.001 * np.clip(raw / 2 + 0.25, 0, 1), 0, 1))

    scored = result.withColumn("score", score("statistics"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
