"""Small helpers that the operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelquarry.session import scratch_path


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` below the shared folder and reads it back, which cuts the lineage: what is read survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_text(
    df: DataFrame, text: str, outputs: T.StructType, start: Callable[[], Callable[[list], list]], keep: Iterable[str] | None = None,
    rows_at_once: int = 256, kept: Hashable = None,
) -> DataFrame:
    """Adds columns made by Python from column ``text``, a few hundred rows at a time.

    ``start()`` runs once per task and gives a function from a list of texts to a list of column
    lists (in the order of ``outputs``). ``keep`` names the input columns that stay (all, if not
    given); result names win over input columns of the same name. Arrow batches are cut into pieces of ``rows_at_once``
    rows, so that only one piece is unpacked at any time. ``kept`` names what ``start()`` takes from :func:`kept_in_worker`;
    everything else that the worker keeps is released first.
    """
    made = {f.name.lower() for f in outputs}
    stay = [c for c in (df.columns if keep is None else keep) if c.lower() not in made]
    source = df.select(F.col(f"`{text}`").cast("binary").alias("_text_"), *[F.col(f"`{c}`") for c in stay])
    schema = T.StructType([df.schema[c] for c in stay] + list(outputs))
    types = [pa_type(f.dataType) for f in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_in_worker(kept)
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                piece = batch.slice(at, rows_at_once)
                columns = work(piece.column(0).to_pylist())
                arrays = [piece.column(i) for i in range(1, piece.num_columns)]
                arrays += [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


_kept: dict = {}


def kept_in_worker(name: Hashable, make: Callable[[], object]):
    """What ``make`` gives, made once per Python worker for the tasks of one query; it replaces what was kept before."""
    if name not in _kept:
        release_in_worker(name)
        _kept[name] = make()
    return _kept[name]


def release_in_worker(but: Hashable = None) -> None:
    """Lets go of what this Python worker keeps under other names: workers outlive queries and share an executor's memory."""
    gone = [n for n in _kept if n != but]
    for name in gone:
        del _kept[name]
    if gone:
        gc.collect()  # what was kept may hold itself


def pa_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, pa_type(f.dataType)) for f in kind])
    return {
        "long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(),
        "boolean": pa.bool_(),
    }[kind.typeName()]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal first ``keys`` columns, from batches that come sorted by them."""
    open_key, parts = None, []
    for batch in batches:
        rows = list(zip(*[batch.column(i).to_pylist() for i in range(keys)], strict=True))
        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end] == rows[at]:
                end += 1
            if rows[at] != open_key:
                if parts:
                    yield open_key, pa.Table.from_batches(parts)
                open_key, parts = rows[at], []
            parts.append(batch.slice(at, end - at))
            at = end
    if parts:
        yield open_key, pa.Table.from_batches(parts)


def matrix(column: pa.ChunkedArray | pa.Array):
    """Lists of equal length as rows of a numpy matrix."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return one.flatten().to_numpy(zero_copy_only=False).reshape(len(one), -1)
