"""Fill-in-middle examples cut from seekable compressed frames.

A text is stored as independent zstandard frames of at most ``FRAME`` bytes. Each frame carries how many
units and characters come before it, so a cut after ``k`` units needs one frame to be unpacked, however long
the text is. A rearranged text is a stream of ordered frames: digests are taken from that stream, and the
text is rebuilt from such a stream alone, one frame in memory at a time.

A unit is a run of ASCII letters or any other single character, so the units of a text join to the text.
Frames may end inside a run: a frame counts the units that *start* in it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelquarry.llm.common import free_name, store

FRAME = 1 << 15
LEVEL = 3
# The markers of the three parts, and the percentages of plain and of suffix-first texts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

FRAMES_TYPE = "struct<payload: array<binary>, units: array<bigint>, chars: array<bigint>, open: array<boolean>, n: bigint, n_chars: bigint, marked: boolean>"
_FRAMES_ARROW = pa.struct([
    ("payload", pa.list_(pa.binary())), ("units", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64())), ("open", pa.list_(pa.bool_())),
    ("n", pa.int64()), ("n_chars", pa.int64()), ("marked", pa.bool_()),
])

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FIRST = np.ones(256, bool)  # bytes that begin a character in UTF-8
_FIRST[0x80:0xC0] = False


def unit_starts(data: bytes, open_before: bool) -> np.ndarray:
    """Which bytes begin a unit; ``open_before``: the byte before ``data`` is a letter."""
    codes = np.frombuffer(data, np.uint8)
    letter = _LETTER[codes]
    after_letter = np.empty(len(codes), bool)
    after_letter[:1] = open_before
    after_letter[1:] = letter[:-1]
    return _FIRST[codes] & ~(letter & after_letter)


def characters(data: bytes) -> int:
    return int(np.count_nonzero(_FIRST[np.frombuffer(data, np.uint8)]))


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` in pieces of at most ``size`` bytes that end between characters."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and not _FIRST[data[end]]:
            end -= 1
        yield data[at:end]
        at = end


def to_frames(data: bytes, packer: zstandard.ZstdCompressor, size: int = FRAME) -> dict:
    """The frames of a text in UTF-8, with the units and characters before each."""
    out: dict = {"payload": [], "units": [], "chars": [], "open": [], "marked": any(m in data for m in (PREFIX, SUFFIX, MIDDLE))}
    units = chars = 0
    open_before = False
    for piece in pieces(data, size):
        out["payload"].append(packer.compress(piece))
        out["units"].append(units)
        out["chars"].append(chars)
        out["open"].append(open_before)
        units += int(np.count_nonzero(unit_starts(piece, open_before)))
        chars += characters(piece)
        open_before = bool(_LETTER[piece[-1]])
    return out | {"n": units, "n_chars": chars}


class Reader:
    """Reads parts of a text from its frames. Unpacks one frame at a time and keeps none."""

    def __init__(self, frames: dict):
        self.frames, self.unpack = frames, zstandard.ZstdDecompressor().decompress

    def locate(self, k: int) -> tuple[int, int, int]:
        """(frame, byte in it, characters before) of the end of the first ``k`` units."""
        f = self.frames
        if k >= f["n"]:
            return len(f["payload"]), 0, f["n_chars"]
        at = bisect_right(f["units"], k) - 1  # of equal counts the last: the frame where the unit starts
        data = self.unpack(f["payload"][at])
        byte = int(np.flatnonzero(unit_starts(data, f["open"][at]))[k - f["units"][at]])
        return at, byte, f["chars"][at] + characters(data[:byte])

    def between(self, start: tuple[int, int, int], end: tuple[int, int, int]) -> Iterator[bytes]:
        for i in range(start[0], min(end[0] + 1, len(self.frames["payload"]))):
            data = self.unpack(self.frames["payload"][i])
            piece = data[start[1] if i == start[0] else 0 : end[1] if i == end[0] else len(data)]
            if piece:
                yield piece


def draws(doc_id: object, seed: int) -> list[int]:
    """Four numbers of 32 bits that the id and the seed decide; a null id counts as an empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def plan(frames: dict, doc_id: object, seed: int) -> tuple[str, int, int]:
    """Form, and the units before the two cuts."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    n = frames["n"]
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    if n == 0 or frames["marked"] or h3 % 100 >= PLAIN_FROM:
        return "plain", *cuts
    return "spm" if h4 % 100 < SPM_BELOW else "psm", *cuts


def rearranged(reader: Reader, form: str, low: tuple, high: tuple) -> Iterator[bytes]:
    """The output text as a stream."""
    begin, end = (0, 0, 0), (len(reader.frames["payload"]), 0, reader.frames["n_chars"])
    if form == "plain":
        return reader.between(begin, end)
    prefix, middle, suffix = reader.between(begin, low), reader.between(low, high), reader.between(high, end)
    if form == "psm":
        return chain([PREFIX], prefix, [SUFFIX], suffix, [MIDDLE], middle)
    return chain([SUFFIX], suffix, [PREFIX], prefix, [MIDDLE], middle)


def segments(stream: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(marker, piece) for a rearranged text; markers may lie across the pieces of the stream."""
    name, rest = b"", b""
    for piece in stream:
        rest += piece
        while True:
            found = [(rest.find(m), m) for m in (PREFIX, SUFFIX, MIDDLE) if m in rest]
            if not found:
                break
            at, marker = min(found)
            if at:
                yield name, rest[:at]
            name, rest = marker, rest[at + len(marker) :]
        if len(rest) > 2:
            yield name, rest[:-2]
            rest = rest[-2:]
    if rest:
        yield name, rest


def restored(stream: Iterable[bytes], form: str, packer: zstandard.ZstdCompressor) -> Iterator[bytes]:
    """The text from its output and form alone. The suffix, which comes too early, waits in compressed frames."""
    if form == "plain":
        yield from stream
        return
    waiting = []
    for marker, piece in segments(stream):
        if marker == SUFFIX:
            waiting.append(packer.compress(piece))
        else:
            yield piece
    unpack = zstandard.ZstdDecompressor().decompress
    for frame in waiting:
        yield unpack(frame)


def digest(stream: Iterable[bytes]) -> str:
    out = hashlib.sha256()
    for piece in stream:
        out.update(piece)
    return out.hexdigest()


def frame_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = FRAME, column: str = "frames") -> DataFrame:
    """The table with ``text`` replaced by column ``frames`` (:data:`FRAMES_TYPE`), written to the shared folder.

    A null text has the frames of an empty one (none); other columns and all rows stay, a column that already has the
    result's name is replaced.
    """
    stay = [c for c in docs.columns if c.lower() not in (text.lower(), column.lower())]
    source = docs.select(F.col(f"`{text}`").cast("binary"), *[F.col(f"`{c}`") for c in stay])
    fields = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in stay], f"`{column}` {FRAMES_TYPE}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                frames = [to_frames(x.as_py() or b"", packer, size) for x in piece.column(0)]
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], pa.array(frames, _FRAMES_ARROW)], names=[*stay, column])

    return store(source.mapInArrow(run, fields), "frames")


def fill_in_middle(
    framed: DataFrame, doc_id: str = "doc_id", seed: int = 1, frames: str = "frames", outputs: tuple[str, ...] = ("output_sha256", "restored_sha256"),
) -> DataFrame:
    """Cuts framed texts and rearranges them.

    Returns the table without its frames, with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars`` and
    ``middle_chars`` (null if plain), and the columns named in ``outputs``: ``output`` (the rearranged text itself),
    ``output_sha256`` and ``restored_sha256`` (of the text rebuilt from output and form). Every row counts for itself:
    repeated ids give equal cuts, a null id counts as an empty text, an empty text is plain with the digest of nothing.
    Other columns with the names of results are replaced.
    """
    kinds = {"output": ("string", pa.string()), "output_sha256": ("string", pa.string()), "restored_sha256": ("string", pa.string())}
    made = {"n": ("bigint", pa.int64()), "form": ("string", pa.string()), "prefix_chars": ("bigint", pa.int64()), "middle_chars": ("bigint", pa.int64())}
    made |= {o: kinds[o] for o in outputs}
    held = free_name(framed, "_id")
    stay = [c for c in framed.columns if c.lower() != frames.lower() and c.lower() not in made]
    source = framed.select(F.col(f"`{frames}`"), F.col(f"`{doc_id}`").alias(held), *[F.col(f"`{c}`") for c in stay])
    fields = ", ".join([*[f"`{c}` {framed.schema[c].dataType.simpleString()}" for c in stay], *[f"`{c}` {k}" for c, (k, _) in made.items()]])

    def one(frames_of: dict, key: object, packer: zstandard.ZstdCompressor) -> list:
        form, a, b = plan(frames_of, key, seed)
        reader = Reader(frames_of)
        low, high = reader.locate(a), reader.locate(b)
        stream = lambda: rearranged(reader, form, low, high)
        results = {
            "output": lambda: b"".join(stream()).decode(), "output_sha256": lambda: digest(stream()),
            "restored_sha256": lambda: digest(restored(stream(), form, packer)),
        }
        sizes = [None, None] if form == "plain" else [low[2], high[2] - low[2]]
        return [frames_of["n"], form, *sizes, *[results[o]() for o in outputs]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                rows = [one(f.as_py(), k.as_py(), packer) for f, k in zip(piece.column(0), piece.column(1), strict=True)]
                columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), made.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns[2:], *columns], names=[*stay, *made])

    return source.mapInArrow(run, fields)
