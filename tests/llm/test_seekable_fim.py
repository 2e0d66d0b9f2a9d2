"""Against cutting lists of units, and exact round trips over frames of a few bytes."""

import hashlib
import re

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from labelquarry.llm import seekable_fim as fim


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out, sizes = "plain", text, (None, None)
    elif h4 % 100 < 20:
        form, out, sizes = "spm", f"<S>{s}<P>{p}<M>{m}", (len(p), len(m))
    else:
        form, out, sizes = "psm", f"<P>{p}<S>{s}<M>{m}", (len(p), len(m))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(units), form, *sizes, out, sha(out), sha(text))


@pytest.mark.parametrize("size", [fim.FRAME, 7])
def test_equals_lists_of_units(spark, rng, size):
    letters = "abcXYZ  \n.é߀😀1"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    texts += [None, "", "a", "word" * 50_000, "😀" * 3000, "x<M>y z", "<P", "< S > <M", "ab " * 30_000, texts[3], texts[3], "\x00a\r\n", "éa"]
    rows = [(i if i % 19 else None, t, "old") for i, t in enumerate(texts)] + [(7, texts[7], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)
    out = fim.fill_in_middle(fim.frame_texts(df, size=size), outputs=("output", "output_sha256", "restored_sha256"))
    got = sorted([tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256").collect()], key=repr)
    assert got == sorted([(k, *brute(k, t)) for k, t, _ in rows], key=repr)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}


@settings(max_examples=60, deadline=None)
@given(st.text("aB< >PSM.é😀", max_size=60), st.integers(4, 9))
def test_frames_and_rebuilding(text, size):
    data, packer = text.encode(), zstandard.ZstdCompressor()
    frames = fim.to_frames(data, packer, size)
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert frames["n"] == len(units) and frames["n_chars"] == len(text)
    reader = fim.Reader(frames)
    places = [reader.locate(k) for k in range(len(units) + 1)]
    assert [p[2] for p in places] == [len("".join(units[:k])) for k in range(len(units) + 1)]
    if not frames["marked"] and units:
        for form in ("psm", "spm"):
            low, high = places[len(units) // 3], places[len(units) // 2]
            assert b"".join(fim.restored(fim.rearranged(reader, form, low, high), form, packer)) == data


def test_a_cut_unpacks_one_frame(monkeypatch):
    frames = fim.to_frames(b"some words here " * 40_000, zstandard.ZstdCompressor())
    reader, opened = fim.Reader(frames), []
    unpack = reader.unpack
    reader.unpack = lambda payload: opened.append(1) or unpack(payload)
    reader.locate(frames["n"] // 2)
    assert len(frames["payload"]) > 15 and len(opened) == 1


def test_empty_table_and_clashing_names(spark):
    assert fim.fill_in_middle(fim.frame_texts(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    df = spark.createDataFrame([(1, "a b", 5, "f", [1])], "doc_id long, text string, N int, frames string, _id array<int>")
    out = fim.fill_in_middle(fim.frame_texts(df))
    assert sorted(out.columns) == sorted(["doc_id", "_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])
    assert out.first()["n"] == 3
