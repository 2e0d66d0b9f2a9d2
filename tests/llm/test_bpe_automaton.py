"""Against the tokenizers library, on given texts, random strings and edge cases."""

import gc
import hashlib
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer as Library

from labelquarry.llm.bpe_automaton import Automaton, Encoder, Pieces, Tokenizer, decode_ids, encode_texts
from labelquarry.llm.common import map_text

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abcdefghijklmnopqrstuvwxyz   aaaeee''''sstt.,!?<|>-_0123456789ÄÖÜäßéñΣσςİıǅﬁ́̈\x1c\x1f\x85 　\t\n日本語한국가각²½٣🙂👨‍👩​­\x00"


@pytest.fixture(scope="module")
def library():
    found = Library.from_file(PATH)
    found.no_padding()
    found.no_truncation()
    return found


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Tokenizer(PATH).spec, cached=5000)


def agree(library, encoder, texts):
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        packed = encoder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == want, text
        assert encoder.decode(packed) == library.decode(want, skip_special_tokens=False)


def test_random_strings(library, encoder, rng):
    agree(library, encoder, ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(3000)])
    agree(library, encoder, ["".join(rng.choice("ae") for _ in range(rng.randint(1, 40))) for _ in range(500)])
    agree(library, encoder, ["".join(rng.choice("!.-") for _ in range(rng.randint(1, 40))) for _ in range(500)])


def test_documents(library, encoder):
    agree(library, encoder, [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()])


def test_added_tokens_and_long_words(library, encoder):
    agree(library, encoder, ["<|startoftext|> hello<|endoftext|>world<|ENDOFTEXT|>", "a" * 5000, "ab" * 3000, " ", ""])


def test_small_automaton_equals_merging_in_order():
    merges = [("a", "a"), ("aa", "a"), ("b", "a"), ("aa", "aa"), ("a", "b</w>")]
    tokens = ["a", "b", "a</w>", "b</w>"] + [x + y for x, y in merges]
    automaton = Automaton(tokens, merges)

    def merged(word):
        pieces = [*word[:-1], word[-1] + "</w>"]
        for pair in merges:
            at = 0
            while at + 1 < len(pieces):
                if (pieces[at], pieces[at + 1]) == pair:
                    pieces[at : at + 2] = ["".join(pair)]
                at += 1
        return pieces

    for size in range(1, 9):
        for bits in range(2**size):
            word = "".join("ab"[bits >> i & 1] for i in range(size))
            assert [tokens[i] for i in automaton.encode(word)] == merged(word)


def test_table(spark, library):
    rows = [(1, None, "x"), (1, "", "x"), (None, "Hello  World", "x"), (2, "Hello  World", "x"), (3, "word " * 30000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = encode_texts(df, PATH, ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(out) == 5
    for row in out:
        want = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == want and row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(row.decoded.encode()).hexdigest()
        assert row.decoded == library.decode(want, skip_special_tokens=False)
    assert encode_texts(df.limit(0), PATH).count() == 0
    back = decode_ids(encode_texts(df, PATH, ("ids", "decoded")).withColumnRenamed("decoded", "want"), PATH).collect()
    assert all(r.decoded == r.want for r in back)


def test_states_of_frequent_labels_take_little_memory():
    """One label that 1200 merges take an arc from: a table per state would hold 720,000 missing arcs."""
    others = [chr(0x4E00 + i) for i in range(1200)]
    merges = [("a", x) for x in others]
    tracemalloc.start()
    try:
        automaton = Automaton(["a", "a</w>", *others, *[x + "</w>" for x in others], *[a + x for a, x in merges]], merges)
        for i in range(0, len(others), 3):
            x, y = others[i], others[-1 - i]
            words = [automaton.decode(automaton.encode(w)) for w in (f"a{x}a{y}a", f"{x}{y}aa{x}")]
            assert words == [f"a{x} a{y} a</w>", f"{x} {y} a a {x}</w>"]
        assert tracemalloc.get_traced_memory()[1] < 15e6
    finally:
        tracemalloc.stop()


def test_cache_holds_no_more_than_its_limit():
    pieces = Pieces(str.encode, 10)
    for i in range(40):
        assert pieces[str(i)] == str(i).encode() == pieces[str(i)]
        assert len(pieces.keys() | pieces.old.keys()) <= 10


def test_workers_let_go_of_the_encoder(spark):
    """Workers are reused: what a query leaves in them would take memory from all that follow."""
    docs = spark.createDataFrame([("hello world",)], "text string").coalesce(1)
    assert encode_texts(docs, PATH).first().n_tokens == 2

    def start():
        held = sum(type(x).__name__ == "Encoder" for x in gc.get_objects())
        return lambda texts: [[held] * len(texts)]

    shape = T.StructType([T.StructField("held", T.LongType())])
    assert {r.held for r in map_text(spark.range(64).selectExpr("string(id) AS text").repartition(16), "text", shape, start).collect()} == {0}
