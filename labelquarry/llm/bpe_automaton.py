"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts with one state in which every base symbol loops. Merges are
then worked in, best first, one gadget each: for a merge ``u v -> t`` the state after ``u`` is
cloned without its ``v`` arc, every ``u`` arc is led to the clone, and each state that has a ``u``
arc gains a ``t`` arc to the state after ``v``. All arcs of one label lead to one state, so the
result is deterministic with at most one new state per merge, and it accepts exactly the token
sequences that applying the merges in order can give.

A clone differs from its source by one missing arc, so states are stored as (source, missing label,
merge number), and arcs gained later are decided from the left parts of a token: ``t`` is there if
its left part was still there when the merge that makes ``t`` was worked in. Sources form trees, and no label
goes missing twice on a path, so a label's missing arcs lie in disjoint ranges of the trees' preorder and one binary
search tells whether a state lacks it. Looked-up arcs are kept in a table.

A pre-split word has exactly one accepted path, and so has each of its prefixes. It is found left to
right by table look-ups: characters lead to the labels that match, labels to the next state.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from labelquarry.llm.common import kept_in_worker, map_text

END = "</w>"
STOP = "\n"  # stands for a word's end; no base symbol


class Automaton:
    """``tokens``: labels by id. ``merges``: pairs of labels, best first."""

    def __init__(self, tokens: list[str], merges: list[tuple[str, str]]):
        self.labels = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        n = len(tokens)
        self.made = array("q", [-1]) * n  # number of the merge that makes a token; -1: base symbol
        self.left = array("q", [-1]) * n
        self.usable = bytearray(len(t.removesuffix(END)) == 1 for t in tokens)  # whether the start state has an arc for it
        self.state = array("q", range(n))  # of each label's arcs
        self.source = array("q", [-1]) * n
        self.missing = array("q", [-1]) * n
        self.since = array("q", [-1]) * n
        made_by_merge = {a + b for a, b in merges}
        for t in made_by_merge:
            self.usable[self.ids[t]] = 0
        self.arcs: dict[int, bool] = {}
        for number, (a, b) in enumerate(merges):
            self._gadget(number, self.ids[a], self.ids[b], self.ids[a + b])
        self._order()
        self._spell()

    def _order(self) -> None:
        """Numbers the states in preorder and sorts the missing arcs by label and range of states."""
        n = len(self.source)
        below = array("q", [1]) * n  # states of each subtree; a source comes before its clones
        for at in range(n - 1, -1, -1):
            if self.source[at] >= 0:
                below[self.source[at]] += below[at]
        self.place, free, roots = array("q", [0]) * n, array("q", [0]) * n, 0
        for at in range(n):
            source = self.source[at]
            if source < 0:
                self.place[at], roots = roots, roots + below[at]
            else:
                self.place[at] = free[source]
                free[source] += below[at]
            free[at] = self.place[at] + 1
        clones = sorted((self.missing[at] << 32 | self.place[at], at) for at in range(n) if self.source[at] >= 0)
        self.gone_from = array("q", [key for key, _ in clones])
        self.gone_to = array("q", [key + below[at] for key, at in clones])
        self.gone_since = array("q", [self.since[at] for _, at in clones])

    def _spell(self) -> None:
        """The table of character transitions that finds the labels matching at a position, as nested rows; key 0 has the label."""
        self.root: dict = {}
        for label, text in enumerate(self.labels):
            if self.usable[label]:
                node = self.root
                for c in text.removesuffix(END) + STOP * text.endswith(END):
                    node = node.setdefault(c, {})
                node[0] = label

    def _gadget(self, number: int, u: int, v: int, t: int) -> None:
        if self.made[t] >= 0:
            raise ValueError(f"token {self.labels[t]!r} is made by two merges")
        if not (self.usable[u] and self.usable[v] and self._present(v, self._missing(self.state[u]).get)):
            return  # u is never followed by v at this point, so the merge never applies
        after_v, before = self.state[v], self.state[u]
        clone = len(self.source)
        self.source.append(before)
        self.missing.append(v)
        self.since.append(number)
        self.state[u] = clone
        self.state[t] = after_v
        self.made[t], self.left[t], self.usable[t] = number, u, 1

    def _missing(self, state: int) -> dict[int, int]:
        """Missing labels of a state and since which merge."""
        found = {}
        while self.source[state] >= 0:
            found[self.missing[state]] = self.since[state]
            state = self.source[state]
        return found

    def _present(self, label: int, since: Callable[[int], int | None]) -> bool:
        """Whether a state has an arc ``label``; ``since`` tells by which merge it lost a label, if it did."""
        if since(label) is not None:
            return False
        while (part := self.left[label]) >= 0:
            gone = since(part)
            if gone is not None and gone <= self.made[label]:
                return False
            label = part
        return True

    def _has(self, last: int, label: int) -> bool:
        """Whether the state after ``last`` has an arc ``label``."""
        place = self.place[self.state[last]]

        def since(one: int) -> int | None:
            key = one << 32 | place
            i = bisect_right(self.gone_from, key) - 1
            return self.gone_since[i] if i >= 0 and key < self.gone_to[i] else None

        return self._present(label, since)

    def encode(self, word: str) -> list[int]:
        """Token ids of one non-empty pre-split word of base characters.

        Follows the longest matching arc first. The path to a position is unique, so one that led nowhere is never
        tried again and the steps are bounded by positions times arcs.
        """
        word += STOP
        n, arcs, has, root = len(word), self.arcs, self._has, self.root
        path, dead, back = [], {n - 1}, []
        at, last, choices = 0, -1, None
        while True:
            if choices is None:
                choices, node, end = [], root, at
                for c in word[at:]:
                    node = node.get(c)
                    if node is None:
                        break
                    end += 1
                    if 0 in node and end not in dead:
                        choices.append((end, node[0]))
            while choices:
                end, label = choices.pop()
                if end in dead:
                    continue
                if last >= 0:
                    key = last << 24 | label
                    fits = arcs.get(key)
                    if fits is None:
                        if len(arcs) > 1_000_000:
                            arcs.clear()
                        fits = arcs[key] = has(last, label)
                    if not fits:
                        continue
                path.append(label)
                if end == n:
                    return path
                back.append((at, last, choices))
                at, last, choices = end, label, None
                break
            else:
                dead.add(at)
                at, last, choices = back.pop()
                path.pop()

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, in order, with a blank between two."""
        return " ".join(map(self.labels.__getitem__, ids))


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else 256 and up in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Tokenizer:
    """Reads the model file of the ``tokenizers`` library: its added tokens, normaliser and splitter, as far as this vocabulary has them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        splitter = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError("only lower-casing BPE files with word ends are understood")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max([*model["vocab"].values(), *added.values()]) + 1)
        for t, i in (model["vocab"] | added).items():
            tokens[i] = t
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.spec = (tokens, merges, added, spec["normalizer"]["normalizers"][1]["pattern"]["Regex"], splitter["pattern"]["Regex"])


class Pieces(dict):
    """Packed ids by piece of text, ``limit`` at most in two generations. When one is full, a new one begins; pieces met again are taken over from the last one."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.old = {}  # goes before the copy comes
            self.old = dict(self)
            self.clear()
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        self[piece] = found
        return found


class Encoder:
    """Encodes texts. Pieces between blanks that were met before come from a cache of bounded size.

    Blanks are cut away by the splitter and no added token holds one, so that pieces between blanks can be normalised
    and split on their own.
    """

    def __init__(self, spec: tuple, cached: int = 250_000):
        tokens, merges, added, blanks, words = spec
        if blanks != r"\s+" or any(" " in t or "\n" in t for t in added):
            raise ValueError("blanks and added tokens are expected to exclude each other")
        self.automaton = Automaton(tokens, merges)
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(words)
        self.symbols = byte_symbols()
        self.pieces = Pieces(self._piece, cached)
        self.split_words = Pieces(self._word, cached * 3 // 4)

    def _piece(self, piece: str) -> bytes:
        parts = self.special.split(piece) if self.special else [piece]
        if len(parts) == 1 and piece.isascii() and piece.isalpha():
            return self.split_words[piece if piece.islower() else piece.lower()]  # both caches share the ids
        ids = array("I")
        for i, part in enumerate(parts):
            if i % 2:
                ids.append(self.added[part])
            elif part:
                plain = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                for word in [plain] if plain.isascii() and plain.isalpha() else self.words.findall(plain):
                    ids.frombytes(self.split_words[word])
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        symbols = self.symbols
        return array("I", self.automaton.encode(word if word.isascii() and word.isalnum() else "".join([symbols[b] for b in word.encode("utf-8")]))).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers in native (little-endian) order."""
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))

    def decode(self, packed: bytes) -> str:
        return self.automaton.decode(memoryview(packed).cast("I"))


OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode_texts(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "n_tokens"), text: str = "text") -> DataFrame:
    """Adds what ``outputs`` names to every row: ``ids``, ``n_tokens``, ``ids_sha256`` (of the ids as
    little-endian unsigned 32-bit integers), ``decoded`` and ``decoded_sha256``.

    Every whole text is encoded; null counts as empty (no ids, decoded text empty). Rows are never
    joined, dropped or reordered, so repeated rows and null ids need no care. Input columns with the
    name of an output are replaced. The vocabulary is read on the driver from ``path`` and
    broadcast: its size does not depend on the data. An automaton is built once per task.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Tokenizer(path).spec)
    schema = T.StructType([T.StructField(o, OUTPUTS[o]) for o in outputs])

    def start():
        encoder = worker_encoder(spec)
        decoding = bool({"decoded", "decoded_sha256"} & set(outputs))

        def work(texts: list) -> list:
            columns: dict[str, list] = {o: [] for o in outputs}
            for raw in texts:
                packed = encoder.encode(raw.decode("utf-8", "replace") if raw else "")
                decoded = encoder.decode(packed) if decoding else ""
                for name, column in columns.items():
                    if name == "ids":
                        column.append(array("I", packed).tolist())
                    elif name == "n_tokens":
                        column.append(len(packed) // 4)
                    elif name == "ids_sha256":
                        column.append(hashlib.sha256(packed).hexdigest())
                    elif name == "decoded":
                        column.append(decoded)
                    else:
                        column.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            return [columns[o] for o in outputs]

        return work

    return map_text(docs, text, schema, start, kept=_name(spec))


def worker_encoder(spec) -> Encoder:
    """One encoder per Python worker: tasks that follow in the same worker reuse it."""
    return kept_in_worker(_name(spec), lambda: Encoder(spec.value))


def _name(spec) -> tuple:
    return "encoder", getattr(spec, "_jbid", None) or id(spec)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text that ``ids`` stands for: the labels of its arcs, a blank between two; null ids give null."""
    from pyspark.sql import functions as F

    labels = df.sparkSession.sparkContext.broadcast(Tokenizer(path).spec[0])

    @F.pandas_udf(T.StringType())
    def labels_of(column):
        table = labels.value
        return column.map(lambda row: None if row is None else " ".join([table[i] for i in row]))

    return df.withColumn(out, labels_of(F.col(f"`{ids}`")))
