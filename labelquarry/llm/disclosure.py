"""Personal data and the terms that give it away, by information-theoretic sanitisation.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers. How strongly a term
reveals an entity is then estimated from the corpus: of all documents with the term, in how many does it stand
near the entity? With pointwise mutual information PMI(entity; term) = ln(p(entity, term) / (p(entity) p(term)))
and information content IC(entity) = -ln p(entity), the disclosure PMI / IC is 1 where a term is met only near the
entity and 0 where it is independent of it. Terms at or above a threshold are generalised to their first letters,
or removed if these disclose too much as well, wherever they stand.

All of it is DataFrame functions. Shuffled are (text digest, entity, term) rows of texts with an entity that is met
in several texts, term counts, and places of flagged words; never a text. A filter of fixed size (at most 4 MB, sent
with the plan) lets only words through that may be asked for, and equi-joins decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelquarry.llm.common import free_name, store

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

# The patterns that define the kinds, written so that Java neither recurses nor goes back in long runs.
# A start inside a run that has no match from its first character has none either, so starts are tried at the head of
# a run only (for e-mail addresses also where the last match ended).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "phone": "+"}  # without this character there is no match
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
WORD = r"[\p{L}\p{N}]++"

REACH = 200  # characters on each side of an entity in which a term is near it
THRESHOLD = 0.95
STEM = 2  # letters that stay of a generalised term
MIN_TEXTS = 2  # different texts in which a term must be near an entity to count as evidence
BLOCK = 4096  # characters of a text that are cut out of it at once
BUCKETS = (1 << 16, 1 << 22)  # least and most bits of a filter
BITS = 7  # of a byte

SPAN = "struct<start: bigint, rank: int, `end`: bigint, kind: string, value: string, near: string>"
PLACE = "struct<start: bigint, `end`: bigint, word: string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(lengths: Column) -> Column:
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit([]).cast("array<bigint>").alias("out"))
    return F.aggregate(lengths, state, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])


def prefix_sums(lengths: Column) -> Column:
    """The sum of all elements before each one. Works in blocks of about the square root of the length, since each step of
    a fold copies its array."""
    total = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda s, x: s + x)

    def in_blocks(all_: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_))).cast("int")
        cut = F.transform(F.sequence(F.lit(1), F.size(all_), size), lambda at: F.slice(all_, at, size))
        return let(cut, lambda blocks: F.flatten(F.zip_with(
            blocks, _sums(F.transform(blocks, total)), lambda block, before: F.transform(_sums(block), lambda v: v + before))))

    return let(lengths, lambda all_: F.when(F.size(all_) <= 64, _sums(all_)).otherwise(in_blocks(all_)))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the matches of a pattern, in code points, ends exclusive."""
    def placed(found: Column) -> Column:
        both = F.zip_with(F.split(text, pattern, -1), found, lambda gap, value: F.struct(F.char_length(gap).cast("long").alias("gap"), value.alias("value")))
        return let(F.slice(both, F.lit(1), F.size(found)), lambda pairs: F.zip_with(
            pairs, prefix_sums(F.transform(pairs, lambda p: p["gap"] + F.char_length(p["value"]))),
            lambda p, before: F.struct(
                (before + p["gap"]).alias("start"), (before + p["gap"] + F.char_length(p["value"])).alias("end"), p["value"].alias("value"))))

    none = F.lit([]).cast("array<struct<start: bigint, `end`: bigint, value: string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check sum of a text of digits is right."""
    def weighted(backwards: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            d = F.substring(backwards, i, F.lit(1)).cast("int")
            return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

        return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), add)

    return let(F.reverse(number), weighted) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match of the pattern is of its kind."""
    count = F.length(digits(value))
    if kind == "ip":
        return value.rlike(IP)
    if kind == "card":
        return F.when(count.between(14, 19), luhn(digits(value))).otherwise(F.lit(False))
    return count.between(10, 15) if kind == "phone" else F.lit(True)


def blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks_: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of a text in blocks, without a walk from its beginning."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.array_join(F.slice(blocks_, first + 1, (F.floor((end - 1) / BLOCK) - first + 1).cast("int")), "")
    return F.when(end > start, F.substring(some, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise(F.lit(""))


def base_spans(text: Column, reach: int = REACH) -> Column:
    """Array of :data:`SPAN` of the entities in a text, by start, then kind. ``near``: the whole words within ``reach`` characters."""
    none = F.lit([]).cast("array<struct<start: bigint, `end`: bigint, value: string>>")

    def of(kind: str) -> Column:
        all_ = matches(text, PATTERNS[kind])
        if kind in HINTS:
            all_ = F.when(F.contains(text, F.lit(HINTS[kind])), all_).otherwise(none)
        rank = KINDS.index(kind)
        return F.transform(F.filter(all_, lambda s: holds(kind, s["value"])), lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))

    def near(s: Column, parts: Column, length: Column) -> Column:
        left = cut(parts, F.greatest(s["start"] - reach, F.lit(0)), s["start"])
        right = cut(parts, s["end"], F.least(s["end"] + reach, length))
        left = F.when(s["start"] > reach, F.regexp_replace(left, f"^{WORD}", "")).otherwise(left)
        right = F.when(s["end"] + reach < length, F.regexp_replace(right, f"{WORD}$", "")).otherwise(right)
        return F.concat(left, F.lit(" "), right)

    def with_words(spans: Column) -> Column:
        def all_(parts: Column, length: Column) -> Column:
            return F.transform(F.sort_array(spans), lambda s: F.struct(
                *[s[f].alias(f) for f in ("start", "rank", "end", "kind", "value")], near(s, parts, length).alias("near")))

        return let(blocks(text), lambda parts: let(F.char_length(text).cast("long"), lambda length: all_(parts, length)))

    return let(F.concat(*[of(k) for k in KINDS]), lambda spans: F.when(F.size(spans) > 0, with_words(spans)).otherwise(F.lit([]).cast(f"array<{SPAN}>")))


def words(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lower))


def general(word: Column) -> Column:
    """A word by its first letters only; the mark at the end keeps it apart from words."""
    return F.concat(F.substring(word, 1, STEM), F.lit("*"))


def words_and_stems(text: Column) -> Column:
    return let(words(text), lambda w: F.concat(w, F.array_distinct(F.transform(w, general))))


def entity(span: Column) -> Column:
    """Kind and value in one form: addresses in lower case, numbers by their digits."""
    value = F.when(span["kind"].isin("card", "phone"), digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


class WordFilter:
    """Tells words that are not in a table of terms, for certain: three of a bounded number of bits, chosen by the word's
    hash, are set for each term.

    The bits are a literal of the plan, at most 0.6 MB whatever the number of terms: every text of a plan spells it out in
    full, and the driver holds many. A byte has seven of them, so that it is a character that Spark turns into a number. Up to 130,000 terms about one word in
    1,200 passes without being a term; with more terms more words pass.
    """

    def __init__(self, terms: DataFrame, term: str = "term"):
        least, most = BUCKETS
        self.size = least
        count = terms.count()
        while self.size < most and self.size < 32 * count:
            self.size *= 2
        taken = bytearray(self.size // BITS + 1)
        asked = terms.select(F.explode(F.array(*[self.bucket(F.col(term), i) for i in range(3)])).alias("b")).distinct()
        for row in asked.toLocalIterator():  # at most 4M numbers
            taken[row["b"] // BITS] |= 1 << row["b"] % BITS
        self.bytes = F.lit(bytes(taken))

    def bucket(self, word: Column, i: int) -> Column:
        return F.pmod(F.shiftrightunsigned(F.xxhash64(word), 21 * i), F.lit(self.size)).cast("int")

    def may_hold(self, word: Column) -> Column:
        def taken(bucket: Column) -> Column:
            byte = F.ascii(F.substring(self.bytes, F.floor(bucket / BITS).cast("int") + 1, F.lit(1)).cast("string"))
            return F.getbit(byte, bucket % BITS) == 1

        first, second, third = [taken(self.bucket(word, i)) for i in range(3)]
        return first & second & third


def disclosures(spans: DataFrame, docs: DataFrame, text: str, threshold: float = THRESHOLD, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(term, disclosure, stem_disclosure, replacement) of the words that disclose an entity.

    ``spans`` has a row (digest, spans) for each row of ``docs``. Probabilities are shares of all rows of ``docs``, copies
    included; at least ``min_texts`` different texts must show a term near an entity, since one text is no evidence. The
    replacement is the word's stem, or empty where the stem discloses as much.
    """
    total = spans.count()
    texts = spans.filter(F.size("spans") > 0).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.first("spans").alias("spans"))
    mentions = texts.select("digest", "copies", F.explode("spans").alias("s")).select("digest", "copies", entity(F.col("s")).alias("entity"), F.col("s.near").alias("near"))
    mentions = store(mentions, "mentions")
    entities = (
        mentions.groupBy("entity", "digest", "copies").agg(F.lit(1).alias("one")).groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count(F.lit(1)).alias("texts"))
        .filter(F.col("texts") >= min_texts).drop("texts")
    )
    pairs = (
        mentions.join(entities, "entity").select("digest", "copies", "entity", "n_entity", F.explode(words_and_stems(F.col("near"))).alias("term"))
        .groupBy("entity", "n_entity", "term", "digest", "copies").agg(F.lit(1).alias("one"))
        .groupBy("entity", "n_entity", "term").agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("texts"))
        .filter(F.col("texts") >= min_texts)
    )
    pairs = store(pairs.select("n_entity", "term", "n_both"), "evidence")
    wanted = WordFilter(pairs)
    met = docs.select(F.explode(F.filter(words_and_stems(F.col(f"`{text}`")), wanted.may_hold)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    share = F.log(F.col("n_both") / F.col("n_term")) / F.log(F.lit(float(total)) / F.col("n_entity"))
    strength = F.when(F.col("n_entity") < total, 1 + share).otherwise(F.lit(0.0))  # what every document tells is no secret
    strongest = store(pairs.join(met, "term").groupBy("term").agg(F.max(strength).alias("disclosure")).filter(F.col("disclosure") >= threshold), "disclosing")
    is_stem = F.col("term").endswith("*")
    stems = strongest.filter(is_stem).select(F.col("term").alias("stem"), F.col("disclosure").alias("stem_disclosure"))
    flagged = strongest.filter(~is_stem).withColumn("stem", general(F.col("term"))).join(stems, "stem", "left")
    return flagged.select("term", "disclosure", "stem_disclosure", F.when(F.col("stem_disclosure").isNull(), F.col("stem")).otherwise(F.lit("")).alias("replacement"))


def places(text: Column, maybe: Callable[[Column], Column]) -> Column:
    """Array of :data:`PLACE` of the words of a text that pass a filter."""
    def lowered(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("word"))

    placed = F.filter(F.transform(matches(text, WORD), lowered), lambda s: maybe(s["word"]))
    return F.when(F.exists(words(text), maybe), placed).otherwise(F.lit([]).cast(f"array<{PLACE}>"))


def find_personal_data(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, reach: int = REACH, min_texts: int = MIN_TEXTS) -> DataFrame:
    """The table with column ``spans``: array of (start, rank, end, kind, replacement), by start, then kind.

    Kinds are those of :data:`KINDS` (replaced by their name in brackets) and ``term`` for words that disclose an entity
    (outside spans of the other kinds). Positions are code points, ends exclusive. Every row stays and counts for itself;
    null texts are empty and have no spans; equal rows have equal spans; an empty table has no rows. A column named
    ``spans`` is replaced; ids play no part.
    """
    digest, held = free_name(docs, "_digest"), free_name(docs, "_held")
    stay = [c for c in docs.columns if c.lower() != "spans"]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = docs.select(whole.alias("text"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    found = store(docs.select(*[F.col(f"`{c}`") for c in stay], F.unhex(F.sha2(whole, 256)).alias(digest), base_spans(whole, reach).alias(held)), "entities")

    slim = found.select(F.col(digest).alias("digest"), F.col(held).alias("spans"))
    flagged = store(disclosures(slim, source, "text", threshold, min_texts), "flagged")
    asked = WordFilter(flagged)
    terms = (
        source.select("digest", F.explode(places(F.col("text"), asked.may_hold)).alias("p")).groupBy("digest", "p").agg(F.lit(1).alias("one"))
        .select("digest", "p.*").join(flagged.select(F.col("term").alias("word"), "replacement"), "word")
        .groupBy("digest").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(TERM).alias("kind"), "replacement")).alias("terms"))
    )
    fixed = F.transform(held, lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("replacement")))
    outside = F.filter("terms", lambda t: ~F.exists(held, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    joined = found.join(terms.select(F.col("digest").alias(digest), "terms"), digest, "left")
    both = F.when(F.col("terms").isNull(), fixed).otherwise(F.sort_array(F.concat(fixed, outside)))
    return joined.select(*[F.col(f"`{c}`") for c in stay], both.alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """Adds ``n_email`` … ``n_phone``, ``base_sha256`` and turns ``spans`` into text."""
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{k}": count(k) for k in KINDS}
    base = F.filter(spans, lambda s: s["kind"] != TERM)
    return found.withColumns(counts | {"base_sha256": F.sha2(span_list(base), 256), "spans": span_list(spans)})


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The table with the spans of :func:`find_personal_data` in ``text`` replaced, and ``spans``. Of overlapping spans the
    first is replaced together with what the others add; a null text stays null."""
    found = find_personal_data(docs, text, **options)
    whole = F.col(f"`{text}`")

    def replaced(parts: Column) -> Column:
        empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit([]).cast("array<string>").alias("out"))

        def step(state: Column, s: Column) -> Column:
            new = F.array(cut(parts, state["at"], s["start"]), s["replacement"])
            return F.struct(
                F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], F.concat(state["out"], new)).otherwise(state["out"]).alias("out"))

        return F.aggregate("spans", empty, step, lambda s: F.array_join(F.concat(s["out"], F.array(cut(parts, s["at"], F.char_length(whole).cast("long")))), ""))

    return found.withColumn(text, F.when(F.size("spans") > 0, let(blocks(whole), replaced)).otherwise(whole))
