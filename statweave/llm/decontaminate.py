"""Benchmark decontamination: one Aho-Corasick automaton, one scan of every text.

A text is normalised bytewise: A-Z to lower case, every other ASCII byte outside 0-9 and
a-z to a blank, runs of blanks to one. Words of the normalised text keep their order, so
that a match ends at a word number, and the word number leads back to the code points of
the original text.

The automaton reads words as codes of two characters. It holds each window of ten consecutive item words once,
with the items that own it; an item of fewer words, but not none, is one window. It is built
once in each Python worker, and takes about 1 KB for a word of the benchmark. A benchmark
of more than ``part_chars`` characters is dealt by item to several automata, used one after
the other with the results so far written in between: a worker holds one of them at a time,
and the driver collects one part at a time. The results are the same.

Defined cases: NULL or empty texts have no words and are clean; a NULL ``item_id`` hits
words but is not listed; rows that repeat an item, or a document, are handled as given
(an item is listed once); an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from statweave.llm.common import durable

WINDOW = 10
#: About 350,000 words, or 360 MB in a Python worker.
PART_CHARS = 2_000_000

_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
#: ``runs`` are the hit words by number, ``spans`` the same by code point.
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("runs", _RUNS), T.StructField("spans", _RUNS),
])
_PAIRS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("runs", _PAIRS), ("spans", _PAIRS),
])
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_ORIGINAL = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


#: Two characters that no code of a word holds.
_UNKNOWN = "\0\0"


def _codes(items: Iterable[list[bytes]]) -> dict[bytes, str]:
    """Two characters for every word, from two ranges, so that a code is only found where a word starts.

    A state has one edge for each character that may follow and looks through them one by one;
    with two characters it has about the square root of the number of words at most.
    """
    numbers: dict[bytes, int] = {}
    for found in items:
        for word in found:
            numbers.setdefault(word, len(numbers))
    base = math.isqrt(len(numbers)) + 1
    return {w: chr(1 + n // base) + chr(1 + base + n % base) for w, n in numbers.items()}


class Scanner:
    """All windows of some items in one automaton over coded words."""

    def __init__(self, items: Sequence[tuple[str | None, str | None]], window: int = WINDOW):
        split = [(item, words_of(text.encode() if text else None)) for item, text in items]
        self.codes = _codes(found for _, found in split)
        self.sizes: list[int] = []
        self.owners: list[tuple[str, ...]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for item, found in split:
            size = min(window, len(found))
            coded = "".join(map(self.codes.__getitem__, found))
            for i in range(len(found) - size + 1 if found else 0):
                key = coded[2 * i:2 * (i + size)]
                at = self.automaton.get(key, -1)
                if at < 0:
                    at = len(self.sizes)
                    self.automaton.add_word(key, at)
                    self.sizes.append(size)
                    self.owners.append(())
                if item is not None and item not in self.owners[at]:
                    self.owners[at] += (item,)
        if self.sizes:
            self.automaton.make_automaton()

    def scan(self, text: bytes | None, before: dict | None = None) -> dict:
        """Words, hit words, items and hit runs of the text, with those found ``before`` by other automata."""
        found = words_of(text)
        known = before or {"items": [], "runs": []}
        coded = "".join(map(self.codes.get, found, repeat(_UNKNOWN)))
        matches = list(self.automaton.iter(coded)) if found and self.sizes else []
        if not matches and not known["runs"]:
            return {"n_words": len(found), "n_hit": 0, "items": [], "runs": [], "spans": []}
        # The codes are of equal length, so a match ends at a word number.
        last = np.array([end // 2 for end, _ in matches], np.int64)
        sizes = np.array([self.sizes[at] for _, at in matches], np.int64)
        turns = np.zeros(len(found) + 1, np.int64)
        np.add.at(turns, last - sizes + 1, 1)
        np.add.at(turns, last + 1, -1)
        for run in known["runs"]:
            turns[run["start"]] += 1
            turns[run["stop"]] -= 1
        hit = np.cumsum(turns[:-1]) > 0
        edges = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
        runs = list(zip(np.nonzero(edges > 0)[0].tolist(), np.nonzero(edges < 0)[0].tolist(), strict=True))
        places = [m.span() for m in _ORIGINAL.finditer(text.decode())]
        items = set(known["items"]).union(*(self.owners[at] for at in {at for _, at in matches}))
        return {
            "n_words": len(found), "n_hit": int(hit.sum()), "items": sorted(items),
            "runs": [{"start": a, "stop": b} for a, b in runs],
            "spans": [{"start": places[a][0], "stop": places[b - 1][1]} for a, b in runs],
        }


@lru_cache(maxsize=1)
def _scanner(items: tuple, window: int) -> Scanner:
    """One automaton for all tasks of a Python worker."""
    return Scanner(items, window)


def _scan(items: Broadcast, window: int):
    @F.arrow_udf(RESULT)
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        built = _scanner(items.value, window)
        for texts, known in batches:
            yield pa.array([
                built.scan(x.as_py(), k.as_py()) for x, k in zip(texts.cast(pa.large_binary()), known, strict=True)], type=_ARROW)

    return scan


def _scans(
    docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, part_chars: int = PART_CHARS,
) -> Iterator:
    """For each part of the benchmark a function from (text, result so far) to ``RESULT``."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // part_chars))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)))
    for part in range(parts):
        held = dealt.where(F.col("part") == part).select("item", "text").collect()
        yield _scan(docs.sparkSession.sparkContext.broadcast(tuple(tuple(r) for r in held)), window)


def _found(docs: DataFrame, benchmark: DataFrame, text: str, **options) -> DataFrame:
    """(row, found): the rows of ``docs`` as structs beside their ``RESULT``."""
    out = docs.select(F.struct("*").alias("row"), F.lit(None).cast(RESULT).alias("found"))
    for number, scan in enumerate(_scans(docs, benchmark, **options)):
        # Written between two automata, so that no worker builds both for one batch.
        out = (durable(out) if number else out).select("row", scan(F.col(f"row.`{text}`"), F.col("found")).alias("found"))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_hit``, ``items`` and ``spans``."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _found(narrow, benchmark, "text", **options).select(
        "row.doc_id", *[f"found.{c}" for c in ("n_words", "n_hit", "items", "spans")])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any hit, as they are."""
    return _found(docs, benchmark, text, **options).where(F.col("found.n_hit") == 0).select("row.*")
