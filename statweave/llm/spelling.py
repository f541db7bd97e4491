"""Spelling variants: words one edit apart, found in a trie of letter counts.

The letters are dealt to groups, and a word becomes its vector of letter counts per group. A
trie arranges the words by these counts, one group a level. One inserted letter adds one to one
count, a deleted one takes one away, a replaced one does either, or both to different groups (or
nothing, within a group). A depth-first search therefore carries two budgets, one surplus and one
deficit: it enters the child of the query's own count for nothing, and the children beside it
for the budget, until it is spent. The words at the leaves are verified letter by letter.

*Distribution.* The top of the trie is grown from counts per prefix: a node with more than
``limit`` words is split by its next group. Its leaves are the shards. Every word lives in one
shard and visits all that the search of the top reaches; each shard is one task's group, in which
the search goes on below. A task holds ``limit`` words and the visitors of their neighbourhood; a
shard that all groups leave too large is cut into pieces, and its visitors go to each piece. The
search carries many queries down at once. Pairs never leave a task: it returns the number of near
words and the best of them for every visitor with any, and these are combined.

``limit`` is 8,192 words, or a 4,096th of all words if that is more, so that at most 4,096 nodes
a level are split. Counts in the top stop at 15 (a difference of one or less stays one or less), so
that it has at most 16 x 4,096 nodes a level: that bounds what the driver receives and broadcasts.

Defined cases: NULL and empty texts have no words; a NULL ``doc_id`` counts as the empty string in
the checksum; repeated rows count each; of equally frequent near words the smallest in code-point
order is taken; a word may have any length; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from statweave.llm.common import durable

LETTERS = r"A-Za-zÀ-ÿ"
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is at least this many times as frequent as its variant.
RATIO = 5
#: One in so many (document, word) pairs loses a letter.
NOISE = 199
GROUPS = 12
SHARD = 8192
SHARDS = 4096
#: Counts in the top of the trie stop here.
TOP = 15
#: A node with so few pairs of words and queries, or fewer, is a leaf: the rest of the budget is looked at in one step.
PAIRS = 1 << 15
#: Longer words are verified one pair at a time.
WIDE = 40
#: Rows that a routing task returns at a time.
ROUTED = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# -- words ---------------------------------------------------------------------

def damaged(doc_id: Column, run: Column, noise: int = NOISE) -> Column:
    """The run without one code point where the checksum of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % noise == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                  min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """``word`` and ``n`` of the words that are long and frequent enough."""
    # Shorter runs cannot become words, as none gains a letter.
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    each = docs.select(F.col(doc_id).alias("doc_id"), F.explode(runs).alias("run"))
    low = each.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    words = low.select(damaged(F.col("doc_id"), F.col("run"), noise).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# -- letter counts -------------------------------------------------------------

def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and the number of each word."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, words), np.int64, len(words))


def letter_counts(words: list[str]) -> np.ndarray:
    """One row per word: its letters per group."""
    codes, lengths = _codes(words)
    cells = np.repeat(np.arange(len(words)), lengths) * GROUPS + codes % GROUPS
    return np.bincount(cells, minlength=len(words) * GROUPS).reshape(-1, GROUPS)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _top_counts(words: pa.Array) -> pa.Array:
    return pa.array(list(np.minimum(letter_counts(words.to_pylist()), TOP).astype(np.int32)), pa.list_(pa.int32()))


# -- verification --------------------------------------------------------------

def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells the words apart."""
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    low, high = 0, len(b)  # longest common prefix, by halving
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return a[low + 1:] == b[low + (len(a) == len(b)):]


class Words:
    """Words as rows of code points, read from the left and from the right."""

    def __init__(self, words: list[str]):
        self.words = words
        codes, self.lengths = _codes(words)
        row, starts = np.repeat(np.arange(len(words)), self.lengths), np.cumsum(self.lengths) - self.lengths
        at = np.arange(len(codes)) - np.repeat(starts, self.lengths)
        self.left, self.right = (np.zeros((len(words), WIDE), np.uint32) for _ in range(2))
        fits = np.repeat(self.lengths <= WIDE, self.lengths)
        self.left[row[fits], at[fits]] = codes[fits]
        self.right[row[fits], (np.repeat(self.lengths, self.lengths) - 1 - at)[fits]] = codes[fits]

    def near(self, i: np.ndarray, other: Words, j: np.ndarray) -> np.ndarray:
        """For each pair of a word and an ``other`` word: one edit apart?"""
        a, b = self.lengths[i], other.lengths[j]
        out = np.zeros(len(i), bool)
        wide = (np.maximum(a, b) > WIDE) & (np.abs(a - b) <= 1)
        for k in np.nonzero(wide)[0]:
            out[k] = one_edit(self.words[i[k]], other.words[j[k]])
        plain = np.nonzero((np.maximum(a, b) <= WIDE) & (np.abs(a - b) <= 1))[0]
        i, j, short, long = i[plain], j[plain], np.minimum(a, b)[plain], np.maximum(a, b)[plain]
        columns = int(long.max(initial=0))
        ahead = _leading(self.left[i, :columns] == other.left[j, :columns])
        behind = _leading(self.right[i, :columns] == other.right[j, :columns])
        # Prefix and suffix cover all but one letter of the longer word; equal words cover more.
        out[plain] = (ahead < long) & (np.minimum(ahead, short) + behind >= long - 1)
        return out


def _leading(same: np.ndarray) -> np.ndarray:
    """Length of the run of True at the start of each row."""
    return np.where(same.all(axis=1), same.shape[1], (~same).argmax(axis=1)) if same.size else np.zeros(len(same), np.int64)


# -- the trie ------------------------------------------------------------------

class Trie:
    """Sorted count vectors; a node is a range of them with one prefix."""

    def __init__(self, counts: np.ndarray):
        self.order = np.lexsort(counts.T[::-1])
        self.counts = counts[self.order]

    def search(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query rows, word rows) whose counts differ within the budgets."""
        every = np.arange(len(queries))
        if len(self.counts) and len(queries):
            yield from self._down(queries, 0, len(self.counts), 0, every, np.ones(len(queries), bool), np.ones(len(queries), bool))

    def _down(self, queries, lo, hi, level, rows, surplus, deficit):
        if level == GROUPS or (hi - lo) * len(rows) <= PAIRS:
            yield from self._leaf(queries, lo, hi, level, rows, surplus, deficit)
            return
        column = self.counts[lo:hi, level]
        starts = np.concatenate([[0], np.nonzero(np.diff(column))[0] + 1, [hi - lo]])
        own = queries[rows, level]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            over = own - column[a]
            enter = (over == 0) | (over == 1) & surplus | (over == -1) & deficit
            if enter.any():
                spent = over[enter]
                yield from self._down(queries, lo + a, lo + b, level + 1, rows[enter], surplus[enter] & (spent != 1), deficit[enter] & (spent != -1))

    def _leaf(self, queries, lo, hi, level, rows, surplus, deficit):
        step = max(1, PAIRS // (hi - lo))
        for at in range(0, len(rows), step):
            some = slice(at, at + step)
            over = queries[rows[some], None, level:] - self.counts[None, lo:hi, level:]
            within = (np.maximum(over, 0).sum(axis=2) <= surplus[some, None]) & (np.maximum(-over, 0).sum(axis=2) <= deficit[some, None])
            q, w = np.nonzero(within)
            yield rows[some][q], self.order[lo + w]


def best_near(held: list[str], counts: list[int], asked: list[str]) -> pa.Table:
    """Per asked word with near words among ``held`` (with their ``counts``): their number and the best of them."""
    n, left, right = np.array(counts, np.int64), Words(asked), Words(held)
    # By falling n, then by code points: the first near word in this order is the best.
    order = sorted(range(len(held)), key=lambda k: (-counts[k], held[k]))
    rank = np.empty(len(held), np.int64)
    rank[order] = np.arange(len(held))
    number, first = np.zeros(len(asked), np.int64), np.full(len(asked), len(held), np.int64)
    for q, w in Trie(letter_counts(held)).search(letter_counts(asked)):
        near = left.near(q, right, w)
        number += np.bincount(q[near], minlength=len(asked))
        np.minimum.at(first, q[near], rank[w[near]])
    found = np.nonzero(number)[0]
    best = [order[k] for k in first[found]]
    return pa.table({
        "word": pa.array([asked[k] for k in found], pa.string()), "n_near": pa.array(number[found], pa.int64()),
        "near": pa.array([held[k] for k in best], pa.string()), "near_n": pa.array(n[best] if best else [], pa.int64())})


# -- shards --------------------------------------------------------------------

def top_trie(words: DataFrame, limit: int) -> dict[tuple[int, ...], int]:
    """Prefixes of the shards, with their numbers of words; ``words`` has ``top``, the capped counts."""
    shards, large = {}, {(): words.count()}
    if large[()] <= limit:
        return large
    for level in range(1, GROUPS + 1):
        prefix = F.slice("top", 1, level)
        if level == 1:
            inside = words
        else:
            parents = words.sparkSession.createDataFrame([(list(p),) for p in large], "parent array<int>")
            inside = words.join(F.broadcast(parents), F.slice("top", 1, level - 1) == F.col("parent"), "left_semi")
        found = {tuple(r.prefix): r["count"] for r in inside.groupBy(prefix.alias("prefix")).count().collect()}
        large = {p: c for p, c in found.items() if c > limit and level < GROUPS}
        shards |= {p: c for p, c in found.items() if p not in large}
        if not large:
            break
    return shards


def nested(shards: list[tuple[int, ...]]) -> dict | int:
    """The top as nested dicts: count -> child, a shard's number at the end."""
    top: dict = {}
    for number, prefix in enumerate(shards):
        if not prefix:
            return number
        node = top
        for count in prefix[:-1]:
            node = node.setdefault(count, {})
        node[prefix[-1]] = number
    return top


def reached(top: dict | int, counts: np.ndarray) -> list[list[int]]:
    """The shards that the search of the top reaches, for every row of counts."""
    out: list[list[int]] = [[] for _ in counts]

    def down(node, level, rows, surplus, deficit):
        if isinstance(node, int):
            for row in rows.tolist():
                out[row].append(node)
            return
        own = counts[rows, level]
        for count, child in node.items():
            over = own - count
            enter = (over == 0) | (over == 1) & surplus | (over == -1) & deficit
            if enter.any():
                spent = over[enter]
                down(child, level + 1, rows[enter], surplus[enter] & (spent != 1), deficit[enter] & (spent != -1))

    down(top, 0, np.arange(len(counts)), np.ones(len(counts), bool), np.ones(len(counts), bool))
    return out


def home_of(top: dict | int, counts: np.ndarray) -> list[int]:
    homes = []
    for row in counts.tolist():
        node, level = top, 0
        while not isinstance(node, int):
            node, level = node[row[level]], level + 1
        homes.append(node)
    return homes


def _router(spark: SparkSession, shards: dict[tuple[int, ...], int], limit: int) -> Callable[[DataFrame], DataFrame]:
    """(shard, piece, home, word, n): a word's home and the places that it visits."""
    prefixes = sorted(shards)
    pieces = [-(-shards[p] // limit) for p in prefixes]
    shared = spark.sparkContext.broadcast((nested(prefixes), pieces))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, cut = shared.value
        for batch in batches:
            counts = np.array(batch.column("top").to_pylist(), np.int64).reshape(-1, GROUPS)
            homes, turns, rows = home_of(top, counts), batch.column("turn").to_pylist(), []
            for at, visits in enumerate(reached(top, counts)):
                own = (homes[at], turns[at] % cut[homes[at]])
                rows += [(shard, piece, (shard, piece) == own, at) for shard in visits for piece in range(cut[shard])]
                if rows and (len(rows) >= ROUTED or at + 1 == len(homes)):
                    yield _routed(batch, rows)
                    rows = []

    return lambda words: words.mapInArrow(route, "shard int, piece int, home boolean, word string, n long")


def _routed(batch: pa.RecordBatch, rows: list[tuple[int, int, bool, int]]) -> pa.RecordBatch:
    shard, piece, home, at = zip(*rows, strict=True)
    taken = batch.take(pa.array(at))
    return pa.RecordBatch.from_pydict({
        "shard": pa.array(shard, pa.int32()), "piece": pa.array(piece, pa.int32()), "home": pa.array(home),
        "word": taken.column("word"), "n": taken.column("n")})


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """Per word with near words: ``word``, ``n_near`` and ``best``, a struct of the best one's ``n`` and ``word``."""
    marked = durable(words.select("word", "n", _top_counts("word").alias("top"), F.pmod(F.xxhash64("word"), F.lit(2**31)).alias("turn")))
    limit = max(shard, marked.count() // SHARDS)
    places = _router(words.sparkSession, top_trie(marked, limit), limit)(marked)

    def search(group: pa.Table) -> pa.Table:
        home = group.filter(group.column("home"))
        return best_near(home.column("word").to_pylist(), home.column("n").to_pylist(), group.column("word").to_pylist())

    found = places.groupBy("shard", "piece").applyInArrow(search, "word string, n_near long, near string, near_n long")
    order = F.struct((-F.col("near_n")).alias("falling"), F.col("near").alias("word"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("best")).select(
        "word", "n_near", F.struct((-F.col("best.falling")).alias("n"), "best.word").alias("best"))


# -- forms and roots -----------------------------------------------------------

def variants(words: DataFrame, ratio: int = RATIO, shard: int = SHARD) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word in ``words`` (``word``, ``n``)."""
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its variant")
    words = durable(words)
    near = near_words(words, shard).withColumnRenamed("word", "of")
    is_form = F.col("best.n") >= ratio * F.col("n")
    formed = durable(words.join(near, words.word == near.of, "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, F.col("best.n")).alias("form_n")))
    # Every step of a chain is ``ratio`` times as frequent as the one before: that bounds its length.
    depth = log(formed.agg(F.max("n")).first()[0] or 1) / log(ratio)
    steps = ceil(log2(max(1.0, depth)))
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(steps):  # pointers that double their reach
        onward = links.select(F.col("word").alias("of"), F.col("root").alias("onward"))
        links = durable(links.join(onward, F.col("root") == F.col("of"), "left").select("word", F.coalesce("onward", "root").alias("root")))
    links = links.withColumnRenamed("word", "of")
    return formed.join(links, formed.word == links.of, "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
