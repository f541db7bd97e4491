"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a row of plain statistics. Every statistic is cut into bins at quantiles of
the training sample, and owns a lookup table over its bins. Training walks over the
statistics in turn, many times; each visit fits one shallow tree to the current gradients
(a histogram per bin is all it needs) and adds a small step of it to the table. Then the
pairs whose joint grid explains most of what is left get tables of their own in the same way.
A score is the sum of one table entry per statistic and pair, through the logistic function:
a batch of texts is scored by adding looked-up columns.

Training takes at most ``max_rows`` labelled rows, those with the smallest id hashes, and runs
in the driver on their statistics (not on texts); scoring runs over every whole text in Arrow
batches. Rows whose crc32(doc_id) leaves 2 modulo 4 are held out of training. Statistics come
from the text alone.

Defined cases: NULL and empty texts have all statistics 0 and are scored like any other; a NULL
``doc_id`` counts as the empty string for the held-out rule and has no label; NULL labels are
left out; repeated labels are repeated evidence; with no usable label all scores are 0.5, with
one class only they are its smoothed share; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

MAX_ROWS = 20_000
THRESHOLD = 0.7
FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_neighbours", "capitals", "symbols", "exclamations",
    "stops", "digits", "bars", "beyond_ascii", "white", "log_lines", "repeated_lines", "line_length", "closed_lines",
    "longest_word", "capitalised_words",
)

_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256),
    "white": (32, *range(9, 14)), "exclaim": b"!?", "stop": b".,", "bar": b"|",
    "symbol": [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?()-"],
}
_MASKS = np.array([[c in set(kind) for c in range(256)] for kind in _KINDS.values()], np.int64).T


def statistics(text: bytes | None) -> list[float]:
    """One value per entry of ``FEATURES``, from the whole text."""
    text = text or b""
    found = text.split()
    if not found:
        return [0.0] * len(FEATURES)
    n, size = len(found), len(text)
    by = dict(zip(_KINDS, (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MASKS).tolist(), strict=True))
    lines = text.split(b"\n")
    letters = by["upper"] + by["lower"]
    return [
        np.log1p(n), sum(map(len, found)) / n, len(set(found)) / n, sum(map(eq, found, found[1:])) / n,
        by["upper"] / max(1, letters), by["symbol"] / size, by["exclaim"] / size, by["stop"] / size, by["digit"] / size,
        by["bar"] / size, by["high"] / size, by["white"] / size, np.log1p(len(lines)), 1 - len(set(lines)) / len(lines),
        np.log1p(size / len(lines)), sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines),
        np.log1p(max(map(len, found))), sum(map(bytes.istitle, found)) / n,
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _leaf(g: float, h: float, l2: float) -> float:
    return g / (h + l2)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> np.ndarray:
    """Newton step per bin from a tree of ``depth`` cuts along the bins, given gradient and Hessian sums."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = gl**2 / (hl + l2) + (g.sum() - gl) ** 2 / (h.sum() - hl + l2)
        at = int(gain.argmax()) + 1
        if gain[at - 1] > g.sum() ** 2 / (h.sum() + l2) + 1e-9:
            return np.concatenate([_tree(g[:at], h[:at], depth - 1, l2), _tree(g[at:], h[at:], depth - 1, l2)])
    return np.full(len(g), _leaf(g.sum(), h.sum(), l2))


def _grid_tree(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """The same over a grid: one cut across the rows, and on either side one along the columns.

    The three cuts are chosen together, so that a pure interaction is found as well.
    """
    def best(left_g: np.ndarray, left_h: np.ndarray) -> np.ndarray:
        """Gain of the best column cut, from column-cumulated sums; one per row cut."""
        right_g, right_h = left_g[:, -1:] - left_g, left_h[:, -1:] - left_h
        return (left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2)).max(axis=1)

    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    at = int((best(cg, ch) + best(cg[-1] - cg, ch[-1] - ch)).argmax()) + 1
    parts = [np.tile(_tree(g[a:b].sum(0), h[a:b].sum(0), 1, l2), (b - a, 1)) for a, b in ((0, at), (at, len(g))) if b > a]
    return np.concatenate(parts)


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.tables and len(x):
            at = self.bins(x)
            for j, table in enumerate(self.tables):
                total += table[at[:, j]]
            for (i, j), table in self.pairs.items():
                total += table[at[:, i], at[:, j]]
        return _sigmoid(total)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, n_bins: int = 24, n_pairs: int = 6,
        pair_rounds: int = 40, depth: int = 2, l2: float = 1.0) -> Model:
    """Cyclic boosting of shallow trees into lookup tables, first per feature, then per chosen pair."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(base=float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, n_bins + 1)[1:-1])) for c in x.T]
    at = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    total = np.full(len(y), model.base)

    def sums(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(total)
        return np.bincount(code, weights=y - p, minlength=size), np.bincount(code, weights=p * (1 - p), minlength=size)

    for _ in range(rounds):
        for j, size in enumerate(sizes):
            step = rate * _tree(*sums(at[:, j], size), depth, l2)
            model.tables[j] += step
            total += step[at[:, j]]

    codes = {(i, j): at[:, i] * sizes[j] + at[:, j] for i in range(len(sizes)) for j in range(i)}

    def gain(pair: tuple[int, int]) -> float:
        g, h = sums(codes[pair], sizes[pair[0]] * sizes[pair[1]])
        return float((g**2 / (h + 8 * l2)).sum())

    chosen = sorted(codes, key=lambda pair: (-gain(pair), pair))[:n_pairs]
    model.pairs = {pair: np.zeros((sizes[pair[0]], sizes[pair[1]])) for pair in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            g, h = sums(codes[i, j], sizes[i] * sizes[j])
            step = rate * _grid_tree(g.reshape(sizes[i], sizes[j]), h.reshape(sizes[i], sizes[j]), 4 * l2)
            model.pairs[i, j] += step
            total += step[at[:, i], at[:, j]]
    return model


def _matrix(texts: pa.Array) -> np.ndarray:
    raw = texts.cast(pa.large_binary())
    return np.array([statistics(x.as_py()) for x in raw], float).reshape(len(raw), len(FEATURES))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pa.Array) -> pa.Array:
    return pa.array(list(_matrix(texts)), pa.list_(pa.float64()))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
          max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows that are not held out."""
    usable = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).select(
        F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y"), F.xxhash64(doc_id).alias("turn"))
    n = usable.count()
    # The lowest hashes: a few more than wanted, so that the broadcast is bounded before the exact cut.
    least = int(-(2**63) + 2**64 * min(1.0, 1.2 * max_rows / max(n, 1)))
    sample = usable.where(F.col("turn") <= F.lit(min(least, 2**63 - 1)))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").select("turn", "id", "y", _statistics("text").alias("x"))
    taken = rows.orderBy("turn", "id", "y", "x").limit(max_rows).select("x", "y").toPandas()
    if not len(taken):
        return Model()
    return fit(np.array(taken.x.tolist(), float), taken.y.to_numpy() >= 0.5)


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``score`` and ``predicted``."""

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.score(_matrix(texts)))

    out = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), score(F.col(text)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
