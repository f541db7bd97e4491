"""Exact top-k inner products by an impact-ordered index, score at a time.

Vectors become integers, floor(scale * x). Candidates are dealt to blocks by a hash; a block is
one row with its ids and its matrix. The index of a block has a posting list per dimension: its
members by falling |value|, cut into segments of equal quantised impact (|value| in 1/255 of the
block's largest).

For a query, a segment's impact is |query value| times its level. Segments of all dimensions are
processed from the largest impact down, each adding its members' contributions to accumulators.
What is unprocessed in a dimension contributes at most |query value| times the next |value| of
its list, up or down; summed over the dimensions this is ``rest``. The best accumulators are
rescored from whole vectors, and the k-th best of these is a score that the result reaches in any
case. A member whose accumulator plus ``rest`` stays below it cannot be in the result: that is
the proof. Processing stops as soon as few members remain possible; all of these are rescored
exactly, ties included, so that the result is that of brute force. If the proof never comes,
all segments are processed, and the accumulators themselves are exact.

Every candidate block meets every query block (the stated query set against all rows), in tasks
that hold one pair of blocks. Only k rows per query and candidate block leave a task, and a
ranked window, limited before the shuffle, merges them. Neither side is broadcast or collected.

Defined cases: NULL vectors, and vectors holding NULL, NaN or infinite components, take no part;
rows without an id neither; vectors of another length than the query's are no candidates of it;
a row that repeats the query's id is its own row and left out; other repeated rows count each;
fewer candidates than k are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

K = 5
SCALE = 256
#: Rows per block: what one task holds of either side.
QUERY_ROWS = 1024
CANDIDATE_ROWS = 8192
LEVELS = 255
#: Shares of the postings after which the proof is looked for.
LOOKS = (0.3, 0.45, 0.6, 0.8)


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id`` and ``v`` (array of long) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    return vectors.where(F.col(vec_id).isNotNull() & _usable(v)).select(
        F.col(vec_id).cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def blocked(rows: DataFrame, n: int, name: str) -> DataFrame:
    """One row per block and vector length: ``name`` (block number), ``dims``, ids and matrix as bytes."""
    dealt = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(n)).alias(name), F.size("v").alias("dims"), "id", "v")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        matrix = np.array(part["v"].tolist(), np.int64).reshape(len(part), -1)
        small = np.abs(matrix).max() < 2**15  # half of the bytes on the way, where they suffice
        return pd.DataFrame({
            name: [part[name].iloc[0]], "dims": [matrix.shape[1]], f"{name}_small": [bool(small)],
            f"{name}_ids": [part["id"].to_numpy(np.int64).tobytes()],
            f"{name}_matrix": [matrix.astype(np.int16 if small else np.int64).tobytes()]})

    return dealt.groupBy(name, "dims").applyInPandas(
        pack, f"{name} long, dims int, {name}_small boolean, {name}_ids binary, {name}_matrix binary")


def _unpacked(ids: bytes, matrix: bytes, small: bool, dims: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(matrix, np.int16 if small else np.int64).astype(np.int64)
    return np.frombuffer(ids, np.int64), rows.reshape(-1, dims)


class Index:
    """Impact-ordered posting lists of one block."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        size = np.abs(matrix)
        self.members = np.argsort(-size, axis=0, kind="stable").T.copy()  # per dimension, by falling |value|
        self.values = np.take_along_axis(matrix.T, self.members, axis=1)
        self.sizes = np.abs(self.values)
        self.most = max(1, int(size.max(initial=0)))
        levels = -(-self.sizes * LEVELS // self.most)
        # ends[d, l]: how many postings of dimension d have a level of l or more.
        self.ends = np.stack([len(ids) - np.searchsorted(row[::-1], np.arange(LEVELS + 2), side="left") for row in levels])

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best members, ties to the smaller id; rows of id ``own`` are left out."""
        dims, n = self.values.shape
        others = np.nonzero(self.ids != own)[0]
        k = min(k, len(others))
        if not k:
            return self.ids[:0], self.ids[:0]
        weight, each = np.abs(query), np.arange(dims)
        gained, done = np.zeros(n, np.int64), np.zeros(dims, np.int64)
        possible = others
        for impact in (*self._impacts(weight, n), 0):
            # Levels of each dimension whose impact is at least this one.
            lowest = np.where(weight > 0, -(-impact // np.maximum(weight, 1)), LEVELS + 1 if impact else 0)
            reach = np.maximum(done, self.ends[each, np.minimum(lowest, LEVELS + 1)])
            for d in np.nonzero(reach > done)[0]:
                part = slice(done[d], reach[d])
                gained[self.members[d, part]] += query[d] * self.values[d, part]  # a member once per dimension
            done = reach
            rest = int((weight * np.where(done < n, self.sizes[each, np.minimum(done, n - 1)], 0)).sum())
            ahead = others[np.argpartition(-gained[others], k - 1)[:k]] if rest else others
            sure = np.partition(self.matrix[ahead] @ query, len(ahead) - k)[len(ahead) - k] if rest else None
            possible = others if sure is None else others[gained[others] + rest >= sure]
            if len(possible) <= max(4 * k, n // 16):
                break
        scores = self.matrix[possible] @ query
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible][best], scores[best]

    def _impacts(self, weight: np.ndarray, n: int) -> list[int]:
        """Impacts down to which about the shares ``LOOKS`` of all postings are processed."""
        counts = -np.diff(self.ends[:, 1:], axis=1)  # postings per dimension and level 1..LEVELS
        impacts = np.outer(weight, np.arange(1, LEVELS + 1)).ravel()
        order = np.argsort(-impacts, kind="stable")
        upto = np.cumsum(counts.ravel()[order])
        at = np.searchsorted(upto, np.array(LOOKS) * n * len(weight))
        return [int(impacts[order[min(i, len(order) - 1)]]) for i in at]


def _searcher(k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, index = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held != (row.block, row.dims):  # pairs come sorted by candidate block
                    held = row.block, row.dims
                    index = Index(*_unpacked(row.block_ids, row.block_matrix, row.block_small, row.dims))
                asked = _unpacked(row.queries_ids, row.queries_matrix, row.queries_small, row.dims)
                found = [(query_id, *index.search(query, query_id, k)) for query_id, query in zip(*asked, strict=True)]
                yield pd.DataFrame({
                    "query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64),
                    "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding",
          scale: int = SCALE, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k best rows of each query.

    ``is_query`` is a condition on ``id``. Where rows of different vectors share a query id, the
    best k over all of them are returned.
    """
    rows = integers(vectors, vec_id, embedding, scale)
    asked = rows.where(is_query).distinct()
    n_all, n_asked = rows.count(), asked.count()
    n_blocks, n_queries = max(1, -(-n_all // candidate_rows)), max(1, -(-n_asked // query_rows))
    # Each pair of blocks has its own key, so that pairs spread over all tasks.
    queries = blocked(asked, n_queries, "queries").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    blocks = blocked(rows, n_blocks, "block").withColumn("queries", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    pairs = blocks.join(queries, ["block", "queries", "dims"])
    found = pairs.mapInPandas(_searcher(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
