"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

*Targets.* The sources, in code point order with NULL last, have the weights 3, 1, 2,
repeating, and share 150 % of all words. A target stops at twice its source's size and the
excess is shared anew by weight: water-filling, whose level is found by the same resharing.

*Rates.* Among all ways to give every word a rate so that each source meets its target, the
mix nearest to the corpus in relative entropy tilts exponentially: rate = exp(lambda of the
source). The lambdas minimise the convex dual, sum(size * exp(lambda) - target * lambda).
Each document has one source, so that gradient and Hessian are the tilted token sums of
the sources: one map-side combined aggregation, then Newton steps on one row per source,
for all sources in parallel.

*Copies.* A document gets floor(rate) copies and perhaps one more, and so at most two. Which
ones get it is decided for cells of (source, size class, hash bucket): in each size class,
largest first, the buckets below a cut, chosen nearest to the tokens that are still owed;
what remains is owed by the next class. Long documents are so made up for by short ones.
No rank over single documents is needed, and a rerun makes the same choice. A source has
at most 64 x 256 cells, however many documents it holds.

Defined cases: NULL, empty or blank texts have size 0; their copies add no words. A NULL
source is a source. Rows that repeat a ``doc_id`` get the same decision. If all sizes are
0, all targets are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from statweave.llm.common import durable, partitions, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
NEWTON_STEPS = 60
BUCKETS = 256
#: Sources up to which their decisions, under 2 KB each, are broadcast.
BROADCAST_SOURCES = 10_000


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))


def numbered(sources: DataFrame) -> DataFrame:
    """Add ``at``, the position from 0 in code point order, NULL last; no single-task window over rows."""
    n = partitions(sources)
    placed = durable(
        sources.repartitionByRange(n, F.col("source").isNull(), F.col("source"))
        .sortWithinPartitions(F.col("source").isNull(), F.col("source"))
        .withColumn("id", F.monotonically_increasing_id()))
    parts = placed.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), F.shiftright("id", 33) == F.col("part")).select(
        *sources.columns, (F.col("start") + inside).alias("at"))


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source: ``source``, ``source_size`` and ``target``."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    per = durable(numbered(per).select(
        "source", "source_size", F.element_at(cycle, (F.col("at") % len(weights) + 1).cast("int")).alias("weight")))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    cap, level = F.col("source_size") * most, -1.0
    while True:
        # Sources at their cap below the level stay there; the rest of the words is shared by weight.
        full = cap <= F.col("weight") * F.lit(level)
        capped, open_weight = per.agg(
            F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        raised = (share * total - capped) / open_weight if open_weight else level
        if raised <= level:
            return per.select("source", "source_size", F.least(
                cap.cast("double"), F.col("weight") * F.lit(max(level, 0.0))).alias("target"))
        level = raised


def rates(wanted: DataFrame) -> DataFrame:
    """Add ``rate``: Newton's method on the dual, from lambda = 0."""
    step = "l - (1 - target / (source_size * exp(l)))"
    solved = f"aggregate(sequence(1, {NEWTON_STEPS}), 0D, (l, i) -> {step})"
    return wanted.withColumn(
        "rate", F.when(F.col("source_size") > 0, F.round(F.exp(F.expr(solved)), 12)).otherwise(0.0))


def _cell(doc_id: str = "doc_id", size: str = "size") -> list:
    return [
        F.length(F.bin(size)).alias("class"),
        F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 2), 16, 10)
        .cast("int").alias("bucket"),
    ]


def cuts(sized: DataFrame, rated: DataFrame) -> DataFrame:
    """Per source: ``cut``, a map from size class to the first bucket that gets no further copy."""
    cells = sized.groupBy("source", *_cell()).agg(F.sum("size").alias("mass"))
    upto = Window.partitionBy("source", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.withColumn("upto", F.sum("mass").over(upto))
    classes = sums.groupBy("source", "class").agg(
        F.sum("mass").alias("mass"), F.sort_array(F.collect_list(F.struct("bucket", "upto", "mass"))).alias("cells"))
    lists = classes.groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("class", "mass", "cells")), asc=False).alias("classes"))
    owed = "(acc.owed + f * x.mass)"
    kept = f"filter(x.cells, c -> c.upto - c.mass / 2 <= {owed})"  # a prefix, as the sums rise
    rated = rated.select(F.col("source").alias("of"), F.expr("rate - floor(rate)").alias("f"))
    chosen = lists.join(rated, F.col("source").eqNullSafe(F.col("of"))).select("source", "f", "classes")
    empty = "CAST(map() AS MAP<INT, INT>)"
    return chosen.select("source", F.expr(f"""
        aggregate(classes, struct(0D AS owed, {empty} AS cut), (acc, x) -> struct(
            {owed} - coalesce(try_element_at({kept}, -1).upto, 0) AS owed,
            map_concat(acc.cut, map(x.class, coalesce(try_element_at({kept}, -1).bucket + 1, 0))) AS cut)).cut""").alias("cut"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per document: ``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` words.

    ``taken`` is ``size`` times the number of copies.
    """
    sized = durable(sizes(docs, doc_id, text, source))
    rated = rates(targets(sized, weights, share, most))
    tilted = rated.select(F.col("source").alias("of"), "source_size", "target", "rate")
    by_source = durable(cuts(sized, rated).join(tilted, F.col("source").eqNullSafe(F.col("of"))).drop("source"))
    if by_source.count() <= BROADCAST_SOURCES:  # else a shuffle, in which Spark can split a large source
        by_source = F.broadcast(by_source)
    found = sized.select("*", *_cell()).join(by_source, F.col("source").eqNullSafe(F.col("of")))
    more = F.when(F.col("bucket") < F.col("cut")[F.col("class")], 1).otherwise(0)
    copies = F.least(F.floor("rate") + more, F.lit(most))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"))
