"""Line dedup over a suffix array of line numbers, in DataFrame operations only.

A run is a sequence of consecutive lines of one document. A run of at least ``min_words``
words whose text also starts at an earlier place of the corpus (smaller ``doc_id``, then
line) is a later copy, and its lines are deleted; the first copy stays.

*Positions.* Every line becomes one row with a 128-bit hash; documents are put in order by a
range partitioning, so that the row number is a position in the text of the whole corpus.

*Prefix doubling.* Level k holds the positions whose 2^k lines occur at least twice, each
with ``rank``: suffixes that agree on 2^k lines have one rank, and the ranks are in
lexicographic order (the lines themselves are numbered by first occurrence). The next level
ranks pairs (rank of i, rank of i + 2^k). An equal rank is an interval of the suffix array
with a longest common prefix of 2^k or more. A suffix whose prefix is unique has its place
and drops out, so that levels shrink to what is repeated; the last one is empty.

*Intervals.* From the top level down, the intervals are refined by the next smaller power of
two. The members of an interval that agree on the next 2^m lines form a sub-interval: all but
its first position move there, as an earlier copy of the longer run exists for them; the
first stays, and is a witness in both. At the end each position knows the longest run that
an earlier position repeats. Rows per step: the members, and one witness per sub-interval;
no pairs of copies are made.

All groups are taken by combined aggregates and by joins that Spark can split; positions are
unique keys. Windows run within a document only. Levels of at most ``FEW`` positions, and the
intervals on them, are worked on in one partition: a long document alone makes a dozen levels of
some rows, and shuffles of those would write little but files per task.

Defined cases: a NULL text has no lines and stays; an empty text is one empty line; rows that
repeat ``doc_id`` and text count as one document and come out alike; documents of one
``doc_id`` with different texts are ordered by text hash, NULL ids come first; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from statweave.llm.common import content_key, durable, keyed, partitions, same_content, words

MIN_WORDS = 50
#: Positions of a level up to which it stays in one partition; intervals on it have at most about twice as many rows.
FEW = 50_000
KEY = ("doc_id", "h1", "h2")


def positions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line: document key, ``line``, ``a`` and ``b`` (its hash), ``pos``, ``last`` of its document, ``upto`` (words)."""
    split = docs.select(F.col(doc_id).alias("doc_id"), *content_key(F.col(text)),
                        F.posexplode(F.split(F.col(text), "\n")).alias("line", "said"))
    hashed = split.select(*KEY, "line", F.xxhash64("said").alias("a"),
                          F.xxhash64(F.lit("second"), "said").alias("b"), words(F.col("said")).alias("w"))
    once = durable(hashed.groupBy(*KEY, "line").agg(*[F.min(c).alias(c) for c in ("a", "b", "w")]))
    # The partitioning by range of the key also serves the window, and keeps a document together.
    placed = once.repartitionByRange(partitions(docs), *KEY).sortWithinPartitions(*KEY, "line")
    within = Window.partitionBy(*KEY).orderBy("line")
    placed = placed.select("*", F.sum("w").over(within).alias("upto"), F.max("line").over(
        within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("lines"))
    placed = placed.withColumn("pos", F.monotonically_increasing_id())
    return durable(placed.select(*KEY, "line", "a", "b", "w", "upto", "pos", (F.col("pos") + F.col("lines") - F.col("line")).alias("last")))


def sorted_in(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: dozens of small tables a run would pass through the driver."""
    return df.hint("merge")


def _repeated(rows: DataFrame, *key: str) -> DataFrame:
    """``key``, ``first`` of each class of equal keys with at least two positions."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).where("n > 1").drop("n")


def _dealt(classes: DataFrame) -> DataFrame:
    """Dealt out by another column than their key, so that a join on the key deals both sides anew and Spark can split a large class."""
    return classes.repartition("first")


def levels(lines: DataFrame) -> list[DataFrame]:
    """Prefix doubling: per level the rows (``pos``, ``last``, ``rank``, ``first``, ``size``).

    ``size``, the number of lines compared, is a column: all rounds then run the same compiled code.
    """
    found = _dealt(_repeated(lines, "a", "b"))
    level = durable(lines.join(sorted_in(found), ["a", "b"]).select(
        "pos", "last", F.col("first").alias("rank"), "first", F.lit(1).cast("long").alias("size")))
    out = []
    while n := level.count():
        few = n <= FEW
        level = level.coalesce(1) if few else level
        out.append(level)
        ahead = level.select((F.col("pos") - F.col("size")).alias("pos"), F.col("rank").alias("r2"))
        pairs = level.where("pos + size <= last").select("pos", "last", F.col("rank").alias("r1"), "size").join(sorted_in(ahead), "pos")
        classes = _repeated(pairs, "r1", "r2")
        # Row numbers of the sorted pairs keep their order.
        placed = classes if few else classes.repartitionByRange(partitions(lines), "r1", "r2")
        ranked = placed.sortWithinPartitions("r1", "r2").select(
            "r1", "r2", "first", F.monotonically_increasing_id().alias("rank"))
        level = durable(pairs.join(sorted_in(ranked), ["r1", "r2"]).select(
            "pos", "last", "rank", "first", (F.col("size") * 2).alias("size")))
    return out


def longest_repeats(doubling: list[DataFrame]) -> DataFrame:
    """(``pos``, ``len``, ``first``): the longest run at ``pos`` that also starts at an earlier position, ``first``."""
    state = above = None
    for level in reversed(doubling):
        few = level.rdd.getNumPartitions() == 1
        # Positions whose longest power of two with an earlier copy is this one, and their witnesses.
        new = level.where("pos <> first")
        if above is not None:
            new = new.join(sorted_in(above.where("pos <> first").select("pos")), "pos", "left_anti")
        new = new.select("pos", "last", F.col("size").alias("len"), "first")
        seen = new.select(F.col("first").alias("pos"), "len", "first").distinct()
        witnesses = level.where("pos = first").select("pos", "last").join(sorted_in(seen), "pos").select("pos", "last", "len", "first")
        new = new.unionByName(witnesses)
        found = new if state is None else new.unionByName(_refined(state, level, few))
        state = durable(found.coalesce(1) if few else found)
        above = level
    return state.where("pos <> first").groupBy("pos").agg(
        F.max("len").alias("len"), F.max_by("first", "len").alias("first"))


def _refined(state: DataFrame, level: DataFrame, few: bool) -> DataFrame:
    """Split each interval of ``state`` by the rank of the next ``size`` lines behind its prefix."""
    ahead = level.select(F.col("pos").alias("at"), F.col("rank").alias("r"), "size")
    after = F.col("pos") + F.col("len")
    known = state.join(sorted_in(ahead), (after == F.col("at")) & (after <= F.col("last")), "left").drop("at")
    classes = _repeated(known.where("r IS NOT NULL").select("len", F.col("first").alias("prefix"), "r", "pos"), "len", "prefix", "r")
    classes = classes if few else _dealt(classes)
    joined = known.join(sorted_in(classes.select("len", F.col("prefix").alias("first"), "r", F.col("first").alias("start"))), ["len", "first", "r"], "left")

    def row(length: Column, first: Column) -> Column:
        return F.struct("pos", "last", length.alias("len"), first.alias("first"))

    old, new = row(F.col("len"), F.col("first")), row(F.col("len") + F.col("size"), F.col("start"))
    return joined.select(F.inline(
        F.when(F.col("start").isNull(), F.array(old))
        .when(F.col("start") == F.col("pos"), F.array(old, new)).otherwise(F.array(new))))


def later_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per document with deleted lines: its key and ``ranges``, sorted (start, stop) line numbers, stop excluded."""
    lines = positions(docs, doc_id, text)
    doubling = levels(lines)
    if not doubling:
        return lines.where("false").select(*KEY, F.array(F.struct(
            F.lit(0).alias("start"), F.lit(0).alias("stop"))).alias("ranges"))
    runs = longest_repeats(doubling)
    ends = lines.select(F.col("pos").alias("end"), F.col("upto").alias("total"))
    spans = runs.withColumn("end", F.col("pos") + F.col("len") - 1).join(sorted_in(ends), "end").select("pos", "end", "total")
    starts = lines.select(*KEY, "line", "pos", (F.col("upto") - F.col("w")).alias("before"))
    kept = durable(spans.join(sorted_in(starts), "pos").where(F.col("total") - F.col("before") >= min_words).select(
        *KEY, "line", (F.col("line") + F.col("end") - F.col("pos") + 1).alias("stop")))
    # Runs of a document overlap; where a run starts behind all ends so far, a new range begins.
    by_line = Window.partitionBy(*KEY).orderBy("line")
    opened = kept.withColumn("reach", F.max("stop").over(by_line.rowsBetween(Window.unboundedPreceding, -1)))
    opened = opened.withColumn("range", F.sum(
        F.when(F.col("reach") >= F.col("line"), 0).otherwise(1)).over(by_line))
    ranges = opened.groupBy(*KEY, "range").agg(
        F.min("line").cast("int").alias("start"), F.max("stop").cast("int").alias("stop"))
    return ranges.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("ranges"))


def _remaining(text: Column) -> Column:
    """The lines between the ranges, in one pass over slices."""
    lines = F.split(text, "\n")
    gaps = F.transform(
        F.concat(F.col("ranges"), F.array(F.struct(F.size(lines).alias("start"), F.size(lines).alias("stop")))),
        lambda r, k: F.slice(lines, F.when(k > 0, F.get("ranges", k - 1)["stop"]).otherwise(0) + 1, r["start"] - F.when(
            k > 0, F.get("ranges", k - 1)["stop"]).otherwise(0)))
    return F.flatten(gaps)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Each row as the struct ``row``, with its ``doc_id``, ``n_removed`` lines and the text ``left``."""
    rows, found = keyed(docs, doc_id, text), later_copies(docs, doc_id, text, min_words)
    joined = rows.join(found.hint("shuffle_hash"), same_content(rows, found), "left").select(
        "row", rows.doc_id, "ranges")
    given = F.col("row")[text]
    removed = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return joined.select(
        "row", "doc_id", F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("ranges").isNull(), given).otherwise(F.array_join(_remaining(given), "\n")).alias("left"))
