"""Near-duplicate detection by SimHash and covering bit masks.

Every text becomes a 64-bit fingerprint. Two fingerprints are linked when they differ in
at most two bits; the classes are the connected components of those links.

*Candidates.* Bit i gets a non-zero vector m(i) of three bits; the table of a non-zero
vector v keeps the bits with odd <m(i), v>. Any two bits leave a v that is orthogonal to
both vectors, so that a pair within the radius agrees on all kept bits of that table: the
seven tables miss no pair. A fingerprint alone in its bucket in all tables has no link.

*Links.* Two fingerprints are within two bits exactly when some value is within one bit
of both. Each candidate is therefore dealt to itself and its 64 one-bit neighbours; who
meets at a value is linked. At most 65 different fingerprints can meet at one, however
large a bucket is, so that neither pairs within a bucket nor a limit on it are needed.

Equal fingerprints are folded before all this: thousands of copies are one node.

Defined cases: a NULL or empty text, or one of white space only, has fingerprint 0 and is
linked like any other; a NULL ``doc_id`` keeps its row and never names a component unless
the whole component has none (then ``component_id`` is NULL); repeated rows stay repeated;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from statweave.llm.common import content_key, durable, keyed, same_content, without

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Shingles hashed at a time: bounds the memory that a very long text takes.
CHUNK = 255 * 256

#: Byte value -> its eight bits, one in each byte of a 64-bit lane word.
_LANES = np.packbits(
    np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")[:, :, None]
    * np.array([1] + [0] * 7, np.uint8), axis=2, bitorder="little",
).reshape(256, 8).view(np.uint64).ravel()


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, lowest bit first."""
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    # A byte lane holds counts up to 255, so that many rows are added at a time.
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of a UTF-8 text, as an unsigned number."""
    found = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six white-space bytes
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    stops = stops[min(shingle, len(found)) - 1:]
    total = len(stops)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, CHUNK):
        spans = zip(starts[at:at + CHUNK].tolist(), stops[at:at + CHUNK].tolist(), strict=False)
        ones += bit_counts(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64))
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    raw = texts.cast(pa.large_binary())
    found = np.fromiter((fingerprint(x.as_py()) for x in raw), np.uint64, len(raw))
    return pa.array(found.view(np.int64))


def covering_masks(bits: int = 64, radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks; any ``radius`` bits are all outside at least one of them."""
    vectors = 2 ** (radius + 1) - 1
    return [
        sum(1 << i for i in range(bits) if (((i % vectors) + 1) & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def candidates(fingerprints: DataFrame) -> DataFrame:
    """Distinct fingerprints (column ``fp``) that share a bucket of some table with another."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for t, m in enumerate(covering_masks())])
    dealt = fingerprints.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    shared = dealt.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    # Dealt out otherwise once more: the join then deals both sides anew, and Spark can split a large bucket.
    shared = shared.repartition("lo").select("t", "key")
    return dealt.join(shared, ["t", "key"], "left_semi").select("fp").distinct()


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges (a < b) that connect all fingerprints within two bits of each other."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64)])
    near = candidates(fingerprints).select(
        "fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("at"))
    met = near.groupBy("at").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    return met.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge: alternating large and small stars.

    Each step is a combined minimum per node and a join, so that a hub is never gathered. The
    minima are dealt out otherwise in between, so that Spark can split a hub in the join.
    """
    edges = durable(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")))
    mark = None
    while True:
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).repartition(F.col("u") + 1)
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m")).repartition(F.col("hi") + 1)
        small = large.join(least, "hi").select("m", F.explode(F.array("lo", "hi")).alias("hi"))
        edges = durable(small.where("m <> hi").select(F.col("m").alias("lo"), "hi").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        mark = now


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), _fingerprints(F.col(text)).alias("fp"))


def rooted(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, roots included."""
    found = components(edges)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def classes(fps: DataFrame) -> DataFrame:
    """(fp, component_id) of every fingerprint that is linked to another or held by several rows."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    roots = rooted(links(nodes.select("fp")))
    joined = nodes.join(roots, nodes.fp == roots.node, "left")
    multi = joined.where("root IS NOT NULL OR copies > 1").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = multi.groupBy("root").agg(F.min("least").alias("component_id"))
    return multi.join(ids, "root").select("fp", "component_id")


def hexed(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` and ``component_id``."""
    fps = durable(fingerprints(docs, doc_id, text))
    known = classes(fps).withColumnRenamed("fp", "of")
    out = fps.join(known, fps.fp == known.of, "left")
    return out.select(
        "doc_id", hexed("fp").alias("fingerprint"),
        F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each class, with all columns: one with the smallest ``doc_id``.

    A NULL ``doc_id`` stays only where the class has no other; of rows that repeat the smallest
    ``doc_id``, or of a class without any, one stays.
    """
    key = [F.col(doc_id).alias("doc_id"), *content_key(F.col(text))]
    fps = durable(docs.select(*key, _fingerprints(F.col(text)).alias("fp")))
    roots = rooted(links(fps.select("fp").distinct()))
    # One row for each content, with its number of rows.
    contents = fps.groupBy("doc_id", "h1", "h2").agg(F.first("fp").alias("fp"), F.count(F.lit(1)).alias("copies"))
    placed = durable(contents.join(roots, contents.fp == roots.node, "left").select(
        "doc_id", "h1", "h2", "copies", F.coalesce("root", "fp").alias("root")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    # Dealt out otherwise once more, so that Spark can split a large class in the join.
    kept = placed.groupBy("root").agg(F.min(order).alias("k"), F.count(F.lit(1)).alias("size")).where("size > 1").select(
        F.col("root").alias("of"), "k").repartition("k")
    is_kept = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("h1") == F.col("k.h1")) & (F.col("h2") == F.col("k.h2"))
    other = placed.join(kept, placed.root == kept.of).where(~is_kept).select("doc_id", "h1", "h2")
    # A kept content that is in several rows goes too, and comes back as one row.
    several = placed.where("copies > 1").select("doc_id", "h1", "h2")
    if several.isEmpty():
        return without(docs, other, doc_id, text)
    other = durable(other)
    again = several.join(other, same_content(several, other), "left_anti")
    rows = keyed(docs, doc_id, text)
    once = rows.join(again.hint("shuffle_hash"), same_content(rows, again), "left_semi").groupBy("doc_id", "h1", "h2").agg(
        F.min_by("row", F.xxhash64("row")).alias("row"))
    return without(docs, other.unionByName(several), doc_id, text).unionByName(once.select("row.*"))
