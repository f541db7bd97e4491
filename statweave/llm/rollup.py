"""Token totals kept up by signed deltas.

Counts of documents are never added up again: each batch of changes (inserts, deletes, revised
counts) is turned into signed rows, plus what is new and minus what was, and summed by source,
language and tokenizer version. These deltas are additive, so that totals are the sum of what is
committed, in any order.

*Commits.* A batch has an id and one folder below ``root``. Spark's committer writes ``_SUCCESS``
there after all its files; a batch counts from that moment on. A batch that is sent again is
found committed and left alone; a folder without the mark, from a lost driver, is written anew.
``compact`` folds committed batches into a snapshot, a folder that names them, under the same
rule; readers take the newest snapshot and the batches that it does not name.

All folders are reached through Hadoop's file system, so that ``root`` may be any shared store.
One batch may be written by one writer at a time.

Defined cases: NULL source, language or version form groups of their own; NULL texts have no
tokens; an unknown ``op`` raises an error; repeated rows of a batch count each; an empty batch
is committed and changes nothing; groups whose totals are all zero are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

GROUP = ("source", "lang", "version")
MEASURES = ("docs", "chars", "tokens")
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenizer pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_count(spark: SparkSession, path: str = TOKENIZER, pattern: str = PATTERN):
    """A function from a text column to its number of tokens; the vocabulary file travels by broadcast."""
    with open(path, "rb") as file:  # on the driver: under 1 MB
        ranks = spark.sparkContext.broadcast(file.read())

    @F.arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _encoding(ranks.value, pattern).encode_ordinary
        for texts in batches:
            yield pa.array([len(encode(x.as_py())) if x.is_valid else 0 for x in texts], pa.int64())

    return count


def change(op: str, before: Column | None = None, after: Column | None = None) -> list[Column]:
    """The columns of a change: ``op`` and the structs ``before`` and ``after`` (group and measures)."""
    kind = ",".join([*[f"{g}:string" for g in GROUP], *[f"{m}:bigint" for m in MEASURES]])
    none = F.lit(None).cast(f"struct<{kind}>")
    return [F.lit(op).alias("op"), (none if before is None else before).alias("before"), (none if after is None else after).alias("after")]


def counted(source: Column, lang: Column, version: str, chars: Column, tokens: Column) -> Column:
    return F.struct(
        source.cast("string").alias("source"), lang.cast("string").alias("lang"), F.lit(version).alias("version"),
        F.lit(1).cast("long").alias("docs"), F.coalesce(chars, F.lit(0)).cast("long").alias("chars"),
        F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def signed(changes: DataFrame) -> DataFrame:
    """Additive deltas per group."""
    known = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(
        F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(F.col("op"), F.lit("NULL")))))
    sides = F.array(F.struct(F.lit(-1).alias("sign"), F.when(known != "insert", F.col("before")).alias("of")),
                    F.struct(F.lit(1).alias("sign"), F.when(known != "delete", F.col("after")).alias("of")))
    rows = changes.select(F.explode(sides).alias("x")).where("x.of IS NOT NULL")
    return rows.groupBy(*[F.col(f"x.of.{g}").alias(g) for g in GROUP]).agg(
        *[F.sum(F.col("x.sign") * F.col(f"x.of.{m}")).alias(m) for m in MEASURES])


class Rollup:
    """Totals below one folder of a shared store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, kind: str) -> list[str]:
        """Committed folders of a kind."""
        base = self._path(kind)
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(base)]
        return sorted(n for n in names if fs.exists(self._path(f"{kind}/{n}/_SUCCESS")))

    def batches(self) -> list[str]:
        return self._names("batches")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch once; False if it was there already."""
        if not batch or "/" in batch or batch[0] in "._":
            raise ValueError(f"not a batch id: {batch!r}")
        if batch in self.batches() or batch in self._folded():
            return False
        signed(changes).write.mode("overwrite").option(
            "mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.root}/batches/{batch}")
        return True

    def _folded(self) -> set[str]:
        newest = self._names("snapshots")[-1:]
        return {r["batch"] for n in newest for r in self.spark.read.parquet(f"{self.root}/snapshots/{n}").where(
            "batch IS NOT NULL").select("batch").collect()}

    def deltas(self) -> DataFrame:
        """The newest snapshot and the batches after it."""
        schema = ", ".join([*[f"{g} string" for g in GROUP], *[f"{m} bigint" for m in MEASURES]])
        newest = self._names("snapshots")[-1:]
        folded = self._folded()
        paths = [f"{self.root}/batches/{b}" for b in self.batches() if b not in folded]
        out = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        for n in newest:
            out = out.unionByName(self.spark.read.parquet(f"{self.root}/snapshots/{n}").where("batch IS NULL").drop("batch"))
        return out

    def totals(self) -> DataFrame:
        sums = self.deltas().groupBy(*GROUP).agg(*[F.sum(m).alias(m) for m in MEASURES])
        return sums.where(" OR ".join(f"{m} <> 0" for m in MEASURES))

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot; rows that name a batch carry no totals."""
        known = sorted(self._folded() | set(self.batches()))
        if not known:
            return
        number = int((self._names("snapshots") or ["0"])[-1]) + 1
        names = self.spark.createDataFrame([(b,) for b in known], "batch string")
        rows = self.totals().withColumn("batch", F.lit(None).cast("string")).unionByName(names, allowMissingColumns=True)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/snapshots/{number:09d}")
