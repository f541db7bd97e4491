"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes that separate words where a contract says ``[^\\x20\\x09-\\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="statweave-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage there.

    Later readers survive lost executors, since the files are on shared storage.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: Column) -> Column:
    """Number of words (maximal runs without ASCII white space); NULL counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def content_key(text: Column) -> list[Column]:
    """128 bits of the text, as two columns: with ``doc_id`` they identify a row's content."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def same_content(left: DataFrame, right: DataFrame) -> Column:
    """NULL-safe match of ``doc_id``, ``h1`` and ``h2``."""
    return left.doc_id.eqNullSafe(right.doc_id) & (left.h1 == right.h1) & (left.h2 == right.h2)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Each row as the struct ``row``, out of the way of any column name, beside its key."""
    return docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), *content_key(F.col(text)))


def without(docs: DataFrame, gone: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` without the contents listed in ``gone``; the hash is built on that narrow side."""
    rows, gone = keyed(docs, doc_id, text), gone.select("doc_id", "h1", "h2").distinct()
    return rows.join(gone.hint("shuffle_hash"), same_content(rows, gone), "left_anti").select("row.*")
