"""Reading and writing tables: delimited text, inline rows, preview."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from statweave.functions.columns import clean, columns_of_kind, quoted
from statweave.operators.clean import promote_dates

SEPARATORS = (",", ";", "\t", "|")
QUOTED = re.compile(r'"(?:[^"]|"")*"')


def detect_separator(spark: SparkSession, path: str, encoding: str = "utf-8", lines: int = 20) -> str:
    """The separator that occurs equally often, and most often, in the first lines, quoted fields aside."""
    read = spark.read.option("encoding", encoding).text(path).limit(lines).collect()
    head = [QUOTED.sub("", r[0]) for r in read if r[0]]
    best, best_count = ",", 0
    for sep in SEPARATORS:
        counts = {line.count(sep) for line in head}
        if len(counts) == 1 and (n := counts.pop()) > best_count:
            best, best_count = sep, n
    return best


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str = "utf-8",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Delimited text with a header; a quote within quotes is doubled. Give ``schema`` on large inputs: inference reads the file twice.

    Beside the UTF encodings, ISO-8859-1 and US-ASCII, Spark reads the JVM's character sets (as ``windows-1251``)
    only where ``spark.sql.legacy.javaCharsets`` is ``true``; else it refuses them.
    """
    reader = (
        spark.read.option("header", True)
        .option("sep", sep or detect_separator(spark, path, encoding))
        .option("encoding", encoding).option("escape", "\"").option("mode", "FAILFAST")
    )
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return check_table(df)


def load_table(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str = "utf-8",
    schema: T.StructType | str | None = None, dates: bool = True,
) -> DataFrame:
    """A table in one step: read (parquet by its name, else delimited text), check it, turn text dates into timestamps."""
    if path.rstrip("/").endswith(".parquet"):
        df = check_table(spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path))
    else:
        df = read_delimited(spark, path, sep, encoding, schema)
    return promote_dates(df) if dates else df


def check_table(df: DataFrame) -> DataFrame:
    """Reject a table without a numeric column or without rows."""
    if not columns_of_kind(df, "numeric"):
        raise ValueError("the table has no numeric column")
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df


def from_rows(spark: SparkSession, rows: Sequence[dict], schema: T.StructType | str | None = None) -> DataFrame:
    return spark.createDataFrame(rows, schema) if schema else spark.createDataFrame(rows)


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).option("escape", "\"").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    """The first rows, dates as text, NaN as NULL."""
    dates = set(columns_of_kind(df, "datetime"))
    return df.limit(rows).select(*[
        F.date_format(quoted(c), "yyyy-MM-dd HH:mm:ss").alias(c) if c in dates else clean(df, c).alias(c)
        for c in df.columns
    ])
