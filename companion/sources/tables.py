"""CSV tables with a header (S2-S6) and the shape probe.

Reads always take an explicit schema: the reference reads every column as
a string and later compares and casts those strings, which Spark's ANSI
mode rejects.  Writes produce a directory of part files, as Spark does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed read of a header CSV directory or file; empty fields are null."""
    return spark.read.schema(schema).option("header", "true").option(
        "mode", "FAILFAST").csv(path)


def write_csv_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header CSV directory; null fields are written empty."""
    df.write.mode(mode).option("header", "true").csv(path)
