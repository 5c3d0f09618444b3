"""PL1: raw review and metadata records -> relation, base and companion ratings."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from companion import schemas
from companion.operators.relation import companion_relation, flag_companions, rating_tables
from companion.operators.reshape import flatten_metadata, project_reviews, table_shape
from companion.session import materialize
from companion.sources.records import record_counts, require_clean, split_records
from companion.sources.tables import read_csv_table, write_csv_table


def preprocess(reviews_raw: DataFrame, meta_raw: DataFrame) -> dict[str, DataFrame]:
    """The three tables both models read, as lazy DataFrames."""
    reviews = project_reviews(reviews_raw)
    rel = companion_relation(flatten_metadata(meta_raw))
    return {"relation": rel, **rating_tables(flag_companions(reviews, rel))}


def preprocess_files(spark: SparkSession, reviews_path: str, meta_path: str,
                     out_dir: str, strict: bool = True) -> dict[str, str]:
    """Read record files, write ``relation``, ``base`` and ``comp`` CSV
    directories and a ``report`` (file, n_records, n_corrupt) under ``out_dir``;
    returns their paths.

    A line that cannot be parsed stops the run; without ``strict`` it is left out and
    counted in the report.  Each raw file is read and parsed once: metadata into a table,
    reviews into one partitioned by what becomes of a line (a broken one, a rating of a
    companion or of another item), which both rating files are read from."""
    paths = {name: os.path.join(out_dir, name) for name in CSV_SCHEMAS}
    meta = materialize(split_records(spark, meta_path, schemas.METADATA), "preprocess-metadata")
    if strict:
        require_clean(meta, meta_path)
    rel = materialize(companion_relation(flatten_metadata(
        meta.where(F.col("_corrupt").isNull()).drop("_corrupt"))), "preprocess-relation")
    lines = split_records(spark, reviews_path, schemas.REVIEW).select(
        *schemas.REVIEW.fieldNames(), "_corrupt", F.col("_corrupt").isNotNull().alias("broken"))
    rated = materialize(flag_companions(lines, rel), "preprocess-reviews", ("broken", "is_comp"))
    if strict:
        require_clean(rated, reviews_path)
    report = [record_counts(t).select(F.lit(name).alias("file"), "*")
              for name, t in (("metadata", meta), ("reviews", rated))]
    write_csv_table(report[0].unionByName(report[1]), paths["report"])
    write_csv_table(rel, paths["relation"])
    for name, table in rating_tables(rated.where(~F.col("broken"))).items():
        write_csv_table(table, paths[name])
    return paths


CSV_SCHEMAS = {"relation": schemas.RELATION, "base": schemas.BASE_RATINGS,
               "comp": schemas.COMP_RATINGS, "report": schemas.RECORD_REPORT}


def read_outputs(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Typed reads of the CSV outputs of ``preprocess_files``."""
    return {name: read_csv_table(spark, path, CSV_SCHEMAS[name])
            for name, path in paths.items()}


def shapes(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, n_rows, n_cols`` for each named table (one row each)."""
    rows = [table_shape(df).select(F.lit(name).alias("table"), "n_rows", "n_cols")
            for name, df in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
