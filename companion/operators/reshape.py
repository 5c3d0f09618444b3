"""Projections, renames, null handling and shape probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from companion.schemas import REST


def project_reviews(df: DataFrame) -> DataFrame:
    """Keep the three review fields the pipelines use."""
    return df.select("reviewerID", "asin", "overall")


def flatten_metadata(df: DataFrame, nested: str = "related") -> DataFrame:
    """Lift every field of the nested struct to a top-level column; one whose name is taken
    carries the struct's name before its own (``related_rest`` beside ``rest``).

    Rows whose struct is null keep null in each lifted field."""
    inner = df.schema[nested].dataType.fieldNames()
    rest = [c for c in df.columns if c != nested]
    return df.select(*rest, *[F.col(f"{nested}.{f}").alias(f"{nested}_{f}" if f in rest else f)
                              for f in inner])


def lift_keys(df: DataFrame, keys: dict[str, str], column: str = REST) -> DataFrame:
    """Typed columns (``name: type``) from the objects of a VARIANT column, which stays.
    A missing key and a value that the type cannot hold give null."""
    return df.select("*", *[
        F.try_variant_get(F.col(column), f"$['{name}']", kind).alias(name)
        for name, kind in keys.items()])


def as_base_ratings(df: DataFrame) -> DataFrame:
    """Adapter: review-shaped rows -> ``reviewerID, productID, prodRating``."""
    return df.select("reviewerID", F.col("asin").alias("productID"),
                     F.col("overall").cast("double").alias("prodRating"))


def as_comp_ratings(df: DataFrame) -> DataFrame:
    """Adapter: review-shaped rows -> ``reviewerID, compProd, compRating``."""
    return df.select("reviewerID", F.col("asin").alias("compProd"),
                     F.col("overall").cast("double").alias("compRating"))


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows holding a null (or NaN) in any of ``subset`` (default all)."""
    return df.na.drop(how="any", subset=subset)


def fill_missing(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    """Replace nulls in the given numeric columns."""
    return df.na.fill(value, subset=columns)


def rating_as_int(col: str) -> F.Column:
    """Ratings travel as double; the factorisation wants whole numbers.

    Casting through double truncates like the reference's ``int``."""
    return F.col(col).cast("double").cast("int")


def pack_ratings(df: DataFrame, item: str, rating: str, name: str) -> DataFrame:
    """Pack ``(item, rating)`` into one struct column ``name``."""
    return df.withColumn(name, F.struct(F.col(item), F.col(rating)))


def table_shape(df: DataFrame) -> DataFrame:
    """One row ``n_rows, n_cols``: a distributed count, nothing collected."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("long"))
