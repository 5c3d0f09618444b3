"""Explicit schemas of the tables the pipelines exchange (no inference)."""

from pyspark.sql import types as T

# raw review record: only the three used fields are kept
REVIEW = T.StructType([
    T.StructField("reviewerID", T.StringType()),
    T.StructField("asin", T.StringType()),
    T.StructField("overall", T.DoubleType()),
])

# raw metadata record: nested "related" holding the also-bought list
METADATA = T.StructType([
    T.StructField("asin", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("related", T.StructType([
        T.StructField("also_bought", T.ArrayType(T.StringType())),
    ])),
])

# the VARIANT field that keeps the keys of its level that no other field names
REST = "rest"

# the same record with every other key of the record and of "related" (further lists)
OPEN_METADATA = T.StructType([
    T.StructField("asin", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("related", T.StructType([
        T.StructField("also_bought", T.ArrayType(T.StringType())),
        T.StructField(REST, T.VariantType()),
    ])),
    T.StructField(REST, T.VariantType()),
])

# base -> companion relation; compProd is null for items without a list
RELATION = T.StructType([
    T.StructField("asin", T.StringType()),
    T.StructField("compProd", T.StringType()),
])

BASE_RATINGS = T.StructType([
    T.StructField("reviewerID", T.StringType()),
    T.StructField("productID", T.StringType()),
    T.StructField("prodRating", T.DoubleType()),
])

COMP_RATINGS = T.StructType([
    T.StructField("reviewerID", T.StringType()),
    T.StructField("compProd", T.StringType()),
    T.StructField("compRating", T.DoubleType()),
])

# lines read and lines that could not be parsed, per record file
RECORD_REPORT = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("n_records", T.LongType()),
    T.StructField("n_corrupt", T.LongType()),
])
