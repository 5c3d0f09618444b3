import ast
import gzip
import os

import pytest
from pyspark.sql import functions as F

from companion import schemas
from companion.operators.relation import list_relations
from companion.operators.reshape import flatten_metadata, lift_keys
from companion.sources import records as REC
from companion.sources.records import (corrupt_records, key_counts, read_records, record_counts,
                                       split_records, to_literal_lines, write_records)
from companion.sources.tables import read_csv_table, write_csv_table
from companion.session import scratch_path

LINES = [
    "{'reviewerID': 'A1', 'asin': 'p1', 'reviewerName': 'J. O\\'Neil', 'helpful': [0, 0], "
    "'overall': 5.0, 'summary': \"it's fine\"}",
    "{'reviewerID': 'A2', 'asin': 'p2', 'overall': 3.0, 'verified': True, 'style': None}",
    "{'reviewerID': 'A3', 'asin': 'p3', 'overall': None}",
    "{'reviewerID': 'A4', 'asin': 'p4', 'overall': 4.0",          # broken line
    "",
]


def test_reads_python_literal_lines_without_eval(spark, tmp_path):
    path = os.path.join(tmp_path, "reviews.json.gz")
    with gzip.open(path, "wt") as fh:
        fh.write("\n".join(LINES) + "\n")
    got = sorted(tuple(r) for r in read_records(spark, path, schemas.REVIEW, strict=False).collect())
    assert got == [("A1", "p1", 5.0), ("A2", "p2", 3.0), ("A3", "p3", None)]
    bad = [r.line for r in corrupt_records(spark, path, schemas.REVIEW).collect()]
    assert bad == [LINES[3]]
    counts = record_counts(split_records(spark, path, schemas.REVIEW)).first()
    assert (counts.n_records, counts.n_corrupt) == (3, 1)
    with pytest.raises(ValueError, match="1 lines"):
        read_records(spark, path, schemas.REVIEW)


TITLES = ["Yes, None, True, ok", "Bob's \"mug\"", "back\\slash \\' end\\", "null, [None], {True}", "tab\there",
          "", None, "é 'x': None,", "None", "\\x41 stays", "new\nline"]


def test_text_survives_a_roundtrip(spark):
    rows = [(str(i), t, 1.0, None) for i, t in enumerate(TITLES)]
    path = scratch_path(spark, "titles-test")
    write_records(spark.createDataFrame(rows, schemas.METADATA), path)
    for line in spark.read.text(path).collect():
        ast.literal_eval(line.value)                       # every line is a Python literal
    back = {r.asin: r.title for r in read_records(spark, path, schemas.METADATA).collect()}
    assert back == {str(i): t for i, t in enumerate(TITLES)}


def test_lines_as_python_writes_them(spark, tmp_path):
    rows = [{"asin": str(i), "title": t, "price": None if i % 2 else 1.5} for i, t in enumerate(TITLES)]
    path = os.path.join(tmp_path, "meta.json")
    with open(path, "w", encoding="utf-8") as fh:
        fh.writelines(repr(r) + "\n" for r in rows)
    back = {r.asin: (r.title, r.price) for r in read_records(spark, path, schemas.METADATA).collect()}
    assert back == {r["asin"]: (r["title"], r["price"]) for r in rows}


def test_nested_metadata_roundtrip(spark):
    rows = [("b1", "anvil", 3.5, (["c1", "c2"],)), ("b2", "bolt", 1.0, None)]
    df = spark.createDataFrame(rows, schemas.METADATA)
    path = scratch_path(spark, "meta-test")
    write_records(df, path)
    text = spark.read.text(path).collect()
    assert any("'related':None" in r.value for r in text)
    back = sorted((tuple(r) for r in read_records(spark, path, schemas.METADATA).collect()),
                  key=str)
    assert back == sorted((tuple(r) for r in df.collect()), key=str)


def test_csv_roundtrip_is_typed(spark):
    df = spark.createDataFrame([("u", "c", 4.0), ("v", None, None)], schemas.COMP_RATINGS)
    path = scratch_path(spark, "csv-test")
    write_csv_table(df, path)
    back = read_csv_table(spark, path, schemas.COMP_RATINGS)
    assert dict(back.dtypes)["compRating"] == "double"
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


OPEN_LINES = [
    "{'asin': 'a', 'title': 'x', 'related': {'also_bought': ['p'], 'also_viewed': ['q', 'r']}, "
    "'salesRank': {'Toys': 3}, 'verified': True, 'note': None}",
    "{'asin': 'b', 'related': None, 'price': 1.5}",
    "{'asin': 'c', 'related': {}, 'brand': 'it\\'s \"big\"', 'brand': \"None, it's\"}",
    "{'asin': 'd', 'deep': {'k': 1, 'k': 2}}",       # VARIANT cannot hold it
    "{'asin': 'e', 'related': {'also_viewed': 7}}",
]


def _as_python(row):
    related = row.related and (row.related.also_bought, row.related.rest and row.related.rest.toPython())
    return row.title, row.price, related, row.rest and row.rest.toPython()


def test_keys_outside_the_schema_survive_read_write_and_parquet(spark, tmp_path):
    path = os.path.join(tmp_path, "meta.json.gz")
    with gzip.open(path, "wt") as fh:
        fh.write("\n".join(OPEN_LINES) + "\n")
    want = {
        "a": ("x", None, (["p"], {"also_viewed": ["q", "r"]}),
              {"salesRank": {"Toys": 3}, "verified": True, "note": None}),
        "b": (None, 1.5, None, None),
        "c": (None, None, (None, None), {"brand": "None, it's"}),
        "e": (None, None, (None, {"also_viewed": 7}), None)}
    first = read_records(spark, path, schemas.OPEN_METADATA, strict=False)
    assert {r.asin: _as_python(r) for r in first.collect()} == want
    assert [r.line for r in corrupt_records(spark, path, schemas.OPEN_METADATA).collect()] == [OPEN_LINES[3]]
    stored, again = scratch_path(spark, "open-stored"), scratch_path(spark, "open-again")
    first.write.parquet(stored)
    write_records(spark.read.parquet(stored), again)
    for line in spark.read.text(again).collect():
        ast.literal_eval(line.value)
    assert {r.asin: _as_python(r) for r in
            read_records(spark, again, schemas.OPEN_METADATA).collect()} == want
    counts = {r.key: r.n_records for r in key_counts(first).collect()}
    assert counts == {"salesRank": 1, "verified": 1, "note": 1, "brand": 1}
    flat = flatten_metadata(first)
    assert flat.columns == ["asin", "title", "price", "rest", "also_bought", "related_rest"]
    lifted = {r.asin: (r.brand, r.verified) for r in lift_keys(
        flat, {"brand": "string", "verified": "boolean"}).collect()}
    assert lifted == {"a": (None, True), "b": (None, None), "c": ("None, it's", None), "e": (None, None)}
    # a value that is no list has no rows; neither has an item without lists
    assert sorted(map(tuple, list_relations(flat).collect())) == [
        ("also_bought", "a", "p"), ("also_viewed", "a", "q"), ("also_viewed", "a", "r")]


def test_named_fields_win_over_equal_keys_of_rest(spark):
    df = spark.sql("""SELECT 'a' AS asin, 't' AS title, 1D AS price,
        named_struct('also_bought', array('p'), 'rest', parse_json('{"also_bought": 1, "z": []}')) AS related,
        parse_json('{"title": "other", "y": "it\\'s"}') AS rest""")
    assert [ast.literal_eval(r.value) for r in to_literal_lines(df).collect()] == [
        {"asin": "a", "title": "t", "price": 1.0, "related": {"also_bought": ["p"], "z": []}, "y": "it's"}]


def test_open_schema_on_an_empty_file(spark, tmp_path):
    path = os.path.join(tmp_path, "empty.json")
    open(path, "w").close()
    back = read_records(spark, path, schemas.OPEN_METADATA)
    assert back.schema == schemas.OPEN_METADATA and back.count() == 0


def test_one_file_is_parsed_by_all_cores(spark, tmp_path):
    """A gzip file is one read task, and its lines are few bytes: all cores parse them."""
    path = str(tmp_path / "one")
    rows = spark.range(400).selectExpr("string(id) AS reviewerID", "'i' AS asin", "1.0D AS overall")
    REC.write_records(rows.coalesce(1), path)
    cores = spark.sparkContext.defaultParallelism
    parsed = REC.split_records(spark, path, schemas.REVIEW)
    sizes = [n for n in parsed.select("asin").rdd.glom().map(len).collect() if n]
    assert len(sizes) >= cores and sum(sizes) == 400
    assert REC.spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() >= cores
    many = spark.range(0, 10, 1, cores)
    assert REC.spread(many) is many


def test_a_line_is_parsed_once_for_its_keys(spark):
    """Inside the filter of repeated keys the parsed map is a variable, not a parser."""
    line = spark.createDataFrame([("{'a': 1, 'b': 2, 'a': 3}",)], "value string")
    whole = REC._last_values(F.from_json("value", REC.OBJECT, REC._PARSE_OPTIONS)).alias("w")
    assert line.select(F.to_json(whole)).first()[0] == '{"b":2,"a":3}'
    assert line.select(whole)._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
