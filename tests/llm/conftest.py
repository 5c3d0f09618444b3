import pytest

SF_TINY = "/root/testdata/sf0.001"
SF_SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def tiny(spark):
    return lambda name: spark.read.parquet(f"{SF_TINY}/{name}.parquet")


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SF_SMALL}/{name}.parquet")


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with columns whose
    names operators use inside."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in ("fp", "score", "spans", "size", "found", "u", "probability", "prediction",
                     "target", "rank", "host", "value"):
            df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return make
