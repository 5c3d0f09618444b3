"""Mixing against a plain water-filling loop, and its SQL."""

import duckdb
import pytest

from companion.llm import mixing, queries


def plain_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0):
    """Clamp, deal the excess again, until no target is above its clamp."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done, left = {}, share * sum(sizes.values())
    open_ = set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] >= cap * sizes[s]]
        if not over:
            return done | {s: level * weight[s] for s in open_}
        for s in over:
            done[s] = cap * sizes[s]
            left -= done[s]
            open_.remove(s)
    return done


def check(df):
    rows = mixing.mix(df).collect()
    sizes = {}
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    want = plain_targets(sizes)
    got, biggest = {}, {}
    for r in rows:
        assert r.target == pytest.approx(want[r.source])
        assert r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        got[r.source] = got.get(r.source, 0) + r.taken
        biggest[r.source] = max(biggest.get(r.source, 0), r.size)
    assert len(rows) == df.count()
    for s, t in want.items():
        assert abs(got[s] - t) <= biggest[s] / 2 + 1e-6
    return rows


def test_whole_table(small):
    first = check(small("documents"))
    again = mixing.mix(small("documents").repartition(7)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_edge_cases(documents):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", "a"), (3, "one two", "a"),
            (4, "w " * 5000, "b"), (5, "x y z", None), (None, "x y", None), (6, " \t", "empty"),
            (7, "p q r s", "c"), (8, "p q r s", "c")]
    check(documents(rows))
    assert mixing.mix(documents([])).count() == 0
    assert {r.taken for r in mixing.mix(documents([(1, None), (2, "")])).collect()} == {0}


def test_equal_rows_are_dealt_singly(spark, documents):
    rows = [(1, "a b c d", "s")] * 100 + [(i, "x y", "s") for i in range(2, 12)]
    rows += [(50, "k l m", None)] * 40 + [(60, "p", "u")] * 30 + [(61, "p q r s t u", "u")] * 30
    rows += [(70, "", "u")] * 5 + [(None, None, "u")] * 5
    got = check(documents(rows).repartition(5))
    again = mixing.mix(documents(rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    copies = mixing.repeat_documents(documents(rows).repartition(3)).groupBy("doc_id").count().collect()
    want = {}
    for r in got:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.epochs
    assert {r.doc_id: r["count"] for r in copies} == {d: n for d, n in want.items() if n}
    con = duckdb.connect()
    con.register("documents", documents(rows).select("doc_id", "text", "source").toArrow())
    sql = con.execute("SELECT doc_id, size, source_size, taken FROM "
                      f"({queries.ORACLE_SQL['op10_source_mixing']})").fetchall()
    assert sorted(map(str, sql)) == sorted(
        str((r.doc_id, r.size, r.source_size, r.taken)) for r in got)


def test_one_row_repeated_in_one_source(documents):
    """The boundary lies inside the copies: the source still meets its target."""
    got = check(documents([(1, "a b c d", "s")] * 100 + [(i, "x", "s") for i in range(2, 12)]
                          + [(99, "z " * 300, "t")]).repartition(4))
    assert {r.epochs for r in got if r.doc_id == 1} in ({1, 2}, {1}, {2})


def test_everything_clamped(documents):
    rows = mixing.mix(documents([(1, "a b c", "s"), (2, "d e", "t")]), share=5.0).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(1, 6), (2, 4)}


def test_few_buckets_give_the_same_rows(small):
    sized = mixing.measured(small("documents")).cache()
    a = mixing.apply_plan(sized, mixing.taking_plan(sized)).collect()
    b = mixing.apply_plan(sized, mixing.taking_plan(sized, buckets=4), buckets=4).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_repeated_documents_follow_the_mix(small, documents):
    docs = small("documents")
    out = mixing.repeat_documents(docs)
    assert out.columns == [*docs.columns, "copy"]
    copies = {r.doc_id: r["n"] for r in out.groupBy("doc_id").count().withColumnRenamed(
        "count", "n").collect()}
    want = {r.doc_id: r.epochs for r in mixing.mix(docs).collect()}
    assert copies == {d: n for d, n in want.items() if n}
    clash = documents([(1, "a b c", "s"), (2, "d e", "t")])
    assert mixing.repeat_documents(clash).columns == [*clash.columns, "copy"]


@pytest.mark.parametrize("name", ["op7_decontamination", "op10_source_mixing"])
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM "
                    f"read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    got = queries.REGISTRY[name](spark, "/root/testdata/sf0.01")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
