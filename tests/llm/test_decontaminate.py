"""Decontamination against a brute-force search of word windows."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from companion.llm import decontaminate as dec
from companion.llm.fm_index import FMIndex

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return TOKEN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    sizes = sorted({len(k) for k in windows})
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                owners = windows.get(tuple(w[i:i + size]))
                if owners:
                    hit[i:i + size] = [True] * size
                    found |= {o for o in owners if o is not None}
        ids = sorted(str(i) for i in found)
        n = sum(hit)
        out.append((doc_id, len(w), n, len(ids),
                    hashlib.sha256(",".join(ids).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                   for r in df.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_whole_table_matches_brute_force(small, block_bytes):
    docs, bench = small("documents"), small("benchmark")
    want = plain([(r.doc_id, r.text) for r in docs.collect()],
                 [(r.item_id, r.text) for r in bench.collect()])
    assert rows(dec.decontaminate(docs, bench, block_bytes)) == want
    assert any(w[5] for w in want)


def test_edge_cases(spark, documents):
    long_ = " ".join(f"w{i}" for i in range(30))
    items = [(1, long_), (2, "Short Item"), (3, None), (4, "..."), (None, "nameless words here"),
             (2, "again under two"), (7, long_)]
    docs = [(1, None), (2, ""), (3, "short, ITEM!"), (4, "x " * 9 + long_[:60]),
            (5, "a " + long_ + " b " + long_), (5, "a " + long_ + " b " + long_), (None, long_),
            (6, "nameless words here"), (8, "short item " * 20000), (9, "again under two é short item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert rows(dec.decontaminate(documents(docs), bench)) == want
    assert rows(dec.decontaminate(documents(docs), bench, block_bytes=40)) == want
    assert rows(dec.decontaminate(documents(docs), bench.limit(0))) == plain(docs, [])
    assert dec.decontaminate(documents([]), bench).count() == 0


def test_spans_are_merged_words(spark, documents):
    bench = spark.createDataFrame([("q", "b c d"), ("r", "d e")], "item_id string, text string")
    row = dec.decontaminate(documents([(1, "a b c d e f d e")]), bench).first()
    assert [tuple(s) for s in row.spans] == [(1, 5), (6, 8)]


def test_only_contaminated_documents_are_dropped(spark, documents):
    passage = " ".join(f"w{i}" for i in range(13))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = documents([(1, passage), (2, passage + " x" * 300), (3, "clean"), (4, None),
                      (5, passage + " x" * 247), (6, passage + " x" * 248)])
    kept = dec.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=25), min_size=1, max_size=6),
       st.lists(st.lists(st.integers(1, 4), min_size=2, max_size=2), min_size=1, max_size=5))
def test_index_finds_every_occurrence(runs, phrases):
    symbols = np.array([x for run in runs for x in (*run, 0)], dtype=np.int32)
    index = FMIndex(symbols, 5, sample_every=3)
    low, high = index.search(np.array(phrases, dtype=np.int32))
    for phrase, a, b in zip(phrases, low, high):
        want = [i for i in range(len(symbols) - 1) if symbols[i:i + 2].tolist() == phrase]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_repeated_runs_are_ordered():
    rng = random.Random(0)
    run = [rng.randrange(1, 9) for _ in range(400)]
    symbols = np.array((run + [0]) * 50, dtype=np.int32)
    index = FMIndex(symbols, 9)
    low, high = index.search(np.array([run[100:113]], dtype=np.int32))
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == [
        100 + 401 * i for i in range(50)]
