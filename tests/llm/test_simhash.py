"""SimHash against a brute-force version: all pairs, bit counts, union of links."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from companion.llm import simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = ([" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
                if len(words) >= 3 else [" ".join(words)])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, max_bits=3):
    parent = list(range(len(ids)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    values = np.array(prints, dtype=np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= max_bits):
            parent[top(i)] = top(i + 1 + int(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(ids))]


def check(df, **options):
    rows = df.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], [f"{p:016x}" for p in prints],
                      plain_components([r.doc_id for r in rows], prints)),
                  key=lambda t: tuple((x is None, x) for x in t))
    got = [(r.doc_id, r.fingerprint, r.component_id)
           for r in simhash.near_duplicates(df, **options).collect()]
    assert sorted(got, key=lambda t: tuple((x is None, x) for x in t)) == want
    return want


def test_whole_table_matches_brute_force(small):
    want = check(small("documents"))
    assert any(d != c for d, _, c in want)


def test_small_blocks_match_brute_force(small):
    check(small("documents"), block=16)


def test_edge_cases(documents):
    rng = random.Random(3)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(99))
            for _ in range(120)]
    near = [" ".join(w if i != at else "other" for i, w in enumerate(base)) for at in range(40)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "ONE Two"),
            (7, "É é"), (8, "x " * 30000), (None, "x " * 30000), (None, "lonely text of nobody")]
    rows += [(10 + i, t) for i, t in enumerate(near)] + [(10, near[0]), (60, near[1])]
    check(documents(rows))
    assert simhash.near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("bits", [5, 9])
def test_links_of_dense_groups_are_all_found(spark, bits):
    rng = np.random.default_rng(bits)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = []
    for c in centre:
        for _ in range(150):
            v = int(c)
            for b in rng.choice(64, rng.integers(0, bits), replace=False):
                v ^= 1 << int(b)
            values.append(v)
    values = sorted(set(values))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    edges = simhash.near_links(df, block=32)
    found = {r.u: r.root for r in simhash.components(edges).collect()}
    want = plain_components(list(range(len(values))), values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got_groups, want_groups = {}, {}
    for i, v in enumerate(signed):
        got_groups.setdefault(found.get(v, v), set()).add(i)
        want_groups.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, got_groups.values())) == sorted(map(sorted, want_groups.values()))


def test_forest_never_lists_all_pairs():
    rng = np.random.default_rng(1)
    group = np.unique(np.bitwise_xor(np.uint64(12345), np.uint64(1) << rng.integers(
        0, 64, 500, dtype=np.uint64)))
    assert len(simhash.forest(group.tobytes(), group.tobytes())) == len(group) - 1


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "u long, v long")
    roots = {r.u: r.root for r in simhash.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}


def test_keep_one_keeps_the_smallest_id_and_all_columns(documents):
    text = " ".join(f"word{i}" for i in range(60))
    docs = documents([(5, text), (3, text), (3, text), (9, "else entirely here"),
                      (9, "a different text with the same id"), (None, "nobody has this one"),
                      (None, "and nobody that one either"), (7, None), (8, "")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([
        (False, 3, text), (False, 9, "else entirely here"),
        (False, 9, "a different text with the same id"), (False, 7, ""),
        (True, 0, "nobody has this one"), (True, 0, "and nobody that one either")])


def test_gray_rank_orders_like_gray_codes(spark):
    codes = [i ^ (i >> 1) for i in range(64)]
    rows = spark.createDataFrame([(c,) for c in codes], "fp long").orderBy(
        simhash.gray_rank(F.col("fp"))).collect()
    assert [r.fp for r in rows] == codes
