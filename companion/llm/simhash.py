"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint has bit ``i`` set when over half the XXH64 values (seed 42) of
the text's 3-word shingles have it set.  Two documents link when their
fingerprints differ in at most 3 bits; a component is a set of documents
connected by links.

Index: distinct fingerprints are sorted by Gray rank (neighbours in that order
share long bit patterns) and cut into blocks of at most ``BLOCK`` that share
their first ``k`` bits.  A block is an upper node: it carries the mask of bits
on which all its fingerprints agree, and their pattern.  Block pairs whose
patterns differ in more than 3 shared bits are pruned without reading a
fingerprint.  Inside a surviving pair the index goes on: nodes of 512, 64, 8
and 1 fingerprints, each with the bits that it shares beyond its parent's;
differences are accumulated on the way down and a whole group is dropped as
soon as they exceed the limit.

Scale: exact copies collapse into one fingerprint before anything is paired.
``k`` follows the number of distinct fingerprints, so a block meets only the
blocks whose first ``k`` bits differ in at most 3 positions; a prefix that
holds more than one block is cut along the Gray order into several.  A pair
of blocks returns a spanning forest of its links, never all pairs, so a group
of n near copies yields fewer than n edges per block pair.  Components come
from alternating star contractions over edge tables; nothing is collected.

Defined cases: a null or blank text has fingerprint zero and links like any
other; fewer than three words are one shingle; a null ``doc_id`` keeps its row
and is never the smallest id (a component of null ids only has a null
``component_id``); repeated rows are kept; an empty table gives no rows; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from companion.llm.common import byte_rows
from companion.session import materialize

SHINGLE = 3
MAX_BITS = 3
BLOCK = 4096
FANOUT = 8
QUERIES = 512                 # fingerprints that walk the index at a time
CHUNK = 1 << 16               # shingles whose bits are counted at a time


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text as an unsigned 64-bit number."""
    words = text.lower().split() if text else []        # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), CHUNK):
        hashes = np.array([digest(joined[a:b], 42) for a, b in
                           zip(first[at:at + CHUNK], last[at:at + CHUNK])], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(first), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = np.array([fingerprint(t, shingle) for t in byte_rows(texts)], dtype=np.uint64)
            yield pa.array(values.view(np.int64))

    return of(text)


def gray_rank(fp: Column) -> Column:
    """Position of ``fp`` in Gray order, as a long whose signed order is that order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _pack(prefix_bits: int, block: int):
    """Sorted fingerprints in, one row per block out."""
    def rows(values: np.ndarray, prefix: int) -> dict:
        agree = ~(np.bitwise_or.reduce(values) ^ np.bitwise_and.reduce(values))
        return {"block": int(values[:1].view(np.int64)[0]), "prefix": prefix,
                "mask": int(np.array([agree], np.uint64).view(np.int64)[0]),
                "pattern": int(values[:1].view(np.int64)[0]), "packed": values.tobytes()}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            held = np.concatenate([held, batch["fp"].to_numpy().astype(np.int64).view(np.uint64)])
            prefixes = held >> np.uint64(64 - prefix_bits)
            cuts = np.flatnonzero(prefixes[1:] != prefixes[:-1]) + 1
            out, start = [], 0
            for end in [*cuts.tolist(), len(held)]:
                while end - start > block or (end < len(held) and end > start):
                    stop = min(end, start + block)
                    out.append(rows(held[start:stop], int(prefixes[start])))
                    start = stop
            held = held[start:]
            if out:
                yield pd.DataFrame(out)
        if len(held):
            yield pd.DataFrame([rows(held, int(held[0] >> np.uint64(64 - prefix_bits)))])

    return pack


def _nodes(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask of newly shared bits, pattern) per level, from the root's children down to
    single fingerprints."""
    sizes = [1]
    while sizes[-1] * FANOUT < len(values):
        sizes.append(sizes[-1] * FANOUT)
    levels, above = [], np.zeros(1, dtype=np.uint64)
    for size in reversed(sizes):
        at = np.arange(0, len(values), size)
        shared = ~(np.bitwise_or.reduceat(values, at) ^ np.bitwise_and.reduceat(values, at))
        parent = above[np.arange(len(at)) // FANOUT] if len(above) > 1 else above[0]
        levels.append((shared & ~parent, values[at]))
        above = shared
    return levels


def index_links(index: np.ndarray, queries: np.ndarray,
                max_bits: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query number, index number) within ``max_bits``, a few queries at a time."""
    levels = _nodes(index)
    for start in range(0, len(queries), QUERIES):
        some = queries[start:start + QUERIES]
        who = np.repeat(np.arange(len(some)), len(levels[0][0]))
        node = np.tile(np.arange(len(levels[0][0])), len(some))
        far = np.zeros(len(who), dtype=np.uint8)
        for depth, (mask, pattern) in enumerate(levels):
            if depth:
                who, far = np.repeat(who, FANOUT), np.repeat(far, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = node < len(mask)
                who, node, far = who[real], node[real], far[real]
            far = far + np.bitwise_count((some[who] ^ pattern[node]) & mask[node])
            near = far <= max_bits
            who, node, far = who[near], node[near], far[near]
        yield who + start, node


def _roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component after adding the edges (a, b)."""
    while True:
        a_root, b_root = parent[a], parent[b]
        open_ = a_root != b_root
        if not open_.any():
            return parent
        a, b, a_root, b_root = a[open_], b[open_], a_root[open_], b_root[open_]
        np.minimum.at(parent, np.maximum(a_root, b_root), np.minimum(a_root, b_root))
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped


def forest(packed_a: bytes, packed_b: bytes, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Spanning forest of the links between (or, for the same block, inside) two blocks."""
    a = np.frombuffer(packed_a, dtype=np.uint64)
    same = packed_a == packed_b
    b = a if same else np.frombuffer(packed_b, dtype=np.uint64)
    values = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    parent = np.arange(len(values))
    for query, found in index_links(a, b, max_bits):
        parent = _roots(parent, query + shift, found)
    child = np.flatnonzero(parent != np.arange(len(values)))
    signed = values.view(np.int64)
    return list(zip(signed[child].tolist(), signed[parent[child]].tolist()))


def prefix_masks(bits: int, max_bits: int) -> list[int]:
    """All ``bits``-wide masks with at most ``max_bits`` bits set."""
    masks, last = [0], [(0, 0)]
    for _ in range(max_bits):
        last = [(m | 1 << i, i + 1) for m, low in last for i in range(low, bits)]
        masks += [m for m, _ in last]
    return masks


def near_links(fingerprints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) over distinct fingerprints (column ``fp``) whose components are those
    of all links within ``max_bits``.  Reads ``fingerprints`` twice: pass a written table."""
    total = fingerprints.count()
    prefix_bits = max(max_bits + 1, math.ceil(math.log2(max(1, total / block))))
    n_parts = max(1, math.ceil(total / (4 * block)))
    blocks = materialize(
        fingerprints.withColumn("rank", gray_rank(F.col("fp")))
        .repartitionByRange(n_parts, "rank").sortWithinPartitions("rank").select("fp")
        .mapInPandas(_pack(prefix_bits, block),
                     "block long, prefix long, mask long, pattern long, packed binary"),
        "simhash-blocks")
    nodes = blocks.select("block", "prefix", "mask", "pattern")
    masks = F.lit(prefix_masks(prefix_bits, max_bits)).cast("array<long>")
    near = nodes.select(
        F.col("block").alias("b_block"), F.col("mask").alias("b_mask"),
        F.col("pattern").alias("b_pattern"),
        F.explode(F.transform(masks, lambda m: F.col("prefix").bitwiseXOR(m))).alias("prefix"))
    apart = F.bit_count(F.col("pattern").bitwiseXOR(F.col("b_pattern"))
                        .bitwiseAND(F.col("mask")).bitwiseAND(F.col("b_mask")))
    pairs = nodes.join(near, "prefix").filter(
        (F.col("block") <= F.col("b_block")) & (apart <= max_bits)).select("block", "b_block")
    data = blocks.select("block", F.col("packed"))
    other = blocks.select(F.col("block").alias("b_block"), F.col("packed").alias("b_packed"))

    # rows are pickled a hundred at a time, so a task holds few blocks at once
    link = F.udf(lambda a, b: forest(bytes(a), bytes(b), max_bits), "array<struct<u:long,v:long>>",
                 useArrow=False)
    work = pairs.join(data, "block").join(other, "b_block")
    n_tasks = max(1, min(4096, math.ceil(total / 1024)))
    work = work.repartition(n_tasks, "block", "b_block")
    return work.select(F.explode(link("packed", "b_packed")).alias("e")).select("e.u", "e.v")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges``, root being the smallest node reachable.

    Alternating large-star and small-star steps, each over one written table.  The
    minima are written before they are joined back, so both join sides are plain
    shuffles and Spark can split a node with very many neighbours."""
    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def least(e: DataFrame) -> DataFrame:
        return materialize(e.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")), "simhash-least")

    high, low = F.greatest("u", "v"), F.least("u", "v")
    edges = materialize(edges.filter("u != v").select(high.alias("u"), low.alias("v")).distinct(),
                        "simhash-edges")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(both.join(least(both), "u").filter("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "simhash-edges")
        small = large.join(least(large), "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialize(small.filter("u != v").distinct(), "simhash-edges")
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select("u", F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id, the signed
    fingerprint ``fp``, ``text_hash`` and the component's own key ``root``."""
    text = F.col("text").cast("string")
    docs = materialize(docs.select(
        "doc_id", fingerprint_column(text, shingle).alias("fp"),
        F.xxhash64(text).alias("text_hash")), "simhash-docs")
    distinct = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fp")
    linked = materialize(components(near_links(distinct.select("fp"), max_bits, block)),
                         "simhash-roots")
    of_root = materialize(
        distinct.join(linked, distinct.fp == linked.u).groupBy("root").agg(
            F.min("least").alias("component_id")), "simhash-components")
    of_fp = linked.join(of_root, "root").select(F.col("u").alias("fp"), "component_id", "root")
    labelled = materialize(
        distinct.join(of_fp, "fp", "left").select(
            "fp", F.coalesce("component_id", "least").alias("component_id"),
            F.coalesce("root", "fp").alias("root")), "simhash-labels")
    return docs.join(labelled, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        "fp", "text_hash", "root")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id.

    Among rows of that doc_id (or of no id at all) one with the smallest text hash
    stays; columns are returned as they were."""
    id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_llm_id")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("best")
    chosen = near_duplicates(docs, shingle, max_bits).groupBy("root").agg(best).select(
        F.coalesce(F.col("best.doc_id").cast("string"), F.lit("")).alias("_llm_id"),
        F.col("best.text_hash").alias("_llm_hash"))
    chosen = materialize(chosen.distinct(), "simhash-kept")
    keyed = docs.select("*", id_key, F.xxhash64(F.col("text").cast("string")).alias("_llm_hash"))
    kept = keyed.join(chosen, ["_llm_id", "_llm_hash"], "left_semi")
    once = Window.partitionBy("_llm_id", "_llm_hash").orderBy("_llm_hash")
    return kept.withColumn("_llm_row", F.row_number().over(once)).filter(
        "_llm_row = 1").select(*docs.columns)
