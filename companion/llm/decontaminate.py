"""Benchmark decontamination with an FM-index per training shard.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all
non-ASCII characters.  Every 13 consecutive words of a benchmark item are a
window; an item of fewer words, but not none, is one window.  A document word
inside any occurrence of a window is hit.

A shard is a batch of documents inside a Spark task.  Its words become
numbers of the phrase vocabulary; a word outside that vocabulary cannot be
part of an occurrence, so it ends a run, and runs shorter than the shortest
window are left out of the index.  The FM-index of what remains is searched
backwards for all windows at once, occurrences are located through sampled
suffix positions, and their word spans are merged.

Scale: documents are not shuffled and nothing is collected from them.  The
benchmark is the query set: it is read in blocks of at most
``BLOCK_BYTES`` of text, each broadcast on its own, and spans found for
different blocks are merged per document, so its size is bounded per pass
and not in total.

Defined cases: a null text has no words; an empty or blank text gives zero
counts and ``contaminated`` false; items without words have no window; a
benchmark row with a null ``item_id`` still hits words but has no id to list
and is not counted in ``n_items``; equal ``item_id`` values count once;
repeated documents give repeated rows; an empty benchmark hits nothing; other
columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from companion.llm.common import byte_rows
from companion.llm.fm_index import FMIndex

WINDOW = 13
BLOCK_BYTES = 1 << 20         # benchmark text per broadcast block
SHARD_SYMBOLS = 1 << 20       # words in one index, at least one document
MIN_SHARE = 20                # contaminated: 20 * n_hit >= n_words

# A-Z become a-z; digits, letters and all non-ASCII bytes stay; the rest separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128
             else 32 for b in range(256))

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Phrases:
    """Windows of one benchmark block as numbers of its own vocabulary."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            words = words_of(None if text is None else text.encode())
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(window, len(numbers))
            for at in range(len(numbers) - size + 1 if numbers else 0):
                owner = owners.setdefault(tuple(numbers[at:at + size]), set())
                if item_id is not None:
                    owner.add(item_id)
        ids = sorted(set().union(*owners.values())) if owners else []
        number = {item: i for i, item in enumerate(ids)}
        self.item_ids = ids
        self.by_length: list[tuple[np.ndarray, list[np.ndarray]]] = []
        for size in sorted({len(w) for w in owners}):
            rows = [w for w in owners if len(w) == size]
            self.by_length.append((
                np.array(rows, dtype=np.int32),
                [np.array(sorted(number[i] for i in owners[w]), dtype=np.int64) for w in rows]))
        self.shortest = self.by_length[0][0].shape[1] if self.by_length else 0


def search_shard(docs: list[np.ndarray], phrases: Phrases):
    """Merged hit spans (document, start, end) and (document, item) pairs of a shard."""
    none = np.zeros(0, dtype=np.int64)
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])      # a 0 ends every document
    flat = np.zeros(starts[-1], dtype=np.int32)
    for start, numbers in zip(starts, docs):
        flat[start:start + len(numbers)] = numbers
    known = np.flatnonzero(flat)
    if not len(known) or not phrases.shortest:
        return (none, none, none), (none, none)
    breaks = np.flatnonzero(np.diff(known) > 1)
    run_first = np.concatenate([[0], breaks + 1])
    run_length = np.diff(np.concatenate([run_first, [len(known)]]))
    keep = run_length >= phrases.shortest
    if not keep.any():
        return (none, none, none), (none, none)
    run_at, run_length = known[run_first[keep]], run_length[keep]
    # indexed text: the kept runs, a 0 after each; origin maps back to the shard
    out_at = np.concatenate([[0], np.cumsum(run_length + 1)])
    origin = np.arange(out_at[-1]) + np.repeat(run_at - out_at[:-1], run_length + 1)
    symbols = flat[origin]
    symbols[out_at[1:] - 1] = 0
    index = FMIndex(symbols, len(phrases.vocabulary) + 1)
    cover = np.zeros(len(flat) + 1, dtype=np.int32)
    pair_docs, pair_items = [none], [none]
    for rows, owners in phrases.by_length:
        low, high = index.search(rows)
        hits = np.flatnonzero(low < high)
        if not len(hits):
            continue
        count = high[hits] - low[hits]
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = origin[index.locate(np.repeat(low[hits], count) + offset)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + rows.shape[1], -1)
        doc = np.searchsorted(starts, at, side="right") - 1
        # distinct (phrase, document) first: a phrase may occur often in one text
        code = np.unique(np.repeat(hits, count) * len(docs) + doc)
        phrase, doc = code // len(docs), code % len(docs)
        sizes = np.array([len(owners[p]) for p in phrase], dtype=np.int64)
        pair_docs.append(np.repeat(doc, sizes))
        pair_items.append(np.concatenate([owners[p] for p in phrase]))
    edges = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)]))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    doc = np.searchsorted(starts, begin, side="right") - 1
    codes = np.unique(np.concatenate(pair_docs) * (len(phrases.item_ids) + 1)
                      + np.concatenate(pair_items))
    width = len(phrases.item_ids) + 1
    return (doc, begin - starts[doc], end - starts[doc]), (codes // width, codes % width)


def find_batch(texts: pa.Array, phrases: Phrases, shard_symbols: int = SHARD_SYMBOLS) -> pa.Array:
    """``FOUND`` rows of one batch, indexed shard by shard."""
    rows = byte_rows(texts)
    n_words = np.zeros(len(rows), dtype=np.int64)
    span_count = np.zeros(len(rows), dtype=np.int64)
    item_count = np.zeros(len(rows), dtype=np.int64)
    begins, ends, items = [], [], []
    look = phrases.vocabulary.get
    shard: list[np.ndarray] = []
    first = size = 0

    def flush(upto: int) -> None:
        nonlocal shard, first, size
        (doc, begin, end), (pair_doc, pair_item) = search_shard(shard, phrases)
        span_count[first:upto] = np.bincount(doc, minlength=upto - first)
        item_count[first:upto] = np.bincount(pair_doc, minlength=upto - first)
        begins.append(begin)
        ends.append(end)
        items.append(pair_item)
        shard, first, size = [], upto, 0

    for at, text in enumerate(rows):
        words = words_of(text)
        n_words[at] = len(words)
        shard.append(np.fromiter(map(look, words, repeat(0)), np.int32, len(words)))
        size += len(words) + 1
        if size >= shard_symbols:
            flush(at + 1)
    flush(len(rows))

    def offsets(counts):
        return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())

    spans = pa.StructArray.from_arrays(
        [pa.array(np.concatenate(begins), pa.int32()), pa.array(np.concatenate(ends), pa.int32())],
        ["start", "end"])
    names = pa.array(phrases.item_ids, pa.string()).take(
        pa.array(np.concatenate(items).astype(np.int64)))
    return pa.StructArray.from_arrays(
        [pa.array(n_words), pa.ListArray.from_arrays(offsets(span_count), spans),
         pa.ListArray.from_arrays(offsets(item_count), names)],
        ["n_words", "spans", "items"])


def _finder(spark: SparkSession, phrases: Phrases):
    shared = spark.sparkContext.broadcast(vars(phrases))      # plain values only

    @F.arrow_udf(returnType=FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = SimpleNamespace(**shared.value)
        for texts in batches:
            yield find_batch(texts, known)

    return find


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES,
                     window: int = WINDOW) -> Iterator[Phrases]:
    """The query set in blocks of about ``block_bytes`` of text each."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                             F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = int(total // block_bytes) + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    for number in range(n_blocks):
        rows = items.filter(block == number).collect()
        yield Phrases([(r.item_id, r.text) for r in rows], window)


def matches(docs: DataFrame, benchmark: DataFrame, text: Column | None = None,
            block_bytes: int = BLOCK_BYTES) -> Column:
    """Struct column: n_words, merged word spans of hits, sorted distinct item ids."""
    text = F.col("text").cast("string") if text is None else text
    found = [_finder(docs.sparkSession, p)(text)
             for p in benchmark_blocks(benchmark, block_bytes)]
    if len(found) == 1:
        return found[0]
    spans = F.aggregate(
        F.array_sort(F.concat(*[f["spans"] for f in found])),
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
                F.try_element_at(done, F.lit(-1))["start"].alias("start"),
                F.greatest(F.try_element_at(done, F.lit(-1))["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(s))))
    items = F.array_sort(F.array_distinct(F.concat(*[f["items"] for f in found])))
    return F.struct(found[0]["n_words"].alias("n_words"), spans.alias("spans"),
                    items.alias("items"))


def n_hit(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"),
                       lambda n, s: n + (s["end"] - s["start"]).cast("long"))


def contaminated(found: Column) -> Column:
    hit = n_hit(found)
    return (hit > 0) & (hit * MIN_SHARE >= found["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, and the merged removal ``spans`` (word numbers, end exclusive)."""
    found = docs.select("doc_id", matches(docs, benchmark, block_bytes=block_bytes).alias("_found"))
    f = F.col("_found")
    return found.select(
        "doc_id", f["n_words"].alias("n_words"), n_hit(f).alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"),
        contaminated(f).alias("contaminated"), f["spans"].alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents; all columns as they were."""
    kept = docs.withColumn("_llm_found", matches(docs, benchmark))
    return kept.filter(~contaminated(F.col("_llm_found"))).drop("_llm_found")
