"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence about a page's language are added as log odds:

* text: naive Bayes over character trigrams of the visible text, learned from
  documents of known language (at most about ``TRAINING_ROWS`` per language, drawn
  by hash); trigrams of a text are far from independent, so the sum is tempered
  to at most ``EFFECTIVE_TRIGRAMS`` of average weight;
* the language declared in the markup (``<html lang=...>``) and
* the address suffix, each through P(value | language);
* a host prior, smoothed towards that of its registered domain, which is
  smoothed towards that of all pages.

The tables of the last three are grouped aggregations of the text's posteriors
over all pages, so a declaration counts for what it has proved to be worth.  A page's own
posterior is taken out of every count before the count speaks about that page, so no text
is heard twice.

Scale: the page texts are read once and leave a narrow table of log likelihoods;
every aggregation is partial on the map side (a host with a third of all pages
sends one row per task) and the counts are written before they are joined
back, so Spark can split a hot host.  All labelled languages take part.  The trigram model
holds ``BUCKETS`` numbers per language; beyond ``MODEL_CELLS`` numbers in all (256 languages)
the trigrams share fewer buckets, so its size is bounded.  Markup is removed by one
scan that never looks at a byte more than a fixed number of times, however a page leaves
its comments, scripts and tags open.

Defined cases: a null or empty page has no text evidence and is judged by the
rest; a null url has the empty host and suffix; no or an unknown declaration is a
value like any other; ties go to the first language by code point; a null page_id
keeps its row; without labelled documents every language is null; an empty table
gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from companion.llm.common import ascii_lower, byte_rows, hash_fraction
from companion.session import materialize

TRAINING_ROWS = 3000          # documents per language, expected
BUCKETS = 1 << 16
MODEL_CELLS = 1 << 24
EFFECTIVE_TRIGRAMS = 40
HOST_STRENGTH = 5.0           # pages that a domain's prior is worth to a host
DOMAIN_STRENGTH = 20.0
EVIDENCE_SMOOTHING = 2.0

OPENING = re.compile(rb"(?i)<(?:!--|(script|style|head)\b)")
CLOSING = {name: re.compile(rb"(?i)</" + name + rb"\s*+>") for name in (b"script", b"style", b"head")}
CLOSING[b""] = re.compile(b"-->")
TAG = re.compile(rb"<[^>]*+>")
ZEROS = re.compile(rb"&#0++(?=[0-9])")
TOO_LARGE = re.compile(rb"&#[0-9]{8,}+;?")            # no code point, and too long for int()
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def without_hidden(html: bytes) -> bytes:
    """Closed comments, scripts, styles and heads become a blank.  The next closing tag of each
    kind is looked up once and kept until the scan has passed it."""
    out, at, look = [], 0, 0
    closing: dict[bytes, tuple[int, int]] = {}
    while found := OPENING.search(html, look):
        kind, inside = (found.group(1) or b"").lower(), found.end()
        if closing.get(kind, (-1, 0))[0] < inside:
            end = CLOSING[kind].search(html, inside)
            closing[kind] = end.span() if end else (len(html), 0)
        start, end = closing[kind]
        if start == len(html):                         # left open: an ordinary tag
            look = inside
            continue
        out += [html[at:found.start()], b" "]
        at = look = end
    return b"".join(out) + html[at:]


def visible(html: bytes) -> bytes:
    """The text of a page without markup, scripts and comments, in time linear in its length."""
    text = without_hidden(html)
    last = text.rfind(b">") + 1                        # behind it no tag can end
    text = TAG.sub(b" ", text[:last]) + text[last:]
    if b"&" not in text:
        return text
    text = TOO_LARGE.sub("\ufffd".encode(), ZEROS.sub(b"&#", text))
    return unescape(text.decode("utf-8", "replace")).encode("utf-8", "replace")


def trigrams(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets (a power of two) of the byte trigrams of folded words."""
    folded = b" " + b" ".join(text.translate(FOLD).split()) + b" "
    b = np.frombuffer(folded, dtype=np.uint8).astype(np.uint32)
    if len(b) < 5:
        return np.zeros(0, dtype=np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(33 - buckets.bit_length())).astype(np.int64)


def bucket_number(languages: int) -> int:
    """Buckets per language: ``BUCKETS``, halved until the model has ``MODEL_CELLS`` at most."""
    buckets = BUCKETS
    while buckets > 2 and buckets * languages > MODEL_CELLS:
        buckets //= 2
    return buckets


def train(docs: DataFrame, rows_per_language: int = TRAINING_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log P(trigram | language), (languages, buckets)."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = materialize(known.groupBy("lang").count(), "language-counts")
    languages = counts.count()
    if not languages:
        return [], np.zeros((0, BUCKETS))
    buckets = bucket_number(languages)
    share = F.least(F.lit(1.0), F.lit(float(rows_per_language)) / F.col("count"))
    sample = known.join(counts, "lang").filter(hash_fraction(F.col("text")) < share)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                table = held.setdefault(lang, np.zeros(buckets))
                table += np.bincount(trigrams(text.encode(), buckets), minlength=buckets)
        for lang, table in held.items():
            at = np.flatnonzero(table)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": table[at]})

    sums = sample.mapInPandas(count, "lang string, bucket int, n double").groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).collect()
    langs = sorted(r.lang for r in packed)
    table = np.full((len(langs), buckets), 0.1)
    for r in packed:                                   # at most MODEL_CELLS cells
        cells = np.array([(c.bucket, c.n) for c in r.cells])
        table[langs.index(r.lang), cells[:, 0].astype(np.int64)] += cells[:, 1]
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def text_column(spark, content: Column, weights: np.ndarray, html: bool = True) -> Column:
    """Tempered log likelihood of every language, an array of doubles."""
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = shared.value
        for contents in batches:
            out = np.zeros((len(contents), len(table)))
            for at, row in enumerate(byte_rows(contents)):
                found = trigrams((visible(row) if html else row) if row else b"", table.shape[1])
                if len(found):
                    seen, n = np.unique(found, return_counts=True)
                    sums = table[:, seen].astype(np.float64) @ n
                    out[at] = sums / len(found) * min(len(found), EFFECTIVE_TRIGRAMS)
            yield pa.ListArray.from_arrays(
                pa.array(np.arange(len(contents) + 1) * len(table), pa.int32()),
                pa.array(out.reshape(-1)))

    return of(content)


def posterior(logs: Column) -> Column:
    """Normalised probabilities of an array of log odds."""
    top = F.array_max(logs)
    raw = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(F.array(raw), lambda r: F.transform(
        r, lambda x: x / F.aggregate(r, F.lit(0.0), lambda s, y: s + y)))[0]


def add(*arrays: Column) -> Column:
    out = arrays[0]
    for other in arrays[1:]:
        out = F.zip_with(out, other, lambda a, b: a + b)
    return out


def soft_counts(pages: DataFrame, *keys: str, n: int) -> DataFrame:
    """Sum of posteriors per key, as ``n`` columns c0, c1, ..."""
    return pages.groupBy(*keys).agg(*[F.sum(F.col("text_p")[i]).alias(f"c{i}") for i in range(n)])


def counts_of(pages: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """A written table of ``key`` and ``name``, the array of its soft counts."""
    counts = F.array(*[F.col(f"c{i}") for i in range(n)])
    return materialize(soft_counts(pages, key, n=n).select(key, counts.alias(name)), f"language-{key}")


def others(counts: Column, own: Column) -> Column:
    """``counts`` without the page's own posterior (rounding must not leave a negative)."""
    return F.zip_with(counts, own, lambda c, p: F.greatest(c - p, F.lit(0.0)))


def sum_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def smooth(counts: Column, prior: Column, strength: float) -> Column:
    """Probabilities of ``counts`` with ``strength`` counts added by ``prior``."""
    size = F.array(sum_of(counts) + strength)          # computed once, outside the loop
    return F.flatten(F.transform(size, lambda s: F.zip_with(
        counts, prior, lambda c, p: (c + strength * p) / s)))


def evidence(counts: Column, total: Column, values: int) -> Column:
    """log P(value | language), smoothed, from the value's counts and those of all values."""
    size = EVIDENCE_SMOOTHING * max(1, values)
    return F.zip_with(counts, total, lambda c, t: F.log((c + EVIDENCE_SMOOTHING) / (t + size)))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page: page_id, lang, probability, text_lang, declared, host, suffix."""
    spark = pages.sparkSession
    langs, weights = train(docs)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.regexp_replace(ascii_lower(F.regexp_extract(url, r"://([^/?#:]*)", 1)), r"^www\.", "")
    html = F.col("html").cast("string")
    opened = F.regexp_extract(html, r"(?is)<html\b([^>]*+)", 1)
    declared = F.lower(F.regexp_extract(opened, r"(?is)\blang\s*+=\s*+[\"']?([A-Za-z]++)", 1))
    rows = pages.select(
        "page_id", host.alias("host"), F.coalesce(declared, F.lit("")).alias("declared"),
        html.alias("html"))
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn(
        "domain", F.substring_index("host", ".", -2))
    n = len(langs)
    if not n:
        none = F.lit(None)
        return rows.select("page_id", none.cast("string").alias("lang"),
                           none.cast("double").alias("probability"),
                           none.cast("string").alias("text_lang"), "declared", "host", "suffix")
    read = rows.select("page_id", "host", "declared", "suffix", "domain",
                       text_column(spark, F.col("html"), weights).alias("text_log"))
    read = materialize(read.withColumn("text_p", posterior(F.col("text_log"))), "language-pages")

    keys = ("host", "domain", "declared", "suffix")
    fused = read
    for key in keys:
        fused = fused.join(counts_of(read, key, n, f"{key}_n"), key)
    own, total = F.col("text_p"), read.agg(*[F.sum(F.col("text_p")[i]) for i in range(n)]).first()
    world = others(F.array(*[F.lit(float(x or 0.0)) for x in total]), own)
    values = {key: read.select(key).distinct().count() for key in ("declared", "suffix")}
    uniform = F.array(*[F.lit(1.0 / n)] * n)
    # innermost first: all pages, the domain's, the host's; each without the page itself
    fused = fused.withColumn("_world", world).withColumn(
        "_prior", smooth(F.col("_world"), uniform, float(n))).withColumn(
        "_prior", smooth(others(F.col("domain_n"), own), F.col("_prior"), DOMAIN_STRENGTH)).withColumn(
        "_prior", smooth(others(F.col("host_n"), own), F.col("_prior"), HOST_STRENGTH))
    logs = add(F.col("text_log"), F.transform("_prior", lambda p: F.log(p)), *[
        evidence(others(F.col(f"{key}_n"), own), F.col("_world"), values[key]) for key in values])
    names = F.array(*[F.lit(x) for x in langs])
    fused = fused.withColumn("p", posterior(logs))
    best = F.array_position("p", F.array_max("p")).cast("int")
    return fused.select(
        "page_id", F.element_at(names, best).alias("lang"), F.array_max("p").alias("probability"),
        F.element_at(names, F.array_position("text_p", F.array_max("text_p")).cast("int")).alias("text_lang"),
        "declared", "host", "suffix")
