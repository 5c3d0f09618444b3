"""Language identification: held-out accuracy and edge cases."""

import html
import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from companion.llm import language_id as lid

PAGES = "page_id long, url string, html string, lang string, host string, p double"


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    split = F.pmod(F.xxhash64("text"), F.lit(4))
    pages = docs.filter(split == 0).filter("n_chars > 40").select(
        F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"),
        F.concat(F.lit("<p>"), "text").alias("html"))
    got = lid.identify(pages, docs.filter(split != 0)).join(
        docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("truth")), "page_id")
    rows = got.collect()
    assert len(rows) > 1000
    assert np.mean([r.lang == r.truth for r in rows]) > 0.97
    assert all(0 < r.probability <= 1 for r in rows)


def page(lang, text):
    return f'<!DOCTYPE html><html lang="{lang}"><head><title>x</title></head><body><p>{text}</p></body></html>'


def test_edge_cases(spark, documents, small):
    docs = small("documents")
    texts = {r.lang: r.text for r in docs.filter("n_chars > 1000").collect()}
    rows = [(i, f"http://h{i % 4}.example.{'fr' if i % 2 else 'de'}/x", page("fr" if i % 2 else "de",
             texts["fr" if i % 2 else "de"])) for i in range(40)]
    rows += [(100, "http://h1.example.fr/", page("fr", "")), (101, "http://h0.example.de/", None),
             (102, None, page("fr", texts["fr"])), (None, None, None), (103, "", ""),
             (104, "x://Y", "<html lang='zz'><script>" + texts["en"] + "</script>" + texts["es"] * 40),
             (40, "http://h0.example.de/x", page("de", texts["de"]))] * 2
    df = spark.createDataFrame([(*r, "zz", "h", 0.5) for r in rows], PAGES)
    got = lid.identify(df, docs).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert all(by_id[i].lang == ("fr" if i % 2 else "de") for i in range(40))
    assert by_id[100].lang == "fr"              # an empty page of a French host that declares French
    assert by_id[101].lang == "de"
    assert by_id[104].lang == "es" and by_id[104].declared == "zz"
    assert by_id[None].lang is not None and by_id[103].lang is not None
    assert lid.identify(df.limit(0), docs).count() == 0
    none = lid.identify(df, docs.limit(0)).collect()
    assert len(none) == len(rows) and {r.lang for r in none} == {None}


def test_visible_text():
    assert lid.visible(b"<html><head><title>t</title></head><style>a{}</style>A &amp; <b>B</b><!-- c --></html>"
                       ).split() == [b"A", b"&", b"B"]


HIDDEN = re.compile(rb"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->")


def plain_visible(page):
    """The same by backtracking patterns, quadratic on markup that is left open."""
    text = re.sub(rb"(?s)<[^>]*>", b" ", HIDDEN.sub(b" ", page))
    return html.unescape(text.decode("utf-8", "replace")).encode("utf-8", "replace")


def test_visible_text_equals_plain_patterns(small):
    rng = np.random.default_rng(1)
    parts = [b"<!--", b"-->", b"<script>", b"</script >", b"<style", b"</STYLE>", b"<head>", b"</head>", b"<", b">",
             b" a ", b"&amp;", b"&#65;", b"<header>", b"</", b"--", b"<SCRIPT x>", "é".encode()]
    pages = [r.html.encode() for r in small("pages").filter("html IS NOT NULL").collect()]
    pages += [b"".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 30))) for _ in range(4000)]
    for page in pages:
        assert lid.visible(page) == plain_visible(page), page[:200]


@pytest.mark.parametrize("part", [b"<!--", b"<script>", b"<", b"<style", b"&#", b"<head><!--", b"&#9", b"&", b"<html lang ",
                                  b"</script", b"--", b"<script></script"])
def test_a_megabyte_of_open_markup(part):
    start = time.perf_counter()
    lid.visible(part * (1_000_000 // len(part)))
    lid.visible(part + b"9" * 1_000_000)
    assert time.perf_counter() - start < 2


def test_open_markup_in_spark(spark, small):
    rows = [(i, "http://" + "a" * 300_000 + ".b/x", x * (300_000 // len(x)), "q", "h", 0.0) for i, x in enumerate(
        ("<!--", "<html ", "<html lang  ", "<", "<script>", "&#1"))]
    start = time.perf_counter()
    assert lid.identify(spark.createDataFrame(rows, PAGES), small("documents")).count() == len(rows)
    assert time.perf_counter() - start < 90


def test_fused_posteriors_by_hand(small):
    pages, docs = small("pages"), small("documents")
    langs, weights = lid.train(docs)
    weights = weights.astype(np.float32).astype(float)
    rows, facts = pages.collect(), []
    for r in rows:
        text = plain_visible((r.html or "").encode())
        words = b" " + b" ".join(text.translate(lid.FOLD).split()) + b" "
        grams = [(words[i] << 16 | words[i + 1] << 8 | words[i + 2]) * 2654435761 % 2 ** 32 >> 16
                 for i in range(len(words) - 2)] if len(words) >= 5 else []
        log = sum((weights[:, g] for g in grams), np.zeros(len(langs)))
        log = log / len(grams) * min(len(grams), lid.EFFECTIVE_TRIGRAMS) if grams else log
        p = np.exp(log - log.max())
        found = re.search(r"://([^/?#:]*)", r.url or "")
        host = re.sub(r"^www\.", "", found.group(1).lower() if found else "")
        tag = re.search(r"(?is)<html\b([^>]*)", r.html or "")
        said = re.search(r"(?is)\blang\s*=\s*[\"']?([A-Za-z]+)", tag.group(1)) if tag else None
        facts.append((log, p / p.sum(), {"host": host, "domain": ".".join(host.split(".")[-2:]),
                      "suffix": host.split(".")[-1], "declared": said.group(1).lower() if said else ""}))
    n = len(langs)
    counts, total = {}, sum(p for _, p, _ in facts)
    for _, p, keys in facts:
        for item in keys.items():
            counts[item] = counts.get(item, 0) + p
    n_values = {k: sum(1 for key, _ in counts if key == k) for k in ("declared", "suffix")}
    want = {}
    for r, (log, p, keys) in zip(rows, facts):
        left = {k: np.maximum(counts[k, v] - p, 0) for k, v in keys.items()}
        world = np.maximum(total - p, 0)
        prior = (world + 1) / (world.sum() + n)
        for key, strength in (("domain", lid.DOMAIN_STRENGTH), ("host", lid.HOST_STRENGTH)):
            prior = (left[key] + strength * prior) / (left[key].sum() + strength)
        fused = log + np.log(prior)
        for key in ("declared", "suffix"):
            fused = fused + np.log((left[key] + 2) / (world + 2 * n_values[key]))
        q = np.exp(fused - fused.max())
        want[r.page_id] = (langs[int(q.argmax())], float(q.max() / q.sum()))
    got = lid.identify(pages, docs).collect()
    assert len(got) == len(rows) == len(want)
    for r in got:
        assert r.lang == want[r.page_id][0] and math.isclose(r.probability, want[r.page_id][1], rel_tol=1e-6)


def test_many_languages_all_take_part(spark):
    rng = np.random.default_rng(7)
    words = {f"l{i:02}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)]
             for i in range(70)}
    docs = [(n, " ".join(rng.choice(w, 40)), lang, "s", 1) for lang, w in words.items() for n in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    langs, table = lid.train(df)
    assert langs == sorted(words) and table.shape == (70, lid.BUCKETS)
    pages = spark.createDataFrame([(i, None, "<p>" + " ".join(rng.choice(w, 40)) + "</p>", "", "", 0.0)
                                   for i, w in enumerate(words.values())], PAGES)
    got = {r.page_id: r.lang for r in lid.identify(pages, df).collect()}
    assert sum(got[i] == lang for i, lang in enumerate(words)) >= 67
    assert lid.bucket_number(256) == lid.BUCKETS and lid.bucket_number(1000) * 1000 <= lid.MODEL_CELLS
