"""The pipeline against plain versions of its stages, and its driver contract."""

import hashlib
import re

import corpus_pipeline
import pytest
from companion.llm import secrets_scan
from test_decontaminate import plain as plain_hits
from test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def outputs(spark):
    """Every stage's rows over sf0.01, each stage reading what the one before wrote."""
    from companion.session import materialize
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "test-stage")
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_stages_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash near-dedup", "benchmark decontamination", "secret scan", "mixing"]


def test_columns(outputs):
    for rows in outputs[:-1]:
        assert list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]
    assert list(outputs[-1][0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars", "copy"]


def test_toxic_documents_go_and_clean_ones_stay(spark, outputs):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(
        "/root/testdata/sf0.01/labels.parquet").collect()}
    kept = set(ids(outputs[1]))
    bad = [d for d, t in toxic.items() if t]
    good = [d for d, t in toxic.items() if not t]
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    assert sum(d not in kept for d in bad) >= 0.7 * len(bad)      # 51 toxic labels to learn from


def test_one_document_of_each_component_stays(outputs):
    rows = outputs[1]
    groups = plain_components([r.doc_id for r in rows], [plain_fingerprint(r.text) for r in rows])
    assert ids(outputs[2]) == sorted(set(groups))


def test_contaminated_documents_go(spark, outputs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(
        "/root/testdata/sf0.01/benchmark.parquet").collect()]
    verdict = {r[0]: r[5] for r in plain_hits([(r.doc_id, r.text) for r in outputs[2]], items)}
    assert ids(outputs[3]) == sorted(d for d, bad in verdict.items() if not bad)
    texts = {r.doc_id: r.text for r in outputs[2]}
    assert all(texts[r.doc_id] == r.text for r in outputs[3])


def test_secrets_are_masked(outputs):
    before = {r.doc_id: r.text for r in outputs[3]}
    assert ids(outputs[4]) == sorted(before)
    for r in outputs[4]:
        assert not secrets_scan.base_spans(r.text) and r.n_chars == len(r.text)
        if secrets_scan.REDACTED not in r.text:
            assert r.text == before[r.doc_id]
    assert any(secrets_scan.REDACTED in r.text for r in outputs[4])


def test_mix_repeats_whole_documents(outputs):
    docs = {r.doc_id: r for r in outputs[4]}
    copies = {}
    for r in outputs[5]:
        assert r.text == docs[r.doc_id].text
        copies.setdefault(r.doc_id, []).append(r.copy)
    assert all(sorted(c) in ([1], [1, 2]) for c in copies.values())
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in docs.items()}
    taken = sum(size[d] * len(c) for d, c in copies.items())
    assert abs(taken / sum(size.values()) - 1.5) < 0.05


def test_run_gives_the_same_rows(spark, outputs):
    def key(rows):
        return sorted((r.doc_id, r.copy, hashlib.md5(r.text.encode()).hexdigest()) for r in rows)
    assert key(corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()) == key(outputs[-1])


def test_empty_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
