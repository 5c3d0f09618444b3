"""Toxicity: held-out accuracy, folds, edge cases."""

import zlib

import numpy as np
from companion.llm import toxicity


def auc(score, label):
    score, label = np.asarray(score), np.asarray(label)
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):                       # ties share their mean rank
        rank[score == v] = rank[score == v].mean()
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").select(
        "score", "predicted", "toxic").collect()
    label = [r.toxic for r in rows]
    assert len(rows) > 600
    assert auc([r.score for r in rows], label) > 0.97
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97
    clean = [r.predicted for r in rows if not r.toxic]
    assert np.mean(clean) < 0.01


def test_edge_cases(spark, small, documents):
    labels = spark.createDataFrame(
        [(i, 1, int(i % 3 == 0)) for i in range(400)] + [(1, 1, None), (None, 1, 1), (3, 0, 0)],
        "doc_id long, quality int, toxic int")
    rows = [(i, "you idiot you moron" if i % 3 == 0 else "a calm and friendly text") for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "idiot " * 30000), (None, "calm"), (1003, "!!! 12 @@"),
             (1000, None)]
    model_rows = toxicity.score_documents(documents(rows), labels).collect()
    assert len(model_rows) == len(rows)
    for r in model_rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    by_id = {r.doc_id: r for r in model_rows}
    assert by_id[0].predicted == 1 and by_id[1].predicted == 0 and by_id[1002].predicted == 1
    assert toxicity.score_documents(documents([]), labels).count() == 0
    none = toxicity.score_documents(documents(rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    kept = toxicity.drop_toxic(documents(rows), labels)
    assert kept.columns == documents(rows).columns
    assert kept.filter("doc_id % 3 = 0 AND doc_id < 400").count() == 0
    assert kept.filter("doc_id % 3 <> 0 AND doc_id < 400").count() == 266


def test_a_class_missing_in_some_remainders(spark, documents):
    """Few labels: the rows of a class serve every purpose that has none of its own."""
    remainder = {i: zlib.crc32(str(i).encode()) % 5 for i in range(300)}
    for places in ({1, 2}, {4}, {3}):
        bad = {i for i, r in remainder.items() if r in places}
        labels = spark.createDataFrame([(i, int(i in bad)) for i in remainder], "doc_id long, toxic int")
        docs = documents([(i, "you idiot you moron" if i in bad else "a calm and friendly text")
                          for i in remainder] + [(1000, "you idiot"), (1001, "a calm text")])
        got = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, labels).collect()}
        assert got[1000] == 1 and got[1001] == 0
        assert sum(got[i] for i in bad) == len(bad) and sum(got.values()) == len(bad) + 1
    one = spark.createDataFrame([(i, 0) for i in remainder], "doc_id long, toxic int")
    scores = {r.score for r in toxicity.score_documents(docs, one).collect()}
    assert len(scores) == 1 and max(scores) < 0.05


def test_features_ignore_everything_but_text():
    lexicon = {"idio": 3.0}
    a = toxicity.features(b"You idiot, YOU idiot! id1ot sooo", lexicon)
    named = dict(zip(toxicity.FEATURES, a))
    assert named["n_hits"] == 2 and named["near_second_person"] == 1
    assert named["obfuscated"] > 0 and named["stretched"] > 0 and named["capitals"] > 0
    assert toxicity.features(None, lexicon) == toxicity.features(b"", lexicon)
