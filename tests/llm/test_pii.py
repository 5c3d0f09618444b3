"""PII scan against plain patterns on whole texts."""

import hashlib
import re

import pytest

from companion.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(PLAIN)
                  for m in re.finditer(PLAIN[kind], text or "") if passes(kind, m[0]))


def check(df, model=None):
    rows = pii.find_pii(df, model).collect()
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    assert len(rows) == df.count()
    for r in rows:
        spans = plain(texts[r.doc_id])
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(k == kind for _, k, _ in spans) for kind in range(4)), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        kept = [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE_KINDS]
        assert ",".join(kept) == base
        assert len(r.redactions) == (len(r.spans.split(",")) if r.spans else 0)
    return rows


def test_whole_table_matches_plain_patterns(small):
    rows = check(small("documents"))
    assert sum(r.n_email for r in rows) and sum(r.n_card for r in rows)


CASES = [
    (1, None), (2, ""), (3, "a@b.c"), (4, "x.y+z@aa-b.cc.dd. é@f.g _@-.-"), (5, "a@b.c_d@e.f@g.h"),
    (6, "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 0000000255.1.1.1"), (7, "é 4111 1111 1111 1111 x"),
    (8, "4111-1111-1111-1112 41111111111111111111111"), (9, "+1 (988) 555-2485 +49-30-1234567."),
    (10, "+1 555 +12345678901234567 + 123456789012"), (11, "a" * 900 + "@" + "b" * 900),
    (12, "12 " * 30000), (13, "1" * 2000), (14, "1." * 2000), (15, "+1" + "." * 9000),
    (16, "+++++1 2 3 4 5 6 7 8 9 0 1"), (17, "0 0-0 0-0 0-0 0-0 0-0 0-0 0-0 00"), (18, "@@@ a@ @b.c a@b a@b."),
    (19, "1  2 4111111111111111--4111111111111111"), (None, "mail me: who@where.org"),
    (20, "10.0.0.1:8080 v1.2.3 1.2.3.4")]


def test_edge_cases(documents):
    check(documents(CASES))
    check(documents(CASES), pii.PiiModel([(1.0, 1.0)], 0.5))
    assert pii.find_pii(documents([])).count() == 0
    assert len(pii.find_pii(documents([(1, "a@b.cd")] * 3)).collect()) == 3


@pytest.fixture(scope="module")
def model(documents):
    rows = []
    for i in range(600):
        rows += [(i, f"call +1 ({200 + i % 700}) 555-{1000 + i} or mail u{i}@mail.example.com now"),
                 (10000 + i, f"the order {i * 37 % 997}{i % 10}, {i % 90 + 10}.5 and build {i}.{i % 7}.{i % 5}.{i}0"),
                 (20000 + i, f"card number {4000000000000000 + i * 7919} in year {1900 + i % 120}")]
    return pii.fit(documents(rows))


def test_trees_separate_checked_formats(model, documents):
    assert model.trees and model.threshold < float("inf")


def test_trees_only_add(model, documents):
    rows = check(documents(CASES + [(30, "his id 123-45-6789 and (555) 123-4567, IBAN DE89 3704 0044 0532 0130 00"),
                                    (31, "write to joe [at] mail [dot] org")]), model)
    for r in rows:
        assert all(s.split(":")[0] in (*pii.BASE_KINDS, *pii.ADDED) for s in r.spans.split(",") if s)
        base = [s for s in r.redactions if s.kind in pii.BASE_KINDS]
        for s in r.redactions:
            if s.kind in pii.ADDED:
                assert not any(b.start < s.end and s.start < b.end for b in base)


def test_everything_scored_high_is_added_once(documents):
    always = pii.PiiModel([(1.0, 1.0)], 0.5)
    rows = pii.find_pii(documents([(1, "ssn 123-45-6789, (555) 123-4567"), (2, "+1 (555) 123-4567"),
                                   (3, "joe [at] mail [dot] org")]), always).collect()
    assert {r.doc_id: r.spans for r in rows} == {
        1: "id_number:4:15,national:17:31", 2: "phone:0:17", 3: "masked_email:0:23"}


def test_tree_expression_equals_the_model(spark, documents):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.classification import GBTClassifier
    from pyspark.sql import functions as F

    table = pii.examples(documents([(i, f"{i}.{i % 300}.1.{i % 400} n{i}@x.org {i * 12345}") for i in range(300)]))
    vectors = table.select("label", "values", array_to_vector("values").alias("features"))
    gbt = GBTClassifier(maxIter=4, maxDepth=3, seed=5).fit(vectors)
    own = pii.PiiModel([(float(w), pii.read_tree(t._java_obj.rootNode()))
                        for w, t in zip(gbt.treeWeights, gbt.trees)], 0.0)
    m = F.struct(*[F.col("values")[i].alias(n) for i, n in enumerate(pii.FEATURES)])
    both = gbt.transform(vectors).select("prediction", "label", own.margin(m).alias("margin")).collect()
    assert all((r.margin > 0) == (r.prediction == 1.0) for r in both)
    assert {r.prediction for r in both} == {0.0, 1.0}


def test_fitted_model_adds_planted_spans(documents):
    rows = []
    for i in range(300):
        rows += [(i, f"call +1 ({200 + i}) 555-{1000 + i} or mail u{i}@mail.example.com now"),
                 (1000 + i, f"the year {1900 + i % 120}, {i % 90 + 10}.5 of {i * 37} and build {i}.{i % 7}.{i % 5}.{i}0"),
                 (2000 + i, f"her ssn {100 + i}-{10 + i % 80}-{1000 + i * 7}, phone 555-{200 + i}-{1000 + i * 11}"),
                 (3000 + i, f"IBAN DE{10 + i % 80} 3704 0044 0532 {1000 + i} 00"),
                 (4000 + i, f"order number {100 + i}-{20 + i % 70}-{2000 + i * 9} was sent")]
    model = pii.fit(documents(rows))
    assert set(model.thresholds) == {"id_number", "national", "account"}
    asked = [(1, "her ssn 219-09-9999"), (2, "he said 219-09-9999 twice"), (3, "phone (555) 123-4567"),
             (4, "ask at 555-123-4567 then"), (5, "the IBAN DE89 3704 0044 0532 0130 00"),
             (6, "pay to FR76 3000 6000 0112 3456 7890 189"), (7, "order number 219-09-9999 came")]
    got = {r.doc_id: [s.kind for s in r.redactions if s.kind in pii.ADDED]
           for r in pii.find_pii(documents(asked), model).collect()}
    assert got == {1: ["id_number"], 2: ["id_number"], 3: ["national"], 4: ["national"],
                   5: ["account"], 6: ["account"], 7: []}


def test_every_document_teaches_or_calibrates(spark):
    docs = spark.range(26000).selectExpr("concat('to u', id, '@mail.org') AS text")
    table = pii.examples(docs)
    emails = table.filter("kind = 0").groupBy("half").count().collect()
    assert sum(r["count"] for r in emails) == 26000 and len(emails) == 2
