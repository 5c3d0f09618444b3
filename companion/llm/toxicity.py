"""Toxicity scores: boosted trees over dense text features, isotonic calibration.

Features: density, number and strength of lexicon words (a short fixed list and
one learned from labelled rows), how many of them stand near a second-person
word, rates of capitals, punctuation and exclamation marks, obfuscated and
stretched words, length.  Gradient-boosted trees (MLlib) turn them into a raw
score, isotonic regression on other rows into a probability.

The learned lexicon holds word beginnings (4 and 5 letters, so endings vary
freely) that are far likelier in toxic than in clean text.  They are counted by
distinct (word before, word after) contexts: a word of one text that was copied
a thousand times counts once.

Training reads labelled rows only, and of those only rows with crc32(doc_id)
mod 5 not 0: remainders 1 and 2 teach the lexicon, 3 the trees, 4 the
calibration, so no step is judged on rows that the step before has learned.
Each takes a bounded sample: at most about ``LEXICON_ROWS``, ``TREE_ROWS`` and
``CALIBRATION_ROWS`` rows of either class, drawn by a hash of doc_id.  Scores
read nothing but the text.

Scale: one bounded training table, then one pass over all documents without a
shuffle; the model is a few trees, the lexicon at most ``LEXICON_TERMS`` terms.

Defined cases: a null or blank text has zero features and gets the score that
the model gives to them; a null doc_id is not held out and teaches nothing;
repeated labels of a document count as toxic if one of them is; null labels are
ignored; without labelled rows of both classes every score is the smoothed share
of toxic rows (0 without any); repeated documents give repeated rows; an empty
table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from companion.llm.common import byte_rows, hash_fraction
from companion.session import materialize

FOLDS = 5                     # crc32(doc_id) mod FOLDS; 0 is held out
LEXICON_ROWS = 2500           # training rows per class, see above
TREE_ROWS = 6000
CALIBRATION_ROWS = 6000
LEXICON_TERMS = 2000
LEAF_ROWS = 10                # a leaf rests on so many training rows at least
MIN_CONTEXTS = 4
MIN_WEIGHT = 1.5
NEAR = 5                      # words between a hit and a second-person word

SEED_LEXICON = frozenset("""
arsehole asshole bastard bitch clown cretin disgusting dumb dumbass filth filthy freak
fool idiot idiotic imbecile jerk loser moron moronic pathetic pig scum scumbag shut
stupid trash ugly vermin vile worthless wretch
abschaum arschloch depp dumm idiotin miststück trottel versager
connard crétin débile imbécile minable salaud
asqueroso basura estúpido idiota imbécil inútil
""".split())
SECOND_PERSON = frozenset("""
you your yours yourself yourselves ya u ur
du dich dir dein deine deinen deiner ihr euch euer
tu te toi ton ta tes vous votre vos
tú ti tus contigo usted ustedes vosotros
""".split())
FEATURES = ("weight_per_word", "max_weight", "n_hits", "hits_per_word", "seed_per_word",
            "near_second_person", "second_person_per_word", "capitals", "punctuation",
            "exclamations", "obfuscated", "stretched", "log_words")

LETTERS = re.compile(r"[^\W\d_]+")
KIND = np.zeros(256, dtype=np.uint8)             # 1 lower, 2 upper, 4 digit or symbol, 8 blank
KIND[ord("a"):ord("z") + 1] = 1
KIND[ord("A"):ord("Z") + 1] = 2
KIND[128:] = 1
KIND[33:48] = KIND[58:65] = KIND[91:97] = KIND[123:127] = 4
KIND[ord("0"):ord("9") + 1] = 5                  # digit: also inside obfuscated words
KIND[[9, 10, 11, 12, 13, 32]] = 8
LETTER = np.isin(np.arange(256), np.flatnonzero((KIND == 1) | (KIND == 2)))
DISGUISE = np.zeros(256, dtype=bool)             # signs that stand in for letters
DISGUISE[list(b"0134578@$!*#%&")] = True


def features(text: bytes | None, lexicon: dict[str, float]) -> list[float]:
    """The ``FEATURES`` of one text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text, dtype=np.uint8)
    counts = np.bincount(KIND[raw], minlength=9)
    n = len(raw)
    obfuscated = stretched = 0
    if n > 2:
        letter = LETTER[raw]
        between = letter[:-2] & letter[2:]
        obfuscated = int(np.count_nonzero(DISGUISE[raw[1:-1]] & between))
        same = raw[1:] == raw[:-1]
        stretched = int(np.count_nonzero(same[1:] & same[:-1] & letter[2:]))
    words = LETTERS.findall(text.decode().lower())
    n_words = max(1, len(words))
    distinct = set(words)
    starts = {w[:4] for w in distinct} | {w[:5] for w in distinct}
    hits, weights, near = 0, [], 0
    if not starts.isdisjoint(lexicon):
        second = None
        for at, word in enumerate(words):
            weight = max(lexicon.get(word[:4], 0.0), lexicon.get(word[:5], 0.0))
            if weight <= 0:
                continue
            hits += 1
            weights.append(weight)
            if second is None:
                second = [w in SECOND_PERSON for w in words]
            near += any(second[max(0, at - NEAR):at + NEAR + 1])
    seeds = sum(w in SEED_LEXICON for w in words) if distinct & SEED_LEXICON else 0
    you = sum(w in SECOND_PERSON for w in words) if distinct & SECOND_PERSON else 0
    return [sum(weights) / n_words, max(weights, default=0.0), float(hits), hits / n_words,
            seeds / n_words, near / hits if hits else 0.0, you / n_words,
            counts[2] / n, counts[4] / n, text.count(b"!") / n, obfuscated / n_words,
            stretched / n_words, float(np.log1p(len(words)))]


def feature_column(text: Column, lexicon: dict[str, float]) -> Column:
    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = byte_rows(texts)
            flat = np.array([features(t, lexicon) for t in rows], dtype=np.float64)
            yield pa.ListArray.from_arrays(
                pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()),
                pa.array(flat.reshape(-1)))

    return array_to_vector(of(text))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Bounded labelled sample as a table: text, toxic (0/1), step (1, 2 lexicon; 3; 4)."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    step = fold(F.col("doc_id"))
    known = materialize(known.withColumn("step", step).filter("step > 0"), "toxicity-labels")
    purpose = F.when(F.col("step") <= 2, 1).otherwise(F.col("step"))
    counts = known.groupBy(purpose.alias("purpose"), "toxic").count().collect()   # six rows
    bound = {1: LEXICON_ROWS, 3: TREE_ROWS, 4: CALIBRATION_ROWS}
    share = F.lit(0.0)
    for row in counts:
        share = F.when((purpose == row.purpose) & (F.col("toxic") == row.toxic),
                       min(1.0, bound[row.purpose] / row["count"])).otherwise(share)
    chosen = known.filter(hash_fraction(F.col("doc_id")) < share).select(
        F.col("doc_id").alias("_llm_id"), "toxic", "step")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # at most 2 * (LEXICON_ROWS + TREE_ROWS + CALIBRATION_ROWS) narrow rows are broadcast
    return materialize(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_llm_id")).select(
        "text", "toxic", "step"), "toxicity-training")


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Word beginnings that are likelier in toxic rows, with their log ratios."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))
    token = F.explode(F.transform(F.col("words"), lambda w, i: F.struct(
        w.alias("word"), F.xxhash64(F.get("words", i - 1), F.get("words", i + 1)).alias("context"))))
    tokens = rows.select("toxic", words.alias("words")).select("toxic", token.alias("t")).filter(
        F.length("t.word") >= 4)
    terms = tokens.select("toxic", F.explode(F.array_distinct(F.array(
        F.substring("t.word", 1, 4), F.substring("t.word", 1, 5)))).alias("term"),
        F.xxhash64("t.word", "t.context").alias("context")).distinct()
    counted = terms.groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    counted = materialize(counted, "toxicity-terms")
    total = counted.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    if not total.n:
        return {}
    good = F.col("n") - F.col("bad")
    weight = F.log((F.col("bad") + 0.5) / float(total.bad + 1)) - F.log(
        (good + 0.5) / float(total.n - total.bad + 1))
    best = counted.select("term", "bad", weight.alias("weight")).filter(
        (F.col("bad") >= MIN_CONTEXTS) & (F.col("weight") >= MIN_WEIGHT))
    top = best.orderBy(F.desc("weight"), "term").limit(LEXICON_TERMS).collect()
    return {r.term: float(r.weight) for r in top}


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    prior: float
    trees: object = None
    calibration: object = None

    def score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """``docs`` with a probability column ``name`` made from ``text`` alone."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.prior))
        vectors = docs.withColumn("_llm_features", feature_column(
            F.col("text").cast("string"), self.lexicon))
        raw = self.trees.transform(vectors).withColumn(
            "_llm_raw", vector_to_array("_llm_probability")[1])
        done = self.calibration.transform(raw)
        # the raw score orders rows inside a step of the calibration
        value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_llm_calibrated")))
        return done.withColumn(name, value * 0.998 + F.col("_llm_raw") * 0.002).drop(
            "_llm_features", "_llm_raw", "_llm_margin", "_llm_probability", "_llm_class",
            "_llm_calibrated")


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    rows = training_rows(docs, labels)
    found = {(r.step, r.toxic): r["count"] for r in rows.groupBy("step", "toxic").count().collect()}
    bad, n = sum(c for (_, t), c in found.items() if t), sum(found.values())
    prior = (bad + 1) / (n + 2) if n else 0.0
    if not 0 < bad < n:
        return ToxicityModel({}, prior)

    def purpose(*steps: int) -> Column:
        """Rows of these remainders; all rows of a class that has none there."""
        mine = [F.col("step").isin(*steps) if any(found.get((s, t)) for s in steps) else F.lit(True)
                for t in (0, 1)]
        return F.when(F.col("toxic") == 1, mine[1]).otherwise(mine[0])

    lexicon = learn_lexicon(rows.filter(purpose(1, 2)))
    uses = rows.filter(purpose(3)).withColumn("step", F.lit(3)).unionByName(
        rows.filter(purpose(4)).withColumn("step", F.lit(4)))
    table = materialize(uses.select(
        "step", F.col("toxic").cast("double").alias("toxic"),
        vector_to_array(feature_column(F.col("text"), lexicon)).alias("values")),
        "toxicity-features").select("step", "toxic", array_to_vector("values").alias("_llm_features"))
    booster = GBTClassifier(
        featuresCol="_llm_features", labelCol="toxic", predictionCol="_llm_class",
        maxIter=12, maxDepth=3, stepSize=0.3, minInstancesPerNode=LEAF_ROWS, seed=7)
    booster.setRawPredictionCol("_llm_margin").setProbabilityCol("_llm_probability")
    trees = booster.fit(table.filter("step = 3"))
    held = trees.transform(table.filter("step = 4")).withColumn(
        "_llm_raw", vector_to_array("_llm_probability")[1])
    calibration = IsotonicRegression(featuresCol="_llm_raw", labelCol="toxic",
                                     predictionCol="_llm_calibrated").fit(held)
    return ToxicityModel(lexicon, prior, trees, calibration)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = fit(docs, labels).score(docs.select("doc_id", "text"))
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents predicted toxic; all columns as they were."""
    scored = fit(docs, labels).score(docs, "_llm_score")
    return scored.filter("_llm_score < 0.5").select(*docs.columns)
