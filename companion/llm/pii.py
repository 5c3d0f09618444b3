"""PII scan by candidate gradient boosting, in DataFrame functions only.

Generators propose candidates with high recall, overlapping where they like:
e-mail-like, dotted-number, digit-chain and plus-number spans of the base
formats, and beside them dashed identity numbers, national phone numbers,
bank account numbers and obfuscated e-mail addresses.  Boosted trees (MLlib)
score every candidate by its format (lengths, digits, separators, groups) and
its context (neighbouring characters, cue words before it).  A threshold per
generator, calibrated on rows that the trees have not seen, selects spans.
Base formats that pass their own check (octets, Luhn, digit count) always stay;
the trees add to them what the other generators propose beside them.

There are no labelled spans, so the trees learn from the formats that can be
checked: a base candidate that passes its check is an example of personal data,
one that fails, and every other number, an example of the contrary, unless it
overlaps what an unchecked generator proposes.  Candidates of those teach by weak
evidence: a cue word of their kind before them speaks for them, a word like "order"
or "version" right before them against them, and others are not examples.  The
kind of a candidate is no feature, and the cue is none of an unchecked candidate, so
what is learned carries over to candidates without a cue.  A kind's threshold rests
on its own evidence, or on the base formats where there is too little.  The candidates of
all documents are read: those of one half, drawn by hash, teach and the others calibrate.
The fitted trees become CASE expressions, so scoring is part of one projection over whole texts.

Scale: no shuffle over texts: every row is scanned, proposed, scored and judged
where it lies.  Every generator starts at the head of a character run and takes
it possessively, so its time is linear in the text.

Defined cases: a null text is empty; no span gives zero counts and the digest
of the empty string; positions are code points, ends exclusive; repeated rows
are kept; an empty table gives no rows; a table without enough of both outcomes
trains no trees and adds no spans; other columns are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from companion.llm.common import text_column
from companion.session import materialize

PRECISION = 0.95              # wanted share of right spans above a threshold
TREES = 8
DEPTH = 3
CONTEXT = 24                  # characters looked at on either side
MIN_EVIDENCE = 10             # calibrating examples from which a kind gets a threshold of its own

BASE_KINDS = ("email", "ip", "card", "phone")
# Base formats (fixed).  Written so that a match starts at the head of its run and
# never gives back: the matches are those of the plain formats in the comments.
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+      from 14 digits on
#   phone  \+[0-9][\x20().0-9-]+[0-9]
GENERATORS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "national": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?(?:at|AT) ?[\])] ?"
                    r"[A-Za-z0-9-]{1,63}(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?|\.)[A-Za-z]{2,}",
    "number": r"(?<![0-9A-Za-z.,:/+-])[0-9]++(?:[.,:/ -][0-9]++)*+(?![0-9A-Za-z])",
}
# What a text must hold before a generator is worth running.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?+[0-9]){13}", "phone": r"\+[0-9]",
         "id_number": r"[0-9]-[0-9]{2}-[0-9]", "national": r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
         "account": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "masked_email": r"[\[(] ?(?:at|AT) ?[\])]",
         "number": r"[0-9]"}
ANY = r"[0-9@]|[\[(] ?(?:at|AT) ?[\])]"
SPANS = "array<struct<start:int,end:int,value:string>>"
KINDS = tuple(GENERATORS)
ADDED = ("id_number", "national", "account", "masked_email")     # what the trees may add
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CUES = {
    "email": r"(?i)mail|contact|write|address|adresse|correo",
    "number": r"(?i)phone|tel\b|call|fax|mobil|tél|card|konto|iban|account|ssn|social|id\b|no\.|nr\.",
}
# Weak evidence before a candidate of an unchecked kind, and against it.
EVIDENCE = {
    "id_number": r"(?i)\bssn\b|social|identity|\bid\b|passport",
    "national": r"(?i)phone|\btel\b|call|fax|mobil|tél|cell",
    "account": r"(?i)iban|account|konto|compte|bank",
    "masked_email": r"(?i)mail|contact|write|address|adresse|correo",
}
CONTRARY = r"(?i)\b(?:order|invoice|build|version|part|item|serial|isbn|ticket|tracking)" \
           r"(?: (?:number|no|nr|id))?[ .:#]{0,3}$"
FEATURES = ("length", "digits", "letters", "separators", "groups", "longest_group",
            "dots", "has_at", "word_before", "word_after", "cue", "line_start", "repeated_digit",
            "contrary")


def found(kind: str, text: Column) -> Column:
    """Array of (start, end, value) of one generator's matches in ``text``."""
    pattern = GENERATORS[kind]

    def placed(values: Column) -> Column:
        # the text between matches; zip_with reads either list once, the last gap has no match
        steps = F.zip_with(values, F.split(text, pattern, -1), lambda v, gap: F.struct(
            F.length(gap).alias("gap"), F.length(v).alias("size")))
        # starts gather in one string: appending to an array would copy it for every match
        starts = F.aggregate(
            steps, F.expr("named_struct('at', 0, 'out', '')"),
            lambda acc, m: F.when(m["size"].isNull(), acc).otherwise(F.struct(
                (acc["at"] + m["gap"] + m["size"]).alias("at"),
                F.concat(acc["out"], (acc["at"] + m["gap"]).cast("string"), F.lit(",")).alias("out"))))
        return F.zip_with(
            values, F.slice(F.split(starts["out"], ","), 1, F.size(values)),
            lambda v, at: F.struct(at.cast("int").alias("start"),
                                   (at.cast("int") + F.length(v)).alias("end"), v.alias("value")))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(NEEDS[kind]), F.transform(F.array(matches), placed)[0]).otherwise(
        F.expr(f"cast(array() as {SPANS})"))


def passes(kind: str, value: Column) -> Column:
    """The base formats' own checks."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15)


def candidates(text: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The generators' spans: array of (start, kind number, end, value, passes)."""
    def tagged(kind: str):
        def of(c: Column) -> Column:
            ok = passes(kind, c["value"]) if kind in BASE_KINDS else F.lit(False)
            return F.struct(c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                            c["end"].alias("end"), c["value"].alias("value"), ok.alias("passes"))
        return of

    lists = [F.transform(found(kind, text), tagged(kind)) for kind in kinds]
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string,passes:boolean>>)")
    return F.when(text.rlike(ANY), F.concat(*lists)).otherwise(none)


def context(text: Column, spans: Column) -> Column:
    """``spans`` with the characters before and after each."""
    def one(c: Column) -> Column:
        first = F.greatest(c["start"] - CONTEXT, F.lit(0))
        return F.struct(
            *[c[n].alias(n) for n in ("start", "kind", "end", "value", "passes")],
            F.substring(text, first + 1, c["start"] - first).alias("before"),
            F.substring(text, c["end"] + 1, F.lit(CONTEXT)).alias("after"))

    return F.transform(spans, one)


def is_added(c: Column) -> Column:
    return c["kind"].isin([KINDS.index(k) for k in ADDED])


def weak_label(c: Column) -> Column:
    """1 or 0 where the text before an unchecked candidate speaks for or against it, else null."""
    label = F.when(c["before"].rlike(CONTRARY), 0.0)
    for kind, cue in EVIDENCE.items():
        label = label.when((c["kind"] == KINDS.index(kind)) & c["before"].rlike(cue), 1.0)
    return label


def measure(c: Column) -> dict[str, Column]:
    """The ``FEATURES`` of a candidate, as doubles."""
    value, before, after = c["value"], c["before"], c["after"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    groups = F.split(F.regexp_replace(value, "[^A-Za-z0-9]+", " "), " ")
    longest = F.aggregate(groups, F.lit(0), lambda m, g: F.greatest(m, F.length(g)))
    # the cue labels unchecked candidates, so it is no feature of theirs
    cue = (before.rlike(CUES["email"]) | before.rlike(CUES["number"])) & ~is_added(c)
    out = {
        "length": F.length(value), "digits": F.length(digits),
        "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
        "separators": F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")),
        "groups": F.size(groups), "longest_group": longest,
        "dots": F.length(F.regexp_replace(value, "[^.]", "")),
        "has_at": value.contains("@").cast("int"),
        "word_before": before.rlike(r"[\p{L}\p{N}]$").cast("int"),
        "word_after": after.rlike(r"^[\p{L}\p{N}]").cast("int"), "cue": cue.cast("int"),
        "line_start": (before == "").cast("int") + before.rlike(r"\n$").cast("int"),
        "repeated_digit": digits.rlike(r"([0-9])\1{3}").cast("int"),
        "contrary": before.rlike(CONTRARY).cast("int")}
    return {name: out[name].cast("double") for name in FEATURES}


Tree = float | tuple          # a leaf's value, or (feature, threshold, left, right)


def read_tree(node) -> Tree:
    """A fitted MLlib node as plain values."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return (FEATURES[split.featureIndex()], float(split.threshold()),
            read_tree(node.leftChild()), read_tree(node.rightChild()))


def tree_column(tree: Tree, m: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, threshold, left, right = tree
    return F.when(m[name] <= threshold, tree_column(left, m)).otherwise(tree_column(right, m))


@dataclass
class PiiModel:
    """Boosted trees with their weights, and the margin from which spans are selected, per
    kind in ``thresholds`` and ``threshold`` for the others."""
    trees: list[tuple[float, Tree]]
    threshold: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def cut(self, kind: str) -> float:
        return self.thresholds.get(kind, self.threshold)

    def margin(self, m: Column) -> Column:
        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + F.lit(weight) * tree_column(tree, m)
        return total

    def selected(self, text: Column, spans: Column) -> Column:
        """Spans that pass a base check, and those that the trees add beside them."""
        base = F.filter(spans, lambda c: c["passes"])
        if not self.trees:
            return base
        # what lies in or across a base span is found already
        asked = context(text, F.filter(spans, lambda c: is_added(c) & ~F.exists(
            spans, lambda b: b["passes"] & (b["start"] < c["end"]) & (c["start"] < b["end"]))))
        measured = F.transform(asked, lambda c: F.struct(c.alias("c"), F.struct(
            *[v.alias(n) for n, v in measure(c).items()]).alias("m")))
        cuts = F.array(*[F.lit(float(self.cut(k))) for k in KINDS])
        stay = F.filter(measured, lambda j: self.margin(j["m"]) >= cuts[j["c"]["kind"]])
        return F.concat(base, F.transform(stay, lambda j: F.struct(
            *[j["c"][n].alias(n) for n in ("start", "kind", "end", "value", "passes")])))


def examples(docs: DataFrame) -> DataFrame:
    """Candidates of all documents as a table: kind, values (FEATURES), label, half (0 or 1).
    Equal texts are in one half."""
    key = F.xxhash64(text_column(docs))
    text = docs.select(text_column(docs).alias("text"), F.pmod(key, F.lit(2)).alias("half"))
    spans = text.select("half", "text", candidates(F.col("text")).alias("spans"))

    def meets(c: Column, others: str) -> Column:
        return F.exists(others, lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]))

    # what overlaps a passing span is no example of its own, but for failing base spans; and
    # a number or a failing span that an unchecked generator proposes is no counter-example
    number = KINDS.index("number")
    mixed = spans.withColumn("right", F.filter("spans", lambda c: c["passes"])).withColumn(
        "added", F.filter("spans", is_added)).withColumn("spans", F.filter("spans", lambda c: (
            c["passes"] | F.when(is_added(c), ~meets(c, "right")).otherwise(
                ~meets(c, "added") & ((c["kind"] != number) | ~meets(c, "right"))))))
    each = mixed.select("half", F.explode(context(F.col("text"), F.col("spans"))).alias("c"))
    values = F.array(*measure(F.col("c")).values())
    label = F.when(is_added(F.col("c")), weak_label(F.col("c"))).otherwise(F.col("c.passes").cast("double"))
    return materialize(each.select("half", "c.kind", values.alias("values"), label.alias(
        "label")).filter("label IS NOT NULL"), "pii-examples")


def smallest_margin(bins: list, precision: float) -> float:
    """Smallest bin above which ``precision`` of the rows is right."""
    right = n = 0.0
    best = float("inf")
    for row in sorted(bins, key=lambda r: -r.bin):
        right, n = right + row.right, n + row.n
        if right / n >= precision:
            best = float(row.bin)
    return best


def calibrate(held: DataFrame, precision: float = PRECISION) -> tuple[float, dict[str, float]]:
    """Smallest margin (to a hundredth) above which ``precision`` of ``held`` is right: of the
    base formats and numbers, and of each unchecked kind with enough evidence."""
    kind = F.when(is_added(F.struct("kind")), F.col("kind")).otherwise(-1)
    bins = held.groupBy(kind.alias("kind"), (F.floor(F.col("margin") * 100) / 100).alias("bin")).agg(
        F.sum("label").alias("right"), F.count("*").alias("n")).collect()   # margins lie in [-3, 3]
    of = {k: [r for r in bins if r.kind == k] for k in {r.kind for r in bins}}
    base = smallest_margin(of.get(-1, []), precision)
    return base, {KINDS[k]: smallest_margin(rows, precision) for k, rows in of.items()
                  if k >= 0 and sum(r.n for r in rows) >= MIN_EVIDENCE}


def fit(docs: DataFrame) -> PiiModel:
    table = examples(docs)
    seen = {(r.half, r.label): r["count"] for r in table.groupBy("half", "label").count().collect()}
    if any(seen.get((half, label), 0) < 10 for half in (0, 1) for label in (0.0, 1.0)):
        return PiiModel([], float("inf"))
    vectors = table.filter("half = 0").select("label", array_to_vector("values").alias("features"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.5, seed=5).fit(vectors)
    trees = [(float(w), read_tree(t._java_obj.rootNode()))
             for w, t in zip(model.treeWeights, model.trees)]
    fitted = PiiModel(trees, float("inf"))
    m = F.struct(*[F.col("values")[i].alias(n) for i, n in enumerate(FEATURES)])
    held = table.filter("half = 1").select("kind", "label", m.alias("m")).select(
        "kind", "label", fitted.margin(F.col("m")).alias("margin"))
    return PiiModel(trees, *calibrate(held))


def _of_kind(number: int):
    return lambda c: c["passes"] & (c["kind"] == number)


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(
        ":", F.element_at(names, c["kind"] + 1), c["start"].cast("string"),
        c["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans,
    and ``redactions``, the selected spans as an array of (start, kind, end)."""
    model = model or fit(docs.select("text"))
    added = [k for k in ADDED if model.trees and model.cut(k) < float("inf")]
    kinds = (*BASE_KINDS, *added)
    rows = docs.select("doc_id", text_column(docs).alias("text"))
    rows = rows.withColumn("spans", candidates(F.col("text"), kinds))
    rows = rows.select("doc_id", F.array_sort(
        model.selected(F.col("text"), F.col("spans"))).alias("spans"))
    base = F.filter("spans", lambda c: c["passes"])
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{kind}")
              for k, kind in enumerate(BASE_KINDS)]
    names = F.array(*[F.lit(k) for k in KINDS])
    return rows.select(
        "doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.transform("spans", lambda c: F.struct(
            c["start"].alias("start"), F.element_at(names, c["kind"] + 1).alias("kind"),
            c["end"].alias("end"))).alias("redactions"))
