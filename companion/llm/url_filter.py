"""URL filter: fixed rules, and a path-template tree for what they leave open.

Rules are (verdict, host, path): a rule fits its host and all subdomains when the
url's path starts with the rule's; the longest fitting rule decides.

Method, for the other urls.  Per host, paths form a tree of segments.  Segments
that vary are generalised: runs of digits and long hexadecimal strings by their
form, and, from the root down, below a node with many children every child that
carries a small share of its urls becomes ``*``; what lies below children that
became ``*`` is counted together before the next level is decided.  The tree has
``DEPTH`` levels; what a path has beyond them is one segment ``**``.

Branches that differ in their last literal segment only are siblings; labelled
siblings whose share of blocked urls does not differ significantly from the family's
are merged and share their counts.  A template is rejected when its smoothed purity,
(blocked + A * pull) / (labelled + A), reaches ``REJECT``.  The pull of a merged branch
is undecided (a half).  That of any other lies half way from undecided to the
purity of the node above, smoothed in the same way up to the host, from the labels
that are not below the node itself: each label counts once, what is said elsewhere on
the host weakens with every level, and a template without labels follows its
surroundings.  Labels are the rules' own verdicts, and a table of judged urls where
there is one.

Scale: urls are first counted by (host, generalised path), with map-side partial
aggregation, so a host with a third of all urls sends each task's distinct paths
only; the tree is built over those counts.  A round gives every path its next wildcard,
so there are as many rounds as a path has wildcards, at most one a level.  Counts that are
joined back are written first, so both sides of a join are plain shuffles whose large
partitions Spark can split.  DataFrame functions only.

Defined cases: a null url or one without ``://`` has empty host and path, fits no
rule and is judged like a host of its own; an empty path is a tree's root; equal
urls get equal verdicts; a null page_id keeps its row; an empty table gives no
rows; without any label nothing is rejected; a url may have any number of
segments; other columns are ignored whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from companion.llm.common import ascii_lower
from companion.session import materialize

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEPTH = 16
MANY_CHILDREN = 20
SMALL_SHARE = 0.02
MIN_LABELLED = 5
Z = 1.96
SMOOTHING = 10.0
REJECT = 0.7


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule written as host + path, verdict), null where no rule fits."""
    name = verdict = None
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = (F.when if name is None else name.when)(fits, F.lit(rule_host + rule_path))
        verdict = (F.when if verdict is None else verdict.when)(fits, F.lit(kind))
    return name, verdict


def forms(path: Column) -> Column:
    """Segments with digit runs and long hexadecimal strings replaced by their form, and
    those beyond the tree's depth by one."""
    hexed = F.regexp_replace(path, r"(?<![0-9A-Za-z])[0-9a-fA-F]{16,}(?![0-9A-Za-z])", "{h}")
    parts = F.split(F.regexp_replace(hexed, "[0-9]+", "{n}"), "/")
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit("**")))
                  ).otherwise(parts)


def nodes(paths: DataFrame) -> DataFrame:
    """One row per path and depth: its parent (a running hash) and segment."""
    steps = F.aggregate(
        F.col("path"), F.expr("named_struct('parent', 0L, 'out', cast(array() as array<bigint>))"),
        lambda acc, s: F.struct(F.xxhash64(acc["parent"], s).alias("parent"),
                                F.concat(acc["out"], F.array(acc["parent"])).alias("out")))
    return paths.withColumn("parents", steps["out"]).select(
        "template_id", "host", "urls", F.posexplode(F.arrays_zip("parents", "path")).alias(
            "depth", "node")).select(
        "template_id", "host", "urls", "depth", F.col("node.parents").alias("parent"),
        F.col("node.path").alias("segment"))


def template_key(host: Column, form: Column) -> Column:
    """Key of a generalised path: 128 bits of a digest."""
    return F.md5(F.concat_ws("\x00", host, F.array_join(form, "/")))


def generalise(counted: DataFrame) -> DataFrame:
    """(template_id, host, path): wildcards where a node's children vary.

    A round replaces the uppermost segment of each path that is due, so whatever lies
    above a decision is final and nodes below a wildcard are one node."""
    paths = counted.select("template_id", "host", "urls", F.col("forms").alias("path"))
    while True:
        each = materialize(nodes(paths), "url-nodes")
        children = materialize(each.groupBy("host", "parent", "segment").agg(
            F.sum("urls").alias("urls")), "url-children")
        totals = children.groupBy("host", "parent").agg(
            F.count("*").alias("children"), F.sum("urls").alias("all_urls")).filter(
            F.col("children") >= MANY_CHILDREN)
        rare = materialize(children.filter("segment <> '*'").join(totals, ["host", "parent"]).filter(
            F.col("urls") < SMALL_SHARE * F.col("all_urls")).select(
            "host", "parent", "segment"), "url-wildcards")
        if rare.isEmpty():
            return paths.drop("urls")
        due = each.join(rare, ["host", "parent", "segment"]).groupBy("template_id").agg(
            F.min("depth").alias("due"))
        paths = materialize(paths.join(due, "template_id", "left").withColumn(
            "path", F.transform("path", lambda s, i: F.when(i == F.col("due"), "*").otherwise(s))
        ).drop("due"), "url-paths")


def smoothed(blocked: Column, labelled: Column, pull: Column) -> Column:
    return (blocked + F.lit(SMOOTHING) * pull) / (labelled + F.lit(SMOOTHING))


def half_way(purity: Column) -> Column:
    return (purity + F.lit(0.5)) / F.lit(2.0)


def pulls(branches: DataFrame) -> DataFrame:
    """(template_key, pull) of every template: the purity of the nodes above it, from the
    labels beside the way down to it, weakened by every level."""
    prefixes = branches.select(
        "template_key", "host", "n", "b", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.size("path")), lambda d: template_key(
                F.col("host"), F.slice("path", F.lit(1), d)))).alias("depth", "node"))
    prefixes = materialize(prefixes, "url-prefixes")
    counts = materialize(prefixes.groupBy("node").agg(
        F.sum("n").alias("node_n"), F.sum("b").alias("node_b")), "url-node-counts")
    # at most DEPTH + 1 nodes to a template
    way = prefixes.join(counts, "node").groupBy("template_key").agg(F.array_sort(F.collect_list(
        F.struct("depth", "node_n", "node_b"))).alias("way"))
    beside = F.zip_with(
        F.slice("way", F.lit(1), F.size("way") - 1), F.slice("way", F.lit(2), F.size("way")),
        lambda above, below: F.struct((above["node_n"] - below["node_n"]).alias("n"),
                                      (above["node_b"] - below["node_b"]).alias("b")))
    purity = F.aggregate(F.filter(beside, lambda x: x.isNotNull()), F.lit(0.5),
                         lambda p, x: smoothed(x["b"], x["n"], half_way(p)))
    return way.select("template_key", half_way(purity).alias("pull"))


def family(path: Column) -> Column:
    """``path`` with its last literal segment replaced by ``+``."""
    literal = F.transform(path, lambda s, i: F.when(
        (s != "") & ~s.contains("{") & (s != "*"), i).otherwise(-1))
    last = F.array_max(literal)
    return F.transform(path, lambda s, i: F.when((i == last) & (last >= 0), F.lit("+")).otherwise(s))


def judge(labelled: DataFrame) -> DataFrame:
    """Verdict of every template: template_id, template, purity, verdict.

    ``labelled`` holds host, forms and label (1 block, 0 allow, null unknown) per url."""
    counted = materialize(labelled.groupBy("host", "forms").agg(
        F.count("*").alias("urls"), F.count("label").alias("labelled"),
        F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")).withColumn(
        "template_id", template_key(F.col("host"), F.col("forms"))), "url-counts")
    named = generalise(counted).join(counted.select("template_id", "labelled", "blocked"), "template_id")
    branch = materialize(named.withColumn("template", F.array_join("path", "/")).withColumn(
        "family", F.array_join(family(F.col("path")), "/")).withColumn(
        "template_key", template_key(F.col("host"), F.col("path"))), "url-templates")
    pooled = materialize(branch.groupBy("template_key").agg(
        F.first("host").alias("host"), F.first("family").alias("family"), F.first("path").alias("path"),
        F.sum("labelled").alias("n"), F.sum("blocked").alias("b")), "url-branches")
    families = materialize(pooled.filter(F.col("n") >= MIN_LABELLED).groupBy("host", "family").agg(
        F.sum("n").alias("fn"), F.sum("b").alias("fb")), "url-families")
    share = F.col("fb") / F.col("fn")
    # within Z standard deviations; a family of one opinion has no variance
    near = F.abs(F.col("b") - F.col("n") * share) <= Z * F.sqrt(F.col("n") * share * (1 - share))
    alike = (F.col("n") >= MIN_LABELLED) & near
    compared = materialize(pooled.drop("path").join(families, ["host", "family"], "left").withColumn(
        "alike", F.coalesce(alike, F.lit(False))), "url-compared")
    merged = materialize(compared.filter("alike").groupBy("host", "family").agg(
        F.sum("n").alias("mn"), F.sum("b").alias("mb"), F.count("*").alias("members")).filter(
        "members > 1"), "url-merged")
    joined = compared.join(merged, ["host", "family"], "left").join(
        materialize(pulls(pooled), "url-pulls"), "template_key")
    purity = F.when(F.col("alike") & F.col("mn").isNotNull(),
                    smoothed(F.col("mb"), F.col("mn"), F.lit(0.5))).otherwise(
        smoothed(F.col("b"), F.col("n"), F.col("pull")))
    rated = materialize(joined.select("template_key", purity.alias("purity")), "url-rated")
    return branch.select("template_id", "template", "template_key").join(rated, "template_key").select(
        "template_id", "template", "purity",
        F.when(F.col("purity") >= REJECT, "block").otherwise("allow").alias("judged"))


def filter_urls(pages: DataFrame, rules=RULES, judged: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    ``judged`` (url, blocked) adds labelled urls to those that the rules decide."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), forms(F.col("path")).alias("forms"))
    label = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    labelled = rows.select("host", "forms", label.alias("label"))
    if judged is not None:
        more_host, more_path = parts(F.col("url"))
        labelled = labelled.unionByName(judged.select(
            more_host.alias("host"), forms(more_path).alias("forms"),
            F.col("blocked").cast("int").alias("label")))
    templates = materialize(judge(labelled), "url-verdicts")
    keyed = rows.withColumn("template_id", template_key(F.col("host"), F.col("forms")))
    return keyed.join(templates, "template_id", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"),
        "template", "purity")
