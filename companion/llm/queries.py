"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from companion.llm import (
    conversation_repair,
    decontaminate,
    language_id,
    licence_scan,
    mixing,
    nearest,
    pii,
    pivot_search,
    secrets_scan,
    simhash,
    toxicity,
    url_filter,
    whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).drop("redactions")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan_licences(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.find_secrets(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "labels"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by a checksum of conversation and turn.  A dropped row stays as
    a mark (no copies) of its conversation."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    kind, text = F.crc32(key) % 20, F.coalesce("text", space)
    dropped = kind == 0
    return conversations.select(
        "conv_id", F.when(~dropped, F.col("turn")).alias("turn"),
        F.when(dropped, space).when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(dropped, space).when(kind == 1, "").when(kind == 2, F.regexp_replace(
            text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(dropped, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.summarize(conversation_repair.repair(rows, copies="copies"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return pivot_search.top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_pii, op2_licence_scan, op3_nearest_neighbours, op4_secret_scan, op5_url_filter,
        op6_simhash_near_dedup, op7_decontamination, op8_language_id, op9_toxicity,
        op10_source_mixing, op11_conversation_repair, op12_exact_top_k, op13_embedding_whitening)
}

# Draws are digests, so the whole mix can be repeated: sizes, water level by one running
# sum over the sources, and per source the documents in draw order up to the fraction.
MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':'
              || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS draw
  FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
steps AS (
  SELECT *, source_size * CAST(2.0 AS DOUBLE) AS clamp, source_size * CAST(2.0 AS DOUBLE) / weight AS need
  FROM sources),
levels AS (
  SELECT *, row_number() OVER o AS place,
         (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(clamp) OVER b, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM steps
  WINDOW o AS (ORDER BY need, source NULLS LAST),
         b AS (ORDER BY need, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(level, place) AS level FROM levels WHERE level <= need),
targets AS (
  SELECT l.source, l.source_size, CASE WHEN f.level IS NULL OR l.need <= f.level THEN l.clamp
         ELSE f.level * l.weight END AS target
  FROM levels l CROSS JOIN final f),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id NULLS FIRST, s.size
                           ROWS UNBOUNDED PRECEDING) - s.size / CAST(2 AS DOUBLE) AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN target - whole * source_size > 0
                            AND middle <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""

# Words and windows as lists; a window is compared as its joined words.
DECONTAMINATION_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT d.r, s.n, i, array_to_string(d.w[i:i + s.n - 1], ' ') AS phrase
  FROM docs d, sizes s, unnest(range(1, len(d.w) - s.n + 2)) AS p(i) WHERE len(d.w) >= s.n),
hits AS (SELECT p.r, p.i, p.n, v.item_id FROM places p JOIN windows v ON p.n = v.n AND p.phrase = v.phrase),
covered AS (SELECT r, count(DISTINCT word) AS n_hit
            FROM (SELECT r, unnest(range(i, i + n)) AS word FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered c ON d.r = c.r LEFT JOIN found f ON d.r = f.r
"""

def licence_sql(known=licence_scan.KNOWN + licence_scan.TITLED) -> str:
    """The canonical form, digests and look-ups in SQL, over the same known texts.  Without
    look-ahead, a line is deleted if it starts like a notice and is not protected."""
    def canonical(text: str) -> str:
        out = f"""array_to_string(list_transform(string_split(lower({text}), chr(10)), lambda line:
            CASE WHEN regexp_matches(line, '{licence_scan.COPYRIGHT_LINE}')
                 AND NOT regexp_matches(line, '{licence_scan.PROTECTED_LINE}') THEN '' ELSE line END), chr(10))"""
        for written, usual in licence_scan.SPELLINGS:
            out = f"replace({out}, '{written}', '{usual}')"
        return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    values = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in known)
    return f"""
WITH given(licence, scope, text) AS (VALUES {values}),
known AS (SELECT scope, digest, string_agg(DISTINCT licence, '|' ORDER BY licence) AS licence
          FROM (SELECT scope, licence, sha256({canonical('text')}) AS digest FROM given) GROUP BY ALL),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
found AS (SELECT r, count(DISTINCT k.licence) AS n, string_agg(DISTINCT k.licence, ',' ORDER BY k.licence) AS ids
          FROM lines JOIN known k ON k.scope = 'notice' AND k.digest = sha256({canonical('line')}) GROUP BY r)
SELECT d.doc_id, k.licence, CAST(coalesce(f.n, 0) AS BIGINT) AS n_notices, coalesce(f.ids, '') AS notices
FROM docs d LEFT JOIN known k ON k.scope = 'text' AND k.digest = sha256({canonical('d.text')})
LEFT JOIN found f ON f.r = d.r
"""


def url_sql() -> str:
    """Rules, template tree and purity in SQL.  The tree is decided level by level, as one
    statement per level."""
    u = url_filter
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, kind)
            for kind, h, p in sorted(u.RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{name}'" for c, name, _ in fits) + " END"
    ruled = "CASE " + " ".join(f"WHEN {c} THEN '{kind}'" for c, _, kind in fits) + " END"
    levels, ways = [], []
    for d in range(u.DEPTH + 1):
        levels.append(f"""
nodes{d} AS (SELECT host, path[1:{d}] AS prefix, path[{d + 1}] AS segment, sum(urls) AS urls
             FROM level{d} WHERE len(path) > {d} GROUP BY ALL),
wild{d} AS (SELECT host, prefix, segment FROM (
              SELECT *, count(*) OVER w AS children, sum(urls) OVER w AS all_urls FROM nodes{d}
              WINDOW w AS (PARTITION BY host, prefix))
            WHERE children >= {u.MANY_CHILDREN} AND segment <> '*'
              AND urls < CAST({u.SMALL_SHARE} AS DOUBLE) * all_urls),
level{d + 1} AS (SELECT l.host, l.forms, l.urls, l.n, l.b,
                   CASE WHEN w.segment IS NULL THEN l.path
                        ELSE list_concat(l.path[1:{d}], ['*'], l.path[{d + 2}:]) END AS path
            FROM level{d} l LEFT JOIN wild{d} w ON len(l.path) > {d} AND l.host = w.host
             AND l.path[1:{d}] = w.prefix AND l.path[{d + 1}] = w.segment)""")
        ways.append(f"""
way{d + 1} AS (SELECT * EXCLUDE (p), CASE WHEN len(path) > {d + 1} THEN
              ((sum(b) OVER above - sum(b) OVER below) + CAST({u.SMOOTHING} AS DOUBLE) * ((p + 0.5::DOUBLE) / 2.0::DOUBLE))
              / ((sum(n) OVER above - sum(n) OVER below) + CAST({u.SMOOTHING} AS DOUBLE)) ELSE p END AS p
            FROM way{d} WINDOW above AS (PARTITION BY host, path[1:{d + 1}]),
                              below AS (PARTITION BY host, path[1:{d + 2}]))""")
    smoothing = f"CAST({u.SMOOTHING} AS DOUBLE)"
    return rf"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
formed AS (
  SELECT *, {rule} AS rule, {ruled} AS ruled, string_split(regexp_replace(array_to_string(list_transform(
    regexp_extract_all(path, '[0-9A-Za-z]+|[^0-9A-Za-z]+'),
    lambda x: CASE WHEN regexp_full_match(x, '[0-9a-fA-F]{{16,}}') THEN '{{h}}' ELSE x END), ''),
    '[0-9]+', '{{n}}', 'g'), '/') AS steps FROM cut),
rows AS (SELECT * EXCLUDE (steps), CASE WHEN len(steps) > {u.DEPTH}
           THEN list_append(steps[1:{u.DEPTH}], '**') ELSE steps END AS forms FROM formed),
level0 AS (
  SELECT host, forms, count(*) AS urls, count(ruled) AS n, count(*) FILTER (WHERE ruled = 'block') AS b,
         forms AS path FROM rows GROUP BY host, forms),{','.join(levels)},
way0 AS (SELECT host, path, sum(n) AS n, sum(b) AS b, 0.5::DOUBLE AS p
         FROM level{u.DEPTH + 1} GROUP BY host, path),{','.join(ways)},
branches AS (
  SELECT *, list_max(list_transform(range(1, len(path) + 1), lambda i: CASE WHEN path[i] <> ''
    AND NOT contains(path[i], '{{') AND path[i] <> '*' THEN i ELSE 0 END)) AS spot FROM way{u.DEPTH + 1}),
kin AS (SELECT *, array_to_string(CASE WHEN spot > 0 THEN list_concat(path[1:spot - 1], ['+'], path[spot + 1:])
                                  ELSE path END, '/') AS family FROM branches),
shares AS (SELECT host, family, sum(b) / sum(n)::DOUBLE AS share
           FROM kin WHERE n >= {u.MIN_LABELLED} GROUP BY host, family),
compared AS (
  SELECT k.*, coalesce(n >= {u.MIN_LABELLED} AND abs(b - n * share)
    <= CAST({u.Z} AS DOUBLE) * sqrt(n * share * (1 - share)), false) AS alike
  FROM kin k LEFT JOIN shares s ON k.host = s.host AND k.family = s.family),
merged AS (SELECT host, family, sum(n) AS mn, sum(b) AS mb FROM compared WHERE alike
           GROUP BY host, family HAVING count(*) > 1),
rated AS (
  SELECT c.host, c.path, CASE WHEN alike AND mn IS NOT NULL
           THEN (mb + {smoothing} * 0.5::DOUBLE) / (mn + {smoothing})
           ELSE (b + {smoothing} * ((p + 0.5::DOUBLE) / 2.0::DOUBLE)) / (n + {smoothing}) END AS purity
  FROM compared c LEFT JOIN merged m ON c.host = m.host AND c.family = m.family)
SELECT r.page_id, r.host, r.path, r.rule,
       coalesce(r.ruled, CASE WHEN t.purity >= CAST({u.REJECT} AS DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict,
       array_to_string(l.path, '/') AS template, t.purity
FROM rows r JOIN level{u.DEPTH + 1} l ON r.host = l.host AND r.forms = l.forms
JOIN rated t ON l.host = t.host AND l.path = t.path
"""


# The k best of one row's products with all others, by a running rank per query.
TOP_K_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(64 AS DOUBLE) * x) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ranked AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows q JOIN rows r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ranked)
WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {
    "op2_licence_scan": licence_sql(),
    "op5_url_filter": url_sql(),
    "op7_decontamination": DECONTAMINATION_SQL,
    "op10_source_mixing": MIXING_SQL,
    "op12_exact_top_k": TOP_K_SQL,
}
