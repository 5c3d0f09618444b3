"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Every statement starts from the driver's tables through the same fixture
mapping as ``companion.sources.fixtures``; ``PRELUDE`` holds the shared
CTEs.  Counts and positions are ``bigint``, doubles are rounded to 6 places.
"""

from __future__ import annotations

from companion.plans.popularity import TOP_K
from companion.sources.fixtures import COMP_MAX_SIZE, MAIN_MIN_SIZE

K = TOP_K

PRELUDE = f"""
reviews AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS reviewerID,
         CAST(l.l_partkey AS VARCHAR) AS asin,
         CAST(ceil(l.l_quantity / 10) AS DOUBLE) AS overall
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
anchors AS (
  SELECT l.l_orderkey, min(l.l_partkey) AS base
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  WHERE p.p_size >= {MAIN_MIN_SIZE} GROUP BY l.l_orderkey),
pairs AS (
  SELECT DISTINCT CAST(a.base AS VARCHAR) AS asin,
         CAST(l.l_partkey AS VARCHAR) AS compProd
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  JOIN anchors a ON l.l_orderkey = a.l_orderkey
  WHERE p.p_size <= {COMP_MAX_SIZE}),
items AS (
  SELECT CAST(p_partkey AS VARCHAR) AS asin, p_name AS title,
         p_retailprice AS price, p_type AS category FROM part),
relation AS (
  SELECT asin, compProd FROM pairs
  UNION ALL
  SELECT asin, CAST(NULL AS VARCHAR) FROM items
  WHERE asin NOT IN (SELECT asin FROM pairs)),
metadata_lists AS (
  SELECT p.asin, list_sort(list(p.compProd)) AS also_bought FROM pairs p GROUP BY p.asin),
metadata_flat AS (
  SELECT i.asin, i.title, i.price, m.also_bought
  FROM items i LEFT JOIN metadata_lists m ON i.asin = m.asin),
meta_relation AS (
  SELECT m.asin, u.compProd FROM metadata_flat m
  LEFT JOIN LATERAL (SELECT unnest(m.also_bought) AS compProd) u ON true),
cat_reviews AS (
  SELECT r.reviewerID, r.asin, r.overall, i.category FROM reviews r JOIN items i ON r.asin = i.asin),
cat_meta AS (
  SELECT m.asin, m.also_bought, i.category FROM metadata_flat m JOIN items i ON m.asin = i.asin),
cat_relation AS (
  SELECT m.category, m.asin, u.compProd FROM cat_meta m
  LEFT JOIN LATERAL (SELECT unnest(m.also_bought) AS compProd) u ON true),
cat_per_product AS (
  SELECT category, asin, count(overall) AS n FROM cat_reviews GROUP BY category, asin),
cat_per_user AS (
  SELECT category, reviewerID, count(overall) AS n FROM cat_reviews
  WHERE reviewerID IS NOT NULL GROUP BY category, reviewerID),
cat_comp_user AS (
  SELECT category, reviewerID, count(DISTINCT asin) AS n FROM cat_reviews r
  WHERE reviewerID IS NOT NULL AND EXISTS (
    SELECT 1 FROM cat_relation c WHERE c.compProd = r.asin AND c.category = r.category
      AND c.asin IS NOT NULL)
  GROUP BY category, reviewerID),
cat_comp_base AS (
  SELECT category, asin, count(DISTINCT compProd) AS n FROM cat_relation c
  WHERE asin IS NOT NULL AND compProd IS NOT NULL AND EXISTS (
    SELECT 1 FROM cat_reviews r WHERE r.asin = c.compProd AND r.category = c.category)
  GROUP BY category, asin),
comp_ids AS (SELECT DISTINCT compProd AS asin FROM relation WHERE compProd IS NOT NULL),
base_ratings AS (
  SELECT reviewerID, asin AS productID, overall AS prodRating FROM reviews
  WHERE asin NOT IN (SELECT asin FROM comp_ids)),
comp_ratings AS (
  SELECT reviewerID, asin AS compProd, overall AS compRating FROM reviews
  WHERE asin IN (SELECT asin FROM comp_ids)),
pop AS (
  SELECT compProd, count(reviewerID) AS score FROM comp_ratings
  WHERE reviewerID IS NOT NULL AND compProd IS NOT NULL AND compRating IS NOT NULL
  GROUP BY compProd),
scores AS (
  SELECT r.asin, r.compProd, CAST(coalesce(p.score, 0) AS BIGINT) AS score
  FROM relation r LEFT JOIN pop p ON r.compProd = p.compProd
  WHERE r.asin IS NOT NULL AND r.compProd IS NOT NULL),
top AS (
  SELECT * FROM (
    SELECT asin, compProd, score,
           CAST(row_number() OVER (PARTITION BY asin ORDER BY score DESC, compProd) AS BIGINT) AS comp_pos
    FROM scores) WHERE comp_pos <= {K}),
pop_rated AS (
  SELECT reviewerID, productID, prodRating, count(*) AS copies FROM base_ratings
  WHERE reviewerID IS NOT NULL AND productID IS NOT NULL AND prodRating IS NOT NULL
    AND productID IN (SELECT asin FROM top)
  GROUP BY reviewerID, productID, prodRating),
pop_users AS (
  SELECT reviewerID, sum(copies) AS m,
         CASE WHEN sum(copies) > 1 THEN floor({K} / sum(copies)) ELSE {K} END AS quota
  FROM pop_rated GROUP BY reviewerID),
pop_picked AS (
  SELECT c.reviewerID, c.productID, c.prodRating, g.copy, t.comp_pos, t.compProd
  FROM pop_rated c JOIN pop_users u ON c.reviewerID = u.reviewerID
  CROSS JOIN LATERAL (SELECT unnest(range(1, c.copies + 1)) AS copy) g
  JOIN top t ON c.productID = t.asin
  WHERE u.quota >= 1 AND t.comp_pos <= u.quota),
pop_rec AS (
  SELECT u.reviewerID, n.pos, n.compProd FROM pop_users u LEFT JOIN (
    SELECT reviewerID, compProd,
           CAST(row_number() OVER (PARTITION BY reviewerID
                ORDER BY productID, prodRating, copy, comp_pos) AS BIGINT) AS pos
    FROM pop_picked) n ON u.reviewerID = n.reviewerID),
comp_mean AS (
  SELECT reviewerID, avg(compRating) AS avgRating FROM comp_ratings GROUP BY reviewerID),
pop_pos AS (
  SELECT c.reviewerID, c.compProd FROM comp_ratings c JOIN comp_mean m
    ON c.reviewerID = m.reviewerID WHERE c.compRating >= m.avgRating),
pop_neg AS (
  SELECT c.reviewerID, c.compProd FROM comp_ratings c JOIN comp_mean m
    ON c.reviewerID = m.reviewerID WHERE c.compRating < m.avgRating),
pop_sizes AS (SELECT reviewerID, count(*) AS n_target FROM pop_pos GROUP BY reviewerID),
pop_eval_users AS (
  SELECT s.reviewerID, s.n_target FROM pop_sizes s
  WHERE s.reviewerID IN (SELECT reviewerID FROM pop_rec)),
pop_flags AS (
  SELECT r.reviewerID, r.pos,
         r.compProd IN (SELECT compProd FROM pop_pos p WHERE p.reviewerID = r.reviewerID) AS hit,
         r.compProd IN (SELECT compProd FROM pop_neg q WHERE q.reviewerID = r.reviewerID) AS neg
  FROM pop_rec r WHERE r.pos IS NOT NULL
    AND r.reviewerID IN (SELECT reviewerID FROM pop_eval_users)),
pop_ideal AS (
  SELECT reviewerID, hit,
         row_number() OVER (PARTITION BY reviewerID ORDER BY cls, pos) AS ideal_pos
  FROM (SELECT reviewerID, pos, hit, 0 AS cls FROM pop_flags WHERE hit
        UNION ALL SELECT reviewerID, pos, hit, 1 FROM pop_flags WHERE NOT hit AND NOT neg
        UNION ALL SELECT reviewerID, pos, hit, 2 FROM pop_flags WHERE neg)),
pop_user_metrics AS (
  SELECT u.reviewerID,
         CAST(coalesce(h.hit, 0) AS BIGINT) AS hit,
         coalesce(h.hit, 0) / {float(K)} AS precision,
         coalesce(h.hit, 0) / u.n_target AS recall,
         coalesce(h.dcg, 0.0) AS dcg,
         coalesce(i.idcg, 0.0) AS idcg,
         CASE WHEN coalesce(i.idcg, 0.0) <> 0 THEN coalesce(h.dcg, 0.0) / i.idcg ELSE 0.0 END AS ndcg
  FROM pop_eval_users u
  LEFT JOIN (SELECT reviewerID, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS hit,
                    sum(CASE WHEN hit THEN ln(2) / ln(pos + 1) ELSE 0 END) AS dcg
             FROM pop_flags GROUP BY reviewerID) h ON u.reviewerID = h.reviewerID
  LEFT JOIN (SELECT reviewerID, sum(CASE WHEN hit THEN ln(2) / ln(ideal_pos + 1) ELSE 0 END) AS idcg
             FROM pop_ideal GROUP BY reviewerID) i ON u.reviewerID = i.reviewerID)
"""


def hist_sql(values: str, bins: int, by: str = "category") -> str:
    """numpy-rule histogram of ``values`` (a query giving ``[by,] v``)."""
    key = f"{by}, " if by else ""
    using = f"USING ({by})" if by else "ON true"
    edge = lambda i: (f"(CASE WHEN {i} = {bins} THEN hi "  # noqa: E731
                      f"ELSE {i} * ((hi - lo) / {float(bins)}) + lo END)")
    return f"""
      hv AS ({values}),
      hr AS (SELECT {key}
               CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
               CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi
             FROM hv WHERE v IS NOT NULL {"GROUP BY " + by if by else ""}),
      h1 AS (SELECT {key} v, lo, hi,
               CAST(trunc((v - lo) / (hi - lo) * {float(bins)}) AS BIGINT) AS i0
             FROM hv JOIN hr {using} WHERE v IS NOT NULL),
      h2 AS (SELECT *, CASE WHEN i0 = {bins} THEN {bins - 1} ELSE i0 END AS i1 FROM h1),
      h3 AS (SELECT *, CASE WHEN v < {edge("i1")} THEN i1 - 1 ELSE i1 END AS i2 FROM h2),
      h4 AS (SELECT {key} CASE WHEN v >= {edge("(i2 + 1)")} AND i2 <> {bins - 1}
                     THEN i2 + 1 ELSE i2 END AS bin FROM h3),
      hc AS (SELECT {key} bin, count(*) AS n FROM h4 GROUP BY {key} bin),
      hg AS (SELECT {key} lo, hi, unnest(range(0, {bins})) AS bin FROM hr)
    SELECT {key} CAST(g.bin AS BIGINT) AS bin,
           round({edge("g.bin")}, 6) AS lo, round({edge("(g.bin + 1)")}, 6) AS hi,
           CAST(coalesce(c.n, 0) AS BIGINT) AS n
    FROM hg g LEFT JOIN hc c USING ({key} bin)"""


def with_prelude(body: str) -> str:
    body = body.strip()
    if body.startswith("hv AS"):   # histogram bodies add their own CTEs
        return f"WITH {PRELUDE}, {body}"
    return f"WITH {PRELUDE}\n{body}"


COUNTS = """
  SELECT {key}
         CAST(count(*) FILTER (WHERE src = 'r') AS BIGINT) AS n_ratings,
         CAST(count(DISTINCT a) FILTER (WHERE src = 'r') AS BIGINT) AS n_users,
         CAST(count(DISTINCT b) FILTER (WHERE src = 'r') AS BIGINT) AS n_items,
         CAST(count(DISTINCT a) FILTER (WHERE src = 'm') AS BIGINT) AS n_bases,
         CAST(count(DISTINCT a) FILTER (WHERE src = 'c') AS BIGINT) AS n_comps
  FROM (SELECT {key} 'r' AS src, reviewerID AS a, asin AS b FROM {reviews}
        UNION ALL SELECT {key} 'm', asin, NULL FROM {meta}
        UNION ALL SELECT {key} 'c', compProd, NULL FROM {rel}) {group}"""

WHOLE_COUNTS = COUNTS.format(key="", reviews="reviews", meta="metadata_flat",
                             rel="meta_relation", group="")
CAT_COUNTS = COUNTS.format(key="category,", reviews="cat_reviews", meta="cat_meta",
                           rel="cat_relation", group="GROUP BY category")

SQL: dict[str, str] = {
    "project_reviews": "SELECT reviewerID, asin, overall FROM reviews",
    "flatten_metadata": """
        SELECT asin, title, round(price, 6) AS price,
               CAST(len(also_bought) AS BIGINT) AS n_also_bought,
               array_to_string(also_bought, ' ') AS also_bought_text
        FROM metadata_flat""",
    "companion_relation": """
        SELECT m.asin, u.compProd FROM metadata_flat m
        LEFT JOIN LATERAL (SELECT unnest(m.also_bought) AS compProd) u ON true""",
    "table_shape": "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(3 AS BIGINT) AS n_cols FROM reviews",
    "drop_incomplete": "SELECT asin, compProd FROM relation WHERE asin IS NOT NULL AND compProd IS NOT NULL",
    "base_ratings": "SELECT * FROM base_ratings",
    "comp_ratings": "SELECT * FROM comp_ratings",
    "companion_popularity": "SELECT compProd, CAST(score AS BIGINT) AS score FROM pop",
    "companion_scores": "SELECT asin, compProd, score FROM scores",
    "fill_missing_scores": """
        SELECT s.compProd, s.asin, CASE WHEN p.p_size <= 12 THEN s.score ELSE 0 END AS score
        FROM scores s JOIN part p ON s.compProd = CAST(p.p_partkey AS VARCHAR)""",
    "top_companions": "SELECT asin, compProd, score, comp_pos FROM top",
    "user_candidates": """
        SELECT b.reviewerID, b.productID, b.prodRating, t.comp_pos, t.compProd
        FROM base_ratings b JOIN top t ON b.productID = t.asin
        WHERE b.reviewerID IS NOT NULL AND b.prodRating IS NOT NULL""",
    "popularity_recommend": "SELECT reviewerID, pos, compProd FROM pop_rec",
    "user_mean_comp": "SELECT reviewerID, round(avgRating, 6) AS avgRating FROM comp_mean",
    "popularity_targets": """
        SELECT reviewerID, compProd, true AS positive FROM pop_pos
        UNION ALL SELECT reviewerID, compProd, false AS positive FROM pop_neg""",
    "user_metrics": """
        SELECT reviewerID, hit, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(dcg, 6) AS dcg, round(idcg, 6) AS idcg, round(ndcg, 6) AS ndcg
        FROM pop_user_metrics""",
    "popularity_evaluation": """
        SELECT CAST(count(*) AS BIGINT) AS n_users,
               CAST(count(*) FILTER (WHERE hit = 0) AS BIGINT) AS zero_hit,
               round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
               round(avg(ndcg), 6) AS ndcg
        FROM pop_user_metrics""",
    "ratings_per_product": """
        SELECT asin, CAST(count(overall) AS BIGINT) AS n_ratings FROM reviews GROUP BY asin""",
    "ratings_per_user": """
        SELECT reviewerID, CAST(count(overall) AS BIGINT) AS n_ratings FROM reviews
        WHERE reviewerID IS NOT NULL GROUP BY reviewerID""",
    "companions_per_user": """
        SELECT reviewerID, CAST(count(DISTINCT asin) AS BIGINT) AS n_companions FROM reviews
        WHERE reviewerID IS NOT NULL AND asin IN (
          SELECT compProd FROM meta_relation WHERE asin IS NOT NULL AND compProd IS NOT NULL)
        GROUP BY reviewerID""",
    "companions_per_base": """
        SELECT asin, CAST(count(DISTINCT compProd) AS BIGINT) AS n_companions FROM meta_relation
        WHERE asin IS NOT NULL AND compProd IS NOT NULL
          AND compProd IN (SELECT asin FROM reviews)
        GROUP BY asin""",
    "dataset_counts": WHOLE_COUNTS,
    "sparsity": f"""
        SELECT n_ratings, n_items, n_users,
               round(1.0 - n_ratings / (CAST(n_items AS DOUBLE) * n_users), 6) AS sparsity
        FROM ({WHOLE_COUNTS})""",
    "sketched_category_counts": """
        SELECT category, count(*) AS n_ratings, count(DISTINCT reviewerID) AS n_users,
               count(DISTINCT asin) AS n_items, true AS within FROM cat_reviews GROUP BY category
        UNION ALL SELECT 'all', count(*), count(DISTINCT reviewerID), count(DISTINCT asin), true
        FROM cat_reviews""",
    "category_stats": f"""
        SELECT *, round(1.0 - n_ratings / (CAST(n_items AS DOUBLE) * n_users), 6) AS sparsity
        FROM ({CAT_COUNTS})""",
    "hist_rating": hist_sql("SELECT category, overall AS v FROM cat_reviews", 10),
    "hist_per_product": hist_sql("SELECT category, n AS v FROM cat_per_product", 500),
    "hist_per_user": hist_sql("SELECT category, n AS v FROM cat_per_user", 200),
    "hist_companions_per_user": hist_sql("SELECT category, n AS v FROM cat_comp_user", 100),
    "hist_companions_per_base": hist_sql("SELECT category, n AS v FROM cat_comp_base", 100),
    "hist_rating_all": hist_sql("SELECT overall AS v FROM reviews", 10, by=""),
    "hit_count": "SELECT reviewerID, hit FROM pop_user_metrics",
    "ideal_order": """
        SELECT r.reviewerID, CAST(row_number() OVER (PARTITION BY r.reviewerID ORDER BY c.cls, r.pos)
                                  AS BIGINT) AS ideal_pos,
               r.compProd, CAST(c.cls AS BIGINT) AS cls
        FROM (SELECT reviewerID, pos, compProd,
                compProd IN (SELECT compProd FROM pop_pos p WHERE p.reviewerID = x.reviewerID) AS hit,
                compProd IN (SELECT compProd FROM pop_neg q WHERE q.reviewerID = x.reviewerID) AS neg
              FROM pop_rec x WHERE pos IS NOT NULL) r
        JOIN (SELECT 0 AS cls UNION ALL SELECT 1 UNION ALL SELECT 2) c
          ON (c.cls = 0 AND r.hit) OR (c.cls = 1 AND NOT r.hit AND NOT r.neg) OR (c.cls = 2 AND r.neg)""",
    "top_k_per_key": f"""
        SELECT * FROM (
          SELECT reviewerID, asin, overall,
                 CAST(row_number() OVER (PARTITION BY reviewerID ORDER BY overall DESC, asin) AS BIGINT) AS pos
          FROM reviews) WHERE pos <= {K}""",
    "rating_lists": """
        SELECT reviewerID,
               coalesce(string_agg(compProd, ' ' ORDER BY pos) FILTER (WHERE pos IS NOT NULL), '')
                 AS recommendation,
               CAST(count(pos) AS BIGINT) AS n_items
        FROM pop_rec GROUP BY reviewerID""",
    "records_roundtrip": "SELECT reviewerID, asin, overall FROM reviews",
    "metadata_records": "SELECT asin, compProd FROM meta_relation",
    "record_cases": """
        SELECT CAST(p_partkey AS VARCHAR) AS asin,
               CASE WHEN p_size <> 7 THEN 'Yes, None, True, ' || p_name
                 || ' \'\'n\'\' "q": null, [False] \\ it\'\'s ' || p_type END AS title,
               CAST(NULL AS BIGINT) AS n_records, CAST(NULL AS BIGINT) AS n_corrupt FROM part
        UNION ALL SELECT NULL, NULL, CAST(count(*) AS BIGINT),
               CAST(count(*) FILTER (WHERE p_size = 3) AS BIGINT) FROM part""",
    "open_metadata_records": """
        SELECT m.asin, m.title, round(m.price, 6) AS price, p.p_brand AS brand,
               p.p_type AS rank_type, CAST(p.p_size AS BIGINT) AS rank,
               CAST(len(m.also_bought) AS BIGINT) AS n_also_bought
        FROM metadata_flat m JOIN part p ON m.asin = CAST(p.p_partkey AS VARCHAR)""",
    "list_relations": """
        SELECT 'also_bought' AS list, asin, compProd FROM pairs
        UNION ALL SELECT 'also_viewed', CAST(p_partkey AS VARCHAR), CAST(p_partkey + step AS VARCHAR)
        FROM part, (VALUES (1), (2)) AS steps(step) WHERE p_size % 2 = 1
        UNION ALL SELECT 'bought_together', CAST(p_partkey AS VARCHAR), CAST(p_partkey * 2 AS VARCHAR)
        FROM part WHERE p_size % 3 = 0""",
    "metadata_keys": """
        SELECT 'record' AS level, key, CAST(count(*) AS BIGINT) AS n_records
        FROM part, (VALUES ('brand'), ('salesRank')) AS keys(key) GROUP BY key
        UNION ALL SELECT 'related', 'also_viewed', CAST(count(*) AS BIGINT) FROM part
        UNION ALL SELECT 'related', 'bought_together', CAST(count(*) AS BIGINT) FROM part""",
    "csv_roundtrip": """
        SELECT 'relation' AS "table", asin AS a, compProd AS b, CAST(NULL AS DOUBLE) AS rating
        FROM meta_relation
        UNION ALL SELECT 'base', reviewerID, productID, prodRating FROM base_ratings
        UNION ALL SELECT 'comp', reviewerID, compProd, compRating FROM comp_ratings""",
    "preprocess_summary": """
        SELECT 'relation' AS "table", CAST(count(*) AS BIGINT) AS n_rows, CAST(2 AS BIGINT) AS n_cols
        FROM meta_relation
        UNION ALL SELECT 'base', CAST(count(*) AS BIGINT), CAST(3 AS BIGINT) FROM base_ratings
        UNION ALL SELECT 'comp', CAST(count(*) AS BIGINT), CAST(3 AS BIGINT) FROM comp_ratings""",
}



def _digest(number: int, half: str) -> str:
    """The round function of the keyed permutation: 60 bits of a digest."""
    return (f"('0x' || substr(md5(concat_ws(':', '42', CAST(u AS VARCHAR), '{number}', "
            f"CAST({half} AS VARCHAR))), 1, 15))::BIGINT")


ALS_PRELUDE = f"""
active AS (SELECT reviewerID FROM comp_ratings GROUP BY reviewerID HAVING count(*) >= 2),
coh_main AS (
  SELECT DISTINCT reviewerID, productID, prodRating FROM base_ratings
  WHERE reviewerID IN (SELECT reviewerID FROM active)),
coh_comp AS (
  SELECT DISTINCT reviewerID, compProd, compRating FROM comp_ratings
  WHERE reviewerID IN (SELECT reviewerID FROM active)
    AND reviewerID IN (SELECT reviewerID FROM base_ratings)),
cohort AS (
  SELECT reviewerID, productID, prodRating FROM coh_main
  UNION ALL SELECT reviewerID, compProd, compRating FROM coh_comp),
item_ids AS (
  SELECT productID, CAST(row_number() OVER (ORDER BY productID) - 1 AS BIGINT) AS productID_int
  FROM (SELECT DISTINCT productID FROM cohort WHERE productID IS NOT NULL)),
user_ids AS (
  SELECT reviewerID, CAST(row_number() OVER (ORDER BY reviewerID) - 1 AS BIGINT) AS reviewerID_int
  FROM (SELECT DISTINCT reviewerID FROM base_ratings WHERE reviewerID IS NOT NULL)),
base_enc AS (
  SELECT u.reviewerID_int, i.productID_int, b.prodRating FROM base_ratings b
  JOIN user_ids u ON b.reviewerID = u.reviewerID JOIN item_ids i ON b.productID = i.productID),
comp_enc AS (
  SELECT DISTINCT u.reviewerID_int, i.productID_int, c.compRating FROM comp_ratings c
  JOIN user_ids u ON c.reviewerID = u.reviewerID JOIN item_ids i ON c.compProd = i.productID),
split_h AS (
  SELECT *, md5(concat_ws(':', '42', CAST(reviewerID_int AS VARCHAR),
                CAST(productID_int AS VARCHAR), CAST(compRating AS VARCHAR))) AS h,
         count(*) OVER (PARTITION BY reviewerID_int) AS n
  FROM (SELECT DISTINCT reviewerID_int, productID_int,
               CAST(trunc(compRating) AS BIGINT) AS compRating FROM comp_enc)),
split AS (
  SELECT reviewerID_int, productID_int, compRating,
         (row_number() OVER (PARTITION BY reviewerID_int ORDER BY h, productID_int, compRating) - 1)
           < floor(CAST(0.8 AS DOUBLE) * n) AS is_train
  FROM split_h),
train AS (
  SELECT reviewerID_int, productID_int, coalesce(CAST(trunc(prodRating) AS BIGINT), 0) AS prodRating
  FROM base_enc
  UNION ALL SELECT reviewerID_int, productID_int, coalesce(compRating, 0) FROM split WHERE is_train),
test AS (
  SELECT DISTINCT reviewerID_int, productID_int, compRating AS prodRating FROM split WHERE NOT is_train),
pool AS (
  SELECT productID_int, row_number() OVER (ORDER BY productID_int) - 1 AS idx
  FROM (SELECT DISTINCT productID_int FROM comp_enc)),
psize AS (SELECT count(*) AS p FROM pool),
tests AS (SELECT * FROM test WHERE reviewerID_int IN (SELECT reviewerID_int FROM train)),
wanted AS (SELECT reviewerID_int, count(*) AS t FROM tests GROUP BY reviewerID_int),
seen AS (
  SELECT DISTINCT s.reviewerID_int, p.idx FROM (
    SELECT reviewerID_int, productID_int FROM train
    UNION ALL SELECT reviewerID_int, productID_int FROM tests) s
  JOIN pool p ON s.productID_int = p.productID_int),
least_side AS (SELECT p, greatest(1, CAST(ceil(sqrt(p)) AS BIGINT)) AS least FROM psize),
side AS (
  SELECT p, a, (p + a - 1) // a AS b FROM (
    SELECT p, unnest(range(least, greatest(least, least(4 * least, (p + 1) // 2)) + 1)) AS a FROM least_side)
  ORDER BY a * ((p + a - 1) // a), a LIMIT 1),
counted AS (
  SELECT w.reviewerID_int, w.t, coalesce(s.s, 0) AS s FROM wanted w LEFT JOIN (
    SELECT reviewerID_int, count(*) AS s FROM seen GROUP BY reviewerID_int) s
  ON w.reviewerID_int = s.reviewerID_int),
round0 AS (
  SELECT c.reviewerID_int AS u, c.t, a, b, p, k, k // b AS l, k % b AS r
  FROM (SELECT c.*, d.a, d.b, d.p, unnest(range(0, least(d.a * d.b, c.t + c.s + d.a * d.b - d.p))) AS k
        FROM counted c CROSS JOIN side d) c),
round1 AS (SELECT * REPLACE ((l + {_digest(0, "r")} % a) % a AS l) FROM round0),
round2 AS (SELECT * REPLACE ((r + {_digest(1, "l")} % b) % b AS r) FROM round1),
round3 AS (SELECT * REPLACE ((l + {_digest(2, "r")} % a) % a AS l) FROM round2),
round4 AS (SELECT * REPLACE ((r + {_digest(3, "l")} % b) % b AS r) FROM round3),
negatives AS (
  SELECT d.u AS reviewerID_int, p.productID_int FROM (
    SELECT *, row_number() OVER (PARTITION BY u ORDER BY k) - 1 AS place FROM (
      SELECT u, t, k, l * b + r AS idx FROM round4 WHERE l * b + r < p) x
    WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.reviewerID_int = x.u AND s.idx = x.idx)) d
  JOIN pool p ON d.idx = p.idx WHERE d.place < d.t),
instances AS (
  SELECT reviewerID_int, productID_int, false AS is_negative FROM tests
  UNION ALL SELECT reviewerID_int, productID_int, true FROM negatives),
means AS (
  SELECT u.reviewerID_int, m.avgRating FROM (
    SELECT reviewerID, avg(prodRating) AS avgRating FROM cohort WHERE prodRating <> 0
    GROUP BY reviewerID) m JOIN user_ids u ON m.reviewerID = u.reviewerID),
als_pos AS (
  SELECT t.reviewerID_int, t.productID_int FROM test t JOIN means m
    ON t.reviewerID_int = m.reviewerID_int WHERE t.prodRating >= m.avgRating - 2.0),
als_neg AS (
  SELECT t.reviewerID_int, t.productID_int FROM test t JOIN means m
    ON t.reviewerID_int = m.reviewerID_int WHERE t.prodRating < m.avgRating - 2.0),
eligible AS (
  SELECT * FROM als_pos WHERE reviewerID_int IN (
    SELECT reviewerID_int FROM als_pos GROUP BY reviewerID_int HAVING count(*) >= 5)),
ideal_flags AS (
  SELECT i.reviewerID_int, i.productID_int, CAST(i.is_negative AS INTEGER) AS kind,
         EXISTS (SELECT 1 FROM als_pos e WHERE e.reviewerID_int = i.reviewerID_int
                                            AND e.productID_int = i.productID_int) AS hit,
         EXISTS (SELECT 1 FROM als_neg n WHERE n.reviewerID_int = i.reviewerID_int
                                           AND n.productID_int = i.productID_int) AS neg
  FROM instances i
  WHERE i.reviewerID_int IN (SELECT reviewerID_int FROM als_pos))
"""

ALS_SQL: dict[str, str] = {
    "active_users": "SELECT reviewerID FROM active",
    "cohort_ratings": "SELECT * FROM cohort",
    "item_index": "SELECT * FROM item_ids",
    "user_index": "SELECT * FROM user_ids",
    "growing_user_ids": """
        SELECT reviewerID, CAST(row_number() OVER (ORDER BY NOT early, reviewerID) - 1 AS BIGINT) AS reviewerID_int
        FROM (SELECT reviewerID, coalesce(bool_or(prodRating = 5), false) AS early FROM base_ratings
              WHERE reviewerID IS NOT NULL GROUP BY reviewerID)""",
    "encode_base": "SELECT * FROM base_enc",
    "encode_comp": "SELECT * FROM comp_enc",
    "holdout_split": "SELECT * FROM split",
    "training_set": """
        SELECT reviewerID_int, productID_int, prodRating, true AS is_train FROM train
        UNION ALL SELECT reviewerID_int, productID_int, prodRating, false FROM test""",
    "negative_samples": "SELECT * FROM instances",
    "user_mean_rating": "SELECT reviewerID_int, round(avgRating, 6) AS avgRating FROM means",
    "user_mean_of_rated": """
        SELECT reviewerID, round(avg(prodRating), 6) AS avgRating FROM cohort
        WHERE prodRating <> 0 AND prodRating <> 1 GROUP BY reviewerID""",
    "sampled_users": """
        SELECT w.reviewerID_int, CAST(w.t AS BIGINT) AS n_tests,
               CAST(least(w.t, (SELECT p FROM psize) - coalesce(s.s, 0)) AS BIGINT) AS n_negatives
        FROM wanted w LEFT JOIN (SELECT reviewerID_int, count(*) AS s FROM seen GROUP BY reviewerID_int) s
          ON w.reviewerID_int = s.reviewerID_int
        WHERE w.reviewerID_int % 3 <> 0""",
    "als_targets": """
        SELECT reviewerID_int, productID_int, true AS positive FROM als_pos
        UNION ALL SELECT reviewerID_int, productID_int, false FROM als_neg""",
    "eligible_targets": "SELECT * FROM eligible",
    "als_ideal_dcg": f"""
        SELECT reviewerID_int,
               round(sum(CASE WHEN hit THEN ln(2) / ln(r + 1) ELSE 0 END), 6) AS idcg
        FROM (
          SELECT *, row_number() OVER (PARTITION BY reviewerID_int
                                       ORDER BY cls, kind, productID_int) AS r
          FROM (
            SELECT reviewerID_int, productID_int, kind, hit, 0 AS cls FROM ideal_flags WHERE hit
            UNION ALL SELECT reviewerID_int, productID_int, kind, hit, 1 FROM ideal_flags
              WHERE NOT hit AND NOT neg
            UNION ALL SELECT reviewerID_int, productID_int, kind, hit, 2 FROM ideal_flags
              WHERE neg))
        WHERE r <= {K}
        GROUP BY reviewerID_int""",
    "als_user_metrics": f"""
        , positives AS (SELECT * FROM als_pos),
        drawn_score AS (
          SELECT reviewerID_int, productID_int, is_negative,
                 ('0x' || substr(md5(concat_ws(':', '7', CAST(reviewerID_int AS VARCHAR),
                                              CAST(productID_int AS VARCHAR))), 1, 15))::BIGINT AS score
          FROM instances),
        rec AS (
          SELECT * FROM (
            SELECT reviewerID_int, productID_int, row_number() OVER (
              PARTITION BY reviewerID_int ORDER BY score DESC, productID_int) AS pos
            FROM drawn_score) WHERE pos <= {K}),
        targets AS (SELECT reviewerID_int, count(*) AS n_target FROM positives GROUP BY reviewerID_int),
        flagged AS (
          SELECT r.*, EXISTS (SELECT 1 FROM positives e WHERE e.reviewerID_int = r.reviewerID_int
                                AND e.productID_int = r.productID_int) AS hit FROM rec r),
        lists AS (
          SELECT reviewerID_int, count(*) AS size, count(*) FILTER (WHERE hit) AS list_hit,
                 sum(CASE WHEN hit THEN ln(2) / ln(pos + 1) ELSE 0 END) AS dcg,
                 coalesce(1.0 / min(pos) FILTER (WHERE hit), 0) AS mrr
          FROM flagged GROUP BY reviewerID_int),
        found AS (
          SELECT p.reviewerID_int, count(*) AS t_hit FROM positives p WHERE EXISTS (
            SELECT 1 FROM rec r WHERE r.reviewerID_int = p.reviewerID_int
                                  AND r.productID_int = p.productID_int) GROUP BY p.reviewerID_int),
        flags AS (
          SELECT i.reviewerID_int, i.productID_int, CAST(i.is_negative AS INTEGER) AS kind,
                 EXISTS (SELECT 1 FROM positives e WHERE e.reviewerID_int = i.reviewerID_int
                           AND e.productID_int = i.productID_int) AS hit,
                 EXISTS (SELECT 1 FROM als_neg n WHERE n.reviewerID_int = i.reviewerID_int
                           AND n.productID_int = i.productID_int) AS neg
          FROM instances i),
        ideal AS (
          SELECT reviewerID_int, sum(CASE WHEN hit THEN ln(2) / ln(r + 1) ELSE 0 END) AS idcg
          FROM (
            SELECT *, row_number() OVER (PARTITION BY reviewerID_int
                                         ORDER BY cls, kind, productID_int) AS r
            FROM (
              SELECT *, 0 AS cls FROM flags WHERE hit
              UNION ALL SELECT *, 1 FROM flags WHERE NOT hit AND NOT neg
              UNION ALL SELECT *, 2 FROM flags WHERE neg))
          WHERE r <= {K} GROUP BY reviewerID_int),
        scored AS (
          SELECT l.reviewerID_int, t.n_target, l.dcg, coalesce(i.idcg, 0) AS idcg, l.mrr,
                 CAST(CASE WHEN t.n_target < l.size THEN coalesce(f.t_hit, 0) ELSE l.list_hit END
                      AS BIGINT) AS hit
          FROM lists l JOIN targets t ON l.reviewerID_int = t.reviewerID_int
          LEFT JOIN found f ON l.reviewerID_int = f.reviewerID_int
          LEFT JOIN ideal i ON l.reviewerID_int = i.reviewerID_int)
        SELECT reviewerID_int, hit, round(hit / CAST({K} AS DOUBLE), 6) AS precision,
               round(hit / CAST(n_target AS DOUBLE), 6) AS recall, round(dcg, 6) AS dcg,
               round(idcg, 6) AS idcg,
               round(CASE WHEN idcg <> 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg,
               round(mrr, 6) AS mrr
        FROM scored""",
    "als_scored_instances": """
        SELECT reviewerID_int, productID_int, is_negative FROM instances
        WHERE reviewerID_int IN (SELECT reviewerID_int FROM train)
          AND productID_int IN (SELECT productID_int FROM train)""",
    "als_list_sizes": f"""
        SELECT reviewerID_int, CAST(least({K}, count(*)) AS BIGINT) AS n_items, true AS distinct_positions
        FROM instances
        WHERE reviewerID_int IN (SELECT reviewerID_int FROM train)
          AND productID_int IN (SELECT productID_int FROM train)
        GROUP BY reviewerID_int""",
    "als_normal_equations": """
        SELECT reviewerID_int, CAST(count(*) AS BIGINT) AS n_ratings, true AS solved FROM train
        GROUP BY reviewerID_int""",
    "als_factor_scores": """
        SELECT reviewerID_int, productID_int, is_negative, true AS equals_model FROM instances
        WHERE reviewerID_int IN (SELECT reviewerID_int FROM train)
          AND productID_int IN (SELECT productID_int FROM train)""",
    "als_training_fit": """
        SELECT CAST(count(*) AS BIGINT) AS n_ratings, true AS fits_better_than_mean FROM train""",
    "ideal_instances": f"""
        SELECT reviewerID_int, CAST(r AS BIGINT) AS ideal_pos, productID_int, CAST(cls AS BIGINT) AS cls
        FROM (
          SELECT *, row_number() OVER (PARTITION BY reviewerID_int
                                       ORDER BY cls, kind, productID_int) AS r
          FROM (
            SELECT reviewerID_int, productID_int, kind, 0 AS cls FROM ideal_flags WHERE hit
            UNION ALL SELECT reviewerID_int, productID_int, kind, 1 FROM ideal_flags
              WHERE NOT hit AND NOT neg
            UNION ALL SELECT reviewerID_int, productID_int, kind, 2 FROM ideal_flags WHERE neg))
        WHERE r <= {K}""",
    "pack_ratings": """
        SELECT reviewerID_int, productID_int AS item,
               CAST(trunc(compRating) AS BIGINT) AS rating,
               '{"productID_int":' || productID_int || coalesce(
                 ',"compRating":' || CAST(trunc(compRating) AS BIGINT), '') || '}' AS packed
        FROM comp_enc""",
}


# the same rows from record files and CSVs
SQL["popularity_from_records"] = SQL["popularity_evaluation"]
ALS_SQL["als_targets_from_records"] = ALS_SQL["als_targets"]


def oracle_sql() -> dict[str, str]:
    out = {name: with_prelude(body) for name, body in SQL.items()}
    for name, body in ALS_SQL.items():
        out[name] = f"WITH {PRELUDE}, {ALS_PRELUDE}\n{body}"
    return out
