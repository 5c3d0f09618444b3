import random

from companion import schemas
from companion.operators import popularity as P
from companion.operators import targets as TG
from companion.plans.popularity import popularity_pipeline


def brute_recommend(base, comp, rel, k):
    """Straight Python statement of the popularity recommender."""
    score = {}
    for _, c, r in comp:
        if c is not None and r is not None:
            score[c] = score.get(c, 0) + 1
    lists = {}
    for b, c in rel:
        if b is not None and c is not None:
            lists.setdefault(b, []).append((-score.get(c, 0), c))
    top = {b: [c for _, c in sorted(v)[:k]] for b, v in lists.items()}
    per_user = {}
    for u, p, r in sorted(x for x in base if None not in x):
        if p in top:
            per_user.setdefault(u, []).append(top[p])
    out = {}
    for u, ls in per_user.items():
        quota = k if len(ls) == 1 else k // len(ls)
        out[u] = [c for lst in ls for c in lst[:quota]]
    return out


def as_lists(rec_df):
    out = {}
    for r in rec_df.collect():
        out.setdefault(r.reviewerID, [])
        if r.pos is not None:
            out[r.reviewerID].append((r.pos, r.compProd))
    return {u: [c for _, c in sorted(v)] for u, v in out.items()}


def test_matches_brute_force_on_random_data(spark):
    rnd = random.Random(7)
    bases = [f"b{i}" for i in range(6)]
    comps = [f"c{i}" for i in range(12)]
    rel = list({(rnd.choice(bases), rnd.choice(comps)) for _ in range(30)})
    base = [(f"u{rnd.randrange(15)}", rnd.choice(bases + ["x"]), float(rnd.randint(1, 5)))
            for _ in range(60)]
    comp = [(f"u{rnd.randrange(15)}", rnd.choice(comps), float(rnd.randint(1, 5)))
            for _ in range(80)]
    for k in (1, 3, 5):
        rec = P.popularity_recommend(
            spark.createDataFrame(base, schemas.BASE_RATINGS),
            spark.createDataFrame(rel, schemas.RELATION),
            spark.createDataFrame(comp, schemas.COMP_RATINGS), k)
        assert as_lists(rec) == brute_recommend(base, comp, rel, k)


def test_more_bases_than_k_gives_empty_list(spark):
    rel = [(f"b{i}", "c") for i in range(7)]
    base = [("u", f"b{i}", 5.0) for i in range(7)] + [("v", "b0", 5.0)]
    rec = P.popularity_recommend(spark.createDataFrame(base, schemas.BASE_RATINGS),
                                 spark.createDataFrame(rel, schemas.RELATION),
                                 spark.createDataFrame([("w", "c", 1.0)], schemas.COMP_RATINGS), 5)
    assert as_lists(rec) == {"u": [], "v": ["c"]}


def test_repeated_base_rating_repeats_its_list(spark):
    rel = [("b", "c1"), ("b", "c2"), ("b", "c3")]
    base = [("u", "b", 5.0), ("u", "b", 5.0)]
    comp = [("w", "c1", 1.0), ("w", "c1", 2.0), ("w", "c2", 1.0)]
    rec = P.popularity_recommend(spark.createDataFrame(base, schemas.BASE_RATINGS),
                                 spark.createDataFrame(rel, schemas.RELATION),
                                 spark.createDataFrame(comp, schemas.COMP_RATINGS), 5)
    assert as_lists(rec) == {"u": ["c1", "c2", "c1", "c2"]}


def test_ties_broken_by_companion_id_and_unrated_scores_zero(spark):
    rel = [("b", "z"), ("b", "a"), ("b", "m")]
    scores = P.companion_scores(spark.createDataFrame(rel, schemas.RELATION),
                                spark.createDataFrame([("w", "m", 1.0)], schemas.COMP_RATINGS))
    top = P.top_companions(scores, 3).orderBy("comp_pos").collect()
    assert [(r.compProd, r.score) for r in top] == [("m", 1), ("a", 0), ("z", 0)]


def test_popularity_targets_use_user_mean(spark):
    comp = [("u", "a", 5.0), ("u", "b", 1.0), ("u", "c", 3.0), ("u", "d", None)]
    labels = TG.popularity_labels(spark.createDataFrame(comp, schemas.COMP_RATINGS)).collect()
    assert sorted(r.compProd for r in labels if r.positive) == ["a", "c"]
    assert sorted(r.compProd for r in labels if not r.positive) == ["b"]


def test_pipeline_summary_counts_empty_lists(spark):
    rel = [(f"b{i}", "c") for i in range(7)] + [("b0", "d")]
    base = [("u", f"b{i}", 5.0) for i in range(7)] + [("v", "b0", 5.0)]
    comp = [("u", "c", 5.0), ("v", "c", 5.0), ("v", "d", 1.0)]
    out = popularity_pipeline(spark.createDataFrame(base, schemas.BASE_RATINGS),
                              spark.createDataFrame(comp, schemas.COMP_RATINGS),
                              spark.createDataFrame(rel, schemas.RELATION), 5)
    s = out["summary"].first()
    # u: empty list, one positive -> zero hit; v: list [c, d], positive c
    assert (s.n_users, s.zero_hit) == (2, 1)
    assert abs(s.precision - (0 + 1 / 5) / 2) < 1e-12
    assert abs(s.recall - (0 + 1.0) / 2) < 1e-12
    assert abs(s.ndcg - (0 + 1.0) / 2) < 1e-12
