from companion import schemas
from companion.operators import cohort as C
from companion.plans.als import ALSConfig, ALSRun
from companion.plans.queries import inputs
from conftest import SF_TINY


def test_cohort_needs_two_companion_rows_and_a_base_row(spark):
    base = spark.createDataFrame(
        [("a", "b1", 4.0), ("a", "b1", 4.0), ("b", "b2", 3.0), ("c", "b1", 5.0)],
        schemas.BASE_RATINGS)
    comp = spark.createDataFrame(
        [("a", "c1", 5.0), ("a", "c1", 5.0),          # two rows, one distinct
         ("b", "c2", 2.0),                            # only one companion row
         ("d", "c1", 1.0), ("d", "c2", 2.0)],         # no base rating
        schemas.COMP_RATINGS)
    out = C.cohort_ratings(base, comp)
    assert sorted(map(tuple, out["main"].collect())) == [("a", "b1", 4.0)]
    assert sorted(map(tuple, out["comp"].collect())) == [("a", "c1", 5.0)]
    assert sorted(map(tuple, out["all"].collect())) == [("a", "b1", 4.0), ("a", "c1", 5.0)]


def test_user_ids_cover_all_base_raters_item_ids_the_cohort(spark):
    base = spark.createDataFrame([("a", "b1", 4.0), ("z", "b9", 1.0)], schemas.BASE_RATINGS)
    comp = spark.createDataFrame([("a", "c1", 5.0), ("a", "c2", 3.0)], schemas.COMP_RATINGS)
    cohort = C.cohort_ratings(base, comp)["all"]
    users = {r.reviewerID: r.reviewerID_int for r in C.user_index(base).collect()}
    items = {r.productID: r.productID_int for r in C.item_index(cohort).collect()}
    assert users == {"a": 0, "z": 1}
    assert items == {"b1": 0, "c1": 1, "c2": 2}
    enc = C.encode_base(base, C.user_index(base), C.item_index(cohort)).collect()
    assert [tuple(r) for r in enc] == [(0, 0, 4.0)]       # b9 is outside the cohort


def test_salted_ranks_change_nothing_end_to_end(spark):
    i = inputs(spark, SF_TINY)
    runs = [ALSRun(i["base"], i["comp"], ALSConfig(group_rows=g, materialize_inputs=False))
            .instances().out for g in (1 << 17, 3)]
    for name in ("split", "instances"):
        a, b = (sorted(map(tuple, r[name].collect())) for r in runs)
        assert a == b
