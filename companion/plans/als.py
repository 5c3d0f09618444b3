"""PL3: ALS companion recommender and its evaluation.

Stages (each a lazy DataFrame unless noted):

``prepare``    cohort, dense ids, encoded ratings
``split``      per-user 80/20 hold-out, train / test sets
``instances``  test items plus sampled unseen items per user
``targets``    positives (rating >= user mean - 2) and negatives
``fit``        ALS model (runs the training jobs), top-K recommendations
``factors``    the model as written relations of user and item factors
``evaluate``   per-user metrics and the one-row summary

Stage methods are idempotent: a stage already run is not run again.
Outputs reused by later stages (inputs, encoded ratings, split, instances,
recommendations) are written once as tables in the shared checkpoint
folder, and so are the model and its predictions; the rest stays lazy.  Tables
that a stage writes on the way to its output are removed when that is written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from companion.operators import als as A
from companion.operators import cohort as C
from companion.operators import evaluation as E
from companion.operators import targets as TG
from companion.operators.negatives import scoring_instances
from companion.operators.ranking import DEFAULT_GROUP_ROWS
from companion.operators.split import holdout_split, training_set
from companion.session import bounded_partitions, collect_garbage, materialize, steps_removed

# Fixed values of the reference's experiment.
TOP_K = 5
MIN_COMP_RATINGS = 2
TRAIN_FRACTION = 0.8
TARGET_OFFSET = 2.0


@dataclass
class ALSConfig:
    k: int = TOP_K
    seed: int = 42
    min_comp: int = MIN_COMP_RATINGS
    frac: float = TRAIN_FRACTION
    offset: float = TARGET_OFFSET
    min_targets: int | None = None        # default: k
    rank: int = A.RANK
    max_iter: int = A.MAX_ITER
    reg_param: float = A.REG_PARAM
    num_blocks: int | None = None     # default: from the number of ratings
    checkpoint_interval: int = A.CHECKPOINT_INTERVAL
    fill_missing: bool = True         # a missing training rating becomes 0, else the row goes
    mean_source: str = "cohort"       # ratings of the user mean: "cohort" or "train"
    group_rows: int = DEFAULT_GROUP_ROWS
    materialize: bool = True          # write stage outputs to the shared folder
    materialize_inputs: bool = True   # off when the inputs are already tables


@dataclass
class ALSRun:
    base: DataFrame
    comp: DataFrame
    cfg: ALSConfig = field(default_factory=ALSConfig)
    out: dict = field(default_factory=dict)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        """Stage output reused downstream: written once to the shared folder."""
        if not self.cfg.materialize:
            return df
        with bounded_partitions(df.sparkSession):
            return materialize(df, name)

    def _result(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """Stage output as ``_keep`` writes it; tables that ``make`` writes are removed."""
        if not self.cfg.materialize:
            return make()
        spark = self.base.sparkSession
        with steps_removed(spark) as keep:
            df = make()
            with bounded_partitions(spark):
                return keep(df, name)

    def prepare(self) -> "ALSRun":
        if "comp_enc" in self.out:
            return self
        base, comp = self.base, self.comp
        if self.cfg.materialize_inputs:
            base = self._keep(base, "als-base")
            comp = self._keep(comp, "als-comp")
        # the cohort feeds the item ids and the user means: written once
        cohort = self._result("als-cohort", lambda: C.cohort_ratings(
            base, comp, self.cfg.min_comp)["all"])
        items = C.item_index(cohort)
        users = C.user_index(base)
        self.out.update(
            cohort=cohort, items=items, users=users,
            base_enc=self._keep(C.encode_base(base, users, items), "als-base-enc"),
            comp_enc=self._keep(C.encode_comp(comp, users, items), "als-comp-enc"))
        return self

    def split(self) -> "ALSRun":
        if "split" in self.out:
            return self
        self.prepare()
        split = self._result("als-split", lambda: holdout_split(
            self.out["comp_enc"], "reviewerID_int", "productID_int", "compRating",
            self.cfg.frac, self.cfg.seed, self.cfg.group_rows))
        train, test = training_set(self.out["base_enc"], split, self.cfg.fill_missing)
        self.out.update(split=split, train=train, test=test)
        return self

    def instances(self) -> "ALSRun":
        if "instances" in self.out:
            return self
        self.split()
        pool = self.out["comp_enc"].select("productID_int").distinct()
        self.out["instances"] = self._result("als-instances", lambda: scoring_instances(
            self.out["test"], self.out["train"], pool, self.cfg.seed,
            group_rows=self.cfg.group_rows))
        return self

    def targets(self) -> "ALSRun":
        if "eligible" in self.out:
            return self
        self.split()
        if self.cfg.mean_source == "train":
            means = TG.user_mean(self.out["train"], "reviewerID_int", "prodRating", nonzero=True)
        else:
            means = (TG.user_mean(self.out["cohort"], "reviewerID", "prodRating", nonzero=True)
                     .join(self.out["users"], "reviewerID")
                     .select("reviewerID_int", "avgRating"))
        labels = self._keep(TG.label_targets(
            self.out["test"], means, "reviewerID_int", "productID_int", "prodRating",
            self.cfg.offset), "als-targets")
        pos = labels.where("positive").select("reviewerID_int", "productID_int")
        neg = labels.where("not positive").select("reviewerID_int", "productID_int")
        need = self.cfg.min_targets if self.cfg.min_targets is not None else self.cfg.k
        self.out.update(means=means, positives=pos, negatives=neg,
                        eligible=TG.keep_users_with_at_least(pos, "reviewerID_int", need))
        return self

    def fit(self) -> "ALSRun":
        if "recommendations" in self.out:
            return self
        self.instances()
        model = A.fit_als(self.out["train"], self.cfg.rank, self.cfg.max_iter,
                          self.cfg.reg_param, self.cfg.seed, num_blocks=self.cfg.num_blocks,
                          checkpoint_interval=self.cfg.checkpoint_interval)
        if self.cfg.materialize:
            model = A.stored_model(model, self.base.sparkSession)
            collect_garbage(self.base.sparkSession)
        pred = self._keep(A.predict(model, self.out["instances"].select(
            "reviewerID_int", "productID_int")), "als-predictions")
        self.out.update(model=model, predictions=pred,
                        recommendations=self._keep(A.recommend(pred, self.cfg.k),
                                                   "als-recommendations"))
        return self

    def factors(self) -> "ALSRun":
        if "user_factors" in self.out:
            return self
        self.fit()
        self.out["user_factors"], self.out["item_factors"] = A.factor_tables(self.out["model"])
        return self

    def evaluate(self) -> "ALSRun":
        if "summary" in self.out:
            return self
        self.fit()
        self.targets()
        inst = self.out["instances"].withColumn(
            "_kind", self.out["instances"]["is_negative"].cast("int"))
        per_user = self._result("als-user-metrics", lambda: E.als_user_metrics(
            self.out["recommendations"], self.out["eligible"], self.out["negatives"],
            inst, self.cfg.k, instance_order=["_kind", "productID_int"]))
        self.out.update(user_metrics=per_user,
                        summary=E.summarize(per_user, with_mrr=True))
        return self


def als_pipeline(base: DataFrame, comp: DataFrame,
                 cfg: ALSConfig | None = None) -> dict:
    """Run every stage; returns the named outputs (``summary`` is one row)."""
    return ALSRun(base, comp, cfg or ALSConfig()).evaluate().out
