import contextlib
import io
import os

import pytest

from companion import session
from companion.plans.als import ALSRun
from companion.session import checkpoint_dir, materialize, run_tables
from conftest import shuffles, soon


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


class FakeCluster:
    """A session as ``checkpoint_dir`` sees it, without a configured folder."""

    def __init__(self, master):
        self.sparkContext, self.master = self, master

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return {}


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "spark://host:7077", "yarn"])
def test_only_a_local_process_gets_a_folder_of_its_own(master):
    with pytest.raises(RuntimeError, match="shared folder"):
        checkpoint_dir(FakeCluster(master))


def test_a_closed_run_leaves_no_folder(spark):
    with run_tables(spark) as folder:
        out = materialize(spark.range(5), "run-test")
        assert os.path.basename(folder) in out.inputFiles()[0] and out.count() == 5
        with run_tables(spark) as inner:
            materialize(spark.range(2), "inner-test")
        assert not os.path.exists(local(inner)) and os.path.exists(local(folder))
    assert not os.path.exists(local(folder))
    with pytest.raises(ZeroDivisionError):
        with run_tables(spark) as folder:
            materialize(spark.range(5), "run-test")
            1 / 0
    assert not os.path.exists(local(folder))


def test_a_written_table_leaves_no_shuffle(spark):
    before = shuffles(spark)
    counted = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    outs = [materialize(counted, f"no-shuffle-{i}") for i in range(3)]
    assert soon(lambda: not shuffles(spark) - before)
    assert all(out.where("count > 141").count() == 7 for out in outs)
    assert session._CLEANUP not in spark.conf.getAll


def test_steps_go_and_their_result_stays(spark):
    with run_tables(spark) as folder:
        with session.steps_removed(spark) as keep:
            step = materialize(spark.range(5), "step")
            with session.steps_removed(spark) as keep_inner:
                inner = keep_inner(materialize(step, "inner-step"), "inner")
            out = keep(inner.selectExpr("id + 1 AS id"), "result")
            assert inner.count() == 5
        assert [n.split("-")[0] for n in os.listdir(local(folder))] == ["result"]
        assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4, 5]
    assert not os.path.exists(local(folder))


def local(path):
    return path.removeprefix("file:")


def test_materialize_cuts_lineage_into_the_shared_folder(spark):
    df = spark.range(50).selectExpr("id", "id * 2 AS twice")
    out = materialize(df, "session-test")
    assert "FileScan parquet" in plan_of(out)
    assert checkpoint_dir(spark).replace("file:", "") .split("/")[1] in plan_of(out)
    assert sorted(r.twice for r in out.collect()) == [2 * i for i in range(50)]


def test_larger_stage_tables_are_not_broadcast(spark, monkeypatch):
    small = session.materialize(spark.range(100).withColumnRenamed("id", "k"), "small-side")
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1)
    large = session.materialize(spark.range(100).withColumnRenamed("id", "k"), "large-side")
    rows = spark.range(1000).withColumnRenamed("id", "k")
    plans = [rows.join(side, "k")._jdf.queryExecution().sparkPlan().toString() for side in (small, large)]
    assert "BroadcastHashJoin" in plans[0]
    assert "BroadcastHashJoin" not in plans[1] and "SortMergeJoin" in plans[1]
    assert rows.join(large, "k").count() == 100


def test_total_bytes_of_folders_and_patterns(spark, tmp_path):
    for name in ("a1", "a2", "b"):
        (tmp_path / name).write_text("12345")
    assert session.total_bytes(spark, str(tmp_path)) == 15
    assert session.total_bytes(spark, str(tmp_path / "a*")) == 10
    assert session.total_bytes(spark, str(tmp_path / "none*")) == 0


def test_tables_are_written_by_bounded_tasks(spark, monkeypatch):
    """Spark's own partition size gives way to the bound while a table is written, one that the
    session sets does not."""
    name, seen = "spark.sql.adaptive.advisoryPartitionSizeInBytes", []
    before = spark.conf.get(name)
    writer = type(spark.range(1).write)
    parquet = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path: (seen.append(spark.conf.get(name)), parquet(self, path)))
    run = ALSRun(None, None)
    run._keep(spark.range(3), "bounded")
    assert seen == [str(1 << 24)] and spark.conf.get(name) == before
    spark.conf.set(name, "32m")
    try:
        run._keep(spark.range(3), "bounded")
    finally:
        spark.conf.unset(name)
    assert seen[1:] == ["32m"]
