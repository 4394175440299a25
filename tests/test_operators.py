"""Golden traces, error policies and oracles of the stream operators."""

import json
import math
from types import SimpleNamespace as Row

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions import columns as C
from tidemark.operators import decisions as B
from tidemark.operators import drift as D
from tidemark.operators import features as P
from tidemark.operators import stats as S
from tidemark.operators import steps as K
from tidemark.operators.fold import Reject, fold_rows, run_batch

SF = "/root/testdata/sf0.001"


def last(step, rows):
    state = step.init()
    for r in rows:
        out = step.step(state, r)
    return state, out


def test_linear_sgd_trace():
    rows = [Row(features=(1, 2), y=3), Row(features=(4, 5), y=6), Row(features=(2, 1), y=4)]
    s, _ = last(K.Linear(2, rate=0.1, l2=0.01), rows)
    assert np.allclose(s.w, [0.9790403, 1.3881705999999998], atol=1e-12) and math.isclose(s.b, 0.49012000000000006)


def test_ftrl_traces():
    s, _ = last(K.Ftrl(), [Row(features=[(0, 1.0), (2, 2.0)], y=5), Row(features=[(0, 1.0), (2, 2.0)], y=-1)])
    assert math.isclose(s.z[0], -3.8009110918132905) and math.isclose(s.n[2], 106.86128932014591) and math.isclose(s.bz, -3.828564651208793)
    s, _ = last(K.Ftrl(classify=True), [Row(features=[(0, 1.0), (2, -1.0)], y=1), Row(features=[(0, 1.0), (2, -1.0)], y=0)])
    assert math.isclose(s.z[0], 0.007811864279204439) and math.isclose(s.n[0], 0.5078728895027211) and math.isclose(s.bz, -0.05864188931623926)


def test_ftrl_at_its_cap():
    rows = [Row(features=[(i, 1.0)], y=1) for i in range(3)]
    with pytest.raises(Reject):
        last(K.Ftrl(most=2), rows)
    assert last(K.Ftrl(most=2, ignore=True), rows)[1][2] == 2


def test_ew_mean_trace():
    assert math.isclose(last(K.EwMean(0.3), [Row(x=i / 2) for i in range(10)])[0].m, 3.3804125414999993)


def test_linucb_trace():
    step = K.LinUcb(2, 3, 1.5)
    s = step.init()
    for arm, x, r in ((0, (1, 0.5, 0.2), 1), (1, (0.3, 0.7, 0.9), 0.5), (0, (0.8, 0.1, 0.4), 0.9)):
        step.update(s, arm, np.array(x, float), r)
    assert np.allclose(np.linalg.inv(s.inv[0]), [[2.64, 0.58, 0.52], [0.58, 1.26, 0.14], [0.52, 0.14, 1.2]])
    assert np.allclose(s.b[0], (1.72, 0.59, 0.56)) and np.allclose(s.b[1], (0.15, 0.35, 0.45))


def test_selector_can_miss_a_switch_while_it_cools():
    rows = [Row(y=1.0, preds=(1.0, 5.0))] * 10 + [Row(y=1.0, preds=(5.0, 1.0))] * 20
    assert last(K.Selector(2, 5, 1, 100), rows)[1][:2] == (1, 0)
    assert last(K.Selector(2, 5, 1, 2), rows)[1][:2] == (1, 1)


def votes(*levels):
    return Row(votes=[(f"d{i}", x, True) for i, x in enumerate(levels)], generation=1)


def test_consensus_confirms_and_clears():
    step = K.Consensus(warning_votes=1, drift_votes=2, confirm=2, clear=2, warming=0)
    s = step.init()
    assert [step.step(s, votes(*v))[0] for v in (("Drift", "None", "None"), ("Drift", "Drift", "None"))] == ["None", "None"]
    got = step.step(s, votes("Drift", "Drift", "None"))
    assert got[0] == "Drift" and got[3]
    assert [step.step(s, votes("None", "None"))[0] for _ in range(2)] == ["Drift", "None"]
    with pytest.raises(Reject):
        step.step(s, Row(votes=[("a", "None", True), ("a", "None", True)], generation=1))


def record(kind, **own):
    base = dict(kind=kind, timestamp=1, decision_id=1, context=(1.0,), selected_arm=0, outcome_time=5, reward=0.75, generation=0, schema_hash="", baseline_reward=None, optimal_reward=1.0, drift=False)
    return Row(**(base | own))


def test_replay_counts():
    step = K.Replay(K.LinUcb(2, 1), 100)
    rows = [record(0), record(0, decision_id=2, outcome_time=None), record(1), record(1), record(0, decision_id=3, schema_hash="other")]
    s, out = last(step, rows)
    assert (s.reward, s.regret, len(s.pending), len(s.done), s.missing, s.duplicate, s.rejected) == (0.75, 0.25, 1, 1, 1, 1, 1)
    assert out[12] == 4.0 and len(out[-1]) == 16
    late = [record(0), record(1, outcome_time=500)]
    assert last(step, late)[0].expired == 1


def test_replay_emits_one_row_a_key_from_unmerged_partitions(spark):
    class Marked(K.EwMean):
        def step(self, state, row):
            if row.x < 0:
                raise Reject("negative")
            return super().step(state, row)

    rows = spark.range(25_000).select(F.floor(F.col("id") % 7 / 3).alias("user_id"), F.col("id").alias("seq"), F.when(F.col("id") > 24_980, -1.0).otherwise(F.col("id") % 11).cast("double").alias("v"))
    rows = rows.unionByName(spark.range(3).select(F.lit(9).cast("bigint").alias("user_id"), F.col("id").alias("seq"), F.lit(-1.0).alias("v")))
    more = {"x": F.col("v")}
    each, end = (run_batch(rows, Marked(0.3), ["user_id"], ["seq"], more, final) for final in (False, True))
    top = each.groupBy("user_id").agg(F.max_by(F.struct("seq", "ew"), "seq").alias("r")).select("user_id", "r.seq", "r.ew")
    assert sorted(end.collect()) == sorted(top.collect()) and end.count() == 3
    plan = queries.QUERIES["b17_replay"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_quantile_markers_come_near_the_exact_ones():
    r = np.random.default_rng(1)
    xs = r.normal(size=4000)
    _, ((got,),) = None, (last(K.P2((0.1, 0.5, 0.9)), [Row(x=x) for x in xs])[1],)
    assert np.allclose(got, np.quantile(xs, [0.1, 0.5, 0.9]), atol=0.08)
    assert last(K.P2((0.5,)), [Row(x=x) for x in (3, 1, 2)])[1] == ([2.0],)


def test_adwin_and_page_hinkley_see_a_shift():
    r = np.random.default_rng(42)
    xs = [*r.normal(0, 0.1, 100), *r.normal(5, 0.1, 100)]
    for step in (K.Adwin(), K.PageHinkley()):
        s, at = step.init(), []
        for i, x in enumerate(xs):
            if step.step(s, Row(x=x))[0] == "Drift":
                at.append(i)
        assert at and min(at) >= 100


def test_drift_aware_model_resets_on_drift():
    step = K.DriftAware(K.Linear(1, rate=0.2), K.PageHinkley(5, 2, least=5))
    s = step.init()
    out = [step.step(s, Row(features=(1.0,), y=y)) for y in [1.0] * 60 + [9.0] * 10]
    assert any(x[3] == "ResetModel" for x in out[60:]) and all(x[3] == "NotifyOnly" for x in out[:60])


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_rejected_rows_leave_the_state(bad):
    step = K.EwMean(0.5)
    state, out = fold_rows(step, step.init(), pd.DataFrame({"x": [1.0, bad, 3.0]}, dtype=object))
    assert state.m == 2.0 and [x[0] for x in out] == [0, 2]


def test_ks_statistic_steps_once_on_ties():
    assert D.ks_statistic([1, 1, 1], [1]) == pytest.approx(2 / 3)
    assert D.ks_statistic([1, 2, 3], [4, 5]) == 1.0


def test_error_policies(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, float("inf"))], "seq int, x double")
    assert [r.seq for r in C.accepted(df, "x").collect()] == [1]
    assert {r.seq: r.error for r in C.rejected(df, "x").collect()} == {2: "x: NaN", 3: "x: missing", 4: "x: infinite"}
    with pytest.raises(Exception, match="not finite"):
        C.accepted(df, "x", on_error="fail").collect()
    assert S.ew_mean and pytest.raises(ValueError, S.ew_mean, F.col("a"), F.col("b"), 0)


def test_hashing_keeps_sums_and_signs(spark):
    df = spark.createDataFrame([([(1, 2.0), (2, 3.0), (99, -1.0)],)], "f array<struct<id:bigint,value:double>>")
    row = df.select(P.hashed(F.col("f"), 8, 3, False).alias("v"), P.hashed(F.col("f"), 8, 3).alias("w")).first()
    one = spark.range(64).select("id", P.hashed(F.array(F.struct("id", F.lit(1.0).alias("value"))), 8, 3).alias("u"))
    unit = {x.id: np.array(x.u) for x in one.withColumn("id", F.when(F.col("id") == 0, 99).otherwise(F.col("id"))).collect()}
    assert len(row.v) == 8 and sum(row.v) == 4.0
    assert all(np.abs(u).sum() == 1 for u in unit.values()) and {u.sum() for u in unit.values()} == {-1.0, 1.0}
    with pytest.raises(ValueError):
        P.hashed(F.col("f"), 0)


def test_names_that_meet_are_merged(spark):
    df = spark.createDataFrame([(1, [(7, 1.0), (3, 2.0), (7, 0.5)]), (2, []), (3, None)], "k int, f array<struct<id:bigint,value:double>>")
    got = {x.k: x.m and [tuple(f) for f in x.m] for x in df.select("k", P.merged(F.col("f")).alias("m")).collect()}
    assert got == {1: [(3, 2.0), (7, 1.5)], 2: [], 3: None}


def test_feedback_keeps_to_its_capacities(spark):
    d = spark.createDataFrame([(i, "go", 0, 100, 1, i % 2) for i in range(6)], "id int, action string, created_at int, expires_at int, generation int, user int")
    rows = [(0, "go", 1.0, 1), (2, "go", 1.0, 2), (4, "go", 1.0, 3), (0, "go", 1.0, 4), (4, "go", 1.0, 5), (4, "no", 1.0, 6), (1, "gone", 1.0, 7), (1, "go", 1.0, 8), (0, "gone", 1.0, 9), (9, "go", 1.0, 10), (3, "go", float("nan"), 11)]
    o = spark.createDataFrame([(i, a, x, seq, 1, seq) for i, a, x, seq in rows], "decision_id int, action string, reward double, observed_at int, generation int, seq int")
    status = lambda *a: [x.status for x in B.feedback(d, o, *a).orderBy("seq").collect()]
    over, large = "CompletedCapacityExceeded", "ActionTooLarge"
    assert status(["user"], 2, 3) == ["Completed", "Completed", over, "DuplicateFeedback", over, "ActionMismatch", large, "Completed", large, "UnknownDecision", "NonFiniteReward"]
    assert status()[2:9] == ["Completed", "DuplicateFeedback", "DuplicateFeedback", "DuplicateFeedback", "ActionMismatch", "Completed", "DuplicateFeedback"]
    assert B.feedback(d, o, ["user"], 2, 3).columns == B.feedback(d, o).columns
    for bad in ([], 2), (["user"], 0), ([], None, 0):
        with pytest.raises(ValueError):
            B.feedback(d, o, *bad)


def test_shuffled_partitions_give_equal_results(spark):
    s = queries.stream(spark, SF).select("user_id", "seq", "x")
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(run_batch(s, K.EwMean(0.3), ["user_id"], ["seq"])) == key(run_batch(s.repartition(7, F.rand(1)), K.EwMean(0.3), ["user_id"], ["seq"]))


NAMES = sorted(queries.ORACLE)


@pytest.mark.parametrize("name", NAMES[:: max(1, len(NAMES) // 24)])
def test_queries_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = queries.QUERIES[name](spark, SF)
    sql = c.execute(queries.ORACLE[name])
    names = [x[0] for x in sql.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda x: None if x is None or x != x else round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else x
    order = sorted(names)
    assert sorted(repr([plain(r[n]) for n in order]) for r in got.collect()) == sorted(repr([plain(r[names.index(n)]) for n in order]) for r in sql.fetchall())


def test_replay_report_sorts_no_outputs_and_equals_sql(spark):
    plan = queries.QUERIES["b18_replay_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("MapInArrow")[0] and plan.count("Sort [") == 2 and plan.count("MapInArrow") == 1
    test_queries_against_sql(spark, "b18_replay_report")


def test_snapshots_and_schemas(spark):
    from tidemark.sources import snapshots as N

    assert N.from_json(N.to_json({"w": [1.0]})) == {"w": [1.0]}
    with pytest.raises(ValueError):
        N.from_json(json.dumps({"format_version": 9, "model": {}}))
    docs = N.snapshots(spark.createDataFrame([([0.5, -0.25], 1.0)], "weights array<double>, intercept double"))
    assert N.restored(docs, "weights array<double>, intercept double").first().weights == [0.5, -0.25]
    assert tuple(N.inspect(docs).first()) == (1, 2, -0.25, 0.5)
    a = N.schema_hash(1, [N.Feature("x", lo=0.0), N.Feature("y")])
    assert a != N.schema_hash(1, [N.Feature("x", lo=0.1), N.Feature("y")]) and len(a) == 64
    with pytest.raises(ValueError):
        N.ensure_schema(a, "other")


def test_replay_logs_round_trip(spark, tmp_path):
    from tidemark.sources import replay

    log = spark.createDataFrame([(10, "a", [1.0, 2.0], 0, 15, 0.5, 1, "h", None, 1.0, False), (20, "b", [0.0], 1, 12, None, 1, "h", None, None, True)], replay.SCHEMA)
    replay.write_json(log, f"{tmp_path}/json")
    replay.write_csv(log, f"{tmp_path}/csv")
    assert sorted(map(repr, replay.read(spark, f"{tmp_path}/json").collect())) == sorted(map(repr, log.collect())) == sorted(map(repr, replay.read_csv(spark, f"{tmp_path}/csv").collect()))
    assert [r.fault for r in replay.faults(log).collect()] == ["latency"]
    with pytest.raises(TypeError):
        replay.numeric(log, "generation")


def test_batch_and_stream_are_equal(spark, tmp_path):
    from tidemark.streaming import streams

    rows = queries.regression(queries.stream(spark, SF))
    rows.repartitionByRange(3, "seq").write.parquet(f"{tmp_path}/in")
    step = K.Linear(2, rate=0.1, scale=True)
    stream = streams.progressive(streams.file_stream(spark, f"{tmp_path}/in", 100), step, ["user_id"], ["seq"])
    got = streams.drain(stream, f"{tmp_path}/check", f"{tmp_path}/out")
    key = lambda df: sorted(map(repr, df.select("user_id", "seq", "pred").collect()))
    assert key(got) == key(run_batch(rows, step, ["user_id"], ["seq"]))


def test_decisions_meet_delayed_feedback_in_a_stream(spark, tmp_path):
    from tidemark.streaming import streams

    d = queries.stream(spark, SF).select(F.col("seq").alias("id"), F.col("ts").cast("timestamp").alias("created_at"))
    o = d.filter("id % 3 = 0").select(F.col("id").alias("decision_id"), (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("observed_at"), F.lit(1.0).alias("reward"))
    d.write.parquet(f"{tmp_path}/d")
    o.write.parquet(f"{tmp_path}/o")
    out = streams.drain(streams.matched(streams.file_stream(spark, f"{tmp_path}/d", 10), streams.file_stream(spark, f"{tmp_path}/o", 10), "2 HOURS"), f"{tmp_path}/check")
    assert out.filter("reward IS NOT NULL").count() == o.count()


def test_thompson_draws_repeat(spark):
    post = spark.createDataFrame([(0, 5.0, 2.0), (1, 1.0, 1.0)], "arm int, alpha double, beta double")
    a, b = (sorted(map(repr, B.thompson_sample(post, 3).collect())) for _ in range(2))
    assert a == b and all(0 < r.draw < 1 for r in B.thompson_sample(post, 3).collect())
