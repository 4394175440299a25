"""Bandits, decision ledgers and diagnostics as aggregates and joins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.frames import Names, last, ordered


def arm_stats(df: DataFrame, arm: str, reward: str, arms: int, keys: Names = ()) -> DataFrame:
    """keys, arm, pulls, total, mean of every arm; 0 for those never pulled."""
    per = df.groupBy(*keys, arm).agg(F.count(F.lit(1)).alias("pulls"), F.sum(reward).alias("total"))
    every = df.sparkSession.range(arms).select(F.col("id").cast("int").alias(arm))
    if keys:
        every = per.select(*keys).distinct().withColumn(arm, F.explode(F.sequence(F.lit(0), F.lit(arms - 1))))
    full = every.join(per, [*keys, arm], "left")
    pulls, total = F.coalesce("pulls", F.lit(0)), F.coalesce("total", F.lit(0.0))
    return full.select(*keys, arm, pulls.cast("bigint").alias("pulls"), total.alias("total"), F.when(pulls > 0, total / pulls).otherwise(0.0).alias("mean"))


def greedy_arm(stats: DataFrame, arm: str, keys: Names = ()) -> DataFrame:
    """The arm of the best mean, the lowest among equals; arms never pulled come last."""
    best = F.max_by(F.col(arm), F.struct((F.col("pulls") > 0).cast("int"), F.col("mean"), -F.col(arm)))
    return stats.groupBy(*keys).agg(best.alias("greedy"), F.sum("pulls").alias("n"))


def epsilon_after(n: Column, epsilon: float = 0.1, decay: float = 1.0, least: float = 0.01) -> Column:
    return F.greatest(F.lit(float(least)), epsilon * F.pow(F.lit(float(decay)), n))


def ucb_scores(stats: DataFrame, c: float = 2.0, keys: Names = ()) -> DataFrame:
    """stats with the upper bound of each arm; null for arms never pulled, which go first."""
    n = F.sum("pulls").over(Window.partitionBy(*keys))
    return stats.withColumn("ucb", F.when(F.col("pulls") > 0, F.col("mean") + c * F.sqrt(2 * F.ln(F.when(n > 0, n)) / F.col("pulls"))))


def thompson_posterior(df: DataFrame, arm: str, reward: str, keys: Names = (), alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    per = df.groupBy(*keys, arm).agg(F.sum(reward).alias("_r"), F.count(F.lit(1)).alias("_n"))
    return per.select(*keys, arm, (F.lit(alpha) + F.col("_r")).alias("alpha"), (F.lit(beta) + F.col("_n") - F.col("_r")).alias("beta"))


def thompson_sample(posterior: DataFrame, seed: int = 0) -> DataFrame:
    """posterior with a draw for each arm, the same for the same seed, arm and posterior."""

    @F.pandas_udf("double")
    def draw(h: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, x & 0xFFFFFFFF, x >> 32 & 0xFFFFFFFF]).beta(p, q) for x, p, q in zip(h, a, b)], dtype=float)

    rest = [c for c in posterior.columns]
    return posterior.withColumn("draw", draw(F.xxhash64(*rest), "alpha", "beta"))


def linucb_state(df: DataFrame, arm: str, xs: Sequence[str], reward: str, keys: Names = ()) -> DataFrame:
    """keys, arm, a_ij and b_i: the identity plus sums of x x', and sums of reward times x."""
    a = [(F.sum(F.col(x) * F.col(y)) + float(i == j)).alias(f"a_{i}{j}") for i, x in enumerate(xs) for j, y in enumerate(xs) if i <= j]
    return df.groupBy(*keys, arm).agg(*a, *(F.sum(F.col(x) * F.col(reward)).alias(f"b_{i}") for i, x in enumerate(xs)))


def linucb_scores(rows: DataFrame, state: DataFrame, arm: str, xs: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """rows by arm with exploit, bonus and score. The state has a row for each arm, and is sent to all executors."""
    d = len(xs)

    @F.pandas_udf("exploit double, bonus double")
    def score(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.DataFrame:
        up = np.triu_indices(d)
        A = np.zeros((len(a), d, d))
        A[:, up[0], up[1]] = np.stack(a.to_numpy()) if len(a) else np.empty((0, len(up[0])))
        A[:, up[1], up[0]] = A[:, up[0], up[1]]
        B, X = (np.stack(s.to_numpy()) if len(s) else np.empty((0, d)) for s in (b, x))
        solved = np.linalg.solve(A, np.stack([B, X], -1))
        return pd.DataFrame({"exploit": (solved[:, :, 0] * X).sum(1), "bonus": alpha * np.sqrt(np.maximum(0, (solved[:, :, 1] * X).sum(1)))})

    packed = state.select(F.col(arm).alias("scored_arm"), F.array(*(f"a_{i}{j}" for i in range(d) for j in range(i, d))).alias("_a"), F.array(*(f"b_{i}" for i in range(d))).alias("_b"))
    met = rows.crossJoin(F.broadcast(packed)).withColumn("_s", score("_a", "_b", F.array(*xs)))
    return met.select(*rows.columns, "scored_arm", "_s.exploit", "_s.bonus", (F.col("_s.exploit") + F.col("_s.bonus")).alias("score"))


def choose(scored: DataFrame, row: Names) -> DataFrame:
    """The arm of the best score for each row, the lowest among equals."""
    return scored.groupBy(*row).agg(F.max_by("scored_arm", F.struct("score", -F.col("scored_arm"))).alias("chosen"))


def condition(state: DataFrame, arm: str, d: int) -> DataFrame:
    """state with the square of the largest by the smallest diagonal entry of the Cholesky factor."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series) -> pd.Series:
        out = []
        for u in a:
            m = np.zeros((d, d))
            m[np.triu_indices(d)] = u
            g = np.diag(np.linalg.cholesky(m + np.triu(m, 1).T))
            out.append((g.max() / g.min()) ** 2)
        return pd.Series(out, dtype=float)

    return state.select(arm, ratio(F.array(*(f"a_{i}{j}" for i in range(d) for j in range(i, d)))).alias("condition"))


# ---- decisions and feedback ------------------------------------------------------------------------------------------------


def register(decisions: DataFrame, order: str) -> DataFrame:
    """decisions with their receipt: Registered, Replay of the same facts, or DecisionConflict with the first ones."""
    facts = F.struct("context", "action", "created_at", "expires_at", "generation")
    w = ordered(["id"], [order])
    first = F.first(facts).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    receipt = F.when(F.row_number().over(w) == 1, "Registered").when(first.eqNullSafe(facts), "Replay").otherwise("DecisionConflict")
    return decisions.withColumn("receipt", F.when(F.col("expires_at") < F.col("created_at"), "InvalidExpiry").otherwise(receipt))


def feedback(decisions: DataFrame, outcomes: DataFrame, ledger: Names = (), max_completed: int | None = None, max_action_bytes: int | None = None) -> DataFrame:
    """outcomes(decision_id, action, reward, observed_at, generation, seq) with their status against registered decisions(id, ...).

    The checks come in a fixed order. Of the outcomes that pass, the first by seq completes the decision; all later ones are
    duplicates. One left join on the id; the checks are conditions on its row.

    max_completed: so many decisions of a ledger (columns of decisions) are completed, by seq; the others stay pending, and their
    outcomes that pass exceed the capacity. max_action_bytes: an outcome whose action, as text, takes more is too large.
    """
    if max_completed is not None and (max_completed < 1 or not ledger):
        raise ValueError("a capacity is at least 1 and counts by the columns of a ledger")
    if max_action_bytes is not None and max_action_bytes < 1:
        raise ValueError("an action has room for one byte at least")
    d = decisions.select(F.col("id").alias("decision_id"), *(F.col(c).alias(f"d_{c}") for c in ("action", "created_at", "expires_at", "generation")), *(F.col(c).alias(f"_ledger_{c}") for c in ledger), F.lit(True).alias("_known"))
    met = outcomes.join(d, "decision_id", "left")
    x = F.col("reward")
    early = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "NonFiniteReward")
    if max_action_bytes is not None:
        early = early.when(F.octet_length(F.col("action").cast("string")) > max_action_bytes, "ActionTooLarge")
    fault = (
        early.when(F.col("_known").isNull(), "UnknownDecision")
        .when(F.col("observed_at") < F.col("d_created_at"), "FeedbackBeforeDecision")
        .when(F.col("observed_at") > F.col("d_expires_at"), "FeedbackExpired")
        .when(F.col("generation") != F.col("d_generation"), "GenerationMismatch")
        .when(F.col("action") != F.col("d_action"), "ActionMismatch")
    )
    met = met.withColumns({"_early": early, "_fault": fault})
    of_decision = ordered(["decision_id"], ["seq"])
    done = F.coalesce(F.max(F.col("_fault").isNull()).over(of_decision.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    met = met.withColumns({"_done": done, "_kept": F.lit(True)})
    if max_completed is not None:
        first = F.col("_fault").isNull() & ~F.col("_done")
        rank = F.sum(first.cast("bigint")).over(ordered([f"_ledger_{c}" for c in ledger], ["seq"]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        met = met.withColumn("_over", first & (rank > max_completed))
        met = met.withColumn("_kept", ~F.max("_over").over(Window.partitionBy("decision_id")))
    again = F.col("_early").isNull() & F.col("_done") & F.col("_kept")
    passed = F.when(F.col("_kept"), "Completed").otherwise("CompletedCapacityExceeded")
    status = F.when(again, "DuplicateFeedback").otherwise(F.coalesce("_fault", passed))
    return met.withColumn("status", status).drop("_early", "_fault", "_known", "_done", "_kept", "_over", *(f"_ledger_{c}" for c in ledger))


def clear_expired(decisions: DataFrame, completed: DataFrame, now: Column) -> DataFrame:
    """The decisions without a completed outcome whose time is over."""
    return decisions.join(completed.select(F.col("decision_id").alias("id")), "id", "left_anti").filter(F.col("expires_at") < now)


def clear_completed_before(completed: DataFrame, before: Column) -> DataFrame:
    """The completed decisions whose outcome was observed before a time."""
    return completed.filter(F.col("observed_at") < before)


def bounded(df: DataFrame, column: str, most_bytes: int) -> DataFrame:
    """The rows whose value takes no more than so many bytes."""
    return df.filter(F.octet_length(column) <= most_bytes)


def latency(df: DataFrame, lag: str, keys: Names) -> DataFrame:
    """n, lo, hi, mean and p95 of feedback delays: p95 is the element at ceil((n - 1) * 95 / 100) in order."""
    xs = F.sort_array(F.collect_list(lag))
    per = df.groupBy(*keys).agg(xs.alias("_xs"), F.avg(lag).alias("lag_mean"))
    at = F.ceil((F.size("_xs") - 1) * 95 / 100).cast("int")
    return per.select(*keys, F.size("_xs").cast("bigint").alias("n"), F.get("_xs", F.lit(0)).alias("lag_min"), F.get("_xs", F.size("_xs") - 1).alias("lag_max"), "lag_mean", F.get("_xs", at).alias("lag_p95"))


def recommend(df: DataFrame, keys: Names, action: str, reward: str) -> DataFrame:
    """For each partition: the action of the best mean reward, of fewest pulls among equals, then the first; its share of pulls."""
    per = df.groupBy(*keys, action).agg(F.count(F.lit(1)).alias("pulls"), F.avg(reward).alias("mean"))
    best = F.max_by(F.struct(F.col(action), F.col("pulls")), F.struct("mean", -F.col("pulls"), -F.col(action)))
    out = per.groupBy(*keys).agg(best.alias("_b"), F.sum("pulls").alias("_all"))
    return out.select(*keys, F.col(f"_b.{action}").alias("recommended"), (F.col("_b.pulls") / F.col("_all")).alias("confidence"))


# ---- diagnostics -----------------------------------------------------------------------------------------------------------


def leaders(df: DataFrame, keys: Names, order: str, t: str, preds: Sequence[str], window: int = 50) -> DataFrame:
    """df with each model's mean error over the last rows, the leading model (first among equals) and whether the lead changed."""
    w, line = last(keys, [order], window), ordered(keys, [order])
    out = df.withColumns({f"mae_{i}": F.avg(F.abs(F.col(t) - F.col(p))).over(w) for i, p in enumerate(preds)})
    low = F.least(*(f"mae_{i}" for i in range(len(preds)))) if len(preds) > 1 else F.col("mae_0")
    lead = F.coalesce(*(F.when(F.col(f"mae_{i}") == low, i) for i in range(len(preds))))
    out = out.withColumn("leader", lead)
    return out.withColumn("lead_changed", ~F.col("leader").eqNullSafe(F.lag("leader").over(line)))


def warmup_state(n: Column, recent: Column, baseline: Column, usable: int = 5, stable: int = 100) -> Column:
    return F.when(n == 0, "NoData").when(n < usable, "WarmingUp").when(recent > 2 * baseline, "Degraded").when((n >= stable) & (recent <= baseline), "Stable").otherwise("Usable")


def confidence(state: Column, beats: Column) -> Column:
    return F.when(state == "NoData", "None").when(state.isin("WarmingUp", "Degraded"), "Low").when((state == "Stable") & beats, "High").otherwise("Medium")


def model_health(df: DataFrame, keys: Names, weights: str) -> DataFrame:
    """keys, n_parameters, lo, hi, n_nan, n_inf, bytes, healthy of models' weight arrays."""
    each = df.select(*keys, F.explode(weights).alias("w"))
    fine = F.when(~F.isnan("w") & (F.abs("w") != float("inf")), F.col("w"))
    out = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_parameters"), F.min(fine).alias("lo"), F.max(fine).alias("hi"), F.sum(F.isnan("w").cast("bigint")).alias("n_nan"), F.sum((F.abs("w") == float("inf")).cast("bigint")).alias("n_inf"))
    return out.withColumns({"bytes": F.col("n_parameters") * 8, "healthy": (F.col("n_nan") + F.col("n_inf")) == 0})
