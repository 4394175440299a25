"""Named queries over the test tables, one or more for each operator, and the SQL that gives the same rows.

All read the events table as a stream of each user's events. Numbers are rounded so that engines that add in another order agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import decisions as B
from .operators import drift as D
from .operators import features as P
from .operators import models as M
from .operators import stats as S
from .operators import steps as K
from .operators.fold import dealt, run_batch
from .plans.frames import last, prior, upto
from .sources import snapshots as N
from .streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

KEYS, ORDER = ["user_id"], ["seq"]
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

#: The same derivations for Spark and for SQL; {prior} means a user's rows before this one.
STREAM = """
WITH e AS (SELECT event_id AS seq, user_id, event_type, ts, value AS x, CAST(hour(ts) AS DOUBLE) AS h, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
  event_type = 'purchase' AS y, CAST(event_id % 4 AS DOUBLE) AS w, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS xm,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS arm,
  least(value / 500.0, 1.0) AS reward, event_id // 100 AS t FROM events),
s AS (SELECT *, coalesce(avg(x) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pred,
  coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY seq), 0) AS pred2, x > 250 AS yhat, least(x / 500.0, 1.0) AS prob FROM e)
"""


def stream(spark: SparkSession, sf_dir: str, live: bool = False) -> DataFrame:
    """The events of a data folder, as a table or (live) as a file stream."""
    at = f"{sf_dir}/events.parquet"
    e = streams.file_stream(spark, at, 100) if live else spark.read.parquet(at)
    arm = F.coalesce(*(F.when(F.col("event_type") == t, i) for i, t in enumerate(EVENT_TYPES[:-1])), F.lit(4))
    x = F.col("value")
    s = e.select(
        F.col("event_id").alias("seq"), "user_id", "event_type", "ts", x.alias("x"), F.hour("ts").cast("double").alias("h"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"), (F.col("event_type") == "purchase").alias("y"),
        (F.col("event_id") % 4).cast("double").alias("w"), F.when(F.col("event_id") % 7 != 0, x).alias("xm"), arm.alias("arm"),
        F.least(x / 500, F.lit(1.0)).alias("reward"), F.floor(F.col("event_id") / 100).alias("t"),
    )
    return C.accepted(s, "x")


def with_predictions(s: DataFrame) -> DataFrame:
    x = F.col("x")
    return s.withColumns({"pred": M.mean_regressor(x, KEYS, ORDER), "pred2": M.last_value_regressor(x, KEYS, ORDER), "yhat": x > 250, "prob": F.least(x / 500, F.lit(1.0))})


def nudge(digits: int) -> float:
    """Added before rounding on both sides: values that lie halfway would go either way by the last bits of a sum. (And 0.0 is added
    after it, so that there is no -0.0.)"""
    return 3.1 * 10.0 ** -(digits + 3)


def r(c: Column | str, digits: int = 4) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + nudge(digits), digits) + F.lit(0.0)


def nudged(sql: str) -> str:
    """sql with the same nudge in each round(value, digits)."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, comma, i = 1, 0, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        value, digits = sql[start + 6 : comma], int(sql[comma + 1 : i - 1])
        out += f"{sql[at:start]}(round(({nudged(value)}) + {nudge(digits):e}::DOUBLE, {digits}) + 0.0::DOUBLE)"
        at = i
    return out + sql[at:]


def bind() -> None:
    """Columns and frames that the queries below share; they can be made only once there is a session."""
    global x, w, xm, y, t, p, yh, W, WP, level, bits, warm
    x, w, xm, y, t, p, yh = (F.col(c) for c in ("x", "w", "xm", "y", "x", "pred", "yhat"))
    W, WP = upto(KEYS, ORDER), prior(KEYS, ORDER)
    level = F.when(x > 300, "Drift").when(x > 150, "Warning").otherwise("None")
    bits = [(F.col("h") > 12).cast("double"), (F.col("k") > 50).cast("double")]
    warm = B.warmup_state(F.col("n"), F.col("err"), F.lit(100.0), 5, 20)


def add(name: str, query: Query, sql: str | None = None, view: str = STREAM) -> None:
    """Register a query, and its SQL with the shared view before it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bind()
        return query(spark, sf_dir)

    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = view + nudged(sql)


x = w = xm = y = t = p = yh = W = WP = level = bits = warm = None

OVER = "OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BEFORE = "OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def lasting(rows: int) -> str:
    return f"OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def by_row(name: str, c: Callable[[], Column], sql: str, digits: int = 4, predicted: bool = False) -> None:
    """seq, user_id and the column's value on each row."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = stream(spark, sf_dir)
        return (with_predictions(s) if predicted else s).select("seq", "user_id", r(c(), digits).alias("value"))

    add(name, run, f"SELECT seq, user_id, round({sql}, {digits}) AS value FROM s")


def by_user(name: str, c: Callable[[], Column], sql: str, digits: int = 4, predicted: bool = False) -> None:
    """user_id and the aggregate over all of the user's rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = stream(spark, sf_dir)
        return (with_predictions(s) if predicted else s).groupBy("user_id").agg(r(c(), digits).alias("value"))

    add(name, run, f"SELECT user_id, round({sql}, {digits}) AS value FROM s GROUP BY user_id")



# ---- statistics
add("s01_count", lambda a, d: stream(a, d).select("seq", "user_id", S.count(W).alias("value")), f"SELECT seq, user_id, count(*) {OVER} AS value FROM s")
by_row("s02_sum", lambda: S.total(x, W), f"sum(x) {OVER}")
by_row("s03_mean", lambda: S.mean(x, W), f"avg(x) {OVER}")
by_row("s04_variance", lambda: S.variance(x, W), f"var_samp(x) {OVER}")
by_row("s04_variance_population", lambda: S.variance(x, W, True), f"var_pop(x) {OVER}")
by_row("s05_std_dev", lambda: S.std_dev(x, W), f"stddev_samp(x) {OVER}")
by_user("s06_ew_mean", lambda: S.ew_mean(F.col("seq"), x, 0.3), "list_reduce(list(x ORDER BY seq), lambda a, v: 0.3::DOUBLE * v + 0.7::DOUBLE * a)")
by_row("s07_min", lambda: S.minimum(x, W), f"min(x) {OVER}")
by_row("s08_max", lambda: S.maximum(x, W), f"max(x) {OVER}")
by_row("s09_rolling_mean", lambda: S.mean(x, last(KEYS, ORDER, 20)), f"avg(x) {lasting(20)}")
by_row("s10_rolling_variance", lambda: S.variance(x, last(KEYS, ORDER, 20)), f"var_samp(x) {lasting(20)}")
add(
    "s13_rolling_median_mad",
    lambda a, d: S.with_median_mad(stream(a, d), "x", KEYS, ORDER, 20, 5).select("seq", r("median").alias("median"), r("mad").alias("mad")),
    f"SELECT seq, CASE WHEN count(*) {lasting(20)} >= 5 THEN round(median(x) {lasting(20)}, 4) END AS median, CASE WHEN count(*) {lasting(20)} >= 5 THEN round(mad(x) {lasting(20)}, 4) END AS mad FROM s",
)
add(
    "s14_normal_mad",
    lambda a, d: S.with_median_mad(stream(a, d), "x", KEYS, ORDER, 20).select("seq", r("normal_mad").alias("value")),
    f"SELECT seq, round(1.482602218505602::DOUBLE * mad(x) {lasting(20)}, 4) AS value FROM s",
)
add(
    "s15_modified_z",
    lambda a, d: S.with_median_mad(stream(a, d), "x", KEYS, ORDER, 20, 3).select("seq", "z_status", r("modified_z").alias("value")),
    f"""SELECT seq, CASE WHEN n < 3 THEN 'InsufficientData' WHEN m = 0 THEN 'ZeroMad' ELSE 'Score' END AS z_status, CASE WHEN n >= 3 AND m <> 0 THEN round(0.6744897501960817::DOUBLE * (x - med) / m, 4) END AS value
FROM (SELECT seq, x, count(*) {lasting(20)} AS n, median(x) {lasting(20)} AS med, mad(x) {lasting(20)} AS m FROM s)""",
)
by_row("s16_clipped_mean", lambda: S.clipped_mean(x, 50, 300, W), f"avg(greatest(least(x, 300), 50)) {OVER}")


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.with_anomalies(stream(spark, sf_dir), "x", KEYS, ORDER, 20, 2.5)
    return out.select("seq", "user_id", r("roll_mean").alias("roll_mean"), r("roll_std").alias("roll_std"), "anomaly")


add(
    "s17_anomalies",
    anomalies,
    f"""SELECT seq, user_id, round(m, 4) AS roll_mean, round(sd, 4) AS roll_std, coalesce(n = 20 AND sd > 1e-9 AND abs(x - m) / sd > 2.5, false) AS anomaly
FROM (SELECT seq, user_id, x, avg(x) {lasting(20)} AS m, stddev_samp(x) {lasting(20)} AS sd, count(*) {lasting(20)} AS n FROM s)""",
)
by_user("s18_weighted_mean", lambda: S.weighted_mean(x, w), "sum(x * w) / nullif(sum(w), 0)")
by_user("s19_weighted_variance", lambda: S.weighted_variance(x, w), "greatest(sum(w * x * x) / nullif(sum(w), 0) - pow(sum(w * x) / nullif(sum(w), 0), 2), 0)", 3)
by_user("s20_weighted_ew_mean", lambda: S.weighted_ew_mean(F.col("seq"), x, w, 0.3), "list_reduce(list({'x': x, 'w': w} ORDER BY seq) FILTER (w > 0), lambda a, v: {'x': (1 - pow(0.7::DOUBLE, v.w)) * v.x + pow(0.7::DOUBLE, v.w) * a.x, 'w': 1.0::DOUBLE}).x")
by_user("s21_weighted_mae", lambda: S.weighted_mae(t, p, w), "sum(w * abs(x - pred)) / nullif(sum(w), 0)", predicted=True)
by_user("s22_weighted_mse", lambda: S.weighted_mse(t, p, w), "sum(w * pow(x - pred, 2)) / nullif(sum(w), 0)", predicted=True)
add(
    "s23_time_decayed_mean",
    lambda a, d: S.decayed_mean(stream(a, d), KEYS, "t", "x", 0.05).select("user_id", r("decayed_mean").alias("value")),
    ", z AS (SELECT *, max(t) OVER (PARTITION BY user_id) AS last_t FROM s) SELECT user_id, round(sum(x * exp(-0.05 * (last_t - t))) / sum(exp(-0.05 * (last_t - t))), 4) AS value FROM z GROUP BY user_id",
)
add(
    "s24_window_buffer",
    lambda a, d: stream(a, d).select("seq", F.array_join(F.transform(S.window_values(x, KEYS, ORDER, 5), lambda v: F.format_string("%.2f", v)), ",").alias("value")),
    f"SELECT seq, array_to_string(list_transform(list(x) {lasting(5)}, lambda v: printf('%.2f', v)), ',') AS value FROM s",
)

# ---- preprocessing
by_row("p01_standard_scaler", lambda: P.scaled(x, W), f"(x - avg(x) {OVER}) / CASE WHEN var_pop(x) {OVER} < 1e-12 THEN 1 ELSE sqrt(var_pop(x) {OVER}) END", 3)
by_row("p01_standard_scaler_prior", lambda: P.scaled(x, WP), f"(x - coalesce(avg(x) {BEFORE}, 0)) / CASE WHEN coalesce(var_pop(x) {BEFORE}, 0) < 1e-12 THEN 1 ELSE sqrt(var_pop(x) {BEFORE}) END", 3)
by_row("p02_min_max_scaler", lambda: P.min_max(x, W), f"CASE WHEN max(x) {OVER} = min(x) {OVER} THEN 0.5 ELSE (x - min(x) {OVER}) / (max(x) {OVER} - min(x) {OVER}) END")
by_row("p03_clipper", lambda: C.clamp(x, 50, 300), "greatest(least(x, 300), 50)")
by_row("p04_constant_imputer", lambda: C.constant_impute(xm, -1.0), "coalesce(xm, -1.0)")
by_row("p05_mean_imputer", lambda: P.mean_imputed(xm, KEYS, ORDER), f"coalesce(xm, avg(xm) {BEFORE}, 0)")
by_row("p06_forward_fill", lambda: P.forward_filled(xm, KEYS, ORDER), f"coalesce(last_value(xm IGNORE NULLS) {OVER}, 0)")
add(
    "p07_missing_indicator",
    lambda a, d: stream(a, d).select("seq", C.with_indicators(F.array("xm", "h")).alias("v")).select("seq", *(r(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(4))),
    "SELECT seq, round(xm, 4) AS v0, CASE WHEN xm IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS v1, h AS v2, 0.0::DOUBLE AS v3 FROM s",
)


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir)
    vocab = P.vocabulary(s, "event_type")
    return s.crossJoin(F.broadcast(vocab))


add(
    "p08_one_hot",
    lambda a, d: encoded(a, d).select("seq", P.one_hot(F.col("event_type"), F.col("vocabulary")).alias("v")).select("seq", *(F.get("v", F.lit(i)).alias(f"v{i}") for i in range(5))),
    "SELECT seq, " + ", ".join(f"CASE WHEN event_type = '{c}' THEN 1.0 ELSE 0.0 END::DOUBLE AS v{i}" for i, c in enumerate(EVENT_TYPES)) + " FROM s",
)
add("p09_ordinal", lambda a, d: encoded(a, d).select("seq", P.ordinal(F.col("event_type"), F.col("vocabulary")).alias("value")), "SELECT seq, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS value FROM s")
add("p10_frequency", lambda a, d: P.with_frequency(stream(a, d), "event_type").select("seq", r("frequency", 6).alias("value")), "SELECT seq, round(count(*) OVER (PARTITION BY event_type) / count(*) OVER ()::DOUBLE, 6) AS value FROM s")
add(
    "p11_sparse_features",
    lambda a, d: P.sparse(stream(a, d), ["user_id"], "arm", "x").select("user_id", F.size("features").cast("bigint").alias("n"), r(P.sparse_get(F.col("features"), F.lit(2))).alias("value")),
    "SELECT user_id, count(DISTINCT arm) AS n, round(sum(x) FILTER (arm = 2), 4) AS value FROM s GROUP BY user_id",
)
named = lambda s: s.select("seq", "user_id", F.array(F.struct(P.hash_name(F.concat(F.lit("type="), "event_type")).alias("id"), F.lit(1.0).alias("value")), F.struct(P.hash_name(F.lit("hour")).alias("id"), F.col("h").alias("value"))).alias("features"), "x", "y")
add("p12_feature_hasher", lambda a, d: named(stream(a, d)).select("seq", P.hashed(F.col("features"), 16).alias("vector")))
add("p13_hashed_names", lambda a, d: named(stream(a, d)).select("seq", F.transform("features", lambda f: f["id"]).alias("ids")))
twice = lambda s: named(s).withColumn("features", F.concat("features", F.transform("features", lambda f: F.struct(f["id"].alias("id"), F.lit(0.5).alias("value")))))
add(
    "p13_merged_names",
    lambda a, d: twice(stream(a, d)).select("seq", P.merged(F.col("features")).alias("m")).select("seq", F.size("m").cast("bigint").alias("n"), F.array_min("m.value").alias("lo"), F.array_max("m.value").alias("hi")),
    "SELECT seq, CAST(2 AS BIGINT) AS n, least(1.5, h + 0.5)::DOUBLE AS lo, greatest(1.5, h + 0.5)::DOUBLE AS hi FROM s",
)

# ---- losses and schedules
by_row("l01_squared_error", lambda: C.squared_loss(p, t), "0.5 * (pred - x) * (pred - x)", predicted=True)
by_row("l01_squared_gradient", lambda: C.squared_gradient(p, t), "pred - x", predicted=True)
by_row("l02_huber", lambda: C.huber_loss(p, t, 20), "CASE WHEN abs(pred - x) <= 20 THEN 0.5 * (pred - x) * (pred - x) ELSE 20 * (abs(pred - x) - 10) END", predicted=True)
by_row("l02_huber_gradient", lambda: C.huber_gradient(p, t, 20), "greatest(least(pred - x, 20), -20)", predicted=True)
by_row("l03_log_loss", lambda: C.log_loss(F.col("prob"), y), "-CASE WHEN y THEN ln(greatest(least(prob, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least(prob, 1 - 1e-15), 1e-15)) END", predicted=True)
by_row("l04_sigmoid", lambda: C.sigmoid((x - 250) / 50), "1 / (1 + exp(-(x - 250) / 50))", 8)

# ---- models
by_row("m01_mean_regressor", lambda: p, "pred", predicted=True)
by_row("m02_last_value", lambda: F.col("pred2"), "pred2", predicted=True)
add(
    "m03_ew_regressor",
    lambda a, d: run_batch(stream(a, d).select("user_id", "seq", "x"), K.EwMean(0.3), KEYS, ORDER).select("seq", "user_id", r(F.coalesce(F.lag("ew").over(_line()), F.lit(0.0))).alias("value")),
    """, z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i FROM s), r AS (SELECT user_id, i, seq, 0.0::DOUBLE AS value, x AS m FROM z WHERE i = 1
UNION ALL SELECT z.user_id, z.i, z.seq, r.m, 0.3::DOUBLE * z.x + 0.7::DOUBLE * r.m FROM r JOIN z ON z.user_id = r.user_id AND z.i = r.i + 1) SELECT seq, user_id, round(value, 4) AS value FROM r""",
    STREAM.replace("WITH e", "WITH RECURSIVE e"),
)


def _line():
    from .plans.frames import ordered

    return ordered(KEYS, ORDER)


def _nb_sql(density: str) -> str:
    return f"SELECT seq, user_id, round(CASE WHEN n1 + n0 = 0 THEN 0.5 WHEN n1 = 0 THEN 0 WHEN n0 = 0 THEN 1 ELSE 1 / (1 + exp(-(ln(n1) - ln(n0) + {density}))) END, 6) AS value FROM z"


_gauss = lambda f, c: f"coalesce(CASE WHEN v{f}{c} > 0 THEN -0.5 * ln(2 * pi() * v{f}{c}) - ({f} - m{f}{c}) * ({f} - m{f}{c}) / (2 * v{f}{c}) END, 0)"
add(
    "m10_gaussian_nb",
    lambda a, d: stream(a, d).select("seq", "user_id", r(M.gaussian_nb([x, F.col("h")], y, WP), 6).alias("value")),
    ", z AS (SELECT seq, user_id, x, h, "
    + ", ".join(f"coalesce(sum(CASE WHEN {c} THEN 1 END) {BEFORE}, 0) AS n{i}, " + ", ".join(f"avg(CASE WHEN {c} THEN {f} END) {BEFORE} AS m{f}{i}, var_pop(CASE WHEN {c} THEN {f} END) {BEFORE} AS v{f}{i}" for f in "xh") for i, c in ((1, "y"), (0, "NOT y")))
    + " FROM s) "
    + _nb_sql(f"{_gauss('x', 1)} + {_gauss('h', 1)} - {_gauss('x', 0)} - {_gauss('h', 0)}"),
)
_bern = lambda f, i: f"{f} * ln((c{f}{i} + 1) / (n{i} + 2)) + (1 - {f}) * ln(1 - (c{f}{i} + 1) / (n{i} + 2))"
add(
    "m11_bernoulli_nb",
    lambda a, d: stream(a, d).select("seq", "user_id", r(M.bernoulli_nb(bits, y, WP), 6).alias("value")),
    ", b AS (SELECT *, CASE WHEN h > 12 THEN 1.0 ELSE 0.0 END::DOUBLE AS f, CASE WHEN k > 50 THEN 1.0 ELSE 0.0 END::DOUBLE AS g FROM s), z AS (SELECT seq, user_id, f, g, "
    + ", ".join(f"coalesce(sum(CASE WHEN {c} THEN 1 END) {BEFORE}, 0)::DOUBLE AS n{i}, coalesce(sum(CASE WHEN {c} AND f > 0.5 THEN 1 END) {BEFORE}, 0)::DOUBLE AS cf{i}, coalesce(sum(CASE WHEN {c} AND g > 0.5 THEN 1 END) {BEFORE}, 0)::DOUBLE AS cg{i}" for i, c in ((1, "y"), (0, "NOT y")))
    + " FROM b) "
    + _nb_sql(f"{_bern('f', 1)} + {_bern('g', 1)} - ({_bern('f', 0)}) - ({_bern('g', 0)})"),
)
add(
    "m12_multinomial_nb",
    lambda a, d: stream(a, d).select("seq", "user_id", r(M.multinomial_nb([F.col("h"), F.col("k")], y, WP), 6).alias("value")),
    ", z AS (SELECT seq, user_id, h, k, "
    + ", ".join(f"coalesce(sum(CASE WHEN {c} THEN 1 END) {BEFORE}, 0)::DOUBLE AS n{i}, coalesce(sum(CASE WHEN {c} THEN h END) {BEFORE}, 0) AS a{i}, coalesce(sum(CASE WHEN {c} THEN k END) {BEFORE}, 0) AS b{i}" for i, c in ((1, "y"), (0, "NOT y")))
    + " FROM s) "
    + _nb_sql(" + ".join(f"{sign} * ({f} * ln(({s}{i} + 1) / (a{i} + b{i} + 2)))" for i, sign in ((1, "1"), (0, "-1")) for f, s in (("h", "a"), ("k", "b")))),
)
by_row("m14_linear_score", lambda: C.linear_score(F.array(x, F.col("h")), F.array(F.lit(0.5), F.lit(-0.25)), 1.0), "1.0 + 0.5 * x - 0.25 * h")


def regression(s: DataFrame, *more: str) -> DataFrame:
    return s.select("user_id", "seq", F.array(F.col("h") / 24, F.col("k") / 100).alias("features"), (x / 500).alias("y"), *more)


def labelled(s: DataFrame) -> DataFrame:
    return s.select("user_id", "seq", F.array(F.col("h") / 24, F.col("x") / 500).alias("features"), y.cast("double").alias("y"))


_SGD = """, z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i, h / 24 AS f FROM s), r AS (
SELECT user_id, i, seq, 0.0::DOUBLE AS pred_, {first} FROM z WHERE i = 1
UNION ALL SELECT z.user_id, z.i, z.seq, r.a * z.f + r.b, {next} FROM r JOIN z ON z.user_id = r.user_id AND z.i = r.i + 1)
SELECT seq, user_id, round(pred_, 6) AS pred FROM r"""
_REC = STREAM.replace("WITH e", "WITH RECURSIVE e")


def folded(name: str, step, rows: Callable[[DataFrame], DataFrame], out: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    add(name, lambda a, d: out(run_batch(rows(stream(a, d)), step, KEYS, ORDER)), sql, _REC)


one = lambda s: s.select("user_id", "seq", F.array(F.col("h") / 24).alias("features"), (x / 500).alias("y"))
pred_only = lambda o: o.select("seq", "user_id", r("pred", 6).alias("pred"))
_res = "(r.a * z.f + r.b - z.x / 500)"
folded(
    "o01_sgd", K.Linear(1, rate=0.1, l2=0.01), one, pred_only,
    _SGD.format(first="-0.1::DOUBLE * (0 - x / 500) * f AS a, -0.1::DOUBLE * (0 - x / 500) AS b", next=f"r.a - 0.1::DOUBLE * ({_res} * z.f + 0.01::DOUBLE * r.a), r.b - 0.1::DOUBLE * {_res}"),
)
folded(
    "o02_adagrad", K.Linear(1, "adagrad", rate=0.1), one, pred_only,
    _SGD.format(
        first="0.1::DOUBLE * (x / 500) * f / sqrt(pow(x / 500 * f, 2) + 1e-8::DOUBLE) AS a, 0.1::DOUBLE * (x / 500) / sqrt(pow(x / 500, 2) + 1e-8::DOUBLE) AS b, pow(x / 500 * f, 2) AS ga, pow(x / 500, 2) AS gb",
        next=f"r.a - 0.1::DOUBLE / sqrt(r.ga + pow({_res} * z.f, 2) + 1e-8::DOUBLE) * {_res} * z.f, r.b - 0.1::DOUBLE / sqrt(r.gb + pow({_res}, 2) + 1e-8::DOUBLE) * {_res}, r.ga + pow({_res} * z.f, 2), r.gb + pow({_res}, 2)",
    ),
)
_PH = f""", a AS (SELECT *, count(*) {OVER} AS n, x - avg(x) {OVER} - 0.005 AS dv FROM s), b AS (SELECT *, sum(dv) {OVER} AS sm FROM a), c AS (SELECT *, sm - least(0, min(sm) {OVER}) AS st FROM b)"""
add(
    "o04_learning_rate",
    lambda a, d: D.page_hinkley(stream(a, d), "x", KEYS, ORDER, 500, 250).select("seq", C.learning_rate(F.col("ph_level")).alias("value")),
    _PH + " SELECT seq, CAST(CASE WHEN n < 30 OR st <= 250 THEN 0.01 WHEN st > 500 THEN 0.05 ELSE 0.02 END AS DOUBLE) AS value FROM c",
)


def fitted(x0: str, x1: str, target: str, out: str, rate: float, scale: bool = False, log: bool = False, weight: str = "") -> str:
    """SQL of a linear or logistic model of two features by gradient steps, predicted before it learns.

    scale: by what the user's rows have shown, before the row for its prediction, with it for learning; weight: rows without
    any weight teach nothing.
    """
    some = f" FILTER ({weight} > 0)" if weight else ""
    cols = []
    for i, f in enumerate((x0, x1)):
        for name, frame in (("p", BEFORE), ("q", OVER)):
            value = f"CASE WHEN coalesce(var_pop(f{i}){some} {frame}, 0) < 1e-12::DOUBLE THEN 1 ELSE sqrt(var_pop(f{i}){some} {frame}) END"
            cols.append(f"(f{i} - coalesce(avg(f{i}){some} {frame}, 0)) / {value} AS {name}{i}" if scale else f"f{i} AS {name}{i}")
    squash = (lambda z: f"1 / (1 + exp(-({z})))") if log else (lambda z: z)
    w = f"z.{weight}" if weight else "1"
    res = "(" + squash("r.w0 * z.q0 + r.w1 * z.q1 + r.c") + f" - z.goal) * {w}"
    at_first = f"({'0.5' if log else '0'} - goal) * {weight or 1}"
    step = f"{rate}::DOUBLE"
    return f""", g AS (SELECT *, CAST({x0} AS DOUBLE) AS f0, CAST({x1} AS DOUBLE) AS f1, CAST({target} AS DOUBLE) AS goal FROM s),
z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i, {", ".join(cols)} FROM g),
r AS (SELECT user_id, i, seq, goal, {'0.5' if log else '0.0'}::DOUBLE AS pred_, -{step} * {at_first} * q0 AS w0, -{step} * {at_first} * q1 AS w1, -{step} * {at_first} AS c FROM z WHERE i = 1
UNION ALL SELECT z.user_id, z.i, z.seq, z.goal, {squash("r.w0 * z.p0 + r.w1 * z.p1 + r.c")}, r.w0 - {step} * {res} * z.q0, r.w1 - {step} * {res} * z.q1, r.c - {step} * {res} FROM r JOIN z ON z.user_id = r.user_id AND z.i = r.i + 1)
SELECT seq, user_id, {out} FROM r"""


_PRED = "round(pred_, 6) AS pred"
folded("m04_linear_regression", K.Linear(2, rate=0.1), regression, lambda o: o.select("seq", "user_id", r("pred", 6).alias("pred"), r("y", 6).alias("y")), fitted("h / 24", "k / 100", "x / 500", _PRED + ", round(goal, 6) AS y", 0.1))
folded(
    "m05_logistic_regression", K.Linear(1, rate=0.5, loss="log"), lambda s: s.select("user_id", "seq", F.array(F.col("h") / 24).alias("features"), y.cast("double").alias("y")), pred_only,
    _SGD.replace("0.0::DOUBLE AS pred_", "0.5::DOUBLE AS pred_").replace("r.a * z.f + r.b, {next}", "1 / (1 + exp(-(r.a * z.f + r.b))), {next}").format(
        first="-0.5::DOUBLE * (0.5 - CASE WHEN y THEN 1 ELSE 0 END) * f AS a, -0.5::DOUBLE * (0.5 - CASE WHEN y THEN 1 ELSE 0 END) AS b",
        next="r.a - 0.5::DOUBLE * (1 / (1 + exp(-(r.a * z.f + r.b))) - CASE WHEN z.y THEN 1 ELSE 0 END) * z.f, r.b - 0.5::DOUBLE * (1 / (1 + exp(-(r.a * z.f + r.b))) - CASE WHEN z.y THEN 1 ELSE 0 END)",
    ),
)
sparse_rows = lambda s: named(s).select("user_id", "seq", "features", (x / 500).alias("y"))


def ftrl(goal: str, log: bool = False) -> str:
    """SQL of FTRL by recursion over a user's rows: a column pair z, n for each event type, the hour and the intercept (last)."""
    values = [f"CASE WHEN event_type = '{c}' THEN 1.0 ELSE 0.0 END::DOUBLE" for c in EVENT_TYPES] + ["h::DOUBLE", "1.0::DOUBLE"]
    ks = range(len(values))
    each = lambda form: ", ".join(form.format(k=k, l1=0 if k == ks[-1] else 1) for k in ks)
    weight = each("CASE WHEN abs(r.z{k}) <= {l1} OR r.n{k} = 0 THEN 0 ELSE -(r.z{k} - {l1} * sign(r.z{k})) / (1 + (1 + sqrt(r.n{k})) / 0.1::DOUBLE) END AS w{k}")
    total = " + ".join(f"v{k} * w{k}" for k in ks)
    moved = each("z{k} + res * v{k} - (sqrt(n{k} + (res * v{k}) * (res * v{k})) - sqrt(n{k})) / 0.1::DOUBLE * w{k}, n{k} + (res * v{k}) * (res * v{k})")
    rows = ", ".join(f"{v} AS v{k}" for k, v in enumerate(values))
    return f""", g AS (SELECT user_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i, {goal}::DOUBLE AS goal, {rows} FROM s),
r AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS seq, 0::DOUBLE AS p, {each("0::DOUBLE AS z{k}, 0::DOUBLE AS n{k}")} FROM g WHERE i = 1
UNION ALL SELECT user_id, i, seq, p, {moved} FROM (SELECT *, p - goal AS res FROM (SELECT *, {f"1 / (1 + exp(-({total})))" if log else total} AS p FROM
(SELECT g.*, {each("r.z{k}, r.n{k}")}, {weight} FROM r JOIN g ON g.user_id = r.user_id AND g.i = r.i + 1))))
SELECT seq, user_id, round(p, 6) AS pred FROM r WHERE i > 0"""


folded("m06_ftrl_regressor", K.Ftrl(), sparse_rows, pred_only, ftrl("x / 500"))
folded("m07_ftrl_classifier", K.Ftrl(classify=True), lambda s: named(s).select("user_id", "seq", "features", y.cast("double").alias("y")), pred_only, ftrl("CASE WHEN y THEN 1 ELSE 0 END", True))
counted = lambda o: o.select("seq", "user_id", "n_features")
# A user's first row of each event type brings a feature; the hour is one from the first row on.
_TYPES = "nt AS (SELECT seq, user_id, event_type, min(seq) OVER (PARTITION BY user_id, event_type) AS born FROM s), rk AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY born) AS nth, CAST(sum(CASE WHEN seq = born THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS INT) AS types FROM nt) "
_COUNTED = ", " + _TYPES + "SELECT seq, user_id, least(3, 1 + types) AS n_features FROM rk"
add("m08_feature_cap", lambda a, d: counted(run_batch(sparse_rows(stream(a, d)), K.Ftrl(most=3, ignore=True), KEYS, ORDER)), _COUNTED)
add("m08_feature_reject", lambda a, d: counted(run_batch(sparse_rows(stream(a, d)), K.Ftrl(most=3), KEYS, ORDER)), _COUNTED + " WHERE nth <= 2")
add(
    "m09_ftrl_resources",
    lambda a, d: run_batch(sparse_rows(stream(a, d)), K.Ftrl(most=3), KEYS, ORDER).groupBy("user_id").agg(F.max("n_features").cast("bigint").alias("features"), (F.max("n_features") / 3.0).alias("saturation"), (F.max("n_features") >= 3).alias("at_cap")),
    ", " + _TYPES + "SELECT user_id, CAST(least(3, 1 + max(types)) AS BIGINT) AS features, least(3, 1 + max(types)) / 3.0::DOUBLE AS saturation, max(types) >= 2 AS at_cap FROM rk GROUP BY user_id",
)
_SCALED = fitted("h / 24", "k / 100", "x / 500", _PRED, 0.1, scale=True)
folded("v01_scaled_pipeline", K.Linear(2, rate=0.1, scale=True), regression, pred_only, _SCALED)
folded("v02_classification_pipeline", K.Linear(2, rate=0.1, loss="log", scale=True), labelled, pred_only, fitted("h / 24", "x / 500", "CASE WHEN y THEN 1 ELSE 0 END", _PRED, 0.1, scale=True, log=True))
folded("v04_weighted_pipeline", K.Linear(2, rate=0.1, scale=True, weighted=True), lambda s: regression(s, "w"), pred_only, fitted("h / 24", "k / 100", "x / 500", _PRED, 0.1, scale=True, weight="w"))
by_user("v05_progressive_regression", lambda: M.mae(t, p), "avg(abs(x - pred))", predicted=True)
by_row("v06_progressive_steps", lambda: M.mae(t, p, W), f"avg(abs(x - pred)) {OVER}", predicted=True)
add(
    "v07_progressive_classification",
    lambda a, d: stream(a, d).select("seq", "user_id", "y", M.gaussian_nb([x], y, WP).alias("q")).groupBy("user_id").agg(r(M.accuracy(y, F.col("q") >= 0.5)).alias("value")),
    ", z AS (SELECT seq, user_id, y, x, "
    + ", ".join(f"coalesce(sum(CASE WHEN {c} THEN 1 END) {BEFORE}, 0) AS n{i}, avg(CASE WHEN {c} THEN x END) {BEFORE} AS mx{i}, var_pop(CASE WHEN {c} THEN x END) {BEFORE} AS vx{i}" for i, c in ((1, "y"), (0, "NOT y")))
    + f" FROM s), q AS (SELECT user_id, y, CASE WHEN n1 + n0 = 0 THEN 0.5 WHEN n1 = 0 THEN 0 WHEN n0 = 0 THEN 1 ELSE 1 / (1 + exp(-(ln(n1) - ln(n0) + {_gauss('x', 1)} - {_gauss('x', 0)}))) END AS q FROM z)"
    + " SELECT user_id, round(avg(CASE WHEN y = (q >= 0.5) THEN 1.0 ELSE 0.0 END), 4) AS value FROM q GROUP BY user_id",
)



class Careful(K.Linear):
    """Learns on a copy of the state, which is kept only if the whole step succeeds."""

    fragile = True


folded("v03_transactional_learning", Careful(2, rate=0.1, scale=True), regression, pred_only, _SCALED)


def live_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the SGD queries over a file stream, run to its end."""
    at = streams.shared_path(spark, "live")
    rows = streams.progressive(one(stream(spark, sf_dir, live=True)), K.Linear(1, rate=0.1, l2=0.01), KEYS, ORDER)
    return pred_only(streams.drain(rows, f"{at}/check", f"{at}/out"))


add("v08_stream_regression", live_regression)
ORACLE["v08_stream_regression"] = ORACLE["o01_sgd"]

# ---- metrics
by_user("e01_mae", lambda: M.mae(t, p), "avg(abs(x - pred))", predicted=True)
by_user("e02_mse", lambda: M.mse(t, p), "avg(pow(x - pred, 2))", predicted=True)
by_user("e03_rmse", lambda: M.rmse(t, p), "sqrt(avg(pow(x - pred, 2)))", predicted=True)
by_user("e04_r2", lambda: M.r2(t, p), "CASE WHEN count(x) >= 2 AND var_pop(x) > 0 THEN 1 - sum(pow(x - pred, 2)) / (var_pop(x) * count(x)) END", predicted=True)
by_user("e05_accuracy", lambda: M.accuracy(y, yh), "avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END)", predicted=True)
by_user("e06_precision", lambda: M.precision(y, yh), "sum(CASE WHEN y AND yhat THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN yhat THEN 1.0 ELSE 0 END), 0)", predicted=True)
by_user("e07_recall", lambda: M.recall(y, yh), "sum(CASE WHEN y AND yhat THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN y THEN 1.0 ELSE 0 END), 0)", predicted=True)
by_user("e08_f1", lambda: M.f1(y, yh), "sum(CASE WHEN y AND yhat THEN 2.0 ELSE 0 END) / nullif(sum(CASE WHEN y THEN 1.0 ELSE 0 END + CASE WHEN yhat THEN 1.0 ELSE 0 END), 0)", predicted=True)
by_user("e09_log_loss", lambda: M.mean_log_loss(y, F.col("prob")), "avg(-CASE WHEN y THEN ln(greatest(least(prob, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least(prob, 1 - 1e-15), 1e-15)) END)", predicted=True)
by_row("e10_rolling_mae", lambda: M.mae(t, p, last(KEYS, ORDER, 20)), f"avg(abs(x - pred)) {lasting(20)}", predicted=True)
by_row("e11_rolling_mse", lambda: M.mse(t, p, last(KEYS, ORDER, 20)), f"avg(pow(x - pred, 2)) {lasting(20)}", predicted=True)
by_row("e12_rolling_accuracy", lambda: M.accuracy(y, yh, last(KEYS, ORDER, 20)), f"avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) {lasting(20)}", predicted=True)

# ---- quantiles
folded("s11_p2_quantile", K.P2((0.5,)), lambda s: s.select("user_id", "seq", "x"), lambda o: o.select("seq", "user_id", r(F.get("estimates", F.lit(0))).alias("value")))
folded("s12_p2_quantiles", K.P2((0.1, 0.5, 0.9)), lambda s: s.select("user_id", "seq", "x"), lambda o: o.select("seq", "user_id", *(r(F.get("estimates", F.lit(i))).alias(f"q{i}") for i in range(3))))
by_user("a05_exact_quantile", lambda: F.percentile("x", F.lit(0.9)), "quantile_cont(x, 0.9)")
add(
    "a06_median_mad",
    lambda a, d: (lambda s: s.join(s.groupBy("user_id").agg(F.percentile("x", F.lit(0.5)).alias("m")), "user_id").groupBy("user_id").agg(r(F.first("m")).alias("median"), r(F.percentile(F.abs(F.col("x") - F.col("m")), F.lit(0.5))).alias("mad")))(stream(a, d)),
    "SELECT user_id, round(median(x), 4) AS median, round(mad(x), 4) AS mad FROM s GROUP BY user_id",
)

# ---- drift
add(
    "r01_page_hinkley",
    lambda a, d: D.page_hinkley(stream(a, d), "x", KEYS, ORDER, 500, 250).select("seq", r("ph_stat", 3).alias("ph_stat"), "ph_level"),
    f""", a AS (SELECT *, count(*) {OVER} AS n, x - avg(x) {OVER} - 0.005 AS dv FROM s), b AS (SELECT *, sum(dv) {OVER} AS sm FROM a), c AS (SELECT *, sm - least(0, min(sm) {OVER}) AS st FROM b)
SELECT seq, round(st, 3) AS ph_stat, CASE WHEN n < 30 OR st <= 250 THEN 'None' WHEN st > 500 THEN 'Drift' ELSE 'Warning' END AS ph_level FROM c""",
)
folded(
    "r01_page_hinkley_forgetting", K.PageHinkley(500, 250, 0.99), lambda s: s.select("user_id", "seq", "x"), lambda o: o.select("seq", "level", r("statistic", 3).alias("statistic")),
    f""", z AS (SELECT user_id, seq, x - avg(x) {OVER} - 0.005 AS dv, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i FROM s),
r AS (SELECT user_id, seq, i, dv AS sm, least(0, dv) AS low FROM z WHERE i = 1
UNION ALL SELECT z.user_id, z.seq, z.i, 0.99::DOUBLE * r.sm + z.dv, least(r.low, 0.99::DOUBLE * r.sm + z.dv) FROM r JOIN z ON z.user_id = r.user_id AND z.i = r.i + 1)
SELECT seq, CASE WHEN i < 30 OR sm - low <= 250 THEN 'None' WHEN sm - low > 500 THEN 'Drift' ELSE 'Warning' END AS level, round(sm - low, 3) AS statistic FROM r""",
)
folded("r02_adwin", K.Adwin(), lambda s: s.select("user_id", "seq", (x / 500).alias("x")), lambda o: o.select("seq", "level", "window", r("window_mean", 6).alias("window_mean")))
_KS = """, n AS (SELECT user_id, x, (row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1) // 20 + 1 AS wid FROM s), f AS (SELECT user_id, wid, list(x) AS xs FROM n GROUP BY ALL HAVING count(*) = 20),
pr AS (SELECT b.user_id, b.wid, a.xs AS xa, b.xs AS xb FROM f a JOIN f b ON a.user_id = b.user_id AND b.wid = a.wid + 1),
u AS (SELECT user_id, wid, unnest(list_concat(xa, xb)) AS v, xa, xb FROM pr),
k AS (SELECT user_id, wid, max(abs(len(list_filter(xa, lambda q: q <= v)) / 20.0 - len(list_filter(xb, lambda q: q <= v)) / 20.0)) AS d FROM u GROUP BY ALL),
l AS (SELECT *, (sqrt(10.0::DOUBLE) + 0.12 + 0.11 / sqrt(10.0::DOUBLE)) * d AS at_ FROM k),
g AS (SELECT *, CASE WHEN at_ < 1e-3 THEN 1.0 ELSE greatest(least(list_sum(list_transform(generate_series(1, 100), lambda j: CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * at_ * at_))), 1), 0) END AS pv FROM l)
"""
kswin = lambda a, d: D.kswin(stream(a, d), "x", KEYS, ORDER, 20, 20, 0.05)
add("r03_kswin", lambda a, d: kswin(a, d).select("user_id", "wid", "level"), _KS + "SELECT user_id, wid, CASE WHEN pv < 0.05 THEN 'Drift' ELSE 'None' END AS level FROM g")
add("r04_ks_statistic", lambda a, d: kswin(a, d).select("user_id", "wid", r("d", 6).alias("d")), _KS + "SELECT user_id, wid, round(CAST(d AS DOUBLE), 6) AS d FROM g")
add("r05_ks_p_value", lambda a, d: kswin(a, d).select("user_id", "wid", r("p_value", 6).alias("p_value")), _KS + "SELECT user_id, wid, round(pv, 6) AS p_value FROM g")
_LEVEL = "CASE WHEN x > 300 THEN 'Drift' WHEN x > 150 THEN 'Warning' ELSE 'None' END"
add("r06_level_change", lambda a, d: stream(a, d).select("seq", level.alias("level"), D.is_change(level).alias("changed")), f"SELECT seq, {_LEVEL} AS level, x > 150 AS changed FROM s")
votes = lambda s: s.select("user_id", "t", "event_type", F.lit(True).alias("available"), level.alias("level"), "x", "seq")
add(
    "r07_vote_counts",
    lambda a, d: D.vote_counts(votes(stream(a, d)), ["t"]),
    "SELECT t, CAST(count(*) FILTER (x > 150) AS BIGINT) AS n_warning, CAST(count(*) FILTER (x > 300) AS BIGINT) AS n_drift, count(*) AS n_available FROM s GROUP BY t",
)


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = votes(stream(spark, sf_dir)).groupBy("user_id", "t", "event_type").agg(F.max_by("level", "x").alias("level"))
    windows = per.groupBy("user_id", "t").agg(F.sort_array(F.collect_list(F.struct(F.col("event_type").alias("detector"), "level", F.lit(True).alias("available")))).alias("votes")).withColumn("generation", F.lit(1))
    return run_batch(windows, K.Consensus(drift_votes=1, confirm=1, clear=1), KEYS, ["t"])


add("r07_consensus", consensus)
add(
    "r08_strategy",
    lambda a, d: stream(a, d).select("seq", D.action_for(level).alias("action"), D.is_destructive(D.action_for(level)).alias("destructive")),
    "SELECT seq, CASE WHEN x > 300 THEN 'ResetModel' ELSE 'NotifyOnly' END AS action, x > 300 AS destructive FROM s",
)
folded("r10_drift_aware_model", K.DriftAware(K.Linear(2, rate=0.1), K.Adwin()), regression, lambda o: o.select("seq", "user_id", r("pred", 6).alias("pred"), r("error", 6).alias("error"), "level", "action"))

# ---- bandits
stats = lambda a, d: B.arm_stats(stream(a, d), "arm", "reward", 5, KEYS)
_ARMS = ", ar AS (SELECT u.user_id, a.arm, count(s.seq) AS pulls, coalesce(sum(s.reward), 0) AS total FROM (SELECT DISTINCT user_id FROM s) u CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS arm) a LEFT JOIN s ON s.user_id = u.user_id AND s.arm = a.arm GROUP BY ALL), st AS (SELECT *, CASE WHEN pulls > 0 THEN total / pulls ELSE 0 END AS mean FROM ar) "
add("b01_arm_stats", lambda a, d: stats(a, d).select("user_id", "arm", "pulls", r("total").alias("total"), r("mean", 6).alias("mean")), _ARMS + "SELECT user_id, arm, pulls, round(total, 4) AS total, round(mean, 6) AS mean FROM st")
add(
    "b02_epsilon_greedy",
    lambda a, d: B.greedy_arm(stats(a, d), "arm", KEYS).select("user_id", "greedy", r(B.epsilon_after(F.col("n"), 0.2, 0.99, 0.05), 6).alias("epsilon")),
    _ARMS + "SELECT user_id, arg_max(arm, {'p': pulls > 0, 'm': mean, 'a': -arm}) AS greedy, round(greatest(0.05, 0.2 * pow(0.99::DOUBLE, sum(pulls))), 6) AS epsilon FROM st GROUP BY user_id",
)
add(
    "b03_ucb1",
    lambda a, d: B.ucb_scores(stats(a, d), 2.0, KEYS).select("user_id", "arm", r("ucb", 6).alias("ucb")),
    _ARMS + "SELECT user_id, arm, CASE WHEN pulls > 0 THEN round(mean + 2 * sqrt(2 * ln(sum(pulls) OVER (PARTITION BY user_id)) / pulls), 6) END AS ucb FROM st",
)
posterior = lambda a, d: B.thompson_posterior(stream(a, d), "arm", "reward")
add("b04_thompson_posterior", lambda a, d: posterior(a, d).select("arm", r("alpha", 3).alias("alpha"), r("beta", 3).alias("beta")), "SELECT arm, round(1 + sum(reward), 3) AS alpha, round(1 + count(*) - sum(reward), 3) AS beta FROM s GROUP BY arm")
add("b04_thompson_sample", lambda a, d: B.thompson_sample(posterior(a, d).select("arm", r("alpha", 6).alias("alpha"), r("beta", 6).alias("beta")), 7).select("arm", "draw"))
context = lambda s: s.withColumns({"c0": F.col("h") / 24, "c1": F.col("k") / 100})
ucb_state = lambda a, d: B.linucb_state(context(stream(a, d)), "arm", ["c0", "c1"], "reward")
_LIN = ", c AS (SELECT *, h / 24 AS c0, k / 100 AS c1 FROM s), m AS (SELECT arm, 1 + sum(c0 * c0) AS a_00, sum(c0 * c1) AS a_01, 1 + sum(c1 * c1) AS a_11, sum(c0 * reward) AS b_0, sum(c1 * reward) AS b_1 FROM c GROUP BY arm) "
add("b05_linucb_state", lambda a, d: ucb_state(a, d).select("arm", *(r(c, 3).alias(c) for c in ("a_00", "a_01", "a_11", "b_0", "b_1"))), _LIN + "SELECT arm, round(a_00, 3) AS a_00, round(a_01, 3) AS a_01, round(a_11, 3) AS a_11, round(b_0, 3) AS b_0, round(b_1, 3) AS b_1 FROM m")
scored = lambda a, d: B.linucb_scores(context(stream(a, d)).select("seq", "c0", "c1"), ucb_state(a, d), "arm", ["c0", "c1"], 1.5)
_SCORE = _LIN + ", q AS (SELECT seq, m.arm AS scored_arm, (c0 * (a_11 * b_0 - a_01 * b_1) + c1 * (a_00 * b_1 - a_01 * b_0)) / (a_00 * a_11 - a_01 * a_01) AS exploit, 1.5 * sqrt(greatest(0, (c0 * c0 * a_11 - 2 * c0 * c1 * a_01 + c1 * c1 * a_00) / (a_00 * a_11 - a_01 * a_01))) AS bonus FROM c CROSS JOIN m) "
add("b06_linucb_scores", lambda a, d: scored(a, d).select("seq", "scored_arm", r("exploit").alias("exploit"), r("bonus").alias("bonus"), r("score").alias("score")), _SCORE + "SELECT seq, scored_arm, round(exploit, 4) AS exploit, round(bonus, 4) AS bonus, round(exploit + bonus, 4) AS score FROM q")
add("b07_linucb_select", lambda a, d: B.choose(scored(a, d).withColumn("score", r("score", 9)), ["seq"]), _SCORE + "SELECT seq, arg_max(scored_arm, {'s': round(exploit + bonus, 9), 'a': -scored_arm}) AS chosen FROM q GROUP BY seq")
add(
    "b08_condition",
    lambda a, d: B.condition(ucb_state(a, d), "arm", 2).select("arm", r("condition", 4).alias("condition")),
    _LIN + ", l AS (SELECT arm, a_00 AS p, a_11 - a_01 * a_01 / a_00 AS q FROM m) SELECT arm, round(greatest(p, q) / least(p, q), 4) AS condition FROM l",
)


def _online_scores(arms: int) -> str:
    """SQL of each arm's score by the sums over the user's rows before: A and b of two features, A inverted in closed form."""
    total = lambda v, k: f"coalesce(sum({v}) FILTER (arm = {k}) {BEFORE}, 0)"
    sums = ", ".join(f"1 + {total('c0 * c0', k)} AS p{k}, {total('c0 * c1', k)} AS o{k}, 1 + {total('c1 * c1', k)} AS q{k}, {total('c0 * reward', k)} AS u{k}, {total('c1 * reward', k)} AS v{k}" for k in range(arms))
    score = ", ".join(f"(c0 * (q{k} * u{k} - o{k} * v{k}) + c1 * (p{k} * v{k} - o{k} * u{k})) / (p{k} * q{k} - o{k} * o{k}) + sqrt(greatest(0, (c0 * c0 * q{k} - 2 * c0 * c1 * o{k} + c1 * c1 * p{k}) / (p{k} * q{k} - o{k} * o{k}))) AS s{k}" for k in range(arms))
    first = "CASE " + " ".join(f"WHEN round(s{k}, 9) = round(greatest({', '.join(f's{j}' for j in range(arms))}), 9) THEN {k}" for k in range(arms)) + " END"
    return f", c AS (SELECT *, h / 24 AS c0, k / 100 AS c1 FROM s), m AS (SELECT seq, c0, c1, {sums} FROM c), q AS (SELECT seq, {score} FROM m) SELECT seq, {first} AS chosen, {', '.join(f'round(s{k}, 6) AS score_{k}' for k in range(arms))} FROM q"


def online_scores(o: DataFrame) -> DataFrame:
    best = lambda z: F.array_position(z, F.array_max(z)) - 1
    return o.select("seq", best(F.transform("scores", lambda z: r(z, 9))).cast("int").alias("chosen"), *(r(F.get("scores", F.lit(k)), 6).alias(f"score_{k}") for k in range(5)))


folded(
    "b09_linucb_online", K.LinUcb(5, 2), lambda s: s.select("user_id", "seq", F.array(F.col("h") / 24, F.col("k") / 100).alias("context"), "arm", "reward"), online_scores,
    _online_scores(5),
)


# ---- decisions: each event decides, the user's next event is its outcome
def decisions(s: DataFrame) -> DataFrame:
    return s.select(F.col("seq").alias("id"), F.col("k").alias("context"), F.col("arm").alias("action"), F.col("seq").alias("created_at"), (F.col("seq") + 150).alias("expires_at"), F.lit(1).alias("generation"), "user_id", "reward")


def outcomes(s: DataFrame) -> DataFrame:
    nxt = F.lead("seq").over(_line())
    o = s.select(F.col("seq").alias("decision_id"), F.col("arm").alias("action"), "reward", nxt.alias("observed_at"), F.when(F.col("seq") % 11 == 0, 2).otherwise(1).alias("generation"), F.col("seq"))
    o = o.filter("observed_at IS NOT NULL").withColumn("action", F.when(F.col("seq") % 13 == 0, F.col("action") + 1).otherwise(F.col("action")))
    again = o.filter("seq % 10 = 0").withColumn("seq", F.col("seq") + 1_000_000_000)
    return o.unionByName(again)


_OUT = """, d AS (SELECT seq AS id, k AS context, arm AS action, seq AS created_at, seq + 150 AS expires_at, 1 AS generation, user_id FROM s),
o1 AS (SELECT seq AS decision_id, CASE WHEN seq % 13 = 0 THEN arm + 1 ELSE arm END AS action, reward, lead(seq) OVER (PARTITION BY user_id ORDER BY seq) AS observed_at, CASE WHEN seq % 11 = 0 THEN 2 ELSE 1 END AS generation, seq FROM s),
o AS (SELECT * FROM o1 WHERE observed_at IS NOT NULL UNION ALL SELECT decision_id, action, reward, observed_at, generation, seq + 1000000000 FROM o1 WHERE observed_at IS NOT NULL AND seq % 10 = 0),
j AS (SELECT o.*, CASE WHEN d.id IS NULL THEN 'UnknownDecision' WHEN o.observed_at < d.created_at THEN 'FeedbackBeforeDecision' WHEN o.observed_at > d.expires_at THEN 'FeedbackExpired' WHEN o.generation <> d.generation THEN 'GenerationMismatch' WHEN o.action <> d.action THEN 'ActionMismatch' END AS fault FROM o LEFT JOIN d ON d.id = o.decision_id),
f AS (SELECT *, CASE WHEN coalesce(bool_or(fault IS NULL) OVER (PARTITION BY decision_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'DuplicateFeedback' ELSE coalesce(fault, 'Completed') END AS status FROM j)
"""


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(stream(spark, sf_dir)).withColumn("line", F.col("id"))
    more = d.filter("id % 10 = 0").withColumns({"line": F.col("id") + 1_000_000_000, "action": F.when(F.col("id") % 20 == 0, F.col("action") + 1).otherwise(F.col("action"))})
    return B.register(d.unionByName(more), "line").select("id", "line", "receipt")


add("b11_register", registered, "SELECT seq AS id, seq AS line, 'Registered' AS receipt FROM s UNION ALL SELECT seq, seq + 1000000000, CASE WHEN seq % 20 = 0 THEN 'DecisionConflict' ELSE 'Replay' END FROM s WHERE seq % 10 = 0")
marked = lambda a, d: (lambda s: B.feedback(decisions(s), outcomes(s)))(stream(a, d))
add("b12_feedback", lambda a, d: marked(a, d).select("decision_id", "seq", "status"), _OUT + "SELECT decision_id, seq, status FROM f")
add(
    "b13_clear_expired",
    lambda a, d: B.clear_expired(decisions(stream(a, d)), marked(a, d).filter("status = 'Completed'"), F.lit(8000)).select("id", "expires_at"),
    _OUT + "SELECT id, expires_at FROM d WHERE expires_at < 8000 AND NOT EXISTS (SELECT 1 FROM f WHERE f.decision_id = d.id AND status = 'Completed')",
)
add(
    "b12_feedback_capacity",
    lambda a, d: (lambda s: B.feedback(decisions(s), outcomes(s), KEYS, 5))(stream(a, d)).select("decision_id", "seq", "status"),
    _OUT + """, g AS (SELECT f.*, sum(CASE WHEN status = 'Completed' THEN 1 ELSE 0 END) OVER (PARTITION BY d.user_id ORDER BY f.seq) AS n FROM f LEFT JOIN d ON d.id = f.decision_id),
lost AS (SELECT DISTINCT decision_id FROM g WHERE status = 'Completed' AND n > 5)
SELECT g.decision_id, g.seq, CASE WHEN lost.decision_id IS NULL THEN g.status ELSE coalesce(g.fault, 'CompletedCapacityExceeded') END AS status FROM g LEFT JOIN lost ON lost.decision_id = g.decision_id""",
)
add(
    "b13_clear_completed",
    lambda a, d: B.clear_completed_before(marked(a, d).filter("status = 'Completed'"), F.lit(8000)).select("decision_id", "observed_at"),
    _OUT + "SELECT decision_id, observed_at FROM f WHERE status = 'Completed' AND observed_at < 8000",
)
add("b14_ledger_counts", lambda a, d: marked(a, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")), _OUT + "SELECT status, count(*) AS n FROM f GROUP BY status")
add("b15_bounded_values", lambda a, d: B.bounded(stream(a, d), "event_type", 5).select("seq", "event_type"), "SELECT seq, event_type FROM s WHERE octet_length(encode(event_type)) <= 5")


def credited(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = context(stream(spark, sf_dir))
    done = B.feedback(decisions(s), outcomes(s)).filter("status = 'Completed'").select(F.col("decision_id").alias("seq"), F.col("reward").alias("got"))
    return B.linucb_state(s.join(done, "seq"), "arm", ["c0", "c1"], "got").select("arm", *(r(c, 3).alias(c) for c in ("a_00", "b_0", "b_1")))


add("b16_delayed_feedback", credited, _OUT + ", c AS (SELECT s.*, h / 24 AS c0, k / 100 AS c1 FROM s JOIN f ON f.decision_id = s.seq AND f.status = 'Completed') SELECT arm, round(1 + sum(c0 * c0), 3) AS a_00, round(sum(c0 * reward), 3) AS b_0, round(sum(c1 * reward), 3) AS b_1 FROM c GROUP BY arm")


def replay_events(s: DataFrame) -> DataFrame:
    """Decision and outcome rows of each user's log, with their place in it and what differs from row to row."""
    rec = dealt(s.select("user_id", "seq", "h", "k", "reward"), KEYS).select("user_id", F.col("seq").alias("timestamp"), "h", "k", F.lead("seq").over(_line()).alias("outcome_time"), "reward")
    both = rec.withColumn("kind", F.explode(F.when(F.col("outcome_time").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    return both.withColumns({"at": F.when(F.col("kind") == 0, F.col("timestamp")).otherwise(F.col("outcome_time")), "index": F.col("timestamp")})


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = {
        "decision_id": F.col("timestamp"), "context": F.array(F.col("h") / 24, F.col("k") / 100), "selected_arm": F.lit(0), "generation": F.lit(0), "schema_hash": F.lit(""),
        "baseline_reward": F.lit(0.2), "optimal_reward": F.lit(1.0), "drift": F.col("timestamp") % 40 == 0,
    }
    end = run_batch(replay_events(stream(spark, sf_dir)), K.Replay(K.LinUcb(1, 2), 150), KEYS, ["at", "kind", "index"], record, final=True)
    return end.select("user_id", *(r(c, 6).alias(c) for c in ("reward", "regret", "baseline")), "pending", "completed", "expired", "missing", "duplicate", "rejected", "drifts", r("latency_mean").alias("latency_mean"), "latency_p95", "digest")


add("b17_replay", replay)
add(
    "b18_replay_report",
    lambda a, d: replay(a, d).select("user_id", r("reward").alias("reward"), r("regret").alias("regret"), "completed", "missing"),
    ", z AS (SELECT *, lead(seq) OVER (PARTITION BY user_id ORDER BY seq) AS nx FROM s) SELECT user_id, round(coalesce(sum(reward) FILTER (nx <= seq + 150), 0), 4) AS reward, round(coalesce(sum(1 - reward) FILTER (nx <= seq + 150), 0), 4) AS regret, CAST(count(*) FILTER (nx <= seq + 150) AS INT) AS completed, CAST(count(*) FILTER (nx IS NULL) AS INT) AS missing FROM z GROUP BY user_id",
)
lags = lambda a, d: outcomes(stream(a, d)).filter("seq < 1000000000").join(stream(a, d).select(F.col("seq").alias("decision_id"), "user_id"), "decision_id").withColumn("lag", F.col("observed_at") - F.col("decision_id"))
add(
    "b19_latency",
    lambda a, d: B.latency(lags(a, d), "lag", KEYS).withColumn("lag_mean", r("lag_mean")),
    ", z AS (SELECT user_id, lead(seq) OVER (PARTITION BY user_id ORDER BY seq) - seq AS lag FROM s), l AS (SELECT user_id, list_sort(list(lag)) AS xs, avg(lag) AS m FROM z WHERE lag IS NOT NULL GROUP BY user_id) SELECT user_id, len(xs) AS n, xs[1] AS lag_min, xs[len(xs)] AS lag_max, round(m, 4) AS lag_mean, xs[CAST(ceil((len(xs) - 1) * 95 / 100.0) AS BIGINT) + 1] AS lag_p95 FROM l",
)
add(
    "b22_recommendation",
    lambda a, d: B.recommend(stream(a, d), ["user_id"], "arm", "reward").select("user_id", "recommended", r("confidence", 6).alias("confidence")),
    ", g AS (SELECT user_id, arm, count(*) AS pulls, avg(reward) AS mean FROM s GROUP BY ALL) SELECT user_id, arg_max(arm, {'m': mean, 'p': -pulls, 'a': -arm}) AS recommended, round(arg_max(pulls, {'m': mean, 'p': -pulls, 'a': -arm}) / sum(pulls)::DOUBLE, 6) AS confidence FROM g GROUP BY user_id",
)
add(
    "b23_adapter_outcomes",
    lambda a, d: marked(a, d).filter("status = 'Completed'").groupBy("action").agg(F.count(F.lit(1)).alias("pulls"), r(F.sum("reward")).alias("total"), r(F.avg("reward"), 6).alias("mean")),
    _OUT + "SELECT action, count(*) AS pulls, round(sum(reward), 4) AS total, round(avg(reward), 6) AS mean FROM f WHERE status = 'Completed' GROUP BY action",
)
add(
    "b24_adapter_health",
    lambda a, d: stream(a, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("at")).agg(F.count(F.lit(1)).alias("partitions"), F.sum("n").alias("total"), F.max("n").alias("most"), F.min("n").alias("least"), F.sum((F.col("at") < 9000).cast("bigint")).alias("stale")),
    ", g AS (SELECT user_id, count(*) AS n, max(seq) AS at_ FROM s GROUP BY user_id) SELECT count(*) AS partitions, CAST(sum(n) AS BIGINT) AS total, max(n) AS most, min(n) AS least, CAST(sum(CASE WHEN at_ < 9000 THEN 1 ELSE 0 END) AS BIGINT) AS stale FROM g",
)

# ---- diagnostics
lead_ = lambda a, d: B.leaders(with_predictions(stream(a, d)).withColumns({"pred": r("pred", 6), "pred2": r("pred2", 6)}), KEYS, "seq", "x", ["pred", "pred2"], 20)
add(
    "d01_baseline_comparator",
    lambda a, d: lead_(a, d).select("seq", r("mae_0").alias("mae_0"), r("mae_1").alias("mae_1")),
    f"SELECT seq, round(avg(abs(x - round(pred, 6))) {lasting(20)}, 4) AS mae_0, round(avg(abs(x - round(pred2, 6))) {lasting(20)}, 4) AS mae_1 FROM s",
)
add(
    "d02_model_selector",
    lambda a, d: run_batch(with_predictions(stream(a, d)).select("user_id", "seq", F.col("x").alias("y"), F.array("pred", "pred2").alias("preds")), K.Selector(2, 20, 10, 5), KEYS, ORDER),
)
_EWREC = """, z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i, abs(x - pred) AS err FROM s), r AS (SELECT user_id, i, seq, pred, x, err, NULL::DOUBLE AS before, err AS m, err AS best FROM z WHERE i = 1
UNION ALL SELECT z.user_id, z.i, z.seq, z.pred, z.x, z.err, r.m, 0.1::DOUBLE * z.err + 0.9::DOUBLE * r.m, least(r.best, z.err) FROM r JOIN z ON z.user_id = r.user_id AND z.i = r.i + 1) """


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, x, pred, err and the errors' weighted mean before and after each row."""
    s = with_predictions(stream(spark, sf_dir)).withColumn("err", F.abs(F.col("x") - F.col("pred")))
    ew = run_batch(s.select("user_id", "seq", F.col("err").alias("x")), K.EwMean(0.1), KEYS, ORDER)
    return s.join(ew, ["user_id", "seq"]).withColumns({"before": F.lag("ew").over(_line()), "n": F.count(F.lit(1)).over(W), "best": F.min("err").over(W)})


add(
    "d03_residual_interval",
    lambda a, d: errors(a, d).select("seq", r(F.col("pred") - 2 * F.col("before")).alias("lo"), r(F.col("pred") + 2 * F.col("before")).alias("hi")),
    _EWREC + "SELECT seq, round(pred - 2 * before, 4) AS lo, round(pred + 2 * before, 4) AS hi FROM r",
    _REC,
)
add(
    "d04_interval_contains",
    lambda a, d: errors(a, d).select("seq", F.col("x").between(F.col("pred") - 2 * F.col("before"), F.col("pred") + 2 * F.col("before")).alias("inside")),
    _EWREC + "SELECT seq, x BETWEEN pred - 2 * before AND pred + 2 * before AS inside FROM r",
    _REC,
)
_STATE = "CASE WHEN i < 5 THEN 'WarmingUp' WHEN err > 200 THEN 'Degraded' WHEN i >= 20 AND err <= 100 THEN 'Stable' ELSE 'Usable' END"
add("d05_warmup", lambda a, d: errors(a, d).select("seq", warm.alias("state")), _EWREC + f"SELECT seq, {_STATE} AS state FROM r", _REC)
add(
    "d06_training_summary",
    lambda a, d: errors(a, d).select("seq", "n", r("ew").alias("recent"), r("best").alias("best"), (F.col("ew") < 100).alias("beats_baseline")),
    _EWREC + "SELECT seq, i AS n, round(m, 4) AS recent, round(best, 4) AS best, m < 100 AS beats_baseline FROM r",
    _REC,
)
add(
    "d07_prediction_report",
    lambda a, d: errors(a, d).select("seq", r("pred").alias("pred"), B.confidence(warm, F.col("ew") < 100).alias("confidence")),
    _EWREC + f", q AS (SELECT *, {_STATE} AS state FROM r) SELECT seq, round(pred, 4) AS pred, CASE WHEN state IN ('WarmingUp', 'Degraded') THEN 'Low' WHEN state = 'Stable' AND m < 100 THEN 'High' ELSE 'Medium' END AS confidence FROM q",
    _REC,
)
add(
    "d08_model_health",
    lambda a, d: B.model_health(stream(a, d).select("user_id", F.array("x", F.when(F.col("seq") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("h"))).alias("weights")), KEYS, "weights").withColumns({"lo": r("lo"), "hi": r("hi")}),
    "SELECT user_id, 2 * count(*) AS n_parameters, round(least(min(x), min(CASE WHEN seq % 50 <> 0 THEN h END)), 4) AS lo, round(greatest(max(x), max(CASE WHEN seq % 50 <> 0 THEN h END)), 4) AS hi, CAST(sum(CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_inf, 16 * count(*) AS bytes, sum(CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END) = 0 AS healthy FROM s GROUP BY user_id",
)

# ---- offline helpers
add("a01_score_curves", lambda a, d: stream(a, d).select("seq", F.posexplode(F.array("h", "k")).alias("arm", "score")), "SELECT seq, 0 AS arm, h AS score FROM s UNION ALL SELECT seq, 1, k FROM s")
add("a02_drift_timeline", lambda a, d: stream(a, d).filter(level == "Drift").select("seq", level.alias("level")), "SELECT seq, 'Drift' AS level FROM s WHERE x > 300")
add("a03_feedback_latencies", lambda a, d: lags(a, d).select(F.col("decision_id").alias("seq"), "lag"), "SELECT * FROM (SELECT seq, lead(seq) OVER (PARTITION BY user_id ORDER BY seq) - seq AS lag FROM s) WHERE lag IS NOT NULL")
add(
    "a04_baseline_comparison",
    lambda a, d: stream(a, d).filter("xm IS NOT NULL").agg(r(F.sum(F.col("xm") / 500), 3).alias("reward"), r(F.sum("reward"), 3).alias("baseline"), F.count(F.lit(1)).alias("n")),
    "SELECT round(sum(xm / 500), 3) AS reward, round(sum(reward), 3) AS baseline, count(*) AS n FROM s WHERE xm IS NOT NULL",
)
by_row("a07_modified_z", lambda: 0.6744897501960817 * (x - 100) / 25, "0.6744897501960817::DOUBLE * (x - 100) / 25")

# ---- snapshots and schemas
add(
    "u06_inspect_snapshots",
    lambda a, d: N.inspect(N.snapshots(stream(a, d).select(F.array("x", "h").alias("weights")))).withColumns({"lo": r("lo"), "hi": r("hi")}),
    "SELECT 1 AS version, 2 AS n_weights, round(least(x, h), 4) AS lo, round(greatest(x, h), 4) AS hi FROM s",
)
add("u07_feature_constraint", lambda a, d: stream(a, d).select("seq", N.Feature("x", lo=10.0, hi=400.0).holds(F.col("x")).alias("holds")), "SELECT seq, x BETWEEN 10 AND 400 AS holds FROM s")
