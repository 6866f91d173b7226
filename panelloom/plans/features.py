"""Windows, lags, calendar and scalar functions over the daily panel."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelloom.operators import backtest as bt
from panelloom.operators import windows as w
from panelloom.plans.base import PANEL, Plans
from panelloom.sources.panels import orders_panel

plan = Plans()
QUERIES, SQL = plan.queries, plan.sql
KEYS = ["region", "event_date"]
OVER = "OVER (PARTITION BY region ORDER BY t_idx"


def _windowed(*columns: str) -> str:
    return PANEL + f" SELECT region, event_date, {', '.join(columns)} FROM panel"


@plan(_windowed(f"sum(y) {OVER} ROWS 6 PRECEDING)::BIGINT AS sum_7", f"sum(y) {OVER} ROWS 13 PRECEDING)::BIGINT AS sum_14"))
def win_rolling_sum(spark, sf_dir):
    return orders_panel(spark, sf_dir).select(*KEYS, w.rolling_sum("y", 7).alias("sum_7"), w.rolling_sum("y", 14).alias("sum_14"))


@plan(_windowed(f"round(avg(y) {OVER} ROWS 6 PRECEDING), 6) AS mean_7", f"round(avg(y) {OVER} ROWS 27 PRECEDING), 6) AS mean_28"))
def win_rolling_mean(spark, sf_dir):
    return orders_panel(spark, sf_dir).select(*KEYS, F.round(w.rolling_mean("y", 7), 6).alias("mean_7"), F.round(w.rolling_mean("y", 28), 6).alias("mean_28"))


@plan(_windowed(f"sum(y) {OVER} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)::BIGINT AS lagged_sum_7"))
def win_lagged_sum(spark, sf_dir):
    return orders_panel(spark, sf_dir).select(*KEYS, w.rolling_sum("y", 7, shift=1).alias("lagged_sum_7"))


@plan(_windowed(f"round(avg(y) {OVER} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 6) AS lagged_mean_28"))
def win_lagged_mean(spark, sf_dir):
    return orders_panel(spark, sf_dir).select(*KEYS, F.round(w.rolling_mean("y", 28, shift=1), 6).alias("lagged_mean_28"))


def _ewm_sql(alpha: float, adjust: bool, shift: int, name: str) -> str:
    """Weighted sums over a list of the steps that count."""
    k, keep = w.kept_steps(alpha), 1 - alpha
    frame = f"{OVER} ROWS BETWEEN {k - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
    held = f"list(y::DOUBLE) {frame}"
    if adjust:
        total = f"list_reduce(list_prepend(0.0::DOUBLE, v), lambda s, x: s * {keep!r}::DOUBLE + x)"
        value = f"{total} / list_reduce(list_prepend(0.0::DOUBLE, list_transform(v, lambda x: 1.0::DOUBLE)), lambda s, x: s * {keep!r}::DOUBLE + x)"
    else:
        value = f"list_reduce(v, lambda s, x: s * {keep!r}::DOUBLE + x * {alpha!r}::DOUBLE)"
    return PANEL + f" SELECT region, event_date, CASE WHEN len(v) > 0 THEN round({value}, 6) END AS {name} FROM (SELECT *, {held} AS v FROM panel)"


SPAN, DECAY = 2 / 15, w.retention_from_halflife(7)


@plan(_ewm_sql(SPAN, True, 0, "ewm_14"))
def win_ewm_span(spark, sf_dir):
    return orders_panel(spark, sf_dir).select(*KEYS, F.round(w.ewm("y", SPAN), 6).alias("ewm_14"))


@plan(_ewm_sql(DECAY, True, 0, "ewm_alpha"))
def win_ewm_alpha(spark, sf_dir):
    return orders_panel(spark, sf_dir).select(*KEYS, F.round(w.ewm("y", DECAY), 6).alias("ewm_alpha"))


@plan(_ewm_sql(SPAN, False, 1, "lagged_ewm"))
def win_lagged_ewm(spark, sf_dir):
    return orders_panel(spark, sf_dir).select(*KEYS, F.round(w.ewm("y", SPAN, adjust=False, shift=1), 6).alias("lagged_ewm"))


@plan(_ewm_sql(DECAY, False, 1, "lagged_decay"))
def win_lagged_decay(spark, sf_dir):
    return orders_panel(spark, sf_dir).select(*KEYS, F.round(w.ewm("y", DECAY, adjust=False, shift=1), 6).alias("lagged_decay"))


@plan(_windowed("y", *[f"coalesce(sum({c}) {OVER} ROWS 6 PRECEDING), 0)::BIGINT AS {c}_sum_7" for c in ("urgent", "high")], *[f"round(avg({c}) {OVER} ROWS 27 PRECEDING), 6) AS {c}_mean_28" for c in ("urgent", "high")]))
def win_feature_block(spark, sf_dir):
    """Originals beside transformed columns, nulls as 0, in one window pass."""
    block = [w.rolling_sum(c, 7).alias(f"{c}_sum_7") for c in ("urgent", "high")] + [F.round(w.rolling_mean(c, 28), 6).alias(f"{c}_mean_28") for c in ("urgent", "high")]
    return orders_panel(spark, sf_dir).select(*KEYS, "y", *block).fillna(0)


@plan(_windowed(*[f"lag(y, {k}) {OVER}) AS y_lag_{k}" for k in range(1, 8)]))
def win_target_lags(spark, sf_dir):
    return orders_panel(spark, sf_dir).select(*KEYS, *[F.lag("y", k).over(w.steps()).alias(f"y_lag_{k}") for k in range(1, 8)])


@plan(_windowed(*[f"lag(urgent, {k}) {OVER}) AS urgent_lag_{k}" for k in (1, 7, 14)]))
def win_past_lags(spark, sf_dir):
    return orders_panel(spark, sf_dir).select(*KEYS, *[F.lag("urgent", k).over(w.steps()).alias(f"urgent_lag_{k}") for k in (1, 7, 14)])


_WEEKEND = "(isodow(event_date) >= 6)::INT"


@plan(_windowed(*[f"lead({_WEEKEND}, {k}) {OVER}) AS weekend_{'m' if k < 0 else 'p'}{abs(k)}".replace("lead((isodow(event_date) >= 6)::INT, -", "lag((isodow(event_date) >= 6)::INT, ") for k in range(-2, 7)]))
def win_future_leads(spark, sf_dir):
    """Known-ahead covariate from two steps back to six ahead."""
    panel = orders_panel(spark, sf_dir).withColumn("weekend", (F.weekday("event_date") >= 5).cast("int"))
    return panel.select(*KEYS, *[F.lead("weekend", k).over(w.steps()).alias(f"weekend_{'m' if k < 0 else 'p'}{abs(k)}") for k in range(-2, 7)])


@plan(PANEL + f" SELECT region, event_date, h::INT AS horizon, CASE h {' '.join(f'WHEN {h} THEN l{h}' for h in range(1, 8))} END AS label FROM (SELECT *, {', '.join(f'lead(y, {h - 1}) {OVER}) AS l{h}' for h in range(1, 8))} FROM panel) CROSS JOIN (SELECT unnest(range(1, 8)) AS h)")
def win_direct_labels(spark, sf_dir):
    """A label for each horizon: y at this step .. six steps on."""
    labels = F.array(*[F.lead("y", h - 1).over(w.steps()) for h in range(1, 8)])
    held = orders_panel(spark, sf_dir).select(*KEYS, labels.alias("labels"))
    return held.select(*KEYS, F.posexplode_outer("labels").alias("h", "label")).select(*KEYS, (F.col("h") + 1).alias("horizon"), "label")


@plan(PANEL + f" SELECT * FROM (SELECT region, event_date, y - lag(y) {OVER}) AS dy FROM panel) WHERE dy IS NOT NULL")
def win_diff(spark, sf_dir):
    return orders_panel(spark, sf_dir).select(*KEYS, (F.col("y") - F.lag("y").over(w.steps())).alias("dy")).filter("dy IS NOT NULL")


@plan(PANEL + """, size AS (SELECT max(t_idx) + 1 AS n, CAST(floor(0.8 * (max(t_idx) + 1)) AS INT) AS start FROM panel)
SELECT region, CAST((t_idx - start) // 7 AS INT) AS fold, CAST((t_idx - start) % 7 + 1 AS INT) AS horizon, y AS level FROM panel, size
WHERE t_idx >= start AND (t_idx - start) // 7 * 7 + start + 7 <= n""")
def win_undiff(spark, sf_dir):
    """Running sums of differences over the horizon on top of the last known level give the levels back."""
    panel = orders_panel(spark, sf_dir)
    n = bt.length(panel)
    diffs = panel.withColumn("dy", F.col("y") - F.lag("y").over(w.steps()))
    skeleton = bt.folds(panel, int(0.8 * n), 7, 7, n)
    held = bt.at(diffs, "dy", "dy", F.col("t0") + F.col("horizon") - 1, skeleton)
    held = bt.at(panel, "y", "anchor", F.col("t0") - 1, held)
    over = w.Window.partitionBy("region", "fold").orderBy("horizon")
    return held.select("region", "fold", "horizon", (F.col("anchor") + F.sum("dy").over(over)).alias("level"))


@plan("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::INT AS horizon FROM lineitem")
def win_horizon_index(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select("l_orderkey", "l_linenumber", F.row_number().over(w.Window.partitionBy("l_orderkey").orderBy("l_linenumber")).alias("horizon"))


@plan("SELECT o_orderkey, month(d)::INT AS month, weekofyear(d)::INT AS week, dayofyear(d)::INT AS day_of_year, (isodow(d) >= 6)::INT AS is_weekend, (isodow(d) - 1)::INT AS weekday, day(d)::INT AS day FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def fn_calendar(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", F.month(d).alias("month"), F.weekofyear(d).alias("week"), F.dayofyear(d).alias("day_of_year"), (F.weekday(d) >= 5).cast("int").alias("is_weekend"), F.weekday(d).alias("weekday"), F.dayofmonth(d).alias("day")
    )


CYCLES = {"month": ("month(d)", 12), "week": ("weekofyear(d)", 52), "dayofyear": ("dayofyear(d)", 365), "dayofweek": ("weekday(d)", 7), "day": ("dayofmonth(d)", 31)}
_CYCLE_SQL = [f"round({f}(2 * pi() * {e.replace('weekday(d)', '(isodow(d) - 1)')} / {p}), 6) + 0.0 AS {n}_{f}" for n, (e, p) in CYCLES.items() for f in ("sin", "cos")]


@plan(f"SELECT o_orderkey, {', '.join(_CYCLE_SQL)} FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def fn_cyclic(spark, sf_dir):
    held = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    turn = lambda f, e, p: F.round(f(F.lit(2 * math.pi) * F.expr(e) / p), 6) + 0.0
    return held.select("o_orderkey", *[turn(f, e, p).alias(f"{n}_{k}") for n, (e, p) in CYCLES.items() for k, f in (("sin", F.sin), ("cos", F.cos))])


@plan("SELECT l_orderkey, l_linenumber, round(pow(2, -1 / l_quantity), 6) AS retention, round(1 - pow(2, -1 / l_quantity), 6) AS alpha, round(-1 / log2(pow(2, -1 / l_quantity)), 6) AS halflife FROM lineitem")
def fn_halflife(spark, sf_dir):
    kept = F.pow(F.lit(2.0), -1 / F.col("l_quantity"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.round(kept, 6).alias("retention"), F.round(1 - kept, 6).alias("alpha"), F.round(-1 / F.log2(kept), 6).alias("halflife"))


@plan(PANEL + " SELECT region, event_date, round(ln(1 + greatest(y, 0)), 6) AS log_level, y::DOUBLE AS level FROM panel")
def fn_log_level_roundtrip(spark, sf_dir):
    level = F.log1p(F.greatest("y", F.lit(0)))
    return orders_panel(spark, sf_dir).select(*KEYS, F.round(level, 6).alias("log_level"), (F.round(F.expm1(level), 6) + 0.0).alias("level"))


@plan("SELECT event_id, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-ln(p / (1 - p)))), 6) AS prob FROM (SELECT event_id, least(greatest((event_id % 101) / 100.0::DOUBLE, 1e-6), 1 - 1e-6) AS p FROM events)")
def fn_logit(spark, sf_dir):
    p = F.least(F.greatest((F.col("event_id") % 101) / F.lit(100.0), F.lit(1e-6)), F.lit(1 - 1e-6))
    z = F.ln(p / (1 - p))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(z, 6).alias("logit"), F.round(1 / (1 + F.exp(-z)), 6).alias("prob"))


@plan(r"SELECT n_name, lower(trim(n_name)) AS low, replace(n_name, '_', '-') AS dashed, contains(n_name, '_1') AS has, starts_with(n_name, 'NATION') AS starts, ends_with(n_name, '3') AS ends, regexp_extract(n_name, '^(.*)_([^_]*)$', 1) AS head, regexp_extract(n_name, '^(.*)_([^_]*)$', 2) AS tail, len(str_split(n_name, '_'))::INT AS parts FROM nation")
def fn_name_strings(spark, sf_dir):
    n = F.col("n_name")
    last = r"^(.*)_([^_]*)$"
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        n, F.lower(F.trim(n)).alias("low"), F.replace(n, F.lit("_"), F.lit("-")).alias("dashed"), n.contains("_1").alias("has"), n.startswith("NATION").alias("starts"), n.endswith("3").alias("ends"),
        F.regexp_extract(n, last, 1).alias("head"), F.regexp_extract(n, last, 2).alias("tail"), F.size(F.split(n, "_")).alias("parts"),
    )


@plan(_windowed(*[f"lead(revenue_cents, {i}) {OVER}) AS frcst_{i}_revenue" for i in range(1, 7)]))
def dummy_lead_forecast(spark, sf_dir):
    """True later values as pretended forecasts for 1 .. ndays - 1 days ahead (ndays 7), within each region."""
    return orders_panel(spark, sf_dir).select(*KEYS, *[F.lead("revenue_cents", i).over(w.steps()).alias(f"frcst_{i}_revenue") for i in range(1, 7)])


def _noisy(frame, column: str, multiplier: float, seed: int):
    spread = frame.agg(F.stddev(column).alias("s")).first()["s"] or 0.0
    return F.col(column) + F.randn(seed) * spread * multiplier


@plan()
def dummy_noise(spark, sf_dir):
    """Gaussian noise of a tenth of the column's deviation."""
    panel = orders_panel(spark, sf_dir)
    return panel.select(*KEYS, "y", _noisy(panel, "y", 0.1, 7).alias("y_noisy"))


@plan()
def dummy_noise_by_day(spark, sf_dir):
    """Noise that grows with the forecast day; a day without an entry takes 0.1. Columns match by whole prefix frcst_<i>_."""
    frame = dummy_lead_forecast(spark, sf_dir)
    amount = {1: 0.05, 2: 0.1, 3: 0.2}
    return frame.select(*KEYS, *[_noisy(frame, f"frcst_{i}_revenue", amount.get(i, 0.1), i).alias(f"frcst_{i}_revenue") for i in range(1, 7)])


@plan(PANEL + ", span AS (SELECT CAST(floor(0.8 * (max(t_idx) + 1)) AS INT) AS t0 FROM panel) SELECT region, t_idx, y, CASE WHEN t_idx < t0 THEN 'context' ELSE 'target' END AS part FROM panel, span WHERE t_idx < t0 + 7")
def ts_slice_by_step(spark, sf_dir):
    """Everything before t0, and the horizon's steps from t0 on."""
    panel = orders_panel(spark, sf_dir)
    t0 = int(0.8 * bt.length(panel))
    return panel.filter(F.col("t_idx") < t0 + 7).select("region", "t_idx", "y", F.when(F.col("t_idx") < t0, "context").otherwise("target").alias("part"))

