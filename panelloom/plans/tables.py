"""Sources, sinks, profiles, projections, reshapes, joins and set operations."""

from __future__ import annotations


from pyspark.sql import functions as F

from panelloom.operators import backtest as bt
from panelloom.operators import reshape as rs
from panelloom.plans.base import PANEL, PREDS, Plans, scratch
from panelloom.sources.panels import PRIORITIES, orders_panel, table, tiers, wide

plan = Plans()
QUERIES, SQL = plan.queries, plan.sql
R = lambda c, n=6: F.round(c, n) + 0.0
FAMILIES = list(PRIORITIES)


# --- sources and sinks -------------------------------------------------------------------------


@plan("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders")
def scan_panel_source(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))


@plan("SELECT lower(replace(trim(n_name), ',', '')) AS name FROM nation")
def src_name_list(spark, sf_dir):
    """A text file of one name a line, with commas and blanks, written from nation and read back."""
    path = scratch(spark)
    table(spark, sf_dir, "nation").select(F.concat(F.lit(" "), "n_name", F.lit(", ")).alias("value")).write.text(path)
    return rs.name_list(spark, path)


@plan("SELECT lower(n_name) AS member, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey")
def dim_group_members(spark, sf_dir):
    """A JSON object {group: [members]}, written from region and nation and read back."""
    held = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = held.groupBy("r_name").agg(F.sort_array(F.collect_list(F.lower("n_name"))).alias("m"))  # a dimension of a few rows
    path = scratch(spark)
    lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "m")))).alias("value")).write.text(path)
    return rs.group_members(spark, path)


@plan(PANEL + " SELECT region, tier FROM tiers WHERE tier IS NOT NULL")
def dim_region_tier(spark, sf_dir):
    """A JSON object {tier name: [regions]}, turned around."""
    names = F.element_at(F.array(*map(F.lit, rs.TIER_NAMES)), F.col("tier") + 1)
    lists = tiers(orders_panel(spark, sf_dir)).filter("tier IS NOT NULL").groupBy(names.alias("t")).agg(F.collect_list("region").alias("m"))
    path = scratch(spark)
    lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("t", "m")))).alias("value")).write.text(path)
    return rs.region_tiers(spark, path)


_RATE = "SELECT region, sum(y)::BIGINT AS total, round(avg(y), 6) AS mean FROM panel GROUP BY region"


def _rates(spark, sf_dir):
    return orders_panel(spark, sf_dir).groupBy("region").agg(F.sum("y").alias("total"), R(F.avg("y")).alias("mean"))


@plan(PANEL + _RATE)
def sink_csv(spark, sf_dir):
    path = scratch(spark)
    _rates(spark, sf_dir).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="region string, total long, mean double")


@plan(PREDS + " SELECT region, fold, horizon, date, y_true, y_pred FROM preds")
def sink_parquet(spark, sf_dir):
    path = scratch(spark)
    bt.long_predictions(orders_panel(spark, sf_dir)).select("region", "fold", "horizon", "date", "y_true", "y_pred").write.parquet(path)
    return spark.read.parquet(path)


@plan(PANEL + " SELECT count(*)::BIGINT AS n, sum(y)::BIGINT AS total, round(avg(y), 6) AS mean FROM panel")
def sink_json(spark, sf_dir):
    path = scratch(spark)
    orders_panel(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("y").alias("total"), R(F.avg("y")).alias("mean")).write.json(path)
    return spark.read.json(path, schema="n long, total long, mean double")


@plan(PREDS + " SELECT split, paradigm, model, region, round(avg(abs(v - y_true)), 6) AS MAE FROM (SELECT 'test' AS split, 'naive' AS paradigm, 'weekly' AS model, region, y_pred AS v, y_true FROM preds UNION ALL SELECT 'test', 'naive', 'last', region, y_last, y_true FROM preds) GROUP BY ALL")
def sink_partitioned_runs(spark, sf_dir):
    """A folder for each split, regime and model; read back as one table."""
    p = bt.long_predictions(orders_panel(spark, sf_dir))
    runs = None
    for name, column in (("weekly", "y_pred"), ("last", "y_last")):
        run = p.groupBy("region").agg(R(F.avg(F.abs(F.col(column) - F.col("y_true")))).alias("MAE")).select(F.lit("test").alias("split"), F.lit("naive").alias("paradigm"), F.lit(name).alias("model"), "region", "MAE")
        runs = run if runs is None else runs.unionByName(run)
    path = scratch(spark)
    runs.write.partitionBy("split", "paradigm", "model").parquet(path)
    return spark.read.parquet(path)


# --- profiles ------------------------------------------------------------------------------------


@plan(PANEL + " SELECT count(*)::BIGINT AS n_rows, 10::BIGINT AS n_columns, min(event_date) AS first_date, max(event_date) AS last_date, count(DISTINCT region)::BIGINT AS n_regions FROM panel")
def profile_source(spark, sf_dir):
    p = orders_panel(spark, sf_dir)
    return p.agg(F.count("*").alias("n_rows"), F.lit(len(p.columns)).cast("long").alias("n_columns"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"), F.countDistinct("region").alias("n_regions"))


@plan(PANEL + ", w AS (SELECT t.tier, lag(y, 1) OVER (PARTITION BY p.region ORDER BY t_idx) AS y_lag, y FROM panel p JOIN tiers t USING (region)) SELECT * FROM (SELECT 'tier' AS name, count(*) FILTER (WHERE tier IS NULL)::BIGINT AS nulls FROM w UNION ALL SELECT 'y_lag', count(*) FILTER (WHERE y_lag IS NULL) FROM w UNION ALL SELECT 'y', count(*) FILTER (WHERE y IS NULL) FROM w) WHERE nulls > 0")
def profile_nulls(spark, sf_dir):
    from pyspark.sql import Window

    p = orders_panel(spark, sf_dir)
    held = p.join(F.broadcast(tiers(p)), "region").select("tier", F.lag("y").over(Window.partitionBy("region").orderBy("t_idx")).alias("y_lag"), "y")
    return rs.null_profile(held)


@plan("SELECT min(n)::BIGINT AS shortest, max(n)::BIGINT AS longest, CAST(round(0.2 * max(n)) AS BIGINT) AS test_length FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def profile_series_length(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").count()
    return n.agg(F.min("count").alias("shortest"), F.max("count").alias("longest"), F.round(F.max("count") * F.lit(0.2)).cast("long").alias("test_length"))


@plan(PANEL + " SELECT region, round(stddev(urgent), 6) AS deviation, count(DISTINCT urgent)::BIGINT AS n_values, false AS has_inf, count(DISTINCT urgent) <= 1 OR stddev(urgent) = 0 AS degenerate FROM panel GROUP BY region")
def profile_degenerate(spark, sf_dir):
    inf = F.max(F.col("urgent").cast("double").isin(float("inf"), float("-inf")))
    return orders_panel(spark, sf_dir).groupBy("region").agg(R(F.stddev("urgent")).alias("deviation"), F.countDistinct("urgent").alias("n_values"), inf.alias("has_inf"), ((F.countDistinct("urgent") <= 1) | (F.stddev("urgent") == 0)).alias("degenerate"))


# --- projections and filters ---------------------------------------------------------------------


@plan("SELECT o_orderkey, o_orderdate::DATE AS o_orderdate FROM orders")
def proj_columns_like(spark, sf_dir):
    """Columns whose lower-cased name holds a token, beside the key."""
    o = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return o.select("o_orderkey", *rs.columns_like(o, "DATE"))


@plan(PANEL + " SELECT region, event_date, urgent, low FROM panel")
def proj_safe_subset(spark, sf_dir):
    """Of a ranked list of features those that exist."""
    p = orders_panel(spark, sf_dir)
    return p.select("region", "event_date", *rs.safe_subset(p, ["urgent", "absent", "low"]))


@plan(PANEL + " SELECT split_part(raw, '_', 1) AS family, count(*)::BIGINT AS n_rows, count(DISTINCT region)::BIGINT AS n_regions FROM (SELECT region, event_date, 'urgent_' || region AS raw FROM panel WHERE urgent > 0 UNION ALL SELECT region, event_date, 'high_' || region FROM panel WHERE high > 0) GROUP BY 1")
def proj_base_names(spark, sf_dir):
    """Family of each wide column (its name without the last token) and what it covers."""
    long = rs.unpivoted(orders_panel(spark, sf_dir).select("region", "event_date", "urgent", "high"), ["region", "event_date"], "metric", "value").filter("value > 0")
    raw = F.concat("metric", F.lit("_"), "region")
    return long.groupBy(F.regexp_replace(raw, "_[^_]*$", "").alias("family")).agg(F.count("*").alias("n_rows"), F.countDistinct("region").alias("n_regions"))


@plan(PANEL + " SELECT region, event_date, y, urgent, high, (isodow(event_date) >= 6)::INT AS is_weekend, tier FROM panel JOIN tiers USING (region)")
def proj_covariate_roles(spark, sf_dir):
    """A PanelSpec names target, past, future and static columns; the frame holds just those."""
    p = orders_panel(spark, sf_dir).withColumn("is_weekend", (F.weekday("event_date") >= 5).cast("int"))
    spec = rs.split_roles(p.columns, target="y", future=["is_weekend"], exclude=["revenue_cents", "medium", "notspec", "low", "t_idx"])
    return p.join(F.broadcast(tiers(p)), "region").select(spec.key, spec.time, spec.target, *spec.past, *spec.future, *spec.static)


@plan(PANEL + " SELECT region, event_date, urgent + high + medium + notspec + low AS total FROM panel")
def proj_row_total(spark, sf_dir):
    return orders_panel(spark, sf_dir).select("region", "event_date", rs.row_total(FAMILIES).alias("total"))


@plan(PANEL + " SELECT event_date, sum(urgent)::BIGINT AS urgent_total, sum(high)::BIGINT AS high_total FROM panel GROUP BY event_date")
def proj_type_totals(spark, sf_dir):
    """National totals by type from the wide table: columns that hold one token and not another."""
    w = wide(orders_panel(spark, sf_dir), ["urgent", "high"])
    return w.select("event_date", *[rs.row_total([c for c in w.columns if k in c and "date" not in c]).alias(f"{k}_total") for k in ("urgent", "high")])


@plan(PANEL + " SELECT region, event_date, y, tier FROM panel JOIN tiers USING (region) WHERE tier IS DISTINCT FROM 0")
def filter_active_tiers(spark, sf_dir):
    """Tier 0 goes; an unknown tier stays."""
    p = orders_panel(spark, sf_dir)
    return p.join(F.broadcast(tiers(p)), "region").filter(~F.col("tier").eqNullSafe(0)).select("region", "event_date", "y", "tier")


@plan(PANEL + ", s AS (SELECT region, sum(urgent) / count(urgent) < 0.05 AS low FROM panel GROUP BY region) SELECT 'urgent_' || region AS name, low AS dropped FROM s")
def filter_low_prevalence(spark, sf_dir):
    """Columns of a family whose positive sum per value is below the ratio; one pass, one row to the driver."""
    w = wide(orders_panel(spark, sf_dir), ["urgent"])
    _, dropped = rs.drop_low_prevalence(w, 0.05, "urgent_")
    names = [c for c in w.columns if c.startswith("urgent_")]
    return w.limit(1).select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(c in dropped).alias("dropped")) for c in names])).alias("x")).select("x.*")


@plan(PANEL + " SELECT region, event_date, (y > 0)::INT AS y_binary FROM panel")
def proj_binarize(spark, sf_dir):
    return rs.binarized(orders_panel(spark, sf_dir), "y").select("region", "event_date", "y_binary")


@plan(PANEL + " SELECT region, event_date, round(urgent / (y + 1), 6) AS ratio FROM panel")
def proj_ratio_feature(spark, sf_dir):
    p = orders_panel(spark, sf_dir)
    return p.select("region", "event_date", R(F.col("urgent") / (F.col("y") + 1)).alias("ratio"))


@plan(PANEL + " SELECT region, event_date, urgent * y AS interaction FROM panel")
def proj_interaction(spark, sf_dir):
    p = orders_panel(spark, sf_dir)
    first = rs.columns_like(p, "urg")[0]
    return p.select("region", "event_date", (F.col(first) * F.col("y")).alias("interaction"))


@plan(PANEL + " SELECT region, event_date, coalesce(nullif(urgent, 0), 0)::BIGINT AS urgent, nullif(low, 0) AS low FROM panel")
def proj_fill_zero(spark, sf_dir):
    p = orders_panel(spark, sf_dir).select("region", "event_date", *[F.nullif(c, F.lit(0)).alias(c) for c in ("urgent", "low")])
    return p.fillna(0, subset=rs.columns_like(p, "urgent"))


@plan(PANEL + " SELECT region, event_date, CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM panel")
def proj_positive_weight(spark, sf_dir):
    return orders_panel(spark, sf_dir).select("region", "event_date", F.when(F.col("y") > 0, 1.0).otherwise(0.0).alias("weight"))


@plan(PANEL + " SELECT region, event_date, y, 1.0::DOUBLE AS weight FROM panel WHERE y > 0 AND t_idx >= 7")
def join_weight_intersect(spark, sf_dir):
    """Weights and values on the days both have."""
    p = orders_panel(spark, sf_dir)
    weights = p.filter("y > 0").select("region", "event_date", F.lit(1.0).alias("weight"))
    return p.filter("t_idx >= 7").select("region", "event_date", "y").join(weights, ["region", "event_date"])


_IMPORTANCE = "SELECT l_orderkey, l_quantity, CASE l_linenumber % 4 WHEN 0 THEN 'qty_' || l_returnflag || '_pastcov_lag' || l_linenumber WHEN 1 THEN 'tax_futcov_lag' || l_linenumber WHEN 2 THEN 'tier_statcov_' || l_returnflag ELSE 'y_target_lag' || l_linenumber END AS feature FROM lineitem"


@plan(f"SELECT role, base, sum(CAST(l_quantity AS BIGINT))::BIGINT AS importance FROM (SELECT l_quantity, regexp_extract(feature, '^(.*?)_(pastcov|futcov|statcov|target)', 1) AS base, regexp_extract(feature, '^(.*?)_(pastcov|futcov|statcov|target)', 2) AS role FROM ({_IMPORTANCE})) GROUP BY role, base")
def parse_feature_names(spark, sf_dir):
    """Importance summed by role and base feature; the first role marker in a name decides."""
    k, flag = F.col("l_linenumber"), F.col("l_returnflag")
    name = F.when(k % 4 == 0, F.concat(F.lit("qty_"), flag, F.lit("_pastcov_lag"), k)).when(k % 4 == 1, F.concat(F.lit("tax_futcov_lag"), k)).when(k % 4 == 2, F.concat(F.lit("tier_statcov_"), flag)).otherwise(F.concat(F.lit("y_target_lag"), k))
    return rs.by_role(table(spark, sf_dir, "lineitem").select(name.alias("feature"), F.col("l_quantity").cast("long").alias("importance")))


# --- reshape -------------------------------------------------------------------------------------


@plan(PANEL + " SELECT event_date, 'y_' || region AS raw, y AS value FROM panel")
def reshape_unpivot(spark, sf_dir):
    w = wide(orders_panel(spark, sf_dir), ["y"])
    return rs.unpivoted(w, ["event_date"], "raw", "value")


@plan(PANEL + ", g AS (SELECT event_date, sum(y)::BIGINT AS all_y FROM panel GROUP BY event_date) SELECT region, event_date, y, urgent, all_y FROM panel JOIN g USING (event_date)")
def reshape_wide_to_long(spark, sf_dir):
    """Wide to long panel: suffix after the last underscore is the region, global columns come back by date."""
    p = orders_panel(spark, sf_dir)
    w = wide(p, ["y", "urgent"])
    total = [c for c in w.columns if c.startswith("y_")]
    w = w.withColumn("all_y", rs.row_total(total))
    regions = sorted({c.rsplit("_", 1)[1] for c in total})
    return rs.wide_to_long(w, regions, "event_date").select("region", "event_date", "y", "urgent", "all_y")


_FLOW = """WITH f AS (SELECT CAST(o_orderdate AS DATE) AS event_date, rc.r_name AS a, r2.r_name AS b, CAST(l_quantity AS BIGINT) AS q
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN region rc ON nc.n_regionkey = rc.r_regionkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN region r2 ON ns.n_regionkey = r2.r_regionkey),
grp AS (SELECT r_name, CASE WHEN r_regionkey = 0 THEN 'primary' WHEN r_regionkey <= 2 THEN 'red' ELSE 'blue' END AS g FROM region)"""


@plan(_FLOW + " SELECT event_date, 'flow_' || least(x.g, y.g) || '_' || greatest(x.g, y.g) AS pair, sum(q)::BIGINT AS value FROM f JOIN grp x ON a = x.r_name JOIN grp y ON b = y.r_name GROUP BY 1, 2")
def reshape_pair_rollup(spark, sf_dir):
    """Flows between members summed to unordered pairs of groups; a pair inside one group names it twice."""
    geo = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name", "r_regionkey")
    side = lambda x: F.broadcast(geo.select(F.col("n_nationkey").alias(f"k{x}"), F.col("r_name").alias(x)))
    flows = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("value"))
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("event_date")), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(side("a"), F.col("c_nationkey") == F.col("ka")).join(side("b"), F.col("s_nationkey") == F.col("kb"))
        .groupBy("event_date", "a", "b").agg(F.sum("value").alias("value"))
    )
    groups = geo.select(F.col("r_name").alias("member"), F.when(F.col("r_regionkey") == 0, "primary").when(F.col("r_regionkey") <= 2, "red").otherwise("blue").alias("grp")).distinct()
    return rs.pair_rollup(flows, groups, "flow")


@plan(PREDS + ", m AS (SELECT region, horizon, avg(abs(y_pred - y_true)) AS v FROM preds GROUP BY 1, 2) SELECT region, " + ", ".join(f"round(max(v) FILTER (WHERE horizon = {h}), 6) AS h{h}" for h in range(1, 8)) + ", round(avg(v), 6) AS row_mean FROM m GROUP BY region")
def reshape_region_horizon_matrix(spark, sf_dir):
    per = bt.long_predictions(orders_panel(spark, sf_dir)).groupBy("region", "horizon").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("v"))
    m = per.groupBy("region").pivot("horizon", list(range(1, 8))).agg(F.first("v"))
    return m.select("region", *[R(F.col(str(h))).alias(f"h{h}") for h in range(1, 8)], R(sum(F.col(str(h)) for h in range(1, 8)) / 7).alias("row_mean")).orderBy(F.desc("row_mean"))


_BY_MODEL = "(SELECT 'weekly' AS model, horizon, y_pred AS v, y_true FROM preds UNION ALL SELECT 'last', horizon, y_last, y_true FROM preds)"


def _by_model(spark, sf_dir):
    p = bt.long_predictions(orders_panel(spark, sf_dir))
    pick = lambda n, c: p.select(F.lit(n).alias("model"), "region", "horizon", F.col(c).alias("v"), "y_true")
    return pick("weekly", "y_pred").unionByName(pick("last", "y_last"))


@plan(PREDS + f" SELECT horizon, round(avg(abs(v - y_true)) FILTER (WHERE model = 'weekly'), 6) AS weekly, round(avg(abs(v - y_true)) FILTER (WHERE model = 'last'), 6) AS last FROM {_BY_MODEL} GROUP BY horizon")
def reshape_horizon_model_matrix(spark, sf_dir):
    return _by_model(spark, sf_dir).groupBy("horizon").pivot("model", ["weekly", "last"]).agg(R(F.avg(F.abs(F.col("v") - F.col("y_true")))))


@plan(PREDS + ", m AS (SELECT region, horizon, avg((y_prob - (y_true > 0)::INT) * (y_prob - (y_true > 0)::INT)) AS b FROM preds GROUP BY 1, 2) SELECT horizon, round(avg(b), 6) AS raw FROM m GROUP BY horizon")
def reshape_calibration_matrix(spark, sf_dir):
    """Brier score by horizon and method: a pivot that takes the mean."""
    d = F.col("y_prob") - (F.col("y_true") > 0).cast("int")
    per = bt.long_predictions(orders_panel(spark, sf_dir)).groupBy("region", "horizon").agg(F.avg(d * d).alias("b")).withColumn("method", F.lit("raw"))
    return per.groupBy("horizon").pivot("method", ["raw"]).agg(R(F.avg("b")))


# --- joins and sets ------------------------------------------------------------------------------


@plan(PANEL + ", g AS (SELECT event_date, sum(y)::BIGINT AS all_y FROM panel GROUP BY event_date) SELECT region, event_date, y, all_y FROM panel LEFT JOIN g USING (event_date)")
def join_global_by_date(spark, sf_dir):
    p = orders_panel(spark, sf_dir)
    return p.select("region", "event_date", "y").join(p.groupBy("event_date").agg(F.sum("y").alias("all_y")), "event_date", "left")


@plan(PANEL + " SELECT region, event_date, y, tier FROM panel LEFT JOIN tiers USING (region)")
def join_region_tier(spark, sf_dir):
    p = orders_panel(spark, sf_dir)
    return p.select("region", "event_date", "y").join(F.broadcast(tiers(p)), "region", "left")


@plan(PREDS + " SELECT p.region, p.fold, p.horizon, p.date, a.y AS y_true, p.y_pred FROM preds p JOIN panel a ON a.region = p.region AND a.event_date = p.date WHERE a.y > 0")
def join_pred_actual(spark, sf_dir):
    """Predictions with the actual values there are; others drop out (here actuals hold active days only)."""
    p = orders_panel(spark, sf_dir)
    actual = p.filter("y > 0").select("region", F.col("event_date").alias("date"), F.col("y").alias("y_true"))
    return bt.long_predictions(p).select("region", "fold", "horizon", "date", "y_pred").join(actual, ["region", "date"])


@plan(PREDS + " SELECT region, fold, horizon, round(y_prob * y_pred, 6) AS y_hurdle FROM preds")
def join_hurdle_stages(spark, sf_dir):
    """Probability and count of the two stages, joined by key, never by position."""
    p = bt.long_predictions(orders_panel(spark, sf_dir))
    keys = ["region", "fold", "horizon"]
    return p.select(*keys, "y_prob").join(p.select(*keys, "y_pred"), keys).select(*keys, R(F.col("y_prob") * F.col("y_pred")).alias("y_hurdle"))


@plan(PREDS + " SELECT region, fold, y_last AS anchor FROM preds WHERE horizon = 1")
def join_asof_anchor(spark, sf_dir):
    """The last level before each fold's first predicted day; the largest index below t0 wins, gaps or not."""
    p = orders_panel(spark, sf_dir)
    n = bt.length(p)
    return rs.asof(bt.folds(p, int(0.8 * n), n=n).filter("horizon = 1").drop("horizon"), p, "region", "t0", "t_idx", "y", "anchor").select("region", "fold", "anchor")


@plan(PANEL + ", w AS (SELECT region, f AS feature FROM (SELECT DISTINCT region FROM panel) CROSS JOIN (VALUES ('urgent'), ('high'), ('absent')) v(f)), h AS (SELECT DISTINCT region, 'urgent' AS feature FROM panel WHERE urgent > 0 UNION SELECT DISTINCT region, 'high' FROM panel WHERE high > 0) SELECT region, feature FROM w WHERE (region, feature) NOT IN (SELECT (region, feature) FROM h)")
def join_anti_missing(spark, sf_dir):
    """Wanted features that a region doesn't have."""
    p = orders_panel(spark, sf_dir)
    present = rs.unpivoted(p.select("region", "urgent", "high"), ["region"], "feature", "value").filter("value > 0").select("region", "feature").distinct()
    wanted = p.select("region").distinct().select("region", F.explode(F.array(*map(F.lit, ("urgent", "high", "absent")))).alias("feature"))
    return wanted.join(present, ["region", "feature"], "left_anti")


@plan(PREDS + " SELECT 'weekly' AS model, region, round(avg(abs(y_pred - y_true)), 6) AS MAE, NULL::DOUBLE AS ME FROM preds GROUP BY region UNION ALL SELECT 'last', region, NULL, round(avg(y_last - y_true), 6) FROM preds GROUP BY region")
def set_union_labelled(spark, sf_dir):
    p = bt.long_predictions(orders_panel(spark, sf_dir))
    a = p.groupBy("region").agg(R(F.avg(F.abs(F.col("y_pred") - F.col("y_true")))).alias("MAE")).withColumn("model", F.lit("weekly"))
    b = p.groupBy("region").agg(F.round(F.avg(F.col("y_last") - F.col("y_true")), 6).alias("ME")).withColumn("model", F.lit("last"))
    return a.unionByName(b, allowMissingColumns=True)


@plan(PANEL + " SELECT region, t_idx, y FROM panel")
def set_append_segments(spark, sf_dir):
    p = orders_panel(spark, sf_dir)
    s = p.withColumn("segment", bt.segments(bt.length(p)))
    parts = [s.filter(F.col("segment") == k).select("region", "t_idx", "y") for k in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@plan(PANEL + " SELECT region FROM tiers WHERE tier >= 1 EXCEPT SELECT region FROM panel GROUP BY region HAVING avg((y > 0)::INT) > 0.25")
def set_except(spark, sf_dir):
    p = orders_panel(spark, sf_dir)
    busy = p.groupBy("region").agg(F.avg((F.col("y") > 0).cast("int")).alias("s")).filter("s > 0.25").select("region")
    return tiers(p).filter("tier >= 1").select("region").subtract(busy)


@plan("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def set_distinct_static(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey").dropDuplicates()


