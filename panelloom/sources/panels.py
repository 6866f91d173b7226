"""Panels from the given tables: one row for each key and step, dense, with counts of 0 where nothing happened."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRIORITIES = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "notspec": "4-NOT SPECIFIED", "low": "5-LOW"}


@dataclass(frozen=True)
class PanelSpec:
    """Roles of a panel's columns; travels beside the DataFrame."""

    key: str = "region"
    time: str = "event_date"
    target: str = "y"
    past: tuple[str, ...] = ()
    future: tuple[str, ...] = ()
    static: tuple[str, ...] = field(default=("tier",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def densify(counts: DataFrame, keys: DataFrame, key: str, time: str, step: str = "interval 1 day") -> DataFrame:
    """Every key with every step between the first and the last; ``t_idx`` numbers the steps from 0."""
    span = counts.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    steps = span.select(F.posexplode(F.expr(f"sequence(lo, hi, {step})")).alias("t_idx", time))
    # keys x steps is the panel itself; both sides are small dimensions
    return keys.select(key).distinct().crossJoin(F.broadcast(steps))


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer nation and day: y, revenue_cents, counts by priority."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.lower(F.regexp_replace("n_name", "_", "")).alias("region"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    daily = (
        table(spark, sf_dir, "orders")
        .select("o_custkey", F.to_date("o_orderdate").alias("event_date"), "o_totalprice", "o_orderpriority")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "event_date")
        .agg(
            F.count("*").alias("y"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("revenue_cents"),
            *[F.count(F.when(F.col("o_orderpriority") == v, 1)).alias(k) for k, v in PRIORITIES.items()],
        )
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .drop("c_nationkey", "n_nationkey")
    )
    values = ["y", "revenue_cents", *PRIORITIES]
    dense = densify(daily, nation, "region", "event_date").join(daily, ["region", "event_date"], "left")
    return dense.select("region", "event_date", F.col("t_idx").cast("int").alias("t_idx"), *[F.coalesce(v, F.lit(0)).cast("long").alias(v) for v in values])


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour: y and t_idx."""
    hourly = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("region"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("event_hour")).agg(F.count("*").alias("y"))
    dense = densify(hourly, hourly, "region", "event_hour", "interval 1 hour").join(hourly, ["region", "event_hour"], "left")
    return dense.select("region", F.col("t_idx").cast("int").alias("t_idx"), F.coalesce("y", F.lit(0)).cast("long").alias("y"))


def tiers(panel: DataFrame) -> DataFrame:
    """Activity tier 0..3 of each region by its total; the most active region's tier is unknown (null)."""
    total = panel.groupBy("region").agg(F.sum("y").alias("total"))  # one row for each region
    ordered = Window.orderBy("total", "region")
    return total.select("region", (F.ntile(4).over(ordered) - 1).alias("t"), F.row_number().over(Window.orderBy(F.desc("total"), "region")).alias("r")).select(
        "region", F.when(F.col("r") > 1, F.col("t")).cast("int").alias("tier")
    )


def wide(panel: DataFrame, metrics: list[str], key: str = "region", time: str = "event_date") -> DataFrame:
    """One row for each day, a column ``<metric>_<region>`` for each pair."""
    regions = sorted(r[0] for r in panel.select(key).distinct().collect())  # column names are decided on the driver
    pivoted = panel.groupBy(time).pivot(key, regions).agg(*[F.first(m, ignorenulls=True).alias(m) for m in metrics])
    if len(metrics) == 1:
        return pivoted.select(time, *[F.col(f"`{r}`").alias(f"{metrics[0]}_{r}") for r in regions])
    return pivoted.select(time, *[F.col(f"`{r}_{m}`").alias(f"{m}_{r}") for r in regions for m in metrics])
