"""Name lists, column roles, and turning tables between wide and long."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.sources.panels import PanelSpec

#: Tier names in rising order.
TIER_NAMES = ("none", "low", "medium", "high")


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """One name a line, without blanks around and commas, lower-cased."""
    return spark.read.text(path).select(F.lower(F.trim(F.replace(F.trim("value"), F.lit(","), F.lit("")))).alias("name")).filter("name <> ''")


def group_members(spark: SparkSession, path: str) -> DataFrame:
    """(member, grp) of a JSON object {group: [members]}."""
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return held.select(F.explode("m").alias("grp", "members")).select(F.explode("members").alias("member"), "grp")


def region_tiers(spark: SparkSession, path: str) -> DataFrame:
    """(region, tier 0..3) of a JSON object {tier name: [regions]}."""
    order = F.create_map(*[x for i, n in enumerate(TIER_NAMES) for x in (F.lit(n), F.lit(i))])
    return group_members(spark, path).select(F.col("member").alias("region"), order[F.col("grp")].alias("tier"))


def columns_like(df: DataFrame, token: str) -> list[str]:
    return [c for c in df.columns if token.lower() in c.lower()]


def safe_subset(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def split_roles(columns: list[str], target: str, future: list[str], exclude: list[str] = (), key: str = "region", time: str = "event_date") -> PanelSpec:
    """Future columns are named; what is left and not excluded is past."""
    past = tuple(c for c in columns if c not in {key, time, target, *future, *exclude})
    return PanelSpec(key, time, target, past, tuple(future))


def row_total(columns: list[str]) -> Column:
    """Sum across columns, nulls as 0."""
    return reduce(add, [F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in columns], F.lit(0).cast("long"))


def binarized(df: DataFrame, column: str) -> DataFrame:
    """``<column>_binary`` in place of the column, which would leak the target."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    return df.withColumn(f"{column}_binary", (F.col(column) > 0).cast("int")).drop(column)


def null_profile(df: DataFrame) -> DataFrame:
    """(name, nulls) of the columns with any null."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    return unpivoted(counts, [], "name", "nulls").filter("nulls > 0")


def drop_low_prevalence(df: DataFrame, ratio: float, prefix: str) -> tuple[DataFrame, list[str]]:
    """Without the columns of a prefix whose sum of positive values per value is below the ratio; and their names."""
    names = [c for c in df.columns if c.startswith(prefix)]
    shares = df.agg(*[(F.sum(F.when(F.col(f"`{c}`") > 0, F.col(f"`{c}`")).otherwise(0)) / F.count(f"`{c}`")).alias(c) for c in names]).first()
    dropped = [c for c in names if shares[c] is not None and shares[c] < ratio]
    return df.drop(*dropped), dropped


def unpivoted(df: DataFrame, ids: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot([F.col(c) for c in ids], [c for c in df.columns if c not in ids], name, value)


def wide_to_long(df: DataFrame, regions: list[str], time: str) -> DataFrame:
    """(region, time, a column for each metric, global columns). Names split at their last underscore; no shuffle: a row becomes a struct for each region."""
    known = set(regions)
    local = [c for c in df.columns if "_" in c and c.rsplit("_", 1)[1] in known]
    metrics = sorted({c.rsplit("_", 1)[0] for c in local})
    others = [c for c in df.columns if c not in local and c != time]
    cell = lambda m, r: F.col(f"`{m}_{r}`") if f"{m}_{r}" in local else F.lit(None)
    rows = F.array(*[F.struct(F.lit(r).alias("region"), *[cell(m, r).alias(m) for m in metrics]) for r in regions])
    held = df.select(time, *others, F.explode(rows).alias("x")).select("x.*", time, *others)
    return held.filter(reduce(lambda a, b: a | b, [F.col(m).isNotNull() for m in metrics]))


def pair_rollup(flows: DataFrame, groups: DataFrame, prefix: str) -> DataFrame:
    """(event_date, pair, value) of flows (event_date, a, b, value): members become groups, pairs are unordered, values are summed."""
    left, right = (F.broadcast(groups.select(F.col("member").alias(x), F.col("grp").alias(f"g{x}"))) for x in "ab")
    pair = F.concat_ws("_", F.lit(prefix), F.least("ga", "gb"), F.greatest("ga", "gb"))
    return flows.join(left, "a").join(right, "b").groupBy("event_date", pair.alias("pair")).agg(F.sum("value").alias("value"))


def by_role(importance: DataFrame) -> DataFrame:
    """(role, base, importance) of (feature, importance)."""
    pattern = r"^(.*?)_(pastcov|futcov|statcov|target)"
    role, base = F.regexp_extract("feature", pattern, 2).alias("role"), F.regexp_extract("feature", pattern, 1).alias("base")
    return importance.groupBy(role, base).agg(F.sum("importance").alias("importance"))


def asof(left: DataFrame, right: DataFrame, key: str, at: str, time: str, value: str, name: str) -> DataFrame:
    """Each left row with the value of the latest right row of its key strictly before ``at``; one union, one window, no range join."""
    from pyspark.sql import Window

    marks = left.select(key, F.col(at).alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(None).alias("_v"))
    values = right.select(key, (F.col(time) + 1).alias("_t"), F.lit(None).cast(marks.schema["_row"].dataType).alias("_row"), F.struct(F.col(value).alias("v")).alias("_v"))
    marks = marks.withColumn("_v", F.lit(None).cast(values.schema["_v"].dataType))
    w = Window.partitionBy(key).orderBy("_t", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = values.unionByName(marks).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_row IS NOT NULL")
    return held.select("_row.*", F.col("_last.v").alias(name))
