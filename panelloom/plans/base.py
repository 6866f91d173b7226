"""Registration of queries, and the common parts of their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from panelloom.operators.shared import shared_folder


class Plans:
    """QUERIES and SQL of a module, filled by a decorator."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        def put(function):
            key = name or function.__name__
            self.queries[key] = function
            if sql is not None:
                self.sql[key] = sql
            return function

        return put


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


PANEL = """
WITH o AS (
  SELECT lower(replace(n_name, '_', '')) AS region, CAST(o_orderdate AS DATE) AS event_date, o_totalprice, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
days AS (SELECT CAST(unnest(generate_series(min(event_date)::TIMESTAMP, max(event_date)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS event_date FROM o),
spine AS (SELECT lower(replace(n_name, '_', '')) AS region, event_date FROM nation CROSS JOIN days),
panel AS (
  SELECT s.region, s.event_date, (row_number() OVER (PARTITION BY s.region ORDER BY s.event_date) - 1)::INT AS t_idx,
    coalesce(c.y, 0)::BIGINT AS y, coalesce(c.revenue_cents, 0)::BIGINT AS revenue_cents, coalesce(c.urgent, 0)::BIGINT AS urgent,
    coalesce(c.high, 0)::BIGINT AS high, coalesce(c.medium, 0)::BIGINT AS medium, coalesce(c.notspec, 0)::BIGINT AS notspec, coalesce(c.low, 0)::BIGINT AS low
  FROM spine s LEFT JOIN (
    SELECT region, event_date, count(*) AS y, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS revenue_cents,
      count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS high,
      count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS medium, count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS notspec,
      count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low
    FROM o GROUP BY region, event_date) c USING (region, event_date)),
tiers AS (
  SELECT region, CASE WHEN r > 1 THEN t END::INT AS tier FROM (
    SELECT region, ntile(4) OVER (ORDER BY total, region) - 1 AS t, row_number() OVER (ORDER BY total DESC, region) AS r
    FROM (SELECT region, sum(y) AS total FROM panel GROUP BY region)))
"""
#: Naive forecasts over daily folds from 80% on: the long prediction table that metrics read.
PREDS = PANEL + """,
size AS (SELECT max(t_idx) + 1 AS n, CAST(floor(0.8 * (max(t_idx) + 1)) AS INT) AS start FROM panel),
skeleton AS (
  SELECT region, t0, CAST(t0 - start AS INT) AS fold, horizon
  FROM (SELECT DISTINCT region FROM panel), size, (SELECT unnest(range(0, 100000)) AS t0) f, (SELECT unnest(range(1, 8)) AS horizon) h
  WHERE t0 BETWEEN start AND n - 7),
active AS (SELECT region, t_idx, coalesce(sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY region ORDER BY t_idx ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 0) AS active28 FROM panel),
preds AS (
  SELECT k.region, k.fold, k.horizon::INT AS horizon, a.event_date AS date, a.y AS y_true, w.y AS y_pred, l.y AS y_last, (c.active28 + 1)::DOUBLE / 30.0::DOUBLE AS y_prob
  FROM skeleton k JOIN panel a ON a.region = k.region AND a.t_idx = k.t0 + k.horizon - 1
  JOIN panel w ON w.region = k.region AND w.t_idx = k.t0 - 7 + k.horizon - 1
  JOIN panel l ON l.region = k.region AND l.t_idx = k.t0 - 1
  JOIN active c ON c.region = k.region AND c.t_idx = k.t0)
"""
