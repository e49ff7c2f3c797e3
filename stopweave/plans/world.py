"""A transit world derived from the warehouse tables, in SQL that Spark and DuckDB read alike.

Suppliers are stops, orders trips, customers routes, line items stop times, parts road nodes and events
position fixes. Doubles are written with an exponent, as a decimal literal would be divided as a decimal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "stops": """
SELECT s_suppkey AS stop_id, concat(p_name, ' ', n_name) AS stop_name, s_nationkey AS zone,
  47e0 + ((s_suppkey * 7919) % 1009) / 1009e0 AS lat, 8e0 + ((s_suppkey * 6271) % 1013) / 1013e0 AS lon
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {part} ON p_partkey = s_suppkey""",
    "trips": "SELECT o_orderkey AS trip_id, o_custkey AS route_id, o_orderstatus AS service_id FROM {orders}",
    "routes": """
SELECT c_custkey AS route_id, c_custkey % 8 AS route_type, (c_custkey * 2654435) % 16777216 AS color,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(substr(c_mktsegment, 1, 3), cast(c_custkey % 40 AS varchar(9))) END AS short_name,
  c_name AS long_name
FROM {customer}""",
    "stop_times": """
SELECT trip_id, stop_id, seq, cast(sum(wait) OVER (PARTITION BY trip_id ORDER BY seq) AS bigint) AS dep_s
FROM (SELECT l_orderkey AS trip_id, l_suppkey AS stop_id, cast(l_quantity AS bigint) * 60 AS wait,
    cast(row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS bigint) AS seq
  FROM {lineitem}) numbered""",
    "edges": """
SELECT src, dst, min(cast(ceil(len * 10 / speed) AS bigint)) AS cost
FROM (
  SELECT least(k, (31 * k + 7) % n) AS src, greatest(k, (31 * k + 7) % n) AS dst, p_size * 10e0 AS len, 5e0 + k % 8 AS speed
  FROM (SELECT p_partkey AS k, p_size, count(*) OVER () AS n FROM {part}) a
  UNION ALL
  SELECT least(k, (k + 1) % n), greatest(k, (k + 1) % n), p_size * 8e0, 4e0 + k % 8
  FROM (SELECT p_partkey AS k, p_size, count(*) OVER () AS n FROM {part}) b
) arcs WHERE src <> dst GROUP BY src, dst""",
    "tags": """
SELECT p_partkey AS id, substr(p_type, 1, 5) AS kind, concat(p_brand, ';', substr(p_name, 1, 4)) AS brands, cast(p_size AS bigint) AS size
FROM {part}""",
    "fixes": """
SELECT user_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS seq,
  47e0 + ((event_id * 31) % 997) / 99700e0 AS lat, 8e0 + (value * 1e0) / 10000e0 AS lon
FROM {events}""",
}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    if name == "stops":
        used["part"] = used["part"].hint("merge")  # all parts are too many for the driver, however few bytes they have on disk
    return spark.sql(text, **used)


def with_views(sql: str) -> str:
    """DuckDB SQL for a query over the views it names as {stops}, {edges}, ..."""
    used = [v for v in VIEWS if f"{{{v}}}" in sql]
    plain = {t: t for t in TABLES}
    heads = ", ".join(f"{v} AS ({VIEWS[v].format(**plain)})" for v in used)
    body = sql.format(**{v: v for v in VIEWS}, **{t: t for t in TABLES if t not in VIEWS})
    body = body.strip()
    if not heads:
        return body
    return f"WITH RECURSIVE {heads}, {body[15:]}" if body.startswith("WITH RECURSIVE ") else f"WITH {heads}, {body[5:]}" if body.startswith("WITH ") else f"WITH {heads} {body}"
