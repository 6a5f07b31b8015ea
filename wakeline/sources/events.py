"""Position reports as a deterministic view of an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_VIEW = """
WITH b AS (
  SELECT event_id AS e, user_id % 15 AS v, CAST(ts AS DATE) AS d, CAST(datediff(CAST(ts AS DATE), DATE'2024-01-01') AS BIGINT) AS di,
    (unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(CAST(CAST(ts AS DATE) AS TIMESTAMP))) DIV 24000000 AS c,
    CAST(floor(value) AS BIGINT) AS val, event_type, CAST(get_json_object(props, '$.k') AS BIGINT) AS k
  FROM {events}),
w AS (SELECT *, (20+3*v)*c + 79190*v + 1009*di AS y, (15+2*v)*c + 104729*v + 2003*di AS x FROM b),
r AS (SELECT *, explode(CASE WHEN e % 50 = 0 THEN array(e*2, e*2+1) ELSE array(e*2) END) AS ordinal FROM w)
SELECT ordinal,
  CASE WHEN e % 211 = 0 THEN '12345' ELSE CAST(367000000+v AS STRING) END AS mmsi,
  date_format(timestamp_seconds(unix_date(d)*86400L + c), 'yyyy-MM-dd HH:mm:ss') AS base_date_time,
  CASE WHEN e % 331 = 0 THEN -200.0D ELSE (-122420000 + (80000 - abs(x % 160000 - 80000)) + (e % 5)*7 + CASE WHEN e % 307 = 0 THEN 50000 ELSE 0 END) / 1e6D END AS longitude,
  (37760000 + (60000 - abs(y % 120000 - 60000)) + CASE WHEN e % 401 = 0 THEN 150000 ELSE 0 END) / 1e6D AS latitude,
  CASE WHEN e % 97 = 0 THEN 61.0D WHEN e % 89 = 0 THEN NULL ELSE val / 10.0D END AS sog,
  CASE WHEN e % 17 = 0 THEN 360.0D ELSE CAST((e*37) % 360 AS DOUBLE) END AS cog,
  CASE WHEN e % 13 = 0 THEN 511.0D ELSE CAST(k*3 AS DOUBLE) END AS heading,
  CASE event_type WHEN 'view' THEN '30' WHEN 'click' THEN '52' WHEN 'signup' THEN '60' WHEN 'purchase' THEN '70' ELSE '80' END AS vessel_type,
  CAST(e % 600 AS DOUBLE) AS length, CAST(e % 120 AS DOUBLE) AS width, CAST(e % 35 AS DOUBLE) AS draft
FROM r
"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw position reports, one row an event and a copy of every fiftieth; one scan of the log."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.sql(_VIEW, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
