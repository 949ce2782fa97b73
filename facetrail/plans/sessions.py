"""Sessions of albums and of their cities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrail.functions.timestamps import instant_micros
from facetrail.operators.sessions import sessions
from facetrail.session import table

GAP_S = 90 * 60


def streams(text_units: DataFrame, event_nodes: DataFrame) -> DataFrame:
    """user_id, city_key, unit_id, at: the dated units of every album (city_key '') and of every city of its nodes."""
    dated = text_units.select("user_id", "unit_id", "photo_id", instant_micros("timestamp").alias("us")).where("us is not null and user_id is not null and unit_id is not null")
    units = dated.groupBy("user_id", "unit_id").agg(F.min(F.struct("us", "photo_id")).alias("r")).select("user_id", "unit_id", F.timestamp_micros("r.us").alias("at"), "r.photo_id")
    city = (
        event_nodes.select("user_id", F.lower(F.trim("gps_city")).alias("city_key"), F.explode("photo_ids").alias("photo_id"))
        .where("city_key is not null and photo_id is not null").distinct()
    )
    in_city = units.join(city, ["user_id", "photo_id"]).select("user_id", "city_key", "unit_id", "at")
    return units.select("user_id", F.lit("").alias("city_key"), "unit_id", "at").unionByName(in_city)


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(streams(table(spark, d, "text_units"), table(spark, d, "event_nodes")), "user_id", "at", "unit_id", GAP_S, "city_key")
    return s.select("user_id", F.col("stream").alias("city_key"), F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), F.round("duration_s", 3).alias("duration_s"), F.col("n_events").alias("n_units"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(streams(table(spark, d, "text_units"), table(spark, d, "event_nodes")), "user_id", "at", "unit_id", GAP_S, "city_key")
    return s.select("user_id", F.col("stream").alias("city_key"), F.col("first_id").alias("first_unit_id"), F.col("last_id").alias("last_unit_id"))


SESSIONS_SQL = r"""
WITH raw AS (
  SELECT user_id, unit_id, photo_id, regexp_extract(timestamp,
    '^\s*(\d{4}-\d{2}-\d{2}|\d{8})[Tt ]\s*(\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?\s*([Zz]|[+-]\d{2}(?::?\d{2})?)?\s*$',
    ['d', 'h', 'm', 's', 'f', 'z']) AS p FROM text_units WHERE user_id IS NOT NULL AND unit_id IS NOT NULL),
parts AS (
  SELECT user_id, unit_id, photo_id, replace(p.d, '-', '') AS d, try_cast(p.h AS BIGINT) AS h, try_cast(p.m AS BIGINT) AS m,
    coalesce(try_cast(p.s AS BIGINT), 0) AS s, coalesce(try_cast(rpad(p.f[1:6], 6, '0') AS BIGINT), 0) AS f, replace(p.z, ':', '') AS z
  FROM raw WHERE p.d <> ''),
dated AS (
  SELECT user_id, unit_id, photo_id,
    epoch_us(try_cast(d[1:4] || '-' || d[5:6] || '-' || d[7:8] AS DATE)::TIMESTAMP) + (h * 60 + m - (CASE WHEN z[1:1] = '-' THEN -1 ELSE 1 END)
      * (coalesce(try_cast(z[2:3] AS BIGINT), 0) * 60 + coalesce(try_cast(z[4:5] AS BIGINT), 0))) * 60000000 + s * 1000000 + f AS us
  FROM parts WHERE h < 24 AND m < 60 AND s < 60 AND d[1:4] <> '0000'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, unit_id ORDER BY us, photo_id) AS k FROM dated WHERE us IS NOT NULL),
units AS (SELECT user_id, unit_id, photo_id, us FROM ranked WHERE k = 1),
city AS (
  SELECT DISTINCT user_id, lower(trim(gps_city)) AS city_key, photo_id
  FROM (SELECT user_id, gps_city, unnest(photo_ids) AS photo_id FROM event_nodes) WHERE gps_city IS NOT NULL AND photo_id IS NOT NULL),
streams AS (
  SELECT user_id, '' AS city_key, unit_id, us FROM units
  UNION ALL SELECT u.user_id, c.city_key, u.unit_id, u.us FROM units u JOIN city c ON u.user_id = c.user_id AND u.photo_id = c.photo_id),
marked AS (
  SELECT *, CASE WHEN us - lag(us) OVER w <= 5400000000 THEN 0 ELSE 1 END AS fresh FROM streams
  WINDOW w AS (PARTITION BY user_id, city_key ORDER BY us, unit_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, city_key ORDER BY us, unit_id ROWS UNBOUNDED PRECEDING) AS g FROM marked)
"""
P2_SESSIONS_SQL = SESSIONS_SQL + """
SELECT user_id, city_key, min(us) AS start_us, max(us) AS end_us, round((max(us) - min(us)) / 1e6, 3) AS duration_s, count(*) AS n_units
FROM numbered GROUP BY user_id, city_key, g
"""
P2_FOUND_SQL = SESSIONS_SQL + """
SELECT user_id, city_key, arg_min(unit_id, (us, unit_id)) AS first_unit_id, arg_max(unit_id, (us, unit_id)) AS last_unit_id
FROM numbered GROUP BY user_id, city_key, g
"""

QUERIES = {"p2_found": p2_found, "p2_sessions": p2_sessions}
SQL = {"p2_found": P2_FOUND_SQL, "p2_sessions": P2_SESSIONS_SQL}
