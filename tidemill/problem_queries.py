"""The queries of the two general data problems: small files and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import Catalog, table
from tidemill.operators import archive, sessions
from tidemill.storage import new_path

catalog = Catalog()
SESSION_GAP_S = 1_800
GAPS_S = (60, 300, 1_800, 7_200)


def _archive(spark: SparkSession, d: str) -> DataFrame:
    return archive.pack_objects(table(spark, d, "cf_objects"), new_path(spark, "archive"))


@catalog.query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct request_id in the bodies, with the smallest object_id that holds it, read from the packed archive."""
    return archive.record_owners(_archive(spark, d))


@catalog.query("SELECT object_id, bucket, object_key, octet_length(body) AS length, CASE WHEN body IS NOT NULL THEN md5(body) END AS md5, CASE WHEN body IS NOT NULL THEN true END AS intact FROM cf_objects")
def p1_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The lossless round trip: every object's bytes, cut out of the archive's blocks."""
    bodies = archive.archive_bodies(_archive(spark, d))
    return bodies.select("object_id", "bucket", "object_key", "length", F.md5("body").alias("md5"), "intact")


@catalog.query(
    "SELECT object_id, bucket, object_key, octet_length(body) AS length, CASE WHEN body IS NOT NULL THEN md5(body) END AS md5, CASE WHEN body IS NOT NULL THEN true END AS intact"
    " FROM cf_objects WHERE (bucket, object_key) IN (SELECT (bucket, object_key) FROM cf_objects GROUP BY bucket, object_key HAVING count(*) > 1)"
)
def p1_lookup_keys(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of the objects whose keys were rewritten or listed again, looked up by key in the archive's index."""
    keys = table(spark, d, "cf_objects").groupBy("bucket", "object_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bodies = archive.archive_bodies(_archive(spark, d), keys)
    return bodies.select("object_id", "bucket", "object_key", "length", F.md5("body").alias("md5"), "intact")


def _forest(spark: SparkSession, d: str) -> DataFrame:
    return sessions.gap_forest(table(spark, d, "cloudfront"), ["remote_ip", "user_agent"], "time", drop_null=("remote_ip",))


# Seconds are grouped first: ties in a window's order would make lag and the running sum disagree.
_SESSIONS = """
WITH s AS (SELECT remote_ip, user_agent, CAST(floor(epoch(time)) AS BIGINT) AS s, count(*) AS n FROM cloudfront
  WHERE remote_ip IS NOT NULL AND time IS NOT NULL GROUP BY ALL),
l AS (SELECT *, s - lag(s) OVER (PARTITION BY remote_ip, user_agent ORDER BY s) AS gap FROM s),
g AS (SELECT *, sum(CASE WHEN gap <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY remote_ip, user_agent ORDER BY s) AS k FROM l),
r AS (SELECT remote_ip, user_agent, min(s) AS start_s, max(s) AS end_s, CAST(sum(n) AS BIGINT) AS n_events FROM g GROUP BY remote_ip, user_agent, k)
"""


@catalog.query(_SESSIONS.format(gap=SESSION_GAP_S) + "SELECT remote_ip, coalesce(user_agent, '') AS user_agent, start_s, end_s FROM r")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    cut = sessions.cut(_forest(spark, d), SESSION_GAP_S)
    return cut.select("remote_ip", F.coalesce("user_agent", F.lit("")).alias("user_agent"), "start_s", "end_s")


@catalog.query(_SESSIONS.format(gap=SESSION_GAP_S) + "SELECT remote_ip, user_agent, start_s, end_s, end_s - start_s AS duration_s, n_events FROM r")
def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.cut(_forest(spark, d), SESSION_GAP_S)


@catalog.query(
    " UNION ALL ".join(
        f"SELECT {g} AS gap_s, count(*) AS n_sessions, CAST(sum(n_events) AS BIGINT) AS n_events, CAST(max(end_s - start_s) AS BIGINT) AS longest_s FROM ({_SESSIONS.format(gap=g)} SELECT * FROM r)" for g in GAPS_S
    )
)
def p2_gap_settings(spark: SparkSession, d: str) -> DataFrame:
    """Several thresholds cut from one forest, in one pass over its nodes."""
    forest = _forest(spark, d)
    gaps = F.explode(F.array(*[F.lit(g) for g in GAPS_S])).alias("gap_s")
    per = forest.select(gaps, F.col("gap_s").alias("own"), "parent_gap_s", "start_s", "end_s", "n_events")
    hit = per.where((F.col("own") <= F.col("gap_s")) & (F.col("parent_gap_s").isNull() | (F.col("parent_gap_s") > F.col("gap_s"))))
    return hit.groupBy("gap_s").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_events").alias("n_events"), F.max(F.col("end_s") - F.col("start_s")).alias("longest_s"))
