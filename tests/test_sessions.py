import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemill.operators import sessions as S


def brute(rows, gap):
    by = defaultdict(list)
    for ip, ua, t in rows:
        if ip is not None and t is not None:
            by[ip, ua].append(t)
    out = set()
    for (ip, ua), ts in by.items():
        ts.sort()
        start = prev = ts[0]
        n = 0
        for t in ts:
            if t - prev > gap:
                out.add((ip, ua, start, prev, n))
                start, n = t, 0
            prev = t
            n += 1
        out.add((ip, ua, start, prev, n))
    return out


def check(spark, rows, chunk, gaps):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "ip string, ua string, t bigint, gap_x string, open_x int").repartition(3)
    forest = S.gap_forest(df, ["ip", "ua"], "t", drop_null=("ip",), chunk_seconds=chunk).persist()
    for gap in gaps:
        got = [(r["ip"], r["ua"], r["start_s"], r["end_s"], r["n_events"]) for r in S.cut(forest, gap).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(rows, gap), (chunk, gap)
    forest.unpersist()


@pytest.mark.parametrize("chunk", [1, 10, 97, 86_400])
def test_against_brute_force(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(rnd.choice(["a", "a", "a", "b", None, f"t{rnd.randint(0, 40)}"]), rnd.choice(["u", "", None]), rnd.choice([None, rnd.randint(-300, 700)])) for _ in range(900)]
    check(spark, rows, chunk, [0, 1, 3, 10, 50, 10_000])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ts=st.lists(st.integers(0, 200), min_size=1, max_size=60), chunk=st.sampled_from([1, 7, 50, 1000]))
def test_any_times(spark, ts, chunk):
    check(spark, [("x", None, t) for t in ts], chunk, [0, 2, 5, 30])


def test_equal_gaps_share_a_node(spark):
    df = spark.createDataFrame([("x", 10 * i) for i in range(50)], "k string, t bigint")
    forest = S.gap_forest(df, ["k"], "t", chunk_seconds=60)
    inner = forest.where("gap_s > 0").collect()
    assert [(r["gap_s"], r["parent_gap_s"], r["start_s"], r["end_s"], r["n_events"]) for r in inner] == [(10, None, 0, 490, 50)]


def test_partial_forests_of_days_merge(spark):
    rows = [("x", t) for t in (5, 50, 86_390, 86_410, 86_500, 200_000)]
    df = spark.createDataFrame(rows, "k string, t bigint")
    days = [S.chunk_forest(df.where(f"t div 86400 = {d}"), ["k"], "t") for d in range(3)]
    parts = days[0].unionByName(days[1]).unionByName(days[2])
    got = sorted((r["start_s"], r["end_s"]) for r in S.cut(S.merge_forests(parts, ["k"]), 1800).collect())
    assert got == [(5, 50), (86_390, 86_500), (200_000, 200_000)]


def test_empty_and_types(spark):
    assert S.cut(S.gap_forest(spark.createDataFrame([], "k string, t timestamp"), ["k"], "t"), 5).count() == 0
    df = spark.sql("SELECT 'k' AS k, t FROM VALUES (TIMESTAMP_NTZ'1970-01-01 00:00:01.9'), (TIMESTAMP_NTZ'1969-12-31 23:59:59.5'), (NULL) AS v(t)")
    r = S.cut(S.gap_forest(df, ["k"], "t"), 100).collect()
    assert [(x["start_s"], x["end_s"], x["duration_s"]) for x in r] == [(-1, 1, 2)]
    with pytest.raises(ValueError):
        S.chunk_forest(df, ["k"], "t", chunk_seconds=0)


def test_times_without_zone_dont_depend_on_the_session(spark):
    """Also across a change to summer time."""
    df = spark.sql("SELECT 'k' AS k, t FROM VALUES (TIMESTAMP_NTZ'2031-03-09 01:59:50'), (TIMESTAMP_NTZ'2031-03-09 02:30:00'), (TIMESTAMP_NTZ'2031-07-01 00:00:00') AS v(t)")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sorted(r["start_s"] for r in S.cut(S.gap_forest(df, ["k"], "t"), 60).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [1930787990, 1930789800, 1940630400]


def test_hot_entity_stays_bounded(spark):
    """However often an entity is seen, a chunk gets at most one row a second."""
    df = spark.range(200_000).selectExpr("'hot' AS k", "id % 300 AS t")
    forest = S.gap_forest(df, ["k"], "t", chunk_seconds=100)
    assert forest.where("gap_s = 0").count() == 300 and S.cut(forest, 1).first()["n_events"] == 200_000
