import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import bitmaps as B
from tidemill.llm import frequent, quantiles


def nearest_rank(values, permille):
    v = sorted(values)
    return v[max(1, -(-permille * len(v) // 1000)) - 1]


def test_percentiles_against_sorting(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, 7, 7, 7, 0, rnd.randint(-50, 50)]), rnd.choice([None, rnd.randint(0, 10**12)]), 1, 2) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, x bigint, y bigint, value int, n int").repartition(7)
    freq = quantiles.frequencies(df, ["g"], ["x", "y"])
    want = defaultdict(list)
    for g, x, y, *_ in rows:
        for m, v in (("x", x), ("y", y)):
            if v is not None:
                want[g, m].append(v)
    ps = [0, 1, 250, 500, 999, 1000]
    got = {(r["g"], r["measure"], r["permille"]): (r["value"], r["n"], r["max_rank_error"]) for r in quantiles.percentiles(freq, ps).collect()}
    assert got == {(*k, p): (nearest_rank(v, p), len(v), 0) for k, v in want.items() for p in ps}


def test_percentiles_of_merged_days_and_doubles(spark):
    df = spark.createDataFrame([("d1", 1.5), ("d1", float("nan")), ("d2", -2.0), ("d2", None), ("d3", 1.5)], "day string, x double")
    days = [quantiles.frequencies(df.where(f"day = '{d}'"), ["day"], ["x"]) for d in ("d1", "d2", "d3")]
    r = quantiles.percentiles(quantiles.merge_frequencies(*days, drop=("day",)), [1, 500, 1000]).orderBy("permille").collect()
    assert [x["value"] for x in r[:2]] == [-2.0, 1.5] and math.isnan(r[2]["value"]) and r[0]["n"] == 4
    empty = quantiles.frequencies(df.limit(0), ["day"], ["x"])
    assert quantiles.percentiles(empty, [500]).count() == 0
    with pytest.raises(ValueError):
        quantiles.percentiles(empty, [1001])


def test_levels_out_of_the_same_counts(spark):
    """Every level's percentiles by brute force; null keys are groups of their own, and null in one key isn't null in the other."""
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice(["a", "b", None]), rnd.choice([None, 0, 1, 5, rnd.randrange(1000)])) for _ in range(900)]
    df = spark.createDataFrame(rows, "d string, e string, x int").repartition(5)
    levels = {"both": ["d", "e"], "d": ["d"], "e": ["e"], "all": []}
    freq = quantiles.roll_up(quantiles.frequencies(df, ["d", "e"], ["x"]), levels, ["d", "e"])
    got = {(r["level"], r["d"], r["e"], r["permille"]): (r["value"], r["n"]) for r in quantiles.percentiles(freq, [0, 333, 1000]).collect()}
    want = {}
    for name, own in levels.items():
        groups = {}
        for d, e, x in rows:
            if x is not None:
                groups.setdefault((d if "d" in own else None, e if "e" in own else None), []).append(x)
        for (d, e), xs in groups.items():
            xs.sort()
            want |= {(name, d, e, p): (xs[max(1, -(-p * len(xs) // 1000)) - 1], len(xs)) for p in (0, 333, 1000)}
    assert got == want


def test_hot_group_is_spread(spark):
    """A group with nearly all values lies in several range partitions."""
    df = spark.range(20_000).selectExpr("if(id % 50 = 0, 'cold', 'hot') AS g", "id AS x")
    got = {(r["g"], r["permille"]): r["value"] for r in quantiles.percentiles(quantiles.frequencies(df, ["g"], ["x"]), [500, 990]).collect()}
    hot = [i for i in range(20_000) if i % 50]
    assert got["hot", 500] == nearest_rank(hot, 500) and got["hot", 990] == nearest_rank(hot, 990) and got["cold", 500] == nearest_rank(range(0, 20_000, 50), 500)


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.sets(st.integers(0, 65_535), min_size=1, max_size=50), st.tuples(st.integers(0, 60_000), st.integers(1, 5_000)).map(lambda t: set(range(t[0], t[0] + t[1])))))
def test_containers_round_trip(values):
    v = np.array(sorted(values))
    data = B.pack(v)
    assert B.unpack(data).tolist() == v.tolist() and len(data) <= 8193 and len(data) <= 2 * len(v) + 1


def test_containers_choose_the_smallest():
    assert B.pack(np.array([5]))[:1] == b"a" and B.pack(np.arange(1000))[:1] == b"r" and B.pack(np.arange(0, 65_536, 2))[:1] == b"b"
    assert B.unpack(B.pack(np.arange(65_536))).tolist() == list(range(65_536))


@pytest.fixture(scope="module")
def visits(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 1, 2, None]), rnd.choice(["x", "x", "y", None]), rnd.choice(["hot"] * 5 + [None] + [f"id{i}" for i in range(300)]), 0) for _ in range(4000)]
    return rows, spark.createDataFrame(rows, "d int, e string, who string, bucket int").repartition(5)


def test_distinct_counts_and_roll_ups(spark, visits):
    rows, df = visits
    ids = B.dictionary(df, "who")
    numbers = sorted(r["id"] for r in ids.collect())
    assert numbers == list(range(len({r[2] for r in rows if r[2]})))
    base = B.bitmaps(df, [("d", F.col("d")), ("e", F.col("e"))], "who", ids).persist()

    def want(key):
        out = defaultdict(set)
        for r in rows:
            if r[2] is not None:
                out[key(r)].add(r[2])
        return {k: len(v) for k, v in out.items()}

    assert {(r["d"], r["e"]): r["n_distinct"] for r in B.count_bits(base, ["d", "e"]).collect()} == want(lambda r: (r[0], r[1]))
    assert {r["d"]: r["n_distinct"] for r in B.count_bits(B.union(base, ["d"]), ["d"]).collect()} == want(lambda r: r[0])
    assert B.count_bits(B.union(B.union(base, ["e"]), []), []).first()["n_distinct"] == want(lambda r: 0)[0]
    by_e = B.union(base, ["e"])
    both = B.intersect(by_e.where("e = 'x'").drop("e"), by_e.where("e = 'y'").drop("e"), [])
    xs, ys = ({r[2] for r in rows if r[1] == e and r[2]} for e in "xy")
    assert B.count_bits(both, []).first()["n_distinct"] == len(xs & ys)


def test_dictionary_goes_on_and_empty(spark, visits):
    _, df = visits
    first = B.dictionary(df.where("d = 1"), "who")
    more = B.dictionary(df, "who", known=first)
    a, b = ({r["value"]: r["id"] for r in x.collect()} for x in (first, more))
    assert all(b[k] == v for k, v in a.items()) and sorted(b.values()) == list(range(len(b)))
    none = df.limit(0)
    ids = B.dictionary(none, "who")
    assert ids.count() == 0 and B.count_bits(B.bitmaps(none, [("d", F.col("d"))], "who", ids), ["d"]).count() == 0
    assert B.count_bits(B.union(B.bitmaps(none, [("d", F.col("d"))], "who", ids), []), []).first()["n_distinct"] == 0


def test_buckets_beyond_the_first(spark):
    df = spark.range(150_000).selectExpr("cast(id as string) AS who", "id % 2 AS d")
    ids = B.dictionary(df, "who")
    base = B.bitmaps(df, [("d", F.col("d"))], "who", ids)
    assert base.select("bucket").distinct().count() == 3
    assert {r["d"]: r["n_distinct"] for r in B.count_bits(base, ["d"]).collect()} == {0: 75_000, 1: 75_000}


def brute_frequent(values, per_mille, least):
    c = Counter(v for v in values if v is not None)
    return {(k, n) for k, n in c.items() if n * 1000 >= len(values) * per_mille and n >= least}


@pytest.mark.parametrize("buckets", [1, 8, 1 << 14])
def test_frequent_values(spark, buckets):
    rnd = random.Random(buckets)
    values = [rnd.choice(["hot"] * 300 + ["warm"] * 5 + ["", None] + [f"v{i}" for i in range(200)]) for _ in range(5000)]
    df = spark.createDataFrame([(v, 1, 2) for v in values], "url string, value int, n int").repartition(5)
    for pm in (1, 5, 300):
        got = frequent.frequent_values(df, "url", per_mille=pm, buckets=buckets).collect()
        assert {(r["value"], r["n"]) for r in got} == brute_frequent(values, pm, 5) and all(r["n_rows"] == 5000 and r["max_error"] == 0 for r in got)


def test_frequent_edges(spark):
    df = spark.createDataFrame([("a",)] * 4 + [("b",)] * 5, "u string")
    assert [r["value"] for r in frequent.frequent_values(df, "u").collect()] == ["b"]
    assert frequent.frequent_values(df.limit(0), "u").count() == 0
    assert frequent.frequent_values(spark.createDataFrame([(None,)] * 9, "u string"), "u").count() == 0
    with pytest.raises(ValueError):
        frequent.frequent_values(df, "u", per_mille=0)


@pytest.mark.parametrize("listed", [1_000, 2])
def test_frequent_by_a_small_share(spark, monkeypatch, listed):
    """One row in five thousand; the heavy buckets as a list and as a table."""
    monkeypatch.setattr(frequent, "LISTED", listed)
    rnd = random.Random(4)
    values = [f"v{int(rnd.paretovariate(0.6)) % 5_000}" for _ in range(20_000)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in values], "u string").repartition(4)
    want = {v: n for v, n in Counter(values).items() if v is not None and n * 5_000 >= len(values) and n >= 5}
    assert {r["value"]: r["n"] for r in frequent.frequent_values(df, "u", per_mille=0.2).collect()} == want
    with pytest.raises(ValueError):
        frequent.frequent_values(df, "u", per_mille=0.0001)


def test_frequent_in_many_rows(spark):
    """Counts times a share go beyond 32 bits."""
    df = spark.range(3_000_000).selectExpr("if(id % 2 = 0, 'even', concat('x', id)) AS u")
    assert [tuple(r) for r in frequent.frequent_values(df, "u", per_mille=400).select("value", "n", "n_rows").collect()] == [("even", 1_500_000, 3_000_000)]
