import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemill.operators import joins, sketches
from tidemill.operators.grouped import grouped_fold, load
from tidemill.operators.sinks import All, Any_, Collect, Combine, Count, Fold, ForEach, GroupBy, Histogram, Max, MaxBy, Mean, Min, MinBy, MostDistinct, MostFrequent, Sample, SortN, StdDev, Sum
from tidemill.plans.flow import Flow
from tidemill.plans.fork import fork, fork_table
from tidemill.plans.pipe import Filtered, Identity, Piped


@pytest.fixture(scope="module")
def xs(spark):
    return Flow.of(spark, [("a", 1, 2.0), ("a", 2, None), ("b", 3, 5.0), ("b", 3, float("nan")), (None, 7, 1.0)], "k string, n bigint, x double")


@pytest.fixture(scope="module")
def none(spark):
    return Flow.of(spark, [], "k string, n bigint, x double")


def test_empty_input(none):
    assert none.count() == 0 and none.sum("n") == 0 and none.mean("x") is None and none.stddev("x") is None
    assert none.max("n") is None and none.min("n") is None and none.max_by("k", "n") is None
    assert none.all(F.col("n") > 0) is True and none.any(F.col("n") > 0) is False
    assert none.histogram("k") == [] and none.sort_n_by(3, "n") == [] and none.sample_unstable(3) == [] and none.most_frequent("k", 3) == []
    assert none.combine("n", max) is None and none.combine("n", "max") is None and none.fold(int, lambda s, r: s + r.n, lambda a, b: a + b) == 0
    assert none.group_by(["k"], Count()) == {} and none.collect() == []


def test_nulls_nan_and_ties(xs):
    assert xs.count() == 5 and xs.sum("n") == 16 and math.isnan(xs.max("x")) and xs.min("x") == 1.0
    assert Min("x", nulls_first=True).run(xs.df) is None and Min("n", nulls_first=True).run(xs.df) == 1
    assert xs.max_by("k", "n") is None and xs.df.where("n = 7").first()["k"] is None
    assert xs.filter("n = 3").max_by("x", "n", [F.coalesce("x", F.lit(0.0))]) is not None
    assert xs.histogram("k") == [("a", 2), ("b", 2), (None, 1)]
    assert xs.all(F.col("n") > 0) and not xs.all(F.col("n") > 1) and xs.any(F.col("n") == 7)


def test_population_deviation_and_empty_partitions(spark):
    f = Flow(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double").repartition(50).where("x < 3"))
    assert f.mean("x") == 1.5 and f.stddev("x") == 0.5
    assert f.filter("x < 2").stddev("x") == 0.0


def test_min_by_ties(spark):
    f = Flow.of(spark, [(1, "p", 5), (1, "q", 4), (2, "r", 1)], "k bigint, v string, t bigint")
    assert f.min_by("v", "k", ["t"]) == "q" and f.min_by("v", "k", [-F.col("t")]) == "p" and f.max_by("v", "k") == "r"


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-(10**6), 10**6), min_size=1, max_size=40), parts=st.integers(1, 9))
def test_results_dont_depend_on_partitions(spark, values, parts):
    f = Flow(spark.createDataFrame([(v,) for v in values], "v bigint").repartition(parts))
    assert f.sum("v") == sum(values) and f.max("v") == max(values) and f.combine("v", lambda a, b: a + b) == sum(values)
    assert f.fold(int, lambda s, r: s + r.v * r.v, lambda a, b: a + b) == sum(v * v for v in values)
    assert f.sort_n_by(3, "v") == [(v,) for v in sorted(values)[:3]]


def test_python_steps_run_over_arrow(xs):
    out = xs.map("k", "n").filter(lambda r: r.n > 1).map(lambda r: (r.k, r.n * 10), schema="k string, m bigint")
    assert sorted((r.m, r.k or "") for r in out.collect()) == [(20, "a"), (30, "b"), (30, "b"), (70, "")]
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BatchEvalPython" not in plan
    words = xs.map("k").flat_map(lambda r: [r.k] * 2 if r.k else [], schema="w string")
    assert words.count() == 8
    with pytest.raises(ValueError):
        xs.map(lambda r: r)


def test_columns_stay_in_the_plan(spark, sf):
    f = Flow(spark.read.parquet(f"{sf}/lineitem.parquet")).filter(F.col("l_quantity") > 45).map("l_orderkey", "l_quantity")
    plan = f.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan
    assert plan.split("ReadSchema: ")[1].startswith("struct<l_orderkey:bigint,l_quantity:double>")
    assert "Python" not in plan and "Arrow" not in plan


def test_update_chain_inspect(xs):
    seen = Observation()
    f = xs.inspect(seen, F.count(F.lit(1)).alias("n")).update(n=F.col("n") + 1)
    assert f.chain(xs).chain(xs).count() == 15 and seen.get["n"] == 5
    assert xs.cloned() is xs


def test_group_keeps_emptied_groups(xs):
    big = F.col("n") > 2
    assert xs.group_by(["k"], Filtered(big, Count())) == {"a": 0, "b": 2, None: 1}
    assert xs.group_by(["k"], Piped(Identity.filter("n > 2"), Sum("n"))) == {"a": 0, "b": 6, None: 7}
    assert xs.group_by(["k"], Filtered(big, MaxBy("n", "n"))) == {"a": None, "b": 3, None: 7}


def test_nested_and_named_groups(xs):
    assert xs.group_by(["k"], GroupBy(["n"], Count())) == {("a", 1): 1, ("a", 2): 1, ("b", 3): 2, (None, 7): 1}
    assert xs.group_by(["k"], {"c": Count(), "s": Sum("n")})["b"] == {"c": 2, "s": 6}
    assert xs.group_by([F.col("n") % 2], Count()) == {1: 4, 0: 1}
    assert xs.group_by(["k"], SortN(1, ["n"]))["b"] is not None


def test_fork_is_one_pass_for_aggregates(xs):
    got = xs.fork(n=Count(), s=Sum("n"), top=SortN(2, ["n"]), h=Histogram("k"), a=All(F.col("n") > 0))
    assert list(got) == ["n", "s", "top", "h", "a"] and got["n"] == 5 and got["s"] == 16 and [r.n for r in got["top"]] == [1, 2] and got["a"] is True
    assert fork(xs.df, [Count(), Any_(F.col("n") > 6)]) == (5, True)
    one = fork_table(xs.df, {"n": Count(), "m": Mean("n"), "d": StdDev("n"), "hi": Max("n"), "lo": MinBy("n", "n")})
    assert one._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    with pytest.raises(ValueError):
        fork_table(xs.df, {"h": Histogram("k")})


def test_pipe_reuse(xs):
    p = Identity.filter("n > 1").map("k", "n").pipe(Identity.update(n=F.col("n") * 2))
    assert xs.pipe(p).sum("n") == 30 and xs.pipe(p.pipe(Count())) == 4
    assert xs.pipe(Identity).count() == 5


def test_joins_nested_and_null_safe(spark):
    left = Flow.of(spark, [(1, "x"), (1, "x"), (2, "y"), (None, "z")], "id bigint, v string")
    right = [(1, 30, "late"), (1, 10, "early"), (None, 5, "null"), (9, 1, "none")]
    schema = "id bigint, ord bigint, w string"
    got = sorted(((r.id, r.v, r.m) for r in left.left_join(right, ["id"], values=["w"], order=["ord"], into="m", schema=schema).collect()), key=str)
    assert got == sorted([(1, "x", ["early", "late"]), (1, "x", ["early", "late"]), (2, "y", []), (None, "z", ["null"])], key=str)
    assert left.inner_join(right, ["id"], values=["w"], into="m", schema=schema).count() == 3
    assert left.inner_join(right, ["id"], flatten=True, schema=schema).count() == 5
    structs = left.left_join(right, ["id"], into="m", schema=schema).df
    assert structs.schema["m"].dataType.elementType.names == ["ord", "w"]
    with pytest.raises(ValueError):
        left.left_join(right, ["id"], into="v", schema=schema)


def test_join_broadcasts_only_what_is_small(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    c = spark.read.parquet(f"{sf}/customer.parquet")
    df = joins.inner_join(c, n, ["c_nationkey"], right_on=["n_nationkey"], flatten=True)
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        df = joins.inner_join(c, n, ["c_nationkey"], right_on=["n_nationkey"], flatten=True)
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_collect_kinds(spark):
    f = Flow.of(spark, [("b", 2), ("a", 1), ("b", 3)], "k string, v bigint")
    assert f.map("k").collect("set") == {"a", "b"} and [r.k for r in f.map("k").collect("sorted")] == ["a", "b"]
    assert f.collect("map", order=["v"]) == {"a": 1, "b": 3}
    assert f.map("k").collect("text", separator="-", order=["k"]) == "a-b-b"
    assert f.collect("arrow").num_rows == 3 and len(f.collect("pandas")) == 3


def test_failures_reach_the_caller(spark):
    f = Flow(spark.range(1000)).map(lambda r: (1 // (r.id - 500),), schema="x bigint")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        f.count()


def test_sketch_sizes():
    assert sketches.register_bits(0.0808) == 8 and sketches.register_bits(0.00408) == 16 and sketches.count_min_size(0.99, 0.002) == (6, 1024)
    for bad in (0.4, 0.001, 0, 1):
        with pytest.raises(ValueError):
            sketches.register_bits(bad)
    with pytest.raises(ValueError):
        MostDistinct("a", "b", 3, error_rate=0.5)


def test_sketches_within_error(spark):
    df = spark.range(100_000).selectExpr("cast(id as string) AS s", "id % 100 AS k")
    hll = sketches.HyperLogLog(0.01)
    half = df.withColumn("p", F.col("k") % 2).groupBy("p").agg(hll.build(F.col("s")).alias("s"))
    assert abs(half.agg(hll.estimate(hll.merge(F.col("s"))).alias("n")).first()["n"] - 100_000) < 5_000
    small = spark.createDataFrame([("x",), ("y",), ("x",), ("z",), (None,)], "s string").agg(hll.estimate(hll.build(F.col("s"))).alias("n")).first()["n"]
    assert small == 3
    cm = sketches.CountMin(0.99, 0.002)
    asked = spark.createDataFrame([(7,), (None,), (-5,)], "k bigint")
    got = {r["k"]: r["estimate"] for r in cm.estimate(cm.table(df, F.col("k")), asked, "k").collect()}
    assert 1000 <= got[7] <= 1200 and got[None] == 0 and got[-5] <= 200
    top = Flow(df.withColumn("k", F.when(F.col("k") < 50, 1).otherwise(F.col("k")))).most_frequent("k", 1)
    assert top == [(1, 50_000)]


def test_sample_is_uniform(spark):
    """Late rows are no likelier than early ones, and too few rows come whole."""
    df = spark.range(40)
    seen = [0] * 40
    for seed in range(60):
        rows = Sample(10, seed).run(df)
        assert len({r.id for r in rows}) == 10
        for r in rows:
            seen[r.id] += 1
    assert sum(seen) == 600 and abs(sum(seen[:20]) - 300) < 75 and max(seen) < 35
    assert len(Sample(100).run(df)) == 40
    per = Sample(3).table(df.withColumn("g", F.col("id") % 4), ["g"])
    assert per.groupBy("g").count().where("count = 3").count() == 4


def test_opaque_sinks(spark):
    df = spark.range(1, 6)
    assert Fold(list, lambda s, r: [*s, r.id], lambda a, b: a + b).run(df) and Combine("id", lambda a, b: a * b).run(df) == 120
    acc = spark.sparkContext.accumulator(0)
    Flow(df).for_each(lambda r: acc.add(r.id))
    assert acc.value == 15
    assert Collect("list").run(df.coalesce(1)) == [1, 2, 3, 4, 5]
    assert MostFrequent("id", 2, exact=True).run(df) == [(1, 1), (2, 1)]


def test_every_sink_per_group(xs):
    """Folds, opaque reductions, rows kept in lists, several at once, three levels; groups emptied by a filter stay."""
    total = Fold(lambda: 0, lambda s, r: s + (r["n"] or 0), lambda a, b: a + b)
    plain = xs.group_by(["k"], Sum("n"))
    assert xs.group_by(["k"], total) == plain
    assert xs.group_by(["k"], Combine("n", lambda a, b: max(a, b))) == xs.group_by(["k"], Max("n"))
    assert xs.group_by(["k"], ForEach(lambda r: None)) == dict.fromkeys(plain)
    big = F.col("n") > 2
    assert xs.group_by(["k"], Filtered(big, Histogram("n"))) == {"a": [], "b": [(3, 2)], None: [(7, 1)]}
    assert xs.group_by(["k"], Filtered(big, SortN(1, ["n"])))["a"] == []
    assert xs.group_by(["k"], Filtered(big, total)) == {"a": 0, "b": 6, None: 7}
    assert xs.group_by(["k"], Piped(Identity.filter("n > 2"), Histogram("n")))["a"] == []
    several = xs.group_by(["k"], {"rows": Count(), "h": Histogram("n"), "t": total, "top": Filtered(big, SortN(1, ["n"]))})
    assert (several["b"]["rows"], several["b"]["h"], several["b"]["t"], len(several["b"]["top"])) == (2, [(3, 2)], 6, 1) and several["a"]["top"] == []
    three = xs.group_by(["k"], GroupBy(["n"], GroupBy([(F.col("n") % 2).alias("odd")], Count())))
    assert three == {("a", 1, 1): 1, ("a", 2, 0): 1, ("b", 3, 1): 2, (None, 7, 1): 1}
    assert xs.group_by(["k"], Filtered(big, GroupBy(["n"], Count()))) == {"a": {}, "b": {3: 2}, None: {7: 1}}


def test_folds_per_group_edges(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("nan"), 2), (None, 3), (0.5, None)], "g double, x int").repartition(3)
    add = Fold(lambda: 0, lambda s, r: s + (r["x"] or 0), lambda a, b: a + b, schema="bigint")
    got = {str(r["g"]): r["fold"] for r in GroupBy(["g"], add).table(df).collect()}
    assert got == {"nan": 3, "None": 3, "0.5": 0}
    assert GroupBy(["g"], add).run(df.limit(0)) == {}
    assert sorted(map(str, GroupBy(["g"], Combine("x", lambda a, b: a + b)).table(df).collect())) == sorted(map(str, GroupBy(["g"], Combine("x", "sum")).table(df).select("g", F.col("combine").cast("int")).collect()))
    few = grouped_fold(spark.range(5_000).selectExpr("id % 700 AS k", "id"), ["k"], lambda: 0, lambda s, r: s + 1, lambda a, b: a + b, most=50)
    assert few.count() == 700 and sum(load(r["_state"]) for r in few.collect()) == 5_000
