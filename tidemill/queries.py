"""Queries of the core operators, each with the statement that gives the same rows in another engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import Catalog, table
from tidemill.destinations import to_json, write_csv, write_json, write_parquet
from tidemill.functions import address, lists, value
from tidemill.functions import time as tm
from tidemill.operators import joins, sketches
from tidemill.operators.sinks import All, Any_, Collect, Combine, Count, Fold, GroupBy, Histogram, Max, MaxBy, Mean, Min, MinBy, MostDistinct, MostFrequent, Sample, SortN, StdDev, Sum
from tidemill.plans.flow import Flow
from tidemill.plans.pipe import Filtered, Identity, Piped
from tidemill.sources.csv import read_csv
from tidemill.sources.json import read_json, read_json_concatenated
from tidemill.sources.parquet import read_parquet, read_parquet_directory
from tidemill.sources.weblog import parse_lines
from tidemill.storage import new_path
from tidemill.streaming import windows

catalog = Catalog()


def flow(spark: SparkSession, d: str, name: str) -> Flow:
    return Flow(table(spark, d, name))


# ---------------------------------------------------------------- row transforms


@catalog.query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue, upper(l_returnflag) AS flag FROM lineitem WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '1995-01-01'")
def map_filter_update(spark: SparkSession, d: str) -> DataFrame:
    revenue = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue")
    kept = flow(spark, d, "lineitem").filter((F.col("l_quantity") > 45) & (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")))
    return kept.map("l_orderkey", "l_linenumber", revenue, F.col("l_returnflag").alias("flag")).update(flag=F.upper("flag")).df


@catalog.query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderkey % 7 = 3")
def map_filter_python(spark: SparkSession, d: str) -> DataFrame:
    """The same by Python functions, over Arrow batches."""
    rows = flow(spark, d, "orders").map("o_orderkey", "o_totalprice").filter(lambda r: r.o_orderkey % 7 == 3)
    return rows.map(lambda r: (r.o_orderkey, r.o_totalprice * 2), schema="o_orderkey bigint, twice double").df


@catalog.query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(p_name, ' ')) AS w FROM part) GROUP BY w")
def flat_map_words(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "part").flat_map(F.split("p_name", " "), "word").group("word", n=Count())


@catalog.query("SELECT o_orderstatus, c AS letter, count(*) AS n FROM (SELECT o_orderstatus, unnest(regexp_split_to_array(o_orderpriority, '')) AS c FROM orders) WHERE c <> '' GROUP BY ALL")
def flat_map_python(spark: SparkSession, d: str) -> DataFrame:
    rows = flow(spark, d, "orders").map("o_orderstatus", "o_orderpriority").flat_map(lambda r: [(r.o_orderstatus, c) for c in r.o_orderpriority], schema="o_orderstatus string, letter string")
    return rows.group("o_orderstatus", "letter", n=Count())


@catalog.query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def chain_union_all(spark: SparkSession, d: str) -> DataFrame:
    region = flow(spark, d, "region").map(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return flow(spark, d, "nation").map(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).chain(region).chain(region).df


_BALANCED = Identity.filter("c_acctbal > 0").map("c_mktsegment", "c_acctbal")


@catalog.query("SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def pipe_reused(spark: SparkSession, d: str) -> DataFrame:
    """A pipe without a source, applied to a table."""
    out = flow(spark, d, "customer").pipe(_BALANCED).group("c_mktsegment", mean=Mean("c_acctbal"), n=Count())
    return out.withColumn("mean", F.round("mean", 6))


# ---------------------------------------------------------------- joins


@catalog.query("SELECT n_nationkey, n_name, coalesce(m, []) AS customers FROM nation LEFT JOIN (SELECT c_nationkey, list(c_custkey ORDER BY c_custkey) AS m FROM customer GROUP BY 1) ON n_nationkey = c_nationkey")
def left_join_nested(spark: SparkSession, d: str) -> DataFrame:
    right = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    return flow(spark, d, "nation").map("n_nationkey", "n_name").left_join(right, ["n_nationkey"], right_on=["c_nationkey"], into="customers").df


@catalog.query("SELECT p_partkey, m AS lines FROM part JOIN (SELECT l_partkey, list(l_quantity ORDER BY l_quantity) AS m FROM lineitem WHERE l_quantity >= 49 GROUP BY 1) ON p_partkey = l_partkey")
def inner_join_nested(spark: SparkSession, d: str) -> DataFrame:
    right = table(spark, d, "lineitem").where("l_quantity >= 49").select("l_partkey", "l_quantity")
    return flow(spark, d, "part").map("p_partkey").inner_join(right, ["p_partkey"], right_on=["l_partkey"], into="lines").df


@catalog.query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def inner_join_flat(spark: SparkSession, d: str) -> DataFrame:
    right = table(spark, d, "nation").select("n_nationkey", "n_name")
    return flow(spark, d, "supplier").inner_join(right, ["s_nationkey"], right_on=["n_nationkey"], flatten=True).map("s_suppkey", "s_name", "n_name").df


@catalog.query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join_count(spark: SparkSession, d: str) -> DataFrame:
    right = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    joined = flow(spark, d, "customer").map("c_custkey").left_join(right, ["c_custkey"], right_on=["o_custkey"], into="orders")
    return joined.map("c_custkey", F.size("orders").cast("bigint").alias("n")).df


@catalog.query("WITH c AS (SELECT DISTINCT committer_email AS e FROM commits), a AS (SELECT committer_email AS e, count(*) AS n FROM commits GROUP BY 1) SELECT c.e AS email, n FROM c JOIN a ON c.e IS NOT DISTINCT FROM a.e")
def join_null_keys(spark: SparkSession, d: str) -> DataFrame:
    """Null keys match null keys."""
    commits = table(spark, d, "commits").select(F.col("committer_email").alias("email"))
    return joins.inner_join(commits.distinct(), commits.groupBy(F.col("email").alias("e")).agg(F.count(F.lit(1)).alias("n")), ["email"], right_on=["e"], flatten=True)


# ---------------------------------------------------------------- terminal operators


@catalog.query("SELECT count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS total, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread, max(value) AS high, min(value) AS low, bool_and(value > 0) AS positive, bool_or(event_type = 'none') AS none FROM events")
def fork_multi_sink(spark: SparkSession, d: str) -> DataFrame:
    """Eight sinks in one pass."""
    out = flow(spark, d, "events").agg(rows=Count(), total=Sum("event_id"), mean=Mean("value"), spread=StdDev("value"), high=Max("value"), low=Min("value"), positive=All(F.col("value") > 0), none=Any_(F.col("event_type") == "none"))
    return out.withColumns({"mean": F.round("mean", 6), "spread": F.round("spread", 6)})


@catalog.query("SELECT l_returnflag, l_linestatus, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, round(stddev_pop(l_tax), 6) AS sd_tax, count(*) AS n FROM lineitem GROUP BY 1, 2")
def group_many_sinks(spark: SparkSession, d: str) -> DataFrame:
    out = flow(spark, d, "lineitem").group("l_returnflag", "l_linestatus", sum_qty=Sum("l_quantity"), avg_disc=Mean("l_discount"), sd_tax=StdDev("l_tax"), n=Count())
    return out.withColumns({"sum_qty": F.round("sum_qty", 2), "avg_disc": F.round("avg_disc", 6), "sd_tax": F.round("sd_tax", 6)})


@catalog.query("SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1")
def histogram_event_type(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "events").table(Histogram("event_type"))


@catalog.query("SELECT event_type, count(*) FILTER (WHERE value > 450) AS big, round(coalesce(sum(value) FILTER (WHERE value > 450), 0), 4) AS amount FROM events GROUP BY 1")
def group_filter_keep_empty(spark: SparkSession, d: str) -> DataFrame:
    """A filter behind the grouping: groups that it empties still appear."""
    big = F.col("value") > 450
    return flow(spark, d, "events").group("event_type", big=Filtered(big, Count()), amount=Filtered(big, Sum("value"))).withColumn("amount", F.round("amount", 4))


@catalog.query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase' AND value > 400) AS count FROM events GROUP BY 1")
def group_pipe_keep_empty(spark: SparkSession, d: str) -> DataFrame:
    """As before with a pipe of several steps in front of the sink."""
    inner = Identity.filter(F.col("event_type") == "purchase").filter(F.col("value") > 400)
    return flow(spark, d, "events").table(GroupBy(["user_id"], Piped(inner, Count())))


@catalog.query("SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY ALL")
def group_by_nested(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "orders").table(GroupBy(["o_orderstatus"], GroupBy(["o_orderpriority"], Count())))


@catalog.query(
    """SELECT event_type, arg_max(event_id, row(value, -event_id)) AS top, arg_min(event_id, row(value, event_id)) AS bottom FROM events GROUP BY 1"""
)
def max_by_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "events").group("event_type", top=MaxBy("event_id", "value", [-F.col("event_id")]), bottom=MinBy("event_id", "value", ["event_id"]))


@catalog.query("SELECT CAST(bit_xor(event_id) AS BIGINT) AS x, CAST(bit_or(user_id) AS BIGINT) AS o, CAST(sum(user_id) AS BIGINT) AS s FROM events")
def combine_builtin(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "events").agg(x=Combine("event_id", "bit_xor"), o=Combine("user_id", "bit_or"), s=Combine("user_id", "sum"))


@catalog.query("SELECT CAST(sum(l_linenumber * l_linenumber) AS BIGINT) AS fold FROM lineitem")
def fold_sum_of_squares(spark: SparkSession, d: str) -> DataFrame:
    """An opaque fold in Python; only states travel."""
    total = flow(spark, d, "lineitem").map("l_linenumber").fold(lambda: 0, lambda s, r: s + r.l_linenumber**2, lambda a, b: a + b)
    return spark.range(1).select(F.lit(total).cast("bigint").alias("fold"))


@catalog.query("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def sort_n(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "events").map("event_id", "user_id", "value").table(SortN(10, [F.desc("value"), F.asc("event_id")]))


@catalog.query("SELECT event_type, event_id, value FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r FROM events) WHERE r <= 3")
def sort_n_grouped(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "events").map("event_type", "event_id", "value").table(GroupBy(["event_type"], SortN(3, ["value", "event_id"])))


@catalog.query("SELECT user_id AS item, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def most_frequent_exact(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "events").table(MostFrequent("user_id", 10, exact=True))


@catalog.query("SELECT true AS within, 10 AS n")
def most_frequent_approx(spark: SparkSession, d: str) -> DataFrame:
    """The approximate counts of the ten most frequent parts lie within the tolerance of the exact ones."""
    line = table(spark, d, "lineitem")
    top = Flow(line).table(MostFrequent("l_suppkey", 10, tolerance=0.001)).select(F.explode("most_frequent").alias("m")).select("m.item", "m.count")
    exact = line.groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = line.agg(F.count(F.lit(1)).alias("total"))
    both = top.join(exact, top["item"] == exact["k"]).crossJoin(F.broadcast(total))  # one row
    return both.agg(F.bool_and(F.abs(F.col("count") - F.col("n")) <= F.col("total") * 0.001).alias("within"), F.count(F.lit(1)).cast("int").alias("n"))


@catalog.query("SELECT user_id AS item, count(DISTINCT event_type) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def most_distinct_exact(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "events").table(MostDistinct("user_id", "event_type", 10, exact=True))


@catalog.query("SELECT edge_location AS item, true AS within FROM cloudfront WHERE edge_location IS NOT NULL GROUP BY 1")
def most_distinct_approx(spark: SparkSession, d: str) -> DataFrame:
    """The sketches' counts of distinct clients lie within five standard errors of the exact ones, at every edge."""
    cf = table(spark, d, "cloudfront").where("edge_location IS NOT NULL")
    top = Flow(cf).table(MostDistinct("edge_location", "remote_ip", 100_000, error_rate=0.01))
    exact = cf.groupBy(F.col("edge_location").alias("k")).agg(F.count_distinct("remote_ip").alias("n"))
    return top.join(exact, top["item"] == exact["k"]).select("item", (F.abs(F.col("count") - F.col("n")) <= F.greatest(F.col("n") * 0.05, F.lit(2))).alias("within"))


@catalog.query("SELECT true AS within, count(DISTINCT url) AS n FROM cloudfront")
def hyperloglog_merged(spark: SparkSession, d: str) -> DataFrame:
    """A sketch for each day, merged: within five standard errors of the exact count."""
    cf = table(spark, d, "cloudfront")
    hll = sketches.HyperLogLog(0.01)
    days = cf.groupBy(F.to_date("time").alias("day")).agg(hll.build(F.col("url")).alias("s"))
    merged = days.agg(hll.estimate(hll.merge(F.col("s"))).alias("e")).crossJoin(cf.agg(F.count_distinct("url").alias("n")))  # one row each
    return merged.select((F.abs(F.col("e") - F.col("n")) <= F.col("n") * 0.05).alias("within"), "n")


@catalog.query("SELECT count(DISTINCT url) AS n_values, true AS never_low, true AS within FROM cloudfront")
def count_min_estimates(spark: SparkSession, d: str) -> DataFrame:
    """A count-min sketch of many more values than counters: never too low, and for 99 % of the values too high by its tolerance at most."""
    cf = table(spark, d, "cloudfront").where(F.col("url").isNotNull())
    cm = sketches.CountMin(0.99, 0.002)
    exact = cf.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    total = cf.agg(F.count(F.lit(1)).alias("total"))
    est = cm.estimate(cm.table(cf, F.col("url")), exact, "url").crossJoin(F.broadcast(total))  # one row
    return est.agg(F.count(F.lit(1)).alias("n_values"), F.bool_and(F.col("estimate") >= F.col("n")).alias("never_low"), (F.avg((F.col("estimate") <= F.col("n") + F.col("total") * 0.002).cast("int")) >= 0.99).alias("within"))


@catalog.query("SELECT least(count(*), 100) AS n, true AS distinct_rows FROM events")
def reservoir_sample(spark: SparkSession, d: str) -> DataFrame:
    drawn = flow(spark, d, "events").map("event_id").table(Sample(100, seed=5))
    return drawn.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("event_id") == F.count(F.lit(1))).alias("distinct_rows"))


@catalog.query("SELECT event_type, least(count(*), 20) AS n FROM events GROUP BY 1")
def sample_per_group(spark: SparkSession, d: str) -> DataFrame:
    drawn = flow(spark, d, "events").map("event_type", "event_id").table(GroupBy(["event_type"], Sample(20, seed=5)))
    return drawn.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@catalog.query("SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS sorted FROM customer GROUP BY 1")
def collect_set(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "customer").map("c_nationkey", "c_mktsegment").table(GroupBy(["c_nationkey"], Collect("sorted")))


@catalog.query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS text FROM nation GROUP BY 1")
def collect_text(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "nation").map("n_regionkey", "n_name").table(GroupBy(["n_regionkey"], Collect("text", separator=", ")))


@catalog.query("SELECT event_type, user_id, max_by(value, event_id) AS last FROM events GROUP BY ALL")
def collect_map(spark: SparkSession, d: str) -> DataFrame:
    """A map per group in which the last row of a repeated key wins, unfolded again."""
    maps = flow(spark, d, "events").map("event_type", "user_id", "value", "event_id").table(GroupBy(["event_type"], Collect("map", order=["event_id"])))
    return maps.select("event_type", F.explode("map").alias("user_id", "last"))


@catalog.query("SELECT count(*) AS seen, round(CAST(sum(value) AS DOUBLE), 2) AS amount FROM events")
def inspect_observed(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates observed while rows pass through to another action."""
    from pyspark.sql import Observation

    seen = Observation("seen")
    flow(spark, d, "events").inspect(seen, F.count(F.lit(1)).alias("seen"), F.sum("value").alias("amount")).df.write.format("noop").mode("overwrite").save()
    return spark.range(1).select(F.lit(seen.get["seen"]).cast("bigint").alias("seen"), F.round(F.lit(seen.get["amount"]).cast("double"), 2).alias("amount"))


# ---------------------------------------------------------------- any sink per group, several sinks over one table


@catalog.query("SELECT event_type, CAST(sum(length(props)) AS BIGINT) AS fold FROM events GROUP BY 1")
def group_fold(spark: SparkSession, d: str) -> DataFrame:
    """An opaque fold for each group: states of the partitions are shuffled and merged."""
    chars = Fold(lambda: 0, lambda s, r: s + len(r["props"]), lambda a, b: a + b, schema="bigint")
    return flow(spark, d, "events").map("event_type", "props").table(GroupBy(["event_type"], chars))


@catalog.query("SELECT o_orderpriority, max(o_totalprice) AS combine FROM orders GROUP BY 1")
def group_combine_function(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "orders").map("o_orderpriority", "o_totalprice").table(GroupBy(["o_orderpriority"], Combine("o_totalprice", lambda a, b: max(a, b))))


@catalog.query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL")
def group_nested_three(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "lineitem").table(GroupBy(["l_returnflag"], GroupBy(["l_linestatus"], GroupBy(["l_linenumber"], Count()))))


@catalog.query(
    """WITH h AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 300 GROUP BY ALL)
SELECT u.user_id, h.event_type AS value, h.n AS count FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN h ON u.user_id = h.user_id"""
)
def group_histogram_keep_empty(spark: SparkSession, d: str) -> DataFrame:
    """A histogram behind a filter for each group; groups that the filter empties have one row of nulls."""
    per = flow(spark, d, "events").table(GroupBy(["user_id"], {"h": Filtered(F.col("value") > 300, Histogram("event_type"))}))
    return per.select("user_id", F.explode_outer("h").alias("x")).select("user_id", "x.value", "x.count")


@catalog.query(
    """WITH g AS (SELECT event_type, count(*) AS rows, max(value) AS best FROM events GROUP BY 1),
t AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events)
SELECT g.event_type, rows, best, t.r AS rank, t.value FROM g JOIN t USING (event_type) WHERE t.r <= 3"""
)
def group_mixed_sinks(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates and a list of rows for each group, side by side."""
    sinks = {"rows": Count(), "best": Max("value"), "top": SortN(3, [F.desc("value"), "event_id"])}
    per = flow(spark, d, "events").map("event_type", "event_id", "value").table(GroupBy(["event_type"], sinks))
    return per.select("event_type", "rows", "best", F.posexplode("top").alias("rank", "x")).select("event_type", "rows", "best", (F.col("rank") + 1).cast("bigint").alias("rank"), "x.value")


@catalog.query(
    """WITH t AS (SELECT CAST(user_id AS VARCHAR) AS item, count(DISTINCT event_type) AS n FROM events GROUP BY 1)
SELECT 'rows' AS sink, CAST(NULL AS VARCHAR) AS item, count(*) AS n FROM events UNION ALL SELECT 'histogram', event_type, count(*) FROM events GROUP BY event_type
UNION ALL (SELECT 'top', item, n FROM (SELECT CAST(event_type AS VARCHAR) AS item, count(DISTINCT user_id) AS n FROM events GROUP BY 1) ORDER BY n DESC, item LIMIT 3)"""
)
def fork_mixed(spark: SparkSession, d: str) -> DataFrame:
    """A fork of an aggregate, a histogram and a top list over one persisted table."""
    got = flow(spark, d, "events").map("event_type", "user_id").fork(rows=Count(), histogram=Histogram("event_type"), top=MostDistinct("event_type", "user_id", 3, exact=True))
    rows = [("rows", None, got["rows"])] + [(k, item, n) for k in ("histogram", "top") for item, n in got[k]]
    return spark.createDataFrame(rows, "sink string, item string, n bigint")


@catalog.query("SELECT count(*) AS seen, CAST(sum(event_id) AS BIGINT) AS ids FROM events")
def for_each_row(spark: SparkSession, d: str) -> DataFrame:
    """A function called with every row, where the row is; what it saw is told by accumulators."""
    sc = spark.sparkContext
    seen, ids = sc.accumulator(0), sc.accumulator(0)

    def look(row) -> None:  # noqa: ANN001
        seen.add(1)
        ids.add(row["event_id"])

    flow(spark, d, "events").map("event_id").for_each(look)
    return spark.createDataFrame([(seen.value, ids.value)], "seen bigint, ids bigint")


# ---------------------------------------------------------------- time, addresses, dynamic values, lists


@catalog.query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS slot, count(*) AS n FROM events GROUP BY 1")
def group_count_15min(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "events").map(tm.truncate_minutes(F.col("ts"), 15).alias("slot")).group("slot", n=Count())


@catalog.query("SELECT date_trunc('hour', ts) AS slot, event_type, count(*) AS n FROM events GROUP BY ALL")
def group_count_hour(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "events").map(tm.truncate_minutes(F.col("ts"), 60).alias("slot"), "event_type").group("slot", "event_type", n=Count())


@catalog.query("SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS mo, CAST(dayofmonth(ts) AS INTEGER) AS dy, CAST(dayofyear(ts) AS INTEGER) AS o, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS days FROM events")
def time_parts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ts")
    return flow(spark, d, "events").map("event_id", tm.year(t).alias("y"), tm.month(t).alias("mo"), tm.day(t).alias("dy"), tm.ordinal(t).alias("o"), tm.hour(t).alias("h"), tm.minute(t).alias("mi"), tm.second(t).alias("s"), tm.as_days(t.cast("date")).alias("days")).df


_HOST = r"^[a-zA-Z]+://([^/:?#]+)"


@catalog.query(f"SELECT regexp_extract(url, '{_HOST}', 1) AS value, count(*) AS count FROM webpages WHERE url IS NOT NULL GROUP BY 1")
def url_host_histogram(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "webpages").filter(F.col("url").isNotNull()).table(Histogram(address.url_part(F.col("url"), "host")))


@catalog.query("SELECT remote_ip, regexp_full_match(remote_ip, '[0-9.]+') AS v4, count(*) AS n FROM cloudfront WHERE remote_ip IS NOT NULL GROUP BY ALL")
def ip_kinds(spark: SparkSession, d: str) -> DataFrame:
    return flow(spark, d, "cloudfront").filter(F.col("remote_ip").isNotNull()).map("remote_ip", address.is_ipv4(F.col("remote_ip")).alias("v4")).group("remote_ip", "v4", n=Count())


@catalog.query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def json_key_group(spark: SparkSession, d: str) -> DataFrame:
    """A field of a dynamic value, extracted with its type before it is grouped by."""
    k = value.try_get(value.parse(F.col("props")), "i64", "$.k").alias("k")
    return flow(spark, d, "events").map(k, "user_id").df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


_KINDS = """SELECT event_id, value > 250 AS b, value AS f, CAST(ts AS DATE) AS dt, event_type AS s, CAST(user_id AS BIGINT) AS i, true AS is_f, false AS is_b,
 CASE WHEN value > 250 THEN 'BOOLEAN' END AS kind, CAST(NULL AS BIGINT) AS not_i, 3 AS n_list, CAST(event_id AS BIGINT) AS second FROM events"""


@catalog.query(_KINDS)
def value_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Dynamic values of several kinds: tested, read as their type, read as another (null), lists and groups inside."""
    text = F.to_json(F.struct((F.col("value") > 250).alias("b"), F.col("value").alias("f"), F.col("ts").cast("date").cast("string").alias("dt"), F.col("event_type").alias("s"), F.col("user_id").alias("i"), F.array(F.lit(0).cast("bigint"), "event_id", "user_id").alias("l"), F.struct(F.col("event_id").alias("x")).alias("g")))
    v = value.parse(text)
    return flow(spark, d, "events").map("event_id", v.alias("v")).df.select(
        "event_id",
        value.get(F.col("v"), "bool", "$.b").alias("b"),
        value.get(F.col("v"), "f64", "$.f").alias("f"),
        value.get(F.col("v"), "date", "$.dt").alias("dt"),
        value.get(F.col("v"), "string", "$.s").alias("s"),
        value.get(F.col("v"), "i64", "$.i").alias("i"),
        value.is_kind(F.col("v"), "f64", "$.f").alias("is_f"),
        value.is_kind(F.col("v"), "bool", "$.f").alias("is_b"),
        F.when(value.get(F.col("v"), "bool", "$.b"), value.kind_of(F.try_variant_get("v", "$.b", "variant"))).alias("kind"),
        value.try_get(F.col("v"), "i64", "$.s").alias("not_i"),
        F.size(value.get(F.col("v"), "array<bigint>", "$.l")).alias("n_list"),
        F.when(value.get(F.col("v"), "i64", "$.l[1]") == value.get(F.col("v"), "i64", "$.g.x"), value.get(F.col("v"), "i64", "$.g.x")).alias("second"),
    )


@catalog.query("SELECT count(*) FILTER (l_returnflag = 'A') AS n, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'A') AS orders FROM lineitem")
def parquet_path_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Files chosen by a predicate of their path."""
    path = new_path(spark, "flags")
    table(spark, d, "lineitem").select("l_returnflag", "l_orderkey").write.partitionBy("l_returnflag").parquet(path)
    kept = read_parquet_directory(spark, path, keep=lambda p: "/l_returnflag=A/" in p)
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("orders"))


@catalog.query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm2 FROM embeddings")
def list_functions(spark: SparkSession, d: str) -> DataFrame:
    squares = lists.map_list(F.col("embedding"), lambda x: x.cast("double") * x.cast("double"))
    return flow(spark, d, "embeddings").map("vec_id", lists.length(F.col("embedding")).alias("n"), F.round(F.aggregate(squares, F.lit(0.0), lambda a, b: a + b), 4).alias("norm2")).df


@catalog.query("SELECT city, count(*) AS n, round(avg(temp_hi), 6) AS hi, count(invent.supplier_id) AS supplied, round(CAST(max(invent.price) AS DOUBLE), 4) AS price FROM weather GROUP BY 1")
def nested_columns(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a nested row, read without its other fields."""
    out = table(spark, d, "weather").groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("temp_hi"), 6).alias("hi"), F.count("invent.supplier_id").alias("supplied"), F.round(F.max("invent.price"), 4).alias("price"))
    return out


@catalog.query("SELECT coalesce(author_email, '') AS author, count(*) AS n, CAST(sum(loc_i - loc_d) AS BIGINT) AS net, max(nfiles) AS files FROM commits WHERE NOT ismerge GROUP BY 1")
def commits_per_author(spark: SparkSession, d: str) -> DataFrame:
    rows = flow(spark, d, "commits").filter(~F.col("ismerge")).map(F.coalesce("author_email", F.lit("")).alias("author"), (F.col("loc_i") - F.col("loc_d")).alias("net"), "nfiles")
    return rows.group("author", n=Count(), net=Sum("net"), files=Max("nfiles"))


# ---------------------------------------------------------------- sources


def _as_line(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("-"))


_LOGGED = "time edge_location response_bytes remote_ip method host url status user_agent referer cookie result_type request_id request_bytes time_taken forwarded_for response_result_type http_version fle_status fle_encrypted_fields".split()
_REQUIRED = " AND ".join(f"{c} IS NOT NULL" for c in ("time", "edge_location", "response_bytes", "remote_ip", "time_taken", "url"))


@catalog.query(f"SELECT {', '.join(_LOGGED)}, ssl_protocol_cipher.protocol AS protocol, ssl_protocol_cipher.cipher AS cipher FROM cloudfront WHERE {_REQUIRED}")
def weblog_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Rows written out as log lines of 26 fields, every field from the row, and parsed again; of rows that have the fields which no line is without."""
    cf = table(spark, d, "cloudfront").where(_REQUIRED)
    url = lambda pattern: F.regexp_extract("url", pattern, 1)
    query = F.when(F.col("url").contains("?"), url(r"\?(.*)$")).otherwise("-")
    ssl = lambda part: F.coalesce(F.col(f"ssl_protocol_cipher.{part}"), F.lit("-"))
    cells = [
        F.substring(F.col("time").cast("string"), 1, 10), F.substring(F.col("time").cast("string"), 12, 8), F.col("edge_location"), _as_line("response_bytes"), F.col("remote_ip"), F.col("method"), F.col("host"), url(r"^[a-z]+://[^/?]+([^?]*)"), F.coalesce(F.col("status").cast("string"), F.lit("000")),
        _as_line("referer"), _as_line("user_agent"), query, _as_line("cookie"), F.col("result_type"), F.col("request_id"), url(r"^[a-z]+://([^/?]+)"), url(r"^([a-z]+)://"), _as_line("request_bytes"),
        F.format_string("%d.%03d", F.floor(F.col("time_taken") / 1000), F.pmod("time_taken", F.lit(1000))), _as_line("forwarded_for"), ssl("protocol"), ssl("cipher"), F.col("response_result_type"), F.col("http_version"), _as_line("fle_status"), _as_line("fle_encrypted_fields"),
    ]
    parsed = parse_lines(cf.select(F.concat_ws("\t", *cells).alias("value")))
    return parsed.select(*_LOGGED, F.col("ssl_protocol_cipher.protocol").alias("protocol"), F.col("ssl_protocol_cipher.cipher").alias("cipher"))


@catalog.query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as CSV without a header and read back with a schema, of which every row must fit."""
    c, path = table(spark, d, "customer"), new_path(spark, "csv")
    write_csv(c, path)
    return read_csv(spark, path, c.schema)


@catalog.query("SELECT event_id, user_id, event_type, value, props FROM events")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    e, path = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props"), new_path(spark, "json")
    write_json(e, path)
    return read_json(spark, path, e.schema)


@catalog.query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def json_concatenated_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Objects one after another in a line, a thousand to a line, all of which must come back."""
    s, path = table(spark, d, "supplier"), new_path(spark, "jsonc")
    lines = s.groupBy(F.expr("s_suppkey div 1000")).agg(F.array_join(F.collect_list(to_json(*s.columns)), "").alias("value"))
    lines.select("value").write.text(path)
    return read_json_concatenated(spark, path, s.schema)


@catalog.query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def parquet_directory_pruned(spark: SparkSession, d: str) -> DataFrame:
    """A directory of key=value folders: the filter on the folder's column prunes files, and only two columns are read."""
    path = new_path(spark, "tree")
    write_parquet(table(spark, d, "orders"), path, partition_by=["o_orderstatus"])
    return read_parquet_directory(spark, path).where("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice", "o_orderstatus")


@catalog.query("SELECT l_orderkey, l_tax FROM lineitem UNION ALL SELECT l_orderkey, l_tax FROM lineitem")
def parquet_files_repeated(spark: SparkSession, d: str) -> DataFrame:
    """The same file twice in a list gives its rows twice; the schema's columns are checked in the footer first."""
    return read_parquet(spark, [f"{d}/lineitem.parquet"] * 2, "l_orderkey bigint, l_tax double")


@catalog.query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS is_number, false AS is_text, NULL::BIGINT AS missing FROM events")
def dynamic_values(spark: SparkSession, d: str) -> DataFrame:
    """Tests and typed extraction of a dynamic value; what isn't there is null."""
    v = value.parse(F.col("props"))
    rows = flow(spark, d, "events").map("event_id", v.alias("v"))
    v = F.col("v")
    return rows.map("event_id", value.get(v, "i64", "$.k").alias("k"), value.is_kind(v, "i64", "$.k").alias("is_number"), F.coalesce(value.is_kind(v, "string", "$.k"), F.lit(False)).alias("is_text"), value.try_get(v, "i64", "$.none").alias("missing")).df


# ---------------------------------------------------------------- beyond the reference: native joins, windows, event time


@catalog.query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 300000")
    c = table(spark, d, "customer")
    return c.join(big, c["c_custkey"] == big["o_custkey"], "left_semi").select("c_custkey")


@catalog.query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a large order."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 400000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@catalog.query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@catalog.query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS count FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    out = windows.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
