"""The queries of the training-data problems, with oracle statements where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import Catalog, table
from tidemill.llm import bitmaps, boilerplate, encoding, frequent, leakage, quality, quantiles, tokenize
from tidemill.storage import materialize

catalog = Catalog()

# ---------------------------------------------------------------- 3: percentiles

PERMILLE = [10, 250, 500, 750, 900, 950, 990, 999]
MEASURES = ["time_taken", "response_bytes"]
LEVELS = {"day_edge": ["day", "edge_location"], "day": ["day"], "edge": ["edge_location"], "all": []}
_PERCENTILES = f"""
WITH long AS (SELECT CAST(time AS DATE) AS day, edge_location, 'time_taken' AS measure, time_taken AS value FROM cloudfront WHERE time_taken IS NOT NULL
  UNION ALL SELECT CAST(time AS DATE), edge_location, 'response_bytes', response_bytes FROM cloudfront WHERE response_bytes IS NOT NULL),
levels AS ({" UNION ALL ".join(f"SELECT '{name}' AS level, {'day' if 'day' in own else 'CAST(NULL AS DATE)'} AS day, {'edge_location' if 'edge_location' in own else 'CAST(NULL AS VARCHAR)'} AS edge_location, measure, value FROM long" for name, own in LEVELS.items())}),
freq AS (SELECT level, day, edge_location, measure, value, count(*) AS k FROM levels GROUP BY ALL),
cum AS (SELECT *, CAST(sum(k) OVER (PARTITION BY level, day, edge_location, measure ORDER BY value) AS BIGINT) AS upto, CAST(sum(k) OVER (PARTITION BY level, day, edge_location, measure) AS BIGINT) AS n FROM freq),
p AS (SELECT CAST(unnest({PERMILLE}) AS INTEGER) AS permille)
SELECT level, day, edge_location, measure, permille, value, n, CAST(0 AS BIGINT) AS max_rank_error
FROM cum, p WHERE greatest(1, (permille * n + 999) // 1000) > upto - k AND greatest(1, (permille * n + 999) // 1000) <= upto
"""


@catalog.query(_PERCENTILES)
def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of both measures for every day and edge_location, every day, every edge_location, and over all, from the written counts of the days."""
    cf = table(spark, d, "cloudfront")
    days = materialize(quantiles.frequencies(cf, [F.to_date("time").alias("day"), F.col("edge_location")], MEASURES), "day-frequencies")
    levels = materialize(quantiles.roll_up(days, LEVELS, ["day", "edge_location"]), "level-frequencies")
    return quantiles.percentiles(levels, PERMILLE)


# ---------------------------------------------------------------- 4: distinct counts

_IDENTIFIERS = ("remote_ip", "url")
_DAY = "CAST(time AS DATE)"
_DISTINCT = " UNION ALL ".join(
    f"SELECT '{c}' AS identifier, '{level}' AS level, {day} AS day, {edge} AS edge_location, count(DISTINCT {c}) AS n_distinct, CAST(0 AS BIGINT) AS max_error FROM cloudfront WHERE {c} IS NOT NULL {group}"
    for c in _IDENTIFIERS
    for level, day, edge, group in (
        ("day_edge", _DAY, "edge_location", f"GROUP BY {_DAY}, edge_location"),
        ("day", _DAY, "CAST(NULL AS VARCHAR)", f"GROUP BY {_DAY}"),
        ("edge", "CAST(NULL AS DATE)", "edge_location", "GROUP BY edge_location"),
        ("all", "CAST(NULL AS DATE)", "CAST(NULL AS VARCHAR)", ""),
    )
)


def _bitmaps(spark: SparkSession, d: str, column: str) -> DataFrame:
    cf = table(spark, d, "cloudfront")
    groups = [("day", F.to_date("time")), ("edge_location", F.col("edge_location"))]
    return materialize(bitmaps.bitmaps(cf, groups, column, bitmaps.dictionary(cf, column)), f"bitmaps-{column}")


@catalog.query(_DISTINCT)
def p4_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct remote_ip and url per day and edge_location, per day, per edge_location, and over all, from one set of bitmaps."""
    out = []
    for c in _IDENTIFIERS:
        base = _bitmaps(spark, d, c)
        by_day = materialize(bitmaps.union(base, ["day"]), f"bitmaps-day-{c}")
        levels = [("day_edge", base, ["day", "edge_location"]), ("day", by_day, ["day"]), ("edge", bitmaps.union(base, ["edge_location"]), ["edge_location"]), ("all", bitmaps.union(by_day, []), [])]
        for level, bm, keys in levels:
            n = bitmaps.count_bits(bm, keys)
            day = F.col("day") if "day" in keys else F.lit(None).cast("date").alias("day")
            edge = F.col("edge_location") if "edge_location" in keys else F.lit(None).cast("string").alias("edge_location")
            out.append(n.select(F.lit(c).alias("identifier"), F.lit(level).alias("level"), day, edge, "n_distinct", "max_error"))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


@catalog.query(
    f"""WITH d AS (SELECT DISTINCT {_DAY} AS day, remote_ip FROM cloudfront WHERE remote_ip IS NOT NULL AND time IS NOT NULL)
SELECT a.day, count(*) AS n_returning FROM d a JOIN d b ON a.remote_ip = b.remote_ip AND b.day = a.day - INTERVAL 1 DAY GROUP BY a.day"""
)
def p4_returning(spark: SparkSession, d: str) -> DataFrame:
    """Clients seen on a day and on the day before: the AND of two days' bitmaps."""
    by_day = materialize(bitmaps.union(_bitmaps(spark, d, "remote_ip"), ["day"]), "bitmaps-day").where(F.col("day").isNotNull())
    both = bitmaps.intersect(by_day, by_day.withColumn("day", F.date_add("day", 1)), ["day"])
    return bitmaps.count_bits(both, ["day"]).select("day", F.col("n_distinct").alias("n_returning"))


# ---------------------------------------------------------------- 6: frequent values

_FREQUENT = """WITH u AS (SELECT 'cloudfront' AS table_name, url FROM cloudfront UNION ALL SELECT 'webpages', url FROM webpages),
t AS (SELECT table_name, count(*) AS n_rows FROM u GROUP BY ALL),
c AS (SELECT table_name, url, count(*) AS n FROM u WHERE url IS NOT NULL GROUP BY ALL)
SELECT {cols} FROM c JOIN t USING (table_name) WHERE n * 1000 >= n_rows * 5 AND n >= 5"""


def _frequent_urls(spark: SparkSession, d: str) -> DataFrame:
    parts = [frequent.frequent_values(table(spark, d, t), "url").select(F.lit(t).alias("table_name"), F.col("value").alias("url"), "n", "n_rows", "max_error") for t in ("cloudfront", "webpages")]
    return parts[0].unionByName(parts[1])


@catalog.query(_FREQUENT.format(cols="table_name, url"))
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequent_urls(spark, d).select("table_name", "url")


@catalog.query(_FREQUENT.format(cols="table_name, url, n, n_rows, CAST(0 AS BIGINT) AS max_error"))
def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return _frequent_urls(spark, d)


# ---------------------------------------------------------------- 8: tokenizer


@catalog.query()
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(table(spark, d, "documents"))


@catalog.query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, md5(coalesce(text, '')) AS md5 FROM documents")
def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every text encoded and decoded again: its length in bytes and its MD5."""
    back = tokenize.decoded(tokenize.token_ids(table(spark, d, "documents")))
    return back.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("md5"))


# ---------------------------------------------------------------- 9: test passages in training text


@catalog.query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).distinct()


@catalog.query()
def p9_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents carry each leaked item, and the longest stretch of it."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), details=True)
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("item_words").alias("longest_words"))


# ---------------------------------------------------------------- 10: text quality


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return quality.classify(quality.statistics(docs), quality.learn(docs, table(spark, d, "doc_labels")))


@catalog.query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d).where(F.col("kind").isin(*quality.KINDS)).select("doc_id")


@catalog.query()
def p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d).select("doc_id", "kind", *[F.round(c, 6).alias(c) for c in quality.RATIOS])


_BLANKS = r"\s\pZ\x0b\x1c-\x1f\x{85}"
_STATS = rf"""
WITH e AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '\r\n|\n|\r'), lambda x: regexp_matches(x, '[^{_BLANKS}]')) AS lines,
 regexp_extract_all(lower(t), '[\pL\pN]+') AS words, len(regexp_extract_all(t, '[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}\x{{f900}}-\x{{faff}}]')) AS east,
 len(regexp_extract_all(t, '\pL')) AS letters, len(regexp_extract_all(t, '\pN')) AS digits, len(regexp_extract_all(t, '[^{_BLANKS}]')) AS filled,
 len(regexp_extract_all(t, '[^\pL\pN{_BLANKS}.,!?;:''"’“”()…。、！？«»¿¡–-]')) AS symbols FROM e),
n AS (SELECT *, len(words) + east // 2 AS n_words, len(list_filter(words, lambda x: x IN ({", ".join(f"'{w}'" for w in sorted(set(quality.COMMON_WORDS)))}))) AS common,
 len(list_filter(lines, lambda x: regexp_matches(x, '[.!?。！？…]["”’»)\]]*[{_BLANKS}]*$'))) AS ended FROM c)
SELECT doc_id, len(lines) = 0 AS blank, CASE WHEN len(lines) = 0 THEN 0 ELSE CAST(n_words AS BIGINT) END AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
 CAST(CASE WHEN len(lines) = 0 THEN 0 ELSE round((letters + digits) / greatest(n_words, 1), 9) END AS DOUBLE) AS mean_word_length,
 CAST(CASE WHEN len(lines) = 0 THEN 0 ELSE round(symbols / greatest(filled, 1), 9) END AS DOUBLE) AS symbol_ratio,
 CAST(CASE WHEN len(lines) = 0 THEN 0 ELSE round(ended / greatest(len(lines), 1), 9) END AS DOUBLE) AS ended_share,
 CAST(CASE WHEN len(lines) = 0 THEN 0 ELSE round(common / greatest(n_words, 1), 9) END AS DOUBLE) AS common_share FROM n
"""


@catalog.query(_STATS)
def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics that the problem names, of every document."""
    s = quality.statistics(table(spark, d, "documents"))
    return s.select("doc_id", "blank", "n_words", "n_lines", *[F.round(c, 9).alias(c) for c in ("mean_word_length", "symbol_ratio", "ended_share", "common_share")])


# ---------------------------------------------------------------- 5: wrong charsets


@catalog.query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "webpages")
    return encoding.garbled(pages, encoding.train(pages))


@catalog.query()
def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    """The pages concerned, with their text restored where it can be, and how many pieces of it were."""
    pages = table(spark, d, "webpages")
    return encoding.garbled(pages, encoding.train(pages), restored=True)


# ---------------------------------------------------------------- 7: main body of pages


@catalog.query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_body(table(spark, d, "webpages"))


@catalog.query()
def p7_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of each main line, without its tags."""
    return boilerplate.main_body(table(spark, d, "webpages"), with_text=True)
