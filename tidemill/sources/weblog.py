"""Access logs of 26 tab-separated fields, gzipped or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a line, in order.
FIELDS = (
    "date time x_edge_location sc_bytes c_ip cs_method cs_host cs_uri_stem sc_status cs_referer cs_user_agent cs_uri_query cs_cookie x_edge_result_type x_edge_request_id x_host_header"
    " cs_protocol cs_bytes time_taken x_forwarded_for ssl_protocol ssl_cipher x_edge_response_result_type cs_protocol_version fle_status fle_encrypted_fields"
).split()


def parse_lines(lines: DataFrame, column: str = "value", *, errors: str = "raise") -> DataFrame:
    """Rows from lines. Blank lines, and lines whose first non-blank character is #, are none.

    A dash stands for null in optional fields, status 000 is null, the time taken is in whole milliseconds. ``errors``:
    "raise" fails on a line that hasn't 26 fields or whose numbers aren't any, "drop" leaves it out.
    """
    body = lines.where(F.col(column).rlike(r"^\s*[^\s#]")).select(F.split(F.regexp_replace(F.col(column), r"\r$", ""), "\t").alias("f"))
    if errors == "drop":
        body = body.where(F.size("f") == len(FIELDS))
    else:
        body = body.select(F.when(F.size("f") == len(FIELDS), F.col("f")).otherwise(F.raise_error(F.concat(F.lit("a log line has not 26 fields but "), F.size("f").cast("string")))).alias("f"))

    def raw(name: str) -> Column:
        return F.get("f", F.lit(FIELDS.index(name)))

    def opt(name: str) -> Column:
        return F.when(raw(name) != "-", raw(name))

    def number(name: str, kind: str) -> Column:
        return raw(name).cast(kind) if errors == "raise" else raw(name).try_cast(kind)

    url = F.concat(raw("cs_protocol"), F.lit("://"), raw("x_host_header"), raw("cs_uri_stem"), F.when(raw("cs_uri_query") != "-", F.concat(F.lit("?"), raw("cs_uri_query"))).otherwise(""))
    when = F.concat_ws(" ", raw("date"), raw("time"))
    both = (raw("ssl_protocol") == "-") & (raw("ssl_cipher") == "-")
    out = body.select(
        (when.cast("timestamp_ntz") if errors == "raise" else when.try_cast("timestamp_ntz")).alias("time"),
        raw("x_edge_location").alias("edge_location"),
        number("sc_bytes", "bigint").alias("response_bytes"),
        raw("c_ip").alias("remote_ip"),
        raw("cs_method").alias("method"),
        raw("cs_host").alias("host"),
        url.alias("url"),
        F.when(raw("sc_status") != "000", number("sc_status", "int")).alias("status"),
        opt("cs_user_agent").alias("user_agent"),
        opt("cs_referer").alias("referer"),
        opt("cs_cookie").alias("cookie"),
        raw("x_edge_result_type").alias("result_type"),
        raw("x_edge_request_id").alias("request_id"),
        number("cs_bytes", "bigint").alias("request_bytes"),
        F.round(number("time_taken", "double") * 1000).cast("bigint").alias("time_taken"),
        opt("x_forwarded_for").alias("forwarded_for"),
        F.when(~both, F.struct(raw("ssl_protocol").alias("protocol"), raw("ssl_cipher").alias("cipher"))).alias("ssl_protocol_cipher"),
        raw("x_edge_response_result_type").alias("response_result_type"),
        raw("cs_protocol_version").alias("http_version"),
        opt("fle_status").alias("fle_status"),
        opt("fle_encrypted_fields").alias("fle_encrypted_fields"),
    )
    return out if errors == "raise" else out.where(F.col("time").isNotNull() & F.col("response_bytes").isNotNull())


def read_weblog(spark: SparkSession, paths: str | list[str], *, errors: str = "raise") -> DataFrame:
    """The rows of log files; files named .gz are decompressed, several members included. A gzipped file is one task."""
    return parse_lines(spark.read.text(paths), errors=errors)
