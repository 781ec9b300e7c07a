"""Settings for object storage through Hadoop's s3a file system; paths are s3a://bucket/key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hadoop's public class names of credential providers.
_ANONYMOUS = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
_SIMPLE = "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider"
_ENVIRONMENT = "software.amazon.awssdk.auth.credentials.EnvironmentVariableCredentialsProvider"


@dataclass(frozen=True)
class Credentials:
    """Anonymous, from the environment, or a key and secret."""

    kind: str = "environment"
    key: str | None = None
    secret: str | None = field(default=None, repr=False)

    @classmethod
    def anonymous(cls) -> Credentials:
        return cls("anonymous")

    @classmethod
    def access_key(cls, key: str, secret: str) -> Credentials:
        return cls("key", key, secret)

    @classmethod
    def environment(cls) -> Credentials:
        return cls("environment")


def store_options(region: str | None = None, credentials: Credentials = Credentials(), *, retries: int = 10, endpoint: str | None = None) -> dict[str, str]:
    """Hadoop settings for a region and credentials; failed requests are repeated ``retries`` times."""
    out = {"fs.s3a.attempts.maximum": str(retries), "fs.s3a.aws.credentials.provider": {"anonymous": _ANONYMOUS, "key": _SIMPLE, "environment": _ENVIRONMENT}[credentials.kind]}
    if credentials.kind == "key":
        out |= {"fs.s3a.access.key": credentials.key or "", "fs.s3a.secret.key": credentials.secret or ""}
    if region:
        out["fs.s3a.endpoint.region"] = region
    if endpoint:
        out["fs.s3a.endpoint"] = endpoint
    return out


def use_store(spark: SparkSession, **how: object) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in store_options(**how).items():
        conf.set(k, v)


def store_path(bucket: str, key: str = "") -> str:
    if not bucket or "/" in bucket:
        raise ValueError("not a bucket's name")
    return f"s3a://{bucket}/{key.lstrip('/')}"


def list_objects(spark: SparkSession, path: str, *, pattern: str | None = None) -> DataFrame:
    """The objects below a bucket or directory, as listed, with the bytes stored under each: object_id, bucket, object_key,
    size_bytes, last_modified, etag (MD5 of the bytes), body.

    Any of Hadoop's file systems. The id is a hash of the full path, the key is the path below ``path``; ``pattern`` is a glob of
    the last part of the name. Columns that aren't asked for aren't read: without body and etag the bytes stay where they are.
    Objects without bytes aren't listed, as Spark passes over empty files; one of 2 GB or more can't be read as one value. Pack them with operators.archive.pack_objects.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    root = path.rstrip("/").split("://", 1)[-1].split(":", 1)[-1]
    bucket = path.split("://", 1)[1].split("/", 1)[0] if "://" in path and not path.startswith("file:") else ""
    full = F.col("path")
    below = F.expr(f"substring(path, instr(path, '{root.replace(chr(39), chr(39) * 2)}') + {len(root) + 1})")
    return files.select(F.xxhash64(full).alias("object_id"), F.lit(bucket).alias("bucket"), below.alias("object_key"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"), F.md5("content").alias("etag"), F.col("content").alias("body"))
