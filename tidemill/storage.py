"""Tables that are written between the stages of an operator.

They go to the folder that all executors share, which the cluster names in
``spark.checkpoint.dir``. Only where that is unset (a session on one machine)
is a folder made here. A written table cuts the lineage and survives the loss
of executors, unlike a local checkpoint.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, from the session's setting where there is one."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if known:
        return known.rstrip("/")
    app = sc.applicationId
    if app not in _own:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="tidemill-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, with the schema it had."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession | None = None) -> None:
    """Remove the intermediate tables written so far (those of one session, if given)."""
    keep = []
    for owner, path in _written:
        if spark is not None and owner is not spark:
            keep.append((owner, path))
            continue
        try:
            jvm, conf = owner._jvm, owner.sparkContext._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone
            pass
    _written[:] = keep


@atexit.register
def _clean() -> None:
    import shutil

    release()  # also what lies in a cluster's shared folder
    for app_dir in _own.values():
        shutil.rmtree(app_dir, ignore_errors=True)
