"""Written intermediate tables for inputs that several branches read."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def stage_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; on a
    cluster the folder must be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="pairlens-stage-")
    return _OWN[app]


def scratch(spark: SparkSession) -> str:
    """A new path below the stage folder."""
    path = f"{stage_dir(spark)}/pairlens/{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, row_group: int | None = None, codec: str | None = None) -> DataFrame:
    """The same rows read back from a written table.

    The upstream plan then runs once however many branches follow, and a lost
    executor re-reads files instead of repeating it. ``row_group`` bounds the
    bytes of a row group, for rows that are large: a reader holds one at a time.
    ``codec`` is for tables that are large on disk. What this function returned
    is a written table already and comes back as it is.
    """
    # Not getattr: an unknown attribute of a frame is looked up among its columns.
    if "_staged" in vars(df):
        return df
    path = scratch(df.sparkSession)
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
    (writer if codec is None else writer.option("compression", codec)).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def release(spark: SparkSession) -> int:
    """Remove every table this application has staged; results that read them must be written before."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in made:
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(made)
