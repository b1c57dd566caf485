"""Tables that cut lineage: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a local session without one gets a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/docloom-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Removes the shuffle files of an execution at its end, rather than when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back. The shuffle files behind it go at once: nothing reads them any more."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a new frame, since a frame takes the setting when it is made
    finally:
        spark.conf.set(_CLEANUP, before or "false")
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def drop_scratch() -> None:
    """Delete the scratch tables of this process; frames that still read them must not be used after."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone at exit
            return
