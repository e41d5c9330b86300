"""Session helpers: shared scratch folder, lineage cuts, table access."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder of this application in the one all executors share, which the session names in ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests) is a folder of this machine used instead; on a cluster
    that would lose data, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="marginalia-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/marginalia-{spark.sparkContext.applicationId}"


#: Lets Spark delete the shuffles of a query when it ends (a setting of Spark).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: a lineage cut that survives lost executors.

    Once the table is written nothing needs the shuffles that made it, so they are deleted at once."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` that nothing will read again."""
    path = getattr(df, "_scratch_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    with contextlib.suppress(Exception):
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hpath, True)


def sweep(spark: SparkSession) -> None:
    """Delete all tables this application has written to the shared folder. Results that read them must have been used."""
    with contextlib.suppress(Exception):
        root = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
        root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
