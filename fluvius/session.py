"""Session helpers: the folder that all executors share, tables written there, and cleaning of shuffle files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own is set only where the session has none and is local (tests). On a
    cluster a folder of the driver's machine is of no use to the executors, so a missing setting is an error there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="fluvius-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir() or named
    return named.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/fluvius-{tag}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")  # shuffle files of a table that is written are not needed again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by ``write_table`` that nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/fluvius-" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
