"""Rows that must not be computed twice, and tables of rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; a temporary one only where none is set and all runs on this machine (as in local tests)."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomspark-")
    sc.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, by columns, and read from there, so what depends on how its rows were dealt stays the same in every branch that reads it.

    Joins with it are sort-merge joins: as files its rows may take a fiftieth of what they take in a hash table, so Spark would take millions of them for small enough to pass through the driver.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
    out.__dict__["settled_at"] = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete tables made by `settled` that nothing will read again."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.__dict__["settled_at"])
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
