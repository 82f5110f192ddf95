"""Tables in the folder that all executors share.

Every table has a folder of its own, so repeated and concurrent runs do not meet; an empty frame gives an empty table of the same columns.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset and all runs on this machine (as in local tests) a temporary folder, set for the context."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        now = sc._jsc.sc().getCheckpointDir()
        if now.isDefined():
            return now.get()
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomspark-")
        sc.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/loomspark-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, schema: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and survives a lost executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["shared_path"] = path
    return out


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def removed(*tables: DataFrame) -> None:
    """Delete tables made by `written` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["shared_path"])
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches between the JVM and Python hold fewer rows than the session's default: whole texts are long, and both sides hold a batch in memory.
    A session that asks for fewer keeps its own number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
