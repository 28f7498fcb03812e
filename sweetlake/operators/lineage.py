"""Cutting the lineage of iterative jobs in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.

    Where the session names none, a temporary folder is set on a master of one machine (as in tests); on a
    cluster that would be a folder that other machines do not see, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sweetlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Folders that this process has written, by session.
WRITTEN: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: lineage ends, lost executors cost nothing, and sizes are known."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder: lighter than a written table where there are many small ones."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this session has written in the shared folder, at the end of a job when its results are stored elsewhere."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in WRITTEN.pop(spark.sparkContext.applicationId, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def followed(start: DataFrame, jump: DataFrame, by: list[str]) -> DataFrame:
    """start and all that following `jump` from it reaches, with the number of steps.

    start: by.., id, at, step (0); jump: by.., at, next, one row per place.  Jumps double each round, so rounds
    grow with the logarithm of the longest path.  A path that comes back to where it was is an error.
    Tables are written and joined by sorting: no side goes through the driver, however small it seems."""
    every = written(start, "paths")
    jump = written(jump.where("at is not null and next is not null").distinct(), "jump")
    places, stride = jump.count(), 1
    while not jump.isEmpty():
        if stride > places:
            raise ValueError("parents form a cycle")
        far = every.join(jump.hint("merge"), [*by, "at"]).select(*by, "id", F.col("next").alias("at"), (F.col("step") + stride).alias("step"))
        every = written(every.unionByName(far), "paths")
        then = jump.select(*by, F.col("at").alias("next"), F.col("next").alias("then"))
        jump = written(jump.join(then.hint("merge"), [*by, "next"]).select(*by, "at", F.col("then").alias("next")), "jump")
        stride *= 2
    return every
