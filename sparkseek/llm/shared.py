"""Cutting lineage: checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of this machine, if that is all there is: a cluster must name one."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))
    return sc._jsc.sc().getCheckpointDir().get()


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds the rows of Arrow batches of this session, as texts are wide: a worker and its executor hold a few batches each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def hidden(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while (out := f"{name}_{uuid.uuid4().hex[:12]}") in taken:
        pass
    return out


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet into the shared folder and read again; compact where rows are wide."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_file(spark: SparkSession, content: bytes, name: str) -> str:
    """Puts a file into the shared folder and has Spark bring it to every executor; SparkFiles.get() of the name that
    is returned gives its path there."""
    name = f"{name}-{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/{name}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    out = fs.create(where)
    out.write(content)
    out.close()
    spark.sparkContext.addFile(fs.makeQualified(where).toString())
    return name
