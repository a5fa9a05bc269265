"""Sessions, and SQL with bound parameters."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine relies on; what the cluster sets otherwise stays."""
    b = SparkSession.builder.appName("corpusmill")
    b = b.master(master) if master else b
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return b.config(map=base | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, a folder that all executors share. Where it is missing a temporary folder serves a local session, as in
    tests; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp("checkpoints")
    return folder


def settled(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read from there: what ranges or numbers its rows have can't change when a task runs
    again."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def sql(spark: SparkSession, sf_dir: str, text: str, **args) -> DataFrame:
    """Runs text, in which {name} is a table of sf_dir and :name a bound value. Errors are raised."""
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, args=args, **frames) if frames else spark.sql(text, args=args)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
