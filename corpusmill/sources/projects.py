"""Projects as folders of any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The project that is there when no other is.
DEFAULT = "myproject"


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, root: str) -> list[str]:
    fs, p = _at(spark, root)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []


def create(spark: SparkSession, root: str, name: str) -> bool:
    """False for a name that is blank or taken."""
    name = name.strip()
    fs, p = _at(spark, f"{root}/{name}")
    return bool(name) and not fs.exists(p) and fs.mkdirs(p)


def rename(spark: SparkSession, root: str, old: str, new: str) -> bool:
    """False if there is no such project, or the new name is blank or taken."""
    new = new.strip()
    fs, a = _at(spark, f"{root}/{old}")
    b = _at(spark, f"{root}/{new}")[1]
    return bool(old and new) and fs.exists(a) and not fs.exists(b) and fs.rename(a, b)


def delete(spark: SparkSession, root: str, name: str, confirmed: str) -> bool:
    """False if the name is not confirmed or there is no such project. The default project is made when none is left."""
    fs, p = _at(spark, f"{root}/{name}")
    if not name or name != confirmed or not fs.exists(p):
        return False
    fs.delete(p, True)
    if not listed(spark, root):
        create(spark, root, DEFAULT)
    return True
