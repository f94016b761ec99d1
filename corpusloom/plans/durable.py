"""Tables written between stages.

A written table in a folder that all executors share cuts the lineage and survives the loss of an
executor.  The folder is the session's spark.checkpoint.dir; only where that is unset, as in tests on
one machine, a folder of our own is made.

All tables of a session stand in one folder below it.  A table that is not read again is deleted by discard;
the folder goes when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of each Spark application's tables.
_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", "file://" + own)
    return "file://" + own


def _at(spark: SparkSession, path: str) -> tuple:
    """(file system, path) in the JVM's terms."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _folder(spark: SparkSession) -> str:
    app = f"{spark.sparkContext.applicationId} {shared_dir(spark)}"
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}"
        fs, where = _at(spark, _FOLDERS[app])
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return _FOLDERS[app]


def keep(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it from there."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by keep; no DataFrame that is still to run may read them."""
    for t in tables:
        if path := getattr(t, "kept_at", None):
            fs, where = _at(t.sparkSession, path)
            fs.delete(where, True)


def join_skewed(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, share: int = 1000) -> DataFrame:
    """Inner join of rows with keyed, in which `on` is unique and `weight` counts the matching rows of each key.

    A key that holds 1/share of all matching rows or more is hot.  There are at most `share` such keys, so
    they are broadcast, and their rows are not shuffled; the other keys are joined by a shuffle.  keyed is a
    written table, as it is read three times.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * F.lit(share) >= F.lit(total)
    found = keyed.where(is_hot)
    if found.isEmpty():
        return rows.join(keyed.drop(weight), on)
    hot = F.broadcast(found.limit(share).drop(weight))
    cold = keyed.where(~is_hot).drop(weight)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))
