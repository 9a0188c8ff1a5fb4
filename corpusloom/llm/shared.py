"""Tables in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only where that is unset and Spark runs in one
process (tests, a laptop) a temporary folder is made and set as the checkpoint folder; elsewhere that is an error, since
executors would not see it.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside pandas code, where a null would turn the whole column into floats.
NO_ID = -(1 << 63)


_HELD: dict[str, dict] = {}


def held(group: str, key, make):
    """``make()`` of ``key``, kept in this Python worker for later tasks.

    Spark hands a worker from one operator to the next, so their caches would add up: a worker that asks for something
    of a group lets go of all other groups.
    """
    if _HELD and group not in _HELD:
        _HELD.clear()
        gc.collect()
    kept = _HELD.setdefault(group, {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def whole_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def null_again(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, a lost executor costs no recomputation."""
    return _written(df, new_path(df.sparkSession, label))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Scratch:
    """Tables of one computation in a folder of their own, deleted together once nothing reads them any more."""

    def __init__(self, spark: SparkSession, label: str, inside: Scratch | None = None):
        self.spark, self.n = spark, 0
        self.folder = f"{inside.folder}/{label}-{uuid.uuid4().hex}" if inside else new_path(spark, label)

    def put(self, df: DataFrame, label: str) -> DataFrame:
        self.n += 1
        return _written(df, f"{self.folder}/{self.n}-{label}")

    def drop(self) -> None:
        fs, p = _store(self.spark, self.folder)
        fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _store(spark, path)
    return bool(fs.exists(p))


def committed(spark: SparkSession, root: str) -> list[str]:
    """Folders right below ``root`` whose job has finished: those with Spark's ``_SUCCESS`` marker, in order of name."""
    fs, p = _store(spark, f"{root}/*/_SUCCESS")
    return sorted(str(f.getPath().getParent().toString()) for f in fs.globStatus(p) or [])


def fresh(name: str, taken) -> str:
    """``name``, lengthened until it differs from all of ``taken``; Spark's names don't tell upper from lower case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
