"""Shared scratch tables: lineage is cut by a written table, never by a local checkpoint."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []
_BASES: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`); only local sessions may fall back to a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="skein-"))
    return _LOCAL_ROOT[0]


class Scratch:
    """Tables of one job in the shared folder. `drop` removes a table that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/skein-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        _BASES.append(self.base)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(saved)] = path
        return saved

    def drop(self, df: DataFrame | None) -> None:
        if df is not None and id(df) in self._paths:
            _delete(self.spark, self._paths.pop(id(df)))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Deletes the scratch tables of all jobs so far. To be called when their results have been read or written, as results
    are read from these tables."""
    while _BASES:
        _delete(spark, _BASES.pop())


def bounded(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; reads no more than needed to tell."""
    return df.limit(max_rows + 1).count() <= max_rows


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_index(ts) -> "F.Column":
    """Calendar month in UTC as a running number. Timestamps are shown in the session's zone, so it is undone first."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return (F.year(utc) * 12 + F.month(utc) - 1).cast("int")
