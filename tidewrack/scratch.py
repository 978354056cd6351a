"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidewrack-")
    return _OWN[app]


def own_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, which goes when the application ends: results are lazy and may read it until then."""
    folder = f"{shared_dir(spark)}/tidewrack/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


#: Spark drops a query's shuffle files when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written in the shared folder: they cut lineage, survive lost executors and can be dropped one by one.

    The shuffle files of a table's making go once it is written.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, own_folder(spark, label)
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_KEPT: dict[tuple[str, ...], str] = {}


def kept(spark: SparkSession, label: str, source: str, write: Callable[[str], None]) -> str:
    """The folder of what `write` made of the files at `source`, written once in an application for each state of these files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    summary = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    listed = spark.read.parquet(source).inputFiles()
    key = (spark.sparkContext.applicationId, label, source, str(summary.getModificationTime()), str(hash(tuple(sorted(listed)))))
    if key not in _KEPT:
        folder = own_folder(spark, label)
        write(folder)
        _KEPT[key] = folder
    return _KEPT[key]
