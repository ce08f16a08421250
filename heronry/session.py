"""Spark session settings shared by tests, the bench and local use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session: UTC, adaptive plans, no UI."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("heronry")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path goes to Spark's reader untouched."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors see; where that is unset, on one machine only
    (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='heronry-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def qualified(spark: SparkSession, path: str) -> str:
    """The path as its file system says it."""
    files, where = _place(spark, path)
    return str(files.makeQualified(where))


def listing(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(path, bytes, time) of the files of a table: what changes when it is written again."""
    files, where = _place(spark, path)
    found = [where] if not files.getFileStatus(where).isDirectory() else []
    out = [(str(s.getPath()), s.getLen(), s.getModificationTime()) for s in map(files.getFileStatus, found)]
    if not found:
        walk = files.listFiles(where, True)
        while walk.hasNext():
            s = walk.next()
            out.append((str(s.getPath()), s.getLen(), s.getModificationTime()))
    return tuple(sorted(out))


def forgotten_at_exit(spark: SparkSession, path: str) -> None:
    """Has the path's file system delete it when the driver's JVM ends; until then results may read it."""
    files, where = _place(spark, path)
    files.deleteOnExit(where)


def new_folder(spark: SparkSession, tag: str) -> str:
    """The path of a folder of its own in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    forgotten_at_exit(spark, path)
    return path


def written(df: DataFrame, tag: str, partitions: Sequence[str] = ()) -> DataFrame:
    """df written once as a Parquet table in the shared folder and read back: a cut in the lineage
    that survives the loss of executors. With partitions, a folder for each of their values."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(partitions) or None)
    forgotten_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    files, where = _place(spark, path)
    files.delete(where, True)


def forgotten(*frames: DataFrame) -> None:
    """Deletes tables that `written` made; nothing may read them any more."""
    for df in frames:
        files, where = _place(df.sparkSession, df._written_path)
        files.delete(where, True)


def settled(df: DataFrame, tag: str, *frames: DataFrame, partitions: Sequence[str] = ()) -> DataFrame:
    """df written, without the tables that it was made from."""
    out = written(df, tag, partitions)
    forgotten(*frames)
    return out
