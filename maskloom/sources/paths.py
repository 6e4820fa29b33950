"""Small questions about paths, and the folder for work between jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from maskloom.sources import store


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    return hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a full URL, its characters as they stand."""
    return file_system(spark, path).makeQualified(hadoop_path(spark, path)).toString()


def literal(path: str) -> str:
    """The path for Spark's readers, which take `[ ] { } * ?` and backslashes for a glob, as it stands."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def path_kind(spark: SparkSession, path: str) -> str | None:
    """"file", "directory", "parts" for a log written in parts, or None when there is nothing."""
    url = qualified(spark, path)
    kind = store.look(url).kind
    if kind != "folder":
        return None if kind == "none" else "file"
    names = [entry.url.rpartition("/")[2] for entry in store.children(url)]
    names = [name for name in names if not (name.endswith(".crc") or name == "_SUCCESS")]
    return "parts" if names and all(is_part(name) for name in names) else "directory"


def is_part(name: str) -> bool:
    return re.match(r"part-\d{5,}", name) is not None


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir or, in local mode, of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="maskloom-")
    folder = f"{base.rstrip('/')}/maskloom-{uuid.uuid4().hex}"
    path = hadoop_path(spark, folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def kept(df: DataFrame, scratch: str | None = None) -> DataFrame:
    """df written and read again, so that what it tells of is looked at once. scratch: a shared folder of the caller."""
    folder = f"{scratch or scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(literal(folder))
