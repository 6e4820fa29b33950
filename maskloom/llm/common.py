"""What the operators share: tables, shared scratch storage, words."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from bisect import bisect_left
from itertools import accumulate
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: white space of ASCII, or all of ASCII but digits and letters.
SPACES, NON_WORD = r"[\x20\x09-\x0D]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; null as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column, between: str = SPACES) -> Column:
    """The words of a text, A-Z lowered; no text has no words."""
    return F.filter(F.split(lower_ascii(text), between), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one made here where it is unset."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors.

    The files go when the session ends, or by `dropped`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = _folder(spark, path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    back = spark.read.schema(df.schema).parquet(path)
    _STORED[back] = path
    return back


_STORED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _folder(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def dropped(*tables: DataFrame) -> None:
    """Remove the files of stored tables that nothing reads any more: what came of them has been written."""
    for table in tables:
        folder = _folder(table.sparkSession, _STORED.pop(table))
        folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


Span = tuple[str, int, int]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def apart_from(spans: list[Span], others: list[Span]) -> list[Span]:
    """Those of spans that overlap none of others."""
    ends = sorted((s, e) for _, s, e in others)
    starts = [s for s, _ in ends]
    highest = list(accumulate((e for _, e in ends), max))
    free = []
    for span in spans:
        before = bisect_left(starts, span[2])
        if not before or highest[before - 1] <= span[1]:
            free.append(span)
    return free
