"""Reading logs: one file, the files of a directory, or whole folder trees.

Folders are listed by tasks, a round per level, and the files found stay a table; their byte ranges
are read by tasks, too. Every reader yields the same columns:

* `value`: the line, with bytes that are no UTF-8 replaced by U+FFFD,
* `source_file`: the name of the log, `source_path`: its URL, for telling logs apart,
* `part_path`: the URL of the file, `line_id`: ascending with the lines of a file.

A log is a file, or a folder `name.log` of the parts in which a job has written one. Names are taken as they
stand: no character makes a glob, and a leading `_` or `.` hides nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from maskloom.config import MASKED_LOG_ENDING, TREE_EXTENSIONS, MaskConfig
from maskloom.sources import store
from maskloom.sources.paths import kept, path_kind, qualified
from maskloom.sources.ranges import read_ranges


def clean_extensions(extensions: Sequence[str]) -> list[str]:
    return sorted({e.strip().lower() for e in extensions})


def extension_of(name: Column) -> Column:
    """The extension with its dot, in lower case; empty when there is none."""
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def has_extension(name: Column, extensions: Sequence[str]) -> Column:
    return extension_of(name).isin(*clean_extensions(extensions))


def is_masked_log(name: Column) -> Column:
    """Whether a file was written by an earlier run, and is to be skipped."""
    return F.endswith(F.lower(name), F.lit(MASKED_LOG_ENDING))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """The table with each `path` once."""
    return paths.dropDuplicates(["path"])


_PART = r"(?s)/part-\d{5,}[^/]*\z"
#: Folders of a running or stopped job, ours or Spark's, are no place for logs.
_WORK = r"\A(?:_(?:staging|new|old)-[0-9a-f]{32}.*|_temporary|_spark_metadata)\z"


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)\z", 1)


def _log_path(path: Column) -> Column:
    """The URL of the log that a file is, or is a part of."""
    parent = F.regexp_replace(path, _PART, "")
    return F.when(path.rlike(_PART) & (extension_of(name_of(parent)) != ""), parent).otherwise(path)


# --- Listing ------------------------------------------------------------------------

ENTRIES = "path string, kind string, size long, problem string"


def _listed(batches: Iterator[pa.RecordBatch], look: bool) -> Iterator[pa.RecordBatch]:
    """What stands in the folders `path`; with `look`, what stands at the paths themselves."""
    for batch in batches:
        for url in batch.column("path").to_pylist():
            try:
                found, problem = ([store.look(url)] if look else store.children(url)), None
            except OSError as error:
                found, problem = [store.Entry(url, "other", 0, 0)], str(error)
            yield pa.record_batch({"path": pa.array([e.url for e in found], pa.string()),
                                   "kind": pa.array([e.kind for e in found], pa.string()),
                                   "size": pa.array([e.size for e in found], pa.int64()),
                                   "problem": pa.array([problem] * len(found), pa.string())})


def entries(paths: DataFrame, look: bool = False) -> DataFrame:
    """The entries of the folders `path`, or of the paths themselves."""
    return paths.select("path").mapInArrow(lambda batches: _listed(batches, look), ENTRIES)


def _paths(spark: SparkSession, urls: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(url,) for url in urls], "path string")


def _below(folders: DataFrame, scratch: str | None, parts_only: Sequence[str] | None = None) -> DataFrame:
    """All files in and below the folders, each folder listed once, a round of tasks per level.

    parts_only: go one level down only, to folders with one of these extensions, for the parts in them.
    """
    level = kept(entries(folders), scratch)
    found = level.where(F.col("kind") != "folder")
    down = (F.col("kind") == "folder") & ~name_of(F.col("path")).rlike(_WORK)
    if parts_only is not None:
        inner = entries(level.where(down & has_extension(name_of(F.col("path")), parts_only)))
        return found.unionAll(kept(inner.where((F.col("kind") != "folder") & F.col("path").rlike(_PART)), scratch))
    while not level.where(down).isEmpty():
        level = kept(entries(level.where(down).repartition(_tasks(level))), scratch)
        found = found.unionAll(level.where(F.col("kind") != "folder"))
    return found


def _tasks(table: DataFrame) -> int:
    """Tasks for a round over names: listing waits more than it works."""
    spark = table.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _as_files(found: DataFrame) -> DataFrame:
    """The table of files of a set of entries. What is no file or can't be listed has a `problem`."""
    path = _log_path(F.col("path"))
    problem = F.coalesce("problem", F.when(F.col("kind") == "none", "no such file").when(F.col("kind") != "file", "not a file"))
    return found.select(name_of(path).alias("source_file"), path.alias("source_path"), F.col("path").alias("part_path"),
                        "size", problem.alias("problem"))


# --- Reading ------------------------------------------------------------------------

def _bytes_setting(spark: SparkSession, name: str, default: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, default))


def numbered_ranges(files: DataFrame) -> DataFrame:
    """The byte ranges of all files without a problem, each log's numbered in their order from 0 as `part_no`.

    A range has at most spark.sql.files.maxPartitionBytes.
    """
    most = F.lit(_bytes_setting(files.sparkSession, "spark.sql.files.maxPartitionBytes", "128m"))
    cut = files.where(F.col("problem").isNull() & (F.col("size") > 0)).withColumn(
        "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, most.cast("long"))))
    number = F.regexp_extract(name_of(F.col("part_path")), r"\Apart-(\d+)", 1).try_cast("decimal(38,0)")
    in_order = Window.partitionBy("source_path").orderBy(number, "part_path", "start")
    return (cut.withColumn("end", F.least(F.col("start") + most, "size"))
            .withColumn("part_no", (F.row_number().over(in_order) - 1).cast("long")))


def read_rows(ranges: DataFrame, *columns: str) -> DataFrame:
    """The lines of ranges: the columns, line_id, value; a range that can't be read has a `problem` in place of a value.

    Ranges are dealt to as many tasks as Spark would use for files of their sizes.
    """
    spark = ranges.sparkSession
    most = _bytes_setting(spark, "spark.sql.files.maxPartitionBytes", "128m")
    each = F.lit(_bytes_setting(spark, "spark.sql.files.openCostInBytes", "4m")) + F.col("end") - F.col("start")
    weight = ranges.agg(F.sum(each)).first()[0] or 0
    passed = ["part_path", *(c for c in columns if c != "part_path")]
    schema = ", ".join(f"{c} {ranges.schema[c].dataType.simpleString()}" for c in passed)
    chosen = ranges.select(*passed, "start", "end")
    rows = chosen.repartition(max(1, -(-weight // most))).mapInArrow(
        read_ranges, f"{schema}, line_id long, value binary, problem string")
    return rows.withColumn("value", F.make_valid_utf8(F.col("value").cast("string")))


@dataclass(frozen=True)
class LogSet:
    """Logs listed once: a row per file, with a `problem` where it can't be read."""

    files: DataFrame

    @property
    def lines(self) -> DataFrame:
        """All lines. A file that can't be read is an error."""
        failed = F.concat_ws(": ", "part_path", "problem")
        bad = self.files.where(F.col("problem").isNotNull()).select(F.raise_error(failed).cast("string").alias("value"),
                                                                     "source_file", "source_path", "part_path",
                                                                     F.lit(0).cast("long").alias("line_id"))
        rows = read_rows(numbered_ranges(self.files), "source_file", "source_path", "part_path")
        value = F.when(F.col("problem").isNotNull(), F.raise_error(failed)).otherwise(F.col("value"))
        return rows.select(value.alias("value"), "source_file", "source_path", "part_path", "line_id").unionAll(bad)


def open_logs(spark: SparkSession, *paths: str, scratch: str | None = None) -> LogSet:
    """The given logs, whatever their extension; of a folder, its parts."""
    given = kept(entries(_paths(spark, [qualified(spark, p) for p in paths]), look=True), scratch)
    parts = entries(given.where(F.col("kind") == "folder")).where(F.col("path").rlike(_PART) | F.col("problem").isNotNull())
    found = given.where(F.col("kind") != "folder").unionAll(parts)
    # Every folder that was named is a log, with or without an extension.
    files = _as_files(found)
    return LogSet(kept(files, scratch))


def read_log_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """The lines of the given logs, whatever their extension."""
    return open_logs(spark, *paths).lines


def list_log_files(spark: SparkSession, *paths: str) -> DataFrame:
    """The given logs as a table of files; nothing of their contents is read."""
    return open_logs(spark, *paths).files


def open_log_dir(spark: SparkSession, directory: str, cfg: MaskConfig, scratch: str | None = None) -> LogSet:
    """The logs right in a directory, earlier outputs left out. Folders below it are listed only where they are logs in parts."""
    found = _below(_paths(spark, [qualified(spark, directory)]), scratch, cfg.extensions)
    files = _as_files(found)
    name = F.col("source_file")
    return LogSet(kept(files.where((has_extension(name, cfg.extensions) & ~is_masked_log(name)) | _unlisted()), scratch))


def _unlisted() -> Column:
    """Whether a row stands for a folder that could not be listed."""
    return F.col("problem").isNotNull() & ~F.col("problem").isin("no such file", "not a file")


def read_log_dir(spark: SparkSession, directory: str, cfg: MaskConfig) -> DataFrame:
    """The lines of the logs right in a directory, earlier outputs left out."""
    return open_log_dir(spark, directory, cfg).lines


def list_log_dir(spark: SparkSession, directory: str, cfg: MaskConfig) -> DataFrame:
    """The files `read_log_dir` reads."""
    return open_log_dir(spark, directory, cfg).files


def tree_roots(spark: SparkSession, paths: Sequence[str],
               extensions: Sequence[str] = TREE_EXTENSIONS) -> tuple[list[str], list[str]]:
    """The given paths as (folders, files), without what another path covers.

    Works on the caller's list of paths only; folders are not listed here.
    """
    kinds = {path: path_kind(spark, path) for path in dict.fromkeys(paths)}
    urls = {path: qualified(spark, path).rstrip("/") for path, kind in kinds.items() if kind}
    folders = {urls[p]: p for p, kind in kinds.items() if kind in ("directory", "parts")}

    def inside_a_folder(url: str) -> bool:
        parents = url.split("/")
        return any("/".join(parents[:n]) in folders for n in range(1, len(parents)))

    tops = [p for url, p in folders.items() if not inside_a_folder(url)]
    files, seen = [], set()
    for path, kind in kinds.items():
        if kind != "file" or urls[path] in seen:
            continue
        seen.add(urls[path])
        dot = path.rsplit("/", 1)[-1].rfind(".")
        extension = path.rsplit("/", 1)[-1][dot:].lower() if dot >= 0 else ""
        if not (extension in clean_extensions(extensions) and inside_a_folder(urls[path])):
            files.append(path)
    return tops, files


def open_log_tree(spark: SparkSession, paths: Sequence[str], extensions: Sequence[str] = TREE_EXTENSIONS,
                  scratch: str | None = None) -> LogSet:
    """All logs in and below the given folders, and given files.

    Only folders are filtered by extension; paths that do not exist are ignored.
    """
    folders, files = tree_roots(spark, paths, extensions)
    if not folders and not files:
        raise FileNotFoundError("none of the given paths exists")
    found = entries(_paths(spark, [qualified(spark, p) for p in files]), look=True)
    if folders:
        below = _below(_paths(spark, [qualified(spark, p) for p in folders]), scratch)
        listed = _as_files(below)
        wanted = listed.where(has_extension(F.col("source_file"), extensions) | _unlisted())
        return LogSet(kept(_as_files(found).unionAll(wanted), scratch))
    return LogSet(kept(_as_files(found), scratch))


def read_log_tree(spark: SparkSession, paths: Sequence[str],
                  extensions: Sequence[str] = TREE_EXTENSIONS) -> DataFrame:
    """The lines of all logs in and below the given folders, and of given files."""
    return open_log_tree(spark, paths, extensions).lines


def list_log_tree(spark: SparkSession, paths: Sequence[str],
                  extensions: Sequence[str] = TREE_EXTENSIONS) -> DataFrame:
    """The files `read_log_tree` reads."""
    return open_log_tree(spark, paths, extensions).files
