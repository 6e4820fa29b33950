"""Whole jobs: mask one log file, a directory, or a batch of files and folders.

A job is one Spark job over all its files, however many and however large:
read, mask, write to staging, move into place. Its salt must be kept when
tokens are to match those of another job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from maskloom.config import MASKED_SUFFIX, SALT_REDACTION_REGEX, TREE_EXTENSIONS, MaskConfig
from maskloom.operators.masking import masked_line
from maskloom.sinks.log_files import Staging, check_target, commit, staging_folder, write_staged
from maskloom.sinks.output_names import plan_output_names
from maskloom.sources import store
from maskloom.sources.log_files import (entries, name_of, numbered_ranges, open_log_dir, open_log_tree, open_logs,
                                        read_rows)
from maskloom.sources.paths import kept, literal, path_kind, qualified

_SHOWN_FAILURES = 10
#: Where rows about files that can't be read are staged; keys of logs are hashes.
_UNREAD = "unread"


@dataclass(frozen=True)
class JobResult:
    """What a job did. Counts come with the write, of all lines that could be read; no line is masked twice."""

    n_files: int = 0
    n_lines: int = 0
    n_changed: int = 0
    n_chars: int = 0
    failures: list[tuple[str, str]] = field(default_factory=list)

    def summary(self) -> str:
        """One line, then at most ten failures."""
        if not self.failures:
            return f"{self.n_files} files masked"
        shown = [f"{name}: {message}" for name, message in self.failures[:_SHOWN_FAILURES]]
        more = ["..."] if len(self.failures) > _SHOWN_FAILURES else []
        head = f"{self.n_files} files masked, {len(self.failures)} failed"
        return "\n".join([head, *shown, *more])


def hide_salts(spark: SparkSession) -> None:
    """Have plans and the UI show generated salts as redacted."""
    if spark.conf.get("spark.sql.redaction.string.regex", None) is None:
        spark.conf.set("spark.sql.redaction.string.regex", SALT_REDACTION_REGEX)


class MaskingFailed(OSError):
    """Some logs of a job failed. `failures` has (name, message) of each, `result` what was done."""

    def __init__(self, result: JobResult):
        self.result, self.failures = result, result.failures
        super().__init__(result.summary())


def _log_key(source_path: Column) -> Column:
    return F.md5(source_path)


def _mask_and_stage(files: DataFrame, staging: Staging, cfg: MaskConfig) -> dict:
    """Mask and stage all files (with `log_key`, `part_no` by range) in one job, whatever can't be read; its counts.

    A range that can't be read becomes a row of the log _UNREAD.
    """
    rows = read_rows(numbered_ranges(files), "log_key", "part_path", "part_no")
    problem = F.col("problem").isNotNull()
    told = F.to_json(F.struct("log_key", "part_path", "problem"))
    masked = rows.select(
        F.when(problem, _UNREAD).otherwise(F.col("log_key")).alias("log_key"), "part_no", "line_id",
        F.when(problem, told).otherwise(masked_line("value", cfg)).alias("value"), F.col("value").alias("before"))
    seen = Observation()
    write_staged(masked.observe(
        seen, F.count("before").alias("n_lines"),
        F.count_if(F.col("before") != F.col("value")).alias("n_changed"),
        F.sum(F.length("before").cast("long")).alias("n_chars")), staging)
    return {name: int(value or 0) for name, value in seen.get.items()}


UNREAD = "log_key string, part_path string, problem string"


def _unread(spark: SparkSession, files: DataFrame, staging: Staging) -> DataFrame:
    """(log_key, part_path, problem) of each file that could not be listed or read, one row per log."""
    listed = files.where("problem IS NOT NULL").select("log_key", "part_path", "problem")
    folder = f"{staging.lines}/log_key={_UNREAD}"
    if store.look(folder).kind == "folder":
        rows = spark.read.option("recursiveFileLookup", "true").text(literal(folder))
        listed = listed.unionAll(rows.select(F.from_json("value", UNREAD).alias("row")).select("row.*"))
    return listed.groupBy("log_key").agg(F.min(F.struct("part_path", "problem")).alias("row")).select("log_key", "row.*")


def _failures(rows: DataFrame) -> list[tuple[str, str]]:
    """(name, message) of the logs that failed, in order."""
    return [(row["name"], row["problem"]) for row in rows.select("name", "problem").orderBy("name", "problem").collect()]


def _run(files: DataFrame, plan: DataFrame, staging: Staging, cfg: MaskConfig) -> JobResult:
    """Mask the logs of a plan (log_key, name, target, problem) and publish those that nothing is wrong with.

    One job reads and masks; what it can't read costs the log it belongs to and nothing else. Any other error, of
    writing or computing, ends the job at once.
    """
    spark = files.sparkSession
    chosen = files.join(plan.where("problem IS NULL").select("log_key"), "log_key", "left_semi")
    counts = _mask_and_stage(chosen, staging, cfg)
    unread = kept(_unread(spark, chosen, staging), staging.path)
    journal = plan.where("problem IS NULL").join(unread, "log_key", "left_anti")
    n_files, unpublished = commit(staging, journal, cfg.overwrite)
    staging.keep = bool(unpublished)
    problems = plan.where("problem IS NOT NULL").select("name", "problem").unionAll(
        plan.drop("problem").join(unread, "log_key").select("name", "problem"))
    return JobResult(n_files=n_files, failures=_failures(problems) + unpublished, **counts)


def _finished(result: JobResult) -> JobResult:
    if result.failures:
        raise MaskingFailed(result)
    return result


def mask_log_file(spark: SparkSession, source: str, target: str, cfg: MaskConfig) -> JobResult:
    """Mask one log, a file or a folder of parts, into the folder `target`; in place if both are the same path."""
    if path_kind(spark, source) not in ("file", "parts"):
        raise FileNotFoundError(f"no such file: {source}")
    check_target(spark, source, target, cfg.overwrite)
    hide_salts(spark)
    url = qualified(spark, source).rstrip("/")
    with staging_folder(spark, target) as staging:
        files = open_logs(spark, source, scratch=staging.path).files.withColumns(
            {"source_path": F.lit(url), "log_key": _log_key(F.lit(url))})
        plan = spark.createDataFrame([(url, url.rpartition("/")[2], qualified(spark, target).rstrip("/"))],
                                     "source_path string, name string, target string")
        plan = plan.select(_log_key(F.col("source_path")).alias("log_key"), "name", "target",
                           F.lit(None).cast("string").alias("problem"))
        return _finished(_run(files, plan, staging, cfg))


def output_folder(folder: str) -> str:
    """Where a folder's outputs go when no place is named."""
    return folder.rstrip("/") + MASKED_SUFFIX


def _names_in(spark: SparkSession, folders: DataFrame) -> DataFrame:
    """(path, name) of everything that stands in the folders `path`; a missing folder is empty."""
    return entries(folders).where("problem IS NULL").select("path", name_of(F.col("path")).alias("name"))


def mask_log_dir(spark: SparkSession, source: str, target: str | None, cfg: MaskConfig) -> JobResult:
    """Mask the log files right in a directory into the directory `target`.

    Without a target, outputs go to a folder named after the source.

    An output whose name is taken gets a free one, or replaces the old file when
    the configuration says so.
    """
    if path_kind(spark, source) not in ("directory", "parts"):
        raise NotADirectoryError(f"no such directory: {source}")
    target = target or output_folder(source)
    hide_salts(spark)
    folder = qualified(spark, target).rstrip("/")
    with staging_folder(spark, f"{folder}/_") as staging:
        # Written down before any output exists: the plan must not see its own results.
        existing = kept(_names_in(spark, spark.createDataFrame([(folder,)], "path string")), staging.path)
        files = open_log_dir(spark, source, cfg, staging.path).files.withColumn("log_key", _log_key(F.col("source_path")))
        names = plan_output_names(files.select(F.col("source_file").alias("name")), existing.select("name"), cfg.overwrite)
        logs = files.groupBy("log_key").agg(F.min("source_file").alias("name"))
        plan = kept(logs.join(names, "name").select("log_key", "name", F.concat(F.lit(folder + "/"), "output_name").alias("target"),
                                                    F.lit(None).cast("string").alias("problem")), staging.path)
        result = _run(files, plan, staging, cfg)
        store.make_folder(folder)
    return _finished(result)


def mask_logs(spark: SparkSession, source: str, target: str, cfg: MaskConfig) -> JobResult:
    """Mask a file or a directory, whichever `source` is."""
    kind = path_kind(spark, source)
    if kind is None:
        raise FileNotFoundError(f"no such path: {source}")
    run = mask_log_dir if kind == "directory" else mask_log_file
    return run(spark, source, target, cfg)


def batch_target(path: Column, target_dir: str | None, overwrite: bool) -> Column:
    """Where a batch writes one file: `x_sanitized.ext`, or `x.ext` to overwrite."""
    name, parent = name_of(path), F.regexp_extract(path, r"(?s)\A(.*)/", 1)
    if not overwrite:
        stem, extension = F.regexp_extract(name, r"(?s)\A(.*?)(\.[^.]*)?\z", 1), F.regexp_extract(name, r"(?s)(\.[^.]+)\z", 1)
        name = F.concat(stem, F.lit(MASKED_SUFFIX), extension)
    return F.concat_ws("/", F.lit(target_dir.rstrip("/")) if target_dir else parent, name)


def _plan_batch(files: DataFrame, target_dir: str | None, overwrite: bool, scratch: str) -> DataFrame:
    """(log_key, name, target, problem) of each log; a log whose target is taken, or another's, has a problem."""
    logs = files.groupBy("log_key").agg(F.min("source_file").alias("name"), F.min("source_path").alias("path"))
    logs = logs.withColumn("target", batch_target(F.col("path"), target_dir, overwrite))
    logs = logs.withColumn("first", F.row_number().over(Window.partitionBy("target").orderBy("path")) == 1)
    free = F.col("first")
    if not overwrite:
        parents = logs.select(F.regexp_extract("target", r"(?s)\A(.*)/", 1).alias("path")).distinct()
        taken = kept(_names_in(files.sparkSession, parents), scratch).select(F.col("path").alias("target"), F.lit(True).alias("taken"))
        logs = logs.join(taken, "target", "left")
        free = free & F.col("taken").isNull()
    return kept(logs.select("log_key", "name", "target", F.when(~free, F.concat(F.lit("output exists already: "), "target"))
                            .alias("problem")), scratch)


def mask_log_batch(spark: SparkSession, paths: Sequence[str], target_dir: str | None,
                   cfg: MaskConfig, extensions: Sequence[str] = TREE_EXTENSIONS) -> JobResult:
    """Mask logs and whole folder trees; a log that fails does not stop the rest.

    One Spark job reads and masks all logs, whichever of them can't be read.
    """
    hide_salts(spark)
    target_dir = qualified(spark, target_dir) if target_dir else None
    kinds = {path: path_kind(spark, path) for path in dict.fromkeys(paths)}
    given = [path if kind == "file" else f"{path.rstrip('/')}/_" for path, kind in kinds.items() if kind]
    if not given:
        raise FileNotFoundError("none of the given paths exists")
    beside = f"{target_dir.rstrip('/')}/_" if target_dir else given[0]
    with staging_folder(spark, beside) as staging:
        files = open_log_tree(spark, paths, extensions, staging.path).files.withColumn("log_key", _log_key(F.col("source_path")))
        return _run(files, _plan_batch(files, target_dir, cfg.overwrite, staging.path), staging, cfg)
