"""Writing masked logs: one output per input, lines in their order, nothing lost when a job dies.

Masked lines are first written to a staging folder, by log and number of the byte range they come from; no shuffle
of lines is needed. Then a journal of (log, target) rows is written, and tasks move the
parts of each log to its final name, which touches names and no data. An output is a folder of parts in line
order, whatever its size; every job takes it as a log again.

All names of a move follow from the journal, and each step looks at what has been done: moving again goes
on where a lost task, or a lost driver, has stopped. `finish_interrupted` does that for earlier jobs.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.sources import store
from maskloom.sources.paths import file_system, hadoop_path, literal, path_kind, qualified

_DIGITS = 10
#: Logs that a task moves, on average.
_LOGS_PER_TASK = 64
_STAGING = re.compile(r"_staging-[0-9a-f]{32}")


@dataclass
class Staging:
    """A folder for a job's work. It is removed at the end unless `keep` is set: then outputs are still in it."""

    path: str
    keep: bool = False

    @property
    def lines(self) -> str:
        return f"{self.path}/lines"

    @property
    def journal(self) -> str:
        return f"{self.path}/journal"


@contextmanager
def staging_folder(spark: SparkSession, beside: str):
    """A new folder next to `beside`."""
    parent = qualified(spark, beside).rpartition("/")[0]
    finish_interrupted(spark, parent)
    staging = Staging(f"{parent}/_staging-{uuid.uuid4().hex}")
    try:
        yield staging
    finally:
        if not staging.keep:
            store.remove(staging.path)


def write_staged(lines: DataFrame, staging: Staging) -> None:
    """Write `value` by `log_key` and `part_no`, ordered by `line_id` within them."""
    (lines.sortWithinPartitions("log_key", "part_no", "line_id")
     .select("log_key", "part_no", "value")
     .write.mode("errorifexists").partitionBy("log_key", "part_no").text(staging.lines))


def same_path(spark: SparkSession, one: str, other: str) -> bool:
    """Whether two paths are equal, ignoring case."""
    def spell(path: str) -> str:
        return qualified(spark, path).rstrip("/").lower()

    return spell(one) == spell(other)


def check_target(spark: SparkSession, source: str, target: str, overwrite: bool) -> None:
    """Refuse to write over the source or an existing output, unless asked to."""
    if overwrite:
        return
    if same_path(spark, source, target):
        raise FileExistsError(f"input and output are the same path: {target}")
    if path_kind(spark, target) is not None:
        raise FileExistsError(f"output exists already: {target}")


def part_name(number: int, piece: int = 0) -> str:
    """A part file's name; names sort like their numbers. piece: where Spark was told to split what one task writes."""
    return f"part-{number:0{_DIGITS}d}" + (f"_{piece:05d}" if piece else "") + ".txt"


# --- Publishing ---------------------------------------------------------------------

def _gather(staged: str, fresh: str) -> None:
    """Move what is staged of a log to `fresh`, named by number. A log without lines becomes an empty part."""
    store.make_folder(fresh)
    for folder in store.children(staged):
        number = int(folder.url.rpartition("part_no=")[2])
        for part in (e.url for e in store.children(folder.url) if e.url.rpartition("/")[2].startswith("part-")):
            piece = re.search(r"\.c(\d+)\.txt\Z", part)
            store.move(part, f"{fresh}/{part_name(number, int(piece[1]) if piece else 0)}")
    if not any(e.url.rpartition("/")[2].startswith("part-") for e in store.children(fresh)):
        store.make_empty(f"{fresh}/{part_name(0)}")


def publish(run: str, log_key: str, staged: str, target: str, overwrite: bool) -> None:
    """Make what is staged of a log the folder `target`.

    Parts are gathered beside the target; a mark tells when all are there. What is replaced is then moved aside, its
    successor moved into place, and what was moved aside removed. Calling this again
    after a stop at any point goes on from there.
    """
    parent, _, name = target.rpartition("/")
    fresh, aside = (f"{parent}/_{word}-{run}-{log_key}" for word in ("new", "old"))
    whole = f"{staged}.gathered"

    def there(url: str) -> bool:
        return store.look(url).kind != "none"

    if not there(whole):
        if there(target) and not overwrite:
            raise FileExistsError(f"output exists already: {target}")
        store.make_folder(parent)
        _gather(staged, fresh)
        store.make_empty(whole)
    if there(fresh):
        if there(target) and not there(aside):
            if not overwrite:
                raise FileExistsError(f"output exists already: {target}")
            store.move(target, aside)
        try:
            store.move(fresh, target)
        except OSError:
            if there(aside) and not there(target):
                store.move(aside, target)
            raise
    if there(aside):
        store.remove(aside)
        # A checksum of a file that was replaced.
        store.remove(f"{parent}/.{name}.crc")


def publish_all(staging: Staging, journal: DataFrame, overwrite: bool) -> tuple[int, list[tuple[str, str]]]:
    """Publish the (log_key, target) rows, by tasks; the number published, and (name, message) of each that failed.

    The driver makes the same few calls however many logs and parts there are.
    """
    spark = journal.sparkSession
    run, lines = staging.path.rpartition("-")[2], staging.lines

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failures = []
            for key, target in zip(*(batch.column(c).to_pylist() for c in ("log_key", "target"))):
                try:
                    publish(run, key, f"{lines}/log_key={key}", target, overwrite)
                except OSError as error:
                    failures.append((target.rpartition("/")[2], str(error).split("\n", 1)[0]))
            yield pa.record_batch({"done": pa.array([batch.num_rows - len(failures)] + [0] * len(failures)),
                                   "name": pa.array([None] + [name for name, _ in failures], pa.string()),
                                   "message": pa.array([None] + [message for _, message in failures], pa.string())})

    n_logs = journal.count()
    done = f"{staging.path}/published"
    (journal.select("log_key", "target").repartition(-(-n_logs // _LOGS_PER_TASK) or 1)
     .mapInArrow(move, "done long, name string, message string").write.mode("overwrite").parquet(done))
    told = spark.read.schema("done long, name string, message string").parquet(literal(done))
    failures = [(row["name"], row["message"]) for row in told.where("name IS NOT NULL").orderBy("name").collect()]
    return told.agg(F.sum("done")).first()[0] or 0, failures


def commit(staging: Staging, journal: DataFrame, overwrite: bool) -> tuple[int, list[tuple[str, str]]]:
    """Write the (log_key, target) rows down, then publish them; see `publish_all`."""
    journal.select("log_key", "target", F.lit(overwrite).alias("overwrite")).write.parquet(staging.journal)
    spark = journal.sparkSession
    n, failures = publish_all(staging, spark.read.parquet(literal(staging.journal)), overwrite)
    if failures:
        store.make_empty(f"{staging.path}/_failed")
    return n, failures


def finish_interrupted(spark: SparkSession, parent: str) -> int:
    """Publish what jobs that were stopped while publishing have left below `parent`; how many logs there were.

    A staging folder without a whole journal has changed nothing outside of it, and is left alone: its job
    may still run. So is one of which some logs could not be published.
    """
    n = 0
    for entry in store.children(parent):
        staging = Staging(entry.url)
        if not _STAGING.fullmatch(entry.url.rpartition("/")[2]) or store.look(f"{entry.url}/_failed").kind != "none":
            continue
        if store.look(f"{staging.journal}/_SUCCESS").kind == "none":
            continue
        journal = spark.read.parquet(literal(staging.journal))
        row = journal.select("overwrite").first()
        done, failures = publish_all(staging, journal, bool(row and row["overwrite"]))
        n += done
        if failures:
            store.make_empty(f"{staging.path}/_failed")
        else:
            store.remove(staging.path)
    return n
