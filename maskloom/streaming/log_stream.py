"""Masking of streams.

A token depends on its value and the salt only, so masking keeps no state: the
same expressions run on a stream in append mode, and a restart from the
checkpoint writes the tokens the first run would have.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from maskloom.config import MaskConfig
from maskloom.operators.masking import masked_line
from maskloom.plans.jobs import hide_salts
from maskloom.sources.log_files import clean_extensions
from maskloom.sources.log_source import FORMAT, LogSource
from maskloom.sources.paths import qualified


def read_log_stream(spark: SparkSession, directory: str, cfg: MaskConfig, state: str | None = None,
                    max_files: int | None = None) -> DataFrame:
    """Lines of the logs in a directory, and of those that arrive later or grow.

    Names are taken as they stand. `state` is a folder of the stream's own, kept from run to run, that holds what has
    been read of which log; it defaults to one below spark.checkpoint.dir. `max_files`
    bounds what one trigger takes up; a run that handles what is there and stops has one trigger.
    """
    spark.dataSource.register(LogSource)
    reader = spark.readStream.format(FORMAT).option("extensions", json.dumps(clean_extensions(cfg.extensions)))
    if max_files is not None:
        reader = reader.option("max_files", max_files)
    state = state or checkpoint_folder(spark, "log-files")
    return (reader.option("state", qualified(spark, state)).load(qualified(spark, directory))
            .select(F.make_valid_utf8(F.col("value").cast("string")).alias("value"), "source_file"))


def mask_stream(stream: DataFrame, column: str, cfg: MaskConfig) -> DataFrame:
    """A text stream of any source with one column masked."""
    return stream.withColumn(column, masked_line(column, cfg))


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """A checkpoint folder of this name in the shared folder the session names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("name a checkpoint folder, or set spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{name}"


def write_log_stream(masked: DataFrame, target: str, checkpoint: str | None = None,
                     name: str = "masked-logs", **trigger) -> StreamingQuery:
    """Append masked lines below `target`, one subfolder per source file.

    `checkpoint` defaults to a folder called `name` below spark.checkpoint.dir.
    `trigger` is passed on; the default handles what is there and stops.
    """
    spark = masked.sparkSession
    hide_salts(spark)
    return (masked.writeStream.format("text").outputMode("append").partitionBy("source_file")
            .option("path", target)
            .option("checkpointLocation", checkpoint or checkpoint_folder(spark, name))
            .trigger(**(trigger or {"availableNow": True})).start())


def mask_log_stream(spark: SparkSession, directory: str, target: str, cfg: MaskConfig,
                    checkpoint: str | None = None, max_files: int | None = None,
                    **trigger) -> StreamingQuery:
    """Mask the logs of a directory, and those that arrive later, into `target`.

    What has been read of which log is kept inside the checkpoint folder. `max_files` is for triggers that come
    again; without one, all that is there is handled.
    """
    checkpoint = checkpoint or checkpoint_folder(spark, "masked-logs")
    lines = read_log_stream(spark, directory, cfg, f"{checkpoint.rstrip('/')}/log-files", max_files if trigger else None)
    return write_log_stream(mask_stream(lines, "value", cfg), target, checkpoint, **trigger)
