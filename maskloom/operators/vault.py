"""A token vault that grows from run to run.

The vault is a table in buckets of (token, value). A run brings only the tokens it has found into these buckets
and joins each with what is in its bucket already; the old vault is read where it lies and never shuffled.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from maskloom.operators.reports import token_vault
from maskloom.sources import store
from maskloom.sources.paths import literal, qualified

#: Buckets of a new vault: tasks of a merge. A vault keeps the number it was made with.
BUCKETS = 64
_KEY = ("token", "value")
_FOLDER = re.compile(r"in-(\d+)-buckets")


def _opened(spark: SparkSession, path: str, buckets: int) -> tuple[str, int]:
    """The vault below `path` as a table of this session, made if there is none; its name and its buckets."""
    url = qualified(spark, path).rstrip("/")
    if literal(url) != url:
        raise ValueError(f"Spark takes the folder of a table for a glob: {url}")
    found = [m for e in store.children(url) if (m := _FOLDER.fullmatch(e.url.rpartition("/")[2]))]
    n = int(found[0][1]) if found else buckets
    name = f"maskloom_vault_{hashlib.md5(url.encode()).hexdigest()}"
    place = f"{url}/in-{n}-buckets".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (prefix STRING, value STRING, token STRING) USING parquet "
              f"CLUSTERED BY ({', '.join(_KEY)}) SORTED BY ({', '.join(_KEY)}) INTO {n} BUCKETS LOCATION '{place}'")
    return name, n


def new_tokens(found: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The tokens of findings that the vault below `path` doesn't have, dealt to its buckets."""
    spark = found.sparkSession
    name, n = _opened(spark, path, buckets)
    # Equal tokens are one row per task before they are dealt out, so a token found everywhere is no burden. (An
    # anti join would be moved in front of that by the optimizer.)
    dealt = token_vault(found).repartition(n, *_KEY)
    old = spark.table(name).select(*_KEY, F.lit(True).alias("known")).hint("merge")
    return dealt.join(old, list(_KEY), "left").where(F.col("known").isNull()).select("prefix", "value", "token")


def merge_vault(found: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Add the tokens of findings to the vault below `path`; how many were new.

    A merge that was stopped has added nothing or, merged again, adds what is missing. One merge at a time may run on a
    vault. Holds raw values: keep the folder apart, and the salt the same, or equal values get a second token.
    """
    name, n = _opened(found.sparkSession, path, buckets)
    seen = Observation()
    (new_tokens(found, path, buckets).observe(seen, F.count("*").alias("n"))
     .write.mode("append").format("parquet").bucketBy(n, *_KEY).sortBy(*_KEY).saveAsTable(name))
    return seen.get["n"]


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """prefix, value and token of every token in the vault below `path`."""
    return spark.table(_opened(spark, path, BUCKETS)[0])
