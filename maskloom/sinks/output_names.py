"""Names of output files that collide with nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from maskloom.config import MASKED_SUFFIX


def name_extension(name: Column) -> Column:
    """The extension with its dot, as written; empty when there is none."""
    return F.regexp_extract(name, r"(\.[^.]+)$", 1)


def name_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def suffixed_name(name: Column, number: Column | None = None) -> Column:
    """`x_sanitized.ext`, or `x_sanitized_<number>.ext` for numbers from 1."""
    suffix = F.lit(MASKED_SUFFIX)
    if number is not None:
        suffix = F.concat(suffix, F.when(number > 0, F.concat(F.lit("_"), number.cast("string")))
                          .otherwise(""))
    return F.concat(name_stem(name), suffix, name_extension(name))


def plan_output_names(sources: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """An output name for each source `name`, given the `name`s that exist.

    A name that is free, or may be overwritten, is used as it is. Otherwise the
    first free one of `x_sanitized.ext`, `x_sanitized_1.ext`, ... is.

    The first free number is 0, or one more than some taken number. So the only
    candidates are the successors of taken names. Sources, taken names and
    candidates meet in sums over tagged rows, by whole names: a key nothing piles
    up on, however many copies of one source there are.
    """
    if overwrite:
        return sources.select("name", F.col("name").alias("output_name")).distinct()
    tagged = sources.select("name", F.lit(1).alias("source"), F.lit(0).alias("exists")).unionAll(
        existing.select("name", F.lit(0), F.lit(1)))
    names = tagged.groupBy("name").agg(F.max("source").alias("source"), F.max("exists").alias("exists"))

    form = rf"(?s)\A(.*){MASKED_SUFFIX}(?:_([1-9][0-9]{{0,17}}))?(\.[^.]+)?\z"
    number = F.coalesce(F.expr("try_cast(nullif(regexp_extract(name, '" + form.replace("\\", "\\\\")
                               + "', 2), '') as bigint)"), F.lit(0))
    nothing = F.lit(None).cast("string")

    def row(name, stem, extension, k, taken):
        """A name as taken, or as a candidate with its family and number."""
        return F.struct(name.alias("candidate"), stem.alias("stem"), extension.alias("extension"),
                        k.cast("bigint").alias("k"), F.lit(taken).alias("taken"))

    def candidate(stem, extension, k):
        numbered = F.when(k > 0, F.concat(F.lit("_"), k.cast("string"))).otherwise("")
        return F.concat(stem, F.lit(MASKED_SUFFIX), numbered, extension)

    name = F.col("name")
    stem, extension = F.regexp_extract(name, form, 1), F.regexp_extract(name, form, 3)
    first = row(candidate(name_stem(name), name_extension(name), F.lit(0)), name_stem(name), name_extension(name),
                F.lit(0), False)
    rows = F.array(row(name, nothing, nothing, F.lit(None), True),
                   F.when(name.rlike(form), row(candidate(stem, extension, number + 1), stem, extension, number + 1, False)),
                   F.when((F.col("source") == 1) & (F.col("exists") == 1), first))
    free = (names.select(F.inline(F.array_compact(rows)))
            .groupBy("candidate").agg(F.max("taken").alias("taken"), F.collect_set(
                F.when(~F.col("taken"), F.struct("stem", "extension", "k"))).alias("families"))
            .where(~F.col("taken")).select(F.inline("families"))
            .groupBy("stem", "extension").agg(F.min("k").alias("k")))
    sources = names.where(F.col("source") == 1).select(
        "name", "exists", name_stem(name).alias("stem"), name_extension(name).alias("extension"))
    return (sources.join(free.hint("merge"), ["stem", "extension"], "left")
            .select("name", F.when(F.col("exists") == 1, suffixed_name(name, F.col("k"))).otherwise(name)
                    .alias("output_name")))
