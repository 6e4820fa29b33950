"""Tables about what was found and masked.

`findings` walks the chain of detectors once per row and keeps what every step
found, so one scan serves all detectors. Everything else aggregates its rows;
each aggregation combines on the map side first, so a value, token or source
that holds a third of all rows shuffles as one row per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from maskloom.config import MaskConfig
from maskloom.functions.matching import is_match, let, shield
from maskloom.functions.reuse import built_once
from maskloom.operators.detectors import Detector, Scrubber, active_detectors, any_needed
from maskloom.operators.json_lines import is_maskable, line_pieces
from maskloom.operators.masking import blocks_of, masked_line

_FOUND = "array<struct<type:string,pos:int,value:string,token:string>>"
_BRACKETS = r"\A\[|\]\z"
_TOKEN = r"\A\[(.+)-[0-9A-F]{6}\]\z"


def _entry(step: Detector, piece: Column, position: Column, cfg: MaskConfig) -> Column:
    """A piece of text after a detector, with what it found there or null."""
    hit = step.take_apart(piece)
    token = hit.token(cfg)
    found = F.struct(F.lit(step.type_name).alias("type"), F.shiftright(position, 1).alias("pos"),
                     hit.plain_value().alias("value"), token.alias("token"))
    is_hit = is_match(position) if hit.keep is None else is_match(position) & ~hit.keep
    return F.struct(F.when(is_hit, hit.replacement(token, cfg)).otherwise(piece).alias("text"),
                    F.when(is_hit, found).alias("found"))


def _observe(step: Detector | Scrubber, cfg: MaskConfig, mask: bool) -> Callable[[Column], Column]:
    def run(state: Column) -> Column:
        text, found = state["text"], state["found"]
        if isinstance(step, Scrubber):
            return F.struct(step.replace(text).alias("text"), found.alias("found")) if mask else state
        entries = F.transform(step.pieces(text),
                              lambda piece, i: _entry(step, piece, i, cfg))
        after = let(entries, lambda e: F.struct(
            (F.array_join(e["text"], "") if mask else text).alias("text"),
            F.concat(found, F.array_compact(e["found"]).cast(_FOUND)).alias("found")))
        return F.when(step.hint(text), after).otherwise(state)

    return run


def _observe_block(block: Sequence[Detector | Scrubber], cfg: MaskConfig,
                   mask: bool) -> Callable[[Column], Column]:
    def run(state: Column) -> Column:
        states = F.array(state)
        for step in block:
            states = F.transform(states, _observe(step, cfg, mask))
        after, needed = F.element_at(states, 1), any_needed(block)
        return after if needed is None else F.when(state["text"].rlike(needed), after).otherwise(state)

    return run


def findings(df: DataFrame, keep: Sequence[str], text: str, cfg: MaskConfig,
             as_lines: bool = False, chained: bool = True) -> DataFrame:
    """One row per finding: the `keep` columns, then type, pos, value and token.

    Texts are taken whole, or, with `as_lines`, as log lines: of a JSON object
    only the string values count. `pos` numbers the matches of one detector in
    one text from 0. With `chained` off, every detector looks at the text as it
    is, and not at what the detectors before it have left. Holds raw sensitive
    values.
    """
    walked = _walked(df.select(*keep, _begun(text, as_lines, cfg).alias("_states")), "_states", cfg, chained)
    return walked.select(*keep, F.inline(_all_found("_states")))


def _begin(part: Column) -> Column:
    return F.struct(shield(part).alias("text"), F.array().cast(_FOUND).alias("found"))


@built_once
def _begun(text: str, as_lines: bool, cfg: MaskConfig) -> Column:
    """The state of each part of a text before the first detector."""
    if as_lines:
        return F.transform(F.filter(line_pieces(F.col(text), cfg), is_maskable), lambda piece: _begin(piece["text"]))
    return F.array(_begin(F.col(text)))


@built_once
def _observed(states: str, number: int, cfg: MaskConfig, mask: bool) -> Column:
    """The states after a block of the chain."""
    return F.transform(states, _observe_block(blocks_of(active_detectors(cfg))[number], cfg, mask))


def _walked(df: DataFrame, states: str, cfg: MaskConfig, mask: bool) -> DataFrame:
    # One select per block keeps each expression small for the analyzer; the
    # optimizer makes one projection of them.
    for number in range(len(blocks_of(active_detectors(cfg)))):
        df = df.withColumn(states, _observed(states, number, cfg, mask))
    return df


@built_once
def _all_found(states: str) -> Column:
    return F.flatten(F.transform(states, lambda state: state["found"]))


def pii_counts(found: DataFrame, source: str = "source") -> DataFrame:
    """Findings per source and type."""
    return found.groupBy(source, "type").agg(F.count("*").alias("n"))


def pii_totals(found: DataFrame, source: str = "source") -> DataFrame:
    """Findings per source and type, per source, and in all (nulls mark totals)."""
    # Count first: the rollup then expands one row per source and type.
    return (pii_counts(found, source).rollup(source, "type")
            .agg(F.sum("n").alias("n")))


def token_vault(found: DataFrame) -> DataFrame:
    """Each masked value with its token. Holds raw values: store it apart.

    Findings masked by a placeholder have no token and are not part of it.
    """
    return (found.select("value", "token").where(F.col("token").rlike(_TOKEN)).distinct()
            .select(F.regexp_extract("token", _TOKEN, 1).alias("prefix"), "value", "token"))


def correlate_tokens(found: DataFrame, source: str = "source") -> DataFrame:
    """Tokens seen in more than one source."""
    return (found.select("token", source).where(F.col(source).isNotNull()).distinct()
            .groupBy("token").agg(F.count("*").alias("n_sources"))
            .where(F.col("n_sources") > 1))


def token_collisions(vault: DataFrame) -> DataFrame:
    """Tokens that stand for more than one value.

    Three bytes of hash make 16.7 million tokens per prefix: with some 4,800
    values of one prefix a clash is as likely as not.
    """
    return (vault.select("token", "value").distinct()
            .groupBy("token").agg(F.count("*").alias("n_values"))
            .where(F.col("n_values") > 1))


def _audit_counts(found: DataFrame) -> DataFrame:
    """Counts per type of what is left. found: inner, known, and type, value and n of what is not known.

    A value counts unless its inner text is known as a token's. The last but one sum has a
    row for each inner text and task at most, and its lists one entry for each type and spelling
    in brackets of one inner text.
    """
    left = F.when(~F.col("known"), F.struct("type", "value", "n"))
    return (found.groupBy("inner", "type", "value", "known").agg(F.sum("n").alias("n"))
            .groupBy("inner").agg(F.max("known").alias("known"), F.collect_list(left).alias("left"))
            .where(~F.col("known")).select(F.inline("left"))
            .groupBy("type").agg(F.sum("n").alias("n"), F.count("*").alias("n_values")))


def residual_audit(masked: DataFrame, text: str, vault: DataFrame, cfg: MaskConfig) -> DataFrame:
    """What the detectors of `cfg` still find in masked text, the tokens of the vault aside.

    Each detector looks at the masked text itself: in a chain, the later ones
    would find tokens the audit has made. Findings and tokens meet in one sum, not
    in a join: a hot value is counted where it is found.
    """
    inner = F.regexp_replace("value", _BRACKETS, "").alias("inner")
    left = findings(masked, [], text, cfg, chained=False).select(
        inner, "type", "value", F.lit(False).alias("known"), F.lit(1).cast("long").alias("n"))
    no_text = F.lit(None).cast("string")
    known = vault.select(F.regexp_replace("token", _BRACKETS, "").alias("inner"), no_text.alias("type"),
                         no_text.alias("value"), F.lit(True).alias("known"), F.lit(0).cast("long").alias("n"))
    return _audit_counts(left.unionByName(known))


def audit_masking(df: DataFrame, text: str, cfg: MaskConfig, audit: MaskConfig) -> DataFrame:
    """`residual_audit` of a column masked by `cfg`, in one scan of the text as it was.

    Each text is walked through the chain of `cfg`, and what comes out is looked at by
    the detectors of `audit` in the same row; the tokens that the chain made are known.
    """
    walked = _walked(df.select(_begun(text, False, cfg).alias("_states")), "_states", cfg, True)
    walked = walked.withColumn("_audit", F.transform("_states", lambda state: F.struct(
        state["text"].alias("text"), F.array().cast(_FOUND).alias("found"))))
    walked = _walked(walked, "_audit", audit, False)

    def bare(value: Column) -> Column:
        return F.regexp_replace(value, _BRACKETS, "")

    tokens = F.filter(_all_found("_states"), lambda f: f["token"].rlike(_TOKEN))
    known = F.transform(tokens, lambda f: F.struct(
        bare(f["token"]).alias("inner"), F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("value"), F.lit(True).alias("known"), F.lit(0).cast("long").alias("n")))
    left = F.transform(_all_found("_audit"), lambda f: F.struct(
        bare(f["value"]).alias("inner"), f["type"].alias("type"), f["value"].alias("value"),
        F.lit(False).alias("known"), F.lit(1).cast("long").alias("n")))
    return _audit_counts(walked.select(F.inline(F.concat(known, left))))


def run_report(lines: DataFrame, source: str, text: str, cfg: MaskConfig) -> DataFrame:
    """Lines, changed lines and characters per source."""
    masked = lines.select(F.col(source).alias("source_file"), F.col(text).alias("before"),
                          masked_line(text, cfg).alias("after"))
    return masked.groupBy("source_file").agg(
        F.count("*").alias("n_lines"),
        F.sum((~F.col("before").eqNullSafe(F.col("after"))).cast("long")).alias("n_changed"),
        F.coalesce(F.sum(F.length("before").cast("long")), F.lit(0)).alias("n_chars"))
