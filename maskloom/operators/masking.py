"""Masking of text columns: plain Columns in, plain Columns out.

A chain of detectors is one expression. Each step maps a one-element array by a
lambda, which names the text of the step before; so the expression grows with
the number of detectors and not with its power, needs no helper columns, and
works in a batch, a stream or SQL alike. It reads one row at a time: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from maskloom.config import MaskConfig
from maskloom.functions.matching import join_pieces, shield, unshield
from maskloom.functions.reuse import built_once
from maskloom.operators import detectors as d
from maskloom.operators.detectors import Detector, Scrubber, any_needed
from maskloom.operators.json_lines import mask_pieces


_BLOCK = 14


def _step(step: Detector | Scrubber, text: Column, cfg: MaskConfig) -> Column:
    if isinstance(step, Scrubber):
        return step.replace(text)
    masked = join_pieces(step.pieces(text), lambda m: step.rewrite(m, cfg))
    return F.when(step.hint(text), masked).otherwise(text)


def _rewriter(step: Detector | Scrubber, cfg: MaskConfig) -> Callable[[Column], Column]:
    return lambda text: _step(step, text, cfg)


def blocks_of(chain: Sequence[Detector | Scrubber]) -> list[Sequence[Detector | Scrubber]]:
    """The chain in pieces that are worth one look at the text before they run."""
    return [chain[i:i + _BLOCK] for i in range(0, len(chain), _BLOCK)]


def _run_block(block: Sequence[Detector | Scrubber], cfg: MaskConfig) -> Callable[[Column], Column]:
    def run(text: Column) -> Column:
        state = F.array(text)
        for step in block:
            state = F.transform(state, _rewriter(step, cfg))
        masked = F.element_at(state, 1)
        # A text without anything the steps need is not changed by the first of
        # them, hence not by the second, and so on: none has to run.
        needed = any_needed(block) if len(block) > 1 else None
        return masked if needed is None else F.when(text.rlike(needed), masked).otherwise(text)

    return run


def run_chain(text: Column, chain: Sequence[Detector | Scrubber], cfg: MaskConfig) -> Column:
    """`text` sent through `chain`, step by step."""
    state = F.array(shield(text))
    for block in blocks_of(chain):
        state = F.transform(state, _run_block(block, cfg))
    return unshield(F.element_at(state, 1))


def mask_text(text: Column, cfg: MaskConfig) -> Column:
    """A text with every sensitive value masked."""
    return run_chain(text, d.active_detectors(cfg), cfg)


def mask_line(line: Column, cfg: MaskConfig) -> Column:
    """A log line masked; of a JSON object only the string values change."""
    if not cfg.detect_json:
        return mask_text(line, cfg)
    return mask_pieces(line, lambda text: mask_text(text, cfg), cfg)


@built_once
def masked_text(name: str, cfg: MaskConfig) -> Column:
    """`mask_text` of the column of this name."""
    return mask_text(F.col(name), cfg)


@built_once
def masked_line(name: str, cfg: MaskConfig) -> Column:
    """`mask_line` of the column of this name."""
    return mask_line(F.col(name), cfg)


def mask_columns(df: DataFrame, columns: Sequence[str], cfg: MaskConfig) -> DataFrame:
    """`df` with each of the named string columns masked as a line."""
    return df.withColumns({name: masked_line(name, cfg) for name in columns})


# One detector at a time -------------------------------------------------------

def scrub_terms(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.scrub_terms(cfg.scrub_terms)], cfg) if cfg.scrub_terms else text


def mask_api_keys(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.API_KEYS], cfg)


def mask_bearer(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.BEARER], cfg)


def mask_ipv6(text: Column, cfg: MaskConfig) -> Column:
    """IPv6 addresses, and the scope or port left behind one."""
    return run_chain(text, [d.IPV6, d.IPV6_TAILS], cfg)


def mask_site_paths(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.SITE_PATHS], cfg)


def mask_ldap(text: Column, cfg: MaskConfig) -> Column:
    """LDAP domains, then CN, OU and DC values up to the next comma."""
    return run_chain(text, [d.LDAP_DOMAINS, d.LDAP_NAMES], cfg)


def mask_key_values(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.KEY_VALUES], cfg)


def mask_url_hosts(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.URL_HOSTS], cfg)


def mask_connection_strings(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.CONNECTION_PAIRS], cfg)


def mask_emails(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.EMAILS], cfg)


def mask_tr_mobiles(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.TR_MOBILES], cfg)


def mask_phones(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.PHONES], cfg)


def mask_cards(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.CARDS], cfg)


def scrub_site_words(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.scrub_site_words(cfg.site_words)], cfg) if cfg.site_words else text


def mask_ipv4(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.IPV4], cfg)


def mask_ssn(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.SSNS], cfg)


def mask_iban(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.IBANS], cfg)


def mask_thumbprints(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.THUMBPRINTS], cfg)


def mask_connection_secrets(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.CONNECTION_SECRETS], cfg)


def mask_domain_users(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.DOMAIN_USERS], cfg)


def mask_usernames(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.USERNAMES], cfg)


def mask_hostnames(text: Column, cfg: MaskConfig) -> Column:
    hostnames = d.HOSTNAMES_BESIDE_TOKENS if cfg.protect_tokens else d.HOSTNAMES
    return run_chain(text, [hostnames], cfg)


def mask_fqdns(text: Column, cfg: MaskConfig) -> Column:
    return run_chain(text, [d.FQDNS], cfg)
