"""Tokens: `[CODE-HHHHHH]`, six hex digits of SHA-256 over value and salt.

A token depends on nothing but code, value and salt, so every task, retry and
micro-batch computes the same one; there is no table of tokens to share.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from maskloom.config import TYPE_CODES, UNKNOWN_TYPE_CODE, MaskConfig


def key_token(code: Column | str, value: Column, cfg: MaskConfig) -> Column:
    """`[CODE-HHHHHH]` under a code of the caller's."""
    opening = F.lit(f"[{code}-") if isinstance(code, str) else F.concat(F.lit("["), code, F.lit("-"))
    salted = F.concat(value, F.lit(cfg.salt)) if cfg.salt else value
    return F.concat(opening, F.upper(F.substring(F.sha2(salted, 256), 1, 6)), F.lit("]"))


def type_code(type_name: Column | str) -> Column | str:
    """The token code of a type; unknown types give `ID`."""
    if isinstance(type_name, str):
        return TYPE_CODES.get(type_name, UNKNOWN_TYPE_CODE)
    codes = F.create_map(*[F.lit(x) for x in chain.from_iterable(TYPE_CODES.items())])
    return F.coalesce(F.try_element_at(codes, type_name), F.lit(UNKNOWN_TYPE_CODE))


def typed_token(type_name: Column | str, value: Column, cfg: MaskConfig) -> Column:
    """`[CODE-HHHHHH]` with the code of a type."""
    return key_token(type_code(type_name), value, cfg)
