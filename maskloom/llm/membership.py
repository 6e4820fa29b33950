"""A small filter of ids: which rows certainly aren't among them, before anything is shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Bits per id, and bits at most: 8 MB go to the tasks however many ids there are.
BITS_PER_ID, MOST_BITS, HASHES = 16, 1 << 26, 3


def _hashes(*columns: str) -> list[Column]:
    return [F.xxhash64(*columns, F.lit(k)) for k in range(HASHES)]


def perhaps_among(ids: DataFrame, *columns: str) -> Column:
    """True for all rows whose columns stand in ids and for few others (more, if there are very many ids).

    Columns have the same names and types on both sides. A join must follow: this only
    keeps the other rows out of its shuffle.
    """
    bits, wanted = 64, min(MOST_BITS, BITS_PER_ID * ids.count())
    while bits < wanted:
        bits *= 2
    place = F.explode(F.array(*(F.pmod(h, F.lit(bits)) for h in _hashes(*columns))))
    words = (ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("at"))
             .agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("w")).toPandas())
    table = np.zeros(bits // 64, np.int64)
    table[words["at"].to_numpy(np.int64)] = words["w"].to_numpy(np.int64)

    @F.pandas_udf("boolean")
    def among(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        out = np.ones(len(a), bool)
        for h in (a, b, c):
            p = np.mod(h.to_numpy(np.int64), bits)
            out &= (table[p >> 6] >> (p & 63) & 1).astype(bool)
        return pd.Series(out)

    return among(*_hashes(*columns))
