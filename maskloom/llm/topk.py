"""Exact top-k inner products over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from maskloom.llm.common import stored

#: Vectors of a block of the index, and queries that one task takes at a time.
BLOCK_ROWS, QUERY_ROWS = 4096, 128
#: Bits of the coarse attribute values in the slices, and of the coarse weights of a query.
VALUE_BITS, WEIGHT_BITS = 7, 10
SCALE = 1024

BLOCKS = "block long, dims int, ids binary, attrs binary"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(SCALE * x) of each component; vectors null or with null or non-finite components take no part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(usable)
            .select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("q")))


def index_blocks(vectors: DataFrame) -> DataFrame:
    """The quantised vectors in blocks of BLOCK_ROWS, a row per block: ids and attributes as packed numbers."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple[int, np.ndarray]]] = {}

        def packed(rows: list[tuple[int, np.ndarray]], dims: int) -> pd.DataFrame:
            nonlocal block
            block += 1
            attrs = np.array([v for _, v in rows], "<i8").reshape(len(rows), dims)
            for kind in ("<i2", "<i4"):
                if attrs.size == 0 or np.abs(attrs).max() <= np.iinfo(kind).max:
                    attrs = attrs.astype(kind)
                    break
            ids = np.array([i for i, _ in rows], "<i8").tobytes()
            return pd.DataFrame({"block": [block], "dims": [dims], "ids": [ids], "attrs": [attrs.tobytes()]})

        for batch in batches:
            for vec_id, q in zip(batch["vec_id"], batch["q"]):
                rows = waiting.setdefault(len(q), [])
                rows.append((vec_id, q))
                if len(rows) == BLOCK_ROWS:
                    yield packed(rows, len(q))
                    waiting[len(q)] = []
        for dims, rows in waiting.items():
            if rows:
                yield packed(rows, dims)

    return quantised(vectors).mapInPandas(run, BLOCKS)


def unpacked(ids: bytes, attrs: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, "<i8")
    width = len(attrs) // max(1, len(found) * dims)
    return found, np.frombuffer(attrs, f"<i{width or 2}").astype(np.int64).reshape(len(found), dims)


class BitSlices:
    """Coarse attribute values of a block as bitmaps: dimension x bit x word, least significant bit first.

    A value is low + (coarse << shift) + rest with 0 <= coarse <= top and 0 <= rest < 1 << shift.
    """

    def __init__(self, attrs: np.ndarray):
        self.n = len(attrs)
        low = attrs.min(axis=0)
        reach = int((attrs - low).max(initial=0)).bit_length()
        self.shift = max(0, reach - VALUE_BITS)
        self.bits = max(1, min(VALUE_BITS, reach))
        self.top = (1 << self.bits) - 1
        coarse = (attrs - low) >> self.shift
        self.slices = np.stack([_bitmaps((coarse >> b) & 1) for b in range(self.bits)], axis=1)

    def sums(self, weights: np.ndarray, negative: np.ndarray) -> list[np.ndarray]:
        """Slices of sum(weight * coarse) for each query: bitmaps of query x word.

        Where the query's weight is negative, top - coarse, the complement, is added instead.
        """
        total: list[np.ndarray] = []
        for d in range(len(self.slices)):
            flip = np.where(negative[:, d], ALL, NONE)[:, None]
            addends = [s ^ flip for s in self.slices[d]]
            for place in range(int(weights[:, d].max(initial=0)).bit_length()):
                gate = np.where(weights[:, d] >> place & 1, ALL, NONE)[:, None]
                _add(total, [a & gate for a in addends], place)
        return total


ALL, NONE = np.uint64(2 ** 64 - 1), np.uint64(0)


def _bitmaps(columns: np.ndarray) -> np.ndarray:
    """Each column of 0 and 1 as a bitmap of 64-bit words."""
    padded = np.pad(columns.astype(np.uint8), ((0, -len(columns) % 64), (0, 0)))
    return np.ascontiguousarray(np.packbits(padded, axis=0, bitorder="little").T).view("<u8")


def _add(total: list[np.ndarray], addend: list[np.ndarray], place: int) -> None:
    """total += addend << place, by ripple-carry on bitmaps."""
    carry = np.zeros_like(addend[0])
    for at in range(place, place + len(addend)):
        if at == len(total):
            total.append(np.zeros_like(carry))
        a, t = addend[at - place], total[at]
        half = t ^ a
        total[at], carry = half ^ carry, (t & a) | (half & carry)
    at = place + len(addend)
    while carry.any():
        if at == len(total):
            total.append(np.zeros_like(carry))
        total[at], carry = total[at] ^ carry, total[at] & carry
        at += 1


def kth_sum(slices: list[np.ndarray], allowed: np.ndarray, k: int) -> int:
    """The k-th largest sum of the allowed rows, from the most significant slice down; the least, if there are fewer."""
    k = min(k, int(np.bitwise_count(allowed).sum()))
    found, above, tied = 0, 0, allowed
    for b in range(len(slices) - 1, -1, -1):
        ones = tied & slices[b]
        n = above + int(np.bitwise_count(ones).sum())
        if n >= k:
            found, tied = found | 1 << b, ones
        else:
            above, tied = n, tied & ~slices[b]
    return found


def at_least(slices: list[np.ndarray], allowed: np.ndarray, bound: int) -> np.ndarray:
    """The allowed rows whose sum is bound or more, from the most significant slice down."""
    if bound <= 0:
        return allowed
    above, equal = np.zeros_like(allowed), allowed
    for b in range(len(slices) - 1, -1, -1):
        if bound >> b & 1:
            equal = equal & slices[b]
        else:
            above, equal = above | (equal & slices[b]), equal & ~slices[b]
    return above | equal


def search_block(ids: np.ndarray, attrs: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
                 k: int) -> Iterator[tuple[int, int, int]]:
    """(place of the query, vec_id, score) for the k best rows of a block for each query, exact.

    A score is a constant + (sum << shifts) + an error of known width, so every row of the
    k best has a sum within that width of the k-th: those rows are scored exactly.
    """
    index = BitSlices(attrs)
    size, negative = np.abs(queries), queries < 0
    drop = max(0, int(size.max(initial=0)).bit_length() - WEIGHT_BITS)
    coarse = size >> drop
    slices = index.sums(coarse, negative)
    rest = (size - (coarse << drop)).astype(object).sum(axis=1) * index.top
    width = (size.astype(object).sum(axis=1) * ((1 << index.shift) - 1) + rest * (1 << index.shift)) \
        // (1 << (index.shift + drop))
    every = _bitmaps(np.ones((len(ids), 1)))[0]
    for place, query in enumerate(queries):
        allowed = every & ~_bitmaps((ids == query_ids[place])[:, None])[0]
        if not allowed.any():
            continue
        own = [s[place] for s in slices]
        near = at_least(own, allowed, kth_sum(own, allowed, k) - int(width[place]))
        rows = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        scores = attrs[rows] @ query
        for i in np.lexsort((ids[rows], -scores))[:k]:
            yield place, int(ids[rows[i]]), int(scores[i])


def query_blocks(blocks: DataFrame, every: int) -> DataFrame:
    """The rows whose vec_id is divisible by `every`, repacked in blocks of at most QUERY_ROWS."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, dims, ids, attrs in zip(batch["block"], batch["dims"], batch["ids"], batch["attrs"]):
                found, values = unpacked(ids, attrs, dims)
                rows = np.flatnonzero(found % every == 0)
                for start in range(0, len(rows), QUERY_ROWS):
                    part = rows[start:start + QUERY_ROWS]
                    yield pd.DataFrame({"query_block": [f"{block}-{start}"], "dims": [dims],
                                        "query_ids": [found[part].tobytes()],
                                        "queries": [values[part].astype("<i8").tobytes()]})

    return blocks.mapInPandas(run, "query_block string, dims int, query_ids binary, queries binary")


FOUND = "query_block string, place int, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Each query's k highest inner products against all other rows, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`. The index is written once,
    in blocks; each block of queries meets each block of rows once, wherever it lies.

    Vectors that are null or have null or non-finite components, and rows without vec_id, take
    no part. Vectors of another length than the query's have no inner product with it. A
    vec_id that stands in several rows gives as many queries and candidates, none of them
    against its own id. Scores are 64-bit. Empty tables give no rows; other columns are not read.
    """
    blocks = stored(index_blocks(vectors), "slices")
    n_blocks = max(1, blocks.count())
    rows = blocks.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(n_blocks)).cast("int"))
    asked = query_blocks(blocks, every).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = rows.join(asked, ["slot", "dims"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                ids, attrs = unpacked(row.ids, row.attrs, row.dims)
                query_ids, queries = unpacked(row.query_ids, row.queries, row.dims)
                found += [(row.query_block, place, int(query_ids[place]), vec_id, score)
                          for place, vec_id, score in search_block(ids, attrs, query_ids, queries, k)]
            yield pd.DataFrame(found, columns=["query_block", "place", "query_id", "vec_id", "score"])

    found = pairs.select("dims", "ids", "attrs", "query_block", "query_ids", "queries").mapInPandas(run, FOUND)
    best = Window.partitionBy("query_block", "place").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
