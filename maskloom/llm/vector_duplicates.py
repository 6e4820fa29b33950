"""Near-duplicate vectors: int8 tile products with error bounds, full precision where these leave a pair open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from maskloom.llm.common import stored
from maskloom.llm.components import components

#: Vectors are linked from this cosine on.
SIMILARITY = 0.9
#: Different vectors of a tile (on average), and rows and columns of a product that are looked at together.
TILE, SQUARE = 8192, 1024
#: More than what rounding in double and single precision can add to a bound.
SLACK = 1e-6


# --- Quantised products ---------------------------------------------------------------

class Tile:
    """Vectors of one length: units in double precision, int8 codes, and what rounding to codes loses of each.

    unit = scale * code + rest, so the cosine of a and b differs from scale_a * scale_b * (code_a . code_b) by
    at most |rest_a| + |rest_b| + |rest_a| |rest_b|, since |scale * code| <= 1 + |rest| by the triangle inequality.
    """

    def __init__(self, keys: np.ndarray, nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        self.keys, self.nodes, self.copies = keys, nodes, copies
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of large components stay finite
        self.units = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        self.scale = np.abs(self.units).max(axis=1) / 127
        self.codes = np.rint(self.units / self.scale[:, None]).astype(np.int8)
        rest = self.units - self.scale[:, None] * self.codes
        self.lost = np.sqrt((rest * rest).sum(axis=1))

    @classmethod
    def of(cls, row: dict) -> Tile:
        nodes, copies = (np.frombuffer(row[c], "<i8") for c in ("nodes", "copies"))
        vectors = np.frombuffer(row["vectors"], row["kind"]).astype(np.float64).reshape(len(nodes), row["dims"])
        return cls(np.frombuffer(row["keys"], "V32"), nodes, copies, vectors)

    def square(self, start: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, scales and losses of SQUARE vectors; codes as numbers in which their products are exact."""
        cut = slice(start, start + SQUARE)
        return self.codes[cut].astype(kind), self.scale[cut], self.lost[cut]


def exact_in_single(dims: int) -> bool:
    """Whether a sum of `dims` products of codes is below 2 ** 24."""
    return dims * 127 * 127 < 1 << 24


def linked(a: Tile, b: Tile) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of the pairs whose cosine is SIMILARITY or more, a square at a time; of one tile, i < j."""
    kind = np.float32 if exact_in_single(a.units.shape[1]) else np.float64
    for p in range(0, len(a.keys), SQUARE):
        codes, scale, lost = a.square(p, kind)
        for q in range(p if a is b else 0, len(b.keys), SQUARE):
            their_codes, their_scale, their_lost = b.square(q, kind)
            product = codes @ their_codes.T
            # The least product that a pair of cosine SIMILARITY can have, where the others lose most and scale most.
            most = their_lost.max()
            must = SIMILARITY - SLACK - lost - most - lost * most
            least = np.where(must > 0, np.floor(must / (scale * their_scale.max())), -np.inf)
            i, j = np.nonzero(product >= least.astype(kind)[:, None])
            near = product[i, j].astype(np.float64) * scale[i] * their_scale[j]
            error = lost[i] + their_lost[j] + lost[i] * their_lost[j] + SLACK
            possible = near + error >= SIMILARITY
            if a is b and p == q:
                possible &= i < j
            i, j, found = i[possible] + p, j[possible] + q, (near - error >= SIMILARITY)[possible]
            doubt = np.flatnonzero(~found)
            for start in range(0, len(doubt), SQUARE * 16):
                part = doubt[start:start + SQUARE * 16]
                found[part] = (a.units[i[part]] * b.units[j[part]]).sum(axis=1) >= SIMILARITY
            if found.any():
                yield i[found], j[found]


def hung(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A forest whose trees are as flat as can be, each place's root the least of its tree, with i and j of each pair joined."""
    while True:
        x, y = parent[i], parent[j]
        apart = x != y
        if not apart.any():
            return parent
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]


FOUND = "key binary, node long, root long, links long"


def compared(a: Tile, b: Tile) -> pa.Table:
    """For each vector with links in the two tiles: the least node that it reaches by them, and how many rows it is linked with."""
    tiles = [a] if a is b else [a, b]
    keys, nodes = (np.concatenate([getattr(t, name) for t in tiles]) for name in ("keys", "nodes"))
    shift = 0 if a is b else len(a.keys)
    order = np.argsort(nodes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    parent, links = np.arange(len(order)), np.zeros(len(order), np.int64)
    for i, j in linked(a, b):
        np.add.at(links, i, b.copies[j])
        np.add.at(links, j + shift, a.copies[i])
        parent = hung(parent, rank[i], rank[j + shift])
    at = np.flatnonzero(links)
    return pa.table({"key": pa.array(keys[at].tolist(), pa.binary()), "node": nodes[at],
                     "root": nodes[order[parent[rank[at]]]], "links": links[at]})


# --- Tables -----------------------------------------------------------------------

def comparable() -> Column:
    """Whether a row can link with others."""
    usable = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & usable & F.exists("embedding", lambda c: c != 0), F.lit(False))


TILES = "dims int, tile int, kind string, keys binary, nodes binary, copies binary, vectors binary"


def tiles_of(distinct: DataFrame, n_tiles: int) -> DataFrame:
    """Different vectors dealt by their key to tiles of about TILE, each packed into a row; tiles hold vectors of one length."""
    def pack(table: pa.Table) -> pa.Table:
        dims, tile = table["dims"][0].as_py(), table["tile"][0].as_py()
        vectors = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        columns = [np.ascontiguousarray(table[c].to_numpy()).astype("<i8").tobytes() for c in ("node", "copies")]
        return pa.table({"dims": pa.array([dims], pa.int32()), "tile": pa.array([tile], pa.int32()),
                         "kind": [vectors.dtype.str], "keys": [b"".join(table["key"].to_pylist())],
                         "nodes": [columns[0]], "copies": [columns[1]], "vectors": [vectors.tobytes()]})

    tile = F.pmod(F.xxhash64("key"), F.lit(n_tiles)).cast("int")
    return (distinct.select(F.size("embedding").alias("dims"), tile.alias("tile"), "key", "node", "copies", "embedding")
            .groupBy("dims", "tile").applyInArrow(pack, TILES))


def links_of(distinct: DataFrame) -> DataFrame:
    """For each vector with links, a row per pair of tiles that has some of them; see `compared`."""
    n_tiles = -(-distinct.count() // TILE) or 1
    tiles = stored(tiles_of(distinct, n_tiles), "tiles")

    def compare(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if len(rows) == 1 and rows[0]["a"] != rows[0]["b"]:
            return pa.table({"key": pa.array([], pa.binary()), **{c: pa.array([], pa.int64()) for c in ("node", "root", "links")}})
        held = [Tile.of(row) for row in rows]
        return compared(held[0], held[-1])

    other = F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)))
    pairs = (tiles.withColumn("other", other).withColumn("a", F.least("tile", "other"))
             .withColumn("b", F.greatest("tile", "other")).drop("tile", "other"))
    return pairs.groupBy("dims", "a", "b").applyInArrow(compare, FOUND)


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: links are cosines of SIMILARITY or more, in double precision.

    Every pair of different vectors is in one product of two tiles. Equal vectors are folded before that and
    counted; what leaves a product is a row per linked vector, never a row per link.

    Vectors that are null, zero, or have null or non-finite components link with nothing; vectors of different
    lengths don't link. Rows that repeat a vec_id are vectors of their own, linked like any others, but one
    node where links are followed. Rows without vec_id link with nothing, have no component and aren't kept. An
    empty table gives no rows; other columns are not read.
    """
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = every.where(comparable()).select(
        "vec_id", F.unhex(F.sha2(F.col("embedding").cast("string"), 256)).alias("key"), "embedding")
    distinct = stored(usable.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"),
                                                F.first("embedding").alias("embedding")), "distinct")
    found = stored(links_of(distinct), "links")
    sums = found.groupBy("key").agg(F.sum("links").alias("links"))
    of_key = distinct.select("key", "node", "copies").join(sums, "key", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    rows = stored(usable.select("vec_id", "key").join(of_key, "key")
                  .select("vec_id", "node", n_links.cast("long").alias("n_links")), "rows")
    reached = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(
        rows.select(F.col("vec_id").alias("a"), F.col("node").alias("b"))))
    alone = every.where(~comparable()).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    component = F.coalesce("component", "vec_id")
    return (rows.select("vec_id", "n_links").unionAll(alone).join(reached, F.col("vec_id") == F.col("node"), "left")
            .select("vec_id", "n_links", component.alias("component_id"),
                    F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")))
