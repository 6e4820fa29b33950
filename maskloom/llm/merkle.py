"""Merkle manifest of a dataset: a tree per source and one over their roots, in van Emde Boas layout.

A tree is stored as blocks, aligned subtrees of SPAN leaves, a row each; the roots of a tree's blocks are the leaves of
the next tier of blocks, until one block is left. Inside a block the nodes lie in van Emde Boas order: split
at half height, the upper half first, then each lower subtree, all of them split the same way. Where
a node lies is arithmetic on its depth and index, so no pointers are stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from maskloom.llm.common import LOWER, UPPER, stored

#: Nodes that one node above them covers, and levels of a block above its leaves.
ARITY, BLOCK_LEVELS = 16, 2
SPAN = ARITY ** BLOCK_LEVELS
#: Rows whose id has a CRC-32 divisible by this are tampered with in the check of proofs.
TAMPERED_EVERY = 5
#: Bytes of a digest.
WIDTH = 32


# --- Layout -----------------------------------------------------------------------

def size(levels: int) -> int:
    """Nodes of a complete tree with so many levels, leaves and root included."""
    return (ARITY ** levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: int) -> int:
    """Where the node of this depth (the root's is 0) and index lies in van Emde Boas order."""
    at = 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        levels, depth = levels - upper, depth - upper
        subtree, index = divmod(index, ARITY ** depth)
        at += size(upper) + subtree * size(levels)
    return at


_ROWS: dict[tuple[int, int], list[int]] = {}


def row_of_addresses(levels: int, depth: int) -> list[int]:
    """The addresses of all nodes of one depth, by index."""
    if (levels, depth) not in _ROWS:
        _ROWS[levels, depth] = [address(levels, depth, index) for index in range(ARITY ** depth)]
    return _ROWS[levels, depth]


def lifts(total: int) -> int:
    """Levels above the leaves of a block, in a tier with so many leaves in its tree."""
    if total > SPAN:
        return BLOCK_LEVELS
    levels = 0
    while ARITY ** levels < total:
        levels += 1
    return levels


def widths(n: int, levels: int) -> list[int]:
    """Nodes at each depth, root first, over n leaves."""
    found = [n]
    for _ in range(levels):
        found.append(-(-found[-1] // ARITY))
    return found[::-1]


def digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def laid_out(leaves: list[bytes], levels: int) -> bytes:
    """The block over these leaves: every run of ARITY nodes has its hash above it. Trailing places without a node are cut."""
    counts = widths(len(leaves), levels)
    nodes = bytearray(WIDTH * size(levels + 1))
    used = 0
    for depth in range(levels, -1, -1):
        here = row_of_addresses(levels + 1, depth)
        if depth < levels:
            below = row_of_addresses(levels + 1, depth + 1)
            leaves = [digest("".join(nodes[WIDTH * a:WIDTH * (a + 1)].hex()
                                     for a in below[ARITY * p:min(ARITY * (p + 1), counts[depth + 1])]))
                      for p in range(counts[depth])]
        for a, value in zip(here, leaves):
            nodes[WIDTH * a:WIDTH * (a + 1)] = value
            used = max(used, a + 1)
    return bytes(nodes[:WIDTH * used])


class Block:
    """A block as it was stored: digests as hex text, found by address."""

    def __init__(self, nodes: bytes, n: int, levels: int):
        self.hex, self.n, self.levels = nodes.hex(), n, levels
        self.counts = widths(n, levels)

    def node(self, depth: int, index: int) -> str:
        a = 2 * WIDTH * row_of_addresses(self.levels + 1, depth)[index]
        return self.hex[a:a + 2 * WIDTH]

    def siblings(self, leaf: int) -> Iterator[tuple[str, str]]:
        """What stands left and right of the path's node in its run, from the leaf up to below the root."""
        for depth in range(self.levels, 0, -1):
            first = leaf - leaf % ARITY
            run = [self.node(depth, i) for i in range(first, min(first + ARITY, self.counts[depth]))]
            yield "".join(run[:leaf - first]), "".join(run[leaf - first + 1:])
            leaf //= ARITY


# --- Leaves and their ranks ---------------------------------------------------------

def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the source), key and item.doc_id (doc_id), leaf, and item.changed: the leaf of a tampered row, else null."""
    def leaf(text: Column) -> Column:
        fields = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
        return F.unhex(F.sha2(F.concat(*fields, _field(text)), 256))

    decimal = F.col("doc_id").cast("string")
    tampered = F.crc32(decimal.cast("binary")) % TAMPERED_EVERY == 0
    changed = F.when(tampered, leaf(F.translate("text", UPPER, LOWER)))
    return docs.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").alias("key"), leaf(F.col("text")).alias("leaf"),
                       F.struct(F.col("doc_id").cast("long").alias("doc_id"), changed.alias("changed")).alias("item"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows with their rank by key within their tree, and the tree's total.

    The rows are sorted over all tasks, so a tree with most of the rows is spread like any other. A row's
    rank is its place in its sorted part and what the tree has in the parts before. The
    sorted rows are written first: both come from the same order, even if a part is made again.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    along = [F.col("tree").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    ordered = (rows.withColumn("tie", F.monotonically_increasing_id())
               .repartitionByRange(parts, *along).sortWithinPartitions(*along))
    kept = stored(ordered.select("tree", "leaf", "item", F.monotonically_increasing_id().alias("at")), "leaves")
    kept = kept.withColumn("part", F.shiftright("at", 33))
    of_tree = Window.partitionBy("tree")
    pieces = (kept.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
              .select(F.col("tree").alias("t"), F.col("part").alias("p"), "first",
                      (F.sum("n").over(of_tree.orderBy("part")) - F.col("n")).alias("before"),
                      F.sum("n").over(of_tree).alias("total")))
    met = kept.join(pieces, F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    return met.select("tree", (F.col("at") - F.col("first") + F.col("before")).alias("rank"), "total", "leaf", "item")


# --- Blocks -----------------------------------------------------------------------

def blocks(rows: DataFrame) -> DataFrame:
    """A row per block: tree, block (its number), total (leaves of the tree in this tier), nodes, root, items in order."""
    kind = rows.schema["item"].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        total = table["total"][0].as_py()
        nodes = laid_out(table["leaf"].to_pylist(), lifts(total))
        return pa.table({"tree": table["tree"][:1], "block": [table["rank"][0].as_py() // SPAN], "total": [total],
                         "n": pa.array([len(table)], pa.int32()), "nodes": [nodes], "root": [nodes[:WIDTH]],
                         "items": pa.array([table["item"].to_pylist()], pa.list_(table["item"].type))})

    number = F.floor(F.col("rank") / F.lit(SPAN)) if SPAN & (SPAN - 1) else F.shiftright("rank", SPAN.bit_length() - 1)
    return rows.groupBy("tree", number.alias("block")).applyInArrow(
        build, f"tree string, block long, total long, n int, nodes binary, root binary, items array<{kind}>")


def tiers(rows: DataFrame, name: str) -> list[DataFrame]:
    """The trees over (tree, rank, total, leaf, item) as tiers of blocks, lowest first, each written once."""
    found = [stored(blocks(rows), name)]
    while (found[-1].agg(F.max("total")).first()[0] or 0) > SPAN:
        above = found[-1].where(F.col("total") > SPAN).select(
            "tree", F.col("block").alias("rank"), F.ceil(F.col("total") / F.lit(SPAN)).cast("long").alias("total"),
            F.col("root").alias("leaf"), F.lit(None).cast("boolean").alias("item"))
        found.append(stored(blocks(above), name))
    return found


def roots(of: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    tops = [tier.where(F.col("total") <= SPAN).select("tree", "root") for tier in of]
    found = tops[0]
    for more in tops[1:]:
        found = found.unionAll(more)
    return found


@dataclass(frozen=True)
class Manifest:
    """The tiers of the trees of all sources, those of the tree over their roots, and its root (None without rows)."""

    sources: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def manifest(docs: DataFrame) -> Manifest:
    """The tree of each source, its leaves by doc_id, and the tree over their roots by source.

    Null sources are one source, the first; rows without doc_id come first in theirs. Rows that
    repeat a doc_id are leaves of their own, by their hash. Other columns are not read. No tree without rows.
    """
    # Written before they are sorted: finding the bounds of the sorted parts would hash every text once more.
    sources = tiers(ranked(stored(leaves(docs), "hashed")), "sources")
    subroots = roots(sources).select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("leaf"),
                                     F.struct(F.col("tree").alias("source"), "root").alias("item"))
    top = tiers(ranked(subroots), "subroots")
    found = roots(top).first()
    return Manifest(sources, top, found["root"].hex() if found else None)


# --- Proofs -----------------------------------------------------------------------

def packed(path: list[tuple[str, str]]) -> bytes:
    """The (left, right) siblings of a path, level by level, as bytes."""
    return b"".join(bytes([len(left) // (2 * WIDTH), len(right) // (2 * WIDTH)]) + bytes.fromhex(left + right)
                    for left, right in path)


def unpacked(path: bytes) -> list[tuple[str, str]]:
    found, at = [], 0
    while at < len(path):
        left, right = path[at] * WIDTH, path[at + 1] * WIDTH
        at += 2
        found.append((path[at:at + left].hex(), path[at + left:at + left + right].hex()))
        at += left + right
    return found


def folded(value: str, path: list[tuple[str, str]]) -> str:
    """The root that a value and its path lead to."""
    for left, right in path:
        value = digest(left + value + right).hex()
    return value


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for n in range(batch.num_rows):
            yield {name: batch.column(k)[n].as_py() for k, name in enumerate(batch.schema.names)}


LEAF_PATHS = "tree string, block long, subroot binary, path binary"


def leaf_paths(with_paths: DataFrame) -> DataFrame:
    """(tree, block, subroot, path) of each leaf of the blocks: a leaf is the root of the block below with that number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row["nodes"], row["n"], lifts(row["total"]))
            paths = [packed(list(block.siblings(i))) + row["path"] for i in range(row["n"])]
            yield pa.record_batch({"tree": pa.array([row["tree"]] * row["n"], pa.string()),
                                   "block": pa.array(range(row["block"] * SPAN, row["block"] * SPAN + row["n"]), pa.int64()),
                                   "subroot": pa.array([row["subroot"]] * row["n"], pa.binary()),
                                   "path": pa.array(paths, pa.binary())})

    return with_paths.select("tree", "block", "total", "n", "nodes", "subroot", "path").mapInArrow(run, LEAF_PATHS)


def lowest_with_paths(of: list[DataFrame], above: DataFrame) -> DataFrame:
    """The blocks of the lowest tier with the path from their root up. above: (tree, subroot, path) of each tree's root."""
    def met(blocks: DataFrame, paths: DataFrame, *keys: str) -> DataFrame:
        paths = paths.select(*(F.col(k).alias(f"its_{k}") for k in keys), "subroot", "path")
        on = [F.col(k).eqNullSafe(F.col(f"its_{k}")) for k in keys]
        return blocks.join(paths, on).select(*blocks.columns, "subroot", "path")

    found = None
    for tier in reversed(of):
        # A tree that ends in this tier has one block here; the others go on from the tier above.
        ended = met(tier.where(F.col("total") <= SPAN), above, "tree")
        below = [] if found is None else [met(tier.where(F.col("total") > SPAN), stored(leaf_paths(found), "paths"),
                                              "tree", "block")]
        found = ended.unionAll(*below) if below else ended
    return found


def source_paths(with_paths: DataFrame) -> DataFrame:
    """(tree, subroot, path) of each source from the lowest blocks over the roots of all sources."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row["nodes"], row["n"], lifts(row["total"]))
            yield pa.record_batch({"tree": pa.array([item["source"] for item in row["items"]], pa.string()),
                                   "subroot": pa.array([item["root"] for item in row["items"]], pa.binary()),
                                   "path": pa.array([packed(list(block.siblings(i))) + row["path"]
                                                     for i in range(row["n"])], pa.binary())})

    return (with_paths.select("total", "n", "nodes", "items", "path")
            .mapInArrow(run, "tree string, subroot binary, path binary"))


PROOFS = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")


def proofs(of: Manifest) -> DataFrame:
    """A row per leaf: the hash of its proof, and the root that its leaf, for some rows a tampered one, folds to."""
    apex = roots(of.top).select("tree", F.col("root").alias("subroot"), F.lit(b"").alias("path"))
    paths = stored(source_paths(lowest_with_paths(of.top, apex)), "paths")
    root = of.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row["nodes"], row["n"], lifts(row["total"]))
            above = unpacked(row["path"])
            of_above = "".join(left + right for left, right in above)
            # What leaves of one block fold to beyond it depends on the block's root alone.
            beyond: dict[str, str] = {}
            columns = {name.split()[0]: [] for name in PROOFS.split(", ")}
            for i, item in enumerate(row["items"]):
                own = list(block.siblings(i))
                leaf = block.node(block.levels, i)
                start = leaf if item["changed"] is None else item["changed"].hex()
                end = folded(start, own)
                if end not in beyond:
                    beyond[end] = folded(end, above)
                end = beyond[end]
                proof = "".join(left + right for left, right in own) + of_above
                for name, value in zip(columns, (item["doc_id"], leaf, row["subroot"].hex(), root,
                                                 digest(proof).hex(), end, end == root)):
                    columns[name].append(value)
            yield pa.record_batch([pa.array(columns["doc_id"], pa.int64()),
                                   *(pa.array(columns[name], pa.string()) for name in list(columns)[1:-1]),
                                   pa.array(columns["verified"], pa.bool_())], names=list(columns))

    return (lowest_with_paths(of.sources, paths).select("total", "n", "nodes", "items", "subroot", "path")
            .mapInArrow(run, PROOFS))


def report(docs: DataFrame) -> DataFrame:
    """Every row of docs as a leaf of the manifest, with its proof checked; see `manifest` and `proofs`.

    Null columns count as such, empty texts as empty; a null doc_id is a leaf that isn't tampered with. Repeated
    rows are leaves side by side. An empty table gives no rows.
    """
    return proofs(manifest(docs))
