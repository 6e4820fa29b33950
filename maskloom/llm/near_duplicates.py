"""Near duplicates: MinHash signatures in an LSH forest, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from maskloom.llm.common import stored, words
from maskloom.llm.components import components
from maskloom.llm.membership import perhaps_among

#: Orders of the forest, and hash values that two texts must at least share at the head of an order.
ORDERS, LEAST_DEPTH = 21, 3
VALUES = ORDERS * LEAST_DEPTH
#: Hash values by which an order sorts.
SORT_DEPTH = 6
#: Predecessors in an order that a text meets: all in a region of up to NEAR + 1 texts, CROWDED in a larger one.
NEAR, CROWDED = 12, 3
#: Hash values of all VALUES that must agree before the rest of a crowded region is compared on full sets:
#: of a pair of similarity 0.8 fewer agree with a probability under one in a million.
LEAST_AGREEING = 35
#: Texts of a crowded region that are compared with each other in one go: of those beside its main component, of all.
BLOCK_BESIDE, BLOCK_ALL = 128, 256
#: Two sets are linked where 100 * intersection >= PERCENT * union.
PERCENT = 80

_RANDOM = np.random.default_rng(20240607)
_XOR = _RANDOM.integers(0, 2 ** 64, VALUES, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2 ** 64, VALUES, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each `size` neighbouring words; one of all words, if they are fewer; none without words."""
    n = min(size, len(hashes))
    if not n:
        return np.zeros(0, np.uint64)
    h = hashes.view(np.uint64)
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k])
    return total


def flat_shingles(texts: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts in a row, and where each text's begin and end."""
    parts = [np.asarray(w, np.int64) for w in texts]
    n_words = np.array([len(p) for p in parts], np.int64)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(bounds[-1], np.uint64)
    long = np.flatnonzero(n_words >= size)
    if len(long):
        flat = np.concatenate([parts[i] for i in long])
        inside = np.ones(len(flat), bool)
        ends = np.cumsum(n_words[long])
        for k in range(1, size):
            inside[ends - k] = False
        place = np.repeat(bounds[long] - np.concatenate([[0], np.cumsum(n[long])[:-1]]), n[long]) + np.arange(n[long].sum())
        out[place] = shingle_hashes(flat, size)[inside[:len(flat) - size + 1]]
    for i in np.flatnonzero((n_words > 0) & (n_words < size)):
        out[bounds[i]] = shingle_hashes(parts[i], size)[0]
    return out, bounds


def hashed_words(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"),
                       F.transform(words(text), lambda w: F.xxhash64(w)).alias("w"))


SIGNED = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, signature binary"


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Per document the size of its shingle set, two hashes of the set, and its MinHash values."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                flat, bounds = flat_shingles(part["w"], size)
                some = np.flatnonzero(np.diff(bounds))
                values = np.zeros((len(part), VALUES), ">u4")
                if len(some):
                    for k in range(VALUES):
                        h = ((flat ^ _XOR[k]) * _TIMES[k]) >> np.uint64(32)
                        values[some, k] = np.minimum.reduceat(h, bounds[some])
                sets = [np.unique(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64").array, "text_hash": part["text_hash"].array,
                    "n_shingles": [len(s) for s in sets],
                    "set_a": [int(_mixed(s).sum(dtype=np.uint64).view(np.int64)) for s in sets],
                    "set_b": [int(_mixed(s ^ _XOR[0]).sum(dtype=np.uint64).view(np.int64)) for s in sets],
                    "signature": [v.tobytes() for v in values]})

    return hashed_words(docs).mapInPandas(run, SIGNED)


def region_rows(classes: DataFrame) -> DataFrame:
    """(region, key, rep) of each text in each order: key is what the order sorts by, region its head."""
    twice = F.concat("signature", "signature")
    order = F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1)))
    return (classes.select("rep", twice.alias("twice"), order.alias("k"))
            .select("rep", "k", F.expr(f"substring(twice, 1 + k * {4 * LEAST_DEPTH}, {4 * SORT_DEPTH})").alias("key"))
            .select(F.xxhash64("k", F.expr(f"substring(key, 1, {4 * LEAST_DEPTH})")).alias("region"), "key", "rep"))


def forest_neighbours(classes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, that stand near each other in some order, and in how many orders they do.

    Order k sorts the texts by their hash values from the k-th triple on. Texts that share
    the triple are a region; each meets those before it with which its common prefix is
    longest: in a crowded region that is deeper than in a sparse one. The sort splits a
    region over as many tasks as it needs; the rows at the tasks' edges meet afterwards.
    """
    rows = region_rows(classes)
    along = ["region", "key", "rep"]
    parts = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, *along).sortWithinPartitions(*along)
    schema = "a long, b long, region long, key binary, rep long"

    def meet(batches: Iterator[pd.DataFrame], edges: bool) -> Iterator[pd.DataFrame]:
        carried, first = None, True
        for batch in batches:
            rows = batch if carried is None else pd.concat([carried, batch], ignore_index=True)
            new = 0 if carried is None else len(carried)
            region, rep = rows["region"].to_numpy(), rows["rep"].to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
            n_in_region = np.repeat(np.diff(np.append(heads, len(region))), np.diff(np.append(heads, len(region))))
            since = np.arange(len(region)) - np.repeat(heads, np.diff(np.append(heads, len(region))))
            found = []
            for back in range(1, NEAR + 1):
                at = np.arange(max(new, back), len(region))
                near = (since[at] >= back) & ((back <= CROWDED) | (n_in_region[at] <= NEAR + 1))
                at = at[near & (rep[at] != rep[at - back])]
                found.append(np.stack([np.minimum(rep[at], rep[at - back]), np.maximum(rep[at], rep[at - back])]))
            a, b = np.concatenate(found, axis=1)
            out = pd.DataFrame({"a": a, "b": b})
            if len(out):
                yield out.assign(region=pd.array([None] * len(out), "Int64"), key=None,
                                 rep=pd.array([None] * len(out), "Int64"))
            if edges and first:
                yield _edge(rows.head(NEAR))
            carried, first = rows.tail(NEAR), False
        if edges and carried is not None:
            yield _edge(carried)

    def _edge(rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.array([None] * len(rows), "Int64")
        return pd.DataFrame({"a": none, "b": none, "region": rows["region"].array, "key": rows["key"].array,
                             "rep": rows["rep"].array})

    met = stored(ordered.mapInPandas(lambda batches: meet(batches, True), schema), "forest")
    # A few rows for each task above, so one task is enough.
    edges = (met.where(F.col("a").isNull()).select(*along).coalesce(1).sortWithinPartitions(*along)
             .mapInPandas(lambda batches: meet(batches, False), schema))
    pairs = met.where(F.col("a").isNotNull()).select("a", "b").unionAll(edges.select("a", "b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("orders"))


def rest_of_crowded(classes: DataFrame, so_far: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) between different components that share a crowded region.

    Of two such texts one at least is not in the region's main component. Those beside it are
    compared with all texts of the regions with that main component: in blocks, so that no task
    gets all of them, by signature first and then on full sets, so that only links leave a task.
    """
    rows = region_rows(classes).select("region", "rep")
    crowded = rows.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") > NEAR + 1)
    named = (rows.join(crowded, "region").join(so_far.withColumnRenamed("node", "rep"), "rep", "left")
             .select("region", "rep", F.coalesce("component", "rep").alias("component")))
    shares = stored(named.groupBy("region", "component").agg(F.count("*").alias("m")), "shares")
    mixed = stored(shares.groupBy("region").agg(F.max(F.struct("m", "component"))["component"].alias("main"),
                                                F.count("*").alias("parts")).where("parts > 1"), "mixed")
    # A text stands once for each main component, however many regions it shares with it.
    inside = (named.join(mixed, "region").select("main", "rep", "component").distinct()
              .join(classes.select("rep", "signature"), "rep").join(sets.hint("merge"), "rep"))
    inside = stored(inside, "inside")
    beside = F.col("component") != F.col("main")
    sizes = stored(inside.groupBy("main").agg(
        F.ceil(F.count_if(beside) / BLOCK_BESIDE).alias("blocks_beside"),
        F.ceil(F.count("*") / BLOCK_ALL).alias("blocks")), "sizes")
    dealt = inside.join(sizes, "main")

    def blocks(df: DataFrame, block: str, *names: str) -> DataFrame:
        share = F.pmod(F.xxhash64("rep"), F.col(block)).alias("block")
        return (df.select("main", "blocks", share, "rep", "component", "signature", "shingles")
                .groupBy("main", "blocks", "block")
                .agg(*(F.collect_list(c).alias(name)
                       for c, name in zip(("rep", "component", "signature", "shingles"), names))))

    few = blocks(dealt.where(beside), "blocks_beside", "a", "ca", "sa", "wa")
    few = few.select("main", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
                     "a", "ca", "sa", "wa")
    all_ = blocks(dealt, "blocks", "b", "cb", "sb", "wb").drop("blocks")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x, y = (np.frombuffer(b"".join(s), ">u4").reshape(-1, VALUES) for s in (row.sa, row.sb))
                agree = np.zeros((len(x), len(y)), np.uint8)
                for k in range(VALUES):
                    agree += x[:, k, None] == y[None, :, k]
                likely = agree >= LEAST_AGREEING
                likely &= np.asarray(row.ca)[:, None] != np.asarray(row.cb)[None, :]
                wa, wb = ([np.frombuffer(w, np.uint64) for w in ws] for ws in (row.wa, row.wb))
                found = [(min(row.a[i], row.b[j]), max(row.a[i], row.b[j])) for i, j in zip(*np.nonzero(likely))
                         if row.a[i] != row.b[j] and are_linked(wa[i], wb[j])]
                yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return few.join(all_, ["main", "block"]).drop("main", "block").mapInPandas(compare, "a long, b long").distinct()


def are_linked(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if not len(s) or not len(t) or 100 * min(len(s), len(t)) < PERCENT * max(len(s), len(t)):
        return False
    merged = np.sort(np.concatenate([s, t]), kind="stable")
    shared = int((merged[1:] == merged[:-1]).sum())
    return 100 * shared >= PERCENT * (len(merged) - shared)


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, shingles) of the wanted documents, computed again from their texts. wanted: doc_id, text_hash."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flat, bounds = flat_shingles(batch["w"], size)
            yield pd.DataFrame({"rep": batch["doc_id"].array,
                                "shingles": [np.unique(flat[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]})

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    near = keyed.where(perhaps_among(wanted, "doc_id", "text_hash"))
    needed = near.join(wanted.hint("merge"), ["doc_id", "text_hash"], "left_semi")
    return hashed_words(needed).mapInPandas(run, "rep long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = [are_linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y)]
        return pd.Series(out, dtype=bool)

    left, right = (sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.where(linked("sa", "sb")).select("a", "b").distinct()


def links(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """Components (node, component) of the linked classes.

    Each text's most promising pairs are confirmed first; of the rest only those between
    different components then matter, so large groups of near copies cost few comparisons. What
    a crowded region has left between different components comes last.
    """
    pairs = stored(forest_neighbours(classes), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = stored(classes.join(nodes, "rep", "left_semi").select(F.col("rep").alias("doc_id"), "text_hash").distinct(), "wanted")
    sets = stored(shingle_sets(docs, wanted, size), "sets")
    best = F.struct("orders", (-F.col("a") - F.col("b")).alias("lower"), "a", "b")
    # Many texts share the smallest that they met: a link with it makes paths short, which costs few rounds.
    smallest = F.min_by(F.struct("a", "b"), F.when(F.col("orders") > 1, F.col("a")))
    first = (pairs.groupBy("b").agg(F.array_compact(F.array(F.max(best).dropFields("orders", "lower"), smallest)).alias("p"))
             .select(F.explode("p").alias("p")).select("p.a", "p.b"))
    second = pairs.groupBy("a").agg(F.max(best).alias("p")).select("p.a", "p.b")
    chosen = stored(first.union(second).distinct(), "chosen")
    found = stored(confirmed(chosen, sets), "links")
    so_far = components(found)
    by = lambda c: so_far.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    rest = pairs.join(chosen, ["a", "b"], "left_anti").join(by("a"), "a", "left").join(by("b"), "b", "left")
    apart = stored(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "apart")
    ends = stored(apart.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "ends")
    more = stored(confirmed(apart, sets.join(ends, "rep", "left_semi")), "links")
    edges = so_far.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)
    last = stored(rest_of_crowded(classes, components(edges), sets), "links")
    return components(edges.unionAll(last))


def decided(docs: DataFrame, size: int) -> DataFrame:
    """report() with text_hash, the hash of each row's text."""
    signed = stored(signatures(docs, size), "signatures")
    usable = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    smallest = F.min(F.struct("doc_id", "text_hash"))
    classes = stored(usable.groupBy("set_a", "set_b").agg(smallest.alias("m"), F.min("signature").alias("signature"))
                     .select("set_a", "set_b", F.col("m.doc_id").alias("rep"), F.col("m.text_hash").alias("text_hash"),
                             "signature"), "classes")
    found = links(docs, classes, size)
    named = (classes.select("set_a", "set_b", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
             .select("set_a", "set_b", F.coalesce("component", "rep").alias("component")))
    out = signed.drop("signature").join(named, ["set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return (out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def report(docs: DataFrame, size: int = 5) -> DataFrame:
    """Per document the size of its shingle set and the component of near duplicates that it is in.

    Documents with equal sets are one class, which is one row in all that follows; links
    between different sets are sought in the forest and confirmed on full sets. A pair of
    similarity 0.8 shares no region with probability (1 - 0.8^3)^21, under one in a million.

    Null texts, empty texts and those without words have no shingles and are linked with
    nothing; repeated rows are equal sets; classes with the same smallest doc_id count as
    linked; a null doc_id is linked with nothing, has no component and is kept; an empty table
    gives no rows; other columns are not read.
    """
    return decided(docs, size).drop("text_hash")


def one_of_each(docs: DataFrame, size: int = 5) -> DataFrame:
    """The documents, unchanged, without near duplicates: of each component the smallest doc_id stays, once.

    Rows without doc_id stay; so do different texts of one doc_id. Only rows that may be
    among those that go or that stand in the table twice are joined; all others pass without
    a shuffle.
    """
    known = stored(decided(docs, size), "decided").where(F.col("doc_id").isNotNull())
    # What isn't one row that stays: doc_id, text_hash, and whether one of the rows stays.
    unsettled = stored(known.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.max("kept").alias("stays"))
                       .where((F.col("n") > 1) | ~F.col("stays")).select("doc_id", "text_hash", "stays"), "unsettled")
    key = ["doc_id", "text_hash"]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    perhaps = F.col("doc_id").isNotNull() & perhaps_among(unsettled, *key)
    met = rows.where(perhaps)
    free = met.join(unsettled.hint("merge"), key, "left_anti")
    once = met.join(unsettled.where("stays").hint("merge"), key, "left_semi").dropDuplicates(key)
    return rows.where(~perhaps).unionAll(free.select(rows.columns)).unionAll(once.select(rows.columns)).select("row.*")
