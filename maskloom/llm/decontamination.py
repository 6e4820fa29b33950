"""Benchmark passages in documents: SimHash of windows, Hamming blocks, exact weighted shingles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from maskloom.llm.common import NON_WORD, stored, words

SHINGLE, SIMILARITY = 5, 0.8
#: Windows start at every STRIDE-th word of a text; an item has a fingerprint for each way to lie against them.
STRIDE = 4
#: Hamming distance up to which no fingerprint is missed: 4 blocks of 16 bits, one of them with RADIUS // 4 flips at most.
RADIUS, BLOCKS = 7, 4
#: Words of the short windows of an item, one from each of its words on: PART + STRIDE - 1 words in a row are never
#: missed. Items under LEAST_PARTED words have as whole windows all that SIMILARITY allows for.
PART, LEAST_PARTED = 8, 9
#: Benchmark items that one pass over the documents looks for; more items take more passes.
ITEMS_PER_PASS = 5_000
#: Words that may stand between two neighbouring parts of an item for them to be one passage.
LARGEST_INSERTION = 256
#: Words of text whose bits are summed at a time.
CHUNK = 1 << 16


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words, case and ASCII punctuation aside."""
    return F.transform(words(F.lower(text), NON_WORD), lambda w: F.xxhash64(w))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Distinct hashes of SHINGLE neighbouring words; of all words, if they are fewer."""
    n = min(SHINGLE, len(hashes))
    if not n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = (total ^ hashes[k:len(hashes) - n + 1 + k].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total)


def window_class(n_words: int) -> tuple[int, int]:
    """Words of an item's window and the stride of windows of that class: the window lies inside the item at any phase."""
    room = n_words - STRIDE + 1
    if room < 2 * STRIDE:
        return n_words, 1
    size = 2 * STRIDE
    while size + max(STRIDE, size // 3 // STRIDE * STRIDE) <= room:
        size += max(STRIDE, size // 3 // STRIDE * STRIDE)
    return size, STRIDE


def _running(hashes: np.ndarray, stride: int, kind: type) -> np.ndarray:
    """Sums of each bit over the words up to each multiple of `stride`."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1)
    whole = len(hashes) // stride * stride
    steps = bits[:whole].reshape(-1, stride, 64).sum(axis=1, dtype=kind)
    return np.concatenate([np.zeros((1, 64), kind), np.cumsum(steps, axis=0, dtype=kind)])


def _kind(size: int) -> type:
    return np.uint8 if size < 256 else np.uint32  # differences of sums that wrap around stay right


def fingerprints(hashes: np.ndarray, size: int, stride: int, running: np.ndarray | None = None) -> np.ndarray:
    """SimHash of the windows of `size` words that start at each multiple of `stride`: a bit is set if most words set it."""
    starts = len(hashes) - size
    if starts < 0:
        return np.zeros(0, np.uint64)
    running = _running(hashes, stride, _kind(size)) if running is None else running
    n = starts // stride + 1
    counts = running[size // stride:][:n] - running[:n]
    return np.packbits(counts > size // 2, axis=1).view(np.uint64).ravel()


def shingle_spread(items: Iterable[np.ndarray]) -> Counter:
    """How many items have each shingle."""
    return Counter(s for w in items for s in shingles(w).tolist())


class Benchmark:
    """The items' fingerprints by window class, indexed by each block with its allowed flips, and their weighted shingles."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], spread: Counter | None = None):
        """spread: how many items have each shingle, where there are more items than these."""
        self.items = [(i, w) for i, w in items if len(w)]
        sets = [shingles(w) for _, w in self.items]
        spread = shingle_spread(w for _, w in self.items) if spread is None else spread
        # A shingle that several items share tells less about each of them.
        self.weights = [dict(zip(found.tolist(), (1 / spread[s] for s in found.tolist()))) for found in sets]
        self.totals = [sum(w.values()) for w in self.weights]
        parts: dict[int, list[tuple[int, int, int]]] = {}
        members: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for n, (_, w) in enumerate(self.items):
            size, stride = window_class(len(w))
            marks = fingerprints(w, size, 1)[:stride]
            members.setdefault((size, stride), []).extend((int(m), n, at) for at, m in enumerate(marks))
            if len(w) >= LEAST_PARTED:
                parts.setdefault(STRIDE if len(w) >= PART + STRIDE else 1, []).extend(
                    (int(m), n, at) for at, m in enumerate(fingerprints(w, PART, 1)))
        self.classes = {key: self._indexed(found) for key, found in members.items()}
        self.parts = {stride: (np.array([m for m, _, _ in found], np.uint64), np.array([f[1:] for f in found], np.int64))
                      for stride, found in ((stride, sorted(found)) for stride, found in parts.items())}

    @staticmethod
    def _indexed(found: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        marks = np.array([m for m, _, _ in found], np.uint64)
        places = np.array([(n, at) for _, n, at in found], np.int64)
        flips = np.array([0, *(1 << b for b in range(16))], np.uint64)
        tables = []
        for block in range(BLOCKS):
            part = (marks >> np.uint64(16 * block)) & np.uint64(0xFFFF)
            keys = (part[:, None] ^ flips).ravel().astype(np.int64)
            order = np.argsort(keys, kind="stable")
            starts = np.searchsorted(keys[order], np.arange(65537))
            tables.append((starts, np.repeat(np.arange(len(marks)), len(flips))[order]))
        return marks, places, tables

    def find(self, hashes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(row, item, first word, end word, similarity) of the items in texts that lie one after another in hashes.

        ends: where each text ends. A window across two texts is compared like any other and then
        cut to the text that it starts in or ends in.
        """
        seen: set[tuple[int, int, int]] = set()

        def met(at: int, size: int, stride: int, windows: np.ndarray, found: np.ndarray) -> None:
            for w, (item, offset) in zip(windows.tolist(), found.tolist()):
                start = at + w * stride
                row = int(np.searchsorted(ends, start, side="right"))
                if start + size <= ends[row]:
                    seen.add((row, item, start - offset))

        sizes = [*self.classes, *((PART, stride) for stride in self.parts)]
        for at in range(0, len(hashes), CHUNK):
            # The sums of bits are the same for all sizes of a stride.
            longest: dict[tuple[int, type], int] = {}
            for size, stride in sizes:
                key = stride, _kind(size)
                longest[key] = max(longest.get(key, 0), size)
            sums = {key: _running(hashes[at:at + CHUNK + size - 1], *key) for key, size in longest.items()}

            def marked(size: int, stride: int) -> np.ndarray:
                return fingerprints(hashes[at:at + CHUNK + size - 1], size, stride,
                                    sums[stride, _kind(size)])[:CHUNK // stride]

            for (size, stride), (marks, places, tables) in self.classes.items():
                windows = marked(size, stride)
                for block, (starts, listed) in enumerate(tables):
                    part = ((windows >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
                    first, n = starts[part], starts[part + 1] - starts[part]
                    hit = np.flatnonzero(n)
                    if not len(hit):
                        continue
                    n = n[hit]
                    window = np.repeat(hit, n)
                    mark = listed[np.repeat(first[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                    near = np.bitwise_count(windows[window] ^ marks[mark]) <= RADIUS
                    met(at, size, stride, window[near], places[mark[near]])
            for stride, (marks, places) in self.parts.items():
                windows = marked(PART, stride)
                first = np.searchsorted(marks, windows)
                n = np.searchsorted(marks, windows, side="right") - first
                hit = np.flatnonzero(n)
                first, n = first[hit], n[hit]
                mark = np.repeat(first - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
                met(at, PART, stride, np.repeat(hit, n), places[mark])
        return self._verified(hashes, ends, seen)

    def _verified(self, hashes: np.ndarray, ends: np.ndarray,
                  seen: set[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
        found = []
        for (row, item), places in groupby(sorted(seen), key=lambda at: at[:2]):
            low, high = (int(ends[row - 1]) if row else 0), int(ends[row])
            starts = np.array([start for _, _, start in places])
            best = max((self._share(hashes, low, high, item, start, start) for start in starts.tolist()), key=lambda at: (at[0], -at[1]))
            if best[0] < SIMILARITY:  # words may have been put in: parts near each other are one passage
                near = np.split(starts, np.flatnonzero(np.diff(starts) > LARGEST_INSERTION) + 1)
                best = max((self._share(hashes, low, high, item, int(part[0]), int(part[-1])) for part in near),
                           key=lambda at: (at[0], -at[1]))
            if best[0] >= SIMILARITY:
                found.append((row, item, best[1] - low, best[2] - low, best[0]))
        return found

    def _share(self, hashes: np.ndarray, low: int, high: int, item: int, first: int, last: int) -> tuple[float, int, int]:
        """The share of the item's shingles in the words that it would take if it began at places from first to last."""
        n = len(self.items[item][1])
        slack = max(2, n // 8)
        start, end = max(low, first), min(high, last + n)
        if n < SHINGLE:
            return float(np.array_equal(hashes[start:start + n], self.items[item][1])), start, min(high, start + n)
        weights = self.weights[item]
        words = hashes[max(low, first - slack):min(high, last + n + slack)]
        return sum(weights.get(s, 0.0) for s in shingles(words).tolist()) / self.totals[item], start, end


def benchmark_passes(items: DataFrame) -> Iterator[Benchmark]:
    """The items, ITEMS_PER_PASS or so at a time: the driver holds those of one pass only.

    How many items have a shingle is counted over all of them in Spark.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(s=[shingles(np.asarray(w, np.int64)).view(np.int64) for w in batch["w"]])

    rows = stored(items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long"),
                               word_hashes(F.col("text")).alias("w")).where(F.size("w") > 0)
                  .mapInPandas(cut, "row long, item_id long, w array<long>, s array<long>"), "items")
    shared = rows.select("row", F.explode("s").alias("s"))
    spread = (shared.join(shared.groupBy("s").agg(F.count("*").alias("n")), "s")
              .groupBy("row").agg(F.collect_list(F.struct("s", "n")).alias("spread")))
    n = max(1, -(-rows.count() // ITEMS_PER_PASS))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("row"), F.lit(n)) == k).drop("s").join(spread, "row").collect()
        if part or not k:
            counts = {int(s) & (1 << 64) - 1: c for r in part for s, c in r["spread"]}
            yield Benchmark([(r["item_id"], np.array(r["w"], np.int64)) for r in part], Counter(counts))


def _flat(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.asarray(w, np.int64) for w in texts]
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.cumsum([len(p) for p in parts])


LEAKS = "doc_id long, item_id long, first_word long, end_word long, similarity double"


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each benchmark item that stands in a document, at its best place.

    Similarity is the weighted share of the item's 5-word shingles in the place found;
    SIMILARITY is asked. Of equally good places the earliest is reported. Where no place alone
    has enough, parts of the item LARGEST_INSERTION words or less apart are one passage, from the first to the
    last. Null, empty and wordless texts and items never match, items of
    fewer words match as a whole; repeated rows are reported as often as they stand; a null id
    stays null; empty tables give no rows; other columns are not read.
    """
    def search(benchmark: Benchmark) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = benchmark.find(*_flat(batch["w"]))
                if found:
                    rows, which, first, end, share = zip(*found)
                    yield pd.DataFrame({
                        "doc_id": batch["doc_id"].astype("Int64").iloc[list(rows)].array,
                        "item_id": pd.array([benchmark.items[i][0] for i in which], "Int64"),
                        "first_word": first, "end_word": end, "similarity": share})

        return hashed.mapInPandas(run, LEAKS)

    hashed = docs.select(F.col("doc_id").cast("long"), word_hashes(F.col("text")).alias("w"))
    passes = benchmark_passes(items)
    first, second = next(passes), next(passes, None)
    if second is None:
        return search(first)
    # Words are hashed once for all passes, and what a pass found is written before the next one's items come.
    hashed = stored(hashed, "words")
    return reduce(DataFrame.unionAll, [stored(search(b), "leaks") for b in chain([first, second], passes)])


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no benchmark item stands, unchanged.

    Null, empty and repeated rows are judged as in `leaks`; without items all documents stay; an empty table
    stays empty.
    """
    def without(benchmark: Benchmark, docs: DataFrame) -> DataFrame:
        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            out = np.ones(len(texts), bool)
            out[[row for row, *_ in benchmark.find(*_flat(texts))]] = False
            return pd.Series(out)

        return docs.where(clean(word_hashes(F.col("text"))))

    for benchmark in benchmark_passes(items):
        docs = without(benchmark, docs)
    return docs
