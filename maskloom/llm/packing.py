"""Packing token sequences by non-negative least squares over length combinations."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from maskloom.llm.common import stored

#: Tokens of a sequence, the id that ends each document, and pieces packed together in one task.
WINDOW, END_ID, SHARD_PIECES = 4096, 2, 4096
#: Length classes of the histogram, pieces in a combination at most, words whose ids are kept at a time.
CLASSES, DEPTH, MEMO_WORDS = 64, 4, 600_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts, encoded word by word and remembered.

    The vocabulary's pre-tokenizer never joins what white space parts, so the ids of a
    text are those of its words in a row. The memory is dropped when it is full.

    New words of plain Latin letters, ASCII digits and signs, for which the vocabulary's rules
    come to lower case and a split by PLAIN_PARTS, are merged by the quicker of the two public
    BPE libraries over the same merges; the vocabulary's own library encodes all others. In
    the quick merges the byte 0xFF, which no text holds, stands for the end of a word.
    """

    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    PLAIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, tokenizer_path: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        special = set(self.tokenizer.get_added_tokens_decoder())
        shown = {}  # the byte that each letter of the vocabulary's alphabet stands for
        for byte in range(256):
            shown[self._shown(byte)] = byte
        assert set(shown) == set(pre_tokenizers.ByteLevel.alphabet())
        ranks = {}
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if number not in special:
                word, end = (token[:-4], b"\xff") if token.endswith("</w>") else (token, b"")
                ranks[bytes(shown[c] for c in word) + end] = number
        self.merge = tiktoken.Encoding("plain", pat_str=r"\S+", mergeable_ranks=ranks,
                                       special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def _shown(byte: int) -> str:
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return chr(byte) if byte in printable else chr(256 + byte - sum(p < byte for p in printable))

    def encode_word(self, word: str) -> list[int]:
        if not self.PLAIN.fullmatch(word) or "<|" in word:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        ids: list[int] = []
        for part in self.PLAIN_PARTS.findall(word.lower()):
            ids += self.merge(part.encode() + b"\xff")
        return ids

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers, END_ID last."""
        end = struct.pack("<I", END_ID)
        for text in texts:
            parts = (text or "").encode().split()  # of bytes: at white space of ASCII only
            if len(self.known) > MEMO_WORDS:
                self.known = {}
            known = self.known
            for word in parts:
                if word not in known:
                    ids = self.encode_word(word.decode())
                    known[word] = struct.pack(f"<{len(ids)}I", *ids)
            yield b"".join(map(known.__getitem__, parts)) + end


def cut(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """A row per piece: documents are cut at every multiple of WINDOW of their ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordIds(tokenizer_path)
        for batch in batches:
            rows = []
            ids_of = zip(batch["doc_id"].array, encoder.encode(batch["text"].tolist()))
            for doc_id, ids in ids_of:
                total = len(ids) // 4
                for start in range(0, total, WINDOW):
                    piece = ids[4 * start:4 * (start + WINDOW)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
            frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, PIECES)


def length_combinations(classes: int = CLASSES, depth: int = DEPTH) -> np.ndarray:
    """A row per way to fill a window with at most `depth` pieces: how many of each length class.

    A class c holds lengths up to c + 1 shares of the window, so the classes of a
    combination are those whose upper ends add up to the window.
    """
    rows = []
    for n in range(2, depth + 1):
        for parts in combinations_with_replacement(range(1, classes), n - 1):
            last = classes - sum(parts)
            if last >= parts[-1]:
                rows.append(np.bincount([*(p - 1 for p in parts), last - 1], minlength=classes))
    return np.array(rows, dtype=float)


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 with a @ x close to b, by accelerated projected gradient steps."""
    x = y = np.zeros(a.shape[1])
    rate, t = 1 / max(np.linalg.norm(a, 2) ** 2, 1e-9), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * (a.T @ (a @ y - b)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / t_new * (new - x), t_new
    return x


def _longest_within(by_class: list[list[int]], lengths: np.ndarray, most: int, step: int) -> int:
    """Takes out the longest piece of at most `most` tokens, of which there is one."""
    for c in range((most - 1) // step, -1, -1):
        place = bisect_right(by_class[c], most, key=lambda i: lengths[i])
        if place:
            return by_class[c].pop(place - 1)
    raise ValueError("no piece is that short")


def pack_lengths(lengths: np.ndarray, window: int = WINDOW, classes: int = CLASSES) -> list[list[int]]:
    """Sequences as lists of indexes into lengths; none is longer than the window.

    Repeat counts of the combinations are solved against the histogram and rounded
    down; the last piece of each is the longest that fits. What is left is put, longest first, where it leaves the least room.
    """
    step = window // classes
    kind = (lengths - 1) // step
    by_class: list[list[int]] = [[] for _ in range(classes)]
    for i in np.argsort(lengths, kind="stable"):
        by_class[kind[i]].append(int(i))
    sequences = [[i] for i in by_class[-1]]
    by_class[-1] = []
    combos = length_combinations(classes)
    repeats = non_negative_least_squares(combos.T, np.array([len(c) for c in by_class], dtype=float))
    for n in np.argsort(-repeats, kind="stable"):
        need = [c for c, k in enumerate(combos[n]) for _ in range(int(k))]
        for _ in range(int(repeats[n])):
            if any(len(by_class[c]) < need.count(c) for c in need):
                break
            members = [by_class[c].pop() for c in need[1:]]
            left = window - int(lengths[members].sum())
            members.append(_longest_within(by_class, lengths, left, step))
            sequences.append(members)
    room: dict[int, list[int]] = defaultdict(list)
    free = 0
    for n, members in enumerate(sequences):
        left = window - int(lengths[members].sum())
        if left:
            room[left].append(n)
            free |= 1 << left
    rest = sorted((i for c in by_class for i in c), key=lambda i: (-lengths[i], i))
    for i in rest:
        size = int(lengths[i])
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            n = room[left].pop()
            if not room[left]:
                free ^= 1 << left
            sequences[n].append(i)
        else:
            n, left = len(sequences), window
            sequences.append([i])
        if left > size:
            room[left - size].append(n)
            free |= 1 << (left - size)
    return sequences


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Every document's ids in sequences of at most WINDOW tokens, a row per piece.

    Pieces are written once, then packed in shards of about SHARD_PIECES pieces: a shard
    is one task whatever the table's size, and each loses one part-filled sequence or so.
    Rows are dealt to shards by their place in the table, so no key is ever hot.

    Null texts are empty: one piece holding only the end id. Repeated rows are packed as
    often as they stand; a null doc_id stays null; an empty table gives no rows; other
    columns are not read.
    """
    pieces = stored(cut(docs, tokenizer_path), "pieces")
    shards = max(1, -(-pieces.count() // SHARD_PIECES))

    def pack_shard(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "start", "ids_crc32", "length"], kind="stable").reset_index(drop=True)
        lengths = shard["length"].to_numpy()
        sequence, offset = np.zeros(len(shard), np.int64), np.zeros(len(shard), np.int64)
        for n, members in enumerate(pack_lengths(lengths)):
            sequence[members] = (key[0] << 32) + n
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        return shard.drop(columns="shard").assign(sequence_id=sequence, offset=offset)

    place = F.monotonically_increasing_id()
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(place), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInPandas(pack_shard, PACKED)
