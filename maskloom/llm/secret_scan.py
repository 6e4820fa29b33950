"""Secrets: fixed patterns, and strings in sensitive places that a primed compressor finds new."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from maskloom.llm.common import Span, apart_from, digest, joined

#: Base kinds in the order of the report, then what the method adds.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "novel")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")
_SENSITIVE = re.compile("pass|secret|token|key|auth|bearer|credential|private|signature|session|pwd", re.I | re.A)
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.~-])[A-Za-z0-9+/_=.~-]{16,}")
#: A line of a list, of a wrapped value or of a key block: nothing, or one long string with the marks around it.
_ENTRY = re.compile(r"""[\x20\t]*+(?:[-*][\x20\t]++)?["'`(\[{<]*+(?:[A-Za-z0-9+/_=.~-]{16,}+["'`)\]}>,;]*+)?[\x20\t\r\\]*+""")
#: Characters on either side of a candidate that prime the compressor: the code around it.
SURROUNDINGS = 1024
#: The identifier dictionary: names left of = or :, the commonest of the corpus.
IDENTIFIER, IDENTIFIERS = r"""([A-Za-z_][A-Za-z0-9_.-]{2,40})["']?\x20*[:=]""", 1000
#: Marginal compressed bytes per character from which a candidate is new.
NOVELTY = 0.7


def identifier_dictionary(docs: DataFrame) -> bytes:
    """The IDENTIFIERS commonest names of the corpus, counted over all texts, commonest last."""
    names = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(IDENTIFIER), 1)).alias("name"))
    top = (names.groupBy("name").agg(F.count("*").alias("n"))
           .orderBy(F.desc("n"), "name").limit(IDENTIFIERS).collect())
    return "\n".join(r["name"] for r in reversed(top)).encode()


def base_spans(text: str) -> list[Span]:
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def marginal_bytes(candidate: str, surroundings: str, identifiers: bytes) -> int:
    """What the candidate adds to a frame that knows its surroundings and the identifiers already."""
    primer = identifiers + b"\n" + surroundings.encode()
    known = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_checksum=False)
    return len(press.compress(candidate.encode())) - len(press.compress(b""))


def candidate_places(text: str) -> list[tuple[int, int]]:
    """Long strings of mixed characters in a sensitive place, in the order of the text.

    Such a place goes from a sensitive word to the end of its line, and on over the lines after it as
    long as these are empty or hold one long string only: wrapped values, key blocks, lists. Time grows with the text.
    """
    places, at, inside = [], 0, False
    for line in text.split("\n"):
        word = _SENSITIVE.search(line)
        inside = word is not None or inside and _ENTRY.fullmatch(line) is not None
        if inside:
            for m in _CANDIDATE.finditer(line):
                # What follows a sensitive word, or is a line of its own after one.
                if (word is None or m.start() >= word.end()) and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
                    places.append((at + m.start(), at + m.end()))
        at += len(line) + 1
    return places


def novel_spans(text: str, identifiers: bytes) -> list[Span]:
    found = []
    for start, end in candidate_places(text):
        around = text[max(0, start - SURROUNDINGS):start] + text[end:end + SURROUNDINGS]
        if marginal_bytes(text[start:end], around, identifiers) >= NOVELTY * (end - start):
            found.append(("novel", start, end))
    return found


REPORT = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def report(docs: DataFrame) -> DataFrame:
    """Per document the secrets of its whole text.

    Two passes: names are counted over the corpus for the dictionary (only the IDENTIFIERS
    commonest reach the driver), then each text is scanned on its own, without a shuffle.
    Whether a string in a sensitive place is reported is decided by its marginal bytes, wherever it stands there.
    A null text is empty and has none; repeated rows are reported as often as they stand; a
    null doc_id stays null; an empty table gives no rows; other columns are not read.
    """
    identifiers = identifier_dictionary(docs)
    order = lambda s: (s[1], KINDS.index(s[0]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base = base_spans(text or "")
                new = apart_from(novel_spans(text or "", identifiers), base)
                n = Counter(kind for kind, _, _ in base)
                rows.append((*(n[k] for k in BASE_KINDS), digest(sorted(base, key=order)),
                             joined(sorted(base + new, key=order)), len(new)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_novel"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, REPORT)
