"""Personal data: weak labelers vote, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from maskloom.llm.common import Span, apart_from, digest, joined

#: Base kinds first; the rest only the method reports.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "local_phone", "national_id", "iban", "person")
LABELERS = ("format", "gazetteer", "context", "counter_context", "boundary", "shape")
CONTEXT_CHARS, THRESHOLD = 40, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_PERSON = re.compile(r"(?:Mrs?|Ms|Mme|Dr|Prof|Herr|Frau|Sra?|Señora?)\.? [A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)?")

_TOP_DOMAINS = frozenset("com org net edu gov io info biz de fr es it uk us ca jp eu ch at nl example test".split())
_GIVEN = frozenset("James John Robert Michael William David Mary Patricia Jennifer Linda Elizabeth Anna Hans "
                   "Peter Klaus Ursula Marie Jean Pierre Louis Camille Maria Carmen Jose Juan Carlos Lucia".split())
_COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE TR".split())
_FOR = {
    "email": re.compile(r"mail|contact|write|reach|@", re.I),
    "ip": re.compile(r"\bip\b|host|address|server|client|login|from", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|payment", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|cell|fax|contact", re.I),
    "local_phone": re.compile(r"phone|tel|call|mobile|cell|fax|contact", re.I),
    "national_id": re.compile(r"ssn|social|national|tax id", re.I),
    "iban": re.compile(r"iban|bank|account|konto|transfer", re.I),
    "person": re.compile(r"name|contact|signed|author|dear|patient|customer", re.I),
}
_AGAINST = re.compile(r"version|release|build|isbn|issn|order|serial|article|page|revision|commit|price", re.I)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # A match is the longest run of local characters before an @, however long the text is.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _is_ip(found: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in found.split("."))


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Everything that looks like personal data: kind, start, end, and whether it is valid by its kind's rule."""
    found = [("email", *span, True) for span in _emails(text)]
    for m in _IP.finditer(text):
        found.append(("ip", *m.span(), _is_ip(m[0])))
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if len(m[0]) > 8 else ""
        if len(digits) > 8:
            found.append(("card", *m.span(), 13 <= len(digits) <= 19 and passes_luhn(digits)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            found.append(("phone", *m.span(), 9 <= len(_digits(m[0])) <= 15))
    for m in _LOCAL_PHONE.finditer(text):
        found.append(("local_phone", *m.span(), True))
    for m in _NATIONAL_ID.finditer(text):
        area = m[0][:3]
        found.append(("national_id", *m.span(), area not in ("000", "666") and area < "900"))
    for m in _IBAN.finditer(text):
        number = m[0][4:] + m[0][:4]
        found.append(("iban", *m.span(), int("".join(str(int(c, 36)) for c in number)) % 97 == 1))
    for m in _PERSON.finditer(text):
        if not text[max(0, m.start() - 1):m.start()].isalnum():
            found.append(("person", *m.span(), True))
    return found


def _gazetteer(kind: str, found: str) -> int:
    if kind == "email":
        return 1 if found.rsplit(".", 1)[-1].lower() in _TOP_DOMAINS else -1
    if kind == "ip":
        return -1 if found.split(".", 1)[0] in ("0", "127", "255") else 0
    if kind == "card":
        return 1 if re.match("4|5[1-5]|2[2-7]|3[47]|35|6011|65", found) else -1
    if kind == "phone":
        return -1 if found[1] == "0" else 1
    if kind == "iban":
        return 1 if found[:2] in _COUNTRIES else -1
    if kind == "person":
        return 1 if _GIVEN.intersection(found.split()) else 0
    return 0


def pattern(text: str, kind: str, start: int, end: int, valid: bool) -> int:
    """Kind, votes and features of a candidate in one number; the labelers vote 0 (no), 1 (none), 2 (yes)."""
    found, before = text[start:end], text[max(0, start - CONTEXT_CHARS):start]
    left, right = text[start - 1:start], text[end:end + 1]
    inside = left.isalnum() or right.isalnum() or left in ("_", "/") or right in ("_", "/")
    digits = _digits(found)
    plain = len(set(digits)) <= 2 if digits else False
    votes = (2 if valid else 0, 1 + _gazetteer(kind, found), 2 if _FOR[kind].search(before) else 1,
             0 if _AGAINST.search(before) else 1, 0 if inside else 2, 0 if plain else 1)
    number = KINDS.index(kind)
    for vote in votes:
        number = number * 3 + vote
    return (number * 4 + min(3, len(found) // 10)) * 2 + ("\n" in before)


def _features(number: int) -> tuple[int, list[int], list[int]]:
    """Kind, votes and the other features of a pattern."""
    number, line = divmod(number, 2)
    number, length = divmod(number, 4)
    votes = []
    for _ in LABELERS:
        number, vote = divmod(number, 3)
        votes.append(vote)
    return number, votes[::-1], [length, line]


def _design(number: int) -> np.ndarray:
    kind, votes, (length, line) = _features(number)
    x = np.zeros(len(KINDS) + 3 * len(LABELERS) + 4 + 2)
    x[kind] = 1
    for i, vote in enumerate(votes):
        x[len(KINDS) + 3 * i + vote] = 1
    x[len(KINDS) + 3 * len(LABELERS) + length] = 1
    x[-2], x[-1] = line, 1
    return x


@dataclass
class PiiModel:
    """weights: of the span classifier; reliability: P(vote | personal or not) of each labeler."""
    weights: np.ndarray
    reliability: dict[str, np.ndarray] = field(default_factory=dict)
    prior: float = 0.5

    def probability(self, number: int) -> float:
        return float(1 / (1 + np.exp(-_design(number) @ self.weights)))


def fit_patterns(counts: dict[int, int], rounds: int = 50) -> PiiModel:
    """Two-class latent truth per candidate: EM over counted vote patterns, then logistic regression on its posteriors."""
    if not counts:
        return PiiModel(np.zeros(_design(0).size))
    numbers = sorted(counts)
    n = np.array([counts[k] for k in numbers], dtype=float)
    votes = np.array([_features(k)[1] for k in numbers])
    posterior = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))
    reliability: dict[str, np.ndarray] = {}
    prior = 0.5
    for _ in range(rounds):
        prior = float(np.clip((n * posterior).sum() / n.sum(), 0.01, 0.99))
        log = np.tile(np.log([1 - prior, prior]), (len(n), 1))
        for i, name in enumerate(LABELERS):
            table = np.array([[1 + (n * p * (votes[:, i] == v)).sum() for v in range(3)] for p in (1 - posterior, posterior)])
            reliability[name] = table / table.sum(axis=1, keepdims=True)
            log += np.log(reliability[name][:, votes[:, i]]).T
        posterior = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    x = np.array([_design(k) for k in numbers])
    w, share = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x.T * (share * p * (1 - p))) @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (share * (p - posterior)) + 1e-3 * w)
    return PiiModel(w, reliability, prior)


def fit(docs: DataFrame) -> PiiModel:
    """Learns from all documents: only counts of vote patterns (fewer than 2 x 4 x 8 x 3^6) reach the driver."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = Counter(pattern(t, *c) for t in batch["text"] if t for c in candidates(t))
            yield pd.DataFrame({"pattern": list(n.keys()), "n": list(n.values())}, dtype="int64")

    rows = (docs.select("text").mapInPandas(count, "pattern long, n long")
            .groupBy("pattern").agg(F.sum("n").alias("n")).collect())
    return fit_patterns({r["pattern"]: r["n"] for r in rows})


def find(text: str, model: PiiModel, known: dict[int, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with those the classifier adds; each by kind, then start. known: remembered probabilities."""
    base, more = [], []
    for kind, start, end, valid in candidates(text):
        if kind in BASE_KINDS:
            if valid:
                base.append((kind, start, end))
            continue
        number = pattern(text, kind, start, end, valid)
        if number not in known:
            known[number] = model.probability(number)
        if known[number] >= THRESHOLD:
            more.append((kind, start, end))
    added = apart_from(more, base)
    order = lambda s: (KINDS.index(s[0]), s[1])
    return sorted(base, key=order), sorted(base + added, key=order)


REPORT = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "n_spans long")


def report(docs: DataFrame, model: PiiModel) -> DataFrame:
    """Per document the personal data of its whole text.

    A null text is empty and has none; repeated rows are reported as often as they stand; a
    null doc_id stays null; an empty table gives no rows; other columns are not read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, float] = {}
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, spans = find(text or "", model, known)
                n = Counter(kind for kind, _, _ in base)
                rows.append((*(n[k] for k in BASE_KINDS), digest(base), joined(spans), len(spans)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_spans"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, REPORT)


def redact(docs: DataFrame, model: PiiModel) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; n_chars, where present, follows.

    Texts without personal data, null texts and all other columns stay as they are.
    """
    def masked(text: str, known: dict[int, float]) -> str:
        parts, done = [], 0
        for kind, start, end in sorted(find(text, model, known)[1], key=lambda s: (s[1], -s[2])):
            if start >= done:
                parts += [text[done:start], f"[{kind.upper()}]"]
            done = max(done, end)
        return "".join([*parts, text[done:]]) if parts else text

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[int, float] = {}
        for batch in batches:
            yield pd.Series([t if t is None else masked(t, known) for t in batch], dtype=object)

    out = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(length, "n_chars"))
    return out
