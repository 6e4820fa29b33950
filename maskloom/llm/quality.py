"""Text quality by positive-unlabelled learning with a non-negative risk."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from maskloom.llm.common import stored

#: Labelled rows that the fit reads at most. Unlabelled rows are read all.
FIT_ROWS = 20_000
FOLDS, THRESHOLD, BINS = 5, 0.3, 12

FEATURES = ("log_chars", "log_words", "word_length", "upper", "digits", "symbols", "stops", "spaces", "other_letters",
            "distinct_words", "top_word", "same_neighbours", "distinct_lines", "line_length", "symbol_words",
            "upper_words", "lone_symbols", "title_words", "long_words")
_TO_CLASS = {c: k for chars, k in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "u"), ("abcdefghijklmnopqrstuvwxyz", "l"),
                                   ("0123456789", "d"), (".,;:?'\"()-", "s"), (" \t\n\r\x0b\x0c", " ")) for c in chars}
_CLASSES = bytes(ord(_TO_CLASS.get(chr(i), "y")) for i in range(128)) + b"o" * 128


def features(text: str) -> list[float]:
    """Shape and repetition of a whole text; no label, language, source or id among them."""
    raw = text.encode()
    kinds = raw.translate(_CLASSES)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    chars, n = max(1, len(raw)), max(1, len(words))
    counts = Counter(words)
    unique = len(counts)
    marked = sum(k for w, k in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?'\")")
    upper = sum(k for w, k in counts.items() if len(w) > 1 and w.isupper())
    lone = sum(k for w, k in counts.items() if len(w) == 1 and not w.isalnum())
    title = sum(k for w, k in counts.items() if w[0].isupper())
    long = sum(k for w, k in counts.items() if len(w) > 12)
    same = sum(map(str.__eq__, words, words[1:])) if words else 0
    return [np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / n, kinds.count(b"u") / chars,
            kinds.count(b"d") / chars, kinds.count(b"y") / chars, kinds.count(b"s") / chars, kinds.count(b" ") / chars,
            kinds.count(b"o") / chars, unique / n, max(counts.values(), default=0) / n, same / n,
            len(set(lines)) / max(1, len(lines)), np.log1p(chars / max(1, len(lines))), marked / n, upper / n, lone / n,
            title / n, long / n]


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and the features of each whole text, in one pass over the texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").array,
                                "x": [np.array(features(t or ""), np.float32) for t in batch["text"]]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, x array<float>")


@dataclass
class QualityModel:
    """cuts: bin limits of each feature; weights and bias of the bins; scale and shift of the score."""
    cuts: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def bins(self, x: np.ndarray) -> np.ndarray:
        """For each row the number of each feature's bin, counted through all features."""
        width = self.cuts.shape[1] + 1
        x = np.asarray(x, np.float32)
        found = [np.searchsorted(c.astype(np.float32), x[:, i], side="right") + i * width for i, c in enumerate(self.cuts)]
        return np.stack(found, axis=1) if len(x) else np.zeros((0, len(self.cuts)), int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(x)].sum(axis=1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def moments(bins: np.ndarray, size: int) -> np.ndarray:
    """How many rows have each pair of bins; the last place stands for all rows. Whole numbers, so sums don't depend on order."""
    pairs = np.zeros((size + 1, size + 1))
    for at in range(0, len(bins), 4096):
        part = bins[at:at + 4096]
        hot = np.zeros((len(part), size + 1), np.float32)
        hot[np.arange(len(part))[:, None], part] = 1
        hot[:, -1] = 1
        pairs += hot.T @ hot
    return pairs


def fit_risk(cuts: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, decay: float = 1e-3) -> QualityModel:
    """The least of prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the squared loss (1 - yz)^2 / 4.

    positive, unlabelled: moments of all rows of each kind; R is a mean over them. Where the
    risk of the negatives would fall below zero it is held at zero: the least of the sum with that part weighed by
    a share of 0 to 1, found by halving, is the least of the whole, since each such sum is convex.
    """
    p, u = positive / positive[-1, -1], unlabelled / unlabelled[-1, -1]
    ridge = decay * np.eye(len(p))
    ridge[-1, -1] = 1e-9

    def risk(pairs: np.ndarray, y: int, w: np.ndarray) -> float:
        return float(1 - 2 * y * w @ pairs[-1] + w @ pairs @ w) / 4

    def least(share: float) -> tuple[np.ndarray, float]:
        curve = (1 - share) * prior * p + share * u + ridge
        w = np.linalg.solve(curve, prior * p[-1] - share * (u[-1] - prior * p[-1]))
        return w, risk(u, -1, w) - prior * risk(p, -1, w)

    w, negatives = least(1.0)
    if negatives < 0:
        low, high = 0.0, 1.0
        for _ in range(40):
            middle = (low + high) / 2
            w, negatives = least(middle)
            low, high = (middle, high) if negatives >= 0 else (low, middle)
    return QualityModel(cuts, w[:-1], float(w[-1]), prior=prior)


#: Places of the positive margins at which tail masses are compared.
TAILS = np.linspace(0, 0.9, 46)


def estimate_prior(positive: np.ndarray, limits: np.ndarray, above: np.ndarray, n: int) -> float:
    """Share of positives among the unlabelled: the least ratio of tail masses, where the tail holds a tenth at least.

    positive: margins by a first model; limits: their TAILS; above: how many of the n unlabelled rows
    reach each limit. Beyond any limit the unlabelled mass is at least the prior times the positive one.
    """
    slack = np.sqrt(1 / len(positive)) + np.sqrt(1 / n)
    held = (positive[:, None] >= limits).mean(axis=0)
    return float(np.clip(((above / n + slack) / np.maximum(held, 1e-9)).min(), 0.05, 0.95))


def fit_scale(model: QualityModel, margins: np.ndarray, labels: np.ndarray) -> None:
    """A logistic scale for the margin from labelled rows; even odds come to lie at THRESHOLD."""
    if len(set(labels.tolist())) < 2:
        return
    spread = max(float(margins.std()), 1e-6)
    x, w = np.stack([margins / spread, np.ones_like(margins)], axis=1), np.zeros(2)
    for _ in range(30):
        p = _sigmoid(x @ w)
        hessian = (x.T * (p * (1 - p))) @ x / len(x) + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(hessian, x.T @ (p - labels) / len(x) + 1e-3 * w), -2, 2)
    model.scale = max(float(w[0]), 1e-3) / spread
    model.shift = float(w[1]) + np.log(THRESHOLD / (1 - THRESHOLD))


def held_out():
    """Whether a row is kept from learning: crc32 of the id's text is a multiple of FOLDS."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def _counted(rows: DataFrame, keys: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
    """Counts of whole numbers that `keys` tells of the features of a batch of rows, summed in the task first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[int] = Counter()
        for batch in batches:
            found, n = keys(_matrix(batch))
            total.update(dict(zip(found.tolist(), n.tolist())))
        yield pd.DataFrame({"k": np.array(list(total), np.int64), "n": np.array(list(total.values()), np.int64)})

    counts = rows.select("x").mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return dict(counts.toPandas().itertuples(index=False, name=None))


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["x"].tolist()).astype(np.float32) if len(frame) else np.zeros((0, len(FEATURES)), np.float32)


#: Features are counted on a grid of 128 steps for each doubling: the upper half of a single-precision number.
_GRID = 16


def quantiles(rows: DataFrame) -> np.ndarray:
    """Bin limits of each feature over all rows, of equal shares up to the grid."""
    def keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = np.ascontiguousarray(np.maximum(x, 0)).view(np.uint32) >> _GRID
        return np.unique(steps.astype(np.int64) * len(FEATURES) + np.arange(len(FEATURES)), return_counts=True)

    counts = _counted(rows, keys)
    limits = np.zeros((len(FEATURES), BINS - 1))
    for i in range(len(FEATURES)):
        steps = np.array(sorted(k // len(FEATURES) for k in counts if k % len(FEATURES) == i), np.uint32)
        below = np.cumsum([counts[int(k) * len(FEATURES) + i] for k in steps])
        at = np.searchsorted(below, np.arange(1, BINS) * below[-1] / BINS, side="right")
        limits[i] = (steps[np.minimum(at, len(steps) - 1)] << np.uint32(_GRID)).view(np.float32)
    return limits


def _all_moments(rows: DataFrame, model: QualityModel) -> np.ndarray:
    size = len(model.weights)

    def keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = moments(model.bins(x), size).ravel()
        at = np.flatnonzero(pairs)
        return at, pairs[at].astype(np.int64)

    pairs = np.zeros((size + 1) ** 2)
    for k, n in _counted(rows, keys).items():
        pairs[k] = n
    return pairs.reshape(size + 1, size + 1)


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, features, and the label (doc_id, quality) of rows that are not held out; a row per document."""
    known = (labels.where(F.col("quality").isin(0, 1) & ~held_out())
             .groupBy(F.col("doc_id").cast("long")).agg(F.max("quality").alias("quality")))
    return feature_table(docs).join(known, "doc_id", "left")


def fit(table: DataFrame) -> QualityModel:
    """Learns from the rows of a marked table that are not held out.

    Of labelled rows about FIT_ROWS, picked by a hash, reach the driver as features. Bin limits, the prior and
    the risk of the unlabelled are sums over all unlabelled rows, a few ten thousand numbers whatever
    the rows. Where no row is unlabelled, all rows stand for them; rows without id are not learned
    from; without positives all scores are 0.5.
    """
    rows = table.where(~held_out() & F.col("doc_id").isNotNull())
    with_label = rows.where(F.col("quality").isNotNull())
    n_labelled, n_rows = rows.agg(F.count("quality"), F.count("*")).first()
    blank = QualityModel(np.zeros((len(FEATURES), BINS - 1)), np.zeros(BINS * len(FEATURES)))
    if not n_labelled:
        return blank
    # The share comes first, so that a task hands on its part of FIT_ROWS and not as many itself.
    share = int(min(1.0, 1.1 * FIT_ROWS / n_labelled) * (1 << 30))
    picked = (with_label.withColumn("h", F.xxhash64("doc_id", "x")).where(F.pmod("h", F.lit(1 << 30)) < share)
              .orderBy("h", "doc_id").limit(FIT_ROWS).select("x", "quality").toPandas())
    marks, all_x = picked["quality"].to_numpy(dtype=int), _matrix(picked)
    positive = all_x[marks == 1]
    if not len(positive):
        return blank
    unlabelled = rows.where(F.col("quality").isNull()) if n_labelled < n_rows else rows
    n = n_rows - n_labelled or n_rows
    cuts = quantiles(unlabelled)
    empty = QualityModel(cuts, np.zeros(BINS * len(FEATURES)))
    ours, others = moments(empty.bins(positive), len(empty.weights)), _all_moments(unlabelled, empty)
    first = fit_risk(cuts, ours, others, 0.5)
    limits = np.quantile(first.margin(positive), TAILS)

    def reached(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(limits)), (first.margin(x)[:, None] >= limits).sum(axis=0)

    tails = _counted(unlabelled, reached)
    above = np.array([tails.get(k, 0) for k in range(len(limits))])
    model = fit_risk(cuts, ours, others, estimate_prior(first.margin(positive), limits, above, n))
    fit_scale(model, model.margin(all_x), marks)
    return model


SCORES = "doc_id long, held_out boolean, score double, predicted int"


def score_table(table: DataFrame, model: QualityModel) -> DataFrame:
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.tolist()).astype(float)) if len(x) else [], dtype=float)

    return (table.select("doc_id", held_out().alias("held_out"), score("x").alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document its quality score.

    The features of the texts are written once; the fit and the scores read them.
    Null and empty texts get the score of an empty text; repeated rows get equal scores; a
    null doc_id is never held out and not learned from; an empty table gives no rows; without
    usable labels all scores are 0.5. Other columns are not read.
    """
    written = stored(marked(docs, labels), "quality")
    return score_table(written, fit(written))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score THRESHOLD or more, unchanged; learned as in score_documents.

    Null and empty texts are judged as an empty text, repeated rows alike; an empty table stays empty; without usable
    labels all documents stay.
    """
    model = fit(stored(marked(docs, labels), "quality"))

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        x = np.array([features(t or "") for t in texts], np.float32).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x.astype(float)) >= THRESHOLD)

    return docs.where(good("text"))
