"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document with features x is  sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j).  The pairwise
part is computed in linear time as half of  |sum_i x_i v_i|^2 - sum_i x_i^2 |v_i|^2.

Features are found in the tasks that scan the texts.  Training sees the features of a bounded number of labelled rows
(``per_class``); the fitted model has a fixed size and travels with the scoring function.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume.llm.common import held_out, labelled_texts, training_labels

WORD_BUCKETS = 1 << 15
STATISTICS = (
    "words", "mean_word", "symbols", "digits", "capitals", "punctuation", "repeats", "variety", "line_words",
    "lines_repeated", "separators", "declared_chars",
)
BINS = 16
FEATURES = WORD_BUCKETS + len(STATISTICS) * BINS

_LETTER, _CAPITAL, _DIGIT, _SPACE, _PUNCTUATION, _SYMBOL, _OTHER = range(7)


def _byte_classes() -> np.ndarray:
    classes = np.full(256, _OTHER, np.uint8)
    for byte in range(128):
        character = chr(byte)
        if character.isupper():
            classes[byte] = _CAPITAL
        elif character.isalpha():
            classes[byte] = _LETTER
        elif character.isdigit():
            classes[byte] = _DIGIT
        elif character.isspace():
            classes[byte] = _SPACE
        elif character in ".,;:!?'\"()-":
            classes[byte] = _PUNCTUATION
        else:
            classes[byte] = _SYMBOL
    return classes


BYTE_CLASSES = _byte_classes()


def _share(part: float, whole: float) -> int:
    """Bin of a share: 0 for none, then by powers of the square root of two up to a whole."""
    if part <= 0 or whole <= 0:
        return 0
    return int(max(1, min(BINS - 1, BINS - 1 + 2 * np.log2(min(1.0, part / whole)))))


def _amount(value: float) -> int:
    return int(min(BINS - 1, np.log2(1 + max(0.0, value))))


class FeatureReader:
    """Feature numbers and values of texts; remembers the buckets of words it has seen, up to a bound."""

    REMEMBERED = 1 << 18

    def __init__(self) -> None:
        self._buckets: dict[bytes, int] = {}

    def _bucket(self, word: bytes) -> int:
        found = self._buckets.get(word)
        if found is None:
            if len(self._buckets) >= self.REMEMBERED:
                self._buckets.clear()
            found = self._buckets[word] = zlib.crc32(word.lower()) % WORD_BUCKETS
        return found

    def read(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").encode("utf-8", "replace")
        words = raw.split()
        distinct = set(words)
        n = len(words)
        lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
        kinds = np.bincount(BYTE_CLASSES[np.frombuffer(raw, np.uint8)], minlength=7)
        letters = int(kinds[_LETTER] + kinds[_CAPITAL] + kinds[_OTHER])
        marked = int(kinds.sum() - kinds[_SPACE])
        bins = (
            _amount(n),
            _amount((marked / n) ** 2 if n else 0),
            _share(int(kinds[_SYMBOL]), marked),
            _share(int(kinds[_DIGIT]), marked),
            _share(int(kinds[_CAPITAL]), letters),
            _share(int(kinds[_PUNCTUATION]), marked),
            _share(sum(a == b for a, b in zip(words, words[1:])), n - 1),
            _share(n - len(distinct), n),
            _amount(n / len(lines) if lines else 0),
            _share(len(lines) - len(set(lines)), len(lines)),
            _share(sum(len(w) == 1 and not w.isalnum() for w in words), n),
            BINS - 1 if n_chars is None else _amount(n_chars),
        )
        buckets = np.unique(np.fromiter(map(self._bucket, distinct), np.int64, len(distinct)))
        statistics = WORD_BUCKETS + np.arange(len(bins)) * BINS + np.array(bins)
        values = np.ones(len(buckets) + len(bins), np.float32)
        values[: len(buckets)] = 1.0 / np.sqrt(max(1, len(buckets)))
        return np.concatenate([buckets, statistics]), values


@dataclass
class FactorisationMachine:
    """Fitted weights: bias, one weight and one vector of ``rank`` factors for each feature."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, features: np.ndarray, values: np.ndarray) -> float:
        scaled = self.factors[features] * values[:, None]
        pairs = 0.5 * float((scaled.sum(0) ** 2).sum() - (scaled**2).sum())
        return self.bias + float(self.weights[features] @ values) + pairs

    def score(self, features: np.ndarray, values: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.margin(features, values), -35, 35))))


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    weights: np.ndarray,
    rank: int = 6,
    epochs: int = 8,
    batch: int = 64,
    rate: float = 0.05,
    penalty: float = 1e-5,
    seed: int = 7,
) -> FactorisationMachine:
    """Minimise the weighted logistic loss with adaptive steps over mini-batches in a seeded order."""
    random = np.random.default_rng(seed)
    linear = np.zeros(FEATURES, np.float32)
    factors = random.normal(0, 0.02, (FEATURES, rank)).astype(np.float32)
    positive = float((labels * weights).sum() + 0.5)
    negative = float(((1 - labels) * weights).sum() + 0.5)
    bias = float(np.log(positive / negative))
    seen_linear, seen_factors = np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, rank), 1e-6, np.float32)
    for _ in range(epochs if len(rows) else 0):
        order = random.permutation(len(rows))
        for start in range(0, len(order), batch):
            picked = order[start : start + batch]
            features = np.concatenate([rows[i][0] for i in picked])
            values = np.concatenate([rows[i][1] for i in picked])
            owner = np.repeat(np.arange(len(picked)), [len(rows[i][0]) for i in picked])
            begins = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in picked])[:-1]])
            scaled = factors[features] * values[:, None]
            sums = np.add.reduceat(scaled, begins)
            margin = bias + np.add.reduceat(linear[features] * values, begins)
            margin += 0.5 * ((sums**2).sum(1) - np.add.reduceat((scaled**2).sum(1), begins))
            error = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - labels[picked]) * weights[picked] / len(picked)
            used, slot = np.unique(features, return_inverse=True)
            pull = error[owner] * values
            linear_step = np.bincount(slot, pull, len(used)) + penalty * linear[used]
            by_factor = pull[:, None] * (sums[owner] - scaled)
            factor_step = np.stack([np.bincount(slot, by_factor[:, f], len(used)) for f in range(rank)], 1)
            factor_step += penalty * factors[used]
            seen_linear[used] += linear_step**2
            seen_factors[used] += factor_step**2
            linear[used] -= rate * linear_step / np.sqrt(seen_linear[used])
            factors[used] -= rate * factor_step / np.sqrt(seen_factors[used])
            bias -= rate * float(error.sum())
    return FactorisationMachine(bias, linear, factors)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2500) -> FactorisationMachine:
    """Fit on at most ``per_class`` training rows of each class.

    Each class is weighted back to its share of all training rows, so that scores are probabilities.  Without any
    label the model gives 0.5 to every document.
    """
    sample = training_labels(labels, label, per_class)
    known = labels.where(~held_out() & F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    shares = {r[label]: r["n"] for r in known.collect()}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = FeatureReader()
        for rows in batches:
            read = [reader.read(t, n) for t, n in zip(rows["text"].to_pylist(), rows["n_chars"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    rows["doc_id"].cast(pa.int64()),
                    rows["y"].cast(pa.int32()),
                    pa.array([f.astype(np.int32) for f, _ in read], pa.list_(pa.int32())),
                    pa.array([v for _, v in read], pa.list_(pa.float32())),
                ],
                ["doc_id", "y", "features", "values"],
            )

    rows = (
        labelled_texts(documents, sample, "n_chars")
        .mapInArrow(features, "doc_id long, y int, features array<int>, values array<float>")
        .toArrow()
        .sort_by("doc_id")
    )
    y = rows["y"].to_numpy().astype(np.float64)
    found = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    total = max(1, sum(shares.values()))
    weights = np.array([shares.get(int(k), 0) / total * len(y) / found[int(k)] for k in y])
    listed = zip(rows["features"].to_pylist(), rows["values"].to_pylist())
    return fit([(np.array(f, np.int64), np.array(v, np.float32)) for f, v in listed], y, weights)


def score(documents: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """All columns of ``documents`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    NULL and empty texts are scored by their (empty) statistics; a NULL length has a bin of its own; repeated rows
    get equal scores; an empty table gives no rows.  Columns named score or predicted are replaced.
    """
    kept = documents.drop("score", "predicted")
    at = {name: kept.columns.index(name) for name in ("text", "n_chars")}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = FeatureReader()
        for rows in batches:
            texts, lengths = rows.column(at["text"]).to_pylist(), rows.column(at["n_chars"]).to_pylist()
            scores = np.array([model.score(*reader.read(t, n)) for t, n in zip(texts, lengths)], np.float64)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                [*rows.schema.names, "score", "predicted"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(scored, f"{fields}, score double, predicted int")
