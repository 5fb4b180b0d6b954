"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length, with exception phrases.

Folding undoes disguises: compatibility forms and letters of other scripts that look Latin become Latin, digits and
signs that stand for letters become those letters, and characters without width go.  ``l``, ``1`` and ``|`` become ``i``
in texts and lexicon alike, so that a digit that may stand for either still matches.

The lexicon holds whole words and word beginnings, weighed by their log-odds between toxic and other labelled texts.
Phrases around a lexicon entry that occur in texts labelled clean at least as readily as in toxic ones are exceptions:
a match inside such a phrase does not count.  The summed weights, by themselves and by length, go through a logistic
curve fitted on the same labelled rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume.llm.common import held_out, labelled_texts, training_labels

# Letters of other scripts with the Latin letter that they look like.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "х": "x", "ԝ": "w", "α": "a",
    "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l",
    "ø": "o", "ɡ": "g", "ɑ": "a", "ʟ": "l",
}
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "l", "!": "l"}
# Characters that take no room.
WIDTHLESS = "­​‌‍⁠﻿"

MERGED = {"l": "i"}
PREFIXES = (4, 5, 6, 7)
#: Longest word of the lexicon.
LONGEST_ENTRY = 24

_not_compatible = re.compile(r"[^\x00-ɏ]")


def _folding() -> dict[int, str | None]:
    """What single characters become: lower case, Latin look-alikes, and a blank for all that is not a letter."""
    fold: dict[int, str | None] = {}
    for code in range(0x250):
        letter = chr(code).lower()
        letter = SUBSTITUTES.get(letter, letter)
        fold[code] = letter if letter.isalpha() else " "
    # General punctuation: dashes, quotation marks, ellipses.
    fold |= dict.fromkeys(range(0x2000, 0x2070), " ")
    for letter, like in LOOKALIKES.items():
        fold[ord(letter)] = fold[ord(letter.upper()[0])] = like
    for character in WIDTHLESS:
        fold[ord(character)] = None
    return {code: MERGED.get(letter, letter) if letter else letter for code, letter in fold.items()}


FOLDING = _folding()
ASCII_FOLDING = bytes(ord(FOLDING[code]) for code in range(128)) + bytes(range(128, 256))


def fold(text: str | None) -> str:
    """The folded text: words of letters between single blanks, with a blank at both ends."""
    if not text:
        return " "
    if text.isascii():
        return " " + " ".join(text.encode("ascii").translate(ASCII_FOLDING).decode("ascii").split()) + " "
    if _not_compatible.search(text):
        text = unicodedata.normalize("NFKC", text)
    return " " + " ".join(text.translate(FOLDING).split()) + " "


def entries(folded: str) -> set[str]:
    """What of a folded text can be in a lexicon: ``" word "`` for whole words, ``" beg"`` for word beginnings."""
    found = set()
    for word in set(folded.split()):
        if 3 <= len(word) <= LONGEST_ENTRY:
            found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in PREFIXES if len(word) > n)
    return found


@dataclass
class Lexicon:
    """Weights of entries, exception phrases, and the logistic curve from match statistics to a score."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))
    _matcher: object = None

    def matcher(self):
        """The automaton over entries and exceptions; built where it is used, not shipped."""
        if self._matcher is None:
            automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                automaton.add_word(phrase, (len(phrase), 0.0))
            if len(automaton):
                automaton.make_automaton()
            self._matcher = automaton
        return self._matcher

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_matcher": None}

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """First position, end and weight of the matches that no exception covers."""
        automaton = self.matcher()
        if not len(automaton):
            return []
        found = [(end + 1 - length, end + 1, weight) for end, (length, weight) in automaton.iter(folded)]
        excused = [(a, b) for a, b, weight in found if not weight]
        return [(a, b, w) for a, b, w in found if w and not any(x <= a and b <= y for x, y in excused)]

    def statistics(self, folded: str) -> np.ndarray:
        """One, and the logarithms of the summed weight, of the weight per thousand words, and of the largest weight.

        Of the matches that begin in one place the heaviest counts.
        """
        best: dict[int, float] = {}
        for first, _, weight in self.matches(folded):
            best[first] = max(weight, best.get(first, 0.0))
        total = sum(best.values())
        per_thousand = 1000.0 * total / max(1, folded.count(" ") - 1)
        return np.array([1.0, np.log1p(total), np.log1p(per_thousand), np.log1p(max(best.values(), default=0.0))])

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.statistics(fold(text)) @ self.curve, -35, 35))))


def _count_by_batch(count, schema_names: tuple[str, ...]):
    """A task function that adds up ``count(text) -> set of keys`` by label within a batch."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sums: Counter = Counter()
            for y, text in zip(rows["y"].to_pylist(), rows["text"].to_pylist()):
                sums.update((key, y) for key in count(fold(text)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in sums], pa.string()),
                    pa.array([n if y else 0 for (_, y), n in sums.items()], pa.int64()),
                    pa.array([0 if y else n for (_, y), n in sums.items()], pa.int64()),
                ],
                list(schema_names),
            )

    return counted


def train(
    documents: DataFrame,
    labels: DataFrame,
    per_class: int = 3000,
    size: int = 2000,
    least_texts: int = 4,
    least_weight: float = 2.0,
) -> Lexicon:
    """A lexicon of at most ``size`` entries from at most ``per_class`` labelled training rows of each class.

    An entry occurs in ``least_texts`` toxic texts and has log-odds of ``least_weight``.  A beginning gives way to a
    longer entry that nearly all its texts hold; entries that begin like a remaining shorter one of at least their
    weight are left to it.  Without toxic labels the lexicon is empty.
    """
    sample = training_labels(labels, "toxic", per_class)
    texts = labelled_texts(documents, sample).select("y", "text")
    classes = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    toxic, clean = classes.get(1, 0), classes.get(0, 0)
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()
    shares = {r["toxic"]: r["count"] for r in known}
    schema = "entry string, toxic long, clean long"

    def tallied(count) -> DataFrame:
        return (
            texts.mapInArrow(_count_by_batch(count, ("entry", "toxic", "clean")), schema)
            .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        )

    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    best = (
        tallied(entries).where(F.col("toxic") >= least_texts).withColumn("weight", weight)
        .where(F.col("weight") >= least_weight)
        .orderBy(F.col("toxic").desc(), "entry").limit(4 * size).collect()
    )
    weights = {r["entry"]: float(r["weight"]) for r in best}
    counts = {r["entry"]: r["toxic"] for r in best}
    # A beginning that one longer entry explains says no more than that entry and would match other words.
    explained = {e[:n] for e in counts for n in range(4, len(e)) if counts[e] >= 0.95 * counts.get(e[:n], float("inf"))}
    kept: dict[str, float] = {}
    for entry in sorted(weights.keys() - explained, key=lambda e: (len(e), e)):
        if len(kept) < size and not any(kept.get(entry[:n], 0.0) >= weights[entry] for n in range(4, len(entry))):
            kept[entry] = weights[entry]
    lexicon = Lexicon(kept)

    def phrases(folded: str) -> set[str]:
        """The words around each match, with one more word before and after."""
        found = set()
        for first, end, _ in lexicon.matches(folded):
            stop = folded.index(" ", end - 1 if folded[end - 1] == " " else end)
            before, after = folded.rfind(" ", 0, first), folded.find(" ", stop + 1)
            if before >= 0:
                found.add(folded[before : stop + 1])
            if after >= 0:
                found.add(folded[first : after + 1])
        return found

    odds = (F.col("clean") + 0.0) / (clean + 1.0) >= (F.col("toxic") + 0.0) / (toxic + 1.0)
    excused = tallied(phrases).where((F.col("clean") >= 2) & odds).orderBy(F.col("clean").desc(), "entry").limit(size)
    lexicon = Lexicon(kept, {r["entry"] for r in excused.collect()})

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [lexicon.statistics(fold(t)).tolist() for t in rows["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([rows["y"].cast(pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["y", "x"])

    rows = texts.mapInArrow(measured, "y int, x array<double>").toArrow()
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(-1, 4)
    y = rows["y"].to_numpy().astype(np.float64)
    total = max(1, sum(shares.values()))
    balance = np.array([shares.get(int(k), 0) / total * len(y) / max(1, classes[int(k)]) for k in y])
    lexicon.curve = fit_curve(x, y, balance)
    return lexicon


def fit_curve(x: np.ndarray, y: np.ndarray, weights: np.ndarray, penalty: float = 0.01, steps: int = 60) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps."""
    curve = np.zeros(4)
    if not len(y):
        return curve
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -35, 35)))
        gradient = x.T @ (weights * (p - y)) + penalty * curve
        curvature = (x * (weights * p * (1 - p))[:, None]).T @ x + penalty * np.eye(4)
        step = np.linalg.solve(curvature, gradient)
        curve -= step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
    return curve


def score(documents: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """All columns of ``documents`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    NULL and empty texts have no match and get the score of such texts; repeated rows get equal scores; an empty table
    gives no rows.  Columns named score or predicted are replaced.
    """
    kept = documents.drop("score", "predicted")
    at = kept.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            scores = np.array([lexicon.score(t) for t in rows.column(at).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                [*rows.schema.names, "score", "predicted"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(scored, f"{fields}, score double, predicted int")
