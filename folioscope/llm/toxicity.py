"""Toxicity from a weighted lexicon that is learned from labelled documents.

Texts are folded first: lower case, look-alike letters of other scripts and digits
that stand for letters become those letters, everything else between words a
space. Terms are beginnings of words that toxic documents hold far more often than
others; exception phrases are words, or a word with its neighbour, that hold a term
but occur in documents that are not toxic. An Aho-Corasick automaton finds both in
one pass over a whole text; an exception silences the terms inside it. The weights
found, summed and set against the length of the text, give the score through a
logistic curve fitted on the same labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import written

#: Labelled documents, those of smallest hash, that the lexicon is learned from.
SAMPLE = 20_000
#: Most terms, and most exception phrases, of a lexicon.
TERMS = 4_000
SHORTEST, LONGEST = 3, 12
#: A term is in so many toxic documents at least and, with 1.5 standard errors to
#: spare, this much likelier there (log).
LEAST, WEIGHT, ERRORS = 3, 2.0, 1.5
PREDICT_AT = 0.3

# Letters and digits that look like Latin letters.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l",
}
_FOLD = LOOKALIKES | {chr(0xFF41 + k): chr(97 + k) for k in range(26)}
#: Of ASCII, a byte table: small letters stay, digits and marks that stand for
#: letters become them, other digits stay, the rest is space.
_BYTES = bytes(
    ord(_FOLD.get(c, c if c.isalnum() else " ")) if (c := chr(k).lower()).isascii() and k < 128 else k for k in range(256)
)
_RARE = re.compile(f"[^\\x00-\\x7f\\w]|[{''.join(c for c in _FOLD if not c.isascii())}]")
_READY: dict[tuple, object] = {}


def fold(text: str | None) -> str:
    """The words of a text, folded, with a space around each."""
    text = (text or "").lower()
    if not text.isascii():
        text = _RARE.sub(lambda m: _FOLD.get(m[0], " "), text)
    return f" {' '.join(text.encode().translate(_BYTES).decode().split())} "


@dataclass(frozen=True)
class Model:
    """``terms`` and their weights, exception phrases, the curve's coefficients."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    curve: tuple[float, ...]

    def automaton(self):
        """One per worker and model."""
        import ahocorasick

        key = (self.terms, self.exceptions)
        if key not in _READY:
            _READY.clear()
            found = ahocorasick.Automaton()
            for phrase in self.exceptions:
                found.add_word(f" {phrase} ", (len(phrase) + 2, None))
            for term, weight in self.terms:
                found.add_word(f" {term}", (len(term) + 1, weight))
            found.make_automaton()
            _READY[key] = found
        return _READY[key]

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """``(start, weight)`` of the heaviest term at each word that no exception
        phrase covers."""
        found = self.automaton()
        if not len(found):
            return []
        best: dict[int, float] = {}
        silent: list[tuple[int, int]] = []
        for end, (size, weight) in found.iter(folded):
            start = end - size + 1
            if weight is None:
                silent.append((start, end))
            else:
                best[start] = max(weight, best.get(start, weight))
        return [(s, w) for s, w in sorted(best.items()) if not any(a <= s < b for a, b in silent)] if silent else sorted(best.items())

    def features(self, text: str | None) -> tuple[float, float, float]:
        folded = fold(text)
        weights = [w for _, w in self.hits(folded)]
        words, total = max(1, folded.count(" ") - 1), sum(weights)
        return (np.log1p(total), np.log1p(100 * total / words), max(weights, default=0.0))

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.curve[0] + features @ np.array(self.curve[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _training(docs: DataFrame, labels: DataFrame, where: str | None, sample: int) -> DataFrame:
    """``text, toxic`` of the sample, copies once."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    if where:
        rows = rows.where(where)
    chosen = rows.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # sample rows at most
    return written(texts.select(F.coalesce("text", F.lit("")).alias("text"), "toxic").distinct(), "labelled")


def _counted(rows: DataFrame, terms_of, least: int) -> DataFrame:
    """``term, toxic, clean``: documents of each label that hold a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[int(toxic > 0)].update(terms_of(fold(text)))
            terms = list(set(seen[0]) | set(seen[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *(pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0))],
                ["term", "toxic", "clean"],
            )

    counted = rows.mapInArrow(run, "term string, toxic bigint, clean bigint")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(f"toxic + clean >= {least}")


def _beginnings(folded: str) -> set[str]:
    return {w[:k] for w in set(folded.split()) if not w.isdigit() for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


def _phrases(model: Model):
    """Words that hold a term, alone and with a neighbour."""

    def run(folded: str) -> set[str]:
        found = set()
        for start, _ in model.hits(folded):
            end = folded.index(" ", start + 1)
            before = folded.rfind(" ", 0, start) if start else -1
            after = folded.find(" ", end + 1)
            found.add(folded[start + 1 : end])
            if before >= 0:
                found.add(folded[before + 1 : end])
            if after >= 0:
                found.add(folded[start + 1 : after])
        return found

    return run


def learn(docs: DataFrame, labels: DataFrame, where: str | None = None, sample: int = SAMPLE) -> Model:
    """A model from the documents that ``labels`` (``doc_id, toxic``) name and
    ``where``, a condition on labels, admits.

    At most ``sample`` labelled documents and TERMS terms take part, so what comes
    to the driver is bounded. Without labels, or with one class, all texts score
    the share of toxic ones, 0 where there are none."""
    rows = _training(docs, labels, where, sample)
    n = {r[0]: r[1] for r in rows.groupBy(F.col("toxic") > 0).count().collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    if not bad or not good:
        share = bad / max(1, bad + good)
        return Model((), (), (float(np.log((share + 1e-9) / (1 - share + 1e-9))), 0.0, 0.0, 0.0))
    weight = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    terms = (
        _counted(rows, _beginnings, LEAST).where(f"toxic >= {LEAST}").withColumn("weight", weight).where(F.col("weight") - ERRORS * error >= WEIGHT)
        .orderBy(F.desc(F.col("weight") * F.log1p("toxic")), "term").limit(TERMS).collect()
    )
    kept: dict[str, float] = {}
    for r in sorted(terms, key=lambda r: (len(r.term), r.term)):  # a beginning stands for its longer forms
        shorter = max((kept.get(r.term[:k], 0.0) for k in range(SHORTEST, len(r.term))), default=0.0)
        if r.weight > shorter + 1.0 or not shorter:
            kept[r.term] = float(r.weight)
    model = Model(tuple(sorted(kept.items())), (), (0.0, 0.0, 0.0, 0.0))
    phrases = (
        _counted(rows, _phrases(model), 2).where(F.col("clean") / good > 2 * F.col("toxic") / bad)
        .orderBy(F.desc("clean"), "term").limit(TERMS).collect()
    )
    model = Model(model.terms, tuple(sorted(r.term for r in phrases)), model.curve)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([model.features(t) for t in b.column(0).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, k]) for k in range(3)), b.column(1)], ["a", "b", "c", "toxic"])

    known = rows.mapInArrow(measured, "a double, b double, c double, toxic int").toArrow()  # sample rows at most
    x = np.column_stack([np.ones(known.num_rows), *(known.column(k).to_numpy() for k in range(3))])
    y = (known.column(3).to_numpy() > 0).astype(float)
    order = np.lexsort((*x.T, y))  # sums in one order
    x, y, w = x[order], y[order], np.zeros(4)
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - 0.1 * w
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4), slope)
    return Model(model.terms, model.exceptions, tuple(map(float, w)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row: null ids and repeated rows have
    theirs, a null text is empty, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([model.features(t.as_py()) for t in b.column(1)]).reshape(-1, 3)
            value = model.score(found)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(value), pa.array((value >= PREDICT_AT).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, predicted int")
