"""Toxicity grades by cumulative-link ordinal regression.

P(grade <= k) is the logistic function of threshold k less w . x: all thresholds share
the weights w.  Features of a text are its words and the 5-grams of the words' letters,
each with its count over the root of the number of words.  A text's w . x is then the
sum of the weights of its words, which workers keep by word.

Fitting takes about ``sample`` labelled texts a grade, chosen by a hash of the id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, tidy, unit_hash

SAMPLE = 1000
GRAM = 5
LEAST_TEXTS = 4
PENALTY = 2e-4
STEPS = 60
CACHE_WORDS = 500_000
EDGE = "\"'`.,;:!?()[]{}<>|*#$%&/\\-_+=~^@"


def features_of(word: str) -> list[str]:
    """The bare word in lower case, and its 5-grams with the word's ends marked."""
    bare = word.strip(EDGE)
    if not bare:
        return []
    marked = f"^{bare}$"
    return [f"={bare}", *(marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """grades: in order; thresholds: one fewer."""

    grades: list[int]
    weights: dict[str, float]
    thresholds: np.ndarray

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(word))

    def at(self, x: float) -> tuple[int, float, float]:
        """The most likely grade, the expected grade, and the chance of a grade above the lowest."""
        upto = np.append(_sigmoid(self.thresholds - x), 1.0)
        p = np.diff(upto, prepend=0.0)
        return self.grades[int(p.argmax())], float(p @ np.array(self.grades)), float(1 - upto[0]) if len(self.grades) > 1 else float(self.grades[0] > 0)


def fit(texts: list[str], grades: list[int], steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam over all rows; grades weigh alike."""
    known = sorted(set(grades)) or [0]
    number: dict[str, int] = {}  # of a word; texts are sparse in words, and words in features
    seen: Counter[str] = Counter()
    parts: list[list[str]] = []
    rows, cols, vals = [], [], []
    for i, text in enumerate(texts):
        words = Counter(w.strip(EDGE) for w in text.lower().split())
        size = max(1.0, sum(words.values()))
        for w, n in words.items():
            if w not in number:
                number[w] = len(number)
                parts.append(features_of(w))
            rows.append(i)
            cols.append(number[w])
            vals.append(n / size**0.5)
        seen.update({f for w in words for f in parts[number[w]]})
    names = sorted(f for f, n in seen.items() if n >= LEAST_TEXTS)
    place = {f: i for i, f in enumerate(names)}
    if len(known) < 2 or not names:
        return Model(known, {}, np.zeros(len(known) - 1))
    row, col, val = np.array(rows, np.int32), np.array(cols, np.int32), np.array(vals)
    pairs = [(k, place[f]) for k, own in enumerate(parts) for f in own if f in place]
    word, feature = (np.array(x, np.int32) for x in zip(*pairs, strict=True))
    y = np.searchsorted(known, grades)
    share = (1 / np.bincount(y, minlength=len(known)))[y] / len(known)
    w = np.zeros(len(names))
    first, gaps = np.zeros(1), np.zeros(len(known) - 2)  # thresholds: first, then steps of exp(gap)
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (w, first, gaps)]
    for t in range(1, steps + 1):
        theta = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        x = np.bincount(row, val * np.bincount(word, w[feature], len(parts))[col], len(texts))
        up = _sigmoid(np.append(theta, np.inf)[y] - x)
        low = _sigmoid(np.append(-np.inf, theta)[y] - x)
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        g_x = share * (d_up - d_low)
        g_theta = np.zeros(len(theta) + 2)
        np.add.at(g_theta, y + 1, -share * d_up)
        np.add.at(g_theta, y, share * d_low)
        g_theta = g_theta[1:-1]
        g_w = np.bincount(feature, np.bincount(col, val * g_x[row], len(parts))[word], len(names)) + penalty * w
        g_gaps = np.exp(gaps) * np.cumsum(g_theta[::-1])[::-1][1:]
        for (q, m, v), g in zip(state, (g_w, np.array([g_theta.sum()]), g_gaps), strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - t / (steps + 1))
    theta = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
    return Model(known, {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4}, theta)


def severity(toxic: str = "toxic", quality: str = "quality") -> Column:
    """Grade 0: not toxic; 1: toxic; 2: toxic in a text of low quality; null if unknown."""
    return F.when(F.col(toxic) == 0, 0).when((F.col(toxic) == 1) & (F.col(quality) == 0), 2).when(F.col(toxic) == 1, 1)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grade: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` rows of each grade of the labels.  Rows of null id or grade don't count."""
    graded = labels.select(F.col(id_col).alias("_id"), (severity() if grade is None else grade).alias("_grade")).where("_id is not null and _grade is not null")
    counts = {r["_grade"]: r["count"] for r in graded.groupBy("_grade").count().toLocalIterator()}
    if not counts:
        return fit([], [])
    rates = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))))
    chosen = graded.where(unit_hash(F.lit("toxic"), "_id") < F.element_at(rates, F.col("_grade"))).dropDuplicates(["_id", "_grade"])
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    found = sorted((r["_text"], r["_grade"]) for r in texts.join(F.broadcast(chosen), "_id").toLocalIterator())
    return fit([t for t, _ in found], [g for _, g in found])


def score(df: DataFrame, model: Model, *, text_col: str = "text", names: tuple[str, str, str] = ("_grade", "_severity", "_p_toxic")) -> DataFrame:
    """df with the grade, the expected grade and the chance of a grade above the lowest, named ``names``; these replace columns of the same name.

    Null texts and texts without a word get the lowest grade and 0; texts are read whole, however
    long; of grades that tie the lower wins; repeated rows get the same answer; a model without
    labels gives 0 throughout; an empty table gives an empty one.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c not in names]
    schema = df.select(*keep).schema.add(names[0], "integer").add(names[1], "double").add(names[2], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = held.value, {}
        for batch in batches:
            found = []
            for text in batch.column(keep.index(text_col)):
                words = (text.as_py() or "").lower().split()
                if not words:
                    found.append((model.grades[0], 0.0, 0.0))
                    continue
                try:
                    total = sum([cache[w] for w in words])
                except KeyError:
                    if len(cache) > CACHE_WORDS:
                        cache.clear()
                    for w in set(words):
                        if w not in cache:
                            cache[w] = model.word(w)
                    total = sum([cache[w] for w in words])
                found.append(model.at(total / np.sqrt(len(words))))
            arrays = [pa.array([f[i] for f in found], kind) for i, kind in ((0, pa.int32()), (1, pa.float64()), (2, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*keep, *names])

    return df.select(*keep).mapInArrow(tidy(run), schema)


def score_digest(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """doc_id, grade, severity (expected grade), p_toxic, toxic of each document."""
    found = score(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", F.col("_grade").alias("grade"), F.col("_severity").alias("severity"), F.col("_p_toxic").alias("p_toxic"), (F.col("_p_toxic") >= cut).alias("toxic"))


def keep_civil(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """docs without the rows whose chance of a grade above the lowest is cut or more.

    Rows of null or blank text stay, repeated rows share their fate, columns of any name stay as
    they are; an empty table gives an empty one.
    """
    names = tuple(fresh(docs, "_grade", "_severity", "_p_toxic"))
    return score(docs, train(docs, labels), names=names).where(F.col(names[2]) < cut).select(*docs.columns)
