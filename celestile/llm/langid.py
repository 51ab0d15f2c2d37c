"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts counts the byte n-grams of orders 2, 3
and 4 that occur in both, divided by the roots of their own counts.  Landmark texts give
Nystroem features, on which one kernel ridge regression a language is fitted.  What the
regressions say of a text is linear in its n-grams, so landmarks, Nystroem map and ridge
weights fold into one table of n-gram by language, and a batch of texts is scored by
the product of its sparse matrix of n-grams with that table.

Fitting takes about ``sample`` labelled texts a language, ``sample_bytes`` of text at most on
average, chosen by a hash of the id; landmarks are those of them with the smallest hash of
their text.  Predicting reads nothing but the text, all of it.  The table that is
broadcast is bounded: more than MOST_LANGUAGES raise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, tidy, unit_hash

ORDERS = (2, 3, 4)
SLOT_BITS = 17
SLOTS = 1 << SLOT_BITS
SAMPLE = 300
SAMPLE_BYTES = 4 << 20
MOST_LANGUAGES = 128
MARKS_AT_ONCE = 64
GRAMS_AT_ONCE = 1 << 17
LANDMARKS = 48
RIDGE = 1e-2
SHARPNESS = 4.0
CHUNK = 1 << 20
TEXTS_AT_ONCE = 256
_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


class Presence:
    """The n-grams of a text, as sorted slots of a table of len(ORDERS) * SLOTS."""

    def __init__(self) -> None:
        self.flags = np.zeros(len(ORDERS) * SLOTS, bool)

    def __call__(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
        for start in range(0, max(1, len(raw) - 1), CHUNK):
            b = raw[start : start + CHUNK + max(ORDERS) - 1].astype(np.uint32)
            key = b
            for k, order in enumerate(range(2, max(ORDERS) + 1)):
                key = (key[:-1] << np.uint32(8)) | b[order - 1 :]
                slot = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
                self.flags[slot + np.uint32(k * SLOTS)] = True
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        return found


@dataclass
class Model:
    """weights: n-gram slot by language; bias: by language."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str | None], presence: Presence) -> tuple[list[str], np.ndarray]:
        """The languages of texts and their shares of the softmax; UNKNOWN, 0 for null, no letter, or a model without languages."""
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        held: list[np.ndarray] = []
        at: list[int] = []

        def flush() -> None:
            # the sparse matrix by its rows: columns one after another, and where each row begins
            size = np.array([len(g) for g in held])
            total = np.zeros((len(held), len(self.languages)))
            some = np.flatnonzero(size)
            if len(some):
                starts = (np.cumsum(size) - size)[some]
                total[some] = np.add.reduceat(self.weights.take(np.concatenate(held), 0), starts, axis=0, dtype=np.float64)
            f = self.bias + total / np.sqrt(np.maximum(size, 1))[:, None]
            p = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
            best = p.argmax(1)
            score[at] = p.max(1) / p.sum(1)
            for i, k in zip(at, best.tolist(), strict=True):
                lang[i] = self.languages[k]
            held.clear()
            at.clear()

        waiting = 0
        for i, text in enumerate(texts):
            if not self.languages or text is None or not _LETTER.search(text):
                continue
            held.append(presence(text))
            at.append(i)
            waiting += len(held[-1])
            if waiting >= GRAMS_AT_ONCE:
                flush()
                waiting = 0
        if at:
            flush()
        return lang, score


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model of the languages that occur; of each, the ``landmarks`` texts with the smallest hash are landmarks."""
    names = sorted(set(langs))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; the table of n-grams holds {MOST_LANGUAGES}")
    presence = Presence()
    slots = len(ORDERS) * SLOTS
    weights = np.zeros((slots, len(names)), np.float32)
    grams = [presence(t) for t in texts]
    seen = dict.fromkeys(names, 0)
    marks: list[int] = []
    for i in sorted(range(len(texts)), key=lambda i: (xxhash.xxh3_64_intdigest(texts[i].encode("utf-8", "surrogatepass")), texts[i], langs[i])):
        if len(grams[i]) and seen[langs[i]] < landmarks:
            seen[langs[i]] += 1
            marks.append(i)
    if not marks:
        return Model(names, weights, np.zeros(len(names)))
    kernel = np.zeros((len(texts), len(marks)))
    for low in range(0, len(marks), MARKS_AT_ONCE):
        part = marks[low : low + MARKS_AT_ONCE]
        own = np.zeros((slots, len(part)), np.float32)
        for j, i in enumerate(part):
            own[grams[i], j] = 1 / np.sqrt(len(grams[i]))
        for i, g in enumerate(grams):
            kernel[i, low : low + len(part)] = own[g].sum(0, dtype=np.float64) / np.sqrt(max(1, len(g)))
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > 1e-8 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = np.hstack([kernel @ whiten, np.ones((len(texts), 1))])
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    penalty = ridge * len(texts) * np.eye(features.shape[1])
    penalty[-1, -1] = 1e-6
    beta = np.linalg.solve(features.T @ features + penalty, features.T @ target)
    for i, row in zip(marks, whiten @ beta[:-1], strict=True):
        weights[grams[i]] += (row / np.sqrt(len(grams[i]))).astype(np.float32)
    return Model(names, weights, beta[-1])


def held_out(id_col: str, parts: int = 4, part: int = 2):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(parts)) == part


def train(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on about ``sample`` texts and at most about ``sample_bytes`` of each language, from rows that are not held out."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    counts = {r["lang"]: min(1.0, sample / r["n"], sample_bytes / max(1, r["bytes"] or 0)) for r in counted.limit(MOST_LANGUAGES + 1).toLocalIterator()}
    if not counts:
        return fit([], [])
    rates = F.create_map(*(F.lit(x) for k, rate in counts.items() for x in (k, rate)))
    chosen = rows.where(F.col("text").isNotNull() & (unit_hash(F.lit("lang"), "doc_id") < F.element_at(rates, F.col("lang"))))
    found = sorted((r["text"], r["lang"]) for r in chosen.select("text", "lang").toLocalIterator())
    return fit([t for t, _ in found], [lang for _, lang in found])


def predict(df: DataFrame, model: Model, *, text_col: str = "text", names: tuple[str, str] = ("_lang_pred", "_score")) -> DataFrame:
    """df with the language and its score, named ``names``; these replace columns of the same name.

    Null texts and texts without a letter are ``und`` with score 0; texts are read whole, however
    long; of languages that tie the first by name wins; an empty table gives an empty one;
    repeated rows get the same answer.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c not in names]
    schema = df.select(*keep).schema.add(names[0], "string").add(names[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence, own = Presence(), held.value
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(i, TEXTS_AT_ONCE)
                lang, score = own.predict(part.column(keep.index(text_col)).to_pylist(), presence)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*keep, *names])

    return df.select(*keep).mapInArrow(tidy(run), schema)


def predict_digest(df: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document; learned from those not held out."""
    model = train(df, **options)
    found = predict(df.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def keep_identified(df: DataFrame, least_score: float = 0.3) -> DataFrame:
    """df's rows whose language can be told; ``und`` (null texts, texts without a letter) and scores below least_score go.

    Repeated rows share their fate, columns of any name stay as they are; an empty table gives an empty one.
    """
    lang, score = fresh(df, "_lang_pred", "_score")
    found = predict(df, train(df), names=(lang, score))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least_score)).select(*df.columns)
