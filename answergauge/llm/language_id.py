"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Trained online with follow-the-regularised-leader and elastic-net penalties (the weights of most n-grams
stay exactly 0), then calibrated by one temperature. Document frequencies are counted over all training texts; the
regression itself is fitted on a seeded sample of at most about ``SAMPLE_PER_CLASS`` rows a language, as sparse
vectors of bounded size. Every labelled language is learnt, however rare; the fit takes memory of ``BUCKETS`` numbers a
language. Prediction reads whole texts and nothing but the text.

Cases: a NULL text, or one without a letter, is ``und`` with score 0; rows without label or id are not learnt from;
without any row to learn from, everything is ``und``; ties go to the language that is first in order;
repeated rows get equal results; long texts cost time in proportion; other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from answergauge.llm.common import give_back, in_slices, schema_of, ship_package

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SAMPLE_PER_CLASS = 1000
EPOCHS = 2
HELD_BACK = 5  # every fifth row of each language's sample is for the temperature
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.01
SLICE_BYTES = 4 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngrams(text: str | None) -> np.ndarray | None:
    """The buckets of all n-grams of the text's letters (lower case, words parted by one space); None without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, np.uint32(32))
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1]  # of several others in a row, one stays
    points = np.concatenate([[np.uint32(32)], points[keep], [np.uint32(32)]]).astype(np.uint64)
    mixed, found = points, []
    for order in range(1, max(ORDERS) + 1):
        if order > 1:
            if len(points) < order:
                break
            mixed = mixed[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[order - 1 :]
        if order in ORDERS:
            spread = (mixed + np.uint64(order)) * np.uint64(0xD6E8FEB86659FD93)
            found.append((spread >> np.uint64(48)).astype(np.int64))
    return np.concatenate(found)


def _vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The TF-IDF vector, of length 1: buckets and values."""
    grams = ngrams(text)
    if grams is None:
        return None
    counts = np.bincount(grams, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    values = np.sqrt(counts[at]) * idf[at]
    return at, values / np.sqrt((values**2).sum())


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, biases and temperature from rows of (class, buckets, values)."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(zs: np.ndarray, ns: np.ndarray, l1: float = L1) -> np.ndarray:
        return np.where(
            np.abs(zs) > l1, (np.sign(zs) * l1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2), 0.0
        )

    def softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    seen, training, held = [0] * classes, [], []
    for row in rows:
        seen[row[0]] += 1
        (training if seen[row[0]] % HELD_BACK else held).append(row)
    for _ in range(EPOCHS):
        for label, at, values in training:
            at, values = np.append(at, BUCKETS), np.append(values, 1.0)  # the last is the bias
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            error = softmax(values @ w)
            error[label] -= 1
            g = values[:, None] * error
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[at] = zs + g - sigma * w
            n[at] = ns + g * g
    w = weights(z, n)
    held = held or rows
    logits = np.array([v @ w[a] + w[BUCKETS] for _, a, v in held]).reshape(-1, classes)
    labels = np.array([r[0] for r in held], int)
    # Platt's smoothed targets: without them, rows that are all told apart would ask for a temperature of 0.
    targets = np.full(logits.shape, 1 / (len(labels) + 2) / max(1, classes - 1))
    targets[np.arange(len(labels)), labels] = (len(labels) + 1) / (len(labels) + 2)
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.05, 20, 121):
        loss = -(targets * np.log(softmax(logits / t) + 1e-300)).sum()
        if loss < best:
            best, temperature = loss, float(t)
    return w[:BUCKETS], w[BUCKETS], temperature


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict_text(self, text: str | None) -> tuple[str, float]:
        vector = _vector(text, self.idf) if self.languages else None
        if vector is None:
            return UNKNOWN, 0.0
        x = (vector[1] @ self.weights[vector[0]] + self.bias) / self.temperature
        p = np.exp(x - x.max())
        at = int(p.argmax())
        return self.languages[at], float(p[at] / p.sum())

    def annotate(
        self, docs: DataFrame, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score"
    ) -> DataFrame:
        """All columns, and at the end the language and its calibrated probability."""
        ship_package(docs.sparkSession)
        held = docs.sparkSession.sparkContext.broadcast(self)  # at most BUCKETS weights a language

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in in_slices(batches, text_col, SLICE_BYTES):
                found = [held.value.predict_text(t) for t in part.column(text_col).to_pylist()]
                yield part.append_column(pred_col, pa.array([f[0] for f in found], pa.string())).append_column(
                    score_col, pa.array([f[1] for f in found], pa.float64())
                )
                part = found = None
            give_back()

        return docs.mapInArrow(run, schema_of(docs, **{pred_col: StringType(), score_col: DoubleType()}))

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Per row: the id, ``lang_pred`` and ``score``, the calibrated probability of that language."""
        chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        return self.annotate(chosen).select(F.col("id").alias(id_col), "lang_pred", "score")


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Number of texts with letters, and of those with each bucket, over all rows. Each task sends one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts, seen = 0, np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, bool)
        for part in in_slices(batches, "text", SLICE_BYTES):
            for text in part.column("text").to_pylist():
                grams = ngrams(text)
                if grams is not None:
                    seen[grams] = True
                    at = np.flatnonzero(seen)
                    counts[at] += 1
                    seen[at] = False
                    total += 1
                part = None
        give_back()
        at = np.flatnonzero(counts)
        if total:
            yield pa.RecordBatch.from_pydict(
                {"bucket": np.append(at, BUCKETS).astype(np.int32), "texts": np.append(counts[at], total)}
            )

    ship_package(docs.sparkSession)
    per_task = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, texts long")
    counts = np.zeros(BUCKETS + 1, np.int64)
    for bucket, texts in per_task.groupBy("bucket").agg(F.sum("texts")).collect():  # at most BUCKETS + 1 rows
        counts[bucket] = texts
    return int(counts[BUCKETS]), counts[:BUCKETS]


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_class: int = SAMPLE_PER_CLASS,
    seed: int = 8,
) -> LanguageModel:
    """Fits a model on the labelled rows of ``docs``."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = labelled.groupBy(F.col(lang_col).cast("string")).count()
    counted = sizes.collect()  # one row a language
    languages = sorted(r[0] for r in counted)
    nothing = LanguageModel([], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 1.0)
    if not languages:
        return nothing
    total, counts = document_frequencies(labelled, text_col)
    idf = np.log((1 + total) / (1 + counts)) + 1
    held = docs.sparkSession.sparkContext.broadcast(idf)
    share = F.create_map(*[x for r in counted for x in (F.lit(r[0]), F.lit(min(1.0, per_class / r[1])))])
    ticket = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11)
    sample = labelled.select(
        ticket.alias("ticket"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    ).where(F.col("ticket") < F.try_element_at(share, F.col("lang")) * F.lit(float(1 << 53)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, "text", SLICE_BYTES):
            found = [_vector(t, held.value) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "ticket": part.column("ticket"),
                    "lang": part.column("lang"),
                    "at": pa.array([f and f[0].astype(np.uint16).tobytes() for f in found], pa.binary()),
                    "values": pa.array([f and f[1].astype(np.float32).tobytes() for f in found], pa.binary()),
                }
            )
            part = found = None
        give_back()

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: i for i, lang in enumerate(languages)}
        rows = [r for batch in batches for r in batch.to_pylist() if r["at"] is not None]
        rows.sort(key=lambda r: (r["ticket"], r["lang"], r["at"], r["values"]))
        w, b, t = fit(
            [
                (
                    place[r["lang"]],
                    np.frombuffer(r["at"], np.uint16).astype(np.int64),
                    np.frombuffer(r["values"], np.float32).astype(float),
                )
                for r in rows
            ],
            len(languages),
        )
        at = np.flatnonzero(w.any(1))
        yield pa.RecordBatch.from_pydict(
            {
                "at": pa.array([at.astype(np.int64).tobytes()], pa.binary()),
                "weights": pa.array([w[at].tobytes()], pa.binary()),
                "bias": pa.array([b.tobytes()], pa.binary()),
                "temperature": pa.array([t]),
            }
        )
        rows = w = None
        give_back()

    made = sample.mapInArrow(vectors, "ticket long, lang string, at binary, values binary").repartition(1)
    model = made.mapInArrow(fitted, "at binary, weights binary, bias binary, temperature double").first()
    weights = np.zeros((BUCKETS, len(languages)))
    weights[np.frombuffer(model["at"], np.int64)] = np.frombuffer(model["weights"]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights, np.frombuffer(model["bias"]).copy(), model["temperature"])
