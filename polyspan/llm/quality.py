"""Document quality by ordinal regression on graded ratings, over hashed text features.

One weight vector serves all grades; ordered thresholds cut its score into grades, with
P(grade <= k) = sigmoid(threshold_k - score). The model gives an expected grade and the probability of a grade of at
least `good`, which selects documents. Two grades are the smallest case, with one threshold.

The score of a text is the mean over its words of the weights of the word and of its shape (letters, capitals, digits
and signs, runs collapsed), plus weights of a few whole-text properties. The model is fitted on at most `max_rows`
rated documents of at most `MAX_BYTES`, chosen by the hash of their id (of several texts of an id the least); scoring
reads every text whole and moves none.

Null and empty texts score by their whole-text properties alone. Without ratings, or with one grade only, nothing is
known: expected grade and tail probability are null and every document is kept. Of ratings that repeat an id the greatest
counts; rows that repeat a text get equal results, and a tail probability of exactly `least` keeps the document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, fields, packed, q, raw_texts, spaced

MAX_ROWS = 6000
MAX_BYTES = 100_000  # of a text to learn from; with MAX_ROWS this bounds what reaches the driver
BUCKETS = 1 << 17
_KIND = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b > 127 else ord("0") if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def word_features(word: bytes) -> tuple[int, int]:
    """Buckets of a word and of its shape."""
    shape = _RUN.sub(rb"\1", word.translate(_KIND))
    return zlib.crc32(b"w" + word.lower()) % BUCKETS, zlib.crc32(b"s" + shape) % BUCKETS


def whole_features(words: list[bytes]) -> list[int]:
    """Buckets of whole-text properties: length, share of distinct words, share of words equal to the one before."""
    n = len(words)
    distinct = 10 * len(set(words)) // n if n else 10
    again = 10 * sum(map(bytes.__eq__, words, words[1:])) // n if n else 0
    return [zlib.crc32(f"{name}{value}".encode()) % BUCKETS for name, value in (("n", n.bit_length()), ("d", distinct), ("r", again))]


def features(text: bytes) -> tuple[list[int], list[float]]:
    """Sparse features of a text, for fitting."""
    words = spaced(text)
    found: Counter[int] = Counter()
    for word, k in Counter(words).items():
        for f in word_features(word):
            found[f] += k / len(words)
    for f in whole_features(words):
        found[f] += 1
    return list(found), list(found.values())


@dataclass
class Ordinal:
    """Fitted weights and thresholds; grades are 0 to the number of thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade, a row for each score."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1), axis=1)


def fit_ordinal(rows: list[tuple[list[int], list[float]]], grades: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> Ordinal:
    """Maximum likelihood by Adam over all rows; thresholds stay ordered as a first value and positive steps."""
    top = int(grades.max())
    index = np.concatenate([np.asarray(i, np.int64) for i, _ in rows])
    value = np.concatenate([np.asarray(v) for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    share = np.array([np.mean(grades <= k) for k in range(top)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    weights = np.zeros(BUCKETS)
    moments = [np.zeros_like(x) for x in (weights, weights, theta, theta)]
    for step in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        score = np.bincount(row, value * weights[index], minlength=len(rows))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
        high, low = sigmoid(edges[grades + 1] - score), sigmoid(edges[grades] - score)
        p = np.maximum(high - low, 1e-9)
        by_high, by_low = high * (1 - high) / p, low * (1 - low) / p
        by_score = (by_high - by_low) / len(rows)  # of the negative log-likelihood
        by_cut = np.array([(by_low[grades == k + 1].sum() - by_high[grades == k].sum()) / len(rows) for k in range(top)])
        by_theta = np.cumsum(by_cut[::-1])[::-1] * np.concatenate([[1.0], np.exp(theta[1:])])
        by_weights = np.bincount(index, value * by_score[row], minlength=BUCKETS) + decay * weights
        for x, g, m, v in ((weights, by_weights, *moments[:2]), (theta, by_theta, *moments[2:])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Ordinal(weights, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def fit(docs: DataFrame, ratings: DataFrame, text: str = "text", doc_id: str = "doc_id", grade: str = "quality", max_rows: int = MAX_ROWS) -> Ordinal | None:
    """A model of at most `max_rows` rated documents; None if there are fewer than two grades. Null grades are left out."""
    rated = ratings.select(ratings[doc_id].alias("id"), ratings[grade].cast("int").alias("grade")).where("id is not null and grade >= 0")
    chosen = rated.groupBy("id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t) for t in raw_texts(batch, "body")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))], ["id", "grade", "i", "v"])

    bodies = docs.select(docs[q(doc_id)].alias("id"), docs[q(text)].cast("binary").alias("body")).where(F.coalesce(F.length("body"), F.lit(0)) <= MAX_BYTES)
    found = bodies.join(F.broadcast(chosen), "id").groupBy("id", "grade").agg(F.min("body").alias("body")).select("id", "body", "grade")  # chosen: at most max_rows short rows
    schema = T.StructType([found.schema["id"], T.StructField("grade", T.IntegerType()), T.StructField("i", T.ArrayType(T.IntegerType())), T.StructField("v", T.ArrayType(T.FloatType()))])
    held = found.mapInArrow(run, schema).toArrow()
    rows = sorted(zip(held["id"].to_pylist(), held["grade"].to_pylist(), held["i"].to_pylist(), held["v"].to_pylist(), strict=True), key=lambda r: r[0])
    grades = np.array([r[1] for r in rows], np.int64)
    if len(np.unique(grades)) < 2:
        return None
    return fit_ordinal([(r[2], r[3]) for r in rows], grades)


def score(docs: DataFrame, model: Ordinal | None, text: str = "text", keep: list[str] = ("doc_id",), good: int = 1, least: float = 0.5) -> DataFrame:
    """The `keep` columns, expected_grade, tail_probability of a grade of at least `good`, and kept: whether that
    reaches `least`."""
    rows = docs.select(packed(docs, list(keep)).alias("row"), docs[q(text)].cast("binary").alias("text"))
    columns = ["expected_grade", "tail_probability", "kept"]
    if model is None:
        nothing = F.lit(None).cast("double")
        return rows.select(*fields("row", list(keep)), nothing.alias(columns[0]), nothing.alias(columns[1]), F.lit(True).alias(columns[2]))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ordinal(*shared.value)
        weight = Recent(lambda word: float(model.weights[list(word_features(word))].sum())).__getitem__
        for batch in batches:
            scores = []
            for body in raw_texts(batch):
                words = spaced(body)
                scores.append(sum(map(weight, words)) / max(1, len(words)) + float(model.weights[whole_features(words)].sum()))
            p = model.grades(np.array(scores, np.float64).reshape(-1))
            tail = p[:, good:].sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p @ np.arange(p.shape[1])), pa.array(tail), pa.array(tail >= least)], ["row", *columns])

    schema = T.StructType([rows.schema["row"], T.StructField(columns[0], T.DoubleType()), T.StructField(columns[1], T.DoubleType()), T.StructField(columns[2], T.BooleanType())])
    return rows.mapInArrow(run, schema).select(*fields("row", list(keep)), *columns)


def good_documents(docs: DataFrame, model: Ordinal | None, text: str = "text", **options) -> DataFrame:
    """The documents that the model keeps, all columns unchanged, whatever their names."""
    rows = docs.select(packed(docs).alias("row"), docs[q(text)].alias("text"))
    return score(rows, model, "text", keep=["row"], **options).where("kept").select(*fields("row", docs.columns))
