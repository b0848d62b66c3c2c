"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of the word itself and its character n-grams, hashed into buckets, so an
unseen misspelling shares most of its vector with the word. A text's vector is the mean over its words
and `BLANKS` empty ones. Embeddings and
softmax are fitted together on at most `max_rows` labelled documents, chosen by the hash of their id, a third of
them with label 1 where there are enough. Scoring reads every text whole and moves none; label, language, source and id are not
inputs.

Texts over `MAX_BYTES` are not learnt from; of several texts of an id the least is, and of labels that repeat an id the
greatest. Null ids are neither learnt nor held out. Rows that repeat a text get equal scores.

Null and empty texts have the zero vector and so the score of the bias. Without labels of both kinds the score is the
share of label 1 (0 without labels).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, alnum_words, fields, packed, q, raw_texts

MAX_ROWS = 6000
MAX_BYTES = 100_000  # of a text to learn from; with MAX_ROWS this bounds what reaches the driver
BUCKETS = 1 << 16
DIM = 6
BLANKS = 20  # words without a vector in every mean, so that a few odd words don't decide a short text
GAIN = 50.0  # embeddings are averaged over hundreds of words; this keeps their steps small


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learnt: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


_FACTOR = 0x9E3779B97F4A7C15


def subwords(words: list[bytes], shortest: int = 3, longest: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their character n-grams, word ends marked; and which word each belongs to."""
    marked = [f"<{w.decode(errors='replace')}>" for w in words]
    sizes = np.array([len(w) for w in marked], np.int64)
    letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % BUCKETS], [np.arange(len(words))]
    h = np.zeros(len(letters), np.uint64)
    for n in range(1, longest + 1):
        h = h[: len(letters) - n + 1] * np.uint64(_FACTOR) + letters[n - 1 :] + np.uint64(1)
        if n >= shortest and len(h):
            inside = owner[: len(h)] == owner[n - 1 :]
            buckets.append((((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64)[inside] % BUCKETS)
            owners.append(owner[: len(h)][inside])
        if len(h) <= 1:
            break
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Subwords:
    """What a subword adds to the log odds of label 1, and the bias; an embedding times the softmax weights' difference."""

    parts: np.ndarray
    bias: float

    def words(self, words: list[bytes]) -> np.ndarray:
        """What each word adds: the mean of its subwords."""
        bucket, owner = subwords(words)
        return np.bincount(owner, self.parts[bucket], len(words)) / np.bincount(owner, minlength=len(words))


class _Mean:
    """The mean of source rows for each target, with weights, and its transpose; both as sums over sorted runs."""

    def __init__(self, target: np.ndarray, source: np.ndarray, weight: np.ndarray, total: np.ndarray, n_source: int):
        n_target, weight = len(total), weight / total[target]
        self.ways = [self._way(target, source, weight, n_target), self._way(source, target, weight, n_source)]

    @staticmethod
    def _way(target, source, weight, n):
        order = np.argsort(target, kind="stable")
        run = target[order]
        first = np.flatnonzero(np.diff(run, prepend=-1))
        return source[order], weight[order].astype(np.float32), first, run[first], n

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        source, weight, first, at, n = self.ways[back]
        out = np.zeros((len(x), n), np.float32)
        if len(first):
            for k, row in enumerate(x):
                out[k, at] = np.add.reduceat(row[source] * weight, first)
        return out


def fit_subwords(bags: list[dict[bytes, int]], labels: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 1e-6, seed: int = 7) -> Subwords:
    """Gradient steps with momentum over all rows at once; words of one or two documents only are left out of fitting. The bias is then set so
    that a probability of one half splits the fitted rows with the fewest errors, label 1 weighted to be half of them."""
    seen = Counter(w for bag in bags for w in bag)
    number = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n > 2))}
    pairs = np.array([(d, number[w], n) for d, bag in enumerate(bags) for w, n in bag.items() if w in number], np.int64).reshape(-1, 3)
    bucket, owner = subwords(list(number))
    sizes = np.array([BLANKS + sum(bag.values()) for bag in bags], np.float64)
    texts = _Mean(pairs[:, 0], pairs[:, 1], pairs[:, 2].astype(np.float64), sizes, len(number))
    used, local = np.unique(bucket, return_inverse=True)
    words = _Mean(owner, local, np.ones(len(owner)), np.bincount(owner, minlength=len(number)).astype(np.float64), len(used))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (DIM, len(used))).astype(np.float32)
    weights, bias = rng.normal(0, 0.5, (2, DIM)).astype(np.float32), np.zeros((2, 1), np.float32)
    onehot = np.eye(2, dtype=np.float32)[:, labels]
    balance = (0.5 / np.maximum(onehot.mean(axis=1), 1e-6))[labels] / len(bags)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (table, weights, bias)]
    for _ in range(steps):
        vectors = GAIN * texts(words(table))
        logits = weights @ vectors + bias
        p = np.exp(logits - logits.max(axis=0))
        p /= p.sum(axis=0)
        by_logits = ((p - onehot) * balance).astype(np.float32)
        by_table = words(texts(GAIN * weights.T @ by_logits, back=True), back=True) + decay * table
        for x, g, (m, v) in zip((table, weights, bias), (by_table, by_logits @ vectors.T + decay * weights, by_logits.sum(axis=1, keepdims=True)), moments, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= rate * m / (np.sqrt(v.mean()) + 1e-12)  # one step size for all: words without a steady gradient hardly move
    side = np.zeros(BUCKETS)
    side[used] = GAIN * ((weights[1] - weights[0]) @ table)
    odds = (weights[1] - weights[0]) @ (GAIN * texts(words(table)))
    order = np.argsort(odds, kind="stable")
    wrong = np.cumsum(np.where(labels[order] == 1, balance[order], -balance[order]))  # by threshold above this row, less a constant
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    best = int(best[len(best) // 2])
    cut = (odds[order[best]] + odds[order[min(best + 1, len(order) - 1)]]) / 2
    return Subwords(side, -float(cut))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_rows: int = MAX_ROWS, learn: Column | None = None) -> Subwords:
    """A model of at most `max_rows` labelled documents; `learn` (over `labels`) says which rows may be learnt from,
    by default all that are not held out."""
    learn = ~held_out(labels[doc_id]) if learn is None else learn
    known = labels.where(learn).select(labels[doc_id].alias("id"), labels[label].cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    by_hash = [F.xxhash64("id"), F.col("id")]
    chosen = known.where("y = 1").orderBy(*by_hash).limit(max_rows // 3).unionByName(known.where("y = 0").orderBy(*by_hash).limit(max_rows - max_rows // 3))
    bodies = docs.select(docs[q(doc_id)].alias("id"), docs[q(text)].cast("binary").alias("body")).where(F.coalesce(F.length("body"), F.lit(0)) <= MAX_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [Counter(alnum_words(t)) for t in raw_texts(batch, "body")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array([list(b) for b in bags], pa.list_(pa.binary())), pa.array([list(b.values()) for b in bags], pa.list_(pa.int32()))], ["id", "y", "w", "n"])

    found = bodies.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("body").alias("body")).select("id", "body", "y")  # chosen: at most max_rows short rows
    schema = T.StructType([found.schema["id"], T.StructField("y", T.IntegerType()), T.StructField("w", T.ArrayType(T.BinaryType())), T.StructField("n", T.ArrayType(T.IntegerType()))])
    table = found.mapInArrow(run, schema).toArrow()
    rows = sorted(zip(table["id"].to_pylist(), table["y"].to_pylist(), table["w"].to_pylist(), table["n"].to_pylist(), strict=True), key=lambda r: r[0])
    y = np.array([r[1] for r in rows], np.int64)
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Subwords(np.zeros(BUCKETS), 40.0 if share else -40.0)
    return fit_subwords([dict(zip(r[2], r[3], strict=True)) for r in rows], y)


def score(docs: DataFrame, model: Subwords, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and score, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model.parts, model.bias))
    rows = docs.select(packed(docs, list(keep)).alias("row"), docs[q(text)].cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Subwords(*shared.value)
        weights = Recent(lambda word: float(model.words([word])[0]))
        for batch in batches:
            odds = []
            for a in range(0, batch.num_rows, 200):  # new words of some texts at once
                texts = [alnum_words(t) for t in raw_texts(batch.slice(a, 200))]
                new = list(set().union(*texts) - weights.keys() - weights.older.keys())
                for i in range(0, len(new), 20_000):
                    part = new[i : i + 20_000]
                    for word, value in zip(part, model.words(part).tolist(), strict=True):
                        weights.older[word] = value
                odds += [model.bias + sum(map(weights.__getitem__, words)) / (BLANKS + len(words)) for words in texts]
            out = 1 / (1 + np.exp(-np.clip(np.array(odds, np.float64).reshape(-1), -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], ["row", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).select(*fields("row", list(keep)), "score")
