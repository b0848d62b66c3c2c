"""Removal of long repeated passages: documents are streamed against compressed FM-indexes over shards of the text.

A window is `WIDTH` consecutive words; windows with equal words have the same smallest k-gram hash, so they meet under
that key. Consecutive windows of a document under one key form a segment (at most WIDTH - k + 1 windows). Keys only
decide what meets where; which words are equal is decided by the index alone.

1. Segments are counted by key without their text. Keys that one document alone holds drop out.
2. The words of the other segments are fetched. Segments of the same words (by a 128-bit BLAKE2 digest) travel once.
3. A shard holds whole keys, some `SHARD_WORDS` words of distinct segments. Its FM-index is a Burrows-Wheeler transform
   in a wavelet tree (matrix layout: one packed bit vector with block counts a level), a bit vector of the places where
   suffixes stop agreeing on `WIDTH` words, and one small number for each class of equal windows: the least id. No
   suffix array, text or suffix order is kept.
4. All segments are streamed past the index of their shard in batches, searched backwards in step. The matching
   statistic of a place, cut at WIDTH, is the longest match that starts there; intervals that reach WIDTH are reported
   with the least id of their class, as runs.
5. A key with more than `KEY_SEGMENTS` different segments (around a passage that many documents share, each in other
   surroundings) is split by the smallest hash of longer k-grams, in the end by whole windows. So no key is unbounded,
   and none is cut off.

Null texts have no words; a null id is greater than all others; ids may be of any type that sorts; rows that repeat an
id and a text get equal results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import fields, join_hot, packed, q, raw_texts, spaced, table
from .decontam import suffix_array

WIDTH = 50
GRAMS = (16, 30, 45)
KEY_SEGMENTS = 2000
SHARD_WORDS = 300_000
_SALTS = 16
_BASE = 0x9E3779B97F4A7C15


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


class Segmenter:
    """Segments of a text's windows by key."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, gram
        self.known: dict[bytes, int] = {}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > 400_000:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """key, first window and number of windows of each segment."""
        n = len(words)
        if n < self.width:
            return (np.zeros(0, np.int64),) * 3
        a = self.numbers(words)
        h = np.zeros(n - self.gram + 1, np.uint64)
        for j in range(self.gram):
            h = h * np.uint64(_BASE) + a[j : n - self.gram + 1 + j]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        span = self.width - self.gram + 1
        key = _slide(h, span)
        turn = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(turn)
        within = np.arange(len(key)) - first[np.cumsum(turn) - 1]
        start = np.flatnonzero(within % span == 0)
        return key[start].view(np.int64), start, np.diff(np.append(start, len(key)))


class _Bits:
    """A bit vector packed in 64-bit blocks, with 32-bit counts of the ones before each block."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros(-(-(len(bits) + 1) // 64) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.blocks = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)])[:-1].astype(np.uint32)
        self.n, self.ones = len(bits), int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block].astype(np.int64) + np.bitwise_count(self.blocks[block] & below).astype(np.int64)

    def places(self) -> np.ndarray:
        """Where the ones are."""
        return np.flatnonzero(np.unpackbits(self.blocks.view(np.uint8), bitorder="little")[: self.n])

    @property
    def nbytes(self) -> int:
        return self.blocks.nbytes + self.before.nbytes


class FMIndex:
    """Of rows of words, each with an owner's rank: the least owner of every class of windows of `width` equal words."""

    def __init__(self, rows: list[list[bytes]], owners: np.ndarray, width: int):
        self.width = width
        sizes = np.array([len(r) for r in rows], np.int64)
        self.number = {w: i + 2 for i, w in enumerate(sorted({w for r in rows for w in r}))}
        text = np.concatenate([np.append(self.numbers(r), 1) for r in rows] + [np.zeros(1, np.int64)])
        order = suffix_array(text, width)
        n, symbols = len(text), len(self.number) + 2
        self.n = n
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.levels: list[tuple[int, _Bits]] = []
        self.symbol_at = np.zeros(symbols, np.int64)
        at, kind = text[order - 1], np.arange(symbols)  # the transform; the word before the first is the final 0
        for bit in reversed(range(max(1, int(symbols - 1).bit_length()))):
            ones = (at >> bit & 1).astype(bool)
            self.levels.append((bit, _Bits(ones)))
            self.symbol_at = self._step(self.levels[-1], kind, self.symbol_at)
            at = np.concatenate([at[~ones], at[ones]])
        # suffixes that agree on `width` words are neighbours; one bit marks where a class starts
        padded = np.concatenate([text, np.full(width, -1, np.int64)])
        same = np.ones(n - 1, bool)
        for d in range(width):
            live = np.flatnonzero(same)
            if not len(live):
                break
            x, y = padded[order[live + 1] + d], padded[order[live] + d]
            same[live] = (x == y) & (x > 1)
        turn = np.concatenate([[True], ~same])
        self.classes = _Bits(turn)
        owner = np.append(np.repeat(owners, sizes + 1), np.iinfo(np.int32).max)[order]
        self.least = np.minimum.reduceat(owner, np.flatnonzero(turn)).astype(np.int32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Words as symbols; 1 is none of the index."""
        return np.fromiter((self.number.get(w, 1) for w in words), np.int64, len(words))

    @property
    def nbytes(self) -> int:
        """What the search needs, beside the list of words."""
        return sum(b.nbytes for _, b in self.levels) + self.classes.nbytes + self.least.nbytes + self.below.nbytes + self.symbol_at.nbytes

    @staticmethod
    def _step(level: tuple[int, _Bits], symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        bit, bits = level
        ones = bits.rank(at)
        return np.where(symbol >> bit & 1, bits.n - bits.ones + ones, at - ones)

    def extend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One step of a backward search for one end of each interval."""
        start = at
        for level in self.levels:
            start = self._step(level, symbol, start)
        return self.below[symbol] + start - self.symbol_at[symbol]

    def _interval(self, row: np.ndarray, start: int, end: int) -> tuple[int, int]:
        """Of row[start:end], searched from nothing."""
        lo, hi = np.zeros(1, np.int64), np.full(1, self.n)
        for symbol in row[start:end][::-1]:
            lo, hi = self.extend(np.array([symbol]), lo), self.extend(np.array([symbol]), hi)
            if hi[0] <= lo[0]:
                break
        return int(lo[0]), int(hi[0])

    def matching_statistics(self, rows: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For every place of every row the length of its longest match in the index, cut at `width`, and the interval's
        first suffix. All rows are searched backwards in step."""
        sizes = np.array([len(r) for r in rows], np.int64)
        order = np.argsort(-sizes, kind="stable")
        steps = int(sizes.max(initial=0))
        back = np.ones((len(order), steps), np.int64)
        for k, r in enumerate(order.tolist()):
            back[k, : sizes[r]] = rows[r][::-1]
        lengths, first = np.zeros((len(order), steps), np.int16), np.zeros((len(order), steps), np.int64)
        lo, hi, size = np.zeros(len(order), np.int64), np.full(len(order), self.n), np.zeros(len(order), np.int64)
        ends = np.append(self.classes.places(), self.n) if len(order) else None
        for step in range(steps):
            k = int(np.searchsorted(-sizes[order], -step, side="left"))  # rows longer than `step`
            symbol = back[:k, step]
            a, z = self.extend(symbol, lo[:k]), self.extend(symbol, hi[:k])
            bad = np.flatnonzero((z <= a) | (symbol == 1))
            good = np.setdiff1d(np.arange(k), bad, assume_unique=True) if len(bad) else slice(0, k)
            lo[good], hi[good], size[good] = a[good], z[good], size[good] + 1
            for b in bad.tolist():
                lo[b], hi[b], size[b] = self._shorter(rows[order[b]], int(sizes[order[b]]) - 1 - step, int(size[b]))
            long = np.flatnonzero(size[:k] >= self.width)  # the interval of the first `width` words alone
            if len(long):
                group = self.classes.rank(lo[long] + 1) - 1
                lo[long], hi[long], size[long] = ends[group], ends[group + 1], self.width
            lengths[:k, step], first[:k, step] = size[:k], lo[:k]
        out, at = [None] * len(rows), [None] * len(rows)
        for k, r in enumerate(order.tolist()):
            out[r], at[r] = lengths[k, : sizes[r]][::-1], first[k, : sizes[r]][::-1]
        return out, at

    def _shorter(self, row: np.ndarray, place: int, size: int) -> tuple[int, int, int]:
        """The longest match at `place` where `size` + 1 words are too many: bisection, as every start of a match is one."""
        low, high, held = 0, size, (0, self.n)
        while low < high:
            mid = (low + high + 1) // 2
            lo, hi = self._interval(row, place, place + mid)
            if hi > lo and not (row[place : place + mid] == 1).any():
                low, held = mid, (lo, hi)
            else:
                high = mid - 1
        return (*held, low)

    def least_owners(self, rows: list[list[bytes]]) -> list[np.ndarray]:
        """For every window of every row the least owner of a window of the same words; the greatest integer if none."""
        lengths, first = self.matching_statistics([self.numbers(r) for r in rows])
        out = []
        for size, at in zip(lengths, first, strict=True):
            n = max(0, len(size) - self.width + 1)
            owner = self.least[self.classes.rank(at[:n] + 1) - 1]
            out.append(np.where(size[:n] >= self.width, owner, np.iinfo(np.int32).max))
        return out


def _runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, value) of the runs of equal values."""
    at = np.flatnonzero(np.diff(values, prepend=values[0] - 1 if len(values) else 0))
    return list(zip(at.tolist(), np.diff(np.append(at, len(values))).tolist(), values[at].tolist(), strict=True))


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _all_segments(width: int, gram: int, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Segmenter(width, gram)
        for batch in batches:
            found = [cut(spaced(body)) for body in raw_texts(batch, "body")]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            key, start, n = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("id").take(owner), batch.column("text_hash").take(owner), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], schema.names)

    return run


def _fetch(width: int, names: list[str]):
    """The words of the wanted segments, each once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            key, digest, start, count, body, owner = [], [], [], [], [], []
            for i, (wanted, text) in enumerate(zip(batch.column("wanted").to_pylist(), raw_texts(batch, "body"), strict=True)):
                words = spaced(text)
                for w in wanted:
                    line = b" ".join(words[w["start"] : w["start"] + w["n"] + width - 1])
                    d = _digest(line)
                    key.append(w["key"])
                    digest.append(d)
                    start.append(w["start"])
                    count.append(w["n"])
                    owner.append(i)
                    body.append(None if d in sent else line)
                    sent.add(d)
                if len(sent) > 500_000:
                    sent.clear()
            owner = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(digest, pa.binary()), batch.column("id").take(owner), batch.column("text_hash").take(owner), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(body, pa.binary())], names)

    return run


def _index(width: int, names: list[str]):
    """Rows sorted by shard, those to index before those to search; runs of windows with the least id out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, texts, ids, index, known = None, [], [], None, None
        for batch in batches:
            id_type = batch.schema.field("id").type
            out = [[] for _ in range(5)]
            waiting: list[tuple] = []

            def search(index=None, known=None, waiting=waiting, out=out):
                for (key, digest, words), least in zip(waiting, index.least_owners([w for _, _, w in waiting]), strict=True):
                    for a, n, rank in _runs(least):
                        if rank < len(known):
                            for held, x in zip(out, (key, digest, a, n, known[rank]), strict=True):
                                held.append(x)
                waiting.clear()

            for s, kind, key, digest, i, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "key", "digest", "id", "words")), strict=True):
                if s != shard:
                    if waiting:
                        search(index, known)
                    shard, texts, ids, index = s, [], [], None
                if kind == 0:
                    texts.append(spaced(words))
                    ids.append(i)
                    continue
                if index is None:
                    known = sorted({x for x in ids if x is not None})
                    rank = {x: k for k, x in enumerate(known)}
                    index = FMIndex(texts, np.array([rank.get(x, len(known)) for x in ids], np.int64), width)
                    texts, ids = [], []
                waiting.append((key, digest, spaced(words)))
            if waiting:
                search(index, known)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), id_type), strict=True)], names)

    return run


def _cut_again(width: int, gram: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Segmenter(width, gram)
        for batch in batches:
            out, owner = [[] for _ in range(6)], []
            for i, (up_key, up_digest, body) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "words")), strict=True)):
                words = spaced(body)
                for key, start, n in zip(*(x.tolist() for x in cut(words)), strict=True):
                    line = b" ".join(words[start : start + n + width - 1])
                    owner.append(i)
                    for held, x in zip(out, (key, _digest(line), line, up_key, up_digest, start), strict=True):
                        held.append(x)
            types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int32())
            columns = [pa.array(x, t) for x, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("id").take(pa.array(owner, pa.int64()))], names)

    return run


def _resolve(units: DataFrame, width: int, grams: tuple[int, ...], key_segments: int, shard_words: int) -> DataFrame:
    """(key, digest, at, len, least): for each of the different segments (key, digest, id, words; id the least that holds
    it) the runs of its windows by the least id that holds them."""
    id_type = units.schema["id"].dataType
    sizes = table(units.groupBy("key").count(), "sizes")
    hot = sizes.where(F.col("count") > key_segments)
    if grams and not hot.isEmpty():
        copies = hot.select("key", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"), F.lit(True).alias("hot"))
        units = table(units.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(_SALTS)).cast("int")).join(copies, ["key", "salt"], "left").drop("salt"), "marked")
        small = units.where("hot is null").drop("hot")
    else:
        small, hot = units, None
    words = small.agg(F.sum(F.length("words") - F.length(F.translate(F.col("words").cast("string"), " ", "")) + 2)).first()[0] or 0
    shards = max(1, math.ceil(words / shard_words))
    n = min(max(shards, 1), 100_000)
    rows = small.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "digest", "id", "words")
    streamed = rows.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("at", T.IntegerType()), T.StructField("len", T.IntegerType()), T.StructField("least", id_type)])
    found = table(streamed.repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_index(width, schema.names), schema), "found")
    if hot is None:
        return found
    finer = T.StructType([T.StructField("key", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("up_key", T.LongType()), T.StructField("up_digest", T.BinaryType()), T.StructField("offset", T.IntegerType()), T.StructField("id", id_type)])
    parts = table(units.where("hot").select("key", "digest", "id", "words").mapInArrow(_cut_again(width, grams[0], finer.names), finer), "parts")
    kinds = table(parts.groupBy("key", "digest").agg(F.min("id").alias("id"), F.first("words").alias("words"), F.count("*").alias("n")), "kinds")
    deeper = _resolve(kinds.drop("n"), width, grams[1:], key_segments, shard_words)
    answers = _answers(deeper, kinds)
    own = parts.select("key", "digest", "up_key", "up_digest", "offset")
    more = join_hot(own, answers, ["key", "digest"], "n", own.count()).select("up_key", "up_digest", "offset", F.explode("runs").alias("run"))
    return found.unionByName(more.select(F.col("up_key").alias("key"), F.col("up_digest").alias("digest"), (F.col("offset") + F.col("run.at")).cast("int").alias("at"), "run.len", "run.least"))


def _answers(found: DataFrame, kinds: DataFrame) -> DataFrame:
    """(key, digest, n, runs): all runs of each segment in one row, with how often it occurs."""
    runs = found.groupBy("key", "digest").agg(F.collect_list(F.struct("at", "len", "least")).alias("runs"))
    return table(kinds.select("key", "digest", "n").join(runs, ["key", "digest"]), "answers")


def repeats(rows: DataFrame, width: int = WIDTH, grams: tuple[int, ...] = GRAMS, key_segments: int = KEY_SEGMENTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, text_hash, spans): for rows (id, text_hash, body) with windows that a smaller id holds too, where those windows
    start and how many follow one another."""
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", id_type), T.StructField("text_hash", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())])
    segments = table(rows.select("id", "text_hash", "body").mapInArrow(_all_segments(width, grams[0], schema), schema), "segments")
    several = F.count_if(F.col("id").isNull()).alias("nulls")
    by_key = segments.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), several, F.count("*").alias("n"))
    by_key = table(by_key.where("low < high or (low is not null and nulls > 0)").select("key", F.col("n").alias("weight")), "keys")
    shared = join_hot(segments, by_key, ["key"], "weight", segments.count())
    wanted = table(shared.groupBy("id", "text_hash").agg(F.collect_list(F.struct("key", "start", "n")).alias("wanted")), "wanted")
    same = F.col("id").eqNullSafe(F.col("own")) & (F.col("text_hash") == F.col("own_hash"))
    texts = rows.select("id", "text_hash", "body").join(wanted.select(F.col("id").alias("own"), F.col("text_hash").alias("own_hash"), "wanted"), same)
    texts = texts.select("id", "text_hash", "wanted", "body")
    if not rows.groupBy("id", "text_hash").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["id", "text_hash"])
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("digest", T.BinaryType()), *schema.fields[1:], T.StructField("words", T.BinaryType())])
    held = table(texts.mapInArrow(_fetch(width, schema.names), schema), "held")
    kinds = table(held.groupBy("key", "digest").agg(F.min("id").alias("id"), F.count("*").alias("n")), "kinds")
    words = held.where("words is not null").groupBy("digest").agg(F.first("words").alias("words"))
    units = table(kinds.join(words, "digest").select("key", "digest", "id", "words"), "units")
    answers = _answers(_resolve(units, width, (*grams[1:], width), key_segments, shard_words), kinds)
    own = held.drop("words").withColumnRenamed("n", "windows")
    told = join_hot(own, answers, ["key", "digest"], "n", own.count()).select("id", "text_hash", "start", F.explode("runs").alias("run"))
    gone = told.where("run.least < id or (id is null and run.least is not null)")
    return table(gone.select("id", "text_hash", F.struct((F.col("start") + F.col("run.at")).cast("int").alias("start"), F.col("run.len").alias("n")).alias("span")).groupBy("id", "text_hash").agg(F.collect_list("span").alias("spans")), "spans")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] = ("doc_id",), width: int = WIDTH, **options) -> DataFrame:
    """The `keep` columns, n_words, n_removed and kept: the words that no window held by a smaller id covers, joined by
    one space. Windows are judged on the input. Kept columns must not bear the names of the new ones."""
    body = F.coalesce(docs[q(text)].cast("binary"), F.lit(b""))
    rows = docs.select(packed(docs, list(keep)).alias("row"), docs[q(doc_id)].alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("body"))
    found = repeats(rows, width, **options).select(F.col("id").alias("own"), F.col("text_hash").alias("own_hash"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for body, spans in zip(raw_texts(batch, "body"), batch.column("spans").to_pylist(), strict=True):
                words = spaced(body)
                sizes.append(len(words))
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [s["start"] for s in spans], 1)
                    np.add.at(edge, [s["start"] + s["n"] + width - 1 for s in spans], -1)
                    left = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                    words = [words[i] for i in left.tolist()]
                gone.append(sizes[-1] - len(words))
                kept.append(b" ".join(words).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept"])

    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    same = F.col("id").eqNullSafe(F.col("own")) & (F.col("text_hash") == F.col("own_hash"))
    out = rows.join(found, same, "left").select("row", "body", "spans").mapInArrow(run, schema)
    return out.select(*fields("row", list(keep)), "n_words", "n_removed", "kept")
