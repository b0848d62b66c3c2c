"""Benchmark decontamination with suffix arrays of the training texts.

Documents stay where they are. A task takes some million words at a time as one shard, keeps the runs of words that
share a short n-gram with any test item (no other word can be in a window), sorts the suffixes of these runs, and
binary-searches every suffix of every test item in them. The interval of suffixes that begin with an item's window gives
all its occurrences; the neighbours of a test suffix give its longest verbatim match and where it lies. Intervals are
marked place by place and never paired with the test suffixes, so repeated words cost no more than others.

Test items reach the tasks in blocks of bounded size (an item is held whole). One block needs one pass over the
documents. Several blocks take a pass each, one after the other; the few texts with hits are written to a table and
joined by their hashes in the end. So a large benchmark costs passes, not memory.

Null and empty texts have no words and no matches; rows are kept one to one, whatever their ids; items without words
never occur; of equal items each counts; a null item id is the item "null".
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, fields, packed, q, raw_texts, table

WIDTH = 10
BLOCK_BYTES = 4_000_000
SHARD_WORDS = 2_000_000
GRAM = 4

def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` words at least (prefix doubling); ties by position."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth and len(words) > 1:
        key = rank * (int(rank.max()) + 1)
        key[:-k] += rank[k:] if k < len(rank) else 0
        order = np.argsort(key, kind="stable")
        step = np.empty(len(key), np.int64)
        step[order] = np.cumsum(np.concatenate([[1], np.diff(key[order]) != 0]))
        rank, k = step, 2 * k
        if rank.max() == len(rank):
            break
    return order


class Items:
    """A block of test items: their words as numbers in one row, 0 between items."""

    def __init__(self, rows: list[tuple[str, list[bytes]]], width: int):
        rows = [(i, w) for i, w in rows if w]
        self.names = [i for i, _ in rows]
        self.vocabulary = {w: k + 1 for k, w in enumerate(dict.fromkeys(chain.from_iterable(w for _, w in rows)))}
        self.words = np.array([x for _, ws in rows for x in (*map(self.vocabulary.__getitem__, ws), 0)], np.int64)
        sizes = np.array([len(w) for _, w in rows], np.int64)
        owner = np.repeat(np.arange(len(rows)), sizes + 1)
        left = np.repeat(np.cumsum(sizes + 1), sizes + 1) - 1 - np.arange(len(self.words))
        need = np.minimum(width, sizes)[owner] if len(rows) else np.zeros(0, np.int64)
        self.suffixes = np.flatnonzero((left >= need) & (left > 0))
        self.owner, self.need, self.left = owner[self.suffixes], need[self.suffixes], left[self.suffixes]
        self.first = np.cumsum(sizes + 1) - sizes - 1
        self.gram = int(min(GRAM, self.need.min(initial=GRAM)))
        self.longest = int(sizes.max(initial=1))
        self.grams = np.unique(self.hashes(self.words)[left >= self.gram]) if len(rows) else np.zeros(0, np.uint64)

    def hashes(self, words: np.ndarray) -> np.ndarray:
        """Of the `gram` words from each place on; places too near the end get some other value."""
        out = np.zeros(len(words), np.uint64)
        padded = np.concatenate([words, np.zeros(self.gram, words.dtype)]).astype(np.uint64)
        for k in range(self.gram):
            out = out * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(words)] * np.uint64(0xC2B2AE3D27D4EB4F)
        return out


def _bound(text: np.ndarray, order: np.ndarray, items: Items, which: np.ndarray, need: np.ndarray, upper: bool) -> np.ndarray:
    """For the test suffixes `which` the place of the first sorted suffix whose first `need` words are not less (upper: greater)."""
    lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(order))
    start = items.suffixes[which]
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        same = _common(text, order[mid], items.words, start[open_], need[open_])
        ours, theirs = text[np.minimum(order[mid] + same, len(text) - 1)], items.words[start[open_] + same]
        right = (same < need[open_]) & (ours < theirs) | ((same == need[open_]) & upper)
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]
    return lo


def _common(text: np.ndarray, a: np.ndarray, words: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words agree from text[a] and words[b] on, at most `most`; both end in a 0."""
    n, live = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
    while live.size:
        x, y = text[np.minimum(a[live] + n[live], len(text) - 1)], words[b[live] + n[live]]
        live = live[(x == y) & (x != 0)]
        n[live] += 1
        live = live[n[live] < most[live]]
    return n


class Shard:
    """What a block's items have in common with one stretch of text (numbers of words; 0 for words in no item)."""

    def __init__(self, text: np.ndarray, base: np.ndarray, items: Items):
        self.base, self.items, self.found = base, items, False
        hashed = items.hashes(text)
        start = np.flatnonzero(np.isin(hashed, items.grams) & (text != 0))
        covered = np.zeros(len(text) + items.gram + 1, np.int32)
        np.add.at(covered, start, 1)
        np.add.at(covered, start + items.gram, -1)
        kept = np.flatnonzero((np.cumsum(covered)[: len(text)] > 0) & (text != 0))
        if not len(kept):
            return
        gap = np.diff(kept, prepend=kept[0]) > 1
        place = np.arange(len(kept)) + np.cumsum(gap)  # a 0 stands between runs
        self.text, self.origin = np.zeros(int(place[-1]) + 2, np.int64), np.full(int(place[-1]) + 2, -1, np.int64)
        self.text[place], self.origin[place] = text[kept], kept
        self.order = suffix_array(self.text, items.longest + 1)
        every = np.arange(len(items.suffixes))
        lo = _bound(self.text, self.order, items, every, items.need, False)
        hi = _bound(self.text, self.order, items, every, items.need, True)
        self.live = np.flatnonzero(hi > lo)
        self.found = len(self.live) > 0
        # equal windows have one interval; windows of one length have disjoint ones
        self.classes, self.class_of = np.unique(np.stack([lo, hi, items.need])[:, self.live], axis=1, return_inverse=True)
        self.class_of = self.class_of.ravel()

    def _places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and place in the text of each occurrence of some classes."""
        lo, hi = self.classes[0, which], self.classes[1, which]
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(which, n), self.origin[self.order[at]]

    def hits(self, size: int) -> np.ndarray:
        """Which words lie in an occurrence of a window."""
        edge = np.zeros(size + 1, np.int64)
        for need in np.unique(self.classes[2]).tolist():
            _, at = self._places(np.flatnonzero(self.classes[2] == need))
            at = np.unique(at)
            edge[at] += 1
            np.add.at(edge, at + need, -1)
        return np.cumsum(edge)[:size] > 0

    def names(self) -> np.ndarray:
        """All different pairs (document, item), a row a pair. Pairs are made class by class and merged as they come."""
        owners = np.unique(np.stack([self.class_of, self.items.owner[self.live]]), axis=1)
        docs = []
        for need in np.unique(self.classes[2]).tolist():
            kind, at = self._places(np.flatnonzero(self.classes[2] == need))
            docs.append(np.unique(np.stack([kind, np.searchsorted(self.base, at, side="right") - 1]), axis=1))
        docs = np.concatenate(docs, axis=1)
        docs = docs[:, np.argsort(docs[0], kind="stable")]
        k = self.classes.shape[1]
        first_owner, n_owners = np.searchsorted(owners[0], np.arange(k)), np.bincount(owners[0], minlength=k)
        size = n_owners[docs[0]]
        ends, out, a = np.cumsum(size), np.zeros((2, 0), np.int64), 0
        while a < docs.shape[1]:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 1_000_000)))
            n = size[a:z]
            own = np.repeat(first_owner[docs[0, a:z]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out = np.unique(np.concatenate([out, np.stack([np.repeat(docs[1, a:z], n), owners[1, own]])], axis=1), axis=1)
            a = z
        return out

    def longest(self) -> list[tuple[int, int, int, int, int]]:
        """(document, start, length, item, start in the item) of the longest match of each test suffix that is not the rest
        of the match before it; of several places the first."""
        items, which = self.items, self.live
        left = items.left[which]
        at = _bound(self.text, self.order, items, which, left, False)
        size = np.zeros(len(which), np.int64)
        for k in (at - 1, at):
            ok = np.flatnonzero((k >= 0) & (k < len(self.order)))
            size[ok] = np.maximum(size[ok], _common(self.text, self.order[k[ok]], items.words, items.suffixes[which[ok]], left[ok]))
        before = np.zeros(len(which), np.int64)
        rest = np.flatnonzero((np.diff(which, prepend=-2) == 1) & (np.diff(items.suffixes[which], prepend=-2) == 1))
        before[rest] = size[rest - 1]
        keep = np.flatnonzero(size > before - 1)
        which, size = which[keep], size[keep]
        lo, hi = (_bound(self.text, self.order, items, which, size, up) for up in (False, True))
        spans = np.append(np.stack([lo, hi], axis=1).ravel(), 0)  # the last start only closes the range before it
        first = np.minimum.reduceat(np.append(self.origin[self.order], np.iinfo(np.int64).max), spans)[:-1:2] if len(lo) else lo
        doc = np.searchsorted(self.base, first, side="right") - 1
        start = items.suffixes[which] - items.first[items.owner[which]]
        return list(zip(doc.tolist(), (first - self.base[doc]).tolist(), size.tolist(), items.owner[which].tolist(), start.tolist(), strict=True))


_MATCH = pa.struct([("item", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("item_start", pa.int32())])
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_RESULT = "n_words long, spans array<struct<start:int,end:int>>, items array<string>, matches array<struct<item:string,start:int,length:int,item_start:int>>"


def _searched(block, width: int, shard_words: int, hits_only: bool):
    """Rows (row, text) in; row and the result columns out, for all rows or only for those with hits."""

    def shard(rows: list[pa.Array], docs: list[np.ndarray], items: Items) -> pa.RecordBatch:
        sizes = np.array([len(d) for d in docs], np.int64)
        base = np.concatenate([[0], np.cumsum(sizes + 1)])
        text = np.concatenate([np.append(d, 0) for d in docs]).astype(np.int64)
        spans, names, matches = {}, {}, {}
        got = Shard(text, base, items) if items.names else None
        if got is not None and got.found:
            hit = np.concatenate([[False], got.hits(len(text)), [False]])
            turn = np.flatnonzero(hit[1:] != hit[:-1])
            starts = turn[::2]
            for d, a, z in zip((np.searchsorted(base, starts, side="right") - 1).tolist(), starts.tolist(), turn[1::2].tolist(), strict=True):
                spans.setdefault(d, []).append({"start": a - int(base[d]), "end": z - int(base[d])})
            for d, i in got.names().T.tolist():
                names.setdefault(d, []).append(items.names[i])
            for d, a, n, i, b in got.longest():
                matches.setdefault(d, []).append({"item": items.names[i], "start": a, "length": n, "item_start": b})
        kept = sorted(spans) if hits_only else range(len(docs))
        row = pa.concat_arrays(rows)
        return pa.RecordBatch.from_arrays(
            [row.take(pa.array(kept, pa.int64())) if hits_only else row, pa.array(sizes[list(kept)] if hits_only else sizes, pa.int64())]
            + [pa.array([x.get(d, []) for d in kept], pa.list_(t)) for x, t in ((spans, _SPAN), (names, pa.string()), (matches, _MATCH))],
            ["row", "n_words", "spans", "items", "matches"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block.value, width)
        number = items.vocabulary.get
        rows, docs, size = [], [], 0
        for batch in batches:
            start = 0
            for i, text in enumerate(raw_texts(batch, "text")):
                docs.append(np.array([number(w, 0) for w in alnum_words(text)], np.int32))
                size += len(docs[-1])
                if size >= shard_words:
                    yield shard([*rows, batch.column("row").slice(start, i + 1 - start)], docs, items)
                    rows, docs, size, start = [], [], 0, i + 1
            if start < batch.num_rows:
                rows.append(batch.column("row").slice(start))
        if docs:
            yield shard(rows, docs, items)

    return run


def find(docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The `keep` columns, n_words, spans (words covered by windows that occur in an item, merged), items (ids, in no
    order) and matches (item, start, length, item_start): for each place of an item the longest verbatim match in a
    shard, told for the first document that holds it, without those that are the rest of another.

    A window is `width` consecutive words of an item; a shorter item is one window. At most about `block_bytes` of
    items are held at once.
    """
    spark = docs.sparkSession
    tests = items.select(F.coalesce(items[q(item_id)].cast("string"), F.lit("null")).alias("i"), F.coalesce(items[q(item_text)].cast("binary"), F.lit(b"")).alias("t")).distinct()
    total = tests.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    body = F.coalesce(docs[q(text)].cast("binary"), F.lit(b""))
    rows = docs.select(packed(docs, list(keep)).alias("row"), body.alias("text"))
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(_RESULT).fields])
    columns = [*fields("row", list(keep)), "n_words", "spans", "items", "matches"]

    def broadcast(block: DataFrame):
        return spark.sparkContext.broadcast([(r.i, alnum_words(bytes(r.t))) for r in block.collect()])  # some `block_bytes`

    if blocks == 1:
        return rows.mapInArrow(_searched(broadcast(tests), width, shard_words, False), schema).select(*columns)
    hashes = F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b"))
    by_hash = rows.select(hashes.alias("row"), "text")
    passes = None
    for b in range(blocks):
        held = broadcast(tests.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b))
        got = table(by_hash.mapInArrow(_searched(held, width, shard_words, True), T.StructType([by_hash.schema["row"], *schema.fields[1:]])), "block")
        held.destroy()
        passes = got if passes is None else passes.unionByName(got)
    # equal texts of one shard share their matches; the result of a text is that of all its copies
    merged = passes.groupBy("row").agg(F.first("n_words").alias("n_words"), *(F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("spans", "items", "matches")))
    merged = table(merged.withColumn("spans", _merged("spans")), "hits").select(F.col("row").alias("hashes"), "spans", "items", "matches")
    nothing = [F.coalesce(c, F.from_json(F.lit("[]"), schema[c].dataType)).alias(c) for c in ("spans", "items", "matches")]
    counted = rows.select("row", hashes.alias("hashes"), _n_words("text").alias("n_words"))
    return counted.join(merged, "hashes", "left").select("row", "n_words", *nothing).select(*columns)


def _n_words(column: str):
    """Runs of word characters: a word starts where no word character stands before. The letters' case does not matter."""
    return F.size(F.regexp_extract_all(F.col(column).cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).cast("long")


def _merged(column: str):
    """Spans in order, those that meet made one."""

    def step(done, s):
        last = F.element_at(done, -1)
        one = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(column), F.expr("cast(array() as array<struct<start:int,end:int>>)"), step)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without a window of any item, all columns unchanged, whatever their names."""
    rows = docs.select(packed(docs).alias("row"), docs[q(text)].alias("text"))
    return find(rows, items, text="text", keep=["row"], **options).where(F.size("spans") == 0).select(*fields("row", docs.columns))
