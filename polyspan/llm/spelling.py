"""Spelling variant grouping with a dictionary of trie-node pairs.

1. Words and their counts come from all texts, counted within tasks before the shuffle.
2. The nodes of the trie of all words, and of the trie of all reversed words, are numbered: words are dealt in ranges and
   sorted, and a word shares the nodes of the prefix that it has in common with the word before it. Nodes that several
   ranges share are prefixes of the words at the ranges' borders, and take their numbers from these.
3. A word enters the dictionary under the pairs (prefix node, suffix node) that together give the whole word, and under
   those that skip one of its letters. Two words under one pair, both with a skipped letter, differ by a replaced
   one; a skipped letter beside a whole word is a deletion. Node numbers stand for exact prefixes and suffixes, so what
   meets is near, with no check of letters. A pair has at most one whole word, and a word for each letter that fits.
4. What a word learns under a pair is a count and its best neighbour there; pairs of words are never listed.
5. Forms are followed to their roots by pointer jumping.

Null texts have no words and a null id counts as an empty one; repeated rows count each time. Very long words take work and
memory in proportion to their length. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, raw_texts, saved

#: Words: least length in code points and least number of occurrences; how many times a form's n is at least the word's.
LEAST_LENGTH, LEAST_N, FORM_TIMES = 7, 2, 10
#: One in so many (document, run) pairs loses a code point.
DELETE_ONE_IN = 31
#: Words counted in a task before they are handed on.
COUNTED_AT_ONCE = 400_000
#: Sampled words for each range, from which the ranges' borders are taken.
SAMPLED = 40
_SHIFT = 40


def _counts(least: int):
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = defaultdict(int)
        for batch in batches:
            for doc, raw in zip(batch.column("doc").to_pylist(), raw_texts(batch)):
                for word, n in Counter(runs.findall(raw.lower().decode())).items():
                    h = zlib.crc32(f"{doc}:{word}".encode())
                    if h % DELETE_ONE_IN == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= COUNTED_AT_ONCE:
                    yield _batch(word=list(held), n=list(held.values()))
                    held.clear()
        if held:
            yield _batch(word=list(held), n=list(held.values()))

    return run


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def words(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: runs of at least LEAST_LENGTH letters with at least LEAST_N occurrences in all texts, A-Z in lower case,
    with the deletions that the CRC-32 of document and run decide."""
    row = packed(docs, [doc, text])
    source = docs.select(F.coalesce(row[doc].cast("string"), F.lit("")).alias("doc"), row[text].alias("text"))
    return source.mapInArrow(_counts(LEAST_LENGTH), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1  # a[:lo] == b[:lo], a[:hi + 1] != b[:hi + 1]
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _borders(found: DataFrame, key: str, ranges: int, total: int) -> list[str]:
    """Words that part `ranges` ranges of about equal size, from a sample of some SAMPLED words a range."""
    share = min(1 << 20, -(-(SAMPLED * ranges << 20) // max(total, 1)))
    sample = sorted(r[0] for r in found.where(F.xxhash64("word").bitwiseAND((1 << 20) - 1) < share).select(key).collect())
    return sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []


def _in_ranges(found: DataFrame, key: str, borders: list[str], n: int) -> DataFrame:
    """Rows with the number `part` of their range, a range in one task, in order."""
    shared = found.sparkSession.sparkContext.broadcast(borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [bisect_right(shared.value, w) for w in batch.column(key).to_pylist()]
            yield batch.append_column("part", pa.array(parts, pa.int32()))

    dealt = found.mapInArrow(run, T.StructType([*found.schema.fields, T.StructField("part", T.IntegerType())]))
    return dealt.repartition(n, "part").sortWithinPartitions("part", key)


class _Trie:
    """Numbers the nodes of words that come in order, a range after the other."""

    def __init__(self, borders: list[str]):
        self.borders, self.part = borders, -1
        # Prefixes of the borders have numbers below zero; the root is -1.
        self.border_nodes, last, nodes, left = [], "", [-1], -2
        for word in borders:
            depth = _common(last, word)
            nodes = nodes[: depth + 1] + list(range(left, left - len(word) + depth, -1))
            left -= len(word) - depth
            self.border_nodes.append(nodes)
            last = word

    def __call__(self, part: int, word: str) -> list[int]:
        """The nodes of the prefixes of all lengths, from none to the whole word."""
        if part != self.part:
            self.part, self.next, self.word, self.nodes = part, part << _SHIFT, "", [-1]
            self.beside = [(self.borders[k], self.border_nodes[k]) for k in (part - 1, part) if 0 <= k < len(self.borders)]
        depth, nodes = _common(self.word, word), self.nodes
        for border, its_nodes in self.beside:
            if (d := _common(border, word)) > depth:
                depth, nodes = d, its_nodes
        new = len(word) - depth
        self.word, self.nodes = word, nodes[: depth + 1] + list(range(self.next, self.next + new))
        self.next += new
        return self.nodes


def _forward(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, part, place = _Trie(shared.value), -1, 0
        for batch in batches:
            ids, nodes = [], []
            for p, word in zip(batch.column("part").to_pylist(), batch.column("word").to_pylist()):
                part, place = p, place + 1 if p == part else 0
                ids.append(p << _SHIFT | place)
                nodes.append(trie(p, word))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column("word"), batch.column("n"), pa.array(nodes, pa.list_(pa.int64()))], ["id", "word", "n", "nodes"])

    return run


def _entries(shared):
    """A word's entries in the dictionary: kind 0 for the whole word, 1 and 2 with a letter skipped; of a run of equal letters,
    any of which gives the same word when skipped, the last has kind 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _Trie(shared.value)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "backward", "nodes", "id", "n"))
            p, s, kind, times, ids, ns = [], [], [], [], [], []
            for part, backward, prefix, i, n in zip(*columns):
                suffix = trie(part, backward)[::-1]
                p += prefix + prefix[:-1]
                s += suffix + suffix[1:]
                word = backward[::-1]
                kind += [0] * len(prefix) + [1 if a == b else 2 for a, b in zip(word, word[1:])] + [2]
                times.append(2 * len(prefix) - 1)
                ids.append(i)
                ns.append(n)
            yield _batch(p=p, s=s, id=np.repeat(ids, times), n=np.repeat(ns, times), kind=np.array(kind, np.int8))

    return run


def _best_two(group: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their group, largest n first (ties: smallest id), where each group starts, and its size."""
    order = np.lexsort((ids, -n, group))
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    return order, first, np.diff(first, append=len(order))


def _learnt(p, s, ids, n, kind) -> list[tuple[np.ndarray, ...]]:
    """(id, near words, n and id of the best of them) that words learn under the pairs of nodes, which come in order."""
    group = np.cumsum(np.r_[True, (p[1:] != p[:-1]) | (s[1:] != s[:-1])]) - 1
    several = np.bincount(group)[group] > 1
    group, ids, n, kind = group[several], ids[several], n[several], kind[several]
    found = []
    # Skipped letters under one pair: replacements.
    skip = np.flatnonzero(kind > 0)
    order, first, size = _best_two(group[skip], ids[skip], n[skip])
    first, size = first[size > 1], size[size > 1]
    rows = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    top = skip[order[np.repeat(first, size)]]
    best = np.where(rows == np.repeat(first, size), skip[order[np.repeat(first + 1, size)]] if len(first) else top, top)
    found.append((ids[skip[order[rows]]], np.repeat(size - 1, size), n[best], ids[best]))
    # A whole word, and words with a letter more.
    whole = np.flatnonzero(kind == 0)
    more = np.flatnonzero(kind == 2)
    order, first, size = _best_two(group[more], ids[more], n[more])
    at = np.full(group[-1] + 1 if len(group) else 0, -1)
    at[group[whole]] = whole
    own = at[group[more[order[first]]]]
    met = own >= 0
    best = more[order[first[met]]]
    found.append((ids[own[met]], size[met], n[best], ids[best]))
    own = at[group[more]]
    found.append((ids[more[own >= 0]], np.ones((own >= 0).sum(), np.int64), n[own[own >= 0]], ids[own[own >= 0]]))
    return found


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("p", "s", "id", "n", "kind")
    rest = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        # The last pair may go on in the next batch.
        end = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        end = end[-1] + 1 if len(end) else 0
        rest = [x[end:] for x in now]
        if end:
            yield from _told([x[:end] for x in now])
    if rest is not None:
        yield from _told(rest)


def _told(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for ids, near, n, best in _learnt(*columns):
        if len(ids):
            yield _batch(id=ids, near=near, best_n=n, best=best)


def neighbours(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words (id, word, n), ids in the order of the words; and (id, n_near, best_n, best) of those that have near
    words: how many, and n and id of the one with the largest n (ties: the first in order). `found` is read several times: give a
    table."""
    spark = found.sparkSession
    n, total = int(spark.conf.get("spark.sql.shuffle.partitions")), found.count()
    borders = _borders(found, "word", n, total)
    named = saved(_in_ranges(found, "word", borders, n).mapInArrow(_forward(spark.sparkContext.broadcast(borders)), "id long, word string, n long, nodes array<long>"))
    backward = named.withColumn("backward", F.reverse("word"))
    borders = _borders(backward, "backward", n, total)
    dealt = _in_ranges(backward.drop("word"), "backward", borders, n)
    entries = dealt.mapInArrow(_entries(spark.sparkContext.broadcast(borders)), "p long, s long, id long, n long, kind byte")
    met = entries.repartition(n, "p", "s").sortWithinPartitions("p", "s").mapInArrow(_meet, "id long, near long, best_n long, best long")
    best = F.max(F.struct("best_n", (-F.col("best")).alias("back"))).alias("b")
    learnt = met.groupBy("id").agg(F.sum("near").alias("n_near"), best).select("id", "n_near", "b.best_n", (-F.col("b.back")).alias("best"))
    return named.select("id", "word", "n"), learnt


def roots(links: DataFrame) -> DataFrame:
    """(id, root) for links (id, form) without circles: each round every word looks up where its last known form leads, so
    chains of k forms take log2(k) rounds."""
    now = saved(links.select("id", F.col("form").alias("root"), F.lit(True).alias("open")))
    while now.where("open").limit(1).count():
        up = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        now = saved(now.join(up, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open")))
    return now.select("id", "root")


def variants(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of `docs` (see `words`).

    Near words differ by one inserted, deleted or replaced code point. A word's form is its near word of largest n (ties: the
    smallest in code-point order) if that n is at least FORM_TIMES the word's; root is where forms lead in the end.
    """
    named, learnt = neighbours(saved(words(docs, doc, text)))
    form = F.when(F.col("best_n") >= FORM_TIMES * F.col("n"), F.col("best"))
    rows = saved(named.join(learnt, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")))
    links = rows.where("form is not null").select("id", "form")
    name = lambda column: rows.select(F.col("id").alias(column), F.col("word").alias(f"{column}_word"))
    led = links.join(roots(links), "id").join(name("form"), "form").join(name("root"), "root").select("id", "form_word", "root_word")
    whole = rows.drop("form").join(led, "id", "left")
    return whole.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
