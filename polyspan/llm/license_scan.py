"""License scans with a positional index of rare words.

The document frequency of every word of the licence templates is counted over the whole corpus. In each file the
words of each template with the highest inverse document frequency are looked up in its positional postings; places
that agree on a template and on the relative position (place in the file less place in the template) make a candidate
alignment. Neighbouring alignments of one template whose relative positions differ by at most `MOST_SHIFT` words are one
candidate, as where a name of several words is filled in or a clause is numbered otherwise. A candidate is verified by the
share of the template's words that stand in place, in the template's order, and by the template's mandatory key phrases
within that region.

Fixed phrases are found beside that, wherever their words stand consecutively. Null and empty texts have no words and
no labels; rows are kept one to one, whatever their ids, and rows that repeat a text get equal results. With an empty
corpus all frequencies are zero; words of equal frequency come in the order of their letters.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, fields, packed, q, raw_texts
from .license_texts import TEMPLATES

#: Phrases and the labels that they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
RARE = 12
LEAST_SHARE = 0.7
#: How many words may be put in or left out between two parts of a template, fewer than any clause that tells licences
#: apart; and from how many words on a template may come in parts, as one-line notices have no room for a name.
MOST_SHIFT, LONG = 12, 40
#: The share of a template's words that one of several parts must have in place: more than unrelated text has by chance.
LEAST_PART = 0.1


def _words(text: str) -> list[bytes]:
    return alnum_words(text.encode())


def document_frequency(docs: DataFrame, words: list[bytes], text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many texts each of the words stands, and how many texts there are; each task sends one row a word."""
    wanted = frozenset(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        n = 0
        for batch in batches:
            for body in raw_texts(batch, "body"):
                n += 1
                seen.update(wanted.intersection(alnum_words(body)))
        rows = [(b"", n), *seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["word", "n"])

    counts = docs.select(docs[q(text)].cast("binary").alias("body")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {bytes(r.word): r.n for r in counts.collect()}  # a row for each template word
    return found, found.pop(b"", 0)


class Index:
    """Positional postings of the templates, with the words' inverse document frequencies."""

    def __init__(self, frequency: dict[bytes, int], n_docs: int, templates=TEMPLATES, phrases=None, rare: int = RARE, least_share: float = LEAST_SHARE, most_shift: int = MOST_SHIFT):
        self.least, self.shift = least_share, most_shift
        self.templates = [(name, label, _words(text), [_words(k) for k in keys]) for name, label, text, keys in templates]
        self.phrases = [(_words(p), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, _, words, _) in enumerate(self.templates):
            for q, w in enumerate(words):
                self.postings[w].append((t, q))
        self.idf = {w: math.log((1 + n_docs) / (1 + frequency.get(w, 0))) for w in self.postings}
        self.firsts = {p[0] for p, _ in self.phrases}
        self.ranked = [sorted(set(words), key=lambda w: (-self.idf[w], w)) for _, _, words, _ in self.templates]
        # so many words of a template that two of them are in place in any alignment with the least share
        self.wanted = [max(rare, math.floor((1 - least_share) * len(words) + 1e-9) + 2) for _, _, words, _ in self.templates]

    @staticmethod
    def _at(words: list[bytes], phrase: list[bytes], start: int, end: int) -> list[int]:
        n, found, i = len(phrase), [], start
        while True:
            try:
                i = words.index(phrase[0], i, max(i, end - n + 1))
            except ValueError:
                return found
            if words[i : i + n] == phrase:
                found.append(i)
            i += 1

    def base(self, words: list[bytes], held: set[bytes]) -> list[tuple[int, str]]:
        """(start, label) of every place of a phrase."""
        return [(i, label) for phrase, label in self.phrases if held.issuperset(phrase) for i in self._at(words, phrase, 0, len(words))]

    def matches(self, words: list[bytes], held: set[bytes]) -> list[tuple[str, int, float]]:
        """(label, start, share of the template's words in place) of each verified alignment."""
        known = held & self.postings.keys()
        if len(known) < 2:
            return []
        # a template can only fit where its share of words is there at all
        reach = [sum(w in known for w in template) >= self.least * len(template) for _, _, template, _ in self.templates]
        rarest = [set([w for w in ranked if w in known][:n]) if r else set() for ranked, n, r in zip(self.ranked, self.wanted, reach, strict=True)]
        postings = {w: found for w in known if (found := [(t, q) for t, q in self.postings[w] if w in rarest[t]])}
        if not postings:
            return []
        votes: Counter[tuple[int, int]] = Counter()
        for p, w in enumerate(words):
            if w in postings:
                votes.update((t, p - q) for t, q in postings[w])
        found, places = [], defaultdict(list)
        for (t, at), n in votes.items():
            if n < 2:
                continue
            share, start, end = self._rigid(words, t, at)
            if share >= LEAST_PART:
                places[t].append(at)
            if share >= self.least and self._holds(words, t, start, end):
                found.append((self.templates[t][1], start, share))
        for t, at in places.items():
            if len(self.templates[t][2]) >= LONG:
                found += self._shifted(words, t, sorted(at), {m[1] for m in found if m[0] == self.templates[t][1]})
        return sorted(found, key=lambda m: (m[1], m[0]))

    def _rigid(self, words: list[bytes], t: int, at: int) -> tuple[float, int, int]:
        """The share of a template's words that stand in place if its first is at `at`, and the region."""
        template = self.templates[t][2]
        start, end = max(0, at), min(len(words), at + len(template))
        return sum(words[i] == template[i - at] for i in range(start, end)) / len(template), start, end

    def _holds(self, words: list[bytes], t: int, start: int, end: int) -> bool:
        return all(self._at(words, k, start, end) for k in self.templates[t][3])

    def _shifted(self, words: list[bytes], t: int, places: list[int], starts: set[int]) -> list[tuple[str, int, float]]:
        """Matches of a template in parts: one for each run of places whose neighbours differ by at most the shift, unless a
        rigid match starts in the run."""
        _, label, template, _ = self.templates[t]
        breaks = [i for i in range(1, len(places)) if places[i] - places[i - 1] > self.shift]
        found = []
        for i, z in zip([0, *breaks], [*breaks, len(places)], strict=True):
            low, high = places[i], places[z - 1]
            end = min(len(words), high + len(template))
            if low == high or any(max(0, low) <= s <= max(0, high) for s in starts):
                continue
            opening = lambda at: sum(words[p] == template[p - at] for p in range(max(0, at), min(len(words), at + LONG // 2)))
            start = max(0, max(places[i:z], key=lambda at: (opening(at), -at)))
            share = in_order(words, template, low, high) / len(template)
            if share >= self.least and self._holds(words, t, max(0, low), end):
                found.append((label, start, share))
        return found


def in_order(words: list[bytes], template: list[bytes], low: int, high: int) -> int:
    """How many of the template's words stand in their order in the text, each `low` to `high` places after its own in the
    template: the longest common subsequence within a band of alignments."""
    number = {w: i for i, w in enumerate(template)}
    wide, n = high - low + 1, len(template)
    text = np.full(n + wide, -1, np.int64)  # of the places low .. high + n
    inside = range(max(0, low), min(len(words), high + n))
    text[inside.start - low : inside.start - low + len(inside)] = [number.get(words[i], -1) for i in inside]
    best = np.zeros(wide + 1, np.int64)  # the last stays zero: beyond the band
    for q, w in enumerate(template):
        met = best[:-1] + (text[q : q + wide] == number[w])
        best[:-1] = np.maximum.accumulate(np.maximum(met, best[1:]))
    return int(best[:-1].max(initial=0))


_OUT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("phrases", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("label", T.StringType())]))),
    T.StructField("matches", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("share", T.DoubleType())]))),
]


def scan(docs: DataFrame, text: str = "text", keep: list[str] = ("doc_id",), templates=TEMPLATES, phrases=None, rare: int = RARE, least_share: float = LEAST_SHARE, most_shift: int = MOST_SHIFT) -> DataFrame:
    """The `keep` columns, n_words, phrases (start, label) and matches (label, start, share)."""
    frequency, n_docs = document_frequency(docs, [w for _, _, body, _ in templates for w in _words(body)], text)
    phrases = dict(PHRASES if phrases is None else phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(frequency, n_docs, templates, phrases, rare, least_share, most_shift)
        of_interest = set(index.firsts) | set(index.postings)
        kinds = (pa.list_(pa.struct([("start", pa.int32()), ("label", pa.string())])), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("share", pa.float64())])))
        for batch in batches:
            sizes, base, more = [], [], []
            for body in raw_texts(batch):
                words = alnum_words(body)
                held = of_interest.intersection(words)
                sizes.append(len(words))
                base.append([{"start": i, "label": x} for i, x in sorted(index.base(words, held | set(words) if held & index.firsts else held))])
                more.append([dict(zip(("label", "start", "share"), m, strict=True)) for m in index.matches(words, held)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.array(sizes, np.int64)), pa.array(base, kinds[0]), pa.array(more, kinds[1])], ["row", "n_words", "phrases", "matches"])

    rows = docs.select(packed(docs, list(keep)).alias("row"), docs[q(text)].cast("binary").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *_OUT])).select(*fields("row", list(keep)), "n_words", "phrases", "matches")
