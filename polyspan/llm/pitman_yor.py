"""Language-model scoring by a hierarchical Pitman-Yor model of words after words.

The restaurant of a context (the word before) has a customer for each training token that follows it. Customers of one word
sit at tables; each table is a customer of the parent restaurant, which all contexts share and whose own parent is
uniform over the known words and one for all others. Seating is sampled by Gibbs: a customer gets up and sits
down again, at a table by its size less the discount or at a new one by what the parent expects. Predictive
probabilities are averaged over the last SAMPLES rounds.

1. Tasks number the words of chunks of some 7 MB of text. The chunks' dictionaries are shuffled by word, which gives counts
   and numbers of the whole corpus.
2. The chunks' pairs of words are shuffled by context and counted. A context with more than a bucket's share of the tokens is
   dealt by its following words to as many buckets as it fills.
3. In each round the buckets seat their customers against the parent of the round before, and the parent's restaurant,
   dealt by word, seats one customer for each table. Within a sweep the number of a restaurant's tables is that of the
   sweep's start, so all words of a restaurant are seated at once, customer by customer. A pair that occurs once has one
   table and needs no sampling. More than BLOCK customers of one word are seated in blocks that share no table, which adds less
   than one table for BLOCK customers.
4. Counts of words and tables return to the chunks, which score their documents.

The discount is n1 / (n1 + 2 n2) of each level's counts, the strength STRENGTH. Everything is counted over all training
documents; messages are one packed row for a sender and receiver, so a frequent word is no hot key. Seeds are fixed: the same input and
number of buckets give the same scores. Null and empty texts are a single end token. A null id counts as an empty one; repeated
rows count each time and get equal scores. Without training documents every probability is one.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import by_bucket, packed, raw_texts, saved, squeeze, stream, unsqueeze, unwide, wide

CHUNK_BYTES = 7_000_000
#: Texts whose words, and whose pairs, share a bucket. What a bucket tells others is a message each, so their number follows the data,
#: not the partitions.
BUCKET_BYTES = 16_000_000
LEAST_BUCKETS = 48
#: Rounds, how many of the last are averaged, sweeps of the contexts' customers in a round.
ROUNDS, SAMPLES, SWEEPS = 3, 2, 2
STRENGTH = 1.0
BLOCK = 1024
_SEED = 7
#: Messages: what, to whom, from whom, up to four sums, and packed arrays.
_ROWS = "kind string, key long, sender long, a long, b long, c long, d long, blob binary"
_SCHEMA = pa.schema([("kind", pa.string()), *((x, pa.int64()) for x in ("key", "sender", "a", "b", "c", "d")), ("blob", pa.binary())])


def _message(kind: str, key: int, sender: int, blob: bytes = b"", a: int = 0, b: int = 0, c: int = 0, d: int = 0) -> dict:
    return {"kind": kind, "key": key, "sender": sender, "a": int(a), "b": int(b), "c": int(c), "d": int(d), "blob": blob}


def _table(messages: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(messages, _SCHEMA)


def _pack(*arrays) -> bytes:
    return squeeze(*map(wide, arrays), level=5)


def _unpack(blob: bytes) -> list[np.ndarray]:
    return [unwide(x) for x in unsqueeze(blob)]


def _received(rows: pa.Table) -> dict[str, dict[int, bytes]]:
    """Blobs by kind and sender."""
    found = defaultdict(dict)
    for kind, sender, blob in zip(*(rows.column(c).to_pylist() for c in ("kind", "sender", "blob"))):
        found[kind][sender] = blob
    return found


def held_out(doc):
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _chunks(buckets: int, chunk_bytes: int):
    """Documents of a chunk as numbers of its words, and its words with their training tokens, by bucket. Word 0 is the end."""

    def emit(chunk: int, kept: list[pa.RecordBatch], docs: list[np.ndarray], words: dict[bytes, int]) -> pa.RecordBatch:
        n = np.array([len(d) + 1 for d in docs])
        used = np.concatenate([x for d in docs for x in (d, [0])]).astype(np.int64)
        train = np.concatenate([b.column("_train").to_numpy(zero_copy_only=False) for b in kept])
        order = np.argsort(-np.bincount(used, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        used = rank[used]
        counts = np.bincount(used[np.repeat(train, n)], minlength=len(words))
        named = list(words)
        named = [named[i] for i in order.tolist()]
        own = np.fromiter((zlib.crc32(w) % buckets for w in named), np.int64, len(named))
        rows = [_message("docs", chunk, chunk, squeeze(stream(kept), wide(n), wide(used), wide(own), wide([rank[0]])))]
        for b, places in by_bucket(own, buckets):
            raw = [named[i] for i in places.tolist()]
            rows.append(_message("words", b, chunk, squeeze(wide([len(w) for w in raw]), b"".join(raw), wide(counts[places]), level=9)))
        return _table(rows).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, empty = TaskContext.get().partitionId() << 32, lambda: defaultdict(None, {b"": 0})
        kept, docs, words, size = [], [], empty(), 0
        words.default_factory = words.__len__
        for batch in batches:
            start = 0
            rest = batch.drop_columns(["_text"])
            for i, text in enumerate(raw_texts(batch, "_text")):
                docs.append(np.fromiter(map(words.__getitem__, text.lower().split()), np.uint32))
                size += len(text) + 1
                if size >= chunk_bytes:
                    kept.append(rest.slice(start, i + 1 - start))
                    yield emit(chunk, kept, docs, words)
                    chunk, kept, docs, words, size, start = chunk + 1, [], [], empty(), 0, i + 1
                    words.default_factory = words.__len__
            if start < batch.num_rows:
                kept.append(rest.slice(start))
        if docs:
            yield emit(chunk, kept, docs, words)

    return run


def _numbered(rows: pa.Table) -> pa.Table:
    """Numbers of a bucket's words by falling count, told to the chunks with the count; and the bucket's training tokens and words."""
    total, lists = defaultdict(int), []
    for chunk, blob in _received(rows)["words"].items():
        length, raw, counts = unsqueeze(blob)
        ends = np.cumsum(unwide(length)).tolist()
        words, counts = [raw[a:z] for a, z in zip([0, *ends[:-1]], ends)], unwide(counts).tolist()
        lists.append((chunk, words))
        for w, n in zip(words, counts):
            total[w] += n
    number = {w: k for k, w in enumerate(sorted(total, key=lambda w: (-total[w], w)))}
    bucket = rows.column("key")[0].as_py()
    told = [_message("ids", chunk, bucket, _pack([number[w] for w in words], [total[w] for w in words])) for chunk, words in lists]
    return _table([*told, _message("size", bucket, bucket, a=sum(total.values()), b=sum(n > 0 for n in total.values()))])


class _Chunk:
    """A chunk's documents with the numbers and counts of their words."""

    def __init__(self, got: dict[str, dict[int, bytes]], told: dict[int, bytes], buckets: int):
        self.rows, n, used, own, end = unsqueeze(next(iter(got["docs"].values())))
        self.n, self.used, self.own, end = unwide(n), unwide(used), unwide(own), unwide(end)[0]
        self.told = []
        for b, places in by_bucket(self.own, buckets):
            for k, values in enumerate(_unpack(told[b])):
                if k == len(self.told):
                    self.told.append(np.zeros(len(self.own), np.int64))
                self.told[k][places] = values
        before = np.concatenate([[end], self.used[:-1]])
        before[np.cumsum(self.n)[:-1]] = end
        code, self.place = np.unique(before * len(self.own) + self.used, return_inverse=True)
        self.u, self.w = code // len(self.own), code % len(self.own)


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def _pair_bucket(u: np.ndarray, w: np.ndarray, n_u: np.ndarray, tokens: int, buckets: int) -> np.ndarray:
    """The bucket of a pair: one for a context, or as many neighbouring ones as its share of all tokens fills."""
    parts = np.maximum(1, -(-n_u * buckets // max(tokens, 1))).astype(np.uint64)
    return ((_mixed(u) + _mixed(w + 1) % parts) % np.uint64(buckets)).astype(np.int64)


def _ordered_pairs(chunk: _Chunk, tokens: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, places, u, w) of a chunk's distinct pairs, all of a context together. The same each time that it is asked."""
    number, count = chunk.told[0] * buckets + chunk.own, chunk.told[-1]
    u, w = number[chunk.u], number[chunk.w]
    for b, places in by_bucket(_pair_bucket(u, w, count[chunk.u], tokens, buckets), buckets):
        yield b, places, u[places], w[places]


def _pairs(tokens: int, buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        got = _received(rows)
        chunk = _Chunk(got, got["ids"], buckets)
        train = pa.ipc.open_stream(chunk.rows).read_all().column("_train").to_numpy()
        n = np.bincount(chunk.place[np.repeat(train, chunk.n)], minlength=len(chunk.u))
        key, count = rows.column("key")[0].as_py(), chunk.told[1]
        return _table([_message("pairs", b, key, _pack(np.diff(u, prepend=0), w, n[places], count[chunk.u[places]])) for b, places, u, w in _ordered_pairs(chunk, tokens, buckets)])

    return run


def _to_words(kind: str, w: np.ndarray, n: np.ndarray, bucket: int, buckets: int) -> list[dict]:
    """Numbers of distinct words, to the words' buckets."""
    return [_message(kind, b, bucket, _pack(np.diff(w[own], prepend=0), n[own])) for b, own in by_bucket(w % buckets, buckets)]


def _added(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and the sums of their numbers."""
    words, place = np.unique(w, return_inverse=True)
    return words, np.bincount(place, weights=n, minlength=len(words)).astype(np.int64)


def _hot(us: np.ndarray, n_u: np.ndarray, tables: np.ndarray, bucket: int, tokens: int, buckets: int) -> list[dict]:
    """This bucket's tables of the contexts that several buckets share."""
    return [_message("hot", int(us[k]), bucket, a=tables[k]) for k in np.flatnonzero(n_u * buckets > tokens)]


def _merged(tokens: int, buckets: int):
    """The pairs of a bucket added up. `model`: contexts with tokens, their size and pairs that occur once, and the pairs that
    occur more often. `codes`: for a chunk's pairs 0 (never in training), 1 (once) or 2 and the number of the pair.
    `single` and `heavy`: customers of the words' common restaurant, one for each pair to begin with."""

    def run(rows: pa.Table) -> pa.Table:
        got, bucket = _received(rows)["pairs"], rows.column("key")[0].as_py()
        senders = sorted(got)
        parts = [_unpack(got[s]) for s in senders]
        u, w, n, n_u = (np.concatenate(x) for x in zip(*((np.cumsum(p[0]), *p[1:]) for p in parts)))
        contexts, row = np.unique(u, return_inverse=True)
        words, word = np.unique(w, return_inverse=True)
        code, first, place = np.unique(row * len(words) + word, return_index=True, return_inverse=True)
        u, w, n_u, n = contexts[code // len(words)], words[code % len(words)], n_u[first], np.bincount(place, weights=n).astype(np.int64)
        heavy = n > 1
        code = np.where(heavy, np.cumsum(heavy) + 1, n)
        us, at = np.unique(u[n > 0], return_index=True)
        row = np.searchsorted(us, u)  # of pairs with tokens
        once, more = (np.bincount(row[which], minlength=len(us)) for which in (n == 1, heavy))
        out = [_message("model", bucket, bucket, _pack(np.diff(us, prepend=0), n_u[n > 0][at], once, more, w[heavy], n[heavy]), a=(n == 1).sum(), b=(n == 2).sum())]
        ends = np.cumsum([len(p[0]) for p in parts])
        out += [_message("codes", bucket, s, _pack(code[place[e - len(p[0]) : e]])) for s, p, e in zip(senders, parts, ends)]
        out += _to_words("single", *_added(w[n == 1], np.ones((n == 1).sum())), bucket, buckets)
        blocks = -(-n[heavy] // BLOCK)
        out += _to_words("heavy", *_added(w[heavy], blocks), bucket, buckets)
        tables = once + np.bincount(row[heavy], weights=blocks, minlength=len(us)).astype(np.int64)
        out += _hot(us, n_u[n > 0][at], tables, bucket, tokens, buckets)
        return _table(out)

    return run


class Seating:
    """Tables of many dishes, each with `n` customers; tables of a dish are numbered below n, empty numbers lie on a stack."""

    def __init__(self, n: np.ndarray, tables: np.ndarray | None = None, sizes: np.ndarray | None = None):
        """`tables` of each dish with their `sizes`, dish by dish; one table a dish where these are not given."""
        if tables is None:
            tables, sizes = np.ones(len(n), np.int64), n
        self.order = np.argsort(-n, kind="stable")  # most customers first
        self.n = n[self.order]
        self.at = np.cumsum(self.n) - self.n
        self.tables = tables[self.order].copy()
        start = np.cumsum(tables) - tables
        k = _counted(self.tables)
        dish = np.repeat(np.arange(len(n)), self.tables)
        size = sizes[start[self.order][dish] + k]
        self.size = np.zeros(self.n.sum(), np.int32)
        self.size[self.at[dish] + k] = size
        self.seat = np.repeat(k, size).astype(np.int32)
        # The stack's lowest n - tables places hold the numbers without guests.
        self.free = (np.repeat(self.n, self.n) - 1 - _counted(self.n)).astype(np.int32)

    def sweep(self, rng: np.random.Generator, new: np.ndarray, discount: float) -> None:
        """Every customer gets up and sits down again; `new` is the weight of a new table for each dish."""
        new = new[self.order]
        active = np.searchsorted(-self.n, -np.arange(1, self.n[0] + 1 if len(self.n) else 1), side="right")
        for j, many in enumerate(active.tolist()):
            at, n, tables, weight = self.at[:many], self.n[:many], self.tables, new[:many]
            k = self.seat[at + j]
            place = at + k
            size = self.size[place] - 1
            self.size[place] = size
            gone = np.flatnonzero(size == 0)
            tables[gone] -= 1
            self.free[at[gone] + n[gone] - tables[gone] - 1] = k[gone]
            others, left = n - 1, None  # None: all
            while left is None or len(left):
                # A point on the weight of a new table and one for each other customer; at a customer it stays with what the
                # discount leaves of a seat at that table, else it is drawn anew.
                point = rng.random(len(at)) * (weight + others) - weight
                fresh = point < 0
                beside = np.maximum(point, 0).astype(np.int64)
                beside += beside >= j
                k = self.seat[at + np.where(fresh, 0, np.minimum(beside, others))]
                size = self.size[at + k]
                sits = ~fresh & (rng.random(len(at), np.float32) * size < size - discount)
                for who, is_new in ((np.flatnonzero(sits), False), (np.flatnonzero(fresh), True)):
                    dish, a = who if left is None else left[who], at[who]
                    if is_new:
                        table = self.free[a + n[who] - tables[dish] - 1]
                        tables[dish] += 1
                        self.size[a + table] = 1
                    else:
                        table = k[who]
                        self.size[a + table] += 1
                    self.seat[a + j] = table
                rest = np.flatnonzero(~fresh & ~sits)
                left = rest if left is None else left[rest]
                at, n, others, weight = at[rest], n[rest], others[rest], weight[rest]

    def told(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of tables of each dish and their sizes, in the order of the dishes given."""
        sizes, start = self.size[self.size > 0], np.cumsum(self.tables) - self.tables
        tables = self.counts()
        return tables, sizes[np.repeat(start[self._back()], tables) + _counted(tables)]

    def counts(self) -> np.ndarray:
        return self.tables[self._back()]

    def _back(self) -> np.ndarray:
        back = np.empty(len(self.order), np.int64)
        back[self.order] = np.arange(len(self.order))
        return back


def _counted(n: np.ndarray) -> np.ndarray:
    """0 .. n[k] - 1 for each k."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _blocks(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dishes with at most BLOCK customers, and whose they are."""
    parts = -(-n // BLOCK)
    whose = np.repeat(np.arange(len(n)), parts)
    return np.minimum(BLOCK, n[whose] - BLOCK * _counted(parts)), whose


def _root(level: dict, round_: int, buckets: int):
    """The common restaurant's customers of a bucket's words seated anew; customers and tables told to who has asked."""

    def run(rows: pa.Table) -> pa.Table:
        got, bucket = _received(rows), rows.column("key")[0].as_py()
        lists = {(kind, s): _unpack(got[kind][s]) for kind in ("single", "heavy") for s in sorted(got[kind])}
        words, n = _added(np.concatenate([np.cumsum(w) for w, _ in lists.values()]), np.concatenate([k for _, k in lists.values()]))
        dishes, whose = _blocks(n)
        seating = Seating(dishes)
        seating.sweep(np.random.default_rng([_SEED, 0, round_, bucket]), np.full(len(dishes), level["new"]), level["discount"])
        tables = np.bincount(whose, weights=seating.counts(), minlength=len(n)).astype(np.int64)
        out = [_message("state", bucket, bucket, _pack(np.diff(words, prepend=0), n, tables), a=n.sum(), b=tables.sum(), c=(n == 1).sum(), d=(n == 2).sum())]
        for (kind, s), (w, _) in lists.items():
            if kind == "heavy":
                at = np.searchsorted(words, np.cumsum(w))
                out.append(_message("reply", s, bucket, _pack(n[at], tables[at])))
        return _table(out)

    return run


def _expected(n: np.ndarray, tables: np.ndarray, level: dict) -> np.ndarray:
    """The common restaurant's probability of a word."""
    return (n - level["discount"] * tables + level["new"]) / (level["strength"] + level["customers"])


def _seat(model: dict, root: dict, hot: dict[int, int], tokens: int, round_: int, buckets: int, sample: bool):
    """A bucket's customers seated against the common restaurant. `hot`: tables of the contexts in several buckets."""

    def run(rows: pa.Table) -> pa.Table:
        got, bucket = _received(rows), rows.column("key")[0].as_py()
        us, n_u, once, more, w, n = _unpack(got["model"][bucket])
        us = np.cumsum(us)
        row = np.repeat(np.arange(len(us)), more)
        words, word = np.unique(w, return_inverse=True)
        expected = np.zeros(len(words))
        for b, own in by_bucket(words % buckets, buckets):
            expected[own] = _expected(*_unpack(got["reply"][b]), root)
        dishes, whose = _blocks(n)
        seating = Seating(dishes, *(_unpack(got["seats"][bucket]) if "seats" in got else ()))
        rng = np.random.default_rng([_SEED, 1, round_, bucket])
        in_pairs = lambda: np.bincount(whose, weights=seating.counts(), minlength=len(n)).astype(np.int64)
        own_tables = lambda pairs: once + np.bincount(row, weights=pairs, minlength=len(us)).astype(np.int64)
        pairs = in_pairs()
        begun = own_tables(pairs)
        elsewhere = np.array([hot.get(u, mine) for u, mine in zip(us.tolist(), begun.tolist())], np.int64) - begun
        for _ in range(SWEEPS):
            new = (model["strength"] + model["discount"] * (elsewhere + own_tables(pairs)))[row] * expected[word]
            seating.sweep(rng, new[whose], model["discount"])
            pairs = in_pairs()
        ends = own_tables(pairs)
        out = [_message("seats", bucket, bucket, _pack(*seating.told())), *_to_words("heavy", *_added(w, pairs), bucket, buckets)]
        out += _hot(us, n_u, ends, bucket, tokens, buckets)
        if sample:
            out += [_message("tables", bucket, bucket, _pack(pairs)), *_to_words("context", us, ends, bucket, buckets)]
        return _table(out)

    return run


def _word_replies(buckets: int):
    """For the words of each chunk: training tokens, and of each sample customers and tables in the common restaurant and tables in
    the word's own."""

    def run(rows: pa.Table) -> pa.Table:
        got, bucket = _received(rows), rows.column("key")[0].as_py()
        lists = {chunk: _unpack(blob) for chunk, blob in got["ids"].items()}
        size, found = 1 + max((k.max() for k, _ in lists.values()), default=-1), []
        for s in range(SAMPLES):
            n, tables, own = (np.zeros(size, np.int64) for _ in range(3))
            for blob in got[f"state{s}"].values():
                w, n_w, t_w = _unpack(blob)
                k = np.cumsum(w) // buckets
                n[k], tables[k] = n_w, t_w
            for blob in got[f"context{s}"].values():
                u, t_u = _unpack(blob)
                np.add.at(own, np.cumsum(u) // buckets, t_u)
            found += [n, tables, own]
        return _table([_message("words", chunk, bucket, _pack(k, *(x[k] for x in found), n)) for chunk, (k, n) in lists.items()])

    return run


def _pair_replies(rows: pa.Table) -> pa.Table:
    """For the pairs of each chunk their tokens and the tables of all samples."""
    got, bucket = _received(rows), rows.column("key")[0].as_py()
    n = _unpack(got["model"][bucket])[5]
    tables = sum(_unpack(got[f"tables{s}"][bucket])[0] for s in range(SAMPLES))
    n, tables = np.concatenate([[0, 1], n]), np.concatenate([[0, SAMPLES], tables])
    return _table([_message("pairs", chunk, bucket, _pack(n[code], tables[code])) for chunk, blob in got["codes"].items() for code in _unpack(blob)])


def _scores(schema: pa.Schema, tokens: int, types: int, model: dict, roots: list[dict], buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        got = _received(rows)
        chunk = _Chunk(got, got["words"], buckets)
        count = chunk.told[-1]
        n, tables = np.zeros(len(chunk.u), np.int64), np.zeros(len(chunk.u), np.int64)
        for b, places, _, _ in _ordered_pairs(chunk, tokens, buckets):
            n[places], tables[places] = _unpack(got["pairs"][b])
        shared = np.zeros(len(chunk.u))
        for s, root in enumerate(roots):
            customers, own, context = chunk.told[3 * s + 1 : 3 * s + 4]
            back = (model["strength"] + model["discount"] * context) / (model["strength"] + count)
            shared += back[chunk.u] * _expected(customers, own, root)[chunk.w] / len(roots)
        log = np.log10((n - model["discount"] * tables / SAMPLES) / (model["strength"] + count[chunk.u]) + shared)[chunk.place]
        base = np.log10((count + 0.5) / (tokens + 0.5 * (types + 1)))[chunk.used]
        first = np.cumsum(chunk.n) - chunk.n
        sums = lambda x: np.add.reduceat(x, first)
        found = pa.ipc.open_stream(chunk.rows).read_all().drop_columns(["_train"])
        for name, values in (("n_tokens", chunk.n), ("n_known", sums((count[chunk.used] > 0).astype(np.int64))), ("train_tokens", np.full(len(chunk.n), tokens)), ("base_score", sums(base)), ("score", sums(log))):
            found = found.append_column(name, pa.array(values))
        return found.select(schema.names).cast(schema)

    return run


def _by(rows: DataFrame, n: int):
    return rows.repartition(n, "key").groupBy("key")


def _discount(once: int | None, twice: int | None) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def score(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: list[str] = ("doc_id",), buckets: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A struct `row` of the `keep` columns, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Documents whose CRC-32 of the id leaves 1 when divided by 5 are held out, all others are learnt. Tokens are the words between ASCII
    white space, A-Z in lower case, and one end. base_score is the log10 probability by counts of single words, each a
    half more than found; score that of the model."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if buckets is None:
        size = docs.select(F.sum(F.octet_length(packed(docs, [text])[text]))).first()[0] or 0
        buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    held = held_out(packed(docs, [doc])[doc])
    source = docs.select(packed(docs, list(keep)).alias("row"), held.alias("held_out"), (~held).alias("_train"), packed(docs, [text])[text].alias("_text"))
    chunks = saved(source.mapInArrow(_chunks(buckets, chunk_bytes), _ROWS))
    numbered = saved(_by(chunks.where("kind = 'words'"), parts).applyInArrow(_numbered, _ROWS))
    size = numbered.where("kind = 'size'").agg(F.sum("a").alias("tokens"), F.sum("b").alias("types")).first()
    tokens, types = size.tokens or 0, size.types or 0
    bodies, ids = chunks.where("kind = 'docs'"), numbered.where("kind = 'ids'")
    pairs = _by(bodies.unionByName(ids), parts).applyInArrow(_pairs(tokens, buckets), _ROWS)
    merged = saved(_by(pairs, parts).applyInArrow(_merged(tokens, buckets), _ROWS))
    model_rows, single = merged.where("kind = 'model'"), merged.where("kind = 'single'")
    found = model_rows.agg(F.sum("a").alias("once"), F.sum("b").alias("twice")).first()
    model = {"strength": STRENGTH, "discount": _discount(found.once, found.twice)}
    # Before its first seating the common restaurant has a table for each word.
    level = {"strength": STRENGTH, "discount": model["discount"], "new": (STRENGTH + model["discount"] * types) / (types + 1)}
    state, samples = merged, []
    for round_ in range(ROUNDS + 1):
        root_rows = saved(_by(single.unionByName(state.where("kind = 'heavy'")), parts).applyInArrow(_root(level, round_, buckets), _ROWS))
        sums = root_rows.where("kind = 'state'").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "abcd")).first()
        seen = level["discount"]
        root = {"strength": STRENGTH, "discount": seen, "customers": sums.a, "new": (STRENGTH + seen * sums.b) / (types + 1)}
        level = {**root, "discount": _discount(sums.c, sums.d), "new": (STRENGTH + _discount(sums.c, sums.d) * sums.b) / (types + 1)}
        if round_ > ROUNDS - SAMPLES:
            samples.append((state, root_rows, root))
        if round_ < ROUNDS:
            # Fewer contexts than there are buckets have more than a bucket's share of the tokens.
            hot = {r.key: r.tables for r in state.where("kind = 'hot'").groupBy("key").agg(F.sum("a").alias("tables")).collect()}
            inputs = model_rows.unionByName(root_rows.where("kind = 'reply'"))
            inputs = inputs.unionByName(state.where("kind = 'seats'")) if round_ else inputs
            seats = _seat(model, root, hot, tokens, round_, buckets, round_ >= ROUNDS - SAMPLES)
            state = saved(_by(inputs, parts).applyInArrow(seats, _ROWS))
    words = ids.withColumns({"key": F.col("sender"), "sender": F.col("key")})
    coded = model_rows.unionByName(merged.where("kind = 'codes'"))
    for s, (state, root_rows, _) in enumerate(samples):
        of = lambda rows, kind: rows.where(F.col("kind") == kind).withColumn("kind", F.lit(f"{kind}{s}"))  # noqa: B023, E731
        words = words.unionByName(of(root_rows, "state")).unionByName(of(state, "context"))
        coded = coded.unionByName(of(state, "tables"))
    replies = _by(words, parts).applyInArrow(_word_replies(buckets), _ROWS).unionByName(_by(coded, parts).applyInArrow(_pair_replies, _ROWS))
    out = T.StructType([source.schema["row"], source.schema["held_out"]])
    for name, kind in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())):
        out = out.add(name, kind)
    scores = _scores(to_arrow_schema(out), tokens, types, model, [root for _, _, root in samples], buckets)
    return _by(bodies.unionByName(replies), parts).applyInArrow(scores, out)
