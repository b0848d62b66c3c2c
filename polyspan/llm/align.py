"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

1. Every text is encoded by both tokenizers, and the byte offsets where tokens end are laid side by side. An interval of
   tokens is cut at a common end near its middle, which bisecting in the other list of ends confirms; both halves are
   cut in turn. Intervals without an inner common end are the groups. All intervals of a batch go down together, a
   level at a time.
2. Tokens whose byte ranges overlap are links. Each chunk of some 7 MB of text lists its distinct pairs of ids with the
   number of its documents that hold them.
3. The chunks' lists are shuffled by pair and added up over the corpus; the highest count of each A id is a table of at
   most the vocabulary's size. Counts return to their chunks, and each document adds up those of its links.

A pair crosses the network once for each chunk that holds it, however often it occurs, and pairs are dealt by their hash,
so a frequent pair or token is no hot key. Null and empty texts, and texts that the tokens' bytes do not give back, have
no tokens: zeros and no groups. Rows are kept one to one; repeated rows count as documents of their own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .bpe import _ODD
from .common import by_bucket, packed, planes, saved, squeeze, stream, texts, unplanes, unsqueeze, unwide, wide

CHUNK_CHARS = 7_000_000
_ROWS = "kind string, chunk long, bucket int, blob binary"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where it is printable, else the next
    free character from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Tokenizer A from the text of a byte-level BPE file (json). Merging by rank gives the same ids where each merge made
    the next id; texts with characters on whose class two libraries could differ take the file's own library."""

    def __init__(self, raw: str, pattern: str):
        self.raw, self.slow = raw, None
        model, byte = json.loads(raw)["model"], _byte_of()
        as_bytes = {token: bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode() for token in model["vocab"]}
        self.table = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in model["vocab"].items():
            self.table[i] = as_bytes[token]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        single = sorted(model["vocab"][c] for c in byte if c in model["vocab"])
        self.fast = None
        if single == list(range(256)) and all(model["vocab"][m] == 256 + k for k, m in enumerate(merged)):
            ranks = {self.table[k]: k for k in range(256 + len(merged))}
            self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not _ODD.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.raw)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """Tokenizer B from the bytes of a piece model."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(raw)
        ids = range(self.model.get_piece_size())
        self.table = [bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    def __call__(self, whole: list[str]) -> list[list[int]]:
        return self.model.encode(whole, num_threads=1)


def _ragged(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[k], first[k] + 1, ... (n[k] numbers) for each k, and k for each number."""
    who = np.repeat(np.arange(len(n)), n)
    return np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + first[who], who


def _near_middle(a_ends: np.ndarray, b_ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each interval of A tokens lo..hi - 1 the inner token nearest its middle whose end is an end of B; else -1."""
    mid, at = (lo + hi - 2) // 2, np.full(len(lo), -1)
    left, reach, step = np.arange(len(lo)), 0, 1
    while len(left):
        m = mid[left]
        first = [np.maximum(lo[left], m - reach - step + 1), m + max(reach, 1)]
        last = [m - reach, np.minimum(hi[left] - 2, m + reach + step - 1)]
        best = np.full(len(left), np.iinfo(np.int64).max)
        for f, e in zip(first, last):
            token, who = _ragged(f, np.maximum(e - f + 1, 0))
            ends = a_ends[token]
            hit = b_ends[np.searchsorted(b_ends, ends)] == ends
            np.minimum.at(best, who[hit], 2 * np.abs(token[hit] - m[who[hit]]) + (token[hit] > m[who[hit]]))
        found = best < np.iinfo(np.int64).max
        at[left[found]] = m[found] + np.where(best[found] % 2, 1, -1) * (best[found] // 2)
        reach += step
        left = left[~found & ((m - reach >= lo[left]) | (m + reach <= hi[left] - 2))]
        step *= 2
    return at


def cuts(a_ends: np.ndarray, b_ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which A tokens end a group: the last of each interval lo..hi - 1, and every inner one whose end is an end of B."""
    cut = np.zeros(len(a_ends), bool)
    cut[hi - 1] = True
    while len(lo):
        more = hi - lo > 1
        lo, hi = lo[more], hi[more]
        at = _near_middle(a_ends, b_ends, lo, hi)
        lo, hi, at = lo[at >= 0], hi[at >= 0], at[at >= 0]
        cut[at] = True
        lo, hi = np.concatenate([lo, at + 1]), np.concatenate([at + 1, hi])
    return cut


class _Table:
    """Tokens as bytes and as decimal numbers with the separator that follows them."""

    def __init__(self, raw: list[bytes]):
        self.raw, self.length = pa.array(raw, pa.large_binary()), np.array([len(x) for x in raw], np.int64)

    def joined(self, ids: np.ndarray) -> memoryview:
        """The tokens' bytes, one after the other."""
        got = self.raw.take(pa.array(ids))
        ends = np.frombuffer(got.buffers()[1], np.int64)
        return memoryview(got.buffers()[2] or b"").cast("B")[ends[got.offset] : ends[got.offset + len(got)]]


class Aligner:
    def __init__(self, a, b):
        self.a, self.b = a, b
        self.a_table, self.b_table = _Table(a.table), _Table(b.table)
        written = [b"%d%s" % (i, end) for table, ends in ((a.table, b",|"), (b.table, b",;")) for end in (ends[:1], ends[1:]) for i in range(len(table))]
        self.written = _Table(written)

    def __call__(self, whole: list[str], as_text: bool) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Of each text (n_a, n_b, n_groups, n_links), and its groups written out or their digest; and all links in order as
        A id times B's number of tokens plus B id."""
        sizes, written = np.zeros((len(whole), 4), np.int64), [""] * len(whole)
        some = [i for i, t in enumerate(whole) if t]
        a_ids = [self.a(" " + whole[i]) for i in some]
        b_ids = [np.array(x, np.uint32) for x in self.b([whole[i] for i in some])]
        wanted = [b" " + whole[i].encode() for i in some]
        a_all, b_all = (np.concatenate([*x, np.zeros(0, np.uint32)]).astype(np.int64) for x in (a_ids, b_ids))
        a_raw, b_raw = self.a_table.joined(a_all), self.b_table.joined(b_all)
        a_at = np.cumsum([0, *(self.a_table.length[x].sum() for x in a_ids)]).tolist()
        b_at = np.cumsum([0, *(self.b_table.length[x].sum() for x in b_ids)]).tolist()
        right = [k for k, w in enumerate(wanted) if a_raw[a_at[k] : a_at[k + 1]] == w and b_raw[b_at[k] : b_at[k + 1]] == w]
        if not right:
            return sizes, written, np.zeros(0, np.int64)
        if len(right) < len(some):
            a_ids, b_ids, some = [a_ids[k] for k in right], [b_ids[k] for k in right], [some[k] for k in right]
            a_all, b_all = (np.concatenate(x).astype(np.int64) for x in (a_ids, b_ids))
        n_a, n_b = (np.array([len(x) for x in ids]) for ids in (a_ids, b_ids))
        a_ends, b_ends = np.cumsum(self.a_table.length[a_all]), np.cumsum(self.b_table.length[b_all])
        last = np.cumsum(n_a)
        cut = cuts(a_ends, b_ends, last - n_a, last)
        n_groups = np.add.reduceat(cut, last - n_a)
        sizes[some] = np.stack([n_a, n_b, n_groups, n_a + n_b - n_groups], 1)
        # A link for each stretch between neighbouring ends of any token.
        ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        ends = ends[np.diff(ends, append=-1) != 0]
        links = a_all[np.searchsorted(a_ends, ends)] * len(self.b.table) + b_all[np.searchsorted(b_ends, ends)]
        # The groups in order, A's tokens before B's.
        a_group = np.cumsum(cut) - cut
        b_group = np.searchsorted(a_ends[cut], b_ends)
        closes = np.diff(b_group, append=-1) != 0
        code = np.concatenate([a_all + len(self.a.table) * cut, 2 * len(self.a.table) + b_all + len(self.b.table) * closes])
        code = code[np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")]
        text = self.written.joined(code)
        at = np.concatenate([[0], np.cumsum(self.written.length[code])])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        for k, i in enumerate(some):
            own = text[at[k] : at[k + 1] - 1]
            written[i] = bytes(own).decode() if as_text else hashlib.sha256(own).hexdigest()
        return sizes, written, links


def _bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return (((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _row(kind: str, chunk: int, bucket: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["kind", "chunk", "bucket", "blob"])


def _chunks(shared, buckets: int, chunk_chars: int, as_text: bool):
    """Rows (kind, chunk, bucket, blob): the documents of a chunk with their pairs, and its distinct pairs by bucket."""

    def emit(chunk: int, kept: list[pa.RecordBatch], links: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = np.array([len(x) for x in links])
        # Documents' distinct pairs: a document's number above a pair of ids, which takes fewer than 40 bits.
        held, times = np.unique((np.repeat(np.arange(len(n)), n) << 40) | np.concatenate(links), return_counts=True)
        pairs, place, n_docs = np.unique(held & ((1 << 40) - 1), return_inverse=True, return_counts=True)
        doc = held >> 40
        blob = squeeze(stream(kept), planes(np.bincount(doc, minlength=len(n))), planes(np.diff(place, prepend=0) & 0xFFFFFFFF), planes(times))
        yield _row("docs", chunk, -1, blob)
        for b, own in by_bucket(_bucket(pairs, buckets), buckets):
            yield _row("pairs", chunk, b, squeeze(wide(np.diff(pairs[own], prepend=0)), planes(n_docs[own]), level=9))
        yield _row("order", chunk, -1, squeeze(wide(np.diff(pairs, prepend=0)), level=9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_raw, pattern, b_raw = shared.value
        align, chunk = Aligner(ByteLevel(a_raw, pattern), Pieces(b_raw)), TaskContext.get().partitionId() << 32
        kept, links, size = [], [], 0
        for batch in batches:
            whole, start = texts(batch, "_text"), 0
            while start < len(whole):
                end = start
                while end < len(whole) and size < chunk_chars:
                    size += len(whole[end]) + 1
                    end += 1
                sizes, written, found = align(whole[start:end], as_text)
                links += np.split(found, np.cumsum(sizes[:-1, 3]))
                rows = batch.drop_columns(["_text"]).slice(start, end - start)
                for name, values in (*zip(("n_a", "n_b", "n_groups", "n_links"), sizes.T), ("groups", pa.array(written, pa.string()))):
                    rows = rows.append_column(name, pa.array(values))
                kept.append(rows)
                start = end
                if size >= chunk_chars:
                    yield from emit(chunk, kept, links)
                    chunk, kept, links, size = chunk + 1, [], [], 0
        if kept:
            yield from emit(chunk, kept, links)

    return run


def _added(lists: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct pairs of a bucket, their counts, and each list's places among them."""
    parts = [unsqueeze(blob) for blob in lists.column("blob").to_pylist()]
    own = [np.cumsum(unwide(p)) for p, _ in parts]
    pairs, place = np.unique(np.concatenate(own), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([unplanes(n) for _, n in parts])).astype(np.int64)
    return pairs, counts, np.split(place, np.cumsum([len(x) for x in own])[:-1])


def _highest(n_b: int):
    def run(lists: pa.Table) -> pa.Table:
        pairs, counts, _ = _added(lists)
        a = pairs // n_b
        first = np.flatnonzero(np.diff(a, prepend=-1))
        return pa.table({"a": pa.array(a[first], pa.int64()), "n": pa.array(np.maximum.reduceat(counts, first), pa.int64())})

    return run


def _answers(n_b: int, highest):
    """For each chunk of a bucket the counts of its pairs, doubled, plus one where the count is the A id's highest."""

    def run(lists: pa.Table) -> pa.Table:
        pairs, counts, places = _added(lists)
        told = 2 * counts + (counts == highest.value[pairs // n_b])
        return pa.table({"chunk": lists.column("chunk"), "bucket": lists.column("bucket"), "blob": pa.array([squeeze(wide(told[p]), level=9) for p in places], pa.binary())})

    return run


def _sums(schema: pa.Schema, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        blobs = dict(zip(docs.column("kind").to_pylist(), docs.column("blob").to_pylist()))
        if not blobs:
            return schema.empty_table()
        pairs = np.cumsum(unwide(unsqueeze(blobs["order"])[0]))
        told, blob_of = np.zeros(len(pairs), np.int64), dict(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()))
        for b, own in by_bucket(_bucket(pairs, buckets), buckets):
            told[own] = unwide(unsqueeze(blob_of[b])[0])
        kept, n, place, times = unsqueeze(blobs["docs"])
        n, place, times = unplanes(n).astype(np.int64), np.cumsum(unplanes(place).view(np.int32).astype(np.int64)), unplanes(times).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        rows = pa.ipc.open_stream(kept).read_all()
        for name, values in (("n_best", times * (told[place] & 1)), ("count_sum", times * (told[place] >> 1))):
            total = np.concatenate([[0], np.cumsum(values)])[ends]
            rows = rows.append_column(name, pa.array(np.diff(total), pa.int64()))
        return rows.select(schema.names).cast(schema)

    return run


def align(docs: DataFrame, a_file: str, b_file: str, pattern: str, text: str = "text", keep: list[str] = ("doc_id",), digest_only: bool = False, buckets: int | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """A struct `row` of the `keep` columns, and of each text n_a, n_b, n_groups, n_links, n_best, count_sum and `groups`.

    A encodes a space and the text with the byte-level BPE of `a_file`, whose words match `pattern`; B encodes the text
    with the piece model of `b_file`, which adds the space. `groups` is a1,a2|b1;a3|b2,b3 in decimal ids, with
    `digest_only` its SHA-256 in lowercase hex; without tokens it is empty. n_best are links whose pair is held by as many documents as any
    pair of its A id; count_sum adds up how many documents hold each link's pair.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(48, 2 * n)
    with open(a_file, encoding="utf-8") as a, open(b_file, "rb") as b:
        raw = a.read(), b.read()
    shared, n_a, n_b = spark.sparkContext.broadcast((raw[0], pattern, raw[1])), len(ByteLevel(raw[0], pattern).table), len(Pieces(raw[1]).table)
    source = docs.select(packed(docs, list(keep)).alias("row"), packed(docs, [text])[text].alias("_text"))
    chunks = saved(source.mapInArrow(_chunks(shared, buckets, chunk_chars, not digest_only), _ROWS))
    pairs = chunks.where("kind = 'pairs'").select("chunk", "bucket", "blob").repartition(n, "bucket").groupBy("bucket")
    # At most one row for each A id: the vocabulary's size, whatever the corpus.
    highest = np.zeros(n_a, np.int64)
    for a, most in pairs.applyInArrow(_highest(n_b), "a long, n long").groupBy("a").agg(F.max("n")).collect():
        highest[a] = most
    answers = pairs.applyInArrow(_answers(n_b, spark.sparkContext.broadcast(highest)), "chunk long, bucket int, blob binary")
    out = T.StructType([source.schema["row"]])
    for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"):
        out = out.add(name, T.LongType())
    out = out.add("groups", T.StringType())
    bodies = chunks.where("kind <> 'pairs'").select("kind", "chunk", "blob")
    return bodies.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_sums(to_arrow_schema(out), buckets), out)
