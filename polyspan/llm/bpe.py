"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Every task splits its documents into pre-tokens and numbers them in a dictionary of its own (a chunk: some
   7 MB of text). A document becomes the list of its pre-tokens' numbers, in order.
2. The chunks' dictionaries are shuffled by word. A word is encoded once, where all chunks that hold it meet.
3. The token ids go back to their chunks, and each document is put together by position.
4. Decoding joins the ids with the table of token bytes, whose size is the vocabulary's.

A word crosses the network once for each chunk that holds it, never once for each occurrence, so a very frequent
word is no hot key. Nulls and empty texts give no tokens. Rows are kept one to one.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import fields, packed, planes, q, squeeze, texts, unplanes, unsqueeze

CHUNK_CHARS = 7_000_000

# Characters on which the standard library's classes below agree with \p{L}, \p{N} and \s; other texts take `regex`.
_LETTER = r"A-Za-zÀ-ÖØ-öø-ſ"
_ODD = re.compile(rf"[^\x00-\x1b\x20-\x7f{_LETTER}]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Splitter:
    """Pre-tokens of a text by a tokenizer's pattern."""

    def __init__(self, pattern: str):
        self.whole = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\t-\r {_LETTER}0-9]").replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", "[0-9]")
        plain = plain.replace(r"\S", r"[^\t-\r ]").replace(r"\s", r"[\t-\r ]")
        self.plain = None if r"\p" in plain else re.compile(plain)

    def __call__(self, text: str) -> list[str]:
        return (self.whole if self.plain is None or _ODD.search(text) else self.plain).findall(text)


def _row(kind: str, chunk: int, bucket: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["kind", "chunk", "bucket", "blob"])


def _chunks(split: Splitter, buckets: int, chunk_chars: int):
    """Rows (kind, chunk, bucket, blob): the documents of a chunk, and its dictionary by bucket of words."""

    def emit(chunk: int, kept: list[pa.RecordBatch], docs: list[np.ndarray], words: dict[str, int]) -> Iterator[pa.RecordBatch]:
        used = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(used, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        named = list(words)
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in named), np.int32, len(named))[order]
        by_bucket = np.argsort(bucket, kind="stable")  # of words in the order of their rank
        ends = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept[0].schema) as out:
            for b in kept:
                out.write_batch(b)
        yield _row("docs", chunk, -1, squeeze(sink.getvalue().to_pybytes(), planes([len(d) for d in docs]), planes(rank[used])))
        for b in range(buckets):
            own = by_bucket[ends[b] : ends[b + 1]]
            if len(own):
                raw = [named[i].encode() for i in order[own].tolist()]
                yield _row("words", chunk, b, squeeze(planes(np.diff(own, prepend=0)), planes([len(w) for w in raw]), b"".join(raw), level=9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        kept, docs, words, size = [], [], defaultdict(), 0
        words.default_factory = words.__len__
        for batch in batches:
            whole = texts(batch, "_text")
            rest = batch.drop_columns(["_text"])
            start = 0
            for i, text in enumerate(whole):
                docs.append(np.fromiter((words[w] for w in split(text)), np.uint32))
                size += len(text)
                if size >= chunk_chars:
                    kept.append(rest.slice(start, i + 1 - start))
                    yield from emit(chunk, kept, docs, words)
                    chunk, kept, docs, words, size, start = chunk + 1, [], [], defaultdict(), 0, i + 1
                    words.default_factory = words.__len__
            if start < len(whole):
                kept.append(rest.slice(start))
        if docs:
            yield from emit(chunk, kept, docs, words)

    return run


def _dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.filter(pc.equal(batch.column("kind"), "words"))
        if words.num_rows:
            yield words.select(["bucket", "chunk", "blob"])


def _encode_words(ranks):
    """Dictionaries sorted by bucket in, token ids of the same words out; each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks.value, special_tokens={})
        bucket, known = None, {}
        for batch in batches:
            blobs = []
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if b != bucket:
                    bucket, known = b, {}
                rank, length, raw = unsqueeze(blob)
                ends = np.cumsum(unplanes(length), dtype=np.int64).tolist()
                words = [raw[a:z] for a, z in zip([0, *ends[:-1]], ends)]
                for w in words:
                    if w not in known:
                        known[w] = whole.encode_ordinary(w.decode())
                ids = [known[w] for w in words]
                blobs.append(squeeze(rank, planes([len(x) for x in ids]), planes([y for x in ids for y in x]), level=9))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(blobs, pa.binary())], ["chunk", "blob"])

    return run


def _reassemble(schema: pa.Schema, table=None):
    """One chunk's documents and its words' ids, to a row for each document."""

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for blob in right.column("blob").to_pylist():
            rank, length, ids = map(unplanes, unsqueeze(blob))
            parts.append((np.cumsum(rank, dtype=np.int64), length, ids))
        n = 1 + max((int(p[0][-1]) for p in parts if len(p[0])), default=-1)
        lengths, starts, at = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        for rank, length, ids in parts:
            lengths[rank] = length
            starts[rank] = at + np.cumsum(length, dtype=np.int64) - length
            at += len(ids)
        flat = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, "<u4")
        tables = []
        for kind, blob in zip(left.column("kind").to_pylist(), left.column("blob").to_pylist(), strict=True):
            if kind != "docs":
                continue
            kept, sizes, used = unsqueeze(blob)
            used, out, a = unplanes(used), [], 0
            if len(used) and int(used.max()) >= n:
                raise RuntimeError("a chunk's words changed between two reads of the input; write the input to a table first")
            for size in unplanes(sizes).tolist():
                own = used[a : a + size]
                a += size
                n_ids = lengths[own]
                total = int(n_ids.sum())
                first = np.cumsum(n_ids) - n_ids
                out.append(flat[np.repeat(starts[own] - first, n_ids) + np.arange(total)].astype("<u4").tobytes())
            rows = pa.ipc.open_stream(kept).read_all().append_column("ids", pa.array(out, pa.binary()))
            tables.append(rows if table is None else rows.append_column("decoded", pa.array(_bytes_of(out, table.value), pa.binary())))
        return pa.concat_tables(tables).cast(schema) if tables else schema.empty_table()

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: list[str] = ("doc_id",), buckets: int | None = None, chunk_chars: int = CHUNK_CHARS, decoded: bool = False) -> DataFrame:
    """The `keep` columns, whatever their names, and `ids`, the token ids as little-endian unsigned 32-bit integers.

    Each match of `pattern` is encoded by itself, without special tokens. Null and empty texts have no ids. With
    `decoded`, a column of that name has what `decode` gives for the ids, in the same pass.
    """
    spark = docs.sparkSession
    buckets = buckets or max(48, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = docs.select(packed(docs, list(keep)).alias("row"), docs[q(text)].alias("_text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One exchange of the compact chunks, read twice: for their dictionaries, and to put the documents together.
    chunks = source.mapInArrow(_chunks(Splitter(pattern), buckets, chunk_chars), "kind string, chunk long, bucket int, blob binary").repartition(n, "chunk")
    words = chunks.mapInArrow(_dictionaries, "bucket int, chunk long, blob binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    ids = words.mapInArrow(_encode_words(spark.sparkContext.broadcast(ranks)), "chunk long, blob binary")
    out = T.StructType([source.schema["row"]]).add("ids", T.BinaryType())
    table = spark.sparkContext.broadcast(token_bytes(ranks)) if decoded else None
    if decoded:
        out = out.add("decoded", T.BinaryType())
    return chunks.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(_reassemble(to_arrow_schema(out), table), out).select(*fields("row", list(keep)), "ids", *(["decoded"] if decoded else []))


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The table of token bytes by id; its size is the vocabulary's and does not grow with the data."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for raw, rank in ranks.items():
        table[rank] = raw
    return table


def _bytes_of(ids: list[bytes | None], table: list[bytes]) -> list[bytes | None]:
    return [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes of `ids`, joined with the table of token bytes, which each executor holds. Null ids give null."""
    shared = tokens.sparkSession.sparkContext.broadcast(token_bytes(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(out, pa.array(_bytes_of(batch.column(ids).to_pylist(), shared.value), pa.binary()))

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(out, T.BinaryType())]))


def token_lists(tokens: DataFrame, ids: str = "ids", out: str = "tokens") -> DataFrame:
    """The packed ids as an array<long> column."""
    n = F.length(ids) / 4
    byte = lambda i, k: F.conv(F.hex(F.substring(F.col(ids), i * 4 + k + 1, 1)), 16, 10).cast("long") * (1 << (8 * k))
    whole = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: byte(i, 0) + byte(i, 1) + byte(i, 2) + byte(i, 3))
    return tokens.withColumn(out, F.when(n > 0, whole).otherwise(F.array().cast("array<long>")))
