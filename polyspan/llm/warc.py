"""A deterministic, sharded WARC writer and its reader.

Records are range-sorted by id into shards of some `SHARD_BYTES`, whose bounds follow from the ids alone. A task writes its shards as files of
gzip members, one a record, and starts the next file when the compressed size passes a limit. A file is written under
a temporary name of its own and renamed when it is whole; it counts once the manifest, which is written last, lists
it. The same rows give the same files, however often a task is tried.

Of records with equal payloads the one with the smallest id is the response, the others revisit it; payloads under
`MIN_REVISIT` bytes are all responses. The digests are grouped by themselves, so payloads are shuffled once, by range.

A null payload counts as empty. Rows that repeat the smallest id of their payload are all responses; rows without an
id are revisits of a row with one, and responses if there is none. Rows are kept one to one; columns other than the three
named are left aside, whatever they are called. The reader opens the files in its tasks, as streams.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, q, table

MIN_REVISIT = 100
ROLL_BYTES = 8_000_000
SHARD_BYTES = 32_000_000  # of payload
_FAN = 256
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = b"\r\n"


def _urn(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC record: an HTTP response, or a revisit with the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _urn(page_id, digest), "WARC-Date": date,
        "WARC-Target-URI": _line(url or "about:blank"), "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
    }
    if page_id is not None:
        head["X-Page-Id"] = _line(page_id)
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(refers_to, digest), "X-Refers-To-Page-Id": _line(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + _EOL + block + _EOL + _EOL


class _Files:
    """Rolling files of one shard."""

    def __init__(self, folder: str, roll_bytes: int):
        self.fs, self.at = fs.FileSystem.from_uri(folder)
        self.roll, self.shard, self.seq, self.out, self.done = roll_bytes, None, 0, None, []

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.seq = shard, 0
        if self.out is None:
            self.name, self.size, self.n, self.digest = f"shard-{self.shard:06d}-{self.seq:05d}.warc.gz", 0, 0, hashlib.sha256()
            self.temp = f"{self.at}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temp, compression=None)
        member = gzip.compress(data, 5, mtime=0)
        self.out.write(member)
        self.digest.update(member)
        self.size, self.n = self.size + len(member), self.n + 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.at}/{self.name}")
            self.done.append((self.name, self.shard, self.seq, self.n, self.size, self.digest.hexdigest()))
            self.out, self.seq = None, self.seq + 1


_MANIFEST = "file string, shard int, seq int, n_records long, n_bytes long, sha256 string"


def _writer(folder: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, current, firsts = _Files(folder, roll_bytes), None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["id"] != current:
                    current, firsts = row["id"], {}
                if row["mark"]:
                    firsts[row["digest"]] = row["first"]
                else:
                    files.add(row["shard"], record(row["id"], row["url"], row["payload"], row["digest"], firsts.get(row["digest"]), date))
        files.close()
        names = ("file", "shard", "seq", "n_records", "n_bytes", "sha256")
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in files.done], t) for i, t in enumerate(types)], names)

    return run


def _bounds(ids: DataFrame, n: int, shards: int) -> list:
    """Shard bounds from ids chosen by their hash: some 4 a shard and 10,000 at least, the same for the same ids."""
    every = max(1, n // max(10_000, 4 * shards))
    got = sorted(r[0] for r in ids.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(every)) == 0)).collect())
    return sorted({got[len(got) * k // shards] for k in range(1, shards)}) if got else []


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", shards: int | None = None, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write all rows as WARC files into `folder`, which executors share; returns the manifest, read from its table."""
    spark = pages.sparkSession
    body = F.coalesce(pages[q(payload)].cast("binary"), F.lit(b""))
    rows = pages.select(pages[q(page_id)].alias("id"), pages[q(url)].cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    told = table(rows.select("id", "digest", F.length("payload").alias("size")), "digests")
    total = told.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    shards = shards or max(1, -(-(total.size or 0) // SHARD_BYTES))
    small = told.where(F.col("size") >= MIN_REVISIT).select("id", "digest")
    firsts = table(small.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"), "firsts")
    marks = join_hot(small, firsts, ["digest"], "n", total.n).where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "digest", F.col("first").cast("string").alias("first")).distinct()
    both = rows.select("id", "url", "payload", "digest", F.lit(None).cast("string").alias("first"), F.lit(False).alias("mark")).unionByName(marks.select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first", F.lit(True).alias("mark")))
    bounds = _bounds(told.select("id"), total.n, shards)
    dealt = both.withColumn("shard", _shard_of("id", bounds)).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "id", F.desc("mark"), "digest", "url")
    target, at = fs.FileSystem.from_uri(folder)
    target.create_dir(f"{at}/_temporary", recursive=True)
    out = dealt.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", "first", "mark", "shard").mapInArrow(_writer(folder, roll_bytes, date), _MANIFEST)
    out.write.mode("overwrite").parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def _shard_of(column: str, bounds: list):
    """The number of bounds up to the id, found in two steps; ids that are null go to shard 0."""
    if not bounds:
        return F.lit(0)
    runs = [bounds[i : i + _FAN] for i in range(0, len(bounds), _FAN)]
    up_to = lambda held: F.size(F.filter(held, lambda b: b <= F.col(column)))
    top = up_to(F.array(*[F.lit(r[0]) for r in runs]))
    inner = F.element_at(F.array(*[F.array(*[F.lit(b) for b in r]) for r in runs]), F.greatest(top, F.lit(1)))
    return F.coalesce(F.when(top == 0, 0).otherwise((top - 1) * _FAN + up_to(inner)), F.lit(0))


def _records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=file))
    while line := stream.readline():
        if line == _EOL:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        for line in iter(stream.readline, _EOL):
            if not line:
                raise ValueError("the archive ends within a record's header")
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        yield head, block


_READ = "id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _reader(folder: str):
    names = ("id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")
    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with system.open_input_file(f"{at}/{name}") as file:
                    rows = _rows(file)
                    while part := list(itertools.islice(rows, 500)):
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(types)], names)

    return run


def _rows(file) -> Iterator[tuple]:
    for head, block in _records(file):
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit = head["warc-type"] == "revisit"
        stated = head["warc-payload-digest"].removeprefix("sha256:")
        if hashlib.sha256(block).hexdigest() != head["warc-block-digest"].removeprefix("sha256:"):
            raise ValueError(f"block digest of {head['warc-record-id']} is wrong")
        digest = stated if revisit else hashlib.sha256(payload).hexdigest()
        if digest != stated:
            raise ValueError(f"payload digest of {head['warc-record-id']} is wrong")
        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        yield head.get("x-page-id"), head["warc-target-uri"], head["warc-type"], head.get("x-refers-to-page-id"), digest, size, None if revisit else payload


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives that the manifest lists; digests are computed again and must agree."""
    manifest = spark.read.parquet(f"{folder}/_manifest").select("file")
    n = manifest.count()
    return manifest.repartition(max(1, n), "file").mapInArrow(_reader(folder), _READ) if n else spark.createDataFrame([], _READ)
