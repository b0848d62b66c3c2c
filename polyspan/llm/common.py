"""Helpers shared by the corpus operators.

Null handling everywhere in this subpackage: a null text counts as an empty text, so every input row
gives a result row. Rows are never merged by their id: repeated rows give repeated results.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of UTF-8 text with A-Z made a-z and all other ASCII but letters and digits made blank.
_ALNUM_LOWER = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def spaced(text: bytes) -> list[bytes]:
    """Words between ASCII white space: matches of [^\\x20\\x09-\\x0D]+."""
    return text.split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and anything beyond ASCII."""
    return text.translate(_ALNUM_LOWER).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or for a local session (tests) a temporary one where
    that is unset; a cluster has none to take."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        sc.setCheckpointDir(at)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


_paths: list[str] = []


def new_shared_path(spark: SparkSession, what: str) -> str:
    _paths.append(f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _paths[-1]


def made_since(n: int) -> list[str]:
    """The tables that operators of this process have written to the shared folder, without the first `n`."""
    return _paths[n:]


def clean_up(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables of the shared folder, all that operators of this process have written if none are named. Results that
    read them cannot be read after that: write them first."""
    jvm = spark.sparkContext._jvm
    for at in made_since(0) if paths is None else paths:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if at in _paths:
            _paths.remove(at)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts are long rows: fewer of them at once between Spark and Python, unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder. Not by a checkpoint: that keeps the plan's size estimate, which
    grows without end where a loop joins a result with itself, while a table has the size of its files."""
    return table(df, "saved")


def table(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage and gives every reader an exchange of its own."""
    path = new_shared_path(df.sparkSession, what)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def q(name: str) -> str:
    """A column name as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def fields(struct: str, names: list[str]) -> list:
    """The fields of a struct column as columns of their own names, whatever these are."""
    return [F.col(struct).getField(n).alias(n) for n in names]


def packed(docs: DataFrame, names: list[str] | None = None):
    """Columns of `docs` as one struct, out of the way of all other names."""
    return F.struct(*(docs[q(n)].alias(n) for n in (docs.columns if names is None else names)))


#: A key is hot if it holds more than this share of all rows, so that fewer than a thousand keys are.
HOT_SHARE = 1 / 1000
HOT_ROWS = 200


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """left join right, where `right` has one row a key and `weight` says how many rows of `left` hold the key. Keys with
    over HOT_SHARE of the `total` rows, fewer than 1 / HOT_SHARE by arithmetic, are broadcast, so their rows stay where
    they are; all others meet by shuffle, at most that share of the rows in one key. `left` and `right` are read
    twice: give tables or checkpoints. `weight` is left out of the result."""
    is_hot = F.col(weight) > max(HOT_ROWS, int(total * HOT_SHARE))
    hot = right.where(is_hot).drop(weight).withColumn("_hot", F.lit(True))
    cold = right.where(~is_hot).drop(weight)
    marked = left.join(F.broadcast(hot), on, "left")
    columns = [*left.columns, *(c for c in cold.columns if c not in on)]
    rest = marked.where("_hot is null").select(*left.columns).join(cold, on, how)
    return marked.where("_hot").select(*columns).unionByName(rest.select(*columns))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def squeeze(*parts: bytes, level: int = 3) -> bytes:
    """Pack byte strings into one compressed blob."""
    sizes = np.array([len(parts), *map(len, parts)], dtype="<u4").tobytes()
    return zstandard.ZstdCompressor(level=level).compress(sizes + b"".join(parts))


def unsqueeze(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)
    return [raw[a:b] for a, b in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


def planes(values) -> bytes:
    """Unsigned 32-bit integers by byte significance, which compresses small numbers well."""
    return np.ascontiguousarray(np.asarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


class Recent(dict):
    """Values of a function by argument; holds the last `size` to twice as many that were asked for."""

    def __init__(self, make, size: int = 200_000):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def wide(values) -> bytes:
    """Unsigned 64-bit integers by byte significance."""
    return np.ascontiguousarray(np.asarray(values, "<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unwide(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def by_bucket(own: np.ndarray, buckets: int):
    """(bucket, places of its numbers) for each bucket that `own` names; the same each time that it is asked."""
    order = np.argsort(own, kind="stable")
    ends = np.searchsorted(own[order], np.arange(buckets + 1)).tolist()
    for b in range(buckets):
        if ends[b] < ends[b + 1]:
            yield b, order[ends[b] : ends[b + 1]]


def stream(batches: list[pa.RecordBatch]) -> bytes:
    """Arrow batches as bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()
