"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints that differ in at most three of 64 bits agree on at least one of four blocks of 16 bits. A node of the
index is such a shared masked bit pattern (mask, bits); a node with too many fingerprints splits into four children
that share more bits, chosen by the same argument, so no link is lost and no node exceeds what one task can hold.
Within a node, fingerprints lie in the order of their rank in the Gray sequence, in which neighbours differ in few
bits. Upper nodes over runs of them keep the bits that the whole run shares; two runs whose shared bits differ in more
than three places are dropped together.

Equal fingerprints are one entry. A task returns a spanning forest of the links it finds, not all pairs, and the
forests are joined to components by alternating stars.

For near-duplicates by similarity (`similar`: five words, 0.8) a radius that misses none would be far too wide for masked
patterns alone. There a node is a shared anchor, the Gray order and its upper nodes prune within it, and every
candidate is checked by its shingles in the task that holds the node, which gives back a spanning forest.

A text without words has fingerprint zero. Nulls count as empty. Rows are kept one to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import fields, join_hot, packed, q, raw_texts, saved, spaced, table

BITS = 3
NODE_SIZE = 4096
SHINGLE = 3
_FAN = 8
_SALTS = 16
_FEW = 2000  # so few edges have no hot key worth a plan of its own


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of the lower-cased (A-Z) text: a bit is 1 if it is set in over half the hashes of all word shingles."""
    words = spaced(text.lower())
    if not words:
        return 0
    line = b" ".join(words)
    start = [0, *accumulate(len(w) + 1 for w in words)]
    ends = start[min(shingle, len(words)) :]
    hashes = np.array([xxh64_intdigest(line[a : z - 1], 42) for a, z in zip(start, ends)], dtype=np.uint64)
    return _majority(hashes)


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """The `keep` columns and fp, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, shingle) for t in raw_texts(batch, "_text")], np.uint64).view(np.int64)
            yield batch.drop_columns(["_text"]).append_column("fp", pa.array(got))

    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fp", T.LongType())])
    return docs.select(*(docs[c] for c in keep), docs[text].cast("binary").alias("_text")).mapInArrow(run, out)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _split(bits: list[int], parts: int) -> list[int]:
    """Masks of so many blocks of about equal size."""
    return [sum(1 << b for b in block) for block in np.array_split(np.array(bits, object), parts)]


def gray_rank(fp):
    """The place of a 64-bit pattern in the reflected Gray sequence, as a signed number of the same order."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class _Forest:
    """Union-find over array positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while ((y := self.up[x]) != x).any():
            self.up[x] = self.up[y]
            x = y
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.up, b, a)


def near_pairs(fps: np.ndarray, firsts: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within `bits` of each other, for fingerprints in groups (firsts: where each group starts), each
    in Gray order."""
    n = len(fps)
    group = np.zeros(n, np.int64)
    group[firsts] = 1
    group = np.cumsum(group) - 1
    within = np.arange(n) - firsts[group]
    levels = [(fps, ~fps, np.arange(n + 1))]  # of each run: bits that are 1 in all below, 0 in all below, where the children start
    step = 1
    while len(levels[-1][0]) > len(firsts):
        step *= _FAN
        start = np.flatnonzero(within % step == 0)
        below = np.flatnonzero(within % (step // _FAN) == 0)
        child = np.searchsorted(below, start)
        ones, zeros, _ = levels[-1]
        levels.append((np.bitwise_and.reduceat(ones, child), np.bitwise_and.reduceat(zeros, child), np.append(child, len(below))))
    todo = [(len(levels) - 1, np.arange(len(firsts)), np.arange(len(firsts)))] if n else []
    while todo:
        level, a, b = todo.pop()
        if level == 0:
            yield a, b
            continue
        if len(a) > 16_384:
            todo += [(level, a[i : i + 16_384], b[i : i + 16_384]) for i in range(0, len(a), 16_384)]
            continue
        child, (ones, zeros, _) = levels[level][-1], levels[level - 1]
        na, nb = child[a + 1] - child[a], child[b + 1] - child[b]
        size = na * nb
        pair = np.repeat(np.arange(len(a)), size)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        x, y = child[a][pair] + k // nb[pair], child[b][pair] + k % nb[pair]
        near = (x < y) | (x == y) & (level > 1)
        x, y = x[near], y[near]
        near = np.bitwise_count((ones[x] & zeros[y]) | (zeros[x] & ones[y])) <= bits
        if near.any():
            todo.append((level - 1, x[near], y[near]))


def link_forest(fps: np.ndarray, firsts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A member of the same component for each position, by links within groups."""
    forest = _Forest(len(fps))
    for a, b in near_pairs(fps, firsts, bits):
        forest.join(a, b)
    return forest.find(np.arange(len(fps)))


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str], batch_rows: int = 131_072) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups of equal `columns`, with the places where the groups start."""

    def turns(rows: pa.Table) -> np.ndarray:
        values = [rows.column(c).to_numpy() for c in columns]
        return np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1

    held, size = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= batch_rows:
            rows = pa.concat_tables(held)
            at = turns(rows)
            end = int(at[-1]) if len(at) else 0  # the last group may go on in the next batch
            if end:
                yield rows.slice(0, end), np.concatenate([[0], at[:-1]])
            held, size = [rows.slice(end)], len(rows) - end
            batch_rows = max(batch_rows, 2 * size)
    if size:
        rows = pa.concat_tables(held)
        yield rows, np.concatenate([[0], turns(rows)]).astype(np.int64)


def _search(bits: int):
    """Rows sorted by node and Gray rank in; links between fingerprints out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, firsts in whole_groups(batches, ["mask", "bits"]):
            fp = rows.column("fp").to_numpy()
            root = link_forest(np.ascontiguousarray(fp).view(np.uint64), firsts, bits)
            linked = np.flatnonzero(root != np.arange(len(root)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], ["u", "v"])

    return run


def links(fps: DataFrame, bits: int = BITS, node_size: int = NODE_SIZE) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that connect all within `bits` of each other: enough of
    them for the components, not all pairs."""
    spark = fps.sparkSession
    parts = bits + 1
    nodes = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in _split(list(range(64)), parts)])).alias("mask"))
    masks = _split(list(range(64)), parts)
    found = None
    while True:
        nodes = nodes.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        deeper = {m: _split(free, parts) for m in masks if len(free := [b for b in range(64) if not m >> b & 1]) > bits + 8}
        hot = saved(nodes.groupBy("mask", "bits").count().where(F.col("count") > node_size).select("mask", "bits")) if deeper else None
        some = hot is not None and not hot.isEmpty()
        if some:  # a hot node's rows are dealt to `_SALTS` tasks, each with a copy of the short list of hot nodes
            copies = hot.select("mask", "bits", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"), F.lit(True).alias("hot"))
            nodes = nodes.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(_SALTS)).cast("int")).join(copies, ["mask", "bits", "salt"], "left").select("fp", "mask", "bits", "hot")
        cold = nodes.where("hot is null") if some else nodes
        cold = cold.select("mask", "bits", "fp", gray_rank(F.col("fp")).alias("rank"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sought = cold.repartition(n, "mask", "bits").sortWithinPartitions("mask", "bits", "rank").select("fp", "mask", "bits").mapInArrow(_search(bits), "u long, v long")
        found = sought if found is None else found.union(sought)
        if not some:
            return found
        children = spark.createDataFrame([(_signed(m), [_signed(m | x) for x in more]) for m, more in deeper.items()], "mask long, more array<long>")
        nodes = saved(nodes.where("hot").join(F.broadcast(children), "mask").select("fp", F.explode("more").alias("mask")))  # children: at most 1024 rows, of the masks alone
        masks = [m | x for m, more in deeper.items() for x in more]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of the edges (u, v): the smallest node reachable. Alternating large and small
    stars; every round is a few joins and aggregates, and the number of rounds grows with the logarithm of the size. The
    centre of a large star is a hot key of a known size."""
    edges = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        n = edges.count()
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        held = saved if n > _FEW else lambda df: df
        joined = join_hot if n > _FEW else lambda left, right, on, weight, _: left.join(right.drop(weight), on)
        least = held(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = held(joined(both.where("v > u"), least, ["u"], "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = held(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = joined(large, least, ["u"], "n", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = saved(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
        state = now


def _named(found: DataFrame, members: DataFrame, distinct: DataFrame, key: str) -> DataFrame:
    """doc_id, key and component_id of all `members` (doc_id, key), given the components `found` of the keys and the
    smallest id and number of members of each (`distinct`: key, first_id, n)."""
    linked = saved(found.withColumnRenamed("node", key).join(distinct, key))
    smallest = saved(linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_keys")))
    named = join_hot(linked.select("component", key), smallest, ["component"], "n_keys", linked.count()).select(key, F.col("component_id").alias("linked_id"))
    by_key = distinct.join(named, key, "left").select(key, F.when(F.col("linked_id").isNull(), F.col("first_id")).otherwise(F.col("linked_id")).alias("component_id"), "n")
    return join_hot(members, saved(by_key), [key], "n", members.count())


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = BITS, node_size: int = NODE_SIZE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that links of at most `bits` differing bits reach. One row for
    each document, in no order. A component whose ids are all null has a null id."""
    prints = saved(fingerprints(docs.select(docs[q(doc_id)].alias("doc_id"), docs[q(text)].alias("text")), "text", ["doc_id"], shingle))
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    found = components(links(distinct.select("fp"), bits, node_size))
    return _named(found, prints, distinct, "fp").select(F.col("doc_id").alias(doc_id), "fp", "component_id")


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _text_hash(docs: DataFrame, text: str):
    return F.xxhash64(F.coalesce(docs[q(text)].cast("binary"), F.lit(b"")))


def _one_row_each(docs: DataFrame, groups: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The documents that come first in their group by (id, text hash): `groups` has doc_id, text_hash, key and
    component_id of every row. Rows without an id stay. Texts meet the list of the rows to drop, which has no bound, by
    shuffle at any size, so that small tables are worked on as large ones are."""
    groups = table(groups.where("doc_id is not null").select("doc_id", "text_hash", "component_id"), "groups")
    rows = groups.groupBy("component_id", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("n_rows"))
    rows, first = table(rows, "rows"), table(first, "first")
    judged = table(join_hot(rows, first, ["component_id"], "n_rows", rows.count()).select("doc_id", "text_hash", "n", (F.col("first") == F.struct("doc_id", "text_hash")).alias("stays")), "judged")
    out = docs.select(packed(docs).alias("row"), docs[q(doc_id)].alias("doc_id"), _text_hash(docs, text).alias("text_hash"))
    # one text in two components of one id cannot be: equal texts are in one group
    kept = out.join(table(judged.where("not stays").select("doc_id", "text_hash"), "dropped").hint("merge"), ["doc_id", "text_hash"], "left_anti")
    again = table(judged.where("stays and n > 1").select("doc_id", "text_hash"), "again")
    if not again.isEmpty():
        same = kept.join(again, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
        kept = kept.join(again, ["doc_id", "text_hash"], "left_anti").unionByName(same)
    return kept.select(*fields("row", docs.columns))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = BITS, node_size: int = NODE_SIZE, shingle: int = SHINGLE) -> DataFrame:
    """The documents, of each group of near-duplicates only the row with the smallest id (of several texts under that id
    that with the smallest hash, of equal rows one); all columns unchanged. Rows without an id stay."""
    rows = docs.select(docs[q(doc_id)].alias("doc_id"), _text_hash(docs, text).alias("text_hash"), docs[q(text)].alias("text")).where("doc_id is not null")
    prints = saved(fingerprints(rows, "text", ["doc_id", "text_hash"], shingle))
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    # a component is named by its fingerprints here: ids may repeat in other components
    found = components(links(distinct.select("fp"), bits, node_size))
    return _one_row_each(docs, _by_key(found, prints, distinct, "fp"), text, doc_id)


def _by_key(found: DataFrame, members: DataFrame, distinct: DataFrame, key: str) -> DataFrame:
    """`members` with component_id: the name of their key's component, or the key itself."""
    named = distinct.join(found.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", key).alias("component_id"), "n")
    return join_hot(members, saved(named), [key], "n", members.count())


# Near-duplicates by similarity: the same fingerprints and Gray order, with a wider radius and an exact check.

LEAST = 0.8
WIDE_SHINGLE = 5
WIDE_BITS = 28  # a similarity of 0.8 is some 10 to 12 of 64 bits on average, with a deviation of 3: one in 10 ** 7 is beyond
NODES_A_SET = 12  # two sets of similarity 0.8 choose none in common once in 10 ** 9
SMALL_SET = 48  # sets of so many shingles enter all their nodes
ANCHORS = 24  # two sets of similarity 0.8 have none in common once in 10 ** 16
SKETCH = 256  # bits
_WORDS = SKETCH // 64
_DEVIATIONS = 7.5  # a sketch of two sets of similarity 0.8 differs in more bits once in 10 ** 9
_FACTOR = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """64-bit hashes of all shingles of the lower-cased (A-Z) words, in order; fewer words are one shingle."""
    words = spaced(text.lower())
    known = {w: xxh64_intdigest(w, 42) for w in set(words)}
    a = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(a):
        return a
    size = min(shingle, len(a))
    h = np.full(len(a) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(_FACTOR) + a[k : len(a) - size + 1 + k]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 16_384):
        part = hashes[a : a + 16_384].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _signed_of(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def set_key(distinct: np.ndarray) -> int:
    return _signed_of(xxh64_intdigest(distinct.tobytes(), 7))


def anchors(distinct: np.ndarray, n: int = ANCHORS) -> np.ndarray:
    """The least shingle of each of `n` classes of shingles: equal in two sets with a probability of their similarity."""
    if not len(distinct):
        return distinct
    kind = distinct % np.uint64(n)
    order = np.argsort(kind, kind="stable")  # `distinct` is sorted
    return distinct[order[np.concatenate([[True], np.diff(kind[order].astype(np.int64)) != 0])]]


def sketch(distinct: np.ndarray) -> bytes:
    """A bit for each of SKETCH classes of shingles: one of its least shingle, 0 if it has none. If the least of two sets
    together is in both, as with a probability of their similarity, their bits are equal, else in one of two cases."""
    bits = np.zeros(SKETCH, np.uint8)
    kind = (distinct % np.uint64(SKETCH)).astype(np.int64)
    least, at = np.unique(kind, return_index=True)  # `distinct` is sorted
    bits[least] = distinct[at] // np.uint64(SKETCH) % np.uint64(2)
    return np.packbits(bits).tobytes()


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, key (a hash of the set of shingles), fp (of the set: no shingle counts twice), size, sketch and
    anchors of every row. Equal sets have equal values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle)) for t in raw_texts(batch, "text")]
            out = batch.drop_columns(["text"]).append_column("key", pa.array([set_key(h) for h in sets], pa.int64()))
            out = out.append_column("fp", pa.array([_signed_of(_majority(h)) for h in sets], pa.int64()))
            out = out.append_column("size", pa.array([len(h) for h in sets], pa.int64()))
            out = out.append_column("sketch", pa.array([sketch(h) for h in sets], pa.binary()))
            yield out.append_column("anchors", pa.array([anchors(h).view(np.int64) for h in sets], pa.list_(pa.int64())))

    schema = T.StructType([rows.schema["doc_id"], rows.schema["text_hash"], *(T.StructField(n, T.LongType()) for n in ("key", "fp", "size")), T.StructField("sketch", T.BinaryType()), T.StructField("anchors", T.ArrayType(T.LongType()))])
    return table(rows.select("doc_id", "text_hash", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema), "sets")


def _shared_nodes(rows: DataFrame, more_than: int = 1) -> DataFrame:
    """The rows (node, ...) of nodes with several rows, and `held`: how many."""
    counts = saved(rows.groupBy("node").agg(F.count("*").alias("held")).where(F.col("held") > more_than))
    return table(join_hot(rows, counts.withColumn("weight", F.col("held")), ["node"], "weight", rows.count()), "nodes")


def _nodes(distinct: DataFrame, node_size: int) -> DataFrame:
    """(node, key, fp, size): sets by the anchors that they share with others. A crowded node gives way to nodes of two
    anchors; one that is still crowded holds texts that have much in common and stays whole."""
    rows = table(distinct.select(F.explode("anchors").alias("node"), "key", "fp", "size"), "anchored")
    nodes = _shared_nodes(rows)
    crowded = nodes.where(F.col("held") > node_size).select("node", "key")
    if crowded.isEmpty():
        return nodes.drop("held")
    pairs = crowded.join(distinct.select("key", "fp", "size", "anchors"), "key").select("node", F.explode("anchors").alias("other"), "key", "fp", "size").where("node <> other")
    finer = table(pairs.select(F.xxhash64(F.least("node", "other"), F.greatest("node", "other")).alias("node"), "key", "fp", "size").distinct(), "finer")
    return nodes.where(F.col("held") <= node_size).drop("held").unionByName(_shared_nodes(finer).drop("held"))


def candidates(fp: np.ndarray, size: np.ndarray, firsts: np.ndarray, bits: int, least: float, sketches: np.ndarray | None = None) -> np.ndarray:
    """A member of the same part for each member of groups (firsts: where each starts), parts by pairs within `bits` in a
    group whose sizes and sketches (a row of words a member, if given) allow a similarity of `least`: no other pair of the
    group can be a link. Pairs a few places apart come first, for all groups of a batch at once; then all pairs of the
    larger groups, in blocks, but those in one part already.

    Sketches differ in no more bits than the sets in shingles, a bound that holds always, and hardly ever in many more
    than the mean at a similarity of `least`."""
    half = (1 - least) / 2
    most = SKETCH * half + _DEVIATIONS * (SKETCH * half * (1 - half)) ** 0.5

    def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (np.bitwise_count(fp[a] ^ fp[b]) <= bits) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-9)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        if sketches is not None:
            apart = np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=1, dtype=np.int64)
            alike = (apart <= most) & (apart <= (1 - least) / (1 + least) * (size[a] + size[b]) + 1e-9)
            a, b = a[alike], b[alike]
        forest.join(a, b)

    n, forest = len(fp), _Forest(len(fp))
    ends = np.append(firsts[1:], n)
    end = np.repeat(ends, ends - firsts)
    for step in range(1, _FAN):
        a = np.flatnonzero(np.arange(n) + step < end)
        a = a[fits(a, a + step)]
        join(a, a + step)
    for a, z in zip(firsts[ends - firsts > _FAN].tolist(), ends[ends - firsts > _FAN].tolist()):
        for low in range(a, z, 1024):
            others = np.arange(low, min(z, low + 1024))
            for start in range(low, z, 256):
                some = np.arange(start, min(z, start + 256))
                i, j = np.nonzero(fits(some[:, None], others[None, :]) & (forest.find(some)[:, None] != forest.find(others)[None, :]))
                join(some[i], others[j])
            if len(np.unique(forest.find(np.arange(a, z)))) == 1:
                break
    return forest.find(np.arange(n))


def with_partner(fp: np.ndarray, size: np.ndarray, firsts: np.ndarray, bits: int, least: float, sketches: np.ndarray | None = None) -> np.ndarray:
    """Which members of groups are in a part of `candidates` with others."""
    root = candidates(fp, size, firsts, bits, least, sketches)
    return np.bincount(root, minlength=len(root))[root] > 1


def _partnered(bits: int, least: float):
    """Rows (node, key, fp, size, sketch) sorted by node in; those in a part with others, and a key of that part, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, firsts in whole_groups(batches, ["node"]):
            fp, size, key = (np.ascontiguousarray(rows.column(c).to_numpy()) for c in ("fp", "size", "key"))
            sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(-1, _WORDS)
            root = candidates(fp.view(np.uint64), size, firsts, bits, least, sketches if bits < 64 else None)
            found = np.bincount(root, minlength=len(root))[root] > 1
            yield from rows.drop_columns(["sketch"]).append_column("root", pa.array(key[root])).filter(pa.array(found)).combine_chunks().to_batches()

    return run


def node_links(fp: np.ndarray, size: np.ndarray, tokens: list[np.ndarray], bits: int, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a node's members (in Gray order) within `bits` and of similarity `least`. Members
    come in turn, those in the middle of the node first; each is compared with all later ones that are not yet in its part."""
    starts = np.concatenate([[0], np.cumsum(size)])
    _, number, held = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    shared = held[number] > 1
    owner = np.repeat(np.arange(len(size)), size)
    # what no other member has is in no intersection: too much of that, and a member has no partner here
    alive = np.flatnonzero(np.bincount(owner[shared], minlength=len(size)) >= least * size - 1e-9)
    if len(alive) < 2:
        return []
    keep = shared & np.isin(owner, alive)
    number = number[keep]
    ends = np.cumsum(np.bincount(owner[keep], minlength=len(size))[alive])
    starts = np.concatenate([[0], ends[:-1]])
    fp, size = fp[alive], size[alive]
    run = np.arange(0, len(alive), _FAN)
    ones, zeros = np.bitwise_and.reduceat(fp, run), np.bitwise_and.reduceat(~fp, run)
    middle = np.uint64(_majority(fp))
    order = np.argsort(np.bitwise_count(fp ^ middle), kind="stable")
    part, waiting, mark, edges = np.arange(len(alive)), np.ones(len(alive), bool), np.zeros(int(number.max()) + 1, bool), []
    for i in order.tolist():
        waiting[i] = False
        near = np.flatnonzero(np.bitwise_count((ones & ~fp[i]) | (zeros & fp[i])) <= bits)  # runs first
        at = (near[:, None] * _FAN + np.arange(_FAN)).ravel()
        at = at[at < len(alive)]
        at = at[waiting[at] & (part[at] != part[i]) & (np.bitwise_count(fp[at] ^ fp[i]) <= bits) & (np.minimum(size[at], size[i]) >= least * np.maximum(size[at], size[i]) - 1e-9)]
        if not len(at):
            continue
        own = number[starts[i] : ends[i]]
        mark[own] = True
        if 2 * len(at) > len(alive):
            both = np.add.reduceat(mark[number], starts, dtype=np.int64)[at]
        else:
            n = ends[at] - starts[at]
            first = np.cumsum(n) - n
            both = np.add.reduceat(mark[number[np.repeat(starts[at] - first, n) + np.arange(int(n.sum()))]], first, dtype=np.int64)
        mark[own] = False
        for j in at[both >= least * (size[i] + size[at] - both) - 1e-9].tolist():
            if part[j] != part[i]:
                edges.append((int(alive[i]), int(alive[j])))
                part[part == part[j]] = part[i]
    return edges


def _node_search(bits: int, least: float):
    """Rows (node, key, fp, tokens) sorted by node and Gray rank in; links (u, v) between keys out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, firsts in whole_groups(batches, ["node"], 8192):
            fp, key = (np.ascontiguousarray(rows.column(c).to_numpy()) for c in ("fp", "key"))
            tokens = [np.frombuffer(t, "<u4") for t in rows.column("tokens").to_pylist()]
            size = np.array([len(t) for t in tokens], np.int64)
            found = [(a + i, a + j) for a, z in zip(firsts.tolist(), [*firsts[1:].tolist(), len(key)], strict=True) if z - a > 1 for i, j in node_links(fp.view(np.uint64)[a:z], size[a:z], tokens[a:z], bits, least)]
            if found:
                u, v = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(key[u]), pa.array(key[v])], ["u", "v"])

    return run


def _tokens(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(key, tokens): the set of each wanted text (doc_id, text_hash, key) as sorted 32-bit hashes. Only these are read again."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique((shingle_hashes(t, shingle) >> np.uint64(32)).astype("<u4")).tobytes() for t in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], ["key", "tokens"])

    bodies = rows.join(table(wanted, "wanted").hint("merge"), ["doc_id", "text_hash"]).select("key", F.col("text").cast("binary").alias("text"))
    return table(bodies.mapInArrow(again, "key long, tokens binary").dropDuplicates(["key"]), "tokens")


def _similar(docs: DataFrame, text: str, doc_id: str, shingle: int, least: float, bits: int, node_size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components of set keys, rows (doc_id, text_hash, key) and sets (key, first_id, n)."""
    rows = docs.select(docs[q(doc_id)].alias("doc_id"), _text_hash(docs, text).alias("text_hash"), docs[q(text)].alias("text")).where("doc_id is not null")
    sets = _sets(rows, shingle)
    first = F.min(F.struct("doc_id", "text_hash"))
    distinct = table(sets.groupBy("key").agg(first.alias("first"), F.count("*").alias("rows"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("anchors").alias("anchors")), "distinct")
    # of the nodes that a large set shares it enters the NODES_A_SET first by value
    entered = F.when(F.col("size") <= SMALL_SET, ANCHORS * ANCHORS).otherwise(NODES_A_SET)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # without the shingles first: who has no partner in a node by fingerprint, size and sketch has no link there
    shared = _nodes(distinct, node_size).join(distinct.select("key", "sketch"), "key").select("node", "key", "fp", "size", "sketch").repartition(n, "node").sortWithinPartitions("node")
    viable = table(shared.mapInArrow(_partnered(bits, least), "node long, key long, fp long, size long, root long"), "viable")
    # all links of a set are in its part of the candidates: up to node_size sets meet there, once each, and others in nodes
    parts = table(components(viable.select(F.col("key").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "key"), "parts")
    counts = table(parts.groupBy("component").agg(F.count("*").alias("held")), "counts")
    parts = table(join_hot(parts, counts.withColumn("weight", F.col("held")), ["component"], "weight", parts.count()), "sized")
    meeting = parts.where(F.col("held") <= node_size).join(distinct.select("key", "fp"), "key").select("component", "key", "fp")
    crowd = viable.join(parts.where(F.col("held") > node_size).select("key"), "key", "left_semi")
    nodes = crowd.groupBy("key", "fp", "size").agg(F.array_sort(F.collect_set("node")).alias("nodes")).withColumn("nodes", F.slice("nodes", F.lit(1), entered))
    nodes = _shared_nodes(table(nodes.select("key", "fp", F.explode("nodes").alias("node")), "chosen")).drop("held")
    nodes = table(nodes.select("node", "key", "fp").unionByName(meeting.select(F.col("component").alias("node"), "key", "fp")), "meeting")
    wanted = distinct.join(nodes.select("key").distinct(), "key").select("key", "first.doc_id", "first.text_hash")
    dealt = nodes.join(_tokens(rows, wanted, shingle), "key").select("node", "key", "fp", "tokens", gray_rank(F.col("fp")).alias("rank"))
    links_ = dealt.repartition(n, "node").sortWithinPartitions("node", "rank", "key").select("node", "key", "fp", "tokens").mapInArrow(_node_search(bits, least), "u long, v long")
    found = components(saved(links_.distinct()))
    return found, sets.select("doc_id", "text_hash", "key"), distinct.select("key", F.col("first.doc_id").alias("first_id"), F.col("rows").alias("n"))


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = WIDE_SHINGLE, least: float = LEAST, bits: int = WIDE_BITS, node_size: int = NODE_SIZE) -> DataFrame:
    """doc_id, key and component_id: the smallest doc_id that links of a Jaccard similarity of `least` or more on word
    shingles reach. Links are sought among texts that share an anchor (the least shingle of one of 24 classes), in the
    Gray order of their fingerprints within `bits` and by sketches (64: all of a node), and checked by all their shingles, as 32-bit hashes. Texts of no words are one
    group; null counts as empty. One row for each document with an id."""
    found, members, distinct = _similar(docs, text, doc_id, shingle, least, bits, node_size)
    return _named(found, members, distinct, "key").select(F.col("doc_id").alias(doc_id), "key", "component_id")


def one_of_each_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = WIDE_SHINGLE, least: float = LEAST, bits: int = WIDE_BITS, node_size: int = NODE_SIZE) -> DataFrame:
    """The documents, of each group of `similar` ones only the first row, as in `one_of_each`."""
    found, members, distinct = _similar(docs, text, doc_id, shingle, least, bits, node_size)
    return _one_row_each(docs, _by_key(found, members, distinct, "key"), text, doc_id)
