"""Near-duplicates with repeated lines and short texts; overlapping secrets at every place of a run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyspan.llm import secrets, simhash


def linked(spark, pairs):
    """How many of the pairs of texts are linked."""
    docs = spark.createDataFrame([(2 * k + side, text) for k, pair in enumerate(pairs) for side, text in enumerate(pair)], "doc_id long, text string").repartition(8)
    group = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert len(group) == 2 * len(pairs)
    return sum(group[2 * k] == group[2 * k + 1] for k in range(len(pairs)))


@pytest.mark.parametrize("repeats", [0, 10, 40, 100])
def test_copies_with_a_repeated_line(spark, repeats):
    rng, pairs = np.random.default_rng(repeats), []
    for _ in range(200):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        other = [*words]
        other[150] = "changed"
        line = " ".join(words[:10])
        pairs.append((" ".join(words) + f" {line}" * repeats, " ".join(other) + f" {line}" * (repeats > 0)))
    assert linked(spark, pairs) == 200


def test_short_texts_of_exactly_the_least_similarity(spark):
    rng = np.random.default_rng(8)
    texts = [[f"w{x}" for x in rng.integers(0, 10**6, 9)] for _ in range(3000)]
    assert linked(spark, [(" ".join(t[:8]), " ".join(t)) for t in texts]) == 3000


def test_long_texts_of_about_the_least_similarity(spark):
    """Similarity 0.802: 22 of 600 words changed, each in five shingles."""
    rng, pairs = np.random.default_rng(9), []
    for _ in range(1000):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 604)]
        other = [*words]
        for at in range(20, 600, 5 * 49 // 9)[:13]:
            other[at] = "x" + other[at]
        pairs.append((" ".join(words), " ".join(other)))
    assert linked(spark, pairs) == 1000


def test_unlike_texts_stay_apart(spark):
    rng = np.random.default_rng(10)
    texts = [[f"w{x}" for x in rng.integers(0, 10**6, 12)] for _ in range(500)]
    assert linked(spark, [(" ".join(t[:8]), " ".join(t)) for t in texts]) == 0  # 4 of 8 shingles


def test_nested_secrets_at_every_place_of_a_run(spark):
    token = "a1b2c3d4e5f6a7b8c9d0e1f2a3b4"
    nested = f"password={token}-Alpha-{token}-MySecretTail-{token}-Omega"
    rows = [(n, " ".join(f"{k:04x}{token}" for k in range(n)) + f" {nested} end") for n in (0, 1, 20, *range(120, 134), 254, 255, 256, 257)]
    docs = spark.createDataFrame([(n, t, "s", "l") for n, t in rows], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r.text for r in secrets.redact(docs, owner=F.lit("o"), repository=F.lit("r")).collect()}
    for n, text in rows:
        assert got[n] == " ".join(["[REDACTED]"] * n) + " [REDACTED] end"


def test_spans_as_one_like_a_plain_sweep(spark):
    rng, rows = np.random.default_rng(4), []
    for k in range(300):
        starts = np.sort(rng.integers(0, 400, rng.integers(0, 300)))
        rows.append((k, [(int(a), int(a + rng.choice([1, 2, 30, 150]))) for a in starts]))
    table = spark.createDataFrame(rows, "k int, spans array<struct<start:int,end:int>>")
    got = {r.k: [tuple(s) for s in r.out] for r in table.select("k", secrets._apart_from_others(F.col("spans")).alias("out")).collect()}
    for k, spans in rows:
        expected = []
        for a, z in spans:
            if expected and a < expected[-1][1]:
                expected[-1] = (expected[-1][0], max(z, expected[-1][1]))
            else:
                expected.append((a, z))
        assert got[k] == expected


def test_partners_like_all_pairs():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 60, 80)
    sizes[:2] = 3000, 5000
    fp = rng.integers(0, 1 << 63, sizes.sum()).astype(np.uint64)
    size = rng.integers(10, 14, sizes.sum())
    firsts = np.cumsum(sizes) - sizes
    found = simhash.with_partner(fp, size, firsts, 17, 0.8)
    for a, n in zip(firsts.tolist(), sizes.tolist()):
        f, s = fp[a : a + n], size[a : a + n]
        for i in range(n):
            near = (np.bitwise_count(f ^ f[i]) <= 17) & (np.minimum(s, s[i]) >= 0.8 * np.maximum(s, s[i]) - 1e-9)
            near[i] = False
            assert found[a + i] == near.any()
    assert 0 < found.sum() < len(fp)


def plain_sketch(hashes):
    bits = 0
    for kind in range(simhash.SKETCH):
        own = [h for h in hashes if h % simhash.SKETCH == kind]
        bits = 2 * bits + (min(own) // simhash.SKETCH % 2 if own else 0)
    return bits.to_bytes(simhash.SKETCH // 8, "big")


def test_sketches_keep_every_pair_of_the_least_similarity():
    rng, kept, n = np.random.default_rng(12), 0, 400
    assert simhash.sketch(np.zeros(0, np.uint64)) == bytes(simhash.SKETCH // 8)
    for k in range(n):
        size = int(rng.choice([1, 2, 5, 9, 30, 100, 500, 3000]))
        union = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        apart = rng.permutation(len(union))[: len(union) // 5]  # similarity 0.8 or a little more
        a, b = (np.delete(union, apart[side::2]) for side in (0, 1))
        if k < 20:
            assert simhash.sketch(a) == plain_sketch([int(h) for h in a])
        sketches = np.frombuffer(simhash.sketch(a) + simhash.sketch(b), np.uint64).reshape(2, -1)
        kept += simhash.with_partner(np.zeros(2, np.uint64), np.array([len(a), len(b)]), np.array([0]), 28, 0.8, sketches).all()
    assert kept == n


def test_candidates_like_the_components_of_all_pairs():
    rng = np.random.default_rng(13)
    sizes = np.array([1, 7, 8, 9, 300, 1500])
    fp = rng.integers(0, 1 << 63, sizes.sum()).astype(np.uint64)
    size = rng.integers(100, 130, sizes.sum())
    sketches = rng.integers(0, 1 << 63, (sizes.sum(), simhash.SKETCH // 64)).astype(np.uint64)
    for _ in range(3):  # some members follow another one
        at, of = rng.integers(0, sizes.sum(), (2, 900))
        sketches[at] = sketches[of] ^ (np.uint64(1) << rng.integers(0, 63, (900, simhash.SKETCH // 64)).astype(np.uint64))
    firsts = np.cumsum(sizes) - sizes
    found = simhash.candidates(fp, size, firsts, 30, 0.8, sketches)
    for a, n in zip(firsts.tolist(), sizes.tolist()):
        f, s, k = fp[a : a + n], size[a : a + n], sketches[a : a + n]
        apart = sum(np.bitwise_count(k[:, None, w] ^ k[None, :, w]).astype(int) for w in range(k.shape[1]))
        total = s[:, None] + s[None, :]
        near = (np.bitwise_count(f[:, None] ^ f[None, :]) <= 30) & (np.minimum(s[:, None], s[None, :]) >= 0.8 * np.maximum(s[:, None], s[None, :])) & (apart <= 61) & (9 * apart <= total)
        root = np.arange(n)
        while ((down := np.where(near, root[None, :], n).min(axis=1, initial=n)) < root).any():
            root = np.minimum(root, down)
        assert (found[a : a + n] == a + root).all()
    assert 300 < (found != np.arange(len(found))).sum() < len(found) - len(sizes) - 300


def sent(spark, monkeypatch, texts, **options):
    """Groups of the texts by id, and how many rows go to the search of links with a set of shingles."""
    rows, plain = [], simhash.table

    def table(df, what, *rest):
        out = plain(df, what, *rest)
        if what == "meeting":
            rows.append(out.count())
        return out

    monkeypatch.setattr(simhash, "table", table)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    return {r.doc_id: r.component_id for r in simhash.similar(docs, **options).collect()}, sum(rows)


def test_only_likely_partners_send_their_shingles(spark, monkeypatch):
    """Texts with a passage in common are no candidates by that; a set of near copies is sent once."""
    rng, texts = np.random.default_rng(14), []
    passage = " ".join(f"p{x}" for x in range(60))
    for k in range(300):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        texts.append(" ".join(words) + " " + passage)
        if k < 20:
            texts.append(" ".join([*words[:-1], "other"]) + " " + passage)
    group, rows = sent(spark, monkeypatch, texts)
    assert len(set(group.values())) == 300 and len(group) == 320
    assert rows == 40


@pytest.mark.parametrize("node_size", [4096, 8])
def test_large_parts_meet_in_nodes(spark, monkeypatch, node_size):
    rng, texts = np.random.default_rng(15), []
    for k in range(4):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        for copy in range(30):
            other = [*words]
            other[10 * copy % 300] = f"c{copy}"
            texts.append(" ".join(other))
    group, rows = sent(spark, monkeypatch, texts, node_size=node_size)
    assert [group[i] for i in range(120)] == [30 * (i // 30) for i in range(120)]
    assert rows == 120 if node_size == 4096 else rows > 120


def test_texts_meet_lists_without_a_bound_by_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "u v w x y z")], "doc_id long, text string")
    kept = simhash.one_of_each_similar(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
