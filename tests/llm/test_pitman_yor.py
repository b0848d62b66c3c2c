"""The language model: counts against plain Python, seating against its exact distribution, scores where nothing is random."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from polyspan.llm import pitman_yor, queries

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def base_rows(docs):
    """doc -> (held_out, n_tokens, n_known, train_tokens), base_score."""
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in docs}
    count = Counter(t for d, text in docs if not held[d] for t in tokens(text))
    n, v = count.total(), len(count)
    rows = {}
    for d, text in docs:
        own = tokens(text)
        rows[d] = (held[d], len(own), sum(t in count for t in own), n), sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
    return rows


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    expected, got = base_rows(docs), queries.QUERIES["op12_language_model"](spark, SF).collect()
    assert {r[0]: tuple(r[1:5]) for r in got} == {d: r for d, (r, _) in expected.items()}
    assert all(math.isclose(r.base_score, expected[r.doc_id][1], rel_tol=1e-9) for r in got)
    perplexity = lambda column, held: sum(r[column] for r in got if r.held_out == held) / sum(r.n_tokens for r in got if r.held_out == held)
    assert perplexity("score", False) > perplexity("base_score", False) and perplexity("score", True) > perplexity("base_score", True)
    again = {r[0]: r[6] for r in queries.QUERIES["op12_language_model"](spark, SF).collect()}
    assert again == {r[0]: r[6] for r in got}


def test_scores_where_every_pair_and_word_occurs_once(spark):
    """Then every customer has a table of its own at both levels, and the scores follow from the definition."""
    train = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 != 1)
    held = [i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    docs = [(train, "A b c d"), (held[0], "b c"), (held[1], "x b"), (held[2], ""), (held[3], "c a a")]
    got = {r.row["doc_id"]: r.score for r in pitman_yor.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    d = d0 = 0.95  # n1 / (n1 + 2 n2) is one: the largest discount
    seq = [b"", b"a", b"b", b"c", b"d", b""]
    pairs, types, theta = set(zip(seq, seq[1:])), 5, pitman_yor.STRENGTH
    root = lambda w: ((1 - d0 if w in seq else 0) + (theta + d0 * 5) / (types + 1)) / (theta + 5)

    def p(u, w):
        c = u in seq
        return ((1 - d) * ((u, w) in pairs) + (theta + d * c) * root(w)) / (theta + c)

    for i, text in docs:
        own = tokens(text)
        assert math.isclose(got[i], sum(math.log10(p(u, w)) for u, w in zip([b"", *own], own)), rel_tol=1e-9)
    assert math.isclose(sum(root(w) for w in {*seq, b"unknown"}), 1)


@pytest.mark.parametrize("n,new,discount", [(2, 0.3, 0.5), (4, 1.5, 0.7), (5, 0.02, 0.3)])
def test_seating_has_the_exact_distribution(n, new, discount):
    weight = Counter()  # of numbers of tables: new ** tables times the tables' factors, by sequential seating

    def seat(sizes, left, w):
        if not left:
            weight[len(sizes)] += w
            return
        seat([*sizes, 1], left - 1, w * new)
        for k, s in enumerate(sizes):
            seat([*sizes[:k], s + 1, *sizes[k + 1 :]], left - 1, w * (s - discount))

    seat([], n, 1.0)
    many = 40_000
    seating, rng = pitman_yor.Seating(np.full(many, n)), np.random.default_rng(3)
    for _ in range(30):
        seating.sweep(rng, np.full(many, new), discount)
    found = Counter(seating.counts().tolist())
    total = sum(weight.values())
    assert all(abs(found[t] / many - w / total) < 0.012 for t, w in weight.items())


def test_seating_stays_whole_and_comes_back():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 50, 300)
    seating = pitman_yor.Seating(n)
    for k in range(4):
        seating.sweep(rng, rng.random(300) * 3, 0.6)
        tables, sizes = seating.told()
        ends = np.cumsum(tables)
        assert (np.add.reduceat(sizes, ends - tables) == n).all() and (sizes > 0).all()
        if k % 2:
            seating = pitman_yor.Seating(n, tables, sizes)
            assert all((a == b).all() for a, b in zip(seating.told(), (tables, sizes)))


def test_frequent_pairs_odd_rows_and_small_chunks(spark):
    """A context and a pair that hold nearly all tokens, which are dealt to buckets and blocks."""
    rows = [(k, "the the Of the\tof " * 700 + f"word{k} the word{k % 3}") for k in range(12)] + [(20, None), (21, ""), (21, "the"), (21, "the"), (None, "the \x0b of\x00"), (22, "naïve ÀB " + "y" * 100_000)]
    docs = spark.createDataFrame([(a, b, 1, "t") for a, b in rows], "`doc.id` long, `te xt` string, `_text` int, kind string")
    scored = pitman_yor.score(docs, "doc.id", "te xt", ["doc.id", "_text", "kind"], buckets=7, chunk_bytes=20_000).collect()
    assert len(scored) == len(rows) and {(r.row["_text"], r.row["kind"]) for r in scored} == {(1, "t")}
    expected = base_rows(rows)
    for r in scored:
        if r.row["doc.id"] != 21:
            assert tuple(r)[1:5] == expected[r.row["doc.id"]][0] and math.isclose(r.base_score, expected[r.row["doc.id"]][1], rel_tol=1e-9)
    twice = [r.score for r in scored if r.row["doc.id"] == 21]
    assert len(twice) == 3 and len(set(twice)) == 2
    assert sum(r.score for r in scored) > sum(r.base_score for r in scored)
    assert all(np.isfinite(r.score) and r.score < 0 for r in scored)


def test_nothing_learnt(spark):
    held = [i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    docs = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in pitman_yor.score(docs).collect()} == {(0, 0, 0.0, 0.0)}
    assert pitman_yor.score(docs.limit(0)).collect() == []
