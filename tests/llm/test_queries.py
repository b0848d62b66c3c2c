"""The registered corpus queries on the given tables: against DuckDB where SQL can express them, else against plain Python."""

import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from polyspan.llm import bpe, license_scan, media, quality, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: {r[0]: r for r in queries.QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.sql(queries.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())


def test_simhash(docs, run):
    from xxhash import xxh64_intdigest

    def plain(text):
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    got, prints = run("op1_simhash"), {i: plain(t) for i, t in docs.items()}
    up = {i: i for i in docs}
    find = lambda x: x if up[x] == x else find(up[x])
    for i in docs:
        for j in docs:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_bpe(docs, run):
    import tiktoken

    ranks, pattern = queries.vocabulary()
    whole, got = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), run("op4_byte_bpe")
    for i, t in docs.items():
        ids = np.array(whole.encode_ordinary(t), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_audio(docs, run):
    got = run("op6_audio")
    for i, t in docs.items():
        payload = media.padded(t.encode())
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes == len(media.wav(payload)) and r.feature.count("|") == 5
    same = {}
    for i, t in docs.items():
        assert same.setdefault(t, got[i].feature) == got[i].feature


def test_licenses(docs, run):
    got = run("op10_licenses")
    for i, t in docs.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        at = sorted((k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_quality_scores(spark, docs, run):
    """The query's scores against the model's sums over plain features of every text."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    for i, r in run("op3_quality").items():
        at, value = quality.features(docs[i].encode())
        grades = model.grades(np.array([model.weights[at] @ np.array(value)]))[0]
        assert abs(r.tail_probability - grades[1:].sum()) < 1e-9 and abs(r.expected_grade - grades @ np.arange(len(grades))) < 1e-9
        assert r.kept == (r.tail_probability >= 0.5)


def test_quality_gradient():
    """The fitted model is where the likelihood is highest: no small step in any direction makes it much better."""
    rng = np.random.default_rng(1)
    rows = [([int(k) for k in rng.integers(0, 40, 6)], [1.0] * 6) for _ in range(300)]
    truth = rng.normal(0, 1, 40)
    grades = np.clip(np.round(np.array([truth[i].sum() for i, _ in rows]) / 2 + 1 + rng.normal(0, 0.5, 300)), 0, 2).astype(int)
    model = quality.fit_ordinal(rows, grades, steps=600, decay=1e-3)

    def loss(weights, cuts):
        score = np.array([weights[i].sum() for i, _ in rows])
        p = quality.Ordinal(weights, cuts).grades(score)[np.arange(300), grades]
        return -np.log(p).mean() + 0.5e-3 * (weights**2).sum()

    at = loss(model.weights, model.thresholds)
    for k in range(40):
        for step in (-0.05, 0.05):
            w = model.weights.copy()
            w[k] += step
            assert loss(w, model.thresholds) > at - 2e-3
    for k in range(2):
        for step in (-0.05, 0.05):
            cuts = model.thresholds.copy()
            cuts[k] += step
            assert loss(model.weights, cuts) > at - 2e-3


def test_toxicity_scores(spark, docs, run):
    """The query's scores against means of plain subword sums; labels of held-out rows change nothing."""
    frame, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(frame, labels)
    flipped = labels.withColumn("toxic", __import__("pyspark").sql.functions.expr("if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic)"))
    again = toxicity.fit(frame, flipped)
    assert (model.parts == again.parts).all() and model.bias == again.bias
    for i, r in run("op7_toxicity").items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in docs[i]))
        total = 0.0
        for x in w:
            bucket, _ = toxicity.subwords([x.encode()])
            total += model.parts[bucket].mean()
        p = 1 / (1 + np.exp(-(model.bias + total / (toxicity.BLANKS + len(w)))))
        assert abs(r.score - p) < 1e-9 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_toxicity_of_unseen_misspellings():
    """No word of the text was learnt; n-grams carry it."""
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in ("stone", "river", "cloud", "maple") for b in ("side", "light", "field", "house")]
    bags = [dict.fromkeys([w.encode() for w in rng.choice(plain, 8)] + ([b"rotten", b"vermin"] if k % 2 else []), 1) for k in range(200)]
    model = toxicity.fit_subwords(bags, np.arange(200) % 2)
    of = lambda words: model.words(words).mean()
    assert of([b"rottenn", b"rottten", b"verminn"]) > max(of([b"riverstone"]), of([b"mapleside"]), of([b"cloudriver"]))
    bucket, owner = toxicity.subwords(["né".encode(), b"a"])
    assert np.bincount(owner).tolist() == [1 + 2 + 1, 1 + 1] and (bucket < toxicity.BUCKETS).all()


def test_fingerprint_order():
    fps = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64))
    near = {tuple(p) for a, b in simhash.near_pairs(fps, np.array([0, 200]), 26) for p in zip(a.tolist(), b.tolist())}
    assert near == {(i, j) for i in range(500) for j in range(i + 1, 500) if (i < 200) == (j < 200) and int(fps[i] ^ fps[j]).bit_count() <= 26}
    assert bpe.token_bytes({b"a": 1}) == [b"", b"a"]
