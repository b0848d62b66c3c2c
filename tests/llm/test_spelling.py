"""Spelling variants against comparing all words."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from polyspan.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms(count, everything=True):
    """word -> (form, root, n, n_near, form_n); near words by trying every pair, or every deletion."""
    found = defaultdict(set)
    if everything:
        for a in count:
            found[a] = {b for b in count if near(a, b)}
    else:
        met = defaultdict(set)
        for w in count:
            for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
                met[v].add(w)
        for group in met.values():
            for a in group:
                found[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, n in count.items():
        best = min(found[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(found[w]), count.get(form[w])) for w, n in count.items()}


def counted(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = forms(counted(rows), everything=False)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.QUERIES["op11_spelling"](spark, sf).collect()}
    assert got == expected and any(v[0] for v in expected.values())


def test_every_pair_of_made_up_words(spark):
    """Few letters, so that words have many neighbours, runs of letters and long chains; words of a range's border too."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abàÿ"), rng.integers(7, 10))) for _ in range(500)} | {"a" * k for k in range(7, 40)} | {"b" * 3000, "b" * 2999, "b" * 3000 + "a"}
    count = {w: int(10 ** rng.integers(0, 7)) * 2 for w in words}
    table = spark.createDataFrame(list(count.items()), "word string, n long").repartition(5)
    named, learnt = spelling.neighbours(spelling.saved(table))
    word = {r.id: r.word for r in named.collect()}
    assert sorted(word, key=word.get) == sorted(word)
    got = {word[r.id]: (r.n_near, r.best_n, word[r.best]) for r in learnt.collect()}
    expected = {}
    for a in count:
        if mine := [b for b in count if near(a, b)]:
            best = min(mine, key=lambda v: (-count[v], v))
            expected[a] = (len(mine), count[best], best)
    assert got == expected


def test_whole_rows(spark):
    rows = [(1, "Zeppelin zeppelin ZEPPELIN zeppelin\tzeppelinÀ zeppelinÀ"), (2, None), (None, "zeppelinÀ zeppelinx zeppelin"), (3, ""), (3, "zeppelan zeppelan " + "zeppelin " * 40), (3, "zeppelan zeppelan " + "zeppelin " * 40), (4, "zeppelax zeppelax, short short x" + "y" * 70000), (5, "x" + "y" * 70000 + " zeppelin4zeppelin")]
    docs = spark.createDataFrame([(a, b, "w", 1) for a, b in rows], "`doc.id` long, `the text` string, word string, n int")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs, "doc.id", "the text").collect()}
    assert got == forms(counted(rows))
    assert spelling.variants(docs.limit(0), "doc.id", "the text").collect() == []


def test_chains_reach_their_roots(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(37)] + [(100, 37)], "id long, form long")
    assert {r.id: r.root for r in spelling.roots(links).collect()} == {k: 37 for k in [*range(37), 100]}
