"""Tokenizer alignment against a plain merge of both lists of ends."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polyspan.llm import align, queries

SF = "/root/testdata/sf0.001"
FILES = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(FILES[0])
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    with open(FILES[0]) as f:
        a_table = align.ByteLevel(f.read(), public_tokenizers.PATTERN).table
    rows, links = [], []
    for text in texts:
        rows.append((0, 0, 0, 0, ""))
        links.append(Counter())
        if not text:
            continue
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        a_bytes = [a_table[i] for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
        if not b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
            continue
        i = j = a_end = b_end = 0
        groups, ga, gb = [], [], []
        while i < len(a):
            links[-1][a[i], b[j]] += 1
            an, bn = a_end + len(a_bytes[i]), b_end + len(b_bytes[j])
            if an <= bn:
                ga.append(str(a[i]))
                i, a_end = i + 1, an
            if bn <= an:
                gb.append(str(b[j]))
                j, b_end = j + 1, bn
            if an == bn:
                groups.append(f"{','.join(ga)}|{','.join(gb)}")
                ga, gb = [], []
        rows[-1] = (len(a), len(b), len(groups), links[-1].total(), ";".join(groups))
    count = Counter(p for found in links for p in found)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(n, best.get(a, 0))
    return [(*r[:4], sum(n for p, n in found.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in found.items()), r[4]) for r, found in zip(rows, links)]


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    expected = {d.doc_id: (*r[:6], hashlib.sha256(r[6].encode()).hexdigest() if r[6] else "") for d, r in zip(docs, plain([d.text for d in docs]))}
    assert {r[0]: tuple(r[1:]) for r in queries.QUERIES["op13_alignment"](spark, SF).collect()} == expected


ODD = [None, "", " ", "a", "  two  spaces\n\n\tand tabs ", "<|endoftext|> and <s> </s> <unk> <0x41>", "日本語のテキスト と emoji 👩‍👩‍👧 ߷ ꙮ", "▁ piece mark", "x" * 5000, "\x00\x1c\x85 controls", "ﬁ ligature ½ Ⅳ", "same text", "same text", "Ünïcödé déjà vu " * 300, "á combining", "​﻿ zero", "9" * 3000 + "'ll 've"]


def test_odd_texts_names_and_chunks(spark):
    rows = [(i, t, 1.5, "k") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "`a.b` long, `te xt` string, blob double, kind string").repartition(3)
    for chunk_chars in (align.CHUNK_CHARS, 40):
        got = align.align(docs, *FILES, public_tokenizers.PATTERN, text="te xt", keep=["a.b", "kind", "blob"], chunk_chars=chunk_chars).collect()
        assert {r.row["a.b"]: tuple(r)[1:] for r in got} == dict(enumerate(plain(ODD)))
        assert {(r.row["kind"], r.row["blob"]) for r in got} == {("k", 1.5)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(docs, *FILES, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40)), min_size=1, max_size=5))
def test_cuts_are_the_common_ends(docs):
    a_ends, b_ends, last, base = [], [], [], 0
    for a, b in docs:
        size = max(sum(a), sum(b))
        a, b = [*np.cumsum(a[:-1]), size], [*np.cumsum(b[:-1]), size]
        a, b = sorted({x for x in a if x <= size}), sorted({x for x in b if x <= size})
        a_ends += [base + x for x in a]
        b_ends += [base + x for x in b]
        last.append(len(a_ends))
        base += size
    a_ends, b_ends, last = np.array(a_ends), np.array(b_ends), np.array(last)
    got = align.cuts(a_ends, b_ends, np.concatenate([[0], last[:-1]]), last)
    assert (got == np.isin(a_ends, b_ends)).all()


@pytest.mark.parametrize("cut_at", [0, 1, 4999, 9998])
def test_one_cut_far_from_the_middle(cut_at):
    a_ends = np.arange(2, 20002, 2)
    b_ends = np.sort(np.array([*(a_ends - 1)[1:], a_ends[cut_at], a_ends[-1]]))
    got = align.cuts(a_ends, b_ends, np.array([0]), np.array([len(a_ends)]))
    assert np.flatnonzero(got).tolist() == sorted({cut_at, len(a_ends) - 1})


def test_encoding_keeps_columns_of_any_name(spark):
    from polyspan.llm import bpe

    rows = [(i, t, 1.5, "k", b"x") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "`a.b` long, `te xt` string, `_text` double, kind string, ids binary").repartition(3)
    ranks, pattern = queries.vocabulary()
    got = bpe.encode(docs, ranks, pattern, text="te xt", keep=["a.b", "_text", "kind"], decoded=True)
    assert got.columns == ["a.b", "_text", "kind", "ids", "decoded"]
    assert {(r[0], r[1], r[2], bytes(r[4])) for r in got.collect()} == {(i, 1.5, "k", (t or "").encode()) for i, t in enumerate(ODD)}
