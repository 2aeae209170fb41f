"""Alignment of two tokenizers against their own libraries and pairs of byte ranges compared one by one."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from telescribe.llm import align, queries

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  \n ", "one", "One two", "one two", "a  b   c ", " lead", "tail  ", "\tx\n\n  y \n", "it's 1234 o'clock... ", "▁odd", "x▁y z", "<s> </s> <unk> <0x41>", "<|endoftext|> a<|endoftext|>",
       "日本語の文 と 中文", "naïve é é", "👍🏽 ok 👩‍👩‍👧", "a b c　d", "\x1c \x85   x", "\0 \x01", "word " * 20_000, "x" * 3000, " " * 500 + "z" + " " * 500, "ﬁ ½ Ⅳ ｆｕｌｌ", "​﻿ a"]


def plain(texts):
    """Rows as the contract has them, from whole texts."""
    own, other = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    own.encode_special_tokens = True
    loaded = align.load(A, B)
    docs = []
    for t in texts:
        a = own.encode(" " + t, add_special_tokens=False).ids if t else []
        b = other.encode(t) if t else []
        whole = (" " + (t or "")).encode()
        if not t or b"".join(loaded.bytes_a[i] for i in a) != whole or b"".join(loaded.bytes_b[i] for i in b) != whole:
            a, b = [], []
        ends_a, ends_b = ([0, *np.cumsum([len(own[i]) for i in ids]).tolist()] for own, ids in ((loaded.bytes_a, a), (loaded.bytes_b, b)))
        groups, link, i, j = [], [], 0, 0
        at_a, at_b = ({e: k for k, e in enumerate(ends)} for ends in (ends_a, ends_b))
        for cut in sorted(set(ends_a[1:]) & set(ends_b[1:])):
            x, y = at_a[cut], at_b[cut]
            groups.append((a[i:x], b[j:y]))
            link += [(a[p], b[q]) for p in range(i, x) for q in range(j, y) if max(ends_a[p], ends_b[q]) < min(ends_a[p + 1], ends_b[q + 1])]
            i, j = x, y
        assert (i, j) == (len(a), len(b))
        docs.append((a, b, groups, link))
    count = Counter(x for d in docs for x in d[3])
    most = defaultdict(int)
    for (_, q), n in count.items():
        most[q] = max(most[q], n)
    shown = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    rows = [(len(a), len(b), len(g), len(k), sum(count[x] == most[x[1]] for x in k), sum(count[x] for x in k), hashlib.sha256(shown(g).encode()).hexdigest() if a else "") for a, b, g, k in docs]
    return rows, count, most


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in docs), plain([r.text for r in docs])[0]))
    assert {r.doc_id: tuple(r)[1:] for r in queries.op11_cross_tokenizer_alignment(spark, SF).collect()} == want


@pytest.mark.parametrize("most_pairs", [align.MOST_PAIRS, 40, 1])
def test_odd_rows(spark, most_pairs, monkeypatch):
    """Odd texts, repeated rows, null ids and clashing columns; with few pairs sent, the others are joined."""
    texts = [*ODD, "one two", "one two"]
    df = spark.createDataFrame([(None if i == 5 else i % 20, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(3)
    rows, count, most = plain(texts)
    want = sorted(((None if i == 5 else i % 20, *r) for i, r in enumerate(rows)), key=repr)
    got = align.digests(df, A, B, most_pairs=most_pairs)
    assert got.columns == ["doc_id", *COLUMNS]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    lexicon = {(r.a_id, r.b_id): (r.n, r.best) for r in align.links(df, A, B).collect()}
    assert lexicon == {x: (n, n == most[x[1]]) for x, n in count.items()}


def test_aligned(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    want = plain(ODD)[0]
    for r in align.aligned(df, A, B).collect():
        assert (len(r.a), len(r.b), len(r.cuts), len(r.ends_a), len(r.ends_b)) == (*want[r.doc_id][:3], want[r.doc_id][2], want[r.doc_id][2])
        if r.a:
            assert r.cuts[-1] == len((" " + ODD[r.doc_id]).encode()) and (r.ends_a[-1], r.ends_b[-1]) == (len(r.a), len(r.b))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.digests(none, A, B).collect() == [] and align.links(none, A, B).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é\n\t '.1　 日\x1c"), max_size=30), max_size=5))
def test_stretches_have_their_own_tokens(texts):
    """Tokens of the stretches, one after the other, are those of the whole text."""
    loaded = align.Aligner(A, B) if loaded_once.get("x") is None else loaded_once["x"]
    loaded_once["x"] = loaded
    own = loaded_once.setdefault("a", Tokenizer.from_file(A))
    own.encode_special_tokens = True
    places, first = loaded.places(texts)
    for t, x, y in zip(texts, first[:-1], first[1:]):
        if t:
            assert loaded.taken("a", places[x:y])[0].tolist() == own.encode(" " + t, add_special_tokens=False).ids
            assert loaded.taken("b", places[x:y])[0].tolist() == loaded.b.encode(t)


loaded_once: dict = {}
