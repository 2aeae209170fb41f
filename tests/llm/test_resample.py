"""Importance resampling against a plain version of its rules."""

import hashlib
import math
import re
import zlib

import pyarrow as pa
import pytest

from telescribe.llm import queries, resample

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest=2):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, buckets=10_000, share=25, least=20, seed=7, longest=2):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    own = [(d, *runs(x, longest)) for d, x in docs]
    for _, _, fs in own:
        for f in fs:
            s[bucket(f)] += 1
    for x in target:
        for f in runs(x, longest)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) if s[b] else 0 for b in range(buckets)]
    out, able = [], []
    for i, (d, n, fs) in enumerate(own):
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = None if d is None else int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        score = None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(fs), weight, score, None])
        if n >= least and d is not None:
            able.append(i)
    able.sort(key=lambda i: (-out[i][3], out[i][0], out[i][1]))
    for rank, i in enumerate(able[: share * len(able) // 100], 1):
        out[i][4] = rank
    return sorted(map(tuple, out), key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got(queries.op12_importance_resampling(spark, SF)) == plain(docs, target)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_odd_rows(spark, longest):
    """Nulls, empty and very long texts and words, ties, repeated rows, null ids and clashing columns."""
    long_word = "x" * 63 + " " + "y" * 64 + " " + "Z" * 65 + " " + "é" * 4000
    texts = [None, "", " .,\n", "one", "One two", "one  TWO", long_word, "a b c " * 30_000, "ß ǅ İ É1", "word " * 25, "word " * 25]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)] + [(9, "word " * 25, 0, "y"), (9, "other words here " * 9, 0, "y"), (None, "word " * 30, 0, "z"), (-5, "é è " * 20, 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int, score string")
    aim = spark.createDataFrame([(0, "word one two"), (1, None), (2, ""), (2, "a b")], "item_id long, text string")
    p = resample.Params(longest=longest, buckets=97, share=60, least_words=3)
    want = plain([r[:2] for r in rows], ["word one two", None, "", "a b"], 97, 60, 3, longest=longest)
    assert got(resample.resample(df, aim, params=p)) == want
    drawn = {r[0] for r in want if r[4]}
    chosen = resample.selected(df, aim, params=p)
    assert chosen.columns == df.columns
    assert sorted(map(tuple, chosen.collect()), key=repr) == sorted((r for r in rows if r[0] in drawn), key=repr)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 9)], "doc_id long, text string")
    assert got(resample.resample(none, some)) == []
    assert got(resample.resample(some, none)) == plain([(1, "a b c " * 9)], [])


def test_features():
    texts = ["Some words é", None, "", "x " * 70, "p" * 200 + " " + "q" * 64 + " r"]
    n_words, offsets, stream = resample.features(pa.array(texts, pa.string()), resample.Params(longest=3))
    for i, t in enumerate(texts):
        n, fs = runs(t, 3)
        assert n_words[i] == n and stream[offsets[i] : offsets[i + 1]].tolist() == [zlib.crc32(f.encode()) % 10_000 for f in fs]
