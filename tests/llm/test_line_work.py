"""Work that line deduplication saves: pairs of sets compared row by row, inverted lists looked at many batches at a time."""

import numpy as np
import pyarrow as pa
import pytest

from telescribe.llm import common, line_dedup


def hashes(rng, n):
    return np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))


def test_similar_pairs():
    """Pairs of all sizes, one with the largest hash, empty sets and those at exactly 80 percent."""
    rng = np.random.default_rng(6)
    s, t = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for n in (*range(1, 90), 128, 400, 511, 513, 1500):
        own = hashes(rng, n)
        s.append(own)
        t.append(np.unique(np.concatenate((own[n // 5 :], hashes(rng, int(rng.integers(0, n // 8 + 1)))))))
    top = np.array([5, 2**64 - 1], dtype=np.uint64)
    s, t = [*s, top, top, top[1:], *t], [*t, top, top[1:], top[:1], *s]
    for percent in (50, 80, 100):
        want = [common.similar(a, b, percent) for a, b in zip(s, t)]
        assert common.similar_pairs([x.tobytes() for x in s], [x.tobytes() for x in t], percent).tolist() == want
    assert common.similar_pairs([], [], 80).tolist() == []


def test_pairs_are_not_ranked(monkeypatch):
    """Comparing pairs ranks no hashes over a whole batch (before: np.unique with inverse on all of them)."""
    rng = np.random.default_rng(7)
    sets = [hashes(rng, 40).tobytes() for _ in range(20)]
    monkeypatch.setattr(common.np, "unique", lambda *a, **k: pytest.fail("ranked"))
    assert common.similar_pairs(sets, sets, 80).all()


def test_line_sets_whose_numbers_meet(monkeypatch):
    """Tokens that one number cannot tell apart are ordered by whole hashes."""
    crowd = np.array([3, 1, 2, 3, 1, 9 << 60, 9 << 60], dtype=np.uint64)

    class Found:
        def __init__(self, texts, letters):
            self.hashes, self.text = crowd, np.array([0, 0, 0, 0, 1, 1, 1])

    monkeypatch.setattr(line_dedup, "Words", Found)
    got = dict(line_dedup.line_sets([7, 8], ["a", "b"]))
    assert {k: np.frombuffer(v, np.uint64).tolist() for k, v in got.items()} == {7: [1, 2, 3], 8: [1, 9 << 60]}


def test_lists_over_batches(spark, monkeypatch):
    """Inverted lists of many batches are looked at together, with the rows that each piece gives alone, those of long lists, too."""
    rng = np.random.default_rng(2)
    texts = ["\n".join(" ".join(f"w{x}" for x in rng.integers(0, 200, 12)) for _ in range(40)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts + [texts[0].replace("w", "w w199 w198 w", 1), texts[0].replace("\n", " w199\n")])), "doc_id long, text string")
    unique = line_dedup.lines_table(docs, 80).selectExpr("at AS id", "n", "low", "high", "often", "prefix")
    rows = lambda most: sorted(tuple(r) for r in line_dedup.candidates(unique, 80, most).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [rows(most) for most in (2000, 5)]
        monkeypatch.setattr(line_dedup, "AT_ONCE", 1)
        assert got == [rows(most) for most in (2000, 5)] and got[0] and got[0] != got[1]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
