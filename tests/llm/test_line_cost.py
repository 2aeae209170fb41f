"""What line deduplication does in fewer passes: words hashed eight bytes at a time, sets of many lines at once, numbers of lines from the tokens' pass."""

import random

import numpy as np
import pyarrow as pa

from telescribe.llm import common, line_dedup


def test_word_hashes():
    """Equal words have one hash whatever lies beside them and whatever their case; others differ, at all lengths."""
    rng = random.Random(3)
    words = {"".join(rng.choices("abzAB09é漢", k=k)) for k in (*range(1, 40), 255, 256, 257, 300) for _ in range(20)}
    words |= {"x" * k for k in range(1, 600)} | {"x" * k + "y" for k in range(600)}
    seen = {}
    for _ in range(3):
        order = rng.sample(sorted(words), len(words))
        got = common.Words(pa.array([rng.choice(" .\n") + rng.choice(" -\t").join(order)]), common.WORD_BYTES).hashes.tolist()
        assert len(got) == len(order)
        for word, h in zip(order, got):
            assert seen.setdefault(common.lower_ascii(word), h) == h
    assert len(set(seen.values())) == len(seen)


def test_line_sets():
    lines = ["b a b", "", "...", "A", "x y z " * 100_000, "z"]
    got = dict(line_dedup.line_sets(list(range(6)), lines))
    whole = [common.Words(pa.array([line]), common.WORD_BYTES).hashes for line in lines]
    assert got == {k: np.unique(h).tobytes() for k, h in enumerate(whole)}


def test_long_lines_and_numbers_of_lines(spark):
    """Prefixes of more tokens than a key's bits for the place; texts without words, empty and null ones have their lines counted, too."""
    words = [f"w{k}" for k in range(1500)]
    near, far = words[:1200] + [f"v{k}" for k in range(130)], words[:1100] + [f"u{k}" for k in range(400)]
    texts = ["first\n" + " ".join(words), " ".join(near) + "\n\n", "\n..\n", "", None, " ".join(far)]
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.later_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert 1200 / 1630 < 0.8 and got == {0: (2, []), 1: (3, []), 2: (3, []), 3: (1, []), 4: (0, []), 5: (1, [])}
    near = words[:1350] + [f"v{k}" for k in range(150)]
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.later_lines(spark.createDataFrame([(0, texts[0]), (1, "\n" + " ".join(near[::-1]))], "doc_id long, text string")).collect()}
    assert 1350 / 1650 > 0.8 and got == {0: (2, []), 1: (2, [1])}


def test_components_joined(spark, monkeypatch):
    """More links join components as if all links were taken at once, by either way."""
    rng = random.Random(4)
    links = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(25)], "a long, b long")
    more = spark.createDataFrame([(rng.randrange(90), rng.randrange(90)) for _ in range(12)], "a long, b long").where("a <> b")
    want = {r.node: r.component for r in common.components(links.unionByName(more)).collect()}
    for most in (common.MOST_SENT, 2):
        monkeypatch.setattr(common, "MOST_SENT", most)
        got = [tuple(r) for r in common.joined(common.components(links), links, more).collect()]
        assert len(got) == len(want) and dict(got) == want
    none = common.joined(common.components(links), links, links.limit(0)).collect()
    assert {tuple(r) for r in none} == {tuple(r) for r in common.components(links).collect()}
