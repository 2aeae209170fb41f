"""Long inverted lists of line deduplication: lists of pairs of tokens in their place, and blocks dealt out in rounds."""

import numpy as np
import pytest

from telescribe.llm import common, line_dedup


def similar(a: str, b: str, percent: int) -> bool:
    a, b = set(a.split()), set(b.split())
    return 100 * len(a & b) >= percent * len(a | b)


def classes(texts: list[str], percent: int) -> dict[tuple[int, int], tuple[int, int]]:
    """Lines that a similar line comes before, with the first line of their component."""
    lines = [(d, k, x) for d, text in enumerate(texts) for k, x in enumerate(text.split("\n"))]
    top = list(range(len(lines)))

    def root(i: int) -> int:
        return i if top[i] == i else root(top[i])

    for i in range(len(lines)):
        for j in range(i):
            if similar(lines[i][2], lines[j][2], percent):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {lines[i][:2]: lines[root(i)][:2] for i in range(len(lines)) if root(i) != i}


def corpus(words: int) -> list[str]:
    """Lines of 1 to 40 words, some of them changed copies of others."""
    rng = np.random.default_rng(4)
    made = [" ".join(f"w{x}" for x in rng.integers(0, words, rng.integers(1, 41))) for _ in range(120)]
    for line in made[:60]:
        own = line.split()
        own[int(rng.integers(0, len(own)))] = f"w{int(rng.integers(0, words))}"
        made.append(" ".join(own))
    return ["\n".join(made[k::6]) for k in range(6)]


@pytest.mark.parametrize("percent, most", [(80, 128), (80, 10), (50, 128), (50, 10)])
def test_pairs_of_tokens_give_the_same_classes(spark, monkeypatch, percent, most):
    """All lists count as long; lines above and about MOST_PAIRED, of one token, and those that may share one only meet, too."""
    monkeypatch.setattr(line_dedup, "MOST_PAIRED", most)
    monkeypatch.setattr(line_dedup, "long_buckets", lambda *a: np.ones(line_dedup.LIST_BUCKETS, dtype=bool))
    texts = corpus(30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.line): (r.first_doc, r.first_line) for r in line_dedup.line_classes(docs, percent).collect()}
    assert got == classes(texts, percent)


def test_long_lists_are_cut_by_a_second_token(spark, monkeypatch):
    """Lines of frequent words that no other is like: few go on to be compared all with all (before: every row of a long list)."""
    rng = np.random.default_rng(9)
    texts = ["\n".join(" ".join(f"w{x}" for x in rng.choice(300, 30, replace=False)) for _ in range(200)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    listed = []
    real = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name, **k: listed.append(real(df, name, **k)) or listed[-1])
    monkeypatch.setattr(line_dedup, "discard", lambda *tables: None)
    line_dedup.line_classes(docs, 80, long_list=40)
    rows = [x for x in listed if "kind" in x.columns]
    assert sum(x.where("kind = 1").count() for x in rows) < 500


def test_blocks_are_dealt_out_in_rounds(spark, monkeypatch):
    """A list of many blocks, no two members alike but one pair: rounds give that link, each with a part of the rows (before: all at once)."""
    rng = np.random.default_rng(3)
    sets = {i: np.unique(rng.integers(0, 2**64, 12, dtype=np.uint64)) for i in range(120)}
    sets[77] = sets[5].copy()
    table = spark.createDataFrame([(i, x.tobytes()) for i, x in sets.items()], "id long, s binary")
    lists = spark.createDataFrame([(1, i, 12) for i in sets], "value int, id long, n int")
    links = spark.createDataFrame([(1, 2)], "a long, b long")
    sizes = []
    real = common.grouped
    monkeypatch.setattr(common, "grouped", lambda df, *a: sizes.append(df.count()) or real(df, *a))
    sets_of = lambda ids: table.join(ids, "id")
    whole = {tuple(r) for r in common.dense_links(lists, links, sets_of, 80, 10).collect()}
    rows = sizes[0]
    sizes.clear()
    monkeypatch.setattr(common, "MET_BYTES", 1)
    parts = {tuple(sorted(r)) for r in common.dense_links(lists, links, sets_of, 80, 10).collect()}
    assert {tuple(sorted(x)) for x in whole} == parts == {(5, 77)}
    assert len(sizes) > 4 and sum(sizes) == rows and max(sizes) < rows / 2
