"""The rounds of line deduplication, and shuffles of scratch tables."""

import time

import numpy as np

from telescribe.llm import common, line_dedup


def test_line_candidates_in_rounds(spark):
    """The rounds of the inverted lists hold each list once, and together give what one round gives; shuffles of scratch tables go at once."""
    rng = np.random.default_rng(2)
    lines = [rng.integers(0, 300, 14) for _ in range(40)]
    texts = ["\n".join(" ".join(f"w{x}" for x in line) + f" own{k}" for line in lines) for k in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    unique = line_dedup.lines_table(docs, 80).selectExpr("at AS id", "n", "low", "high", "often", "prefix")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    whole = rows(line_dedup.candidates(unique, 80, 2000))
    parts = [rows(line_dedup.candidates(unique, 80, 2000, k, line_dedup.ROUNDS)) for k in range(line_dedup.ROUNDS)]
    assert whole and sum(map(bool, parts)) > 1 and sorted(sum(parts, [])) == whole
    left = lambda: spark._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    before = left()
    common.written(docs.repartition(7, "doc_id"), "rows")
    for _ in range(50):
        if left() <= before:
            break
        time.sleep(0.1)
    assert left() <= before
