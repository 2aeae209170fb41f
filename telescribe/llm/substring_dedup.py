"""Substring deduplication: passages of over 50 words that repeat across documents, by banding of paragraphs.

A paragraph is a line of at least LEAST_WORDS words. It gives MinHash bands over its word shingles, tuned so that paragraphs
at the threshold collide with a chance above 0.9999; colliding paragraphs are confirmed by exact Jaccard of the shingle
sets, components of the links are the passages, and every paragraph of one but the first is removed.

A passage need not fill a line, so texts are also cut by content: of every STEP stretches of SPAN words that begin side by
side, the one of the smallest hash is a paragraph too. Two texts that share SPAN + STEP - 1 words in a row share such a
paragraph, wherever these words begin. Its words are equal or not, so that one hash of them all is its only band.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telescribe.llm.common import CODE, WORD_BYTES, Words, ahead, components, confirmed, dense_links, discard, lists_array, map_batches, map_rows, mixed, sent, single, with_small_ids, written

#: Words of a shingle, similarity in percent, words from which a line is a passage, bands and rows of a band; paragraphs
#: from which a band's list counts as long; bits of the line number.
SHINGLE, PERCENT, LEAST_WORDS, BANDS, ROWS, LONG_LIST, LINE_BITS = 5, 80, 51, 20, 4, 40, 24

#: Words of a paragraph cut by content, and in how many beginnings side by side one is sure to be: runs of 51 words are found.
SPAN, STEP = 43, 9


def behind(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate((np.zeros(min(n, len(x)), x.dtype), x[: max(0, len(x) - n)]))


def spread(x: np.ndarray, n: int, pick: np.ufunc, shift) -> np.ndarray:
    """pick (minimum or maximum) of each value and the n - 1 next to it on one side."""
    size = 1
    while 2 * size <= n:
        x, size = pick(x, shift(x, size)), 2 * size
    return pick(x, shift(x, n - size))


def stretches(words: Words, span: int = SPAN, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the stretches of span words that content chooses, and the number of the word each begins with."""
    whole, inside = words.windows(span)
    # the smallest of step beginnings; those of which the text has no span words left are no candidates
    whole = np.where(inside, np.maximum(whole, np.uint64(1)), ~np.uint64(0))
    low = np.where(ahead(words.text + 1, span + step - 2) == words.text + 1, spread(whole, step, np.minimum, ahead), np.uint64(0))
    at = np.flatnonzero((spread(low, step, np.maximum, behind) == whole) & inside)
    return whole[at], at


def runs(docs: DataFrame, span: int = SPAN, step: int = STEP) -> DataFrame:
    """(doc_id, ranges, sources, shared): what stretches shared with other documents cover.

    ranges: words [from, to, ...] in stretches that an earlier document holds too, sources: the first documents that hold
    them; shared: how many stretches any other document holds. Every run of span + step - 1 words that two documents
    share is found, a few words at its ends aside, and none of under span words. Equal 64-bit hashes count as equal.
    """

    def rows(batch):
        words = Words(batch.column(1), WORD_BYTES)
        value, at = stretches(words, span, step)
        text = words.text[at]
        return {"value": value.view(np.int64), "doc_id": batch.column(0).to_numpy()[text], "place": (at - words.first[text]).astype(np.int32)}

    def joined(cols):
        for key, places, sources, shared in zip(*cols):
            p = np.array(places, dtype=np.int64)
            cut = p[1:] > p[:-1] + span
            ranges = np.stack((p[np.append(True, cut)], p[np.append(cut, True)] + span), axis=1).reshape(-1).tolist() if len(p) else []
            yield key, ranges, sources, shared

    seen = written(map_batches(docs.select("doc_id", "text"), rows, "value bigint, doc_id bigint, place int", 1), "stretches")
    ends = seen.groupBy("value").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("value", "first")
    later = F.col("doc_id") > F.col("first")
    hits = seen.join(ends, "value").groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.when(later, F.col("place")))).alias("places"), F.array_sort(F.collect_set(F.when(later, F.col("first")))).alias("sources"), F.count("*").alias("shared")
    )
    out = written(map_rows(hits, joined, "doc_id bigint, ranges array<bigint>, sources array<bigint>, shared bigint"), "runs")
    discard(seen)
    return out


def paragraphs(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(doc_id << LINE_BITS) + line, sorted shingle hashes and words of each line of at least so many words."""
    ids = batch.column(0).to_pylist()
    lines, at = [], []
    for key, text in zip(ids, batch.column(1).to_pylist()):
        for k, line in enumerate(text.split("\n")):
            if k >> LINE_BITS:
                raise ValueError(f"a text of more than {1 << LINE_BITS} lines")
            if len(line) >= 2 * least - 1:
                lines.append(line)
                at.append((key << LINE_BITS) + k)
    words = Words(pa.array(lines, pa.string()), WORD_BYTES)
    n = np.diff(words.first)
    sets = words.shingles(SHINGLE)
    keep = np.flatnonzero(n >= least)
    return np.array(at, dtype=np.int64)[keep], [sets[i] for i in keep], n[keep]


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS values for each set, each a hash of ROWS minima of different hash functions."""
    if not sets:
        return np.empty((0, BANDS), np.uint64)
    whole = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        value = np.full(len(sets), b, dtype=np.uint64)
        for r in range(ROWS):
            value = mixed(value + np.minimum.reduceat((whole ^ CODE[b * ROWS + r]) * (CODE[255 - b * ROWS - r] | np.uint64(1)), starts))
        out[:, b] = value
    return out


def passages(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, line, n_words, first_doc, first_line) of lines in a component of more than one; docs: (doc_id, text)."""
    return with_small_ids(docs, lambda small: _passages(small, least), ("doc_id", "first_doc"))


def _passages(docs: DataFrame, least: int) -> DataFrame:
    def rows(batch):
        at, sets, n = paragraphs(batch, least)
        return {
            "at": at,
            "words": n,
            "n": np.array([len(s) for s in sets], dtype=np.int64),
            "digest": pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
            "bands": lists_array(bands_of(sets).reshape(-1).view(np.int64), np.full(len(sets), BANDS)),
        }

    seen = written(map_batches(docs, rows, "at bigint, words bigint, n bigint, digest binary, bands array<bigint>", 1), "paragraphs")
    reps = written(seen.groupBy("digest").agg(F.min("at").alias("id"), F.count("*").alias("copies")), "reps")
    unique = written(seen.join(reps.select(F.col("id").alias("at")), "at", "left_semi").select(F.col("at").alias("id"), "n", F.explode(F.array_distinct("bands")).alias("value")), "bands")
    sizes = unique.groupBy("value").agg(F.count("*").alias("size"), F.min("id").alias("head")).where("size > 1")
    lists = written(unique.join(sizes, "value"), "lists")
    discard(unique)
    short = lists.where(F.col("size") <= LONG_LIST)
    pairs = short.alias("x").join(short.alias("y"), "value").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    stars = lists.where((F.col("size") > LONG_LIST) & (F.col("head") < F.col("id"))).select(F.col("head").alias("a"), F.col("id").alias("b"))
    hopes = written(pairs.unionByName(stars).distinct(), "hopes")

    def sets_of(ids: DataFrame) -> DataFrame:
        need = ids.groupBy(F.shiftright("id", LINE_BITS).alias("doc_id")).agg(F.collect_list(F.col("id").bitwiseAND(F.lit((1 << LINE_BITS) - 1))).alias("lines"))

        def sets(cols):
            for key, text, wanted in zip(*cols):
                lines = text.split("\n")
                for k, s in zip(wanted, Words(pa.array([lines[k] for k in wanted]), WORD_BYTES).shingles(SHINGLE)):
                    yield (key << LINE_BITS) + k, s.tobytes()

        return map_rows(docs.join(sent(need), "doc_id").select("doc_id", "text", "lines"), sets, "id bigint, s binary", chunk=64)

    links = confirmed(hopes, sets_of, PERCENT)
    discard(hopes)
    long = lists.where(F.col("size") > LONG_LIST).select("value", "id", "n")
    if long.limit(1).count():
        links = links.unionByName(dense_links(long, links, sets_of, PERCENT))
    comp = components(links)
    first = written(reps.join(comp, reps.id == comp.node, "left").where("copies > 1 or component is not null").select("digest", F.coalesce("component", "id").alias("first")), "first")
    discard(lists, reps, comp)
    line = lambda c: F.col(c).bitwiseAND(F.lit((1 << LINE_BITS) - 1))
    out = written(seen.select("at", "words", "digest").join(first, "digest").select(
        F.shiftright("at", LINE_BITS).alias("doc_id"), line("at").alias("line"), F.col("words").alias("n_words"), F.shiftright("first", LINE_BITS).alias("first_doc"), line("first").alias("first_line")
    ), "passages")
    discard(seen, first)
    return out


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, span: int = SPAN, step: int = STEP) -> DataFrame:
    """One row a document: doc_id, class_id, repeated, n_links, n_removed, n_removed_words, removed, first_docs, removed_ranges.

    n_links counts the document's lines that belong to a repeated passage, removed lists those of them that are not the
    passage's first, n_removed_words counts their words. removed_ranges holds the document's words [from, to, ...] that
    stand in stretches of an earlier document, in removed lines or others; see runs(). repeated: a line or stretch of
    the document, be it the first, stands in another line or document too. first_docs are the documents where removed
    lines and ranges stand first. class_id is the smallest doc_id that holds the first of one of its passages, itself
    included. Passages of fewer words than least are none, and a passage with changed words inside a line is found only
    as far as its equal runs reach. Null and empty texts have no passage; rows with a null id are left out; rows that
    repeat an id count as one, with the smallest text; an empty table gives an empty one. Other columns are not read.
    """
    docs = single(df, id_col, text_col)
    texts = docs.where("text is not null")
    inside = runs(texts, span, step)
    later = (F.col("doc_id") != F.col("first_doc")) | (F.col("line") != F.col("first_line"))
    found = passages(texts, least).groupBy("doc_id").agg(
        F.min("first_doc").alias("first"),
        F.count("*").alias("n_links"),
        F.sum(F.when(later, F.col("n_words"))).alias("n_removed_words"),
        F.array_sort(F.collect_list(F.when(later, F.col("line")))).alias("removed"),
        F.array_sort(F.collect_set(F.when(later, F.col("first_doc")))).alias("first_docs"),
    )
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")
    return docs.select("doc_id").join(found, "doc_id", "left").join(inside, "doc_id", "left").select(
        "doc_id",
        F.least("doc_id", "first", F.array_min("sources")).alias("class_id"),
        (F.coalesce("n_links", zero) + F.coalesce("shared", zero) > 0).alias("repeated"),
        F.coalesce("n_links", zero).alias("n_links"),
        F.size(F.coalesce("removed", none)).cast("bigint").alias("n_removed"),
        F.coalesce("n_removed_words", zero).alias("n_removed_words"),
        F.coalesce("removed", none).alias("removed"),
        F.array_sort(F.array_union(F.coalesce("first_docs", none), F.coalesce("sources", none))).alias("first_docs"),
        F.coalesce("ranges", none).alias("removed_ranges"),
    )
