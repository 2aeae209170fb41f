"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams, scanned over every text.

The set is sorted arrays of hashes, built from slices of the benchmark whose size is checked before they are sent. Hits are
verified word by word. A benchmark of several slices is scanned slice after slice, each sent only for its own pass; an item
larger than a slice is cut in pieces that share all but one word of a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telescribe.llm.common import WORD, WORD_BYTES, Words, bounded, discard, filtered, lower_ascii, map_rows, slices as text_slices, written

#: Words in a window, and the most benchmark text (bytes) that one broadcast slice holds; its arrays take a few times that.
WINDOW, SLICE_BYTES = 10, 8 << 20
#: Windows whose items are kept once a hit has asked for them.
KEPT_KEYS = 100_000
#: A-Z to a-z, other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Windows:
    """The windows of one slice by length: sorted hashes, the first word of each, and the item it belongs to."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.items = [item for item, _ in items]
        words = Words(pa.array([text for _, text in items] or [""], pa.string()), WORD_BYTES)
        self.data, self.start, self.end = words.data.tobytes().translate(LOWER), words.start, words.end
        self.owners: dict[tuple[int, bytes], list[str]] = {}
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        count = np.diff(words.first)
        for n in np.unique(np.minimum(count, window)).tolist():
            if n:
                whole, inside = words.windows(n)
                own = count >= window if n == window else count == n
                at = np.flatnonzero(inside & own[words.text])
                at = at[np.lexsort((at, words.text[at], whole[at]))]
                at = at[self._first(whole[at], words.text[at], at, n)]
                self.by_size[n] = (whole[at], at, words.text[at])

    def _first(self, whole: np.ndarray, item: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Which windows are the first of their words in their item; those of one hash are compared word by word."""
        keep = np.ones(len(at), dtype=bool)
        again = np.flatnonzero((whole[1:] == whole[:-1]) & (item[1:] == item[:-1])) + 1
        seen: set[bytes] = set()
        last = -2
        for i in again.tolist():
            if i != last + 1:
                seen = {self.key(int(at[i - 1]), n)}
            key, last = self.key(int(at[i]), n), i
            keep[i] = key not in seen
            seen.add(key)
        return keep

    def key(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[a:b] for a, b in zip(self.start[at : at + n].tolist(), self.end[at : at + n].tolist()))

    def items_of(self, low: int, n: int, key: bytes) -> list[str]:
        """The items that hold a window, whose hash stands from a place on."""
        out = self.owners.get((n, key))
        if out is None:
            if len(self.owners) >= KEPT_KEYS:
                self.owners.clear()
            known, at, item = self.by_size[n]
            high = int(np.searchsorted(known, known[low], side="right"))
            out = self.owners[n, key] = sorted({self.items[item[i]] for i in range(low, high) if self.key(int(at[i]), n) == key})
        return out

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
        """For each text its words, the word ranges hit (start, end, ...; ends excluded, ranges apart), and the items that occur."""
        words = Words(texts, WORD_BYTES)
        data = b""
        hit, found = np.zeros(len(words.hashes) + 1, dtype=np.int64), {}
        for n, (known, at, item) in self.by_size.items():
            whole, inside = words.windows(n)
            low = np.minimum(np.searchsorted(known, whole), len(known) - 1)
            told: set[tuple[int, bytes]] = set()
            for p in np.flatnonzero(inside & (known[low] == whole)).tolist():
                data = data or words.data.tobytes().translate(LOWER)
                key = b" ".join(data[a:b] for a, b in zip(words.start[p : p + n].tolist(), words.end[p : p + n].tolist()))
                owners, text = self.items_of(int(low[p]), n, key), int(words.text[p])
                if owners:
                    hit[p] += 1
                    hit[p + n] -= 1
                    # a window that a text repeats tells of its items once
                    if (text, key) not in told:
                        told.add((text, key))
                        found.setdefault(text, set()).update(owners)
        covered = np.cumsum(hit[:-1]) > 0
        ranges, items = [[]] * len(texts), [[]] * len(texts)
        for text, owners in found.items():
            own = np.concatenate(([0], covered[words.first[text] : words.first[text + 1]].astype(np.int8), [0]))
            ranges[text], items[text] = np.flatnonzero(np.diff(own)).tolist(), sorted(owners)
        return np.diff(words.first), ranges, items


def pieces(text: str, most_bytes: int, window: int) -> Iterator[str]:
    """A text in pieces of about most_bytes that together hold all its windows, each of window words at least."""
    spots = [m.span() for m in WORD.finditer(lower_ascii(text))]
    if len(spots) <= window:
        # few words, so all between them may go
        yield " ".join(text[a:b] for a, b in spots)
        return
    begin = 0
    while begin + window <= len(spots):
        end, size = begin, 0
        while end < len(spots) and (size < most_bytes or end < begin + window):
            size += 1 + len(text[spots[end][0] : spots[end][1]].encode())
            end += 1
        yield " ".join(text[a:b] for a, b in spots[begin:end])
        if end == len(spots):
            return
        begin = end - window + 1


def slices(benchmark: DataFrame, item_col: str, text_col: str, slice_bytes: int = SLICE_BYTES, window: int = WINDOW) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's rows in slices of about slice_bytes; rows without an id or a text take no part."""
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")
    ).distinct()
    large = F.octet_length("text") > slice_bytes
    if rows.where(large).limit(1).count():
        cut = map_rows(rows.where(large), lambda cols: ((item, part) for item, text in zip(*cols) for part in pieces(text, slice_bytes, window)), "item string, text string", chunk=1)
        rows = written(rows.where(~large).unionByName(cut), "pieces")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // slice_bytes) or 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.collect()]


def _scanned(df: DataFrame, at: int, windows: Windows) -> DataFrame:
    """df with n_words, hit_ranges and hit_items behind its columns; at: the number of the text's."""
    shared = df.sparkSession.sparkContext.broadcast(windows)
    added = T._parse_datatype_string("n_words bigint, hit_ranges array<bigint>, hit_items array<string>")
    schema = T.StructType([*df.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, at):
                n, ranges, items = shared.value.scan(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64()), pa.array(ranges, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=schema.fieldNames())

    out = bounded(df).mapInArrow(run, schema)
    out._shared = shared
    return out


def scan(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_col: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Adds to every row n_words, hit_ranges (of word numbers, flat, ends excluded) and hit_items (sorted strings).

    Null and empty texts have no words and no hits; an empty benchmark hits nothing; repeated rows get equal results;
    repeated item ids count as one item. Columns of df that are called like the added ones are replaced.
    """
    names = [c for c in df.columns if c not in ("n_words", "hit_ranges", "hit_items")]
    df = df.select(*[F.col(f"`{c}`") for c in names])
    parts = slices(benchmark, item_col, bench_col, slice_bytes, window)
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return _scanned(df, names.index(text_col), Windows(first, window))
    # several passes: only rows with hits are written by each, under numbers that one written table gives the rows
    rows = written(df.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("own")), "numbered")
    hits, n_words = None, None
    for items in (first, second, *parts):
        out = _scanned(rows.select("row", F.col(f"own.`{text_col}`").alias("text")), 1, Windows(items, window))
        n_words = n_words or written(out.select("row", "n_words"), "n_words")
        now = written(out.where(F.size("hit_items") > 0).select("row", "hit_ranges", "hit_items"), "hits")
        out._shared.destroy()
        hits = now if hits is None else hits.unionByName(now)
    span = lambda r: F.transform(F.sequence(F.lit(0), (F.size(r) / 2).cast("int") - 1), lambda i: F.struct(F.element_at(r, (2 * i + 1).cast("int")).alias("a"), F.element_at(r, (2 * i + 2).cast("int")).alias("b")))
    every = hits.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list(span(F.col("hit_ranges"))))).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("i"))
    # ranges in order of their starts: one that touches the last is taken into it
    join = lambda out, x: F.when((F.size(out) > 0) & (x["a"] <= F.element_at(out, -1)), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.greatest(F.element_at(out, -1), x["b"])))).otherwise(F.concat(out, F.array(x["a"], x["b"])))
    none = F.array().cast("array<bigint>")
    every = every.select("row", F.aggregate("r", none, join).alias("r"), "i")
    return rows.join(n_words, "row").join(every, "row", "left").select("own.*", "n_words", F.coalesce("r", none).alias("hit_ranges"), F.coalesce("i", F.array().cast("array<string>")).alias("hit_items"))


def remove_spans(text: str, ranges: list[int]) -> str:
    """The text without the characters of the given word ranges."""
    spots = [m.span() for m in WORD.finditer(lower_ascii(text))]
    out, at = [], 0
    for start, end in zip(ranges[::2], ranges[1::2]):
        out.append(text[at : spots[start][0]])
        at = spots[end - 1][1]
    return "".join([*out, text[at:]])


def clean_documents(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_col: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of df in which no window of the benchmark occurs; all columns as they were, whatever their names."""
    parts = slices(benchmark, item_col, bench_col, slice_bytes, window)
    items = next(parts)
    if (second := next(parts, None)) is None:
        shared = df.sparkSession.sparkContext.broadcast(Windows(items, window))
        return filtered(df, text_col, lambda texts: [not x for x in shared.value.scan(texts)[2]])
    before = None
    for items in (items, second, *parts):
        shared = df.sparkSession.sparkContext.broadcast(Windows(items, window))
        df = written(filtered(df, text_col, lambda texts, shared=shared: [not x for x in shared.value.scan(texts)[2]]), "clean")
        shared.destroy()
        if before is not None:
            discard(before)
        before = df
    return df
