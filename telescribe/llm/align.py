"""Alignment of two tokenizers' tokens over the same bytes.

Packed bitsets mark the bytes at which tokens of either tokenizer end. Their AND holds the cuts that both share, which
split a text into groups; popcounts give the rank of a byte among a bitset's ends and so the token range of each group.
Their OR holds the end of each stretch that one token of either side covers; the two tokens there are linked.

A text is taken apart where a blank follows another character: no token of either side reaches over such a place, so a
stretch of text has the same tokens, groups and links wherever it stands, and each different one is aligned once in a
while (a bounded store a process). Where the second vocabulary has a token over such a place, texts stay whole.

One pass over the texts writes what does not depend on the corpus, and each slice's links as packed numbers into the
slice's own list of id pairs. The lists are summed up over the corpus, and a second pass over the packed numbers sums the
counts by document. The count table is sent to all tasks if it is small; of a larger one only the frequent pairs are, and
the others are joined, each of few rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telescribe.llm.bpe import byte_alphabet
from telescribe.llm.common import bounded, discard, lists_array, slices, written

#: White space, then all up to a blank behind another character; the white space at the end of a text goes to its last stretch.
STRETCH = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:\s+\Z)?")
#: White space before a blank: without any, blanks alone part the stretches.
UNEVEN = re.compile(r"\s ")
#: Stretches and bytes of their results that a process holds before it forgets them.
STORED, STORED_BYTES = 100_000, 32 << 20
#: Most id pairs whose counts are sent to every task, 17 bytes each.
MOST_PAIRS = 2_000_000


class Bits:
    """A packed bitset over bytes, with the number of bits before each 64-bit word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-(size + 1) // 64) * 64, dtype=bool)
        marks[places] = True
        return cls(np.packbits(marks, bitorder="little").view(np.uint64))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Bits before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def aligned_tokens(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of token sizes in bytes, none 0 and of the same sum: the shared cuts (last bytes), for each the tokens of either
    side that end up to it, and the linked tokens of either side."""
    total = int(size_a.sum())
    a, b = (Bits.of(np.cumsum(size) - 1, total) for size in (size_a, size_b))
    cuts = Bits(a.words & b.words).select()
    ends = Bits(a.words | b.words).select()
    return cuts, a.rank(cuts + 1), b.rank(cuts + 1), a.rank(ends), b.rank(ends)


def grown(old: np.ndarray, new: np.ndarray, used: int) -> np.ndarray:
    """old with new behind its first used rows, in room that doubles."""
    if used + len(new) > len(old):
        old = np.concatenate((old[:used], np.zeros((max(len(new), used, 1024), *old.shape[1:]), old.dtype)))
    old[used : used + len(new)] = new
    return old


class Aligner:
    """Two vocabularies: byte-level BPE from a tokenizers file (A) and a sentencepiece model with byte fallback (B).

    Stretches are known by their text without the blank that each begins with.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(path_a, encoding="utf-8") as f:
            vocab: dict[str, int] = json.load(f)["model"]["vocab"]
        as_byte = {c: i for i, c in enumerate(byte_alphabet())}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            # a special token's piece need not be in the alphabet; it never comes out
            self.bytes_a[i] = bytes(as_byte[c] for c in piece) if all(c in as_byte for c in piece) else b""
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in own], dtype=np.int64) for own in (self.bytes_a, self.bytes_b))
        self.top_a, self.top_b = len(self.bytes_a), len(self.bytes_b)
        self.whole = any(re.search(r"\S ", x.decode("utf-8", "replace")) for x in self.bytes_b)
        a, b = [b"%d" % i for i in range(self.top_a)], [b"%d" % i for i in range(self.top_b)]
        self.shown = [x + b"," for x in a] + [x + b"|" for x in a] + [x + b"," for x in b] + [x + b";" for x in b]
        self.shown_size = np.array([len(x) for x in self.shown], dtype=np.int64)
        self.forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        #: By stretch: tokens of A and of B, groups and links; whether both vocabularies give it back; its groups as text.
        self.stats = np.zeros((0, 4), dtype=np.int64)
        self.good = np.zeros(0, dtype=bool)
        self.groups: list[bytes] = []
        #: All stretches' tokens and linked pairs, one after the other, and where each stretch's end.
        self.flat = {c: np.zeros(0, dtype=np.int64) for c in ("a", "b", "pairs")}
        self.ends = {c: np.zeros(0, dtype=np.int64) for c in self.flat}
        self.held = 0

    @property
    def full(self) -> bool:
        return len(self.place) >= STORED or self.held >= STORED_BYTES

    def cut(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        if text[-1].isspace() or UNEVEN.search(" " + text):
            return [s[1:] for s in STRETCH.findall(" " + text)] or [text]
        return text.split(" ")

    def places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' stretches, and where each text's begin (and past the last); null and empty ones have none."""
        cut = [self.cut(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        new = [s for s in dict.fromkeys(flat) if s not in self.place]
        if new:
            # those that end in white space cannot stand before another blank
            self._add([s for s in new if s and not s[-1].isspace()], not self.whole)
            self._add([s for s in new if not s or s[-1].isspace()], False)
        return np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat)), np.concatenate(([0], np.cumsum([len(x) for x in cut]))).astype(np.int64)

    def _encoded(self, new: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which are good, tokens of A and of B by stretch, all tokens of A and of B); those that are not good have none."""
        raw = [b" " + s.encode() for s in new]
        if joined:
            # no token reaches from one stretch into the next, so all are encoded as one text
            text = " ".join(new)
            a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
            whole = b"".join(raw)
            if b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b)):
                a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
                ends = np.cumsum([len(x) for x in raw])
                n_a, n_b = (np.diff(np.searchsorted(np.cumsum(size[ids]), ends, side="right"), prepend=0) for size, ids in ((self.size_a, a), (self.size_b, b)))
                return np.ones(len(new), dtype=bool), n_a, n_b, a, b
        lists_a = [self.a.encode(" " + s, add_special_tokens=False).ids for s in new]
        lists_b = self.b.encode(new)
        good = np.array([b"".join(map(self.bytes_a.__getitem__, x)) == s == b"".join(map(self.bytes_b.__getitem__, y)) for s, x, y in zip(raw, lists_a, lists_b)], dtype=bool)
        n_a, n_b = (np.array([len(x) if ok else 0 for x, ok in zip(lists, good)], dtype=np.int64) for lists in (lists_a, lists_b))
        a, b = (np.array([i for x, ok in zip(lists, good) if ok for i in x], dtype=np.int64) for lists in (lists_a, lists_b))
        return good, n_a, n_b, a, b

    def _add(self, new: list[str], joined: bool) -> None:
        if not new:
            return
        first = len(self.place)
        good, n_a, n_b, a, b = self._encoded(new, joined)
        _, to_a, to_b, link_a, link_b = aligned_tokens(self.size_a[a], self.size_b[b])
        # a stretch's links and groups end where its tokens do
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        key_ends = np.searchsorted(link_a, last_a)
        group_ends = np.searchsorted(to_a, last_a, side="right")
        # the groups as text: each token where the tokens of the groups before it leave off
        group_a, group_b = np.searchsorted(to_a, np.arange(len(a)), side="right"), np.searchsorted(to_b, np.arange(len(b)), side="right")
        place = np.empty(len(a) + len(b), dtype=np.int64)
        ends_a, ends_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        ends_a[to_a - 1], ends_b[to_b - 1] = True, True
        place[np.arange(len(a)) + np.concatenate(([0], to_b))[group_a]] = a + self.top_a * ends_a
        place[np.arange(len(b)) + to_a[group_b]] = b + 2 * self.top_a + self.top_b * ends_b
        text = b"".join(map(self.shown.__getitem__, place.tolist()))
        upto = np.concatenate(([0], np.cumsum(self.shown_size[place])))
        at = upto[np.concatenate(([0], last_a + last_b))].tolist()
        self.groups += [text[x:y] for x, y in zip(at[:-1], at[1:])]
        stats = np.stack((n_a, n_b, np.diff(group_ends, prepend=0), np.diff(key_ends, prepend=0)), axis=1)
        self.stats, self.good = grown(self.stats, stats, first), grown(self.good, good, first)
        for c, values, ends in (("a", a, last_a), ("b", b, last_b), ("pairs", a[link_a] * self.top_b + b[link_b], key_ends)):
            used = int(self.ends[c][first - 1]) if first else 0
            self.flat[c], self.ends[c] = grown(self.flat[c], values, used), grown(self.ends[c], ends + used, first)
            self.held += 8 * len(values)
        self.place.update(zip(new, range(first, first + len(new))))
        self.held += len(text) + 150 * len(new)

    def taken(self, c: str, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values (tokens or pairs) of stretches in that order, and how many each has."""
        ends = self.ends[c][places]
        n = ends - np.where(places > 0, self.ends[c][places - 1], 0)
        return self.flat[c][np.arange(n.sum()) + np.repeat(ends - np.cumsum(n), n)], n

    def valid(self, places: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which texts have tokens: they are not empty, and both vocabularies give all their stretches back."""
        bad = np.concatenate(([0], np.cumsum(~self.good[places])))
        return (first[1:] > first[:-1]) & (bad[first[1:]] == bad[first[:-1]])


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Aligner:
    """One pair of vocabularies a process; the files are part of the installed environment of every executor."""
    return Aligner(path_a, path_b)


def _mapped(df: DataFrame, schema: str, run) -> DataFrame:
    return bounded(df).mapInArrow(run, T._parse_datatype_string(schema))


def aligned(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a and b (token ids of a blank and the text), cuts (byte offsets where tokens of both end), and for each
    group of tokens between cuts its first token past the end on either side (ends_a, ends_b).

    Texts that are null, empty or that a vocabulary does not give back byte by byte have empty lists. Null ids stay;
    repeated rows give repeated rows; an empty table gives an empty one; other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["doc_id", "a", "b", "cuts", "ends_a", "ends_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path_a, path_b)
        for batch in batches:
            for part in slices(batch, 1):
                if own.full:
                    own.forget()
                places, first = own.places(part.column(1).to_pylist())
                out = []
                for x, y, ok in zip(first[:-1], first[1:], own.valid(places, first)):
                    a, b = (own.taken(c, places[x:y] if ok else places[:0])[0] for c in "ab")
                    cuts, to_a, to_b, _, _ = aligned_tokens(own.size_a[a], own.size_b[b])
                    out.append((a, b, cuts + 1, to_a, to_b))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([x[k] for x in out], pa.list_(pa.int64())) for k in range(5)]], names=names)

    return _mapped(df.select(id_col, text_col), f"doc_id {kind}, " + ", ".join(f"{c} array<bigint>" for c in names[1:]), run)


def packed(df: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """A row a slice of texts, written: ids, stats (four numbers a text), digests, the id pairs linked in the slice and how
    often, the place in that list of every link (16 bits, or 32 where they do not do), and where each text's links end."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["ids", "stats", "digests", "pairs", "times", "links", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path_a, path_b)
        for batch in batches:
            for part in slices(batch, 1):
                if own.full:
                    own.forget()
                places, first = own.places(part.column(1).to_pylist())
                valid = own.valid(places, first)
                text = np.repeat(np.arange(part.num_rows), np.diff(first))
                kept = valid[text]
                stats = np.stack([np.bincount(text[kept], weights=own.stats[places[kept], k], minlength=part.num_rows) for k in range(4)], axis=1).astype(np.int64)
                digests = [hashlib.sha256(b"".join(map(own.groups.__getitem__, places[x:y].tolist()))[:-1]).hexdigest() if ok else "" for x, y, ok in zip(first[:-1], first[1:], valid)]
                # pairs are looked up once for each different stretch
                used, at = np.unique(places[kept], return_inverse=True)
                keys, n = own.taken("pairs", used)
                pairs, code = np.unique(keys, return_inverse=True)
                size = n[at]
                start = np.concatenate(([0], np.cumsum(n)[:-1]))[at] if len(n) else at
                links = code[np.arange(size.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)] if len(at) else code[:0]
                times = np.bincount(links, minlength=len(pairs))
                row = [part.column(0), stats.reshape(-1), digests, pairs, times, None, np.cumsum(stats[:, 3])]
                arrays = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), row[0])]
                arrays += [lists_array(np.asarray(x), np.array([len(x)])) for x in row[1:5]]
                arrays += [pa.array([links.astype("<u2" if len(pairs) <= 1 << 16 else "<u4").tobytes()], pa.binary()), lists_array(row[6], np.array([part.num_rows]))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"ids array<{kind}>, stats array<bigint>, digests array<string>, pairs array<bigint>, times array<bigint>, links binary, ends array<bigint>"
    return written(_mapped(df.select(id_col, text_col), schema, run), "links")


def pair_counts(slices_of: DataFrame, top_b: int) -> DataFrame:
    """(pair, n, best), written: each linked id pair (A id times B's vocabulary plus B id), its links in all texts, and
    whether no other pair of its B id has more. slices_of: packed()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            pairs, at = np.unique(np.concatenate([x for x, _ in held] or [np.empty(0, np.int64)]), return_inverse=True)
            sums = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(sums, at, np.concatenate([x for _, x in held] or [np.empty(0, np.int64)]))
            held[:] = [(pairs, sums)]
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(sums)], names=["pair", "n"])

        for batch in batches:
            held.append((batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()))
            size += len(held[-1][0])
            if size > 4_000_000:
                out, size = summed(), len(held[0][0])
                if size > 2_000_000:
                    yield out
                    held, size = [], 0
        yield summed()

    counts = written(_mapped(slices_of.select("pairs", "times"), "pair bigint, n bigint", run).groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = F.pmod("pair", F.lit(top_b))
    best = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row a B id
    out = written(counts.withColumn("b", b).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")
    discard(counts)
    return out


def links(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The corpus's lexicon: a_id, b_id, n (links of the two in all texts), best (no other A id has more with that B id)."""
    top_b = load(path_a, path_b).top_b
    own = packed(df, path_a, path_b, id_col, text_col)
    pairs = pair_counts(own, top_b)
    discard(own)
    return pairs.select(F.floor(F.col("pair") / top_b).cast("bigint").alias("a_id"), F.pmod("pair", F.lit(top_b)).alias("b_id"), "n", "best")


def digests(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the best of its B id),
    count_sum (of the corpus-wide counts of its links) and groups_sha256.

    Texts that are null, empty or that a vocabulary does not give back have zeros and an empty digest, and count
    nowhere. Null ids stay; repeated rows count and come out each by itself; an empty table gives an empty one; other
    columns are not read. The result does not depend on most_pairs.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    own = packed(df, path_a, path_b, id_col, text_col)
    counts = pair_counts(own, load(path_a, path_b).top_b)
    size = counts.agg(F.count("*").alias("pairs"), F.sum("n").alias("links")).first()
    # pairs of more than links / most_pairs links are fewer than most_pairs; the others have so few rows each
    floor = 0 if size["pairs"] <= most_pairs else size["links"] // most_pairs
    table = counts.where(F.col("n") > floor).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "seldom"]
    kinds = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, stats, digest, pairs, packed_links, ends = (batch.column(k)[i] for k in range(6))
                pairs, ends = pairs.values.to_numpy(), ends.values.to_numpy()
                stats = stats.values.to_numpy().reshape(-1, 4)
                there = np.zeros(len(pairs), dtype=bool)
                values = np.zeros((len(pairs), 2), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                    there = known[at] == pairs
                    values = np.stack((best[at] & there, np.where(there, n[at], 0)), axis=1)
                links = np.frombuffer(packed_links.as_buffer(), dtype="<u2" if len(pairs) <= 1 << 16 else "<u4")
                upto = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(values[links], axis=0)))
                sums = np.diff(upto[ends], axis=0, prepend=np.zeros((1, 2), np.int64))
                seldom = [[]] * len(ends)
                if not there.all():
                    for k, (x, y) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                        rest, times = np.unique(links[x:y][~there[links[x:y]]], return_counts=True)
                        seldom[k] = [{"pair": p, "times": t} for p, t in zip(pairs[rest].tolist(), times.tolist())]
                columns = [ids.values, *[pa.array(np.ascontiguousarray(stats[:, k])) for k in range(4)], *[pa.array(np.ascontiguousarray(sums[:, k])) for k in range(2)], digest.values, pa.array(seldom, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in names[1:7]) + ", groups_sha256 string, seldom array<struct<pair:bigint,times:bigint>>"
    out = _mapped(own.select("ids", "stats", "digests", "pairs", "links", "ends"), schema, run)
    if not floor:
        return out.drop("seldom")
    out = written(out.withColumn("row", F.monotonically_increasing_id()), "aligned")
    seldom = out.select("row", F.explode("seldom").alias("x")).select("row", "x.pair", "x.times").join(counts.where(F.col("n") <= floor), "pair")
    added = seldom.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_count"))
    out = out.join(added, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_count", F.lit(0)))
    return out.select(*names[:-1])
