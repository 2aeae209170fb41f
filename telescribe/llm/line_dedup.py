"""Line deduplication by an exact set-similarity join over line tokens.

1. One pass counts tokens over the whole corpus in rows of hash buckets; the least of a token's counts, in a table whose
   size does not grow with the data, gives one global order of tokens, rare ones first.
2. A second pass turns every line into its distinct tokens in that order, a digest of the set, and the prefix that any
   line similar enough must share a token of.
3. Lines of one digest are one class; the classes' prefixes form inverted lists, filtered by length and position.
   Where a token's list is long, lines similar enough that meet at it first must share a second token of a prefix one
   longer, so such lists are made of pairs of tokens.
4. Candidate pairs are confirmed on the full token sets, and components of the links are cleared of all but the first line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telescribe.llm.common import WORD_BYTES, Words, bounded, components, confirmed, dense_links, discard, hub_join, joined, lists_array, map_batches, map_rows, mixed, sent, single, slices, with_small_ids, written

#: Rows of buckets in which tokens are counted, bits of a bucket's number, and parts that a table of counts is cut in.
ROWS, BUCKET_BITS, SEGMENTS = 3, 17, 48
#: Lists with more lines count as long; bits of a line's number.
LONG_LIST, LINE_BITS = 2000, 24
#: The largest size of a line that the inverted lists tell apart.
MOST_SIZE = (1 << 20) - 1
#: Rows of inverted lists that are looked at together.
AT_ONCE = 50_000
#: Words of a bucket from which its tokens are dealt out, and the parts they go to.
OFTEN, PARTS = 1_000_000, 31
#: Rounds that the inverted lists are made in, each of its own tokens; the shuffle of one round is on disk at a time. Lists
#: of pairs of tokens take twice as many.
ROUNDS = 4
#: Buckets in which rows of the inverted lists are counted, the share above the mean that makes a bucket's lists long, and
#: the most tokens of lines that long lists are made of pairs for.
LIST_BUCKETS, ABOVE_MEAN, MOST_PAIRED = 3 << 18, 4, 128
SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def line_words(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of texts, the line of each (numbered over all texts), and the first line of each text and past the last."""
    words = Words(texts, WORD_BYTES)
    feeds = np.flatnonzero(words.data == 10)
    first = np.arange(len(texts) + 1) + np.searchsorted(feeds, words.offsets)
    before = np.searchsorted(words.start, feeds)
    line = np.repeat(np.arange(len(feeds) + 1), np.diff(before, prepend=0, append=len(words.start)))
    return words, line + words.text, first


def buckets_of(hashes: np.ndarray, apart: bool = False) -> list[np.ndarray]:
    """The place of each hash in each row of buckets, in one table of all rows; apart: in the row's own."""
    return [((hashes >> np.uint64(BUCKET_BITS * r)) & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64) + (0 if apart else r << BUCKET_BITS) for r in range(ROWS)]


def code_of(counts: np.ndarray) -> np.ndarray:
    """Counts to 16 bits in the same order, one part in a hundred apart."""
    return (counts.astype(np.float32).view(np.uint32) >> np.uint32(16)).astype(np.uint16)


def summed(df: DataFrame, count: Callable[[pa.RecordBatch], list[np.ndarray]], rows: int, size: int) -> np.ndarray:
    """The sum of what count gives for batches of df, rows arrays of places below size: a small table a task, cut in segments that are added up apart."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((rows, size), dtype=np.int64)
        for batch in batches:
            # the table is long, so it is gone over once a batch
            for row, found in zip(counts, count(batch)):
                row += np.bincount(found, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array([x.tobytes() for x in np.split(counts.reshape(-1), SEGMENTS)], pa.binary())], names=["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now = np.frombuffer(counts, dtype=np.int64)
                sums[segment] = sums[segment] + now if segment in sums else now
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["segment", "counts"])

    schema = "segment int, counts binary"
    found = bounded(df).mapInArrow(each, schema).repartition("segment").mapInArrow(add, schema).collect()
    counts = np.zeros((SEGMENTS, rows * size // SEGMENTS), dtype=np.int64)
    for r in found:
        counts[r.segment] = np.frombuffer(r.counts, dtype=np.int64)
    return counts.reshape(-1)


def bucket_counts(df: DataFrame, text_col: str) -> np.ndarray:
    """How many words of the corpus fall in each bucket."""

    def count(batch: pa.RecordBatch) -> list[np.ndarray]:
        hashes = [Words(part.column(0), WORD_BYTES).hashes for part in slices(batch, 0)]
        return buckets_of(np.concatenate([np.empty(0, np.uint64), *hashes]), apart=True)

    return summed(df.select(text_col), count, ROWS, 1 << BUCKET_BITS)


def list_bucket(values: np.ndarray) -> np.ndarray:
    return values.view(np.uint32) % np.uint32(LIST_BUCKETS)


def long_buckets(unique: DataFrame, percent: int, long_list: int) -> np.ndarray:
    """Which buckets of prefix tokens hold long lists: more than long_list rows, and well above the mean of all buckets.

    Lists give the same pairs whichever way they are made, so it is no loss if a bucket's lists are long only together.
    """

    def count(batch: pa.RecordBatch) -> list[np.ndarray]:
        n, prefix = batch.columns
        size = prefix.value_lengths().to_numpy()
        # the last token is one more than the prefix that lists are made of, unless that is the whole line
        own = np.ones(int(size.sum()), dtype=bool)
        own[(np.cumsum(size) - 1)[size > prefix_size(n.cast(pa.int64()).to_numpy(), percent)]] = False
        return [list_bucket(prefix.flatten().to_numpy()[own]).astype(np.int64)]

    counts = summed(unique.select("n", "prefix"), count, 1, LIST_BUCKETS)
    return counts > max(long_list, ABOVE_MEAN * counts.mean())


def ordered_sets(tokens: np.ndarray, lines: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each line, those of small codes first, and the start of each line that has any.

    Equal codes are ordered by the tokens' hashes. One number of line, code and part of the hash sorts most batches; where
    it cannot tell two tokens or number all lines, whole hashes do.
    """
    if not len(tokens):
        return tokens, np.empty(0, np.int64)
    order = None
    if lines[-1] < 1 << 20:
        key = (lines.astype(np.uint64) << np.uint64(44)) | (code.astype(np.uint64) << np.uint64(28)) | (tokens >> np.uint64(36))
        order = np.argsort(key)
        key, found = key[order], tokens[order]
        if ((key[1:] == key[:-1]) & (found[1:] != found[:-1])).any():
            order = None
    if order is None:
        order = np.lexsort((tokens, code, lines))
    tokens, lines = tokens[order], lines[order]
    first = np.ones(len(tokens), dtype=bool)
    first[1:] = lines[1:] != lines[:-1]
    new = first.copy()
    new[1:] |= tokens[1:] != tokens[:-1]
    return tokens[new], np.flatnonzero(first[new])


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of n that a set at least so similar must share one of."""
    return n - -(-n * percent // 100) + 1


def signature(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits a line, one set by each token: bits that differ are tokens that differ, so they bound the similarity."""
    h = mixed(tokens ^ np.uint64(0x2545F4914F6CDD1D))
    bit = np.uint64(1) << (h & np.uint64(63))
    low = (h & np.uint64(64)) == 0
    zero = np.uint64(0)
    return np.bitwise_or.reduceat(np.where(low, bit, zero), starts), np.bitwise_or.reduceat(np.where(low, zero, bit), starts)


def lines_table(docs: DataFrame, percent: int) -> DataFrame:
    """(at, n, one, two, low, high, often, prefix) of every line with tokens; often: place of the first token the corpus holds often.

    A prefix holds one token more than prefix_size() says, where the line has one.
    Each text has a row of n = 0 besides, at its first line, with its number of lines as "one" and no prefix.
    """
    codes = docs.sparkSession.sparkContext.broadcast(code_of(bucket_counts(docs, "text")))
    often_from = code_of(np.array([OFTEN]))[0]

    def code(tokens):
        return np.minimum.reduce([codes.value[found] for found in buckets_of(tokens)])

    def rows(batch):
        words, lines, first = line_words(batch.column(1))
        tokens, starts = ordered_sets(words.hashes, lines, code(words.hashes))
        there = lines[np.flatnonzero(np.diff(lines, prepend=-1))]
        text = np.searchsorted(first, there, side="right") - 1
        if len(first) > 1 and np.diff(first).max() > 1 << LINE_BITS:
            raise ValueError(f"a text of more than {1 << LINE_BITS} lines")
        ids = batch.column(0).to_numpy() << LINE_BITS
        at = ids[text] + there - first[text]
        n = np.diff(np.append(starts, len(tokens)))
        k = np.minimum(prefix_size(n, percent) + 1, n)
        empty = np.empty(0, np.uint64)
        one, two = (np.add.reduceat(mixed(tokens ^ np.uint64(x)), starts) if len(starts) else empty for x in SEEDS)
        low, high = signature(tokens, starts) if len(starts) else (empty, empty)
        ahead = np.arange(len(tokens)) - np.repeat(starts, n) < np.repeat(k, n)
        short = tokens[ahead].astype(np.uint32).view(np.int32)
        seldom = code(tokens[ahead]) < often_from
        often = np.add.reduceat(seldom.astype(np.int32), np.concatenate(([0], np.cumsum(k)[:-1]))) if len(k) else k.astype(np.int32)
        none = np.zeros(len(ids), np.int64)
        marks = {c: np.concatenate((x.view(np.int64), np.diff(first) if c == "one" else none)) for c, x in (("one", one), ("two", two), ("low", low), ("high", high))}
        at, n, k, often = (np.concatenate((x, y)) for x, y in ((at, ids), (n, none), (k, none), (often, none)))
        return {"at": at, "n": n, "often": often, "prefix": lists_array(short, k)} | marks

    return written(map_batches(docs.select("doc_id", "text"), rows, "at bigint, n int, one bigint, two bigint, low bigint, high bigint, often int, prefix array<int>", 1), "lines", varied=True)


def pair_rows(place: np.ndarray, line: np.ndarray, values: np.ndarray, size: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the lists of pairs of tokens: the place in values of the first token, and a number of the pair.

    size: values of each line; hot: values whose lists are made of pairs, with each later value of the line.
    """
    first = np.flatnonzero(hot)
    later = size[line[first]] - 1 - place[first]
    at = np.repeat(first, later)
    second = at + 1 + np.arange(len(at)) - np.repeat(np.cumsum(later) - later, later)
    both = (values[at].view(np.uint32).astype(np.uint64) << np.uint64(32)) | values[second].view(np.uint32)
    return at, (mixed(both) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def list_rows(unique: DataFrame, percent: int, turn: int, rounds: int, long: Broadcast) -> DataFrame:
    """(list, id, low, high): rows of the inverted lists where some are made of pairs of tokens; list: see candidates().

    Sets with two tokens in common or more, the first of them in a long list, meet in the list of their first two. Sets
    of one token, those of more than MOST_PAIRED and what may be similar to those stay in the lists of single tokens.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # rows of pairs are many times those of lines
            for at in range(0, batch.num_rows, 2048):
                ids, n, low, high, often, prefix = batch.slice(at, 2048).columns
                values, size = prefix.flatten().to_numpy(), prefix.value_lengths().to_numpy()
                ids, n, low, high, often = (x.to_numpy() for x in (ids, n.cast(pa.int64()), low, high, often))
                k = prefix_size(n, percent)
                line = np.repeat(np.arange(len(n)), size)
                place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
                own = place < k[line]
                hot = own & long.value[list_bucket(values)]
                # what a line's least partner would share is n - k + 1
                alone = np.flatnonzero(own & (~hot | ((n == k) | (n * 100 > MOST_PAIRED * percent))[line]))
                paired, both = pair_rows(place, line, values, size, hot & (n <= MOST_PAIRED)[line])
                at, value = np.concatenate((alone, paired)), np.concatenate((values[alone], both))
                mine = value % rounds == turn
                at, value = at[mine], value[mine].astype(np.int64)
                x, place = line[at], place[at]
                part = np.where(place >= often[x], mixed(ids[x].view(np.uint64)) % np.uint64(PARTS) + np.uint64(1), np.uint64(0)).astype(np.int64)
                key = (value << 32) + (part << 27) + (np.minimum(n[x], MOST_SIZE) << 7) + np.minimum(place, 127)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[x]), pa.array(low[x]), pa.array(high[x])], names=["list", "id", "low", "high"])

    return bounded(unique).select("id", "n", "low", "high", "often", "prefix").mapInArrow(rows, "list bigint, id bigint, low bigint, high bigint")


def candidates(unique: DataFrame, percent: int, long_list: int, turn: int = 0, rounds: int = 1, long: Broadcast | None = None) -> DataFrame:
    """(kind, a, b, n) from the inverted lists of prefix tokens, in one shuffle; those of every rounds-th token, from turn on.

    kind 0: a and b are a pair that the length, positional and bitmap filters let pass. A list whose passing pairs
    outnumber its lines (copies of one line, or more lines than a task holds at once) gives pairs with one line only, the
    one that passes with most others, and a row of kind 1 for each member: a the token, b the line, n its size. Tokens
    that the corpus holds very often are dealt out over many tasks, each part a list of its own, and always give rows of
    kind 1. long: long_buckets(), whose lists are made of pairs of tokens; see list_rows().
    """
    # one number holds the token, its part, the size and the place, so that rows sort by it alone; a size or place beyond
    # its bits is held as the largest, which lets more pairs pass. Bytes of rows are what the shuffle costs
    if long is not None:
        lists = list_rows(unique, percent, turn, rounds, long)
    else:
        lists = unique.select("id", "n", "low", "high", "often", F.posexplode("prefix").alias("place", "value")).where(F.col("place") <= F.col("n") - F.expr(f"(n * {percent} + 99) div 100"))
        lists = lists if rounds == 1 else lists.where(F.pmod("value", F.lit(rounds)) == turn)
        part = F.when(F.col("place") >= F.col("often"), F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int") + 1).otherwise(F.lit(0))
        key = F.shiftleft(F.col("value").cast("bigint"), 32) + F.shiftleft(part.cast("bigint"), 27) + F.shiftleft(F.least("n", F.lit(MOST_SIZE)).cast("bigint"), 7) + F.least("place", F.lit(127))
        lists = lists.select(key.alias("list"), "id", "low", "high")
    lists = bounded(lists).repartition(F.shiftright("list", 27)).sortWithinPartitions("list")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], int | None]]:
        """Rows of whole lists, or of a list grown too long, and the list let go last."""
        held: list[np.ndarray] = []
        cut = None
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            if held:
                now = [np.concatenate((x, y)) for x, y in zip(held, now)]
            key = now[0] >> 27
            last = len(key) - int(np.argmax(key[::-1] != key[-1])) if len(key) and (key != key[-1]).any() else 0
            # a list that has grown too long is let go in pieces; those after the first are long however few their lines
            last = len(key) if len(key) - last > long_list else last
            held = [x[last:] for x in now]
            if last:
                yield [x[:last] for x in now], cut
                cut = key[-1] if last == len(key) else cut
        if held and len(held[0]):
            yield held, cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[list[np.ndarray]] = []
        begun, rows = None, 0
        for cols, cut in pieces(batches):
            # pieces of one list stay apart, each with a head of its own
            if some and (rows >= AT_ONCE or cut is not None and cols[0][0] >> 27 == cut):
                yield from emit([np.concatenate(x) for x in zip(*some)], begun)
                some, rows = [], 0
            begun = begun if some else cut
            some.append(cols)
            rows += len(cols[0])
        if some:
            yield from emit([np.concatenate(x) for x in zip(*some)], begun)

    def emit(cols: list[np.ndarray], cut: int | None) -> Iterator[pa.RecordBatch]:
        key, ids, low, high = cols
        # 32 bits hold sizes times percents
        n, place = ((key >> 7) & MOST_SIZE).astype(np.int32), (key & 127).astype(np.int32)
        key, value, part = key >> 27, key >> 32, (key >> 27) & 31
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begin, len(key)))
        group = np.repeat(np.arange(len(begin)), size)
        end = np.repeat(begin + size, size)
        big = (size > long_list) | (np.zeros(len(begin), dtype=bool) if cut is None else key[begin] == cut)
        low, high = low.view(np.uint64), high.view(np.uint64)

        def passing(at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Pairs of rows, the first's size no larger, that may be similar."""
            fits = n[at] * 100 >= n[to] * percent
            at, to = at[fits], to[fits]
            good = np.minimum(n[at] - place[at], n[to] - place[to]) * (100 + percent) >= (n[at] + n[to]) * percent
            at, to = at[good], to[good]
            differ = np.bitwise_count(low[at] ^ low[to]).astype(np.int32) + np.bitwise_count(high[at] ^ high[to])
            good = differ * (100 + percent) <= (n[at] + n[to]) * (100 - percent)
            return at[good], to[good]

        found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        at = np.flatnonzero(~np.repeat(big, size))
        step, pairs = 0, np.zeros(len(begin), dtype=np.int64)
        while len(at):
            step += 1
            at = at[at + step < end[at]]
            # rows of a list are in order of size (but for sizes that the key cannot tell), so that no later one fits either
            at = at[(n[at] * 100 >= n[at + step] * percent) | (n[at + step] >= MOST_SIZE)]
            x, y = passing(at, at + step)
            found.append((x, y))
            if not step % 8:
                # enough to choose a head by; counts are as long as the batch, so they are not made at every step
                pairs += np.bincount(group[np.concatenate([x for x, _ in found[-8:]])], minlength=len(begin))
                at = at[pairs[group[at]] <= 16 * size[group[at]]]
        x, y = (np.concatenate(z) for z in zip(*found))
        pairs = np.bincount(group[x], minlength=len(begin))
        degree = np.bincount(x, minlength=len(key)) + np.bincount(y, minlength=len(key))
        dense = big | (pairs > 4 * size)
        wanted = ~dense[group[x]]
        x, y = x[wanted], y[wanted]
        best = np.flatnonzero(degree == np.maximum.reduceat(degree, begin)[group]) if len(key) else begin
        head = best[np.unique(group[best], return_index=True)[1]]
        star = np.flatnonzero(np.repeat(dense, size))
        star = star[star != head[group[star]]]
        a, b = passing(np.minimum(star, head[group[star]]), np.maximum(star, head[group[star]]))
        x, y = np.concatenate((x, a)), np.concatenate((y, b))
        listed = np.flatnonzero(np.repeat(dense | (part[begin] > 0), size))
        a = np.concatenate((np.minimum(ids[x], ids[y]), value[listed]))
        b = np.concatenate((np.maximum(ids[x], ids[y]), ids[listed]))
        kind = np.concatenate((np.zeros(len(x), np.int32), np.ones(len(listed), np.int32)))
        sizes = np.concatenate((n[x], n[listed])).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b), pa.array(sizes)], names=["kind", "a", "b", "n"])

    return lists.mapInArrow(run, "kind int, a bigint, b bigint, n int")


def line_sets(ids: list[int], lines: list[str]) -> Iterator[tuple[int, bytes]]:
    """The sorted distinct tokens of each line, as bytes."""
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string())], names=["id", "line"])
    for part in slices(batch, 1):
        words = Words(part.column(1), WORD_BYTES)
        # one number of the line and part of the hash sorts most slices, as in ordered_sets()
        bits = np.uint64(part.num_rows.bit_length())
        key = (words.text.astype(np.uint64) << (np.uint64(64) - bits)) | (words.hashes >> bits)
        order = np.argsort(key)
        key, tokens = key[order], words.hashes[order]
        if ((key[1:] == key[:-1]) & (tokens[1:] != tokens[:-1])).any():
            order = np.lexsort((words.hashes, words.text))
            tokens = words.hashes[order]
        line = words.text[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (line[1:] != line[:-1])
        whole, ends = tokens[new].tobytes(), 8 * np.searchsorted(line[new], np.arange(part.num_rows), side="right")
        for id, a, b in zip(part.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
            yield id, whole[a:b]


def line_classes(docs: DataFrame, percent: int = 80, long_list: int = LONG_LIST, sizes: bool = False) -> DataFrame:
    """Lines that a similar line comes before: (doc_id, line, first_doc, first_line), the first line of the component.

    docs: (doc_id bigint, text), ids unique and not null; null texts have no lines. Ids beyond 2**39 are numbered first,
    in their order. sizes: each text has a row besides: its id, null, its id, its number of lines.
    """
    return with_small_ids(docs, lambda small: _line_classes(small.where("text is not null"), percent, long_list, sizes), ("doc_id", "first_doc"))


def _line_classes(docs: DataFrame, percent: int, long_list: int, sizes: bool) -> DataFrame:
    # at = doc_id * 2**24 + line orders all lines
    table = lines_table(docs, percent)
    seen, counted = table.where("n > 0"), table.where("n = 0")
    reps = written(seen.groupBy("one", "two", "n").agg(F.min("at").alias("id"), F.count("*").alias("copies")), "reps", varied=True)
    # numbers alone are held, so that rows with their prefixes need no sort
    ids = reps.select(F.col("id").alias("at")).hint("shuffle_hash")
    unique = written(seen.join(ids, "at", "left_semi").select(F.col("at").alias("id"), "n", "low", "high", "often", "prefix"), "unique", varied=True)
    long = long_buckets(unique, percent, long_list)
    long, rounds = (docs.sparkSession.sparkContext.broadcast(long), 2 * ROUNDS) if long.any() else (None, ROUNDS)
    made = [written(candidates(unique, percent, long_list, turn, rounds, long), "candidates") for turn in range(rounds)]
    found = reduce(DataFrame.unionByName, made)
    discard(unique)

    def sets_of(ids: DataFrame) -> DataFrame:
        need = ids.groupBy(F.shiftright("id", LINE_BITS).alias("doc_id")).agg(F.collect_list(F.col("id").bitwiseAND(F.lit((1 << LINE_BITS) - 1))).alias("lines"))

        def sets(cols):
            ids, lines = [], []
            for key, text, wanted in zip(*cols):
                own = text.split("\n")
                ids += [(key << LINE_BITS) + k for k in wanted]
                lines += [own[k] for k in wanted]
            return line_sets(ids, lines)

        return map_rows(docs.join(sent(need), "doc_id").select("doc_id", "text", "lines"), sets, "id bigint, s binary", chunk=64)

    hopes = written(found.where("kind = 0").select("a", "b").distinct(), "hopes")
    links = confirmed(hopes, sets_of, percent)
    discard(hopes)
    dense = found.where("kind = 1").select(F.col("a").alias("value"), F.col("b").alias("id"), "n")
    comp = components(links)
    if dense.limit(1).count():
        comp = joined(comp, links, dense_links(dense, links, sets_of, percent, comp=comp))
    # components are far fewer than lines: their nodes are held, and so are the classes that have a first line elsewhere
    first = reps.join(comp.hint("shuffle_hash"), reps.id == comp.node, "left").select("one", "two", "n", "copies", "id", F.coalesce("component", "id").alias("first"))
    # of most lines no other is like them
    first = written(first.where("copies > 1 or first <> id").withColumnRenamed("copies", "rows").drop("id"), "first")
    discard(*made, reps, comp)
    later = hub_join(seen.select("at", "one", "two", "n"), first.hint("shuffle_hash"), ["one", "two", "n"], table.count()).where("at <> first")
    number = lambda c: F.col(c).bitwiseAND(F.lit((1 << LINE_BITS) - 1))
    doc = lambda c: F.shiftright(c, LINE_BITS)
    later = later.select(doc("at").alias("doc_id"), number("at").alias("line"), doc("first").alias("first_doc"), number("first").alias("first_line"))
    if sizes:
        later = later.unionByName(counted.select(doc("at").alias("doc_id"), F.lit(None).cast("bigint").alias("line"), doc("at").alias("first_doc"), F.col("one").alias("first_line")))
    later = written(later, "later")
    discard(table, first)
    return later


def later_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed, removed (line numbers), class_id, first_docs.

    A line (cut at line feeds) is removed if components of similar lines (Jaccard of distinct words, percent or more)
    hold a line of a smaller (doc_id, line). Lines without words are kept and linked with nothing. class_id is the
    smallest doc_id that holds the first line of one of the document's components, itself included. Null texts have no
    lines; rows with a null id are left out; rows that repeat an id count as one, with the smallest text; an empty table
    gives an empty one. A text of more than 2**24 lines is an error. Other columns are not read.
    """
    docs = single(df, id_col, text_col)
    one = F.col("line").isNotNull()
    lists = line_classes(docs, percent, sizes=True).groupBy("doc_id").agg(
        F.max(F.when(~one, F.col("first_line"))).alias("n_lines"), F.sort_array(F.collect_list("line")).alias("removed"),
        F.min(F.when(one, F.col("first_doc"))).alias("first_doc"), F.sort_array(F.collect_set(F.when(one, F.col("first_doc")))).alias("first_docs"),
    )
    none = F.array().cast("array<bigint>")
    return docs.select("doc_id").join(lists, "doc_id", "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("removed", none).alias("removed"),
        F.least("doc_id", F.coalesce("first_doc", "doc_id")).alias("class_id"), F.coalesce("first_docs", none).alias("first_docs"),
    )


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """df with the removed lines cut from text_col; all rows and all columns stay, whatever their names. See later_lines().

    Rows with a null id or text stay as they are. Of rows that repeat an id those with the smallest text are cut, each of
    them alike; the others stay as they are.
    """
    docs = single(df, id_col, text_col)
    gone = line_classes(docs, percent).groupBy("doc_id").agg(F.collect_list("line").alias("gone"))
    # the row's own columns are kept apart in one, so that none clashes
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("bigint").alias("id"))
    text, same = F.col(f"row.`{text_col}`"), F.lit(True)
    if docs._repeated:
        gone = gone.join(docs.select(F.col("doc_id"), F.col("text").alias("only")), "doc_id")
        same = F.col("only") == text
    cut = row.join(gone, F.col("id") == F.col("doc_id"), "left").select("row", F.when(text.isNotNull() & same, F.col("gone")).alias("cut"))
    names, at = df.columns, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts = columns[at].to_pylist()
            for i, lines in enumerate(batch.column(1).to_pylist()):
                if lines:
                    lines = set(lines)
                    texts[i] = "\n".join(line for k, line in enumerate(texts[i].split("\n")) if k not in lines)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return bounded(cut).mapInArrow(run, df.schema)
