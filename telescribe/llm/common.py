"""Helpers shared by the corpus operators: table reading, scratch tables, word splitting and components."""

from __future__ import annotations

import atexit
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of ASCII letters, digits and any characters beyond ASCII (texts are lower-cased first).
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A run of anything but ASCII white space.
SPACED_WORD = re.compile(r"[^\x20\x09-\x0D]+")

_scratch: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z; every other letter is left as it is."""
    return text.encode().lower().decode()


def words_of(text: str | None) -> list[str]:
    """Lower-cases A-Z and takes the words; null has none."""
    return WORD.findall(lower_ascii(text)) if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def letters(pattern: re.Pattern) -> np.ndarray:
    """Which bytes of UTF-8 texts belong to words of the pattern, one that tells ASCII characters only apart."""
    return np.array([i >= 128 or bool(pattern.match(chr(i).lower())) for i in range(256)])


WORD_BYTES, SPACED_BYTES = letters(WORD), letters(SPACED_WORD)
FACTOR = 0x9E3779B97F4A7C15
CODE = mixed(np.arange(1, 257, dtype=np.uint64))
CODE[65:91] = CODE[97:123]


#: A-Z as a-z; masks of the first so many bytes of eight; bytes of a word up to which it is hashed with all others.
LOWER = bytes(range(256)).lower()
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
LONG_WORD = 256


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each of the words data[start:end], A-Z read as a-z: eight bytes of all words at a time, longer words one by one."""
    lower = data.tobytes().translate(LOWER) + bytes(8)
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=lower, strides=(1,))
    length = end - start
    # the length comes first, so that words that fill up to the same eight bytes differ
    out = mixed(mixed(length.astype(np.uint64)) + (eights[start] & MASKS[np.minimum(length, 8)]))
    more, at = np.flatnonzero((length > 8) & (length <= LONG_WORD)), 8
    while len(more):
        out[more] = mixed(out[more] * np.uint64(FACTOR) + (eights[start[more] + at] & MASKS[np.minimum(length[more] - at, 8)]))
        at += 8
        more = more[length[more] > at]
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(lower[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


class Words:
    """The words of a batch of texts, found and hashed for all texts at once.

    hashes: 64 bits a word, A-Z read as a-z. text: the number of its text. start: its first byte in data. first: for each
    text and one past the last, the number of its first word.
    """

    def __init__(self, texts: pa.Array, word_bytes: np.ndarray):
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        self.data = np.frombuffer(whole, dtype=np.uint8)[offsets[0] : offsets[-1]] if whole is not None else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]
        inside = np.zeros(len(self.data) + 1, dtype=bool)
        inside[:-1] = np.frombuffer(self.data.tobytes().translate(word_bytes.tobytes()), dtype=bool)
        breaks = self.offsets[:-1]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        begin[breaks] = inside[breaks]
        end = ~inside
        end[breaks] = True
        end[1:] &= inside[:-1]
        end[0] = False
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end)
        self.hashes = word_hashes(self.data, self.start, self.end)
        self.first = np.searchsorted(self.start, self.offsets)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def shingles(self, size: int) -> list[np.ndarray]:
        """For each text the sorted distinct hashes of its word shingles; fewer words than size are one, no words none."""
        h, out = self.hashes, []
        whole = np.full(max(0, len(h) - size + 1), size, dtype=np.uint64)
        for i in range(size):
            whole = mixed(whole * np.uint64(FACTOR) + h[i : len(h) - size + 1 + i]) if len(whole) else whole
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            if b - a >= size:
                out.append(np.unique(whole[a : b - size + 1]))
            else:
                few = np.full(min(1, b - a), b - a, dtype=np.uint64)
                for i in range(a, b):
                    few = mixed(few * np.uint64(FACTOR) + h[i])
                out.append(few)
        return out


    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash of size words from each word on, and whether its text has so many words left."""
        whole, have = np.zeros(len(self.hashes), np.uint64), 0
        part, width, left = self.hashes, 1, size
        while left:
            if left & 1:
                whole, have = mixed(whole * np.uint64(FACTOR) + ahead(part, have)), have + width
            part, width, left = mixed(part * np.uint64(FACTOR) + ahead(part, width)), 2 * width, left >> 1
        return whole, ahead(self.text + 1, size - 1) == self.text + 1


def ahead(x: np.ndarray, n: int) -> np.ndarray:
    """x[n:], filled up with zeros."""
    return np.concatenate((x[n:], np.zeros(min(n, len(x)), x.dtype)))


def shingle_hashes(text: str | None, size: int, word_bytes: np.ndarray = SPACED_BYTES) -> np.ndarray:
    return Words(pa.array([text], pa.string()), word_bytes).shingles(size)[0]


#: Bytes of rows that Spark hands to Python at once, where the session sets no bound of its own (its default is rows only).
BATCH_BYTES = "4m"


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session from now on hands rows to Python in batches of bounded bytes, so that long texts don't add up."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, BATCH_BYTES)
    return df


def slices(batch: pa.RecordBatch, text_col: int, most_bytes: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold most_bytes of text, or one row."""
    ends = np.cumsum(np.maximum(1, np.nan_to_num(pa.compute.binary_length(batch.column(text_col)).to_numpy(zero_copy_only=False).astype(float))))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def filtered(df: DataFrame, text_col: str, keep: Callable[[pa.Array], list[bool]]) -> DataFrame:
    """The rows of df whose text keep() wants, all columns as they were. keep: texts to as many booleans."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(keep(part.column(at)), pa.bool_()))

    return bounded(df).mapInArrow(run, df.schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, text_col: int, most_bytes: int = 1 << 18) -> DataFrame:
    """Applies fn to slices of Arrow batches that hold most_bytes of text, or one row; fn gives arrays by name."""
    out = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            for part in slices(batch, text_col, most_bytes):
                found = fn(part)
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], type=f.type) if isinstance(found[f.name], (list, np.ndarray)) else found[f.name].cast(f.type) for f in arrow], names=arrow.names)

    return bounded(df).mapInArrow(run, out)


def lists_array(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow list of sizes[i] values for each i."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, as in tests on one machine, one below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: On a local file system Hadoop starts a process for each file it makes beside a checksum file; scratch tables do without.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def written(df: DataFrame, name: str, varied: bool = False) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back, so lost executors cost no recomputation.

    What was shuffled for it is never read again, and goes at once, not when the driver next collects garbage.
    varied: values hardly repeat (hashes, ids), so that making dictionaries of them would be work for nothing.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**PLAIN, **({"parquet.enable.dictionary": "false"} if varied else {})).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before) if before is not None else spark.conf.unset(SHUFFLE_CLEANUP)
    _scratch[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables at once. What was made from them must be written by then, so that no lost task reads them again."""
    for df in tables:
        delete(df._scratch_path, _scratch.pop(df._scratch_path))


def delete(path: str, spark: SparkSession) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def single(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id bigint, text): rows with an id, one an id (the smallest text). _repeated: whether ids had more rows than one."""
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    if repeated:
        docs = written(docs.groupBy("doc_id").agg(F.min("text").alias("text")), "single")
    docs._repeated = repeated
    return docs


#: Ids below this, and above its negative, leave room for a line number in 64 bits.
ID_LIMIT = 1 << 39


def with_small_ids(docs: DataFrame, fn: Callable[[DataFrame], DataFrame], columns: tuple[str, ...]) -> DataFrame:
    """fn(docs); if ids (doc_id) reach ID_LIMIT, it gets them numbered in order, and its columns of numbers become ids again."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or -ID_LIMIT < low and high < ID_LIMIT:
        return fn(docs)
    at = written(docs.select("doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("at", F.monotonically_increasing_id()), "ids")
    part, total, offsets = F.shiftright("at", 33).alias("part"), 0, []
    for r in at.groupBy(part).count().orderBy("part").collect():  # one row a partition
        offsets.append((r["part"], total))
        total += r["count"]
    offset = F.broadcast(docs.sparkSession.createDataFrame(offsets, "part bigint, offset bigint"))
    number = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ids = written(at.withColumn("part", part).join(offset, "part").select("doc_id", number.alias("number")), "numbers")
    out = fn(docs.join(ids, "doc_id").drop("doc_id").withColumnRenamed("number", "doc_id").select(docs.columns))
    for c in columns:
        back = ids.select(F.col("number").alias(c), F.col("doc_id").alias("_id"))
        out = out.join(back, c).withColumn(c, F.col("_id")).drop("_id")
    return out


@atexit.register
def drop_scratch() -> None:
    """Deletes the scratch tables of this process; those of a session that has ended stay to its cluster's cleaner."""
    for path, spark in list(_scratch.items()):
        _scratch.pop(path)
        if spark._jsc is None or spark._jsc.sc().isStopped():
            continue
        delete(path, spark)


def grouped(df: DataFrame, keys: list[str], fn: Callable[[dict[str, list | np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """Applies fn to the rows of each group of integer keys: a dict of columns to tuples. Many small groups share a batch.

    A group is held whole, so callers bound its size.
    """
    out, names = T._parse_datatype_string(schema), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)

        def made(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
            cols = {c: table[c].to_numpy() if pa.types.is_integer(table[c].type) else table[c].to_pylist() for c in names}
            rows = [row for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) for row in fn({c: x[a:b] for c, x in cols.items()})]
            columns = list(zip(*rows)) if rows else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], names=arrow.names)

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(names.index(c)).to_numpy() for c in keys], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            begins = held and (key[0] != last).any()
            if begins or len(cuts):
                end = 0 if begins else int(cuts[0])
                if held:
                    done = pa.Table.from_batches([*held, batch.slice(0, end)])
                    yield made(done, np.array([0, done.num_rows]))
                    held, first = [], end
                else:
                    first = 0
                whole = cuts[cuts >= first]
                if len(whole) and whole[-1] > first:
                    at = np.unique(np.concatenate(([first], whole))) - first
                    yield made(pa.Table.from_batches([batch.slice(first, int(whole[-1]) - first)]), at)
                    first = int(whole[-1])
                held = [batch.slice(first)]
            else:
                held.append(batch)
            last = key[-1]
        if held:
            done = pa.Table.from_batches(held)
            yield made(done, np.array([0, done.num_rows]))

    return bounded(df).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, out)


def map_rows(df: DataFrame, fn: Callable[[list[list]], Iterator[tuple]], schema: str | T.StructType, chunk: int = 256) -> DataFrame:
    """Applies fn, in Arrow batches, to lists of column values (one list a column, at most chunk rows a call).

    fn yields tuples in the order of schema. It runs on what a task reads, so memory is bounded by a batch.
    """
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                rows = list(fn([part.column(i).to_pylist() for i in range(part.num_columns)]))
                columns = list(zip(*rows)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], names=names)

    return bounded(df).mapInArrow(run, out)


#: Most ids that are sent to every executor, 8 bytes each.
MOST_SENT = 500_000


#: Rows of one key that a join may leave to one task, where no more than MOST_SENT keys have more.
HUB = 4096


def hub_join(rows: DataFrame, ones: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with ones, which hold each key once and, as "rows", no fewer than the rows that have it; total: their sum.

    Rows of the frequent keys stay where they lie, and their ones are sent to every task: at most MOST_SENT, as total
    rows cannot make more keys so frequent. Only the others are dealt out by key, so no key makes a task large.
    """
    most = max(HUB, total // MOST_SENT)
    hubs = F.broadcast(ones.where(F.col("rows") > most))
    rest = rows.join(F.broadcast(ones.where(F.col("rows") > most).select(*keys)), keys, "left_anti")
    return rows.join(hubs, keys).unionByName(rest.join(ones.where(F.col("rows") <= most), keys)).drop("rows")


#: Edges of a component round for each partition it is written in, and rounds that no graph needs.
ROUND_EDGES, MOST_ROUNDS = 100_000, 200


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): every node with the smallest node it reaches.

    Alternates a step that points each node's larger neighbours at the smallest one with a step that does so for its
    smaller neighbours, until all edges point at roots; steps grow with the logarithm of the largest component. Nodes
    with many edges are hubs of hub_join(). Only counts come to the driver; each round is a written table, and the one before it is deleted. Null ends and loops are
    left out. An empty table gives an empty one. Columns: node, component. discard() deletes what the result reads.
    """
    e = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    parts = None
    for _ in range(MOST_ROUNDS):
        # done once every node has one edge, to a node that has none itself
        ends = e.select(F.col("a").alias("k"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(e.select(F.col("b").alias("k"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        ends = ends.groupBy("k").agg(F.sum("out").alias("out"), F.max("in").alias("in"), F.count("*").alias("rows"))
        now = ends.agg(F.max(F.expr("out > 1 or out + in > 1")).alias("open"), F.max("rows").alias("most"), F.sum("out").alias("edges")).first()
        if not now["open"]:
            break
        # rounds never hold more edges than the first table
        parts = parts or -(-now["edges"] // ROUND_EDGES)

        def met(rows: DataFrame, ones: DataFrame) -> DataFrame:
            return hub_join(rows, ones, ["a"], 2 * now["edges"]) if now["most"] > HUB else rows.join(ones.drop("rows"), "a")

        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("rows"))
        large = met(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows"))
        small = met(large, low).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b")))
        before, e = e, written(small.where("a <> b").distinct().coalesce(parts), "small")
        discard(before)
    else:
        raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
    out._scratch_path = e._scratch_path
    return out


def joined(comp: DataFrame, links: DataFrame, more: DataFrame) -> DataFrame:
    """components() of links and more, from those of links (comp, which is discarded); many more links are taken with all others.

    Few of them meet as edges between components, and only what they join gets another smallest node.
    """
    if more.count() > MOST_SENT // 2:
        discard(comp)
        return components(links.unionByName(more))
    ends = more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = written(comp.join(F.broadcast(ends), "node").select("node", "component"), "ends")
    of = lambda c: F.broadcast(known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of")))
    top = components(more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")))
    least = F.broadcast(top.select(F.col("node").alias("component"), F.col("component").alias("least")))
    out = comp.join(least, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    # nodes that no link has
    fresh = top.join(F.broadcast(known.select(F.col("component").alias("node")).distinct()), "node", "left_anti").select("node", "component")
    out = written(out.unionByName(fresh), "joined")
    discard(comp, known, top)
    return out


def sent(ids: DataFrame) -> DataFrame:
    """ids (with an array column "lines", or one id a row), marked for broadcast if it holds at most MOST_SENT numbers.

    Then the texts it is joined with stay where they lie; a larger one is joined by a shuffle.
    """
    size = F.size("lines") + 1 if "lines" in ids.columns else F.lit(1)
    total = ids.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(ids) if total <= MOST_SENT else ids


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * common >= percent * (len(s) + len(t) - common)


#: Hashes of two sets up to which pairs are compared many at once, those of like sizes together.
FEW_HASHES = (128, 1024)


def similar_pairs(s: list[bytes], t: list[bytes], percent: int) -> np.ndarray:
    """Which pairs of sets (sorted 64-bit hashes as bytes) are similar."""
    size = np.array([[len(x) for x in s], [len(x) for x in t]], dtype=np.int64).reshape(2, -1) >> 3
    total = size.sum(axis=0)
    good, done = np.zeros(len(s), dtype=bool), 0
    for most in FEW_HASHES:
        few = np.flatnonzero((total > done) & (total <= most))
        done = most
        # a row a pair, filled up behind its hashes; a set holds a hash once, so one that comes twice in a pair is common to it
        width = np.arange(total[few].max(initial=0))
        rows = np.full((len(few), len(width)), ~np.uint64(0))
        rows[width < total[few][:, None]] = np.frombuffer(b"".join([x for i in few.tolist() for x in (s[i], t[i])]), dtype=np.uint64)
        rows.sort(axis=1)
        common = ((rows[:, 1:] == rows[:, :-1]) & (width[1:] < total[few][:, None])).sum(axis=1)
        good[few] = 100 * common >= percent * (total[few] - common)
    for i in np.flatnonzero((total > done) | (total == 0)):
        good[i] = similar(np.frombuffer(s[i], dtype=np.uint64), np.frombuffer(t[i], dtype=np.uint64), percent)
    return good


def confirmed(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar, written. sets_of: (id) to (id, s), s the sorted 64-bit hashes as bytes."""
    sets = written(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("s_b")), "b")

    def rows(cols):
        a, b, s, t = cols
        for i in np.flatnonzero(similar_pairs(s, t, percent)):
            yield a[i], b[i]

    links = written(map_rows(both.select("a", "b", "s_a", "s_b"), rows, "a bigint, b bigint", chunk=256), "links")
    discard(sets)
    return links


def bit_sets(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words a set, one bit set by each hash; bits that differ are at most the hashes that differ."""
    n = np.array([len(s) for s in sets])
    bits = 64 * int(np.clip(n.max() // 8 + 1, 2, 64))
    out = np.zeros(len(sets) * bits, dtype=bool)
    out[np.repeat(np.arange(len(sets)) * bits, n) + (mixed(np.concatenate(sets)) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out.reshape(len(sets), bits), axis=1).view(np.uint64)


#: Members of a block of a long list, and hashes of their sets (8 bytes each).
TILE, TILE_HASHES = 400, 1 << 18
#: Bytes that are dealt out to blocks in one round, or as many as all sets have, if those are more; bytes of a row beside its set.
MET_BYTES, ROW_BYTES = 1 << 29, 32


def dense_links(lists: DataFrame, links: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, tile: int = TILE, comp: DataFrame | None = None) -> DataFrame:
    """Links between components that only long inverted lists can show, found without a row for each pair.

    lists: (value, id, n), n the set's size. Lists whose members lie in one component need nothing more, and of lists
    with the same members one is enough. In each of the others the members outside its largest component are cut into
    blocks of about tile members, as are those inside, and each block of the former meets every block of the list in a
    task that compares full sets and gives a link only where it joins components. Lists up to one block are one group.
    So rows are the lists' members, and for longer lists as many times more as there are blocks outside; they are dealt
    out in rounds, so that disk holds no more of them than MET_BYTES or the sets themselves. comp: the components of links,
    if they are there; the caller discards them.
    """
    own = [] if comp is not None else [components(links)]
    comp = own[0] if own else comp
    listed = rows = written(lists.distinct().join(comp, lists.id == comp.node, "left").select("value", "id", "n", F.coalesce("component", "id").alias("of")), "lists")
    mark = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    whole = rows.groupBy("value").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.count("*").alias("size"), F.sum("n").alias("hashes"), *mark).where("low < high")
    once = written(whole.groupBy("size", "hashes", "mark0", "mark1").agg(F.min("value").alias("value")).select("value", "size", "hashes"), "apart")
    if not once.limit(1).count():
        discard(*own, listed, once)
        return links.limit(0)
    rows = kept = written(rows.join(once, "value"), "kept")
    single = (F.col("size") <= tile) & (F.col("hashes") <= TILE_HASHES)
    # long lists only: which members lie in the largest component, and the blocks of either kind
    by = rows.where(~single).groupBy("value", "of").agg(F.count("*").alias("c"), F.sum("n").alias("h"))
    most = by.groupBy("value").agg(F.max_by("of", F.struct("c", "of")).alias("main"), F.max(F.struct("c", "of", "h"))["h"].alias("h"), F.max("c").alias("c"), F.sum("c").alias("size"), F.sum("h").alias("hashes"))
    parts = lambda n, h: F.greatest(F.ceil(n / tile), F.ceil(h / TILE_HASHES), F.lit(1)).cast("int")
    most = written(most.select("value", "main", parts(F.col("size") - F.col("c"), F.col("hashes") - F.col("h")).alias("outer"), parts(F.col("c"), F.col("h")).alias("inner")), "blocks")
    small = rows.where(single).select("value", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("left"), "id", "of")
    at = F.when(F.col("of") == F.col("main"), F.col("outer") + F.pmod(F.xxhash64("id"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("id"), F.col("outer"))).cast("int")
    large = rows.where(~single).select("value", "id", "of").join(most, "value").withColumn("at", at)
    as_left = F.when(F.col("at") < F.col("outer"), F.transform(F.sequence(F.col("at"), F.col("outer") + F.col("inner") - 1), lambda j: F.struct(F.col("at").alias("i"), j.alias("j"), F.lit(True).alias("left"))))
    before = F.least(F.col("at"), F.col("outer")) - 1
    as_right = F.when(before >= 0, F.transform(F.sequence(F.lit(0), before), lambda i: F.struct(i.alias("i"), F.col("at").alias("j"), F.lit(False).alias("left"))))
    none = F.array().cast("array<struct<i:int,j:int,left:boolean>>")
    large = large.select("value", "id", "of", F.explode(F.concat(F.coalesce(as_left, none), F.coalesce(as_right, none))).alias("x")).select("value", "x.i", "x.j", "x.left", "id", "of")
    sets = written(sets_of(kept.select("id").distinct()), "sets")
    # a member outside meets all blocks, one inside those outside
    times = F.when(single, F.lit(1)).when(F.col("of") == F.col("main"), F.col("outer")).otherwise(F.col("outer") + F.col("inner"))
    total = rows.join(most, "value", "left").agg(F.sum((8 * F.col("n") + ROW_BYTES) * times)).first()[0] or 0
    rounds = 1 if total <= MET_BYTES else -(-total // max(MET_BYTES, sets.agg(F.sum(F.octet_length("s"))).first()[0] or 0))
    members = small.unionByName(large)

    def compare(cols: dict) -> list[tuple]:
        left, ids, of = np.array(cols["left"]), cols["id"], cols["of"]
        sets = [np.frombuffer(x, dtype=np.uint64) for x in cols["s"]]
        inner = cols["i"][0] == cols["j"][0]
        top = {x: x for x in of.tolist()}

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        one, two = np.flatnonzero(left), np.flatnonzero(left if inner else ~left)
        out = []
        if len(one) and len(two) and (of != of[0]).any():
            words, place = np.unique(np.concatenate([sets[i] for i in two]), return_inverse=True)
            n = np.array([len(sets[i]) for i in two])
            starts = np.concatenate(([0], np.cumsum(n)[:-1]))
            mark = np.zeros(len(words), dtype=np.int64)
            bits = bit_sets(sets)
            differ = np.zeros((len(one), len(two)), dtype=np.int32)
            for x in bits.T:
                differ += np.bitwise_count(x[one][:, None] ^ x[two][None])
            total = np.array([len(sets[i]) for i in one])[:, None] + n[None]
            # sets that are similar enough differ in few hashes, so in few bits
            hope = (differ * (100 + percent) <= total * (100 - percent)) & (of[one][:, None] != of[two][None])
            for i in one[hope.any(axis=1)]:
                at = np.searchsorted(words, sets[i])
                at = at[words[np.minimum(at, len(words) - 1)] == sets[i]]
                mark[at] = 1
                common = np.add.reduceat(mark[place], starts)
                mark[at] = 0
                for j in two[(100 * common >= percent * (len(sets[i]) + n - common)) & (of[two] != of[i])]:
                    a, b = root(int(of[i])), root(int(of[j]))
                    if a != b:
                        top[max(a, b)] = min(a, b)
                        out.append((int(ids[i]), int(ids[j])))
        return out

    found = []
    for turn in range(rounds):
        now = members if rounds == 1 else members.where(F.pmod(F.xxhash64("value", "i", "j"), F.lit(rounds)) == turn)
        met = now.join(sets, "id").select("value", "i", "j", "left", "id", "of", "s")
        found.append(written(grouped(met, ["value", "i", "j"], compare, "a bigint, b bigint"), "dense"))
    discard(*own, listed, once, most, kept, sets)
    return reduce(DataFrame.unionByName, found)
