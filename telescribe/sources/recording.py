"""Robot recordings (bag format 2.0, little-endian records) as rows of messages, whole or cut off at the end.

Files are read in byte ranges, so one of any size is many tasks:

1. A task a file reads the file's header and the index at its end: connections, and for each chunk its place, times and
   messages by connection. Where the index is missing or broken, the task steps from record to record instead, reading
   headers only; the chunks it finds are then unpacked in many tasks, which gives what the index would have held.
2. That table, a row a chunk, tells which chunks hold topics that are asked for, and the number of each chunk's first
   message. Chunks are dealt out by file and range of bytes, and each task reads its own ranges and no other.

Stores that Arrow cannot open are read file by file through Spark's binaryFile source, below 2 GB each.
"""

from __future__ import annotations

import bz2
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telescribe.operators.scratch import checkpointed, discard

try:
    import lz4.frame as lz4
except ImportError:
    lz4 = None

# The first line of a file, and the kinds of records that matter.
MAGIC, HEADER, CHUNK, CHUNK_INFO, CONNECTION, MESSAGE = b"#ROSBAG V2.0", 0x03, 0x05, 0x06, 0x07, 0x02
#: Bytes read to look at a record's header; bytes of a file that one task unpacks; bytes of definitions sent to every task.
LOOK, RANGE_BYTES, MOST_SENT = 4096, 64 << 20, 32 << 20
#: Schemes of paths that Arrow opens, and its names for them.
SCHEMES = {"": "file", "file": "file", "s3": "s3", "s3a": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}
SCHEMA = "bag string, conn_id int, topic string, msgtype string, md5sum string, callerid string, latching int, definition string, ts_ns bigint, number bigint, raw binary"


def fields(header: bytes) -> dict[bytes, bytes]:
    """The name=value fields of a record's header; a field that the header cuts off ends them."""
    out, at = {}, 0
    while at + 4 <= len(header):
        (n,) = struct.unpack_from("<I", header, at)
        name, mark, value = header[at + 4 : at + 4 + n].partition(b"=")
        if at + 4 + n > len(header):
            break
        if mark:
            out.setdefault(name, value)
        at += 4 + n
    return out


def records(data: bytes, at: int = 0) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(header fields, data) of the records from a place on; one that the data's end cuts off is left out."""
    while at + 4 <= len(data):
        (n,) = struct.unpack_from("<I", data, at)
        if at + 8 + n > len(data):
            return
        (m,) = struct.unpack_from("<I", data, at + 4 + n)
        if at + 8 + n + m > len(data):
            return
        yield fields(data[at + 4 : at + 4 + n]), data[at + 8 + n : at + 8 + n + m]
        at += 8 + n + m


def kind(header: dict[bytes, bytes]) -> int | None:
    op = header.get(b"op")
    return op[0] if op else None


def unpacked(header: dict[bytes, bytes], data: bytes) -> bytes | None:
    """A chunk's records; None if they cannot be unpacked."""
    name = header.get(b"compression", b"none")
    try:
        if name == b"bz2":
            return bz2.decompress(data)
        if name == b"lz4":
            return lz4.decompress(data) if lz4 else None
        return data if name == b"none" else None
    except Exception:
        return None


def is_recording(content: bytes) -> bool:
    return content.startswith(MAGIC)


def is_truncated(content: bytes) -> bool:
    """Whether the place of the index that the file's header names is unset or lies beyond the file's end."""
    line = content.find(b"\n") + 1
    header = next(records(content, line), ({}, b""))[0] if is_recording(content) else {}
    place = header.get(b"index_pos")
    return place is not None and not 0 < struct.unpack("<Q", place)[0] < len(content)


def slash_type(name: str) -> str:
    """pkg/Type as pkg/msg/Type."""
    return name if "/msg/" in name else name.replace("/", "/msg/", 1)


def parsed_connection(header: dict[bytes, bytes], data: bytes) -> tuple | None:
    """(topic, msgtype, md5sum, callerid, latching, definition) of a connection record; None if topic or type is missing."""
    more = fields(data)
    if not header.get(b"topic") or not more.get(b"type"):
        return None
    text = lambda name: more.get(name, b"").decode("utf-8", "replace")
    return header[b"topic"].decode("utf-8", "replace"), slash_type(text(b"type")), text(b"md5sum"), text(b"callerid"), int(text(b"latching") == "1"), text(b"message_definition")


def parts(chunk: bytes) -> Iterator[tuple[int, int, object, bytes]]:
    """(kind, connection's number, connection or time in ns, data) of a chunk's connections and messages."""
    for header, data in records(chunk):
        conn = header.get(b"conn")
        if conn is None or len(conn) != 4:
            continue
        (conn,) = struct.unpack("<I", conn)
        if kind(header) == CONNECTION and (found := parsed_connection(header, data)):
            yield CONNECTION, conn, found, b""
        elif kind(header) == MESSAGE and len(header.get(b"time", b"")) == 8:
            s, ns = struct.unpack("<II", header[b"time"])
            yield MESSAGE, conn, s * 1_000_000_000 + ns, data


def messages_of(content: bytes, bag: str) -> Iterator[tuple]:
    """Rows of SCHEMA in file order of a recording in memory. Connections are known from its chunks, wherever they stand;
    messages of unknown ones are left out."""
    if not is_recording(content):
        return
    chunks = [x for head, packed in records(content, content.find(b"\n") + 1) if kind(head) == CHUNK and (x := unpacked(head, packed)) is not None]
    known: dict[int, tuple] = {}
    for chunk in chunks:
        for what, conn, found, _ in parts(chunk):
            if what == CONNECTION:
                known.setdefault(conn, found)
    number = 0
    for chunk in chunks:
        for what, conn, ts, data in parts(chunk):
            if what == MESSAGE and conn in known:
                yield (bag, conn, *known[conn], ts, number, data)
                number += 1


def opened(path: str) -> pa.NativeFile:
    """A file to read ranges of, by the path that Spark gives it."""
    scheme, mark, rest = path.partition(":")
    if not mark or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + (rest if mark else path).lstrip("/"))
    store, place = fs.FileSystem.from_uri(SCHEMES[scheme] + ":" + rest)
    return store.open_input_file(place)


def look(file: pa.NativeFile, at: int, size: int) -> tuple[dict[bytes, bytes], int, int] | None:
    """(header fields, place of the data, its length) of the record at a place; None if the file ends within it."""
    head = file.read_at(min(LOOK, size - at), at)
    if len(head) < 4:
        return None
    (n,) = struct.unpack_from("<I", head)
    if at + 8 + n > size:
        return None
    if 8 + n > len(head):
        head = file.read_at(8 + n, at)
    (m,) = struct.unpack_from("<I", head, 4 + n)
    return (fields(head[4 : 4 + n]), at + 8 + n, m) if at + 8 + n + m <= size else None


def steps(file: pa.NativeFile, at: int, size: int) -> Iterator[tuple[int, dict[bytes, bytes]]]:
    """(place, header fields) of the records from a place on; what they hold is not read."""
    while at < size and (found := look(file, at, size)) is not None:
        yield at, found[0]
        at = found[1] + found[2]


def chunk_at(file: pa.NativeFile, at: int, size: int) -> bytes | None:
    """A chunk's records; None if no chunk stands there or it cannot be unpacked."""
    found = look(file, at, size) if 0 < at < size else None
    return unpacked(found[0], file.read_at(found[2], found[1])) if found and kind(found[0]) == CHUNK else None


def indexed(file: pa.NativeFile, head: dict[bytes, bytes], size: int) -> tuple[list[tuple], list[tuple]] | None:
    """Connections (number, connection) and chunks (place, first and last time, {connection: messages}) that the index
    names; None if there is none, it is cut off, or it does not hold as many as the file's header says or no chunk first."""
    (place,), (n_conns,), (n_chunks,) = (struct.unpack(f, head.get(k, b"").ljust(struct.calcsize(f), b"\0")) for f, k in (("<Q", b"index_pos"), ("<I", b"conn_count"), ("<I", b"chunk_count")))
    if not 0 < place < size:
        return None
    conns, chunks = [], []
    for header, data in records(file.read_at(size - place, place)):
        if kind(header) == CONNECTION and len(header.get(b"conn", b"")) == 4:
            conns.append((struct.unpack("<I", header[b"conn"])[0], parsed_connection(header, data)))
        elif kind(header) == CHUNK_INFO and len(header.get(b"chunk_pos", b"")) == 8 and len(data) % 8 == 0:
            times = [s * 1_000_000_000 + ns for s, ns in (struct.unpack("<II", header.get(k, bytes(8))) for k in (b"start_time", b"end_time"))]
            chunks.append((struct.unpack("<Q", header[b"chunk_pos"])[0], *times, dict(struct.iter_unpack("<II", data))))
    chunks.sort()
    if len(conns) != n_conns or len(chunks) != n_chunks or any(c is None for _, c in conns):
        return None
    for at, *_ in chunks[:1] + chunks[-1:]:
        if not 0 < at < place or (found := look(file, at, size)) is None or kind(found[0]) != CHUNK:
            return None
    return conns, chunks


#: A row a file (state cut: whether its index cannot be there), a connection, a chunk of a known index, or one still to be opened.
PLAN = "path string, size bigint, state string, pos bigint, place int, conn_id int, topic string, msgtype string, md5sum string, callerid string, latching int, definition string, start_ns bigint, end_ns bigint, counts array<struct<conn:int,n:bigint>>"


def _rows(schema: str, fn: Callable[[dict], Iterator[tuple]]):
    """A function of Arrow batches that gives fn's tuples for each row, some thousands or megabytes at a time."""
    kinds = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], names=arrow.names)
        for batch in batches:
            rows, size = [], 0
            for row in batch.to_pylist():
                for out in fn(row):
                    rows.append(out)
                    size += len(out[-1]) if isinstance(out[-1], bytes) else 1
                    if size > 1 << 22 or len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return run


def _planned(row: dict) -> Iterator[tuple]:
    path, size, none = row["path"], row["length"], (None,) * 7
    with opened(path) as file:
        if not is_recording(first := file.read_at(min(size, LOOK), 0)):
            return
        begin = first.find(b"\n") + 1
        found = look(file, begin, size)
        head = found[0] if found else {}
        place = struct.unpack("<Q", head[b"index_pos"])[0] if len(head.get(b"index_pos", b"")) == 8 else 1
        yield path, size, "cut" if not 0 < place < size else "whole", None, None, *none, None, None, None
        if (index := indexed(file, head, size)) is not None:
            for i, (conn, what) in enumerate(index[0]):
                yield path, size, "connection", -1, i, conn, *what, None, None, None
            for at, start, end, counts in index[1]:
                yield path, size, "chunk", at, 0, *none, start, end, [{"conn": c, "n": n} for c, n in counts.items()]
        else:
            for at, header in steps(file, begin, size):
                if kind(header) == CHUNK:
                    yield path, size, "unopened", at, 0, *none, None, None, None


def _opened(row: dict) -> Iterator[tuple]:
    """What an index would hold of a chunk: its connections, and its messages by connection."""
    path, size, at = row["path"], row["size"], row["pos"]
    with opened(path) as file:
        chunk = chunk_at(file, at, size)
    if chunk is None:
        return
    counts: dict[int, int] = {}
    low = high = None
    for i, (what, conn, found, _) in enumerate(parts(chunk)):
        if what == CONNECTION:
            yield path, size, "connection", at, i, conn, *found, None, None, None
        else:
            counts[conn] = counts.get(conn, 0) + 1
            low, high = (found, found) if low is None else (min(low, found), max(high, found))
    yield path, size, "chunk", at, 0, *(None,) * 7, low, high, [{"conn": c, "n": n} for c, n in counts.items()]


def _dealt(rows: DataFrame, range_bytes: int) -> DataFrame:
    """rows (path, pos, ..) of chunks, those of a range of bytes of a file in one partition."""
    rows = rows.withColumn("_range", F.floor(F.col("pos") / range_bytes))
    n = rows.select("path", "_range").distinct().count()
    return rows.repartitionByRange(max(1, n), "path", "_range").sortWithinPartitions("path", "pos").drop("_range")


def ranged(path: str) -> bool:
    scheme, mark, _ = path.partition(":")
    return (scheme if mark else "") in SCHEMES


def plan(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """What the recordings below path hold, written: rows of PLAN, each file, connection and chunk by its state."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bag").option("recursiveFileLookup", "true").load(path).select("path", "length")
    first = checkpointed(files.repartition(max(1, min(files.count(), 10_000)), "path").mapInArrow(_rows(PLAN, _planned), PLAN))
    closed = first.where("state = 'unopened'").select("path", "size", "pos")
    if not closed.limit(1).count():
        return first
    out = checkpointed(first.where("state <> 'unopened'").unionByName(_dealt(closed, range_bytes).mapInArrow(_rows(PLAN, _opened), PLAN)))
    discard(first)
    return out


def _bag(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def connections(planned: DataFrame) -> DataFrame:
    """(path, conn_id, topic, msgtype, md5sum, callerid, latching, definition): the first of each number in a file."""
    names = ["topic", "msgtype", "md5sum", "callerid", "latching", "definition"]
    first = planned.where("state = 'connection'").groupBy("path", "conn_id").agg(F.min_by(F.struct(*names), F.struct("pos", "place")).alias("x"))
    return first.select("path", "conn_id", *[f"x.{c}" for c in names])


def read(spark: SparkSession, path: str, topics: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Messages of the recordings below path (*.bag), those of some topics or of all; number is the place in the file.

    A file that is no recording gives no rows. Messages of connections that no chunk or index names are left out and not
    numbered, as are those of chunks that cannot be unpacked; an index numbers the latter's messages, too. Chunks without
    any message of the topics are not read.
    """
    if not ranged(path):
        return read_whole(spark, path, topics)
    planned = plan(spark, path, range_bytes)
    known = checkpointed(connections(planned))
    wanted = F.lit(True) if topics is None else F.col("topic").isin(*topics)
    # the connections of a file are few beside its messages
    own = known.groupBy("path").agg(F.collect_set("conn_id").alias("known"), F.collect_set(F.when(wanted, F.col("conn_id"))).alias("wanted"))
    chunks = planned.where("state = 'chunk'").select("path", "size", "pos", "counts").join(own, "path")
    n = F.aggregate(F.filter("counts", lambda c: F.array_contains("known", c["conn"])), F.lit(0).cast("bigint"), lambda s, c: s + c["n"])
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    chunks = chunks.withColumn("first", F.coalesce(F.sum(n).over(before), F.lit(0)))
    chunks = checkpointed(chunks.where(F.arrays_overlap(F.transform("counts", lambda c: c["conn"]), "wanted")).drop("counts"))

    def unpack(row: dict) -> Iterator[tuple]:
        with opened(row["path"]) as file:
            chunk = chunk_at(file, row["pos"], row["size"])
        number, known, wanted = row["first"], set(row["known"]), set(row["wanted"])
        for what, conn, ts, data in parts(chunk or b""):
            if what == MESSAGE and conn in known:
                if conn in wanted:
                    yield row["path"], conn, ts, number, data
                number += 1

    schema = "path string, conn_id int, ts_ns bigint, number bigint, raw binary"
    rows = _dealt(chunks, range_bytes).mapInArrow(_rows(schema, unpack), schema)
    size = known.agg(F.sum(F.octet_length("definition") + F.octet_length("path") + 200)).first()[0] or 0
    out = rows.join(F.broadcast(known) if size <= MOST_SENT else known, ["path", "conn_id"])
    discard(planned)
    return out.withColumn("bag", _bag(F.col("path"))).select(*T._parse_datatype_string(SCHEMA).fieldNames())


def discovered(spark: SparkSession, path: str) -> DataFrame:
    """(bag, start_us, end_us, n, truncated) of the recordings below path that hold messages, in order of name.

    Of files with an index only header and index are read.
    """
    planned = plan(spark, path)
    known = connections(planned).select("path", F.col("conn_id").alias("conn"))
    each = planned.where("state = 'chunk'").select("path", "start_ns", "end_ns", F.explode("counts").alias("c")).select("path", "start_ns", "end_ns", "c.conn", "c.n").join(known, ["path", "conn"])
    ends = each.groupBy("path").agg(F.floor(F.min("start_ns") / 1000).alias("start_us"), F.floor(F.max("end_ns") / 1000).alias("end_us"), F.sum("n").alias("n"))
    cut = planned.where("state in ('cut', 'whole')").select("path", (F.col("state") == "cut").alias("truncated"))
    return ends.join(cut, "path").select(_bag(F.col("path")).alias("bag"), "start_us", "end_us", "n", "truncated").orderBy("bag")


def read_whole(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    """read() of a store that only Spark opens: each file is one binary value, so below 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bag").option("recursiveFileLookup", "true").load(path)
    wanted = set(topics) if topics is not None else None

    def rows(row: dict) -> Iterator[tuple]:
        return (x for x in messages_of(row["content"], row["path"].rsplit("/", 1)[-1]) if wanted is None or x[2] in wanted)

    return files.select("path", "content").mapInArrow(_rows(SCHEMA, rows), SCHEMA)


def topic_counts(messages: DataFrame) -> DataFrame:
    """(bag, topic, msgtype, n): messages of a topic, however many connections carry it."""
    return messages.groupBy("bag", "topic", "msgtype").agg(F.count("*").alias("n"))
