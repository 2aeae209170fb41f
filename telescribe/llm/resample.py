"""Importance resampling towards a target distribution, over hashed word features.

1. Every whole text becomes the buckets of its features, packed as 16-bit numbers; one stream holds the texts of a slice,
   with the place where each begins. The streams are a written table, so texts are read and hashed once.
2. Each stream is sorted and its runs are counted; the sums by bucket, a table whose size is a parameter, give the gain of
   each bucket: the logarithm of its share in the target over its share in the corpus.
3. A second pass over the streams looks the gains up and sums them between the places, which weighs each document.
4. The largest weights after noise by hash of the id are drawn; ranks come from a range partitioning and a count a partition.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telescribe.llm.common import WORD_BYTES, Words, bounded, discard, lists_array, map_batches, written


@dataclass(frozen=True)
class Params:
    """longest: words of the longest feature. buckets: at most 65536. share: percent drawn of the documents that have
    least_words words or more. seed: goes before the id in the hash of the noise. scale: gains and noise are whole
    numbers of so many to one."""

    longest: int = 2
    buckets: int = 10_000
    share: int = 25
    least_words: int = 20
    seed: int = 7
    scale: int = 1000


#: Bytes of words whose checksums are joined by tables; longer ones are joined one by one.
LONG_WORD = 64


def crc_steps() -> np.ndarray:
    """What a byte makes of the low byte of a CRC-32: the reflected polynomial 0xEDB88320, eight bits at a time."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ np.where(out & 1, np.uint32(0xEDB88320), np.uint32(0))
    return out


STEP = crc_steps()


def crc_shifts() -> np.ndarray:
    """[n, k, b]: the checksum's byte k of value b after n zero bytes; checksums of joined texts are sums of these."""
    out = np.empty((LONG_WORD + 1, 4, 256), dtype=np.uint32)
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for n in range(LONG_WORD + 1):
        out[n] = now
        now = STEP[now & np.uint32(255)] ^ (now >> np.uint32(8))
    return out.reshape(-1)


SHIFT = crc_shifts()


def checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each word (size bytes of data from start), a byte of all words at a time."""
    out = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")
    still = np.searchsorted(-size[order], -np.arange(1, LONG_WORD + 1), side="right")
    at, state = start[order], out[order]
    for k, n in enumerate(still.tolist()):
        if not n:
            break
        state[:n] = STEP[(state[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]].tobytes())
    return out


def followed(crc: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The checksums of texts (crc) with a blank and a word behind them; own: the words' checksums."""
    state = ~crc
    blank = ~(STEP[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8)))
    row = np.minimum(size, LONG_WORD) * 1024
    out = own.copy()
    for k in range(4):
        out ^= SHIFT[row + 256 * k + ((blank >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64)]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]].tobytes(), int(blank[i]))
    return out


def features(texts: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text, the place where its buckets begin (and past the last text), and the buckets of all."""
    words = Words(texts, WORD_BYTES)
    data = words.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    size = words.end - words.start
    n_words = np.diff(words.first)
    per_text = np.maximum(0, n_words[:, None] - np.arange(p.longest)[None])
    offsets = np.concatenate(([0], np.cumsum(per_text.sum(axis=1))))
    own = checksums(data, words.start, size)
    stream = np.empty(offsets[-1], dtype=np.uint16)
    crc, begin = own, offsets[:-1].copy()
    for n in range(p.longest):
        if n:
            crc = followed(crc[:-1], data, words.start[n:], size[n:], own[n:])
        at = np.arange(len(crc))
        text = words.text[: len(crc)]
        inside = words.text[n:] == text
        stream[(begin - words.first[:-1])[text[inside]] + at[inside]] = crc[inside] % np.uint32(p.buckets)
        begin += per_text[:, n]
        if len(crc) < 2:
            break
    return n_words, offsets, stream


def streams(df: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """(ids, n_words, offsets, stream): a row a slice of texts, written; the stream is packed little-endian."""

    def rows(part):
        n_words, offsets, stream = features(part.column(1), p)
        one = np.array([part.num_rows])
        return {
            "ids": pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)),
            "n_words": lists_array(n_words, one),
            "offsets": lists_array(offsets, one + 1),
            "stream": pa.array([stream.astype("<u2").tobytes()], pa.binary()),
        }

    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return written(map_batches(texts, rows, "ids array<bigint>, n_words array<bigint>, offsets array<bigint>, stream binary", 1), "streams")


def bucket_counts(packed: DataFrame, p: Params) -> np.ndarray:
    """How many features lie in each bucket: sorted streams, run lengths, and sums by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, dtype=np.int64)
        for batch in batches:
            for stream in batch.column(0):
                values = np.sort(np.frombuffer(stream.as_buffer(), dtype="<u2"))
                if len(values):
                    runs = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
                    total[values[runs]] += np.diff(np.append(runs, len(values)))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    out = np.zeros(p.buckets, dtype=np.int64)
    for r in bounded(packed.select("stream")).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray, p: Params) -> np.ndarray:
    """The whole-number gain of each bucket; one is added to each count."""
    s, t = int(corpus.sum()) + p.buckets, int(target.sum()) + p.buckets
    return np.array([math.floor(p.scale * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def weighed(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every text of the streams; weight is the floored mean of its gains."""
    shared = packed.sparkSession.sparkContext.broadcast(gain)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n_words, offsets, stream = (batch.column(k)[i] for k in range(4))
                offsets = offsets.values.to_numpy()
                n = np.diff(offsets)
                weight = np.zeros(len(n), dtype=np.int64)
                full = n > 0
                if full.any():
                    sums = np.add.reduceat(shared.value[np.frombuffer(stream.as_buffer(), dtype="<u2")], offsets[:-1][full])
                    weight[full] = sums // n[full]
                yield pa.RecordBatch.from_arrays([ids.values, n_words.values, pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return bounded(packed).mapInArrow(rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def drawn(rows: DataFrame, p: Params) -> DataFrame:
    """rows (doc_id, n_words, n_features, weight) with score, and rank for the share drawn; null for the others."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-p.scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    able = (F.col("n_words") >= p.least_words) & F.col("doc_id").isNotNull()
    rows = rows.withColumn("score", F.col("weight") + noise).withColumn("able", able)
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").asc()]
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    part, total, able_rows, offsets = F.shiftright("at", 33), 0, 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("able")).orderBy("part").collect():  # one row a partition
        offsets.append((r.part, total))
        total, able_rows = total + r.n, able_rows + r.able
    offset = F.broadcast(placed.sparkSession.createDataFrame(offsets, "part bigint, offset bigint"))
    rank = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.withColumn("part", part).join(offset, "part")
    return out.withColumn("rank", F.when(rank <= p.share * able_rows // 100, rank)).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", params: Params = Params()) -> DataFrame:
    """One row a document: doc_id, n_words, n_features, weight, score, and rank (1, 2, 3...; null if not drawn).

    Null and empty texts have no features and weight 0, and are never drawn, as they have too few words. Rows with a null
    id get a null score and are never drawn. Repeated rows are weighed and drawn each by itself; equal scores go by the
    smaller id, and of equal ids by fewer features. An empty target counts no feature in any bucket; an empty df gives an
    empty table. Ids are whole numbers; other columns are not read.
    """
    p = params
    aim = streams(target.withColumn("_id", F.lit(0)), "_id", target_col, p)
    wanted = bucket_counts(aim, p)
    discard(aim)
    packed = streams(df, id_col, text_col, p)
    rows = written(weighed(packed, gains(bucket_counts(packed, p), wanted, p)), "weighed")
    discard(packed)
    return drawn(rows, p)


def selected(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", params: Params = Params()) -> DataFrame:
    """The rows of df whose id is drawn, all columns as they were, whatever their names. All rows of a drawn id stay."""
    ids = resample(df, target, id_col, text_col, target_col, params).where("rank is not null").select(F.col("doc_id").alias("drawn")).distinct()
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("bigint").alias("id"))
    return row.join(ids, F.col("id") == F.col("drawn"), "left_semi").select("row.*")
