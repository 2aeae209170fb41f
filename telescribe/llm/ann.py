"""Nearest vectors by largest inner product: a block matrix join with int8 product tiles and exact recomputation.

Queries and candidates are dealt into blocks of a checked size, and every block of one meets every block of the other in
a group of its own, so nothing is broadcast. Tiles of int8 codes bound every product from both sides, survivors are
recomputed in double precision, and each group keeps the k best a query, so only these are shuffled and merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telescribe.llm.common import bounded

#: Bytes of a block as it is sent, bytes from which a table is worth a block more, and the sides of a product tile.
BLOCK_BYTES, WORTH_BYTES, TILE_QUERIES, TILE_ROWS = 8 << 20, 1 << 20, 512, 4096


def valid(batch: pa.RecordBatch | pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and double vectors by dimension; rows that are null, zero, or hold null or non-finite components are left out."""
    found: dict[int, tuple[list, list]] = {}
    vectors = batch.column(1).combine_chunks() if isinstance(batch, pa.Table) else batch.column(1)
    for key, v in zip(batch.column(0).to_pylist(), vectors.to_numpy(zero_copy_only=False)):
        if key is None or v is None or not len(v):
            continue
        v = np.asarray(v, dtype=np.float64)
        if np.isfinite(v).all() and v.any():
            ids, vectors = found.setdefault(len(v), ([], []))
            ids.append(key)
            vectors.append(v)
    return {d: (np.array(ids, dtype=np.int64), np.array(vectors)) for d, (ids, vectors) in found.items()}


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (held as floats, in which tile sums are exact), scale of each row, and sum of absolute codes."""
    scale = np.abs(x).max(axis=1) / 127
    c = np.rint(x / np.maximum(scale, 1e-300)[:, None])
    return c.astype(np.float32 if x.shape[1] <= 1000 else np.float64), scale, np.abs(c).sum(axis=1)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, components added in order."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores of each q, one an id, ties to smaller ids."""
    order = np.lexsort((-score, ids, q))
    q, score, ids = q[order], score[order], ids[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    q, score, ids = q[new], score[new], ids[new]
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[place < k], score[place < k], ids[place < k]


class Block:
    """A block of queries of one dimension and the best candidates that it has met so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, vectors, k
        self.c, self.s, self.l1 = codes(vectors)
        self.floor = np.full(len(self.ids), -np.inf)
        self.found = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        c, s, l1 = codes(y)
        new = [self.found]
        order = np.argsort(ids, kind="stable")
        once = np.flatnonzero(np.concatenate(([True], ids[order][1:] != ids[order][:-1])))
        for at in range(0, len(self.ids), TILE_QUERIES):
            q = slice(at, at + TILE_QUERIES)
            weight = self.s[q, None] * s[None, :]
            product = (self.c[q] @ c.T).astype(np.float64) * weight
            error = weight * (0.5 * self.l1[q, None] + 0.5 * l1[None, :] + 0.25 * y.shape[1]) * (1 + 1e-9) + 1e-12
            own = self.ids[q, None] == ids[None, :]
            low = np.where(own, -np.inf, product - error)
            floor = self.floor[q]
            if len(once) > self.k:
                # rows that repeat an id take one of the k places
                low = low if len(once) == len(ids) else np.maximum.reduceat(low[:, order], once, axis=1)
                floor = np.maximum(floor, np.partition(low, len(once) - self.k, axis=1)[:, len(once) - self.k])
            i, j = np.nonzero((product + error >= floor[:, None]) & ~own)
            new.append((i + at, exact(self.x[i + at], y[j]), ids[j]))
        self.found = best(*(np.concatenate(c) for c in zip(*new)), self.k)
        q, score, _ = self.found
        full = np.bincount(q, minlength=len(self.ids)) >= self.k
        worst = np.full(len(self.ids), np.inf)
        np.minimum.at(worst, q, score)
        self.floor = np.where(full, worst, -np.inf)


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k candidates of largest inner product, itself left out.

    Vectors of another dimension than the query's are no candidates; nor are null, zero or non-finite ones, or rows
    without an id. Rows that repeat an id count as one candidate, the one that scores best. Ties go to the smaller id.
    Fewer than k candidates give fewer rows; an empty table gives none. Other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null and v is not null")
    # equal rows count once, so that no block fills up with them
    rows = bounded(rows).groupBy("id", "v").agg(F.max("asks").alias("asks"))
    size = F.size("v") * 4 + 8
    every, asked = rows.agg(F.sum(size), F.sum(F.when(F.col("asks"), size))).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = max(-(-(every or 1) // block_bytes), min(cores, -(-(every or 1) // WORTH_BYTES)))
    m = -(-(asked or 1) // block_bytes)
    own, number = F.xxhash64("id", "v"), lambda to: F.explode(F.sequence(F.lit(0), F.lit(to - 1)))
    queries = rows.where("asks").select(F.pmod(own, F.lit(m)).cast("int").alias("q"), number(n).alias("c"), "id", "v")
    candidates = rows.select(number(m).alias("q"), F.pmod(own, F.lit(n)).cast("int").alias("c"), "id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = {d: Block(ids, x, k) for d, (ids, x) in valid(left.select(["id", "v"])).items()}
        right = right.select(["id", "v"])
        for at in range(0, right.num_rows if blocks else 0, TILE_ROWS):
            for d, (ids, y) in valid(right.slice(at, TILE_ROWS)).items():
                if d in blocks:
                    blocks[d].meet(ids, y)
        found = [(b.ids[b.found[0]], b.found[2], b.found[1]) for b in blocks.values()] or [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        q, ids, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    out = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    once = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
