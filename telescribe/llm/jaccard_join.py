"""Joins of texts by the Jaccard similarity of their word shingles, in the metric space of the Jaccard distance.

1. Texts of one set of shingles are one; the smallest id stands for it.
2. Pivots. Texts whose sketches share a value propose the one of smallest id as their pivot; a text within half the join's
   radius of a pivot lies in the cell of the nearest one, and all others are pivots of cells of their own. Any two texts
   of a cell are links, by the triangle inequality, so a group of copies is one pivot from here on.
3. Neighbours. Two cells hold a link only if their pivots are no farther apart than both cells' radii and the join's. Such
   pairs of pivots are found exactly, from inverted lists of the shingles that so similar sets must share one of, rare ones
   first, and the distance of full sets. A list of many pivots is a region to be joined by itself (5).
4. Windows. Where two such cells are not linked by their pivots, the texts of one that may reach the other's are sent to
   its region, and those of the other that they may reach stay in it; both by their distances to their pivots.
5. Regions are joined recursively: a small one by comparing full sets; a large one chooses pivots among its own members, each
   member goes to the nearest, and to every other one that its distances do not rule out. A region that does not get
   smaller this way is compared in blocks. No pair within the radius is lost at any step.
6. Components of the links of cells give the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telescribe.llm.common import SPACED_BYTES, Words, bit_sets, bounded, components, discard, grouped, hub_join, lists_array, map_batches, map_rows, mixed, sent, single, slices, written
from telescribe.llm.line_dedup import code_of, ordered_sets
from telescribe.llm.near_dedup import Params as SketchParams
from telescribe.llm.near_dedup import sketches

SetsOf = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Params:
    """k: hashes of a sketch. asked: values of it by which a text looks for a pivot. alike: share of a sketch in common
    from which a pivot is tried. long_list: most pivots of an inverted list that gives pairs. region, hashes: members and
    hashes of a region that one task compares. pivots: most pivots of a larger one. depth: most levels of regions.
    bucket_bits: the table in which shingles are counted for their order has 2 to that many places."""

    shingle: int = 5
    percent: int = 80
    k: int = 16
    asked: int = 6
    alike: float = 0.5
    long_list: int = 400
    region: int = 400
    hashes: int = 1 << 18
    pivots: int = 32
    depth: int = 5
    bucket_bits: int = 22


#: Slack for sums of rounded distances, always on the side of one more comparison.
EPS = 1e-9


def common_sizes(s: list[bytes], t: list[bytes], few: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of sets (sorted 64-bit hashes as bytes) the sizes of intersections and unions; small pairs all at once."""
    total = np.array([len(x) + len(y) for x, y in zip(s, t)], dtype=np.int64) >> 3
    common = np.zeros(len(s), dtype=np.int64)
    small = np.flatnonzero(total <= few)
    both = [x for i in small for x in (s[i], t[i])]
    pair = np.repeat(np.repeat(np.arange(len(small)), 2), np.array([len(x) >> 3 for x in both], dtype=np.int64))
    ranks = np.unique(np.frombuffer(b"".join(both), dtype=np.uint64), return_inverse=True)[1]
    # a set holds a hash once, so one that comes twice in a pair is common to it
    key = np.sort(ranks * max(1, len(small)) + pair)
    common[small] = np.bincount(key[1:][key[1:] == key[:-1]] % max(1, len(small)), minlength=len(small))
    for i in np.flatnonzero(total > few):
        common[i] = len(np.intersect1d(np.frombuffer(s[i], dtype=np.uint64), np.frombuffer(t[i], dtype=np.uint64), assume_unique=True))
    return common, total - common


def measured(pairs: DataFrame, sets_of: SetsOf, most: float) -> DataFrame:
    """(a, b, d) of the pairs (a, b) whose distance is at most most, written."""
    sets = written(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("s_b")), "b")

    def rows(cols):
        a, b, s, t = cols
        common, union = common_sizes(s, t)
        d = 1 - common / union
        for i in np.flatnonzero(d <= most + EPS).tolist():
            yield a[i], b[i], float(d[i])

    out = written(map_rows(both.select("a", "b", "s_a", "s_b"), rows, "a bigint, b bigint, d double", chunk=64), "measured")
    discard(sets)
    return out


def cells(reps: DataFrame, sets_of: SetsOf, total: int, p: Params) -> DataFrame:
    """(id, pivot, d), written: texts within half the join's radius of a pivot, with the nearest; every other text is a pivot."""
    half = (1 - p.percent / 100) / 2
    held = reps.select(F.col("doc_id").alias("id"), "n", "sketch", F.explode(F.slice("sketch", 1, p.asked)).alias("value"))
    # the smallest id of each list asks all others
    first = held.groupBy("value").agg(F.min(F.struct("id", "n", "sketch")).alias("x"), F.count("*").alias("rows")).where("rows > 1")
    tried = hub_join(held, first, ["value"], total * p.asked).where("id <> x.id")
    sized = F.least("n", "x.n") >= F.greatest("n", "x.n") * (1 - half - EPS)
    alike = F.size(F.array_intersect("sketch", "x.sketch")) >= p.alike * F.least(F.size("sketch"), F.size("x.sketch"))
    pairs = written(tried.where(sized & alike).select(F.col("id").alias("a"), F.col("x.id").alias("b")).distinct(), "tried")
    near = measured(pairs, sets_of, half)
    # a text that has a pivot is none itself
    taken = near.select(F.col("a").alias("b")).distinct()
    own = near.join(taken, "b", "left_anti").groupBy("a").agg(F.min(F.struct("d", "b")).alias("x"))
    out = written(own.select(F.col("a").alias("id"), F.col("x.b").alias("pivot"), F.col("x.d").alias("d")), "cells")
    discard(pairs, near)
    return out


def token_codes(texts: DataFrame, p: Params) -> np.ndarray:
    """How many texts hold a shingle of each bucket, over all texts, in 16 bits of the same order."""
    size, segments = 1 << p.bucket_bits, 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0, 1 << 21):
                counts += np.bincount(bucket(np.concatenate(Words(part.column(0), SPACED_BYTES).shingles(p.shingle)), p), minlength=size)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(segments), pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in np.split(counts, segments)], pa.binary())], names=["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now = np.frombuffer(counts, dtype=np.uint32).astype(np.int64)
                sums[segment] = sums[segment] + now if segment in sums else now
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([code_of(x).tobytes() for x in sums.values()], pa.binary())], names=["segment", "counts"])

    schema = "segment int, counts binary"
    # a table a task, so few tasks
    few = bounded(texts).select("text").coalesce(2 * texts.sparkSession.sparkContext.defaultParallelism)
    out = np.zeros((segments, size // segments), dtype=np.uint16)
    for r in few.mapInArrow(count, schema).repartition("segment").mapInArrow(add, schema).collect():
        out[r.segment] = np.frombuffer(r.counts, dtype=np.uint16)
    return out.reshape(-1)


def bucket(hashes: np.ndarray, p: Params) -> np.ndarray:
    return (hashes >> np.uint64(64 - p.bucket_bits)).astype(np.int64)


def prefixes(texts: DataFrame, radius: float, p: Params) -> DataFrame:
    """(id, n, radius, often, prefix), written: the shingles of which a pivot shares one with every pivot near enough, rare
    ones first; often: place of the first that more than long_list pivots may hold. radius: of the largest cell."""
    codes = texts.sparkSession.sparkContext.broadcast(token_codes(texts, p))
    from_code = code_of(np.array([p.long_list + 1]))[0]
    share = p.percent / 100 - radius

    def rows(batch):
        sets = Words(batch.column(1), SPACED_BYTES).shingles(p.shingle)
        n = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        text = np.repeat(np.arange(len(n)), n)
        # every text here has shingles; distinct already, they are only put in order
        tokens, starts = ordered_sets(flat, text, codes.value[bucket(flat, p)])
        own = batch.column(2).to_numpy()
        size = np.minimum(n, n - np.ceil(n * (share - own) - EPS).astype(np.int64) + 1)
        ahead = np.arange(len(tokens)) - np.repeat(starts, n) < np.repeat(size, n)
        tokens = tokens[ahead]
        seldom = codes.value[bucket(tokens, p)] < from_code
        often = np.add.reduceat(seldom.astype(np.int32), np.concatenate(([0], np.cumsum(size)[:-1])))
        return {"id": batch.column(0), "n": n, "radius": batch.column(2), "often": often, "prefix": lists_array(tokens.view(np.int64), size)}

    out = map_batches(texts.select("doc_id", "text", "radius"), rows, "id bigint, n int, radius double, often int, prefix array<bigint>", 1)
    return written(out, "prefixes")


def met(rows: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) of rows (token, id, n, place, radius) of one token whose sizes, places and radii allow them to be near."""
    r = 1 - p.percent / 100
    names = ["token", "id", "n", "place", "radius"]

    def found(cols: list[np.ndarray]) -> pa.RecordBatch:
        token, ids, n, place, radius = cols
        begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        left = np.repeat(begin + np.diff(np.append(begin, len(token))), np.diff(np.append(begin, len(token)))) - np.arange(len(token)) - 1
        out, at, step = [], np.flatnonzero(left > 0), 1
        # the row that many places on, for all lists at once
        while len(at):
            to = at + step
            near = 1 - (radius[at] + radius[to] + r)
            good = np.minimum(n[at], n[to]) >= np.maximum(n[at], n[to]) * near - EPS
            good &= np.minimum(n[at] - place[at], n[to] - place[to]) * (1 + near) >= (n[at] + n[to]) * near - EPS
            out.append((ids[at[good]], ids[to[good]]))
            step += 1
            at = at[left[at] >= step]
        a, b = (np.concatenate([x[k] for x in out] or [np.empty(0, np.int64)]) for k in (0, 1))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.RecordBatch.from_arrays([pa.array(a[new], pa.int64()), pa.array(b[new], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            now = [np.concatenate((x, y)) for x, y in zip(held, now)] if held else now
            token = now[0]
            # the last token's list may go on in the next batch; lists are no longer than long_list
            last = int(np.searchsorted(token, token[-1])) if len(token) else 0
            held = [x[last:] for x in now]
            if last:
                yield found([x[:last] for x in now])
        if held and len(held[0]):
            yield found(held)

    return bounded(rows).select(*names).repartition("token").sortWithinPartitions("token").mapInArrow(run, "a bigint, b bigint").distinct()


def compare(cols: dict, r: float) -> list[tuple]:
    """(a, b, d) of the members of one region that are near enough and lie in different components.

    Of links only those that join components. Members that are not at home here are not compared with each other, nor
    are those of one block where two blocks meet (apart).
    """
    ids, of, radius, home = cols["id"], cols["of"].copy(), np.array(cols["radius"]), np.array(cols["home"])
    sets = [np.frombuffer(x, dtype=np.uint64) for x in cols["s"]]
    out: list[tuple] = []
    if (of == of[0]).all():
        return out
    top = {x: x for x in of.tolist()}

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    words, place = np.unique(np.concatenate(sets), return_inverse=True)
    n = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    mark = np.zeros(len(words), dtype=np.int64)
    bits = bit_sets(sets)
    for i in np.flatnonzero(home).tolist():
        rest = ((np.arange(len(n)) > i) | ~home) & (of != of[i])
        if cols["apart"]:
            rest &= cols["block"] != cols["block"][i]
        near = 1 - (radius[i] + radius + r)
        at = np.flatnonzero(rest & (np.minimum(n, n[i]) >= np.maximum(n, n[i]) * near - EPS))
        if not len(at):
            continue
        # bits that differ are hashes that differ, of which near sets have few
        differ = np.bitwise_count(bits[at] ^ bits[i][None]).sum(axis=1, dtype=np.int64)
        at = at[differ * (1 + near[at]) <= (n[at] + n[i]) * (1 - near[at]) + EPS]
        if not len(at):
            continue
        mark[place[starts[i] : starts[i] + n[i]]] = 1
        common = np.add.reduceat(mark[place], starts)[at]
        mark[place[starts[i] : starts[i] + n[i]]] = 0
        d = 1 - common / (n[i] + n[at] - common)
        for j, x in zip(at.tolist(), d.tolist()):
            if x > radius[i] + radius[j] + r + EPS:
                continue
            a, b = root(int(of[i])), root(int(of[j]))
            if a != b:
                if x <= r + EPS:
                    top[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j]), x))
    return out


def distances(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """Of each set (a row) to each pivot (a column)."""
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    out = np.empty((len(sets), len(pivots)))
    for k, pivot in enumerate(pivots):
        at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
        common = np.add.reduceat((pivot[at] == flat).astype(np.int64), starts)
        out[:, k] = 1 - common / (n + len(pivot) - common)
    return out


def join_regions(items: DataFrame, sets_of: SetsOf, widest: float, p: Params) -> DataFrame:
    """(a, b, d), written: pairs near enough of members of one region and different components, at least one at home there.

    items: (region, id, n, radius, of, home); a pair is near enough if its distance is at most both radii and the join's.
    widest: the largest radius. Of links (within the join's radius) those that join components are enough.
    """
    r = 1 - p.percent / 100
    names = ["region", "id", "n", "radius", "of", "home"]
    sets = written(sets_of(items.select("id").distinct()), "sets")
    level = written(items.select(*names), "level")
    found: list[DataFrame] = []
    pair = "a bigint, b bigint, d double"
    small = (F.col("size") <= p.region) & (F.col("hashes") <= p.hashes)

    def sized(rows: DataFrame) -> DataFrame:
        homes = F.count_if("home")
        work = homes * (F.count("*") * 2 - homes)
        own = F.sum(F.when(F.col("home"), F.col("n")).otherwise(0))
        out = rows.groupBy("region").agg(F.count("*").alias("size"), F.sum("n").alias("hashes"), homes.alias("homes"), own.alias("own"), work.alias("work"), F.min("of").alias("low"), F.max("of").alias("high"))
        return out.where("low < high and homes > 0").drop("low", "high")

    def compared(rows: DataFrame) -> DataFrame:
        own = rows.join(sets, "id").select(*names, "s")
        return written(grouped(own, ["region"], lambda c: compare(c | {"apart": False}, r), pair), "compared")

    def in_blocks(rows: DataFrame) -> DataFrame:
        """rows: with sized(). Each block of members at home meets each block of the region in one task."""
        parts = lambda n, hashes: F.greatest(F.ceil(n * 2 / p.region), F.ceil(hashes * 2 / p.hashes), F.lit(1)).cast("int")
        rows = rows.withColumns({"inner": parts(F.col("homes"), F.col("own")), "outer": parts(F.col("size") - F.col("homes"), F.col("hashes") - F.col("own"))})
        lot = F.xxhash64("id")
        rows = rows.withColumn("block", F.when(F.col("home"), F.pmod(lot, F.col("inner"))).otherwise(F.col("inner") + F.pmod(lot, F.col("outer"))).cast("int"))
        none = F.array().cast("array<struct<i:int,j:int>>")
        one = F.when(F.col("home"), F.transform(F.sequence(F.col("block"), F.col("inner") + F.col("outer") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))).otherwise(none)
        before = F.least(F.col("block"), F.col("inner")) - 1
        two = F.when(before >= 0, F.transform(F.sequence(F.lit(0), before), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))).otherwise(none)
        spread = rows.select(*names, "block", F.explode(F.concat(one, two)).alias("x"))
        own = spread.select(*names, "block", "x.i", "x.j").join(sets, "id").select(*names, "block", "i", "j", "s")
        return written(grouped(own, ["region", "i", "j"], lambda c: compare(c | {"apart": c["i"][0] != c["j"][0]}, r), pair), "blocks")

    used = [level]
    for depth in range(p.depth + 1):
        size = written(sized(level), "sizes")
        used.append(size)
        if size.where(small).limit(1).count():
            found.append(compared(level.join(size.where(small).select("region"), "region")))
        large = size.where(~small)
        if not large.limit(1).count():
            break
        rows = level.join(large, "region")
        if depth == p.depth:
            found.append(in_blocks(rows))
            break
        # pivots: the first of each of a few parts of a region by hash
        m = F.least(F.lit(p.pivots), F.greatest(F.lit(4), F.ceil(F.col("size") * 2 / p.region))).cast("int")
        parts = F.greatest(F.ceil(F.col("size") * 2 / p.region), F.ceil(F.col("hashes") * 2 / p.hashes)).cast("int")
        lot = F.xxhash64("id", F.lit(depth))
        chosen = rows.groupBy("region", F.pmod(lot, m).alias("cell")).agg(F.min(F.struct(lot.alias("lot"), "id", "n", "radius", "of")).alias("x"), F.first(parts).alias("parts"))
        spread = chosen.select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("x.id").alias("id"), F.col("x.n").alias("n"), F.col("x.radius").alias("radius"), F.col("x.of").alias("of"), F.lit(True).alias("home"), F.col("cell").cast("int").alias("cell"))
        dealt = rows.select("region", F.pmod(F.xxhash64("id", F.lit(-1 - depth)), parts).cast("int").alias("part"), "id", "n", "radius", "of", "home", F.lit(-1).alias("cell"))
        own = dealt.unionByName(spread).join(sets, "id").select("region", "part", "id", "n", "radius", "of", "home", "cell", "s")

        def placed(c: dict, depth: int = depth) -> list[tuple]:
            """Members under the pivots that they may share a pair at: (region, id, n, radius, of, home, d)."""
            cell = np.array(c["cell"])
            heads, rest = np.flatnonzero(cell >= 0), np.flatnonzero(cell < 0)
            if not len(rest):
                return []
            all_sets = [np.frombuffer(x, dtype=np.uint64) for x in c["s"]]
            heads = heads[np.argsort(cell[heads])]
            d = distances([all_sets[i] for i in rest], [all_sets[i] for i in heads])
            nearest = d.argmin(axis=1)
            radius, home = np.array(c["radius"])[rest], np.array(c["home"])[rest]
            reach = d <= (d.min(axis=1) + 2 * (r + radius + widest))[:, None] + EPS
            own = np.arange(len(heads))[None] == nearest[:, None]
            # pairs of members at home meet under the earlier of their two pivots
            reach &= own | ~home[:, None] | (np.arange(len(heads))[None] < nearest[:, None])
            region = mixed(np.uint64(int(c["region"][0]) & (2**64 - 1)) + mixed(cell[heads].astype(np.uint64) + np.uint64(1000 * (depth + 1)))).view(np.int64)
            out = []
            for i, k in zip(*np.nonzero(reach)):
                at = int(rest[i])
                out.append((int(c["region"][0]), int(region[k]), int(c["id"][at]), int(c["n"][at]), float(radius[i]), int(c["of"][at]), bool(home[i] and own[i, k]), float(d[i, k])))
            return out

        schema = "parent bigint, region bigint, id bigint, n int, radius double, of bigint, home boolean, d double"
        below = written(grouped(own, ["region", "part"], placed, schema), "below")
        far = below.where("home").groupBy("region").agg(F.max("d").alias("far"), F.max("radius").alias("wide"))
        # what no member at home is near enough to stays out
        kept = below.join(far, "region").where(F.col("home") | (F.col("d") <= F.col("far") + r + F.col("radius") + F.col("wide") + EPS))
        kept = written(kept.select("parent", *names), "kept")
        work = sized(kept).join(kept.select("region", "parent").distinct(), "region").groupBy(F.col("parent").alias("region")).agg(F.sum("work").alias("after"))
        stuck = written(large.join(work, "region").where("after > 0.7 * work").select("region"), "stuck")
        if stuck.limit(1).count():
            found.append(in_blocks(rows.join(stuck, "region")))
        used += [below, kept, stuck]
        level = kept.join(stuck.select(F.col("region").alias("parent")), "parent", "left_anti").select(*names)
    out = written(reduce(DataFrame.unionByName, found) if found else items.sparkSession.createDataFrame([], pair), "found")
    discard(sets, *used, *found)
    return out


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest id that it reaches by links, itself included).

    Null and empty texts have empty sets and stand alone; a text of fewer words than a shingle has is one shingle. Rows
    with a null id are left out. Rows that repeat an id count as one document, the one with the smallest text. An empty
    table gives an empty one. Ids are whole numbers; other columns are not read.
    """
    p, r = params, 1 - params.percent / 100
    docs = single(df, id_col, text_col)
    seen = written(sketches(docs, SketchParams(shingle=p.shingle, k=p.k), "doc_id", "text").select("doc_id", "n", "digest", "sketch"), "sketches")
    total = seen.count()
    reps = written(seen.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "texts")
    own = seen.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    empty = own.where("digest is null").withColumn("rep", F.col("doc_id")).drop("digest")
    member = written(hub_join(own, reps, ["digest"], total).drop("digest").unionByName(empty), "member")
    sketch = written(seen.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").drop("digest"), "reps")
    discard(seen, reps)

    def sets_of(ids: DataFrame) -> DataFrame:
        def full(batch):
            return {"id": batch.column(0), "s": [s.tobytes() for s in Words(batch.column(1), SPACED_BYTES).shingles(p.shingle)]}

        texts = docs.join(sent(ids.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
        return map_batches(texts.select("doc_id", "text"), full, "id bigint, s binary", 1)

    cell = cells(sketch, sets_of, total, p)
    radii = cell.groupBy(F.col("pivot").alias("id")).agg(F.max("d").alias("radius"), F.count("*").alias("members"))
    pivots = sketch.select(F.col("doc_id").alias("id"), "n").join(cell.select("id"), "id", "left_anti").join(radii, "id", "left")
    pivots = written(pivots.select("id", "n", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("members", F.lit(0)).alias("members")), "pivots")
    discard(sketch)
    widest = pivots.agg(F.max("radius")).first()[0] or 0.0

    texts = docs.join(sent(pivots.select(F.col("id").alias("doc_id"), "radius")), "doc_id")
    prefix = prefixes(texts, widest, p)
    listed = prefix.select("id", "n", "radius", "often", F.posexplode("prefix").alias("place", "token"))
    seldom, often = listed.where("place < often").drop("often"), listed.where("place >= often").drop("often")
    # the shingles of one passage have lists that begin alike; all that do are one region
    long = written(often.groupBy("token").agg(F.count("*").alias("size"), F.min("id").alias("region")).where(F.col("size") > p.long_list).select("token", "region"), "long")
    if long.limit(1).count():
        long_rows = sent(long)
        seldom = seldom.unionByName(often.join(long_rows.drop("region"), "token", "left_anti"))
    else:
        long_rows, seldom = None, seldom.unionByName(often)
    pairs = written(met(seldom, p), "pairs")
    near = measured(pairs, sets_of, r + 2 * widest)
    discard(pairs)

    def linked(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("d") <= r + EPS).select("a", "b")

    if long_rows is not None:
        comp = components(linked(near))
        # of two near members the smaller has its first common shingle early: only such are at home
        near_enough = F.lit(p.percent / 100 - widest) - F.col("radius")
        early = (F.col("n") - F.col("place")) * (1 + near_enough) >= 2 * F.col("n") * near_enough - EPS
        rows = often.join(long_rows, "token").groupBy("region", "id").agg(F.max("n").alias("n"), F.max("radius").alias("radius"), F.bool_or(early).alias("home"))
        rows = rows.join(comp, F.col("id") == F.col("node"), "left").select("region", "id", "n", "radius", F.coalesce("component", "id").alias("of"), "home")
        rows = written(rows, "regions")
        some = rows.groupBy("region").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.bool_or("home").alias("any")).where("low < high and any").select("region")
        more = join_regions(rows.join(sent(some), "region"), sets_of, widest, p)
        discard(comp, rows)
        near = near.unionByName(more)
    discard(long, prefix)

    # cells whose pivots are no link but near enough for one between their texts
    comp = components(linked(near))
    of = lambda x: F.coalesce(F.col(f"{x}_of.component"), F.col(x))
    sides = [pivots.select(F.col("id").alias(x), F.col("radius").alias(f"r_{x}"), F.col("members").alias(f"m_{x}")) for x in "ab"]
    border = near.where(F.col("d") > r + EPS).join(sides[0], "a").join(sides[1], "b").where(F.col("d") <= F.col("r_a") + F.col("r_b") + r + EPS)
    border = border.join(comp.alias("a_of"), F.col("a") == F.col("a_of.node"), "left").join(comp.alias("b_of"), F.col("b") == F.col("b_of.node"), "left")
    border = border.select("a", "b", "d", "r_a", "r_b", "m_a", "m_b", of("a").alias("of_a"), of("b").alias("of_b")).where("of_a <> of_b")
    # the larger cell is the region
    turn = (F.col("m_a") < F.col("m_b")) | ((F.col("m_a") == F.col("m_b")) & (F.col("a") > F.col("b")))
    side = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    border = written(border.select(side("a", "b").alias("region"), side("b", "a").alias("q"), "d", side("r_a", "r_b").alias("r_p"), side("r_b", "r_a").alias("r_q"), side("of_a", "of_b").alias("of_p"), side("of_b", "of_a").alias("of_q")).distinct(), "border")
    edges = linked(near)
    used = [border]
    if border.limit(1).count():
        inside = written(cell.unionByName(pivots.select("id", F.col("id").alias("pivot"), F.lit(0.0).alias("d"))), "inside")
        # d(x, y) >= d(p, q) - d(x, p) - d(y, q)
        guests = border.join(inside.select(F.col("pivot").alias("q"), "id", F.col("d").alias("d_q")), "q").where(F.col("d") - F.col("d_q") <= F.col("r_p") + r + EPS)
        guests = guests.select("region", "id", F.col("of_q").alias("of"), F.lit(False).alias("home"))
        least = border.groupBy("region").agg(F.min(F.col("d") - F.col("r_q")).alias("least"), F.min("of_p").alias("of"))
        hosts = inside.withColumnRenamed("pivot", "region").join(least, "region").where(F.col("d") >= F.col("least") - r - EPS)
        hosts = hosts.select("region", "id", "of", F.lit(True).alias("home"))
        sizes = member.select(F.col("doc_id").alias("id"), F.col("n_shingles").cast("int").alias("n"))
        items = hosts.unionByName(guests.distinct()).join(sizes, "id").select("region", "id", "n", F.lit(0.0).alias("radius"), "of", "home")
        across = join_regions(items, sets_of, 0.0, p)
        to = lambda x: inside.select(F.col("id").alias(x), F.col("pivot").alias(f"p_{x}"))
        edges = edges.unionByName(across.join(to("a"), "a").join(to("b"), "b").select(F.col("p_a").alias("a"), F.col("p_b").alias("b")))
        used += [inside, across]
    best = components(edges)
    found = member.join(cell.select(F.col("id").alias("rep"), "pivot"), "rep", "left").withColumn("rep", F.coalesce("pivot", "rep")).drop("pivot")
    found = found.join(best.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = found.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    discard(*used)
    return out
