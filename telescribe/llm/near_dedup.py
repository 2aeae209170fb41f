"""MinHash near-duplicates by bottom-k sketches of one hash function, confirmed on full shingle sets.

1. Every text gives its set of shingle hashes, the set's digest and its k smallest hashes (the sketch).
2. Texts of one digest are one class; the smallest id stands for it.
3. The retained values of the representatives form inverted lists. Short lists give all their pairs; long ones (frequent
   shingles, large groups) give only pairs with the list's first member, so a group of n copies costs n pairs, not n^2.
4. Pairs whose union sketch cannot reach the threshold go; the rest are confirmed on the full sets.
5. Texts made up mostly of frequent shingles could match inside long lists only. Once the confirmed links have joined
   most of such a group, blocks of its full sets are compared, and only links between different components come out.
6. Components of the confirmed links give the classes.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telescribe.llm.common import SPACED_BYTES, Words, components, confirmed, dense_links, discard, hub_join, lists_array, map_batches, map_rows, sent, single, written

@dataclass(frozen=True)
class Params:
    """k: hashes retained. long_list: members from which a list counts as long. first: short-list values used of a
    sketch with few long lists. frequent: share of long-list values from which a text takes part in step 5.
    floor: estimated similarity below which a pair goes; it is six standard errors below the threshold."""

    shingle: int = 2
    percent: int = 80
    k: int = 64
    long_list: int = 40
    first: int = 12
    frequent: float = 0.65
    floor: float = 0.5


def sketches(df: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, digest, sketch, bits0..3): set size, digest of the set (null for an empty one), its k smallest hashes,
    and 256 bits with one set by each of these."""

    def rows(batch):
        sets = Words(batch.column(1), SPACED_BYTES).shingles(p.shingle)
        small = [s[: p.k] for s in sets]
        sizes = np.array([len(s) for s in small])
        flat = np.concatenate(small)
        bits = np.zeros((len(sets), 4), dtype=np.uint64)
        np.bitwise_or.at(bits, (np.repeat(np.arange(len(sets)), sizes), ((flat >> np.uint64(6)) & np.uint64(3)).astype(np.int64)), np.uint64(1) << (flat & np.uint64(63)))
        return {f"bits{i}": np.ascontiguousarray(bits[:, i]).view(np.int64) for i in range(4)} | {
            "doc_id": batch.column(0),
            "n": [len(s) for s in sets],
            "digest": [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "sketch": lists_array(flat.view(np.int64), sizes),
        }

    return map_batches(df.select(id_col, text_col), rows, "doc_id bigint, n bigint, digest binary, sketch array<bigint>, bits0 bigint, bits1 bigint, bits2 bigint, bits3 bigint", 1)


def hopeful(pairs: DataFrame, sketch: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose sizes allow the threshold and whose union sketch estimates at least the floor."""
    one = sketch.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    two = sketch.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    both = pairs.join(one, "a").join(two, "b")
    both = both.where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * p.percent) & F.arrays_overlap("s_a", "s_b"))

    def rows(cols):
        for a, b, s, t in zip(*cols):
            s, t = np.array(s, dtype=np.int64).view(np.uint64), np.array(t, dtype=np.int64).view(np.uint64)
            union = np.union1d(s, t)[: p.k]
            common = np.intersect1d(s, t, assume_unique=True)
            if np.isin(union, common, assume_unique=True).sum() >= p.floor * len(union):
                yield a, b

    return map_rows(both.select("a", "b", "s_a", "s_b"), rows, "a bigint, b bigint")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest id reachable by links), kept (it is that one).

    Null and empty texts have empty sets and stand alone. Rows with a null id are left out. Rows that repeat an id count
    as one document, the one with the smallest text. An empty table gives an empty one. Ids are integers; other
    columns are not read.
    """
    p = params
    docs = single(df, id_col, text_col)
    seen = written(sketches(docs, p, "doc_id", "text"), "sketches")
    reps = written(seen.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "texts")
    total = seen.count()
    own = seen.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    empty = own.where("digest is null").withColumn("rep", F.col("doc_id")).drop("digest")
    member = written(hub_join(own, reps, ["digest"], total).drop("digest").unionByName(empty), "member")
    sketch = written(seen.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").drop("digest"), "reps")
    discard(seen, reps)
    bits = [f"bits{i}" for i in range(4)]

    held = sketch.select("doc_id", F.explode("sketch").alias("value"))
    sizes = held.groupBy("value").agg(F.count("*").alias("size")).where("size > 1").withColumn("rows", F.col("size"))
    per_doc = hub_join(held, sizes, ["value"], total * p.k).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("size") <= p.long_list, F.col("value")))).alias("short"),
        F.collect_list(F.when(F.col("size") > p.long_list, F.col("value"))).alias("long"),
    )
    per_doc = per_doc.join(sketch.select("doc_id", "n", F.size("sketch").alias("k"), *bits), "doc_id")
    # similar texts share one of the first values of all; if it is in no short list, the long ones need hold no others
    used = F.array_intersect("long", F.slice(F.sort_array(F.concat("short", "long")), 1, p.first))
    few = F.size("long") * 4 <= F.col("k")
    per_doc = written(
        per_doc.select(F.col("doc_id").alias("id"), F.when(few, F.slice("short", 1, p.first)).otherwise(F.col("short")).alias("short"), "n", "k", *bits, used.alias("long"), (F.size("long") >= p.frequent * F.col("k")).alias("frequent")),
        "values",
    )
    short = per_doc.select("id", "n", "k", *bits, F.explode("short").alias("value"))
    # sketches that share enough values for the floor differ in few bits
    differ = sum(F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in bits)
    close = differ <= F.col("x.k") + F.col("y.k") - 2 * p.floor * F.greatest("x.k", "y.k")
    sized = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * p.percent
    pairs = short.alias("x").join(short.alias("y"), "value").where((F.col("x.id") < F.col("y.id")) & sized & close).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    long = written(per_doc.where("frequent").select("id", "n", F.explode("long").alias("value")), "long")
    heads = long.groupBy("value").agg(F.min("id").alias("a"))
    stars = long.join(heads, "value").where("a < id").select("a", F.col("id").alias("b"))

    def sets_of(ids: DataFrame) -> DataFrame:
        def full(batch):
            return {"id": batch.column(0), "s": [s.tobytes() for s in Words(batch.column(1), SPACED_BYTES).shingles(p.shingle)]}

        own = docs.join(sent(ids.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
        return map_batches(own.select("doc_id", "text"), full, "id bigint, s binary", 1)

    hopes = written(hopeful(pairs.unionByName(stars).distinct(), sketch, p), "hopes")
    discard(per_doc, sketch)
    links = confirmed(hopes, sets_of, p.percent)
    discard(hopes)
    if long.limit(1).count():
        links = links.unionByName(dense_links(long, links, sets_of, p.percent))
    discard(long)
    best = components(links).select(F.col("node").alias("rep"), "component")
    out = member.join(best, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """df without the documents that classes() does not keep; all columns stay, whatever their names, as do null ids."""
    gone = classes(df, id_col, text_col, params).where("not kept").select(F.col("doc_id").alias("copy"))
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("bigint").alias("id"))
    return row.join(gone, F.col("id") == F.col("copy"), "left_anti").select("row.*")
