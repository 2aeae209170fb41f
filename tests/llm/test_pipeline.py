"""The pipeline's stages on the smallest tables, each against brute force on what it was given."""

import hashlib
import itertools
import re

from tokenizers import Tokenizer

import corpus_pipeline
from telescribe.llm import queries, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def joined(sets):
    """The smallest key reachable by links of 80 percent; empty sets stand alone."""
    top = {k: k for k in sets}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        s, t = sets[a], sets[b]
        if s and t and 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)) and 100 * len(s & t) >= 80 * len(s | t):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}


def cut(texts):
    first = joined({(d, k): frozenset(WORD.findall(lower(line))) for d, t in texts.items() for k, line in enumerate(t.split("\n"))})
    return {d: "\n".join(line for k, line in enumerate(t.split("\n")) if first[d, k] == (d, k)) for d, t in texts.items()}


def copies(texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    return {d: texts[d] for d, first in joined({d: shingles(t) for d, t in texts.items()}).items() if d == first}


def contaminated(texts, bench):
    items = [WORD.findall(lower(t)) for t in bench]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in items if w for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}

    def hit(t):
        w = WORD.findall(lower(t))
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    return {d: t for d, t in texts.items() if not hit(t)}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = toxicity.fit(docs, labels)
    brute = [lambda texts: {d: t for d, t in texts.items() if index.score(t)[0] < 0.5}, cut, copies, lambda texts: contaminated(texts, bench)]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], brute):
        texts = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert {r.doc_id: r.text for r in rows} == want(texts), name
        assert name != "line dedup" or all(r.n_chars == len(r.text) for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    own = Tokenizer.from_file(queries.tokenizer_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in corpus_pipeline.encode(spark, docs, SF).collect():
        ids = own.encode(texts.pop(r.doc_id), add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
    assert not texts


def test_toxic_documents_go_by_their_own_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    assert sum((d in left) == (y == 0) for d, y in known.items()) >= 0.8 * len(known)
    none = docs.selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")
    assert corpus_pipeline.drop_toxic(spark, none.unionByName(docs), SF).count() == 2 * len(left)
