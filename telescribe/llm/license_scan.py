"""License scans with DataFrame operations only: phrases word by word, and template containment as a set-similarity join.

Text blocks are the lines, and every two lines that follow each other, as licenses are often wrapped. The templates'
tokens are put in order of how many text blocks hold them. A block that holds enough of a template
holds one of its rarest tokens, so an inverted list of these prefixes, with length and positional filters, finds every
block to confirm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telescribe.llm.common import written

#: Base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Templates, as words in lower case, and their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution license", "cc-by"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("all rights reserved", "all-rights-reserved"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words and what separates them, before A-Z are lower-cased.
WORD, GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def starts(found: Column, phrase: str) -> Column:
    """Places (from 0) at which the phrase's words stand in an array of words."""
    wanted = phrase.split()
    fits = lambda i: _all([F.get(found, i + k) == w for k, w in enumerate(wanted)])
    return F.when(F.size(found) >= len(wanted), F.filter(F.sequence(F.lit(0), F.size(found) - len(wanted)), fits)).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def templates_table(spark, templates, threshold: float) -> DataFrame:
    """(template, label, tokens, needed): distinct tokens and how many of them a block must hold."""
    rows = []
    for i, (text, label) in enumerate(templates):
        tokens = sorted(set(text.split()))
        needed = next(n for n in range(len(tokens) + 1) if n >= threshold * len(tokens))
        rows.append(F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.array(*map(F.lit, tokens)).alias("tokens"), F.lit(needed).alias("needed")))
    return spark.range(1, numPartitions=1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    n_base counts all places of the phrases, first_word and last_word are their smallest and largest start. labels adds
    those of templates of which a line (cut at line feeds), or a line and the next, neither without any of the templates'
    words, hold threshold of the tokens or more. score is the largest
    share of a template's tokens among these, 1 where a phrase stands, else 0. Null and empty texts have no words;
    repeated rows are judged apart; null ids stay; other columns are not read.
    """
    spark = df.sparkSession
    vocabulary = F.array(*map(F.lit, sorted({w for t, _ in templates for w in t.split()})))
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.transform(F.split(text, "\n"), words)
    found = df.select(F.col(id_col).alias("doc_id"), text.alias("_text"), lines.alias("_lines"))
    likely = "(?i)" + "|".join(GAP.join(p.split()) for p, _ in phrases)
    place = F.when(F.col("_text").rlike(likely), F.transform(F.flatten("_lines"), lambda w: F.translate(w, UPPER, LOWER)))
    hits = F.transform("_lines", lambda line: F.array_intersect(F.transform(line, lambda w: F.translate(w, UPPER, LOWER)), vocabulary))
    found = found.select(
        "doc_id",
        F.aggregate("_lines", F.lit(0).cast("bigint"), lambda n, line: n + F.size(line)).alias("n_words"),
        place.alias("_words"),
        hits.alias("_lines"),
    )
    some = lambda h: F.size(h) > 0
    both = lambda a, b: F.when(some(a) & some(b), F.array_union(a, b)).otherwise(F.array().cast("array<string>"))
    pairs = F.when(F.exists("_lines", some), F.zip_with(F.slice("_lines", 1, F.size("_lines") - 1), F.slice("_lines", 2, F.size("_lines")), both))
    found = found.withColumn("_hits", F.filter(F.concat("_lines", F.coalesce(pairs, F.array().cast("array<array<string>>"))), some))
    at = [F.when(F.col("_words").isNotNull(), starts(F.col("_words"), p)).otherwise(F.array().cast("array<int>")).alias(f"_at{i}") for i, (p, _) in enumerate(phrases)]
    found = found.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "n_words", "_hits", *at)
    found = written(found, "license")

    blocks = found.select("_row", F.posexplode("_hits").alias("_line", "tokens"))
    often = blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    table = templates_table(spark, templates, threshold)
    ranked = table.select("template", F.explode("tokens").alias("token")).join(often, "token", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")))
    table = table.join(ranked.groupBy("template").agg(order.alias("ordered")), "template").withColumn("ordered", F.col("ordered.token"))
    # one of the first size - needed + 1 tokens must be there; the lists are as many as the templates have tokens
    prefix = F.slice("ordered", F.lit(1), F.size("ordered") - F.col("needed") + 1)
    inverted = table.select("template", "label", "ordered", "needed", F.posexplode(prefix).alias("place", "token"))
    pairs = blocks.select("_row", "tokens", F.explode("tokens").alias("token")).join(F.broadcast(inverted), "token")
    room = (F.size("tokens") >= F.col("needed")) & (F.size("ordered") - F.col("place") >= F.col("needed"))
    common = F.array_intersect("ordered", "tokens")
    # a block meets a template once for each prefix token it holds; the first of them speaks for the pair
    pairs = pairs.where(room).select("_row", "token", "label", "needed", "ordered", common.alias("common"))
    pairs = pairs.where((F.size("common") >= F.col("needed")) & (F.get("common", F.lit(0)) == F.col("token")))
    own = pairs.groupBy("_row").agg(F.collect_set("label").alias("_labels"), F.max(F.size("common") / F.size("ordered")).alias("_share"))

    every = F.concat(*[F.col(f"_at{i}") for i in range(len(phrases))])
    base = F.array_compact(F.array(*[F.when(F.size(f"_at{i}") > 0, label) for i, (_, label) in enumerate(phrases)]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    none = F.array().cast("array<string>")
    return found.join(own, "_row", "left").select(
        "doc_id",
        "n_words",
        F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.coalesce("_labels", none))).alias("labels"),
        F.when(F.size(every) > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )
