"""Licence scans by a positional index of rare licence words, in DataFrame operations only.

Templates are short word sequences with a label and a mandatory key phrase (a span of the sequence). A file
is reduced to the places of licence words, the words that occur in any template. Document frequencies over
the whole corpus give each licence word its inverse document frequency (IDF). For every template the word of
its key phrase with the highest IDF is its anchor. A file's postings meet only those templates whose anchor
it holds; each meeting votes for the place where the template would start, so postings are intersected by
relative position. A place counts if the whole key phrase stands there, and scores the IDF share of the
template's words found at their places. Base templates are their own key phrase, so they count when
every word stands in line; others count from a score of `PASS`.

Defined cases: a null text is an empty one, with no words and score 0. Repeated rows, and rows with equal or
null ids, are scanned each on their own. An empty corpus gives an empty result. Extra columns are not read.
Work is linear in the licence words of a text; postings grow by template words at most.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm.common import LOWER, UPPER, stored, table, text_or_empty

#: Phrases every scan must find, and their labels (fixed values).
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Further templates: words, label, and the span of words that is mandatory.
OWN = [
    ("gnu lesser general public license", "lgpl", (0, 2)),
    ("gnu affero general public license", "agpl", (0, 2)),
    ("mozilla public license", "mpl", (0, 3)),
    ("eclipse public license", "epl", (0, 3)),
    ("boost software license", "bsl", (0, 3)),
    ("licensed under the apache license version", "apache-notice", (3, 5)),
    ("released under the mit license", "mit-notice", (3, 5)),
    ("under the terms of the gnu general public license", "gpl-notice", (5, 9)),
    ("redistribution and use in source and binary forms", "bsd", (4, 8)),
    ("permission is hereby granted free of charge", "mit-text", (0, 4)),
    ("released into the public domain", "public-domain", (3, 5)),
]
#: Share of a template's IDF that must stand in place.
PASS = 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def templates() -> list[tuple[int, str, bool, list[str], tuple[int, int]]]:
    """Number, label, whether base, words and key span of every template."""
    rows = [(words, label, True, (0, len(words.split()))) for words, label in BASE] + [(words, label, False, key) for words, label, key in OWN]
    return [(n, label, base, words.split(), key) for n, (words, label, base, key) in enumerate(rows)]


def postings_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row, id, n_words, hits): the places of licence words in every text, words counted from 0."""
    vocabulary = sorted({w for _, _, _, words, _ in templates() for w in words})

    def hit(word, at):  # noqa: ANN001, ANN202
        small = F.lower(word)
        same = small.isin(vocabulary) & (F.octet_length(small) == F.octet_length(word))  # only A-Z may fold
        return F.when(same, F.struct(at.alias("at"), small.alias("word")))

    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.array_remove(F.split(text_or_empty(text_column), SEPARATORS), "").alias("words"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", F.size("words").cast("long").alias("n_words"), F.array_compact(F.transform("words", hit)).alias("hits"))


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per file: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    files = stored(postings_of(docs, id_column, text_column), "licence-hits")
    total = files.count()
    present = files.select(F.explode(F.array_distinct("hits.word")).alias("word"))
    # One count per template word: as many rows as the vocabulary has words.
    seen = {r.word: r["count"] for r in present.groupBy("word").count().collect()}
    idf = lambda w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 0.01
    index = []
    for n, label, base, words, (first, stop) in templates():
        anchor = max(words[first:stop], key=lambda w: (idf(w), w))
        whole = sum(map(idf, words))
        index += [f"({n}, '{label}', {base}, {stop - first}, '{anchor}', '{w}', {at}, {first <= at < stop}, {idf(w) / whole!r}D)" for at, w in enumerate(words)]
    index = spark.sql(f"SELECT * FROM VALUES {', '.join(index)} AS t(template, label, base, n_key, anchor, word, rel, in_key, share)")
    votes = (
        files.where(F.size("hits") > 0)
        .select("row", F.array_distinct("hits.word").alias("held"), F.explode("hits").alias("hit"))
        .select("row", "held", "hit.word", "hit.at")
        .join(index, "word")
        .where(F.array_contains("held", F.col("anchor")) & (F.col("at") >= F.col("rel")))
    )
    places = (
        votes.groupBy("row", "template", "label", "base", "n_key", (F.col("at") - F.col("rel")).alias("start"))
        .agg(F.sum(F.col("in_key").cast("int")).alias("keys"), F.round(F.sum("share"), 4).alias("score"))
        .where((F.col("keys") == F.col("n_key")) & (F.col("base") | (F.col("score") >= PASS)))
    )
    start = F.when(F.col("base"), F.col("start").cast("long"))
    marked = places.groupBy("row").agg(
        F.count(start).alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    return files.select("row", "id", "n_words").join(marked, "row", "left").select(
        F.col("id").alias(id_column),
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels and places of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


_VALUES = ", ".join(
    f"({n}, '{label}', {base}, {stop - first}, '{w}', {at}, {first <= at < stop})" for n, label, base, words, (first, stop) in templates() for at, w in enumerate(words)
)

OP4_SQL = f"""
WITH files AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), t(template, label, base, n_key, word, rel, in_key) AS (VALUES {_VALUES}),
hits AS MATERIALIZED (
  SELECT rid, word, pos FROM (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM files) WHERE word IN (SELECT word FROM t)
), idf AS (
  SELECT v.word, ln(((SELECT count(*) FROM files) + 1) / (count(DISTINCT rid) + 1)) + 0.01 AS idf
  FROM (SELECT DISTINCT word FROM t) v LEFT JOIN hits USING (word) GROUP BY v.word
), weighed AS (
  SELECT t.*, idf / sum(idf) OVER (PARTITION BY template) AS share FROM t JOIN idf USING (word)
), places AS (
  SELECT rid, template, label, base, pos - rel AS start, round(sum(share), 4) AS score
  FROM hits JOIN weighed USING (word) WHERE pos >= rel
  GROUP BY rid, template, label, base, n_key, pos - rel
  HAVING sum(in_key::INT) = n_key AND (base OR round(sum(share), 4) >= {PASS})
), marked AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM places GROUP BY rid
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM files LEFT JOIN marked USING (rid)
"""
