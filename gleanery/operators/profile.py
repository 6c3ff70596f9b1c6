"""Corpus reports over text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions.redact import token_count

# Characters a reader cannot see: controls, no-break and other odd spaces, zero-width marks, BOM.
HIDDEN = r"[\x00-\x1F\x7F-\xA0\u00AD\u1680\u180E\u2000-\u200F\u2028-\u202F\u205F-\u2064\u3000\uFEFF]"


def char_profile(df: DataFrame, column: str) -> DataFrame:
    """(code_point, occurrences, values): hidden characters of a text column and how many values hold them.

    Only the hidden characters are exploded, one row per distinct one and value.
    """
    found = F.regexp_extract_all(F.col(column), F.lit(f"({HIDDEN})"), F.lit(1))
    per_value = df.select(found.alias("f")).filter(F.size("f") > 0)
    counted = per_value.select(F.explode(F.array_distinct("f")).alias("ch"), "f")
    times = F.size(F.filter("f", lambda c: c == F.col("ch")))
    return (
        counted.select(F.ascii("ch").alias("code_point"), times.alias("times"))
        .groupBy("code_point")
        .agg(F.sum("times").alias("occurrences"), F.count("*").alias("values"))
    )


def redaction_report(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, rows, tokens): values that hold a secret-looking token, and how many they hold."""
    counts = F.array(*[F.struct(F.lit(c).alias("column"), token_count(F.col(c)).alias("n")) for c in columns])
    flat = df.select(*by, F.inline(counts))
    return flat.groupBy(*by, "column").agg(F.count_if(F.col("n") > 0).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
