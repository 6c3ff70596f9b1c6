"""Captured responses: scan, size guard, charset, preprocessing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.functions.chain import apply_chain
from gleanery.functions.codec import decode_bytes
from gleanery.schema import PAGES

# Fixed value: the largest answer read, in bytes.
MAX_BODY = 32 << 20


def read_pages(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Captured pages as a batch or a file stream. Store them partitioned by source, so that
    each source's rules read only its own files."""
    reader = spark.readStream if streaming else spark.read
    return with_format(reader.schema(PAGES).parquet(path))


def with_format(pages: DataFrame) -> DataFrame:
    """Response format as html, json or xml; HTML unless declared otherwise, whatever the case."""
    kind = F.lower(F.coalesce("format", F.lit("")))
    return pages.withColumn("format", F.when(kind.isin("json", "xml"), kind).otherwise(F.lit("html")))


def split_oversize(pages: DataFrame, max_bytes: int = MAX_BODY, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(pages within the cap, rejects with an error): an oversized answer fails, it is never cut short."""
    size = F.octet_length(F.col(body))
    over = F.coalesce(size > max_bytes, F.lit(False))
    error = F.concat(F.lit("response of "), size.cast("string"), F.lit(f" bytes exceeds {max_bytes}"))
    return pages.filter(~over), pages.filter(over).withColumn("error", error)


def decode_body(pages: DataFrame, raw: str = "raw", charset: str = "charset") -> DataFrame:
    """body and error from bytes; the declared charset (`charset`) overrides any header."""
    decoded = pages.withColumn("__d", decode_bytes(F.col(raw), F.col(charset)))
    return decoded.withColumn("body", F.col("__d.body")).withColumn("error", F.col("__d.error")).drop("__d", raw)


def preprocess(pages: DataFrame, steps: Sequence[dict], now=None, charset: str | None = None) -> DataFrame:
    """Run value filters over the whole body before it is read."""
    return pages.withColumn("body", apply_chain(F.col("body"), steps, now=now, charset=charset))


def no_results(body: Column, message: str | None) -> Column:
    """A JSON or XML answer that carries the source's no-results message has no rows."""
    return F.contains(body, F.lit(message)) if message else F.lit(False)
