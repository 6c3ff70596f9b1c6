"""Writing feeds and JSON results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.operators.render import results_json


def write_feed(channels: DataFrame, path: str) -> None:
    """One channel element per request, as compressed XML files; `_` fields are attributes."""
    (
        channels.select(F.col("request_id").alias("_request"), "response", "item")
        .write.format("xml")
        .option("rootTag", "rss")
        .option("rowTag", "channel")
        .option("attributePrefix", "_")
        .option("valueTag", "_VALUE")
        .option("compression", "gzip")
        .save(path)
    )


def feed_xml(channels: DataFrame) -> DataFrame:
    """(request_id, xml): the channel as text, for serving from a table."""
    channel = F.struct("response", "item")
    options = {"rowTag": "channel", "attributePrefix": "_", "valueTag": "_VALUE"}
    return channels.select("request_id", F.to_xml(channel, options).alias("xml"))


def write_results(rendered: DataFrame, path: str) -> None:
    """One JSON object per line, in compressed files: the names of some forty fields in every line are most of their length."""
    results_json(rendered).write.option("compression", "gzip").text(path)


def read_feed_items(pages_xml: DataFrame, column: Column, schema: str) -> DataFrame:
    """Items of feed documents held in a column."""
    return pages_xml.select("*", F.from_xml(column, schema).alias("parsed"))
