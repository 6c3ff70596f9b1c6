"""Table layouts and the schema contract check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_STR, _INT, _LONG, _DBL, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()

# The listing columns in store order, with their types.
LISTING = T.StructType(
    [
        T.StructField("id", _LONG),
        T.StructField("name", _STR),
        T.StructField("tracker", _STR),
        T.StructField("details_url", _STR),
        T.StructField("download_url", _STR),
        T.StructField("magnet", _STR),
        T.StructField("seeders", _INT),
        T.StructField("leechers", _INT),
        T.StructField("size", _LONG),
        T.StructField("published", _TS),
        T.StructField("categories", T.ArrayType(_INT)),
        T.StructField("description", _STR),
        T.StructField("infohash", _STR),
        T.StructField("grabs", _INT),
        T.StructField("files", _INT),
        T.StructField("imdbid", _STR),
        T.StructField("tvdbid", _STR),
        T.StructField("download_volume_factor", _DBL),
        T.StructField("upload_volume_factor", _DBL),
        T.StructField("minimum_ratio", _DBL),
        T.StructField("minimum_seed_time", _INT),
        T.StructField("tmdbid", _STR),
        T.StructField("tvmazeid", _STR),
        T.StructField("traktid", _STR),
        T.StructField("doubanid", _STR),
        T.StructField("rageid", _STR),
        T.StructField("genres", _STR),
        T.StructField("year", _INT),
        T.StructField("poster", _STR),
        T.StructField("author", _STR),
        T.StructField("booktitle", _STR),
        T.StructField("publisher", _STR),
        T.StructField("artist", _STR),
        T.StructField("album", _STR),
        T.StructField("label", _STR),
        T.StructField("track", _STR),
        T.StructField("identity", _STR),
        T.StructField("last_seen", _TS),
        T.StructField("search_managed", T.BooleanType()),
    ]
)

SEARCHES = T.StructType(
    [
        T.StructField("tracker", _STR),
        T.StructField("search_key", _STR),
        T.StructField("identity", _STR),
        T.StructField("last_seen", _TS),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("page_id", _LONG),
        T.StructField("source", _STR),
        T.StructField("url", _STR),
        T.StructField("fetched_at", _TS),
        T.StructField("format", _STR),
        T.StructField("body", _STR),
    ]
)

ATTEMPTS = T.StructType(
    [
        T.StructField("source", _STR),
        T.StructField("key", _STR),
        T.StructField("started", _TS),
        T.StructField("ended", _TS),
        T.StructField("error", _STR),
        T.StructField("queue_wait", T.BooleanType()),
    ]
)

EXTERNAL_IDS = ["doubanid", "imdbid", "rageid", "tmdbid", "tvdbid", "tvmazeid", "traktid"]


def default_for(field: T.StructField) -> Column:
    """What a listing column holds when nothing is known: '' rather than NULL, 1 for factors."""
    if field.name in ("download_volume_factor", "upload_volume_factor"):
        value = F.lit(1.0)
    elif isinstance(field.dataType, T.StringType):
        value = F.lit("")
    elif isinstance(field.dataType, T.ArrayType):
        value = F.array()
    elif isinstance(field.dataType, T.BooleanType):
        value = F.lit(False)
    elif isinstance(field.dataType, T.TimestampType) or field.name == "id":
        value = F.lit(None)
    else:
        value = F.lit(0)
    return value.cast(field.dataType)


def conform_listings(df: DataFrame) -> DataFrame:
    """Project df onto the listing schema, filling columns it does not carry."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in have else default_for(f)).alias(f.name)
            for f in LISTING.fields
        ]
    )


class SchemaMismatch(ValueError):
    """A stored table whose layout is not the one this version writes."""


def check_schema(df: DataFrame, expected: T.StructType = LISTING) -> DataFrame:
    """Fail unless every expected column resolves with its type; no Spark job runs."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in expected.fields if f.name not in have]
    wrong = [
        f"{f.name} is {have[f.name].simpleString()}, expected {f.dataType.simpleString()}"
        for f in expected.fields
        if f.name in have and have[f.name].simpleString() != f.dataType.simpleString()
    ]
    if missing or wrong:
        parts = (["missing columns: " + ", ".join(missing)] if missing else []) + wrong
        raise SchemaMismatch(
            "; ".join(parts) + ". The table is never migrated: delete it and let the next ingest rebuild it."
        )
    return df
