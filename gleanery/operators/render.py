"""Listings as feed items and JSON results: nested projections, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions.coerce import trim_space
from gleanery.functions.dates import feed_date
from gleanery.functions.text import number_text
from gleanery.operators.taxonomy import supported_categories

TORRENT_TYPE = "application/x-bittorrent"  # fixed value

# Optional attributes in feed order, name -> listing column.
TEXT_ATTRIBUTES = {
    "tvdbid": "tvdbid",
    "tmdbid": "tmdbid",
    "tvmazeid": "tvmazeid",
    "traktid": "traktid",
    "doubanid": "doubanid",
    "rageid": "rageid",
    "genre": "genres",
    "coverurl": "poster",
    "author": "author",
    "booktitle": "booktitle",
    "publisher": "publisher",
    "artist": "artist",
    "album": "album",
    "label": "label",
    "track": "track",
}


def imdb_number(digits: Column) -> Column:
    width = F.greatest(F.length(digits), F.lit(7))
    return F.when(digits == "", F.lit("")).otherwise(F.lpad(digits, width, "0"))


def imdb_id(digits: Column) -> Column:
    return F.when(digits == "", F.lit("")).otherwise(F.concat(F.lit("tt"), imdb_number(digits)))


def _attribute(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))


def attributes() -> Column:
    """array<struct<name, value>> of a listing; peers is the whole swarm."""
    categories = F.transform("categories", lambda c: F.struct(F.lit("category").alias("name"), c.cast("string").alias("value")))
    always = F.array(
        _attribute("seeders", F.col("seeders")),
        _attribute("leechers", F.col("leechers")),
        _attribute("peers", F.col("seeders") + F.col("leechers")),
        _attribute("size", F.col("size")),
        _attribute("grabs", F.col("grabs")),
        _attribute("downloadvolumefactor", number_text(F.col("download_volume_factor"))),
        _attribute("uploadvolumefactor", number_text(F.col("upload_volume_factor"))),
    )

    def positive(name: str, column: str, text: Column | None = None) -> Column:
        return _attribute(name, F.when(F.col(column) > 0, text if text is not None else F.col(column).cast("string")).otherwise(F.lit("")))

    optional = F.array(
        _attribute("magneturl", F.col("magnet")),
        _attribute("infohash", F.col("infohash")),
        _attribute("imdb", imdb_number(F.col("imdbid"))),
        _attribute("imdbid", imdb_id(F.col("imdbid"))),
        *[_attribute(name, F.col(column)) for name, column in TEXT_ATTRIBUTES.items()],
        positive("year", "year"),
        positive("files", "files"),
        positive("minimumratio", "minimum_ratio", number_text(F.col("minimum_ratio"))),
        positive("minimumseedtime", "minimum_seed_time"),
    )
    return F.concat(categories, always, F.filter(optional, lambda a: a["value"] != ""))


def guid() -> Column:
    return F.when(F.col("details_url") != "", F.col("details_url")).otherwise(F.col("name"))


def summary() -> Column:
    return F.when(F.col("description") != "", F.col("description")).otherwise(F.col("name"))


def client_link(base: str, api_key: str = "", owner: str = "tracker") -> Column:
    """What a client fetches: the magnet when there is no file link, else our own download address."""
    escaped = F.replace(F.replace(F.url_encode(F.col(owner)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for code, char in (("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@"), ("%7E", "~")):
        escaped = F.replace(escaped, F.lit(code), F.lit(char))
    link = F.concat(F.lit(f"{base}/api/v2.0/indexers/"), escaped, F.lit("/download/"), F.col("id").cast("string"))
    if api_key:
        link = F.concat(link, F.lit("?apikey="), F.url_encode(F.lit(api_key)))
    return (
        F.when(F.col("download_url") == "", F.col("magnet"))
        .when(F.col("download_url").startswith("magnet:"), F.col("download_url"))
        .otherwise(link)
    )


def feed_items(listings: DataFrame, base: str, now, api_key: str = "") -> DataFrame:
    """One `item` struct per listing, beside the listing's own columns."""
    link = client_link(base, api_key)
    item = F.struct(
        F.col("name").alias("title"),
        F.struct((F.col("details_url") != "").alias("_isPermaLink"), guid().alias("_VALUE")).alias("guid"),
        link.alias("link"),
        F.col("details_url").alias("comments"),
        feed_date(F.col("published"), now).alias("pubDate"),
        F.transform("categories", lambda c: c.cast("string")).alias("category"),
        summary().alias("description"),
        F.struct(F.col("size").alias("_length"), F.lit(TORRENT_TYPE).alias("_type"), link.alias("_url")).alias("enclosure"),
        F.transform(attributes(), lambda a: F.struct(a["name"].alias("_name"), a["value"].alias("_value"))).alias("attr"),
    )
    return listings.withColumn("item", item)


def feed(pages: DataFrame, base: str, now, api_key: str = "") -> DataFrame:
    """One channel per request, items in page order.

    pages: request_id, rank, total, offset and the listing columns; a page is bounded by the
    feed limit, so a channel is small however large the result set.
    """
    items = feed_items(pages, base, now, api_key)
    return items.groupBy("request_id").agg(
        F.struct(F.first("offset").alias("_offset"), F.first("total").alias("_total")).alias("response"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda i: i["item"]).alias("item"),
    )


def gain() -> Column:
    """Seeders times gibibytes; NULL for an unknown size."""
    return F.when(F.col("size") != 0, F.col("seeders").cast("double") * F.col("size").cast("double") / F.lit(float(1 << 30)))


def result_genres() -> Column:
    return F.filter(F.transform(F.split("genres", ","), trim_space), lambda g: g != "")


def category_desc(names: Column) -> Column:
    """Names of a listing's categories from a map id -> name, unknown ids skipped."""
    found = F.transform("categories", lambda c: F.coalesce(F.try_element_at(names, c), F.lit("")))
    return F.array_join(F.filter(found, lambda n: n != ""), ", ")


def enrich(listings: DataFrame, sources: DataFrame, mappings: DataFrame, tax: DataFrame) -> DataFrame:
    """Display name (falling back to the id), source type and category names.

    The category names are at most the 71 standard ones, folded into one constant map.
    """
    names = supported_categories(mappings, tax).agg(F.map_from_entries(F.collect_list(F.struct("id", "name"))).alias("m"))
    owner = sources.select(F.col("id").alias("tracker"), F.col("name").alias("__name"), F.col("type").alias("tracker_type"))
    return (
        listings.join(owner, "tracker", "left")
        .withColumn("tracker_name", F.coalesce("__name", "tracker"))
        .withColumn("tracker_type", F.coalesce("tracker_type", F.lit("")))
        .withColumn("__names", names.scalar())
        .withColumn("category_desc", category_desc(F.col("__names")))
        .drop("__name", "__names")
    )


def results(enriched: DataFrame, base: str, api_key: str = "") -> DataFrame:
    """The JSON result columns; peers here are the leechers, and zero means not known for optional numbers."""

    def optional(name: str) -> Column:
        return F.when(F.col(name) != 0, F.col(name))

    def external(name: str) -> Column:
        return F.when(F.col(name).rlike("^[+-]?[0-9]+$"), F.col(name).try_cast("bigint"))

    none = F.array().cast("array<string>")
    columns = {
        "Album": F.col("album"), "Artist": F.col("artist"), "Author": F.col("author"), "BookTitle": F.col("booktitle"),
        "Category": F.coalesce("categories", F.array().cast("array<int>")),
        "CategoryDesc": F.col("category_desc"), "Comments": F.col("details_url"), "Description": summary(),
        "Details": F.col("details_url"), "DoubanId": external("doubanid"),
        "DownloadVolumeFactor": F.col("download_volume_factor"), "Files": optional("files"), "Guid": guid(),
        "Gain": gain(), "Genres": result_genres(), "Grabs": optional("grabs"), "Imdb": external("imdbid"),
        "InfoHash": F.col("infohash"), "Label": F.col("label"), "Languages": none, "Link": client_link(base, api_key),
        "MagnetUri": F.col("magnet"), "MinimumRatio": optional("minimum_ratio"),
        "MinimumSeedTime": optional("minimum_seed_time"), "Peers": F.col("leechers"), "Poster": F.col("poster"),
        "PublishDate": F.coalesce(F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")),
        "Publisher": F.col("publisher"), "RageID": external("rageid"), "Seeders": F.col("seeders"),
        "Size": optional("size"), "Subs": none, "TMDb": external("tmdbid"), "TVDBId": external("tvdbid"),
        "TVMazeId": external("tvmazeid"), "Title": F.col("name"), "Track": F.col("track"),
        "Tracker": F.col("tracker_name"), "TrackerId": F.col("tracker"), "TrackerType": F.col("tracker_type"),
        "TraktId": external("traktid"), "UploadVolumeFactor": F.col("upload_volume_factor"), "Year": optional("year"),
    }
    return enriched.select(*[c.alias(n) for n, c in columns.items()])


def results_json(rendered: DataFrame) -> DataFrame:
    """One JSON object per result, absent numbers written as null."""
    return rendered.select(F.to_json(F.struct(*rendered.columns), {"ignoreNullFields": "false"}).alias("json"))
