"""Feeds and JSON results over the catalogue."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gleanery import fixtures as fx
from gleanery.operators import extract, render, search as s, taxonomy as tax
from gleanery.plans import sql
from gleanery.plans.asking import source_table
from gleanery.plans.registry import joined, query, stamp
from gleanery.schema import LISTING, default_for
from gleanery.sources import feeds
from gleanery.sources.rules import read_document

NOW = datetime(2002, 1, 15, 12, 30, 0)
BASE = "https://proxy.invalid"


def full_listings(spark, sf):
    """The catalogue with every listing column, unknown ones at their defaults; the id is a number."""
    return in_full(fx.listings(spark, sf))


def in_full(L, *more):
    """Rows of the catalogue with every listing column, and some columns more."""
    L = L.withColumn("id", F.xxhash64("tracker", "identity"))
    have = set(L.columns)
    made = {
        "download_url": F.when(F.col("details_url") != "", F.concat("details_url", F.lit("/get"))).otherwise(F.lit("")),
        "magnet": F.when(F.col("infohash") != "", F.concat(F.lit("magnet:?xt=urn:btih:"), "infohash")).otherwise(F.lit("")),
        "grabs": F.col("leechers") * 3,
        "download_volume_factor": F.when(F.col("leechers") % 2 == 0, F.lit(0.5)).otherwise(F.lit(1.0)),
        "genres": F.when(F.col("leechers") == 1, F.lit("Drama, Sci Fi ,")).otherwise(F.lit("")),
        "year": F.when(F.col("leechers") > 5, F.lit(1999)).otherwise(F.lit(0)),
    }
    return L.select(
        *[(F.col(f.name) if f.name in have else made.get(f.name, default_for(f))).cast(f.dataType).alias(f.name) for f in LISTING.fields], *more
    )


ATTRS = """list_concat(list_transform(categories, lambda c: 'category=' || c), list_filter(['seeders=' || seeders, 'leechers=' || leechers, 'peers=' || (seeders + leechers),
  'size=' || size, 'grabs=' || (leechers * 3), 'downloadvolumefactor=' || CASE WHEN leechers % 2 = 0 THEN '0.5' ELSE '1' END, 'uploadvolumefactor=1',
  CASE WHEN infohash != '' THEN 'magneturl=magnet:?xt=urn:btih:' || infohash END, CASE WHEN infohash != '' THEN 'infohash=' || infohash END,
  CASE WHEN imdbid != '' THEN 'imdb=' || imdbid END, CASE WHEN imdbid != '' THEN 'imdbid=tt' || imdbid END, CASE WHEN tvdbid != '' THEN 'tvdbid=' || tvdbid END,
  CASE WHEN leechers = 1 THEN 'genre=Drama, Sci Fi ,' END, CASE WHEN leechers > 5 THEN 'year=1999' END], lambda a: a IS NOT NULL))"""


@query(
    "feed_attributes",
    f"WITH {sql.LISTINGS} SELECT tracker, identity, array_to_string({ATTRS}, ';') AS attributes FROM listings",
)
def feed_attributes(spark, sf):
    pairs = F.transform(render.attributes(), lambda a: F.concat_ws("=", a["name"], a["value"]))
    return full_listings(spark, sf).select("tracker", "identity", F.array_join(pairs, ";").alias("attributes"))


@query(
    "feed_items",
    f"""WITH {sql.LISTINGS} SELECT tracker, identity, name AS title, CASE WHEN details_url != '' THEN details_url ELSE name END AS guid,
      (details_url != '')::INT AS permalink, CASE WHEN published IS NULL THEN 'Tue, 15 Jan 2002 12:30:00 +0000' ELSE strftime(published, '%a, %d %b %Y %H:%M:%S') || ' +0000' END AS pub_date,
      CASE WHEN details_url != '' THEN 'https://proxy.invalid/api/v2.0/indexers/' || replace(tracker, '#', '%23') || '/download/?apikey=a+b' WHEN infohash != ''
        THEN 'magnet:?xt=urn:btih:' || infohash ELSE '' END AS link, array_to_string(categories, ',') AS category, size AS length FROM listings""",
)
def feed_items(spark, sf):
    items = render.feed_items(full_listings(spark, sf), BASE, NOW, "a b")
    i = F.col("item")
    return items.select(
        "tracker", "identity", i["title"].alias("title"), i["guid"]["_VALUE"].alias("guid"), i["guid"]["_isPermaLink"].cast("int").alias("permalink"),
        i["pubDate"].alias("pub_date"), F.regexp_replace(i["link"], r"/download/-?\d+\?", "/download/?").alias("link"), joined(i["category"]).alias("category"),
        i["enclosure"]["_length"].alias("length"),
    )


FEED_PAGES = f"""{sql.LISTINGS}, pages0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tracker ORDER BY published DESC NULLS LAST, id DESC) AS rank,
  count(*) OVER (PARTITION BY tracker) AS total FROM listings) WHERE rank <= 50)"""


def _feeds(spark, sf):
    """One feed per source: its newest 50."""
    L = fx.listings(spark, sf)
    totals = L.groupBy("tracker").agg(F.count("*").alias("total"))
    # The newest are picked from the catalogue's own columns; the others are made for those picked only.
    newest = in_full(s.recent(L, 50), "rank")
    pages = newest.join(totals, "tracker").withColumn("request_id", F.col("tracker")).withColumn("offset", F.lit(0))
    return render.feed(pages, BASE, NOW)


@query(
    "feed_documents",
    f"""WITH {FEED_PAGES} SELECT tracker AS request_id, any_value(total) AS total, count(*) AS items, string_agg(name, '|' ORDER BY rank) AS titles FROM pages0 GROUP BY tracker""",
)
def feed_documents(spark, sf):
    channel = _feeds(spark, sf)
    return channel.select(
        "request_id", F.col("response._total").alias("total"), F.size("item").alias("items"),
        F.array_join(F.transform("item", lambda i: i["title"]), "|").alias("titles"),
    )


FEED_RULES = """
id: feed
links: [https://proxy.invalid/]
search:
  paths: [{path: rss, response: {type: XML}}]
  rows: {selector: channel > item}
  fields:
    title: {selector: title}
    details: {selector: comments, optional: true}
    size: {selector: enclosure, attribute: length}
    seeders: {selector: "attr[name=seeders]", attribute: value}
    leechers: {selector: "attr[name=leechers]", attribute: value}
    infohash: {selector: "attr[name=infohash]", attribute: value, optional: true}
    category: {selector: "attr[name=category]", attribute: value, optional: true}
    date: {selector: pubDate}
"""


@query(
    "xml_round_trip",
    f"""WITH {FEED_PAGES} SELECT tracker AS source, rank - 1 AS row_no, name, details_url, seeders, leechers, size,
      strftime(coalesce(published, TIMESTAMP '2002-01-15 12:30:00'), '%Y-%m-%d %H:%M:%S') AS published, infohash,
      coalesce(categories[1]::VARCHAR, '') AS categories FROM pages0""",
)
def xml_round_trip(spark, sf):
    """Feeds written as XML documents, then read back as captured pages by XML rules and typed."""
    pages = feeds.feed_xml(_feeds(spark, sf)).select(
        F.xxhash64("request_id").alias("page_id"), F.lit("feed").alias("source"), F.lit("https://proxy.invalid/rss").alias("url"),
        F.lit("xml").alias("format"), F.col("xml").alias("body"), F.col("request_id").alias("owner"),
    )
    definition = read_document(FEED_RULES)
    rows = extract.kept_rows(extract.extract_rows(pages, definition, NOW, kind="xml"))
    sources = source_table(spark, sf).limit(0).select("id", "type")
    standard = tax.taxonomy(spark)
    identity = standard.select(
        F.lit("feed").alias("source"), F.col("id").alias("ordinal"), F.col("id").cast("string").alias("cat_id"), F.col("name").alias("cat"),
        F.lit("").alias("desc"), F.lit(False).alias("is_default"),
    )
    listed = extract.to_listings(rows, sources, identity, standard, NOW)
    owners = pages.select("page_id", "owner")
    return listed.join(owners, "page_id").select(
        F.col("owner").alias("source"), "row_no", "name", "details_url", "seeders", "leechers", "size", stamp("published").alias("published"),
        "infohash", joined("categories").alias("categories"),
    )


@query(
    "json_results",
    f"""WITH {sql.LISTINGS} SELECT name AS title, tracker AS tracker_id, 'Shop ' || (substr(tracker, 10)::INT) AS tracker, leechers AS peers, coalesce(try_cast(imdbid AS BIGINT), -1) AS imdb,
      coalesce(try_cast(tvdbid AS BIGINT), -1) AS tvdb, -1 AS files, leechers * 3 AS grabs, CASE WHEN leechers > 5 THEN 1999 ELSE -1 END AS year,
      round(seeders::DOUBLE * size / 1073741824, 6) AS gain, CASE WHEN leechers = 1 THEN 'Drama|Sci Fi' ELSE '' END AS genres,
      CASE WHEN published IS NULL THEN '' ELSE strftime(published, '%Y-%m-%dT%H:%M:%SZ') END AS publish_date,
      array_to_string(list_filter(list_transform(categories, lambda c: CASE c WHEN 2030 THEN 'Movies/SD' WHEN 2040 THEN 'Movies/HD' WHEN 5040 THEN 'TV/HD' WHEN 5030 THEN 'TV/SD'
        WHEN 3010 THEN 'Audio/MP3' WHEN 7020 THEN 'Books/EBook' END), lambda x: x IS NOT NULL), ', ') AS category_desc,
      CASE WHEN infohash != '' THEN 'x' ELSE '' END AS magnet FROM listings""",
)
def json_results(spark, sf):
    """Results as JSON text, read back for the comparison."""
    enriched = render.enrich(full_listings(spark, sf), source_table(spark, sf), fx.category_mappings(spark), tax.taxonomy(spark))
    doc = feeds.results_json(render.results(enriched, BASE)).select(F.parse_json("json").alias("d"))

    def at(name: str, kind: str = "string"):
        return F.try_variant_get(F.col("d"), f"$.{name}", kind)

    return doc.select(
        at("Title").alias("title"), at("TrackerId").alias("tracker_id"), at("Tracker").alias("tracker"), at("Peers", "int").alias("peers"),
        F.coalesce(at("Imdb", "bigint"), F.lit(-1)).alias("imdb"), F.coalesce(at("TVDBId", "bigint"), F.lit(-1)).alias("tvdb"),
        F.coalesce(at("Files", "int"), F.lit(-1)).alias("files"), at("Grabs", "int").alias("grabs"), F.coalesce(at("Year", "int"), F.lit(-1)).alias("year"),
        F.round(at("Gain", "double"), 6).alias("gain"), F.array_join(at("Genres", "array<string>"), "|").alias("genres"),
        at("PublishDate").alias("publish_date"), at("CategoryDesc").alias("category_desc"),
        F.when(at("MagnetUri") != "", "x").otherwise("").alias("magnet"),
    )
