"""Merge, search, retention and statistics over the listing catalogue."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gleanery import fixtures as fx
from gleanery.operators import listings as ops, search as s, taxonomy as tax
from gleanery.plans import sql
from gleanery.plans.registry import flag, joined, query, stamp

CUTOFF = datetime(1998, 7, 1)
CUT = "TIMESTAMP '1998-07-01'"
LISTING_OUT = """tracker, identity, name, infohash, details_url, {pub} AS published, {seen} AS last_seen, seeders, leechers,
  size, array_to_string(categories, ',') AS categories, imdbid, tvdbid, search_managed::INT AS search_managed""".format(
    pub=sql.folded("published"), seen=sql.folded("last_seen")
)


def _out(df):
    return df.select(
        "tracker", "identity", "name", "infohash", "details_url", stamp("published").alias("published"),
        stamp("last_seen").alias("last_seen"), "seeders", "leechers", "size", joined("categories").alias("categories"),
        "imdbid", "tvdbid", flag("search_managed").alias("search_managed"),
    )


@query("upsert_listings", f"WITH {sql.LISTINGS} SELECT {LISTING_OUT} FROM listings")
def upsert_listings(spark, sf):
    return _out(fx.merged_listings(spark, sf))


@query(
    "upsert_provenance",
    f"WITH {sql.SIGHTINGS}, {sql.SEARCHES} SELECT tracker, search_key, identity, {sql.folded('last_seen')} AS last_seen FROM searches",
)
def upsert_provenance(spark, sf):
    """Sightings up to a moment are the stored bridge, later ones the arriving batch."""
    rows = fx.sightings(spark, sf, with_categories=False).filter("search_managed")
    rows = rows.select("tracker", "search_key", "identity", "last_seen")
    early = F.col("last_seen") < F.lit(CUTOFF)
    merged = ops.merge_searches(rows.filter(early), rows.filter(~early))
    return merged.withColumn("last_seen", stamp("last_seen"))


@query(
    "search_page",
    f"""WITH {sql.LISTINGS}, hits AS (
      SELECT * FROM listings WHERE contains(lower(name), 'hot') AND contains(lower(name), 'rod') AND contains(lower(name), 'brand#1')
        AND (len(categories) = 0 OR list_has_any(categories, [2000,2010,2020,2030,2040,2045,2050,2060,2070,2080,3010]))
        AND len(categories) > 0)
      SELECT {LISTING_OUT}, (SELECT count(*) FROM hits) AS total FROM hits
      ORDER BY published DESC NULLS LAST, id DESC LIMIT 50 OFFSET 10""",
)
def search_page(spark, sf):
    """One feed search: terms, an expanded category, filed rows only, second page."""
    wanted = ["2000", "2010", "2020", "2030", "2040", "2045", "2050", "2060", "2070", "2080", "3010"]
    q = s.Query(terms=["HOT", "rod", "Brand#1"], categories=wanted, needs_category=True, limit=50, offset=10)
    page, total = s.search(fx.listings(spark, sf), q)
    return _out(page).withColumn("total", total.scalar())


@query(
    "search_deep_page",
    f"""WITH {sql.LISTINGS}, places AS (SELECT *, row_number() OVER (ORDER BY published DESC NULLS LAST, id DESC) AS place, count(*) OVER () AS total FROM listings)
      SELECT {LISTING_OUT}, total FROM places WHERE place > total * 5 // 6 AND place <= total * 5 // 6 + 100""",
)
def search_deep_page(spark, sf):
    """A page of everything that lies behind five in six rows."""
    listings = fx.listings(spark, sf)
    total = listings.count()
    found, count = s.search(listings, s.Query(limit=100, offset=total * 5 // 6))
    return _out(found).withColumn("total", count.scalar())


@query(
    "search_sources",
    f"""WITH {sql.LISTINGS} SELECT {LISTING_OUT} FROM listings
      WHERE tracker IN ('Supplier#000000001', 'Supplier#000000004', 'nobody') AND (len(categories) = 0 OR list_has_any(categories, [5040, 7020]))
      ORDER BY published DESC NULLS LAST, id DESC LIMIT 100""",
)
def search_sources(spark, sf):
    """No terms, some sources, categories that an unfiled row matches too."""
    q = s.Query(trackers=["Supplier#000000001", "Supplier#000000004", "nobody"], categories=["5040", "7020"], limit=100)
    return _out(s.search(fx.listings(spark, sf), q)[0])


@query(
    "search_by_ids",
    f"""WITH {sql.LISTINGS} SELECT {LISTING_OUT} FROM listings WHERE search_managed OR (
        ((imdbid != '' AND ltrim(imdbid, '0') = '15') OR (tvdbid != '' AND ltrim(tvdbid, '0') = '7'))
        AND (imdbid = '' OR ltrim(imdbid, '0') = '15') AND (tvdbid = '' OR ltrim(tvdbid, '0') = '7'))
      ORDER BY published DESC NULLS LAST, id DESC LIMIT 10000""",
)
def search_by_ids(spark, sf):
    q = s.Query(ids={"imdbid": "tt0000015", "tvdbid": "007"}, limit=s.JSON_MAX)
    return _out(s.search(fx.listings(spark, sf), q)[0])


@query(
    "search_unsearched_terms",
    f"""WITH {sql.LISTINGS} SELECT tracker, identity, name FROM listings
      WHERE contains(lower(name), 'widget') AND (search_managed OR contains(lower(name), 'economy'))""",
)
def search_unsearched_terms(spark, sf):
    """Every match of a search whose episode text binds only rows no search produced."""
    q = s.Query(terms=["widget"], unsearched_terms=["ECONOMY"])
    return fx.listings(spark, sf).filter(s.where(q)).select("tracker", "identity", "name")


@query(
    "search_provenance",
    f"""WITH {sql.LISTINGS}, {sql.SEARCHES} SELECT tracker, identity, name, search_managed::INT AS search_managed FROM listings l
      WHERE contains(lower(name), 'bolt') AND (NOT search_managed OR EXISTS (SELECT 1 FROM searches b
        WHERE b.tracker = l.tracker AND b.identity = l.identity AND b.search_key = 'A'))""",
)
def search_provenance(spark, sf):
    q = s.Query(terms=["bolt"], query_key="A")
    found = s.restrict_to_search(fx.listings(spark, sf).filter(s.where(q)), fx.searches(spark, sf), q.query_key)
    return found.select("tracker", "identity", "name", flag("search_managed").alias("search_managed"))


@query(
    "batch_search",
    f"""WITH {sql.LISTINGS}, {sql.SEARCHES}, {sql.SEARCH_REQUESTS},
      known AS (SELECT tracker, identity, list(DISTINCT search_key) AS keys FROM searches GROUP BY ALL),
      l AS MATERIALIZED (SELECT l.*, lower(name) AS folded, ltrim(imdbid, '0') AS bare, coalesce(keys, []) AS keys FROM listings l LEFT JOIN known USING (tracker, identity)),
      n AS (SELECT DISTINCT folded FROM l),
      m AS (SELECT q.*, folded FROM search_requests q JOIN n ON list_bool_and(list_transform(list_append(terms, ''), lambda t: contains(folded, lower(t))))),
      ranked AS (SELECT request_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY request_id) AS total, l.tracker, l.identity, l.name, l.published,
            m."limit" AS lim, m."offset" AS off
          FROM m JOIN l ON m.folded = l.folded AND (len(m.categories) = 0 OR len(l.categories) = 0 OR list_has_any(m.categories, l.categories::VARCHAR[]))
            AND (len(trackers) = 0 OR list_contains(trackers, l.tracker)) AND (NOT needs_category OR len(l.categories) > 0)
            AND (search_managed OR list_bool_and(list_transform(list_append(unsearched, ''), lambda t: contains(l.folded, t))))
            AND (imdb = '' OR len(terms) > 0 OR search_managed OR bare = imdb)
            AND (m.query_key = '' OR NOT search_managed OR list_contains(keys, m.query_key))
          WINDOW w AS (PARTITION BY request_id ORDER BY l.published DESC NULLS LAST, l.id DESC))
      SELECT request_id, pos - off AS rank, total, tracker, identity, name, {sql.folded('published')} AS published
      FROM ranked WHERE pos > off AND pos <= off + lim""",
)
def batch_search(spark, sf):
    """Every request's page and total in one job."""
    found = s.search_many(fx.search_requests(spark, sf), fx.listings(spark, sf), bridge=fx.searches(spark, sf))
    return found.withColumn("published", stamp("published"))


AND_QUERIES = ["The hot-rod and Brand", "small a ring", "an economy GIZMO promo", "blue widget 7", "___"]


@query(
    "and_match",
    """WITH q(qi, kw) AS (VALUES (0, ['hot', 'rod', 'brand']), (1, ['small', 'ring']), (2, ['economy', 'gizmo', 'promo']),
        (3, ['blue', 'widget']), (4, ['___']), (5, ['small', 'ri'])),
      n AS (SELECT p_partkey, lower(p_name || ' ' || p_brand || ' ' || p_type) AS name FROM part)
      SELECT p_partkey, """
    + ", ".join(
        f"(SELECT list_bool_and(list_transform(kw, lambda w: contains(n.name, w))) FROM q WHERE qi = {i})::INT AS m{i}" for i in range(6)
    )
    + " FROM n",
)
def and_match(spark, sf):
    part = fx.table(spark, sf, "part").withColumn("name", F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    cols = [flag(s.and_match(F.col("name"), F.lit(q))).alias(f"m{i}") for i, q in enumerate(AND_QUERIES)]
    cols.append(flag(s.and_match(F.col("name"), F.lit("small ring"), 8)).alias("m5"))
    return part.select("p_partkey", *cols)


@query(
    "tracker_stats",
    f"""WITH {sql.LISTINGS} SELECT coalesce(tracker, '') AS tracker, count(*) AS torrents, {sql.folded('max(published)')} AS newest
      FROM listings GROUP BY ROLLUP(tracker)""",
)
def tracker_stats(spark, sf):
    return ops.stats_with_total(fx.listings(spark, sf)).select(
        F.coalesce("tracker", F.lit("")).alias("tracker"), "torrents", stamp("newest").alias("newest")
    )


@query(
    "prune_listings",
    f"""WITH {sql.LISTINGS} SELECT tracker, identity FROM listings
      WHERE NOT (published IS NOT NULL AND published < {CUT}) AND NOT (published IS NULL AND last_seen < {CUT})""",
)
def prune_listings(spark, sf):
    return ops.prune(fx.listings(spark, sf), F.lit(CUTOFF)).select("tracker", "identity")


@query(
    "prune_dated",
    f"WITH {sql.LISTINGS} SELECT tracker, count(*) AS removed FROM listings WHERE published < {CUT} GROUP BY tracker",
)
def prune_dated(spark, sf):
    gone = fx.listings(spark, sf).filter(ops.expired(F.lit(CUTOFF)) & F.col("published").isNotNull())
    return gone.groupBy("tracker").agg(F.count("*").alias("removed"))


@query(
    "prune_undated",
    f"WITH {sql.LISTINGS} SELECT tracker, count(*) AS removed FROM listings WHERE published IS NULL AND last_seen < {CUT} GROUP BY tracker",
)
def prune_undated(spark, sf):
    gone = fx.listings(spark, sf).filter(ops.expired(F.lit(CUTOFF)) & F.col("published").isNull())
    return gone.groupBy("tracker").agg(F.count("*").alias("removed"))


@query(
    "prune_report",
    f"""WITH {sql.LISTINGS} SELECT count(*) FILTER (published < {CUT}) AS removed_dated,
      count(*) FILTER (published IS NULL AND last_seen < {CUT}) AS removed_undated,
      count(*) FILTER (published >= {CUT} OR (published IS NULL AND last_seen >= {CUT})) AS kept FROM listings""",
)
def prune_report(spark, sf):
    return ops.sweep_report(fx.listings(spark, sf), F.lit(CUTOFF))


@query(
    "prune_provenance",
    f"""WITH {sql.LISTINGS}, {sql.SEARCHES}, kept AS (SELECT tracker, identity FROM listings
        WHERE NOT coalesce(published < {CUT}, last_seen < {CUT}))
      SELECT b.tracker, b.search_key, b.identity FROM searches b SEMI JOIN kept k ON b.tracker = k.tracker AND b.identity = k.identity
      WHERE b.last_seen >= {CUT}""",
)
def prune_provenance(spark, sf):
    _, bridge = ops.sweep(fx.listings(spark, sf), fx.searches(spark, sf), F.lit(CUTOFF))
    return bridge.select("tracker", "search_key", "identity")


@query(
    "cascade_provenance",
    f"""WITH {sql.LISTINGS}, {sql.SEARCHES} SELECT b.tracker, b.search_key, b.identity FROM searches b
      SEMI JOIN (SELECT * FROM listings WHERE seeders > 20) k ON b.tracker = k.tracker AND b.identity = k.identity""",
)
def cascade_provenance(spark, sf):
    left = fx.listings(spark, sf).filter("seeders > 20")
    return ops.cascade(fx.searches(spark, sf), left).select("tracker", "search_key", "identity")


@query(
    "clear_source",
    f"""WITH {sql.LISTINGS}, {sql.SEARCHES}
      SELECT 'listing' AS kind, tracker, count(*) AS n FROM listings WHERE tracker != 'Supplier#000000003' GROUP BY tracker
      UNION ALL SELECT 'search', tracker, count(*) FROM searches WHERE tracker != 'Supplier#000000003' GROUP BY tracker""",
)
def clear_source(spark, sf):
    kept, bridge = ops.clear_source(fx.listings(spark, sf), fx.searches(spark, sf), "Supplier#000000003")
    count = F.count("*").alias("n")
    return (
        kept.groupBy("tracker").agg(count).select(F.lit("listing").alias("kind"), "tracker", "n")
        .unionByName(bridge.groupBy("tracker").agg(count).select(F.lit("search").alias("kind"), "tracker", "n"))
    )


@query(
    "recent_per_source",
    f"""WITH {sql.LISTINGS} SELECT tracker, identity, name, rank FROM (SELECT *, row_number() OVER
        (PARTITION BY tracker ORDER BY published DESC NULLS LAST, id DESC) AS rank FROM listings) WHERE rank <= 20""",
)
def recent_per_source(spark, sf):
    return s.recent(fx.listings(spark, sf), 20).select("tracker", "identity", "name", "rank")


# --- categories ------------------------------------------------------------------------

BRAND_CAT = """CASE p_type WHEN 'ECONOMY' THEN 'Movies/SD' WHEN 'SMALL' THEN 'TV/HD' WHEN 'MEDIUM' THEN 'TV/SD'
  WHEN 'STANDARD' THEN 'Audio/MP3' WHEN 'LARGE' THEN 'Books/EBook' ELSE 'Promotions' END"""
BRAND_MAPPINGS = f"""
mappings AS (SELECT p_brand AS source, p_partkey AS ordinal, {BRAND_CAT} AS cat,
  CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_name END AS cat_id,
  CASE WHEN p_partkey % 4 < 2 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) ELSE '' END AS descr,
  p_partkey % 7 = 0 AS is_default FROM part),
resolved AS (SELECT m.*, t.id AS std_id, CASE WHEN descr != '' THEN 100000 + coalesce(try_cast(cat_id AS INT),
    ('0x' || substr(sha1(cat_id), 3, 2) || substr(sha1(cat_id), 1, 2))::INT) END AS custom_id
  FROM mappings m JOIN taxonomy t ON m.cat = t.name)"""


def brand_mappings(spark, sf):
    """Category mappings as wide as the part table: one per part, the brand being the source."""
    part = fx.table(spark, sf, "part")
    names = {"ECONOMY": "Movies/SD", "SMALL": "TV/HD", "MEDIUM": "TV/SD", "STANDARD": "Audio/MP3", "LARGE": "Books/EBook"}
    cat = F.lit("Promotions")
    for kind, name in names.items():
        cat = F.when(F.col("p_type") == kind, F.lit(name)).otherwise(cat)
    key = F.col("p_partkey")
    return part.select(
        F.col("p_brand").alias("source"),
        key.cast("int").alias("ordinal"),
        F.when(key % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_name")).alias("cat_id"),
        cat.alias("cat"),
        F.when(key % 4 < 2, F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substr(p_name, 2)"))).otherwise("").alias("desc"),
        (key % 7 == 0).alias("is_default"),
    )


@query(
    "map_categories",
    f"""WITH {sql.taxonomy()}, {BRAND_MAPPINGS},
      ids AS (SELECT source, lower(cat_id) AS k, list(x ORDER BY ordinal, pos) AS ids FROM (
          SELECT source, cat_id, ordinal, 0 AS pos, std_id AS x FROM resolved UNION ALL
          SELECT source, cat_id, ordinal, 1, custom_id FROM resolved WHERE custom_id IS NOT NULL) GROUP BY ALL),
      descs AS (SELECT source, lower(descr) AS k, list(x ORDER BY ordinal, pos) AS ids FROM (
          SELECT source, descr, ordinal, 0 AS pos, std_id AS x FROM resolved WHERE descr != '' UNION ALL
          SELECT source, descr, ordinal, 1, custom_id FROM resolved WHERE descr != '') GROUP BY ALL),
      r AS (SELECT p_partkey, p_brand, upper(p_size::VARCHAR) AS c, upper(p_name) AS d FROM part),
      j AS (SELECT p_partkey, list_concat(coalesce(i.ids, []), coalesce(e.ids, [])) AS raw FROM r
        LEFT JOIN ids i ON i.source = p_brand AND i.k = lower(c) LEFT JOIN descs e ON e.source = p_brand AND e.k = lower(d)),
      u AS (SELECT p_partkey, x, min(i) AS i FROM (SELECT p_partkey, unnest(raw) AS x, unnest(range(len(raw))) AS i FROM j) GROUP BY ALL)
      SELECT r.p_partkey, coalesce((SELECT string_agg(x::VARCHAR, ',' ORDER BY i) FROM u WHERE u.p_partkey = r.p_partkey), '') AS categories FROM r""",
)
def map_categories(spark, sf):
    """Every part filed by its brand's own mappings, by id then by description."""
    rows = fx.table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_brand").alias("source"),
        F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")).alias("category"),
        F.upper("p_name").alias("categorydesc"),
    )
    mapped = tax.map_categories(rows, brand_mappings(spark, sf), tax.taxonomy(spark))
    return mapped.select("p_partkey", joined("categories").alias("categories"))


@query(
    "expand_categories",
    f"""WITH {sql.taxonomy()}, {sql.requests()},
      x AS (SELECT request_id, unnest(categories) AS c FROM requests),
      w AS (SELECT request_id, c FROM x UNION SELECT request_id, id::VARCHAR FROM x JOIN taxonomy
        ON id > try_cast(c AS INT) AND id < try_cast(c AS INT) + 1000 AND try_cast(c AS INT) % 1000 = 0)
      SELECT r.request_id, coalesce(e.c, '') AS expanded FROM requests r
      LEFT JOIN (SELECT request_id, string_agg(c, ',' ORDER BY c) AS c FROM w GROUP BY request_id) e USING (request_id)""",
)
def expand_categories(spark, sf):
    wide = tax.expand_categories(fx.requests(spark, sf))
    return wide.select("request_id", joined("expanded").alias("expanded"))


@query(
    "site_categories",
    f"""WITH {sql.taxonomy()}, {sql.requests()}, {BRAND_MAPPINGS},
      r AS (SELECT request_id, 'Brand#' || (1 + request_id % 25) AS source, categories FROM requests),
      x AS (SELECT request_id, source, unnest(categories) AS c FROM r),
      w AS (SELECT * FROM x UNION SELECT request_id, source, id::VARCHAR FROM x JOIN taxonomy
        ON id > try_cast(c AS INT) AND id < try_cast(c AS INT) + 1000 AND try_cast(c AS INT) % 1000 = 0),
      hit AS (SELECT request_id, cat_id, min(ordinal) AS o FROM w JOIN resolved m ON m.source = w.source
        AND (w.c = std_id::VARCHAR OR w.c = custom_id::VARCHAR) GROUP BY ALL),
      dflt AS (SELECT source, string_agg(cat_id, ',' ORDER BY o) AS ids FROM (SELECT source, cat_id, min(ordinal) AS o FROM mappings
        WHERE is_default GROUP BY ALL) GROUP BY source)
      SELECT r.request_id, r.source, coalesce(h.ids, d.ids, '') AS site_categories FROM r
      LEFT JOIN (SELECT request_id, string_agg(cat_id, ',' ORDER BY o) AS ids FROM hit GROUP BY request_id) h USING (request_id)
      LEFT JOIN dflt d ON d.source = r.source""",
)
def site_categories(spark, sf):
    requests = fx.requests(spark, sf).select(
        "request_id", F.concat(F.lit("Brand#"), (1 + F.col("request_id") % 25).cast("string")).alias("source"), "categories"
    )
    out = tax.site_categories(requests, brand_mappings(spark, sf), tax.taxonomy(spark))
    return out.select("request_id", "source", joined("site_categories").alias("site_categories"))


@query(
    "supported_categories",
    f"WITH {sql.taxonomy()}, {BRAND_MAPPINGS} SELECT DISTINCT std_id AS id, cat AS name FROM resolved",
)
def supported_categories(spark, sf):
    return tax.supported_categories(brand_mappings(spark, sf), tax.taxonomy(spark))


@query(
    "custom_categories",
    f"""WITH {sql.taxonomy()}, {BRAND_MAPPINGS},
      f AS (SELECT source, custom_id AS id, arg_min(descr, ordinal) AS name FROM resolved WHERE custom_id IS NOT NULL GROUP BY ALL)
      SELECT source, id, name FROM f""",
)
def custom_categories(spark, sf):
    return tax.custom_categories(brand_mappings(spark, sf), tax.taxonomy(spark)).select("source", "id", "name")


@query(
    "custom_category_order",
    f"""WITH {sql.taxonomy()}, {BRAND_MAPPINGS},
      f AS (SELECT source, custom_id AS id, arg_min(descr, ordinal) AS name FROM resolved WHERE custom_id IS NOT NULL GROUP BY ALL)
      SELECT source, string_agg(name, '|' ORDER BY lower(name), name DESC) AS names FROM f GROUP BY source""",
)
def custom_category_order(spark, sf):
    own = tax.custom_categories(brand_mappings(spark, sf), tax.taxonomy(spark))
    return own.groupBy("source").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda c: c["name"]), "|").alias("names")
    )
