"""Requests and the sources that can answer them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleanery import fixtures as fx
from gleanery.operators import frontier, requests as rq, routing, taxonomy as tax
from gleanery.plans import sql
from gleanery.plans.catalogue import BRAND_MAPPINGS, brand_mappings
from gleanery.plans.registry import flag, joined, query

# --- requests out of raw parameters -----------------------------------------------------


def raw_requests(spark, sf):
    """Submitted parameters made from events: odd spellings, repeats, blanks, bad numbers."""
    e = fx.table(spark, sf, "events")
    n = F.col("event_id")

    def one(c: Column) -> Column:
        return F.array(c.cast("string"))

    params = F.create_map(
        F.lit("T"), one(F.when(n % 3 == 0, "tv-search").when(n % 3 == 1, F.col("event_type")).otherwise("")),
        F.lit("Cat[]"), F.array(F.concat(F.lit(" 0"), (F.col("user_id") * 10).cast("string"), F.lit(",, x ")), F.lit("+5000")),
        F.lit("category"), one((n % 9 * 1000)),
        F.lit("q"), F.array(F.lit(""), F.when(n % 2 == 0, F.col("event_type")).otherwise("")),
        F.lit("query"), one(F.lit("fallback")),
        F.lit("LIMIT"), one(F.when(n % 5 == 0, "lots").otherwise(F.col("value").cast("int").cast("string"))),
        F.lit("offset"), one(n % 7 - 3),
        F.lit("rid"), one(F.lit("")),
        F.lit("rageid"), one(F.col("user_id")),
    )
    return e.select(n.alias("request_id"), params.alias("params"))


@query(
    "normalize_requests",
    """SELECT event_id AS request_id,
      CASE WHEN event_id % 3 = 0 THEN 'tvsearch' WHEN event_id % 3 = 2 THEN 'search' ELSE event_type END AS type,
      (user_id * 10) || ',x,5000,' || (event_id % 9 * 1000) AS categories,
      CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'fallback' END AS query,
      CASE WHEN event_id % 5 = 0 OR floor(value) <= 0 THEN 50 ELSE least(floor(value), 100) END::INT AS "limit",
      greatest(event_id % 7 - 3, 0)::INT AS "offset", user_id::VARCHAR AS tvrageid, '' AS album FROM events""",
)
def normalize_requests(spark, sf):
    out = rq.normalize_requests(raw_requests(spark, sf))
    return out.select("request_id", "type", joined("categories").alias("categories"), "query", "limit", "offset", "tvrageid", "album")


def typed_requests(spark, sf):
    """Full request rows derived from events, every field present."""
    e = fx.table(spark, sf, "events")
    n, u = F.col("event_id"), F.col("user_id")
    empty = F.lit("")
    kinds = {"view": "search", "click": "tvsearch", "purchase": "movie", "signup": "music", "error": "book"}
    kind = F.lit("")
    for event, name in kinds.items():
        kind = F.when(F.col("event_type") == event, F.lit(name)).otherwise(kind)
    given = {
        "query": F.when(n % 4 == 0, empty).otherwise(F.concat(F.lit("show "), u.cast("string"))),
        "season": F.when(n % 6 == 1, (n % 13).cast("string")).when(n % 6 == 2, F.lit("2024")).when(n % 6 == 3, F.lit("x")).otherwise(empty),
        "ep": F.when(n % 5 == 0, empty).when(n % 5 == 1, F.lit("03/15")).when(n % 5 == 2, F.lit("13/45")).otherwise((n % 120).cast("string")),
        "artist": F.when(n % 10 == 0, F.lit(" The  Band ")).otherwise(empty),
        "imdbid": F.when(u % 7 == 0, F.concat(F.lit("tt"), u.cast("string"))).otherwise(empty),
        "tvrageid": F.when(u % 11 == 0, u.cast("string")).otherwise(empty),
        "tvdbid": F.when(u % 5 == 0, u.cast("string")).otherwise(empty),
        "genre": F.when(n % 50 == 0, F.lit("jazz")).otherwise(empty),
    }
    categories = F.array((n % 9 * 1000).cast("string"), (u % 3).cast("string"))
    return e.select(
        n.alias("request_id"), kind.alias("type"), categories.alias("categories"), F.lit(50).alias("limit"),
        (n % 3).cast("int").alias("offset"), *[given.get(f, empty).alias(f) for f in rq.FIELDS],
    )


TYPED = """
typed AS (SELECT event_id AS request_id,
  CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'tvsearch' WHEN 'purchase' THEN 'movie' WHEN 'signup' THEN 'music' ELSE 'book' END AS type,
  [(event_id % 9 * 1000)::VARCHAR, (user_id % 3)::VARCHAR] AS categories, event_id % 3 AS "offset",
  CASE WHEN event_id % 4 = 0 THEN '' ELSE 'show ' || user_id END AS query,
  CASE event_id % 6 WHEN 1 THEN (event_id % 13)::VARCHAR WHEN 2 THEN '2024' WHEN 3 THEN 'x' ELSE '' END AS season0,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '03/15' WHEN 2 THEN '13/45' ELSE (event_id % 120)::VARCHAR END AS ep,
  CASE WHEN event_id % 10 = 0 THEN ' The  Band ' ELSE '' END AS artist,
  CASE WHEN user_id % 7 = 0 THEN 'tt' || user_id ELSE '' END AS imdbid,
  CASE WHEN user_id % 11 = 0 THEN user_id::VARCHAR ELSE '' END AS tvrageid,
  CASE WHEN user_id % 5 = 0 THEN user_id::VARCHAR ELSE '' END AS tvdbid,
  CASE WHEN event_id % 50 = 0 THEN 'jazz' ELSE '' END AS genre FROM events),
seasoned AS (SELECT *, CASE WHEN season0 = '0' THEN '' ELSE season0 END AS season FROM typed),
worded AS (SELECT *, CASE WHEN season = '' THEN '' WHEN season = '2024' AND ep = '03/15' THEN '2024.03.15'
    ELSE 'S' || CASE WHEN length(season) = 1 AND season != 'x' THEN '0' || season ELSE season END
      || CASE WHEN ep = '' THEN '' WHEN length(ep) = 1 THEN 'E0' || ep ELSE 'E' || ep END END AS episode FROM seasoned)"""


@query(
    "request_keywords",
    f"""WITH {TYPED} SELECT request_id, season, episode,
      trim(trim(CASE WHEN query = '' THEN artist ELSE query || CASE WHEN artist = '' THEN '' ELSE ' ' || artist END END) || ' ' || episode) AS keywords,
      array_to_string(list_filter(string_split(query || ' ' || artist, ' '), lambda x: x != ''), '|') AS terms FROM worded""",
)
def request_keywords(spark, sf):
    r = typed_requests(spark, sf)
    return r.select(
        "request_id", rq.season(F.col("season")).alias("season"), rq.episode(F.col("season"), F.col("ep")).alias("episode"),
        rq.keywords().alias("keywords"),
        F.array_join(rq.search_terms(), "|").alias("terms"),
    )


@query(
    "request_keys",
    f"""WITH {TYPED} SELECT request_id, sha256(array_to_string(['', artist, '', '', ep, '', genre, imdbid, '', '', query, season,
      '', '', '', '', tvdbid, '', tvrageid, type, '', array_to_string(list_sort(categories), ',')], chr(0))) AS search_key FROM worded""",
)
def request_keys(spark, sf):
    return typed_requests(spark, sf).select("request_id", rq.search_key().alias("search_key"))


@query(
    "request_flags",
    f"""WITH {TYPED} SELECT request_id, (imdbid != '' OR tvdbid != '' OR tvrageid != '' OR ep != '' OR artist != '' OR genre != '' OR season != '')::INT AS is_id_search,
      (query = '' AND artist = '' AND episode = '' AND NOT (imdbid != '' OR tvdbid != '' OR tvrageid != '' OR ep != '' OR genre != '' OR season != ''))::INT AS is_rss_search,
      (imdbid != '')::INT AS is_imdb_query, (genre != '')::INT AS is_genre_query, 0 AS is_douban_query, (tvrageid != '')::INT AS is_tvrage_query,
      (type = 'search')::INT AS is_search, (type = 'tvsearch')::INT AS is_tv_search, (type = 'movie')::INT AS is_movie_search,
      (type = 'music')::INT AS is_music_search, (type = 'book')::INT AS is_book_search FROM worded""",
)
def request_flags(spark, sf):
    r = typed_requests(spark, sf)
    return r.select("request_id", *[flag(c).alias(n) for n, c in rq.request_flags().items()])


def _typed_queries(spark, sf):
    """Interactive queries typed by people: names with an episode at the end, ids, plain text."""
    n, u = F.col("request_id"), F.col("request_id") % 89
    two = F.lpad((n % 30).cast("string"), 2, "0")
    text = (
        F.when(n % 8 == 0, F.concat(F.lit("show "), u.cast("string"), F.lit(" S"), two, F.lit("E0"), (n % 10).cast("string")))
        .when(n % 8 == 1, F.concat(F.lit("show E"), two))
        .when(n % 8 == 2, F.concat(F.lit(" show-S"), two, F.lit(" ")))
        .when(n % 8 == 3, F.concat(F.lit("show S"), two, F.lit(" E"), two, F.lit("b")))
        .when(n % 8 == 4, F.concat(F.lit("tt"), (n * 37).cast("string")))
        .when(n % 8 == 5, F.concat(F.lit("xS"), two, F.lit("E01")))
        .when(n % 8 == 6, F.concat(F.lit("tt0000"), F.lit("!0")))
        .otherwise(F.lit("show s01e02"))
    )
    return typed_requests(spark, sf).withColumn("query", text).withColumn("season", F.when(n % 16 == 8, F.lit("4")).otherwise("")).withColumn(
        "ep", F.when(n % 24 == 1, F.lit("9")).when(n % 24 == 2, F.lit("7")).otherwise("")
    )


@query(
    "interactive_queries",
    """WITH t AS (SELECT event_id AS n, event_id % 8 AS k, event_id % 89 AS u, lpad((event_id % 30)::VARCHAR, 2, '0') AS two, event_id % 30 AS num FROM events),
      p AS (SELECT n, k, two, num, CASE k WHEN 0 THEN 'show ' || u WHEN 1 THEN 'show' WHEN 2 THEN 'show-' WHEN 3 THEN 'show'
          WHEN 4 THEN CASE WHEN n * 37 BETWEEN 1 AND 99999999 THEN '' ELSE 'tt' || (n * 37) END
          WHEN 5 THEN 'xS' || two || 'E01' WHEN 6 THEN 'tt0000!0' ELSE 'show s01e02' END AS query,
        CASE WHEN k = 4 AND n * 37 BETWEEN 1 AND 99999999 THEN 'tt' || lpad((n * 37)::VARCHAR, greatest(7, length((n * 37)::VARCHAR))::INT, '0') ELSE '' END AS new_imdb,
        CASE WHEN k IN (0, 2, 3) THEN num::VARCHAR WHEN n % 16 = 8 THEN '4' ELSE '' END AS season,
        CASE WHEN k = 0 THEN ltrim((n % 10)::VARCHAR, '0') WHEN k = 1 THEN ltrim(two, '0') WHEN k = 3 THEN ltrim(two || 'b', '0')
          WHEN n % 24 = 1 THEN '9' WHEN n % 24 = 2 THEN '7' ELSE '' END AS ep FROM t)
      SELECT n AS request_id, query, season, ep, CASE WHEN k = 4 AND new_imdb != '' THEN '' ELSE 'search' END AS type,
        CASE WHEN k = 0 THEN 'S' || two || 'E0' || (n % 10) WHEN k = 1 THEN 'E' || two
          WHEN k = 2 THEN CASE WHEN ep != '' THEN '' ELSE 'S' || two END
          WHEN k = 3 THEN 'E' || two || 'b|S' || two ELSE '' END AS episode_terms,
        new_imdb AS typed_imdb FROM p""",
)
def interactive_queries(spark, sf):
    out = rq.parse_interactive(_typed_queries(spark, sf).withColumn("imdbid", F.lit("")))
    return out.select(
        "request_id", "query", "season", "ep", "type", F.array_join("episode_terms", "|").alias("episode_terms"),
        F.col("imdbid").alias("typed_imdb"),
    )


# --- sources ----------------------------------------------------------------------------


def source_table(spark, sf):
    """One source per supplier, with varied capabilities."""
    s = fx.table(spark, sf, "supplier")
    k = F.col("s_suppkey")

    def params(*names: str) -> Column:
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")

    modes = (
        F.when(k % 5 == 0, F.create_map().cast("map<string,array<string>>"))
        .when(k % 5 == 1, F.create_map(F.lit("search"), params("q"), F.lit("tv-search"), params("q", "season", "rid")))
        .when(k % 5 == 2, F.create_map(F.lit("search"), params(), F.lit("audio-search"), params("q", "artist")))
        .when(k % 5 == 3, F.create_map(F.lit("movie-search"), params("q", "imdbid", "year")))
        .otherwise(F.create_map(F.lit("search"), params("q"), F.lit("music-search"), params("album", "q")))
    )
    site = F.concat(F.lit("https://s"), k.cast("string"), F.lit(".invalid/"))
    return s.select(
        F.col("s_name").alias("id"),
        F.concat(F.lit("Shop "), k.cast("string")).alias("name"),
        F.lit("").alias("description"),
        F.when(k % 2 == 0, "en-US").otherwise("de-DE").alias("language"),
        F.when(k % 3 == 0, "public").when(k % 3 == 1, "Private").otherwise("semi-private").alias("type"),
        F.array(site, F.concat(site, F.lit("b/"))).alias("links"),
        F.when(k % 4 == 0, F.array(F.concat(site, F.lit("old/")))).otherwise(F.array().cast("array<string>")).alias("legacy_links"),
        F.array(F.concat(F.lit("Old#"), k.cast("string")), F.concat(F.lit("Supplier#"), F.lpad((k + 1).cast("string"), 9, "0"))).alias("replaces"),
        F.lit("").alias("encoding"), F.lit(0.0).alias("request_delay"), (k % 10 == 9).alias("allow_raw_search"),
        (k % 4 == 0).alias("allow_tv_imdb"), modes.alias("modes"), F.lit(False).alias("requires_login"),
        F.lit(False).alias("pages_server_side"), F.concat(F.col("s_name"), F.lit(".yml")).alias("file_name"),
    )


CAPABILITIES = """
caps(k, c) AS (SELECT s_name, unnest(list_filter(['any',
    CASE WHEN s_suppkey % 5 IN (0, 3) THEN 'movie:imdbid' END, CASE WHEN s_suppkey % 4 = 0 THEN 'tv:imdb' END,
    CASE WHEN s_suppkey % 5 = 1 THEN 'tv:rid' END, CASE WHEN s_suppkey % 5 = 0 THEN 'tv:tvdbid' END,
    CASE WHEN s_suppkey % 5 IN (0, 1) THEN 'mode:tvsearch' END, CASE WHEN s_suppkey % 5 IN (0, 3) THEN 'mode:movie' END,
    CASE WHEN s_suppkey % 5 IN (2, 4) THEN 'mode:music' END], lambda x: x IS NOT NULL)) FROM supplier),
needs AS (SELECT request_id, unnest(CASE WHEN imdbid != '' THEN CASE WHEN type = 'tvsearch' THEN ['movie:imdbid', 'tv:imdb'] ELSE ['movie:imdbid'] END
    ELSE list_filter([CASE WHEN type = 'search' THEN 'any' ELSE 'mode:' || type END, CASE WHEN tvrageid != '' THEN 'tv:rid' END,
      CASE WHEN tvdbid != '' THEN 'tv:tvdbid' END], lambda x: x IS NOT NULL) END) AS c FROM typed),
routed AS (SELECT DISTINCT request_id, k FROM needs JOIN caps USING (c))"""


@query(
    "route_requests",
    f"""WITH {TYPED}, {CAPABILITIES} SELECT t.request_id, count(k) AS n_sources, coalesce(min(k), '') AS first_source, coalesce(max(k), '') AS last_source
      FROM typed t LEFT JOIN routed USING (request_id) GROUP BY t.request_id""",
)
def route_requests(spark, sf):
    """Each request's need set, met with what is known of the set's sources."""
    needing, routes = routing.route_requests(typed_requests(spark, sf), source_table(spark, sf))
    about = routes.groupBy("needs").agg(F.count("*").alias("n_sources"), F.min("source").alias("first_source"), F.max("source").alias("last_source"))
    return needing.join(about, "needs", "left").select(
        "request_id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("first_source", F.lit("")).alias("first_source"),
        F.coalesce("last_source", F.lit("")).alias("last_source"),
    )


@query(
    "unsupported_requests",
    f"WITH {TYPED}, {CAPABILITIES} SELECT request_id, type FROM typed ANTI JOIN routed USING (request_id)",
)
def unsupported_requests(spark, sf):
    return routing.unsupported(*routing.route_requests(typed_requests(spark, sf), source_table(spark, sf))).select("request_id", "type")


@query(
    "restrict_sources",
    "SELECT s_name AS id FROM supplier WHERE s_suppkey IN (SELECT user_id * 2 FROM events)",
)
def restrict_sources(spark, sf):
    wanted = fx.table(spark, sf, "events").select(
        F.concat(F.lit("Supplier#"), F.lpad((F.col("user_id") * 2).cast("string"), 9, "0")).alias("source")
    )
    return routing.restrict_sources(source_table(spark, sf), wanted).select("id")


@query(
    "resolve_sources",
    """WITH r AS (SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN 'Old#' || user_id
          WHEN event_id % 3 = 1 THEN 'Supplier#' || lpad(user_id::VARCHAR, 9, '0') ELSE 'gone' || user_id END AS source, user_id, event_id FROM events),
      n AS (SELECT max(s_suppkey) AS top FROM supplier)
      SELECT request_id, source, coalesce(CASE WHEN event_id % 3 = 0 THEN (SELECT s_name FROM supplier WHERE s_suppkey = user_id)
        WHEN event_id % 3 = 1 THEN (SELECT s_name FROM supplier WHERE s_suppkey = least(user_id, (SELECT top FROM n)) AND user_id <= (SELECT top + 1 FROM n)) END, '') AS resolved FROM r""",
)
def resolve_sources(spark, sf):
    n, u = F.col("event_id"), F.col("user_id").cast("string")
    asked = fx.table(spark, sf, "events").select(
        n.alias("request_id"),
        F.when(n % 3 == 0, F.concat(F.lit("Old#"), u)).when(n % 3 == 1, F.concat(F.lit("Supplier#"), F.lpad(u, 9, "0"))).otherwise(
            F.concat(F.lit("gone"), u)
        ).alias("source"),
    )
    return routing.resolve_source(asked, source_table(spark, sf)).withColumn("resolved", F.coalesce("resolved", F.lit("")))


@query(
    "resolve_settings",
    """SELECT s_name AS source, '' AS apikey,
      CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'True' ELSE '' END
        WHEN s_suppkey % 4 = 1 THEN 'True' WHEN s_suppkey % 2 = 0 THEN 'True' ELSE '' END AS freeleech,
      CASE WHEN s_suppkey % 3 = 0 THEN 'own' || s_suppkey ELSE s_nationkey::VARCHAR END AS sort FROM supplier""",
)
def resolve_settings(spark, sf):
    """Own overrides for every third source; for others those stored under a former id."""
    s = fx.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    rows = F.array(
        F.struct(F.lit("apikey").alias("name"), F.lit("text").alias("type"), F.lit(None).cast("string").alias("default")),
        F.struct(F.lit("freeleech").alias("name"), F.lit("checkbox").alias("type"), (k % 2 == 0).cast("string").alias("default")),
        F.struct(F.lit("sort").alias("name"), F.lit("select").alias("type"), F.col("s_nationkey").cast("string").alias("default")),
    )
    settings = s.select(F.col("s_name").alias("source"), F.inline(rows))
    own = s.filter(k % 3 == 0).select(F.col("s_name").alias("source"), F.lit("sort").alias("name"), F.concat(F.lit("own"), k.cast("string")).alias("value"))
    former = s.filter(k % 4 == 1).select(F.concat(F.lit("Old#"), k.cast("string")).alias("source"), F.lit("freeleech").alias("name"), F.lit("1").alias("value"))
    sources = source_table(spark, sf).withColumn("replaces", F.slice("replaces", 1, 1))
    out = routing.resolve_settings(settings, own.unionByName(former), sources)
    return out.select("source", *[F.try_element_at("config", F.lit(n)).alias(n) for n in ("apikey", "freeleech", "sort")])


HEALTH = """
health AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 200) AS failures FROM events GROUP BY user_id)"""


@query(
    "source_filter",
    f"""WITH {HEALTH}, s AS (SELECT s_name AS id, s_suppkey AS k, coalesce(failures, 0) AS failures, h.user_id IS NOT NULL AS scraped
        FROM supplier LEFT JOIN health h ON user_id = s_suppkey)
      SELECT id FROM s WHERE (k % 3 = 0 AND k % 2 = 0 AND NOT failures > 0) OR (NOT scraped AND k % 3 = 1)""",
)
def source_filter(spark, sf):
    e = fx.table(spark, sf, "events")
    health = e.groupBy(F.concat(F.lit("Supplier#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("id")).agg(
        F.count_if((F.col("event_type") == "error") & (F.col("value") > 200)).alias("failures"), F.lit(True).alias("scraped")
    )
    sources = source_table(spark, sf).join(health, "id", "left")
    chosen = sources.filter(routing.source_predicate("TYPE:public + lang:EN+!test:failed, status:unknown+type:private"))
    return chosen.select("id")


MODES = """
declared AS (SELECT s_nationkey AS nation, s_suppkey AS id, unnest(CASE s_suppkey % 5
    WHEN 0 THEN [{'mode': 'search', 'params': ['q']}, {'mode': 'tv-search', 'params': ['q', 'season', 'ep', 'tvdbid']}, {'mode': 'movie-search', 'params': ['q', 'imdbid']}]
    WHEN 1 THEN [{'mode': 'search', 'params': ['q']}, {'mode': 'tv-search', 'params': ['q', 'season', 'rid']}]
    WHEN 2 THEN [{'mode': 'search', 'params': ['q']}, {'mode': 'audio-search', 'params': ['q', 'artist']}]
    WHEN 3 THEN [{'mode': 'movie-search', 'params': ['q', 'imdbid', 'year']}]
    ELSE [{'mode': 'search', 'params': ['q']}, {'mode': 'music-search', 'params': ['album', 'q']}] END) AS d FROM supplier)"""


@query(
    "merged_modes",
    f"""WITH {MODES}, p AS (SELECT DISTINCT d.mode AS mode, unnest(d.params) AS param FROM declared)
      SELECT mode, string_agg(param, ',' ORDER BY param) AS params FROM p GROUP BY mode""",
)
def merged_modes(spark, sf):
    return routing.merged_modes(source_table(spark, sf)).select("mode", joined("params").alias("params"))


@query(
    "merged_modes_by_nation",
    f"""WITH {MODES}, size AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1),
      p AS (SELECT DISTINCT nation, d.mode AS mode, unnest(d.params) AS param FROM declared),
      merged AS (SELECT nation, mode, string_agg(param, ',' ORDER BY param) AS params FROM p GROUP BY ALL)
      SELECT m.nation AS by, m.mode AS mode, CASE WHEN n = 1 THEN array_to_string(any_value(d.params), ',') ELSE params END AS params
      FROM declared JOIN size ON size.nation = declared.nation JOIN merged m ON m.nation = declared.nation AND m.mode = d.mode
      GROUP BY m.nation, m.mode, n, params""",
)
def merged_modes_by_nation(spark, sf):
    """Every nation's sources as a set: single ones keep their order, and a mode that one of several has is sorted."""
    sources = source_table(spark, sf).join(fx.table(spark, sf, "supplier").select(F.col("s_name").alias("id"), "s_nationkey"), "id")
    return routing.merged_modes(sources, F.col("s_nationkey")).select("by", "mode", joined("params").alias("params"))


@query(
    "source_caps",
    f"""WITH {sql.taxonomy()}, {BRAND_MAPPINGS}, c AS (SELECT 'Supplier#' || lpad((substr(source, 7)::INT)::VARCHAR, 9, '0') AS id,
        count(DISTINCT std_id) + count(DISTINCT custom_id) AS n FROM resolved GROUP BY source)
      SELECT s_name AS id, coalesce(n, 0) AS categories, 50 AS limit_default, 100 AS limit_max,
        CASE s_suppkey % 5 WHEN 2 THEN 'q,artist' WHEN 4 THEN 'album,q' ELSE '' END AS audio, '' AS book,
        CASE s_suppkey % 5 WHEN 0 THEN 'q,imdbid' WHEN 3 THEN 'q,imdbid,year' ELSE '' END AS movie,
        CASE WHEN s_suppkey % 5 = 3 THEN 'no' ELSE 'yes' END AS search,
        CASE s_suppkey % 5 WHEN 0 THEN 'q,season,ep,tvdbid' WHEN 1 THEN 'q,season,rid' ELSE '' END AS tv,
        CASE WHEN s_suppkey % 10 = 9 THEN 'raw' ELSE '' END AS engine FROM supplier LEFT JOIN c ON c.id = s_name""",
)
def source_caps(spark, sf):
    mappings = brand_mappings(spark, sf).withColumn(
        "source", F.concat(F.lit("Supplier#"), F.lpad(F.regexp_extract("source", "([0-9]+)", 1), 9, "0"))
    )
    c = routing.caps(source_table(spark, sf), mappings, tax.taxonomy(spark))
    return c.select(
        "id", F.size("categories").alias("categories"), F.col("limits.default").alias("limit_default"), F.col("limits.max").alias("limit_max"),
        F.col("searching.audio_search.supportedParams").alias("audio"), F.col("searching.book_search.supportedParams").alias("book"),
        F.col("searching.movie_search.supportedParams").alias("movie"), F.col("searching.search.available").alias("search"),
        F.col("searching.tv_search.supportedParams").alias("tv"), F.col("searching.search.searchEngine").alias("engine"),
    )


@query(
    "aggregate_caps",
    f"""WITH {sql.taxonomy()}, {BRAND_MAPPINGS}, {MODES}, p AS (SELECT DISTINCT d.mode AS mode, unnest(d.params) AS param FROM declared),
      m AS (SELECT mode, string_agg(param, ',' ORDER BY param) AS params FROM p GROUP BY mode)
      SELECT (SELECT count(DISTINCT std_id) FROM resolved) AS categories,
        coalesce((SELECT params FROM m WHERE mode = 'music-search'), (SELECT params FROM m WHERE mode = 'audio-search'), '') AS audio,
        coalesce((SELECT params FROM m WHERE mode = 'movie-search'), '') AS movie, coalesce((SELECT params FROM m WHERE mode = 'tv-search'), '') AS tv,
        CASE WHEN EXISTS (SELECT 1 FROM m WHERE mode = 'search') THEN 'yes' ELSE 'no' END AS search,
        CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 10 = 9) THEN 'raw' ELSE '' END AS engine""",
)
def aggregate_caps(spark, sf):
    c = routing.aggregate_caps(source_table(spark, sf), brand_mappings(spark, sf), tax.taxonomy(spark))
    return c.select(
        F.size("categories").alias("categories"), F.col("searching.audio_search.supportedParams").alias("audio"),
        F.col("searching.movie_search.supportedParams").alias("movie"), F.col("searching.tv_search.supportedParams").alias("tv"),
        F.col("searching.search.available").alias("search"), F.col("searching.search.searchEngine").alias("engine"),
    )


LISTED = f"""{sql.taxonomy()}, {BRAND_MAPPINGS}, c AS (SELECT 'Supplier#' || lpad((substr(source, 7)::INT)::VARCHAR, 9, '0') AS id,
        count(DISTINCT std_id) + count(DISTINCT custom_id) AS n FROM resolved GROUP BY source)"""


def _source_mappings(spark, sf):
    """The brands' mappings as those of the source with the same number."""
    number = F.lpad(F.regexp_extract("source", "([0-9]+)", 1), 9, "0")
    return brand_mappings(spark, sf).withColumn("source", F.concat(F.lit("Supplier#"), number))


@query(
    "source_list",
    f"""WITH {LISTED} SELECT s_name AS id, 'Shop ' || s_suppkey AS title, 'https://s' || s_suppkey || '.invalid/' AS link, 1 AS configured, '' AS description,
        CASE WHEN s_suppkey % 2 = 0 THEN 'en-US' ELSE 'de-DE' END AS language,
        CASE s_suppkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'Private' ELSE 'semi-private' END AS type, coalesce(n, 0) AS categories, 50 AS limit_default, 100 AS limit_max,
        CASE s_suppkey % 5 WHEN 0 THEN 'q,season,ep,tvdbid' WHEN 1 THEN 'q,season,rid' ELSE '' END AS tv FROM supplier LEFT JOIN c ON c.id = s_name""",
)
def source_list(spark, sf):
    out = routing.source_list(source_table(spark, sf), _source_mappings(spark, sf), tax.taxonomy(spark))
    return out.select(
        "id", "title", "link", flag("configured").alias("configured"), "description", "language", "type", F.size("categories").alias("categories"),
        F.col("limits.default").alias("limit_default"), F.col("limits.max").alias("limit_max"), F.col("searching.tv_search.supportedParams").alias("tv"),
    )


@query(
    "source_directory_json",
    f"""WITH {LISTED} SELECT s_name AS id, 'https://s' || s_suppkey || '.invalid/' AS site_link, 'https://s' || s_suppkey || '.invalid/b/' AS alternative,
        'Shop ' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'en-US' ELSE 'de-DE' END AS language,
        CASE s_suppkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'Private' ELSE 'semi-private' END AS type, coalesce(n, 0) AS caps,
        'true' AS configured, '' AS last_error, 'false' AS potatoenabled FROM supplier LEFT JOIN c ON c.id = s_name""",
)
def source_directory_json(spark, sf):
    out = routing.source_directory_json(source_table(spark, sf), _source_mappings(spark, sf), tax.taxonomy(spark))
    doc = F.try_parse_json("json")
    text = lambda path: F.try_variant_get(doc, path, "string")
    return out.select(
        "id", text("$.site_link").alias("site_link"), text("$.alternativesitelinks[0]").alias("alternative"),
        *[text(f"$.{k}").alias(k) for k in ("name", "language", "type", "configured", "last_error", "potatoenabled")],
        F.size(F.try_variant_get(doc, "$.caps", "array<variant>")).alias("caps"),
    )


@query(
    "and_match_stand_down",
    f"""WITH {TYPED}, p AS (SELECT t.*, s.* FROM typed t JOIN supplier s ON s_suppkey = request_id % (SELECT count(*) FROM supplier))
      SELECT request_id, ((imdbid != '' AND (s_suppkey % 5 = 3 OR s_suppkey % 4 = 0)) OR (tvrageid != '' AND s_suppkey % 4 = 0))::INT AS stands_down FROM p""",
)
def and_match_stand_down(spark, sf):
    """The advertised-id gate of every request against one source each."""
    sources = source_table(spark, sf).withColumn("n", F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint"))
    many = fx.table(spark, sf, "supplier").agg(F.count("*")).scalar()
    asked = typed_requests(spark, sf).drop("type").withColumn("n", F.col("request_id") % many)
    pairs = asked.join(sources.select("n", "modes", "allow_tv_imdb"), "n")
    return pairs.select("request_id", flag(routing.id_search_supported()).alias("stands_down"))


# --- planning ---------------------------------------------------------------------------


def path_table(spark, sf):
    """Three search paths per source: one open, one for some categories, one for all but some."""
    s = fx.table(spark, sf, "supplier").select(F.col("s_name").alias("source"), F.col("s_suppkey").alias("k"))

    def row(i: int, path: str, method: str, *categories: str) -> Column:
        cats = F.array(*[F.lit(c) for c in categories]).cast("array<string>")
        return F.struct(F.lit(i).alias("path_ordinal"), F.lit(path).alias("path"), F.lit(method).alias("method"), cats.alias("categories"))

    rows = F.array(row(0, "list+all.php?x=1", "get"), row(1, "/list%20all.php?x=1", "get", "2000", "5040"), row(2, "../post.php", "post", "!", "7000"))
    return s.select("source", F.inline(rows))


@query(
    "fetch_frontier",
    f"""WITH {sql.requests()}, m AS (SELECT s_name AS source, s_suppkey AS k, unnest(CASE WHEN s_suppkey % 4 = 0
          THEN ['', 'b/', 'old/'] ELSE ['', 'b/'] END) AS tail FROM supplier),
      r AS (SELECT request_id, source, categories, 'https://s' || k || '.invalid/' || tail AS mirror, 'https://s' || k || '.invalid/' AS site, tail
        FROM requests JOIN m USING (source)),
      p AS (SELECT *, 0 AS path_ordinal, mirror || 'list%20all.php?x=1' AS url, array_to_string(categories, ',') AS cats FROM r
        UNION ALL SELECT *, 1, site || 'list%20all.php?x=1', array_to_string(list_filter(categories, lambda c: c IN ('2000', '5040')), ',') FROM r
          WHERE list_has_any(categories, ['2000', '5040']) AND tail != ''
        UNION ALL SELECT *, 2, site || 'post.php', '' FROM r WHERE NOT list_has_any(categories, ['7000']))
      SELECT request_id, source, mirror, path_ordinal, url, cats AS request_categories FROM p""",
)
def fetch_frontier(spark, sf):
    requests = fx.requests(spark, sf).select("request_id", "source", F.col("categories").alias("site_categories"))
    plan = frontier.plan_frontier(requests, source_table(spark, sf), path_table(spark, sf))
    return plan.select("request_id", "source", "mirror", "path_ordinal", "url", joined("request_categories").alias("request_categories"))


@query(
    "request_forms",
    f"""WITH {TYPED} SELECT request_id, array_to_string(list_filter([CASE WHEN artist != '' THEN 'artist=+The++Band+' END,
        CASE WHEN genre != '' THEN 'genre=' || genre END, 'page=' || "offset" || '&page=' || (request_id % 4) || '%26', 'q=fixed~+%2A'],
        lambda x: x IS NOT NULL), '&') AS form FROM typed""",
)
def request_forms(spark, sf):
    """Shared inputs under the path's own, blanks left out, a raw fragment added as repeated values."""
    from gleanery.functions import urls

    r = typed_requests(spark, sf)
    form = urls.request_form(
        {"q": F.col("query"), "artist": F.col("artist"), "page": F.col("offset").cast("string")},
        {"q": F.lit("fixed~ *"), "genre": F.col("genre"), "$raw": F.concat(F.lit("&page="), (F.col("request_id") % 4).cast("string"), F.lit("%26&"))},
    )
    return r.select("request_id", urls.encode_form(form).alias("form"))


@query(
    "site_links",
    """SELECT s_name AS source, CASE WHEN s_suppkey % 2 = 0 THEN 'own' || s_suppkey ELSE 'https://s' || s_suppkey || '.invalid/' END AS sitelink FROM supplier""",
)
def site_links(spark, sf):
    s = source_table(spark, sf).withColumn("k", F.regexp_extract("id", "([0-9]+)$", 1).cast("int"))
    config = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("sitelink"), F.concat(F.lit("own"), F.col("k").cast("string")))).otherwise(
        F.create_map(F.lit("sort"), F.lit("new"))
    )
    linked = frontier.with_site_link(config, F.get("links", 0))
    return s.select(F.col("id").alias("source"), F.try_element_at(linked, F.lit("sitelink")).alias("sitelink"))
