"""SQL definitions of the derived tables (fixtures.py), for the counterpart of each query."""

from __future__ import annotations

MEDIUM_ID = "100000 + ('0x' || substr(sha1('MEDIUM'), 3, 2) || substr(sha1('MEDIUM'), 1, 2))::INT"
LARGE_ID = "100000 + ('0x' || substr(sha1('LARGE'), 3, 2) || substr(sha1('LARGE'), 1, 2))::INT"

TYPE_CATEGORIES = f"""CASE p_type WHEN 'ECONOMY' THEN [2030] WHEN 'SMALL' THEN [2040, 5040]
  WHEN 'MEDIUM' THEN [5030, {MEDIUM_ID}] WHEN 'STANDARD' THEN [3010]
  WHEN 'LARGE' THEN [7020, {LARGE_ID}] ELSE []::INT[] END"""

SIGHTINGS = f"""
sightings0 AS (
  SELECT s_name AS tracker, p_name || ' ' || p_brand || ' ' || p_type AS name,
    CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber % 2 = 1 THEN upper(md5(l_orderkey::VARCHAR) || '00000000')
      ELSE md5(l_orderkey::VARCHAR) || '00000000' END ELSE '' END AS infohash,
    CASE WHEN l_returnflag = 'A' THEN 'https://x.invalid/' || l_orderkey || '/' || l_linenumber ELSE '' END AS details_url,
    CASE WHEN l_linestatus = 'O' THEN l_shipdate END AS published,
    l_shipdate + to_days(l_linenumber) AS last_seen,
    l_quantity::INT AS seeders, l_linenumber AS leechers, l_quantity::BIGINT * 1048576 AS size,
    {TYPE_CATEGORIES} AS categories,
    CASE WHEN l_partkey % 3 = 0 THEN lpad(l_partkey::VARCHAR, 7, '0') ELSE '' END AS imdbid,
    CASE WHEN l_partkey % 5 = 0 THEN l_suppkey::VARCHAR ELSE '' END AS tvdbid,
    l_linenumber % 2 = 0 AS search_managed, l_returnflag AS search_key,
    row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
sightings AS (
  SELECT *, CASE WHEN infohash != '' THEN 'btih:' || lower(infohash) WHEN details_url != '' THEN 'url:' || details_url
    ELSE 'title:' || name END AS identity FROM sightings0)"""

LISTINGS = f"""{SIGHTINGS},
listings AS (
  SELECT tracker, identity, arg_max(name, seq) AS name, arg_max(infohash, seq) AS infohash,
    arg_max(details_url, seq) AS details_url, arg_max(published, seq) AS published,
    arg_max(last_seen, seq) AS last_seen, arg_max(seeders, seq) AS seeders, arg_max(leechers, seq) AS leechers,
    arg_max(size, seq) AS size, arg_max(categories, seq) AS categories, arg_max(imdbid, seq) AS imdbid,
    arg_max(tvdbid, seq) AS tvdbid, bool_or(search_managed) AS search_managed, min(seq) AS id
  FROM sightings GROUP BY tracker, identity)"""

SEARCHES = """
searches AS (
  SELECT tracker, search_key, identity, max(last_seen) AS last_seen FROM sightings
  WHERE search_managed GROUP BY ALL)"""


def fixed_list(rows: list[list[str]]) -> str:
    """A list of lists of text as a SQL literal."""
    quoted = [
        "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + "]::VARCHAR[]" for row in rows
    ]
    return "[" + ", ".join(quoted) + "]"


def requests() -> str:
    from gleanery.fixtures import REQUEST_CATEGORIES, REQUEST_TERMS

    return f"""
requests AS (
  SELECT event_id AS request_id, ts, 'Supplier#' || lpad((user_id % 10)::VARCHAR, 9, '0') AS source, event_type AS key,
    {fixed_list(REQUEST_TERMS)}[(event_id % {len(REQUEST_TERMS)}) + 1] AS terms,
    {fixed_list(REQUEST_CATEGORIES)}[((event_id // 3) % {len(REQUEST_CATEGORIES)}) + 1] AS categories,
    CASE WHEN event_type = 'purchase' THEN ['Supplier#' || lpad((user_id % 10)::VARCHAR, 9, '0')] ELSE []::VARCHAR[] END AS trackers,
    event_type = 'view' AS needs_category, 5 AS "limit", CASE WHEN event_type = 'click' THEN 3 ELSE 0 END AS "offset"
  FROM events)"""


SEARCH_REQUESTS = """
search_requests AS (
  SELECT event_id AS request_id, CASE WHEN k < 2 THEN []::VARCHAR[] WHEN k < 5 THEN [substr(p_type, 1, 1)] WHEN k < 9 THEN [substr(w[2], 1, 3), lower(p_brand)]
      WHEN k < 14 THEN [w[1], upper(w[2]), lower(p_brand)] ELSE [w[2] || ' ' || lower(p_brand), lower(substr(p_type, 2, 4))] END AS terms,
    CASE WHEN k IN (5, 10, 15) THEN ['2000', '5040'] WHEN k = 16 THEN ['3010'] ELSE []::VARCHAR[] END AS categories,
    CASE WHEN k < 5 THEN ['Supplier#' || lpad((user_id % 10)::VARCHAR, 9, '0')] ELSE []::VARCHAR[] END AS trackers, k = 11 AS needs_category,
    CASE WHEN k IN (12, 13) THEN [lower(p_type)] ELSE []::VARCHAR[] END AS unsearched, CASE WHEN k IN (1, 6) THEN p_partkey::VARCHAR ELSE '' END AS imdb,
    CASE WHEN k IN (3, 7, 17, 18) THEN ['R', 'A', 'N'][event_id % 3 + 1] ELSE '' END AS query_key,
    CASE WHEN event_id % 997 = 0 THEN 10000 ELSE 5 END AS "limit", CASE WHEN k IN (2, 8) THEN event_id % 300 ELSE 0 END AS "offset"
  FROM (SELECT *, event_id % 20 AS k, string_split(p_name, ' ') AS w FROM events JOIN part ON p_partkey = (event_id * 7) % (SELECT count(*) FROM part) + 1))"""

ATTEMPTS = """
attempts AS (
  SELECT user_id::VARCHAR AS source, event_type AS key, event_id AS attempt_id, ts AS started,
    ts + to_microseconds(round(value * 1000000)::BIGINT) AS ended, event_type != 'error' AS ok FROM events)"""


def taxonomy() -> str:
    from gleanery.operators.taxonomy import STANDARD_CATEGORIES

    rows = ", ".join(f"('{name}', {i}, {i - i % 1000})" for name, i in STANDARD_CATEGORIES.items())
    return f"\ntaxonomy(name, id, parent_id) AS (VALUES {rows})"


def folded(column: str) -> str:
    """Text of a nullable timestamp column."""
    return f"coalesce(strftime({column}, '%Y-%m-%d %H:%M:%S'), '')"
