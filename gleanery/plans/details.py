"""Smaller behaviours, each with a query of its own: row and field removal, nested JSON rows, appended fields,
literal wildcards, cleaned requests, rendered paths, written feeds and results, scheduled sweeps."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gleanery import fixtures as fx
from gleanery.functions import dates, urls
from gleanery.functions.coerce import SPACE
from gleanery.functions.templates import TemplateEnv, as_column, template_col
from gleanery.operators import extract, frontier, render, requests, search as s, taxonomy as tax
from gleanery.plans import rendering, sql, upkeep
from gleanery.plans.asking import path_table, source_table
from gleanery.plans.capture import NOW, rules, site_pages
from gleanery.plans.registry import joined, query, stamp
from gleanery.session import shared_path
from gleanery.sources import feeds, pages as page_source
from gleanery.sources.store import ListingStore
from gleanery.streaming import ingest

#: The white space class as the SQL engine's expressions spell it.
SQL_SPACE = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", SPACE)

TRIMMED = """
search:
  path: page
  rows: {selector: nav ul li, remove: "li:first-child"}
  fields:
    title: {selector: a}
    rest: {selector: li, remove: a, optional: true, default: nothing else}
    "title|append": {text: " of {{ .Config.shop }}"}
"""


@query(
    "removed_rows",
    r"""WITH n AS (SELECT page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1) AS nav FROM pages),
      l AS (SELECT page_id, unnest(regexp_extract_all(nav, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS title,
        unnest(range(len(regexp_extract_all(nav, '<li>')))) AS i FROM n)
      SELECT page_id, i - 1 AS row_no, replace(title, '&amp;', '&') || ' of Corner' AS title, 'nothing else' AS rest FROM l WHERE i >= 1 AND title != ''""",
)
def removed_rows(spark, sf):
    """Rows a selector takes out, fields without a part of their text, and a field appended to an earlier one."""
    got = extract.kept_rows(extract.extract_rows(site_pages(spark, sf), rules(TRIMMED), NOW, config={"shop": "Corner"}))
    return got.where("fields['title'] != ' of Corner'").select("page_id", "row_no", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in ("title", "rest")])


NESTED = """
search:
  paths: [{path: q, response: {type: JSON}}]
  rows: {selector: groups, attribute: files, multiple: true}
  fields:
    title: {selector: name}
    group: {selector: ..label}
"""


@query(
    "nested_rows",
    """WITH e AS (SELECT event_id, user_id, event_type FROM events), g AS (SELECT event_id, user_id, event_type, unnest(range(user_id % 3)) AS gi FROM e),
      f AS (SELECT event_id, gi, event_type, unnest(range(1 + (event_id + gi) % 3)) AS fi FROM g)
      SELECT event_id AS page_id, (row_number() OVER (PARTITION BY event_id ORDER BY gi, fi) - 1)::INT AS row_no, event_type || '-' || gi || '-' || fi AS title, 'G' || gi AS "group" FROM f""",
)
def nested_rows(spark, sf):
    """Rows that lie in a list below each item of a list, with a field read off the item above."""
    e = fx.table(spark, sf, "events")

    def upto(n, make):  # noqa: ANN001, ANN202
        return F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < n), make)

    def one_file(g):  # noqa: ANN001, ANN202
        return lambda i: F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit("-"), g.cast("string"), F.lit("-"), i.cast("string"), F.lit('"}'))

    def group(g):  # noqa: ANN001, ANN202
        files = F.array_join(upto(1 + (F.col("event_id") + g) % 3, one_file(g)), ",")
        return F.concat(F.lit('{"label": "G'), g.cast("string"), F.lit('", "files": ['), files, F.lit("]}"))

    body = F.concat(F.lit('{"groups": ['), F.array_join(upto(F.col("user_id") % 3, group), ","), F.lit("]}"))
    captured = e.select(F.col("event_id").alias("page_id"), F.lit("site").alias("source"), F.lit("https://site.invalid/q").alias("url"), F.lit("json").alias("format"), body.alias("body"))
    rows = extract.kept_rows(extract.extract_rows(captured, rules(NESTED), NOW))
    return rows.select("page_id", "row_no", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in ("title", "group")])


@query("literal_wildcards", "SELECT doc_id, contains(text, '%%%')::INT AS percent, contains(text, '_')::INT AS underscore, contains(lower(text), 'the%')::INT AS both FROM documents")
def literal_wildcards(spark, sf):
    """Percent signs and underscores in a term stand for themselves."""
    docs = fx.table(spark, sf, "documents").withColumn("name", F.col("text"))
    tests = {"percent": ["%%%"], "underscore": ["_"], "both": ["The%"]}
    return docs.select("doc_id", *[s.name_matches(t).cast("int").alias(n) for n, t in tests.items()])


@query(
    "cleaned_requests",
    rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\p{{Pd}}+', '-', 'g'), '[`´‘’]', '''', 'g'), '[^\p{{L}}\p{{Nd}}{SQL_SPACE}\-._()@/''\[\]+%]', '', 'g')) AS cleaned FROM documents""",
)
def cleaned_requests(spark, sf):
    """Whole documents as request text, with dashes and quotes unified and other signs dropped."""
    return fx.table(spark, sf, "documents").select("doc_id", F.md5(requests.sanitize(F.col("text")).cast("binary")).alias("cleaned"))


@query(
    "joined_categories",
    f"""WITH {sql.requests()} SELECT request_id, 'c=' || array_to_string(categories, ';') || CASE WHEN len(categories) > 0 THEN '&' ELSE '' END AS rendered FROM requests""",
)
def joined_categories(spark, sf):
    """A template that joins a list, and a condition on it."""
    env = TemplateEnv(categories=F.col("categories"))
    text = template_col('c={{ join .Categories ";" }}{{ if .Categories }}&{{ end }}', env)
    return fx.requests(spark, sf).select("request_id", as_column(text).alias("rendered"))


@query(
    "narrow_dates",
    """SELECT o_orderkey, strftime(o_orderdate + to_hours((12 + o_orderkey % 12)::BIGINT) + INTERVAL 30 MINUTE - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS parsed FROM orders""",
)
def narrow_dates(spark, sf):
    """Single-letter year, half of the day and zone."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 12
    hour = F.when(k == 0, F.lit(12)).otherwise(k).cast("string")
    text = F.concat(F.date_format(d, "d/M/yy "), hour, F.lit(":30 P +2"))
    return fx.spread(fx.table(spark, sf, "orders")).select("o_orderkey", stamp(dates.parse_declared(text, "d/M/y h:mm t z", NOW)).alias("parsed"))


@query(
    "rendered_paths",
    f"""WITH {sql.SEARCH_REQUESTS}, w AS (SELECT request_id, array_to_string(terms, ' ') AS kw, categories FROM search_requests)
      SELECT request_id, 'https://s1.invalid/b/browse/' || replace(replace(kw, '#', '%23'), ' ', '%20') || '/c' || array_to_string(categories, '-') || '.html?x=1'
        || CASE WHEN kw = '' THEN '' ELSE '&q=' || replace(replace(kw, '#', '%23'), ' ', '+') END AS url FROM w""",
)
def rendered_paths(spark, sf):
    """Search paths rendered from keywords and categories, resolved against a mirror, with the form appended."""
    asked = fx.search_requests(spark, sf).withColumn("kw", F.array_join("terms", " "))
    path = F.concat(F.lit("browse/"), urls.path_value(F.col("kw")), F.lit("/c"), F.array_join("categories", "-"), F.lit(".html?x=1"))
    form = urls.encode_form(urls.request_form(None, {"q": F.col("kw")}))
    return asked.select("request_id", urls.with_query(urls.request_url(F.lit("https://s1.invalid/b/"), path), form).alias("url"))


@query(
    "rendered_frontier",
    f"""WITH {sql.requests()}, r AS (SELECT request_id, source, array_to_string(terms, ' ') AS kw, categories, s_suppkey AS k FROM requests JOIN supplier ON s_name = source),
      m AS (SELECT *, unnest(CASE WHEN k % 4 = 0 THEN ['', 'b/', 'old/'] ELSE ['', 'b/'] END) AS tail FROM r)
      SELECT request_id, source, 'https://s' || k || '.invalid/' || tail AS mirror,
        'https://s' || k || '.invalid/' || tail || 'find/' || replace(replace(kw, '#', '%23'), ' ', '%20') AS url, count(*) AS paths
      FROM m, unnest([0, 1, 2]) p(i) WHERE i = 0 OR (i = 2 AND NOT list_has_any(categories, ['7000'])) GROUP BY ALL""",
)
def rendered_frontier(spark, sf):
    """The frontier with every path rendered from the request: equal GETs run once, POSTs all."""
    asked = fx.requests(spark, sf).select("request_id", "source", F.col("categories").alias("site_categories"), F.array_join("terms", " ").alias("kw"))
    plan = frontier.plan_frontier(asked, source_table(spark, sf), path_table(spark, sf), rendered=lambda p: F.concat(F.lit("find/"), urls.path_value(F.col("kw"))))
    return plan.groupBy("request_id", "source", "mirror", "url").agg(F.count("*").alias("paths"))


@query(
    "written_feeds",
    f"""WITH {rendering.FEED_PAGES} SELECT tracker AS request_id, name AS title, size AS length, total FROM pages0""",
)
def written_feeds(spark, sf):
    """Feeds written as XML files and read back from them."""
    path = shared_path(spark, "feeds")
    feeds.write_feed(rendering._feeds(spark, sf), path)
    schema = "_request string, response struct<_total:bigint>, item array<struct<title:string, enclosure:struct<_length:bigint>>>"
    back = spark.read.format("xml").option("rowTag", "channel").option("attributePrefix", "_").schema(schema).load(path)
    items = back.select(F.col("_request").alias("request_id"), F.col("response._total").alias("total"), F.explode("item").alias("i"))
    return items.select("request_id", F.col("i.title").alias("title"), F.col("i.enclosure._length").alias("length"), "total")


@query(
    "written_results",
    f"""WITH {sql.LISTINGS} SELECT tracker AS tracker_id, name AS title, seeders, leechers AS peers, size, CASE WHEN details_url != '' THEN details_url ELSE '' END AS details FROM listings""",
)
def written_results(spark, sf):
    """Results written as JSON lines and read back from the files."""
    path = shared_path(spark, "results")
    enriched = render.enrich(rendering.full_listings(spark, sf), source_table(spark, sf), fx.category_mappings(spark), tax.taxonomy(spark))
    feeds.write_results(render.results(enriched, rendering.BASE), path)
    back = spark.read.schema("TrackerId string, Title string, Seeders int, Peers int, Size bigint, Details string").json(path)
    return back.select(
        F.col("TrackerId").alias("tracker_id"), F.col("Title").alias("title"), F.col("Seeders").alias("seeders"), F.col("Peers").alias("peers"),
        F.col("Size").alias("size"), F.coalesce("Details", F.lit("")).alias("details"),
    )


@query(
    "scheduled_sweep",
    f"""WITH {sql.LISTINGS}, late AS (SELECT DISTINCT tracker, identity FROM sightings WHERE last_seen - to_days(leechers) >= {upkeep.CUT})
      SELECT {upkeep.STORED.format(managed='(late.tracker IS NOT NULL)::INT')} FROM listings LEFT JOIN late USING (tracker, identity)
      WHERE published >= TIMESTAMP '2000-01-01' OR (published IS NULL AND late.tracker IS NOT NULL)""",
)
def scheduled_sweep(spark, sf):
    """A sweep as a scheduler runs it: days of retention counted back from now; zero days is no sweep."""
    store = upkeep._two_batches(spark, sf)
    ingest.sweep(store, datetime(2000, 1, 31), 0)
    ingest.sweep(store, datetime(2000, 1, 1) + timedelta(days=90), 90)
    return upkeep._stored(store.listings())


@query(
    "captured_pages",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'json' WHEN page_id % 3 = 1 THEN 'xml' ELSE 'html' END AS format,
      md5(CASE WHEN strlen(html) <= 3000 THEN trim(replace(html, chr(10), ' ')) ELSE '' END) AS body, (strlen(html) > 3000)::INT AS rejected FROM pages""",
)
def captured_pages(spark, sf):
    """Pages stored as captured, scanned back, guarded by size and preprocessed."""
    path = shared_path(spark, "captured")
    kind = F.when(F.col("page_id") % 3 == 0, F.lit("JSON")).when(F.col("page_id") % 3 == 1, F.lit("Xml")).otherwise(F.lit(None))
    from gleanery.schema import PAGES

    raw = fx.responses(spark, sf).withColumn("format", kind)
    raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in PAGES.fields]).write.parquet(path)
    kept, rejects = page_source.split_oversize(page_source.read_pages(spark, path), 3000)
    ready = page_source.preprocess(kept, [{"name": "replace", "args": ["\n", " "]}, {"name": "trim"}])
    body = lambda c: F.md5(c.cast("binary")).alias("body")
    return ready.select("page_id", "format", body(F.col("body")), F.lit(0).alias("rejected")).union(
        rejects.select("page_id", "format", body(F.lit("")), F.lit(1).alias("rejected"))
    )


INGEST_RULES = {
    "s0": """id: s0
name: First
links: [https://s0.invalid/]
search:
  path: page
  rows: {selector: nav ul li}
  fields:
    title: {selector: a}
    size: {text: "{{ .Config.weight }} MB"}
settings: [{name: weight, type: text, default: "7"}]
""",
    "s1": "id: [unclosed",
    "s2": """id: s2
name: Third
links: [https://s2.invalid/]
search:
  path: page
  rows: {selector: nav ul li}
  fields:
    name: {selector: a}
    title: {text: '{{ re_replace .Result.name "(" "x" }}'}
""",
    "s3": """id: s3
name: Fourth
links: [https://s3.invalid/]
search:
  path: page
  error: [{selector: "nav:not(:has(li:nth-child(6)))", message: {selector: b}}]
  rows: {selector: nav ul li, after: 1}
  fields:
    title: {selector: a}
""",
}
#: The first source's rules as they are when the second half of the pages arrives.
CHANGED = INGEST_RULES["s0"].replace("title: {selector: a}", 'title: {selector: a, filters: [{name: append, args: " (new)"}]}')


def _put(spark, path: str, text: str) -> None:
    """A small text file in any store the session knows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    out.write(bytearray(text.encode()))
    out.close()


@query(
    "ingest_pages",
    r"""WITH p AS (SELECT page_id, 's' || page_id % 4 AS source, page_id % 8 >= 4 AS second, html, regexp_extract(html, '<nav>(.*?)</nav>', 1) AS nav FROM pages),
      kept AS (SELECT *, len(regexp_extract_all(nav, '<li>')) AS items FROM p WHERE strlen(html) <= 4000),
      l AS (SELECT source, second, items, unnest(regexp_extract_all(nav, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS title,
        unnest(range(len(regexp_extract_all(nav, '<li>')))) AS i FROM kept WHERE source IN ('s0', 's3')),
      t AS (SELECT source, replace(title, '&amp;', '&') || CASE WHEN source = 's0' AND second THEN ' (new)' ELSE '' END AS name FROM l
        WHERE title != '' AND (source = 's0' OR (i >= 1 AND items >= 6)))
      SELECT DISTINCT 'listing' AS kind, source AS key, name AS text, CASE WHEN source = 's0' THEN 9 * 1048576 ELSE 0 END AS size FROM t
      UNION ALL SELECT 'error', page_id::VARCHAR, 'response of ' || strlen(html) || ' bytes exceeds 4000', 0 FROM p WHERE strlen(html) > 4000
      UNION ALL SELECT 'error', page_id::VARCHAR, CASE source WHEN 's1' THEN 'no usable rules' WHEN 's2' THEN 're_replace: bad pattern ' || chr(39) || '(' || chr(39)
          ELSE 'tracker reported an error' END, 0 FROM kept WHERE source IN ('s1', 's2') OR (source = 's3' AND items < 6)""",
)
def ingest_pages(spark, sf):
    """Pages arriving in two batches with a rule change between, from four sources: one with settings of its own, one
    with a broken rule file, one whose rules do not compile, one with error pages; some pages over the size cap."""
    from gleanery.schema import PAGES

    root = shared_path(spark, "ingest-pages")
    raw = fx.table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("s"), (F.col("page_id") % 4).cast("string")).alias("source"), "url", F.lit(None).cast("timestamp").alias("fetched_at"),
        F.lit("html").alias("format"), F.col("html").alias("body"),
    )
    for source, text in INGEST_RULES.items():
        _put(spark, f"{root}/rules/{source}.yml", text)
    _put(spark, f"{root}/settings/s0.yml", 'weight: "9"')
    store = ListingStore(spark, f"{root}/store", buckets=4)
    for half in (raw.where("page_id % 8 < 4"), raw.where("page_id % 8 >= 4")):
        half.select(*PAGES.names).write.mode("append").parquet(f"{root}/pages")
        arriving = page_source.read_pages(spark, f"{root}/pages", streaming=True)
        ingest.ingest_pages(
            arriving, store, f"{root}/rules", f"{root}/checkpoint", lambda: NOW, lambda errors, epoch: errors.write.mode("append").parquet(f"{root}/errors"),
            overrides_dir=f"{root}/settings", max_bytes=4000,
        ).awaitTermination()
        _put(spark, f"{root}/rules/s0.yml", CHANGED)
    errors = spark.read.parquet(f"{root}/errors")
    return (
        store.listings()
        .select(F.lit("listing").alias("kind"), F.col("tracker").alias("key"), F.col("name").alias("text"), F.col("size").cast("bigint").alias("size"))
        .union(errors.select(F.lit("error"), F.col("page_id").cast("string"), "error", F.lit(0).cast("bigint")))
    )
