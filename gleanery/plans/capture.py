"""Rows out of captured pages and JSON answers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gleanery import fixtures as fx
from gleanery.functions.codec import decode_bytes
from gleanery.operators import extract
from gleanery.plans.registry import flag, query, stamp
from gleanery.sources import pages as page_source
from gleanery.sources.rules import read_document

NOW = datetime(2024, 2, 1)
SOURCES = "example"


def rules(text: str) -> dict:
    return read_document("id: site\nname: Site\n" + text)


def site_pages(spark, sf):
    return fx.responses(spark, sf).withColumn("source", F.lit("site"))


LINKS = """
search:
  path: page
  rows: {selector: nav ul li, after: 1}
  fields:
    title: {selector: a}
    details: {selector: a, attribute: href}
    missing: {selector: b, optional: true, default: "none of {{ .Result.title }}"}
"""


@query(
    "html_links",
    r"""WITH n AS (SELECT page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1) AS nav FROM pages),
      l AS (SELECT page_id, unnest(regexp_extract_all(nav, '<li><a href="([^"]*)">[^<]*</a></li>', 1)) AS details,
        unnest(regexp_extract_all(nav, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS title,
        unnest(range(len(regexp_extract_all(nav, '<li>')))) AS i FROM n)
      SELECT page_id, i - 1 AS row_no, replace(details, '&amp;', '&') AS details, replace(title, '&amp;', '&') AS title,
        'none of ' || replace(title, '&amp;', '&') AS missing FROM l WHERE i >= 1 AND title != ''""",
)
def html_links(spark, sf):
    rows = extract.kept_rows(extract.extract_rows(site_pages(spark, sf), rules(LINKS), NOW))
    return rows.select("page_id", "row_no", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in ("details", "title", "missing")])


HEADINGS = """
search:
  path: page
  rows: {selector: "article:has(h1)"}
  fields:
    title: {selector: h1}
    head: {selector: ":root title"}
    lang: {selector: ":root", attribute: lang}
    advert: {selector: "div.ad", optional: true}
    kind: {case: {"h1:contains(zzz)": odd, "p:nth-child(2)": text, "*": other}}
    paragraphs: {text: "{{ if eq .Result.lang \\"en\\" }}{{ .Result.title }}{{ else }}{{ re_replace .Result.title \\"[^a-z]+\\" \\"-\\" }}{{ end }}"}
"""


@query(
    "html_titles",
    r"""WITH t AS (SELECT page_id, replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&') AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
        replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&') AS head FROM pages WHERE html LIKE '%<h1>%')
      SELECT page_id, title, head, lang, '' AS advert, CASE WHEN contains(lower(title), 'zzz') THEN 'odd' ELSE 'text' END AS kind,
        CASE WHEN lang = 'en' THEN title ELSE regexp_replace(title, '[^a-z]+', '-', 'g') END AS paragraphs FROM t WHERE title != ''""",
)
def html_titles(spark, sf):
    rows = extract.kept_rows(extract.extract_rows(site_pages(spark, sf), rules(HEADINGS), NOW))
    names = ("title", "head", "lang", "advert", "kind", "paragraphs")
    return rows.select("page_id", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names])


BY_LANGUAGE = """
search:
  path: page
  rows: {selector: "article:has(h1)"}
  fields:
    lang: {selector: ":root", attribute: lang}
    advert: {selector: "div.ad", optional: true}
    title: {selector: '{{ if eq .Result.lang "en" }}h1{{ else if .Result.advert }}div.ad{{ else }}:root title{{ end }}'}
    other: {selector: '{{ if .Result.title }}{{ if eq .Result.lang "en" "de" }}:root title{{ else }}h1{{ end }}{{ else }}p{{ end }}'}
"""


@query(
    "selectors_by_field",
    r"""WITH t AS (SELECT page_id, replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&') AS h1, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
        replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&') AS head FROM pages WHERE html LIKE '%<h1>%')
      SELECT page_id, lang, CASE WHEN lang = 'en' THEN h1 ELSE head END AS title, CASE WHEN lang IN ('en', 'de') THEN head ELSE h1 END AS other
      FROM t WHERE h1 != '' AND head != ''""",
)
def selectors_by_field(spark, sf):
    """Fields whose selectors are chosen by what earlier fields of the same row hold."""
    rows = extract.kept_rows(extract.extract_rows(site_pages(spark, sf), rules(BY_LANGUAGE), NOW))
    return rows.select("page_id", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in ("lang", "title", "other")])


PARAGRAPHS = """
search:
  path: page
  rows: {selector: article p}
  fields:
    title: {selector: p, filters: [{name: trim}, {name: replace, args: ["\\u00a0", " "]}]}
"""


@query(
    "html_paragraphs",
    r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
      p AS (SELECT page_id, unnest(string_split(body, '<p>')[2:]) AS t FROM a),
      c AS (SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), ' ' || chr(10) || chr(9) || chr(13)) AS t FROM p)
      SELECT page_id, count(*) AS paragraphs, sum(length(t))::BIGINT AS chars FROM c WHERE t != '' GROUP BY page_id""",
)
def html_paragraphs(spark, sf):
    """Paragraphs as tolerant HTML reads them: an unclosed one ends where the next begins."""
    got = extract.kept_rows(extract.extract_rows(site_pages(spark, sf), rules(PARAGRAPHS), NOW))
    return got.groupBy("page_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length(F.try_element_at("fields", F.lit("title")))).alias("chars"))


ERRORS = """
search:
  path: page
  error:
    - {selector: "h1:contains(zzqx)", message: {text: x}}
    - {selector: "nav:not(:has(li:nth-child(6)))", message: {selector: "li:first-child a", filters: [{name: prepend, args: "short menu after "}]}}
  rows: {selector: li}
  fields:
    title: {selector: a, filters: [{name: regexp, args: "^([a-z].*)"}]}
    number: {selector: "a[href$=e]"}
"""


@query(
    "page_errors",
    r"""WITH n AS (SELECT page_id, url, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="[^"]*">([^<]*)</a>', 1) AS a FROM pages)
      SELECT page_id, url, 'short menu after ' || replace(a[1], '&amp;', '&') AS error FROM n WHERE len(a) < 6""",
)
def page_errors(spark, sf):
    got = extract.extract_rows(site_pages(spark, sf), rules(ERRORS), NOW)
    return extract.page_errors(got).select("page_id", "url", "error")


@query(
    "extraction_yield",
    r"""WITH n AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="([^"]*)">[^<]*</a>', 1) AS h,
          regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages),
      r AS (SELECT page_id, CASE WHEN NOT regexp_matches(hh, 'e$') THEN 'required missing: number' WHEN NOT regexp_matches(tt, '^[a-z]') THEN 'no title' ELSE 'kept' END AS reason
        FROM (SELECT page_id, unnest(h) AS hh, unnest(t) AS tt FROM n WHERE len(h) >= 6)),
      o AS (SELECT page_id, reason, count(*) AS rows FROM r GROUP BY ALL UNION ALL SELECT page_id, 'page failed', 0 FROM n WHERE len(h) < 6)
      SELECT 'site' AS source, reason, sum(rows)::BIGINT AS rows, count(*) AS pages FROM o GROUP BY reason""",
)
def extraction_yield(spark, sf):
    return extract.yield_report(extract.extract_rows(site_pages(spark, sf), rules(ERRORS), NOW))


JSON = """
search:
  paths: [{path: q, response: {type: json, noResultsMessage: '"k": 13}'}}]
  rows: {selector: "$.hits:not(hidden)", count: {selector: total}}
  fields:
    title: {selector: name}
    k: {selector: props.k}
    flags: {selector: "flags"}
    price: {selector: price, filters: [{name: append, args: " EUR"}]}
    parity: {selector: even, case: {"True": even, "False": odd}}
"""


@query(
    "json_rows",
    """WITH j AS (SELECT event_id, json_extract(props, '$.k')::INT AS k, value, event_type, user_id FROM events)
      SELECT event_id AS page_id, i AS row_no, event_type || i AS title, k::VARCHAR AS k, 'True,,' || user_id || ',0.00000000000000000001,,a,1' || repeat('0', 40) AS flags,
        CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END || ' EUR' AS price, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS parity
      FROM j, unnest(range(user_id % 3)) t(i) WHERE k != 13""",
)
def json_rows(spark, sf):
    """Answers with zero to two hits and a hidden one, built around each event's own JSON."""
    e = fx.spread(fx.table(spark, sf, "events"))
    hit = F.concat(
        F.lit('{"name": "'), F.col("event_type"), F.lit('%d", "props": '), F.col("props"), F.lit(', "flags": [true, null, [['),
        F.col("user_id").cast("string"), F.lit(', [1e-20]], []], "a", 1e40], "price": '), F.col("value").cast("string"), F.lit(', "even": '),
        (F.get_json_object("props", "$.k").cast("int") % 2 == 0).cast("string"), F.lit("}"),
    )
    n = F.col("user_id") % 3
    hits = F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda i: i < n), lambda i: F.replace(hit, F.lit("%d"), i.cast("string")))
    body = F.concat(
        F.lit('{"total": '), n.cast("string"), F.lit(', "hits": ['), F.array_join(F.concat(hits, F.array(F.lit('{"name": "x", "hidden": null}'))), ", "), F.lit("]}")
    )
    pages = e.select(F.col("event_id").alias("page_id"), F.lit("site").alias("source"), F.lit("https://site.invalid/q").alias("url"), F.lit("json").alias("format"), body.alias("body"))
    rows = extract.kept_rows(extract.extract_rows(pages, rules(JSON), NOW))
    return rows.select("page_id", "row_no", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in ("title", "k", "flags", "price", "parity")])


@query(
    "header_carry",
    """WITH r AS (SELECT o_custkey AS page_id, o_orderkey AS row_no, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS header FROM orders)
      SELECT page_id, row_no, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY row_no ROWS UNBOUNDED PRECEDING), '') AS carried FROM r""",
)
def header_carry(spark, sf):
    """A customer's orders as one page: finished orders are the date headers."""
    rows = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("row_no"), "o_orderstatus", "o_orderdate")
    header = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
    out = extract.carry_headers(rows, header, "carried")
    return out.select("page_id", "row_no", F.coalesce("carried", F.lit("")).alias("carried"))


@query(
    "oversize_pages",
    """SELECT page_id, strlen(html) <= 2000 AS kept, CASE WHEN strlen(html) > 2000 THEN 'response of ' || strlen(html) || ' bytes exceeds 2000' ELSE '' END AS error FROM pages""",
)
def oversize_pages(spark, sf):
    kept, rejects = page_source.split_oversize(fx.responses(spark, sf), 2000)
    return kept.select("page_id", F.lit(True).alias("kept"), F.lit("").alias("error")).unionByName(
        rejects.select("page_id", F.lit(False).alias("kept"), "error")
    )


@query(
    "decoded_bodies",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE md5(text) END AS body, CASE WHEN doc_id % 4 = 3 THEN 'unknown encoding "klingon"' ELSE '' END AS error FROM documents""",
)
def decoded_bodies(spark, sf):
    """Documents stored in three encodings and one that does not exist."""
    n = F.col("doc_id") % 4
    raw = F.when(n == 1, F.encode("text", "UTF-16")).when(n == 2, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-8"))
    charset = F.when(n == 1, "utf-16").when(n == 2, "UTF-16LE").when(n == 3, "klingon").otherwise("")
    docs = fx.table(spark, sf, "documents").select("doc_id", decode_bytes(raw, charset).alias("d"))
    return docs.select("doc_id", F.coalesce(F.md5(F.col("d.body").cast("binary")), F.lit("")).alias("body"), F.coalesce("d.error", F.lit("")).alias("error"))
