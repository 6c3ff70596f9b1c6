from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanery.functions.nodes import PIECE, html_nodes, shred, shredded
from gleanery.functions.selectors import Dialect, Scope, matches, node_text
from gleanery.operators import extract, taxonomy
from gleanery.schema import PAGES
from gleanery.sources import rules

NOW = datetime(2024, 4, 1, 12, 0, 0)

SHOP_RULES = """
id: shop
name: Shop
type: public
links: [https://shop.invalid/list/]
caps:
  categories: {10: Movies/HD}
  categorymappings:
    - {id: 20, cat: TV/SD, desc: Series}
search:
  path: list.php
  error:
    - selector: div.problem
  rows:
    selector: table.items tr.item
    after: 1
    remove: .ad
    dateheaders:
      selector: th.day
      filters: [{name: replace, args: ["On ", ""]}]
  fields:
    category: {selector: "td.kind a", attribute: href, filters: [{name: querystring, args: c}]}
    title: {selector: td.name a, remove: em}
    details: {selector: td.name a, attribute: href}
    download: {selector: "a[href^=get]", attribute: href}
    size: {selector: td.size}
    seeders: {text: "{{ .Result.size }}", filters: [{name: regexp, args: "^(\\\\d+)"}]}
    date: {selector: td.when, optional: true}
    description: {selector: td.none, default: "about {{ .Result.title }}"}
    downloadvolumefactor:
      case:
        'img[src$="free.png"]': 0
        "*": 1
"""

SHOP_PAGE = """<html><body><table class="items">
<tr class="item head"><td>Kind</td></tr>
<tr class="item"><th class="day" colspan=5>On 2024-03-05</th></tr>
<tr class="item"><td class="kind"><a href="list.php?c=10">Film</a></td><td class="name"><a href="v.php?id=1">First &amp; <em>new</em>Film</a></td>
 <td><a href="get.php?id=1">dl</a><td class="size">700 MB<td class="flags"><img src="x/free.png"></tr>
<tr class="item ad"><td class="name"><a href="/ad">Advert</a></td></tr>
<tr class="item"><td class="kind"><a href="?c=20">Show</a></td><td class="name"><a href="/v.php?id=2">Второй</a></td>
 <td><a href="get.php?id=2">dl</a></td><td class="size">1.5 ГБ</td><td class="when">2024-03-01 10:00</td></tr>
<tr class="item"><td class="kind"><a href="?c=20">Show</a></td><td class="name">no link</td></tr>
</table></body></html>"""


def pages_of(spark, rows):
    data = [(i, s, u, None, f, b) for i, (s, u, f, b) in enumerate(rows)]
    return spark.createDataFrame(data, PAGES)


@pytest.fixture(scope="module")
def shop():
    return rules.read_document(SHOP_RULES)


def test_html_page_to_listings(spark, shop):
    pages = pages_of(spark, [("shop", "https://shop.invalid/list/list.php?p=1", "html", SHOP_PAGE),
                             ("shop", "https://shop.invalid/list/list.php?p=2", "html", "<div class=problem> Slow <b>down</b> </div>")])
    got = extract.extract_all(pages, [shop], NOW)
    reasons = {(r.page_id, r.row_no): (r.reason, r.error) for r in got.collect()}
    assert reasons == {
        (0, 0): ("header", None),
        (0, 1): (None, None),
        (0, 2): (None, None),
        (0, 3): ("required missing: title", None),
        (1, None): (None, "Slow down"),
    }
    sources = spark.createDataFrame([("shop", "public")], "id string, type string")
    mapping = spark.createDataFrame(
        [("shop", 0, "10", "Movies/HD", "", False), ("shop", 1, "20", "TV/SD", "Series", False)], taxonomy.MAPPING_COLUMNS
    )
    listed = extract.to_listings(extract.kept_rows(got), sources, mapping, taxonomy.taxonomy(spark), NOW)
    first, second = listed.orderBy("row_no").collect()
    assert first.name == "First & Film" and second.name == "Второй"
    assert first.details_url == "https://shop.invalid/list/v.php?id=1"
    assert second.details_url == "https://shop.invalid/v.php?id=2"
    assert first.download_url == "https://shop.invalid/list/get.php?id=1"
    assert (first.size, second.size) == (700 * 1024**2, int(1.5 * 1024**3))
    assert (first.seeders, second.seeders) == (700, 1)
    assert first.published == datetime(2024, 3, 5) and second.published == datetime(2024, 3, 1, 10)
    assert first.categories == [2040] and second.categories == [5030, 100020]
    assert (first.download_volume_factor, second.download_volume_factor) == (0.0, 1.0)
    assert first.description == "about First & Film"
    report = {(r.reason): (r.rows, r.pages) for r in extract.yield_report(got).collect()}
    assert report == {"header": (1, 1), "kept": (2, 1), "required missing: title": (1, 1), "page failed": (0, 1)}


JSON_RULES = """
id: api
links: [https://api.invalid/]
search:
  paths: [{path: q, response: {type: JSON, noResultsMessage: "nothing here"}}]
  rows: {selector: "data.items:not(hidden)", attribute: files, multiple: true, count: {selector: data.total}}
  fields:
    title: {selector: name}
    parent: {selector: ..group.label}
    size: {selector: size}
    tags: {selector: tags}
    free: {selector: free, case: {"True": yes, "*": no}}
"""

JSON_BODY = """{"data": {"total": 3, "items": [
 {"group": {"label": "G1"}, "files": [{"name": "a", "size": 12000000, "tags": ["x", true, null], "free": true}, 7]},
 {"group": {"label": "G2"}, "files": {"z": {"name": "zed", "size": 1.50, "tags": []}, "b": {"name": "bee", "size": 2.0, "tags": 3, "free": false}}},
 {"hidden": 1, "group": {"label": "G3"}, "files": [{"name": "no"}]}]}}"""


def test_json_rows(spark):
    api = rules.read_document(JSON_RULES)
    bodies = [JSON_BODY, '{"data": {"total": 0, "items": [{}]}}', '{"note": "nothing here"}', "{oops", '{"data": {}}']
    got = extract.extract_all(pages_of(spark, [("api", "https://api.invalid/q", "json", b) for b in bodies]), [api], NOW)
    rows = sorted((r.page_id, r.row_no, r.fields["title"], r.fields["parent"], r.fields["size"], r.fields["tags"], r.reason)
                  for r in got.collect() if r.page_id == 0)
    assert rows == [
        (0, 0, "a", "G1", "12000000", "x,True,", None),
        (0, 1, "bee", "G2", "2", "3", None),
        (0, 2, "zed", "G2", "1.5", "", "required missing: free"),
    ]
    rest = {r.page_id: (r.row_no, r.error) for r in got.collect() if r.page_id > 0}
    assert rest[1] == (None, None) and rest[2] == (None, None)
    assert rest[3] == (None, "invalid JSON response")
    assert rest[4][1].startswith("the row selector")


XML_RULES = """
id: feed
links: [https://feed.invalid/]
search:
  paths: [{path: rss, response: {type: xml}}]
  rows: {selector: channel > item}
  fields:
    title: {selector: title}
    size: {selector: enclosure, attribute: length}
    seeders: {selector: "attr[name=seeders]", attribute: value}
    description: {selector: note, remove: skip}
"""


def test_xml_rows(spark):
    body = """<?xml version="1.0"?><rss xmlns:t="http://t.invalid/"><channel><title>no</title>
    <item><title>One &lt;1&gt;</title><enclosure length="5"/><t:attr name="seeders" value="9"/><note>a<skip>b</skip>c</note></item>
    <item><title>Two</title><enclosure length="6"/><t:attr name="other" value="1"/></item></channel></rss>"""
    feed = rules.read_document(XML_RULES)
    got = extract.extract_all(pages_of(spark, [("feed", "u", "xml", body), ("feed", "u", "xml", "<a><b></a>")]), [feed], NOW).collect()
    by_row = {(r.page_id, r.row_no): r for r in got}
    assert by_row[(0, 0)].fields == {"title": "One <1>", "size": "5", "seeders": "9", "description": "ac"}
    assert by_row[(0, 1)].reason == "required missing: seeders"
    assert by_row[(1, None)].error.startswith("invalid XML response")


PAGE = """<div id=top class="a b"><ul><li>one<li class=x>two <b>bold</b><li>three</ul>
<p>para<div><span data-k="v w">s1</span><span>s2</span></div><table><tr><td>1<td>2</table></div>"""


@pytest.mark.parametrize(
    "selector, texts",
    [
        ("li", ["one", "two bold", "three"]),
        ("ul > li.x", ["two bold"]),
        ("li:contains(BOLD)", ["two bold"]),
        ("li:not(.x)", ["one", "three"]),
        ("li:first-child, li:last-child", ["one", "three"]),
        ("li:nth-child(2)", ["two bold"]),
        ("li:nth-child(odd)", ["one", "three"]),
        ("li + li", ["two bold", "three"]),
        ("li.x ~ li", ["three"]),
        ("li:has(b)", ["two bold"]),
        ("li:has(~ li.x)", ["one"]),
        ("li:has(+ li)", ["one", "two bold"]),
        ("ul:has(> li.x) li:nth-of-type(3)", ["three"]),
        ("span[data-k~=w]", ["s1"]),
        ("span[data-k]", ["s1"]),
        ('span[data-k^="v"]', ["s1"]),
        ("span:not([data-k])", ["s2"]),
        ("#top .x b", ["bold"]),
        ("table > tbody > tr > td", ["1", "2"]),
        ("p", ["para"]),
        ("div.a.b > div > span:last-child", ["s2"]),
        ("html > body > div > p", ["para"]),
        ("li:[", []),
    ],
)
def test_css(spark, selector, texts):
    df = spark.createDataFrame([(PAGE,)], "body string").withColumn("s", shred(F.col("body"), "html"))
    nodes = F.col("s.nodes")
    dialect = Dialect("html")
    groups = dialect.read(selector)
    hits = F.filter(nodes, lambda n: matches(groups, Scope(nodes), n)) if groups else F.array().cast("array<string>")
    out = F.transform(hits, lambda n: F.trim(node_text(nodes, n))) if groups else hits
    assert [t.strip() for t in df.select(out.alias("o")).first().o] == texts


PICKY_RULES = """
id: picky
name: Picky
search:
  path: /
  rows: {selector: "li{{ if .Config.open }}.open{{ else }}{{ end }}"}
  fields:
    kind: {selector: s, optional: true}
    title: {selector: a}
    size: {selector: '{{ if eq .Result.kind "big" }}u{{ else if .Result.kind }}{{ if .Result.title }}i{{ end }}{{ else }}b{{ end }}'}
"""


def test_selectors_read_earlier_fields(spark):
    body = (
        "<ul><li class=open><s>big</s><a>one</a><u>1</u><b>2</b></li><li class=open><s>odd</s><a>two</a><i>3</i><u>4</u></li>"
        "<li class=open><a>three</a><b>5</b><u>6</u></li><li><a>shut</a><b>7</b></li><li class=open><s>big</s><a>four</a><b>8</b></li></ul>"
    )
    rows = extract.extract_rows(pages_of(spark, [("picky", "https://picky.invalid/", "html", body)]), rules.read_document(PICKY_RULES), NOW, {"open": "True"})
    found = {r.fields["title"]: (r.fields["size"], r.reason) for r in rows.collect()}
    assert found == {"one": ("1", None), "two": ("3", None), "three": ("5", None), "four": (None, "required missing: size")}


def test_json_selectors_read_earlier_fields(spark):
    rule = rules.read_document(
        "id: j\nname: J\nsearch:\n  paths: [{path: /, response: {type: json}}]\n  rows: {selector: hits}\n  fields:\n"
        "    title: {selector: name}\n    size: {selector: '{{ if eq .Result.title \"a\" }}n.x{{ else }}n.y{{ end }}'}\n"
    )
    body = '{"hits": [{"name": "a", "n": {"x": 1, "y": 2}}, {"name": "b", "n": {"x": 3, "y": 4}}]}'
    rows = extract.extract_rows(pages_of(spark, [("j", "https://j.invalid/", "json", body)]), rule, NOW)
    assert {r.fields["title"]: r.fields["size"] for r in rows.collect()} == {"a": "1", "b": "4"}


def test_selectors_spliced_from_fields_are_refused(spark):
    rule = rules.read_document("id: s\nname: S\nsearch:\n  path: /\n  rows: {selector: li}\n  fields:\n    kind: {selector: s}\n    title: {selector: 'a.{{ .Result.kind }}'}\n")
    with pytest.raises(ValueError, match="conditions only"):
        extract.extract_rows(pages_of(spark, [("s", "https://s.invalid/", "html", "<li>")]), rule, NOW)


def test_json_fields_are_settled_before_rows_are_filtered(spark):
    """A filter on reason or error is not carried to the scan, where it would read the page again for every test."""
    definition = rules.read_document("""
id: site
name: Site
links: [https://site.invalid/]
caps: {categorymappings: [{id: 1, cat: TV}]}
search:
  paths: [{path: q, response: {type: json}}]
  rows: {selector: hits}
  fields: {title: {selector: name}, seeds: {selector: n}}
""")
    body = r'{"hits": [{"name": "a", "n": 1.0}, {"name": "q\\", "n": [true, null, "x\n,", [[]], 1e2]}, {"n": 2}, {"name": {"k": 1}, "n": [{"a": false}, [3]]}]}'
    pages = spark.createDataFrame([(1, "site", "u", "json", body), (2, "site", "u", "json", "{")], "page_id int, source string, url string, format string, body string")
    out = extract.extract_rows(pages.repartition(2), definition, None)
    got = [(r.row_no, r.fields["title"], r.fields["seeds"]) for r in extract.kept_rows(out).orderBy("row_no").collect()]
    assert got == [(0, "a", "1"), (1, 'q\\', "True,,x\n,,,100"), (3, '{"k":1}', '{"a":false},3')]
    assert [r.error for r in extract.page_errors(out).collect()] == ["invalid JSON response"]
    plan = extract.kept_rows(out)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "variant" in line.lower()]


def test_nodes_of_a_large_batch_are_made_in_pieces():
    pages = [f"<p>{i}</p>" + "x" * 5000 for i in range(200)] + ["<p>big</p>" + "x" * PIECE, None, ""]
    pieces = list(shredded(html_nodes, iter([pd.Series(pages)])))
    sizes = [len(p) for p in pieces]
    assert max(sizes) <= PIECE // 5000 and sum(sizes) == len(pages)
    assert [n for p in pieces for n in p.nodes] == [html_nodes(body or "") for body in pages]
