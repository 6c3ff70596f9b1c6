"""Rows out of captured pages, by declarative rules compiled to Columns.

One pass per page: Python only turns markup into a node array (functions/nodes.py); row
selection, fields, cases, filters and typing are Columns over it. Store pages partitioned
by source and each source's rules read only that source's files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleanery.functions import coerce, jsonpath
from gleanery.functions.bind import let
from gleanery.functions.chain import apply_chain
from gleanery.functions.dates import parse_unknown
from gleanery.functions.nodes import shred
from gleanery.functions.selectors import Dialect, Scope, matches, node_text
from gleanery.functions.templates import TemplateEnv, as_column, template_col, template_variants
from gleanery.functions.urls import resolve_url
from gleanery.operators.search import and_match
from gleanery.operators.taxonomy import map_categories
from gleanery.sources.pages import no_results, preprocess

PAGE = ["page_id", "source", "url"]


def _constant(text: str, env: TemplateEnv) -> str:
    rendered = template_col(text, env)
    if not isinstance(rendered, str):
        raise ValueError(f"selector {text!r} must be constant for a source")
    return rendered


# --- markup (HTML, XML) ---------------------------------------------------------------


def _markup_value(dialect: Dialect, nodes: Column, row: Column, pool: Column, field: Mapping, env: TemplateEnv) -> Column:
    """Text of a selector field, the number of the case arm that holds, or NULL when nothing matches."""
    selector = _constant(field["selector"], env)
    if field["arms"]:

        def arm_of(scope: Column, inner: Column | None) -> Column:
            tests = [(i, dialect.holds(nodes, scope, arm["selector"], inner)) for i, arm in enumerate(field["arms"])]
            return reduce(lambda rest, t: F.when(t[1], F.lit(str(t[0]))).otherwise(rest), reversed(tests), F.lit(None).cast("string"))

        if not selector:
            return arm_of(row, pool)
        return let(dialect.pick(nodes, row, selector, pool), lambda n: F.when(n.isNotNull(), arm_of(n, None)))
    if not selector:
        return F.lit("")

    def read(n: Column) -> Column:
        if field["attribute"]:
            return F.try_element_at(n["attrs"], F.lit(field["attribute"]))
        removed = dialect.find(nodes, n, field["remove"]) if field["remove"] else None
        return F.when(n.isNotNull(), node_text(nodes, n, removed))

    return let(dialect.pick(nodes, row, selector, pool), read)


def _markup_rows(dialect: Dialect, nodes: Column, rule: Mapping, selector: str) -> Column:
    if dialect.kind == "xml":
        rows = dialect.find(nodes, F.get(nodes, 0), selector)
    else:
        groups = dialect.read(selector)
        rows = F.filter(nodes, lambda n: matches(groups, Scope(nodes), n) if groups else F.lit(False))
        if rule["remove"]:
            out = dialect.read(rule["remove"])
            rows = F.filter(rows, lambda n: ~matches(out, Scope(nodes), n) if out else F.lit(True))
    return F.filter(rows, lambda n: n["tag"] != "#text")


def _after(rows: Column, skip: int) -> Column:
    return rows if skip <= 0 else F.slice(rows, skip + 1, F.greatest(F.size(rows) - skip, F.lit(0)))


def _error_message(dialect: Dialect, nodes: Column, blocks: Sequence[Mapping], now, charset) -> Column:
    """The message of the first error block present in the page, NULL when there is none."""

    def in_document(selector: str) -> Column:
        groups = dialect.read(selector)
        return F.filter(nodes, lambda n: matches(groups, Scope(nodes), n) if groups else F.lit(False))

    def within(hits: Column, selector: str) -> Column:
        return F.flatten(F.transform(hits, lambda h: dialect.find(nodes, h, selector)))

    found = F.lit(None).cast("string")
    for block in reversed(blocks):
        message = block["message"]
        selector = block["selector"] or message["selector"]
        if not selector:
            continue
        hits = in_document(selector)
        narrower = message["selector"] and message["selector"] != selector
        shown = within(hits, message["selector"]) if narrower else hits
        text = coerce.trim_space(F.array_join(F.transform(shown, lambda n: node_text(nodes, n)), ""))
        text = apply_chain(text, message["filters"], now=now, charset=charset)
        text = F.when(text == "", F.lit("tracker reported an error")).otherwise(text)
        found = F.when(F.size(hits) > 0, text).otherwise(found)
    return found


def _markup(pages: DataFrame, kind: str, search: Mapping, env: TemplateEnv, now, charset) -> DataFrame:
    dialect, rule = Dialect(kind), search["rows"]
    shredded = pages.withColumn("__s", shred(F.col("body"), kind)).drop("body")
    nodes = F.col("__s.nodes")
    if kind == "html":
        error = _error_message(dialect, nodes, search["error"], now, charset)
        selected = F.when(F.col("error").isNull(), _markup_rows(dialect, nodes, rule, _constant(rule["selector"], env)))
    else:
        error = F.when(F.col("__s.error").isNotNull(), F.concat(F.lit("invalid XML response: "), F.col("__s.error")))
        selected = F.when(
            F.col("error").isNull() & ~F.col("__no_results"), _markup_rows(dialect, nodes, rule, _constant(rule["selector"], env))
        )
    slots = _slots(search, env)

    def read_row(row: Column) -> Column:
        def with_pool(pool: Column) -> Column:
            return F.struct(*[_markup_value(dialect, nodes, row, pool, f, env).alias(name) for name, f in slots])

        return let(F.slice(nodes, row["i"] + 2, row["last"] - row["i"]), with_pool)

    # Two projections: the row array is computed once, then read field by field.
    picked = shredded.withColumn("error", error).withColumn("__rows", _after(selected, rule["after"]))
    read = picked.withColumn("__rows", F.transform("__rows", read_row)).drop("__s")
    return read.select("*", F.posexplode_outer("__rows").alias("row_no", "__row")).drop("__rows")


def _slots(search: Mapping, env: TemplateEnv) -> list[tuple[str, Mapping]]:
    """Named things to read from each row: the fields, and the date header if rules declare one.

    A selector whose template asks for earlier fields is read once for every text it can become;
    which of them counts is known when the earlier fields are.
    """
    slots = []
    for i, field in enumerate(search["fields"]):
        if field["selector"] or field["arms"]:
            earlier = env.with_result({f["name"]: F.lit("") for f in search["fields"][:i]})
            texts = [text for _, text in template_variants(field["selector"] or "", earlier)]
            if texts == [None]:
                raise ValueError(f"selector {field['selector']!r} names a variable never set")
            slots += [(f"v{i}_{k}", {**field, "selector": text}) for k, text in enumerate(texts) if text is not None]
    if search["rows"].get("dateheaders"):
        slots.append(("header", search["rows"]["dateheaders"]))
    return slots or [("none", {"selector": "", "arms": [], "attribute": "", "remove": ""})]


def _chosen(i: int, field: Mapping, scope: TemplateEnv) -> Column:
    """What the selector of field i found, by the text its template becomes in this row."""
    variants = [
        (condition, F.lit(None).cast("string") if text is None else F.col(f"__row.v{i}_{k}"))
        for k, (condition, text) in enumerate(template_variants(field["selector"] or "", scope))
    ]
    if variants[0][0] is None:
        return variants[0][1]
    return reduce(lambda rest, v: F.when(v[0], v[1]).otherwise(rest), reversed(variants), F.lit(None).cast("string"))


# --- JSON ------------------------------------------------------------------------------


def _json_field(value: Column, parent: Column, field: Mapping, env: TemplateEnv) -> Column:
    selector = _constant(field["selector"], env)
    if field["arms"]:
        scope = jsonpath.resolve(value, parent, selector) if selector else value
        text = jsonpath.scalar_text(scope)
        tests = [
            (i, F.lit(True) if arm["selector"] in ("*", "") else text == arm["selector"]) for i, arm in enumerate(field["arms"])
        ]
        arm = reduce(lambda rest, t: F.when(t[1], F.lit(str(t[0]))).otherwise(rest), reversed(tests), F.lit(None).cast("string"))
        return F.when(scope.isNotNull(), arm)
    if field["attribute"]:
        selector = f"{selector}.{field['attribute']}" if selector else field["attribute"]
    return jsonpath.scalar_text(jsonpath.resolve(value, parent, selector) if selector else value)


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _json(pages: DataFrame, search: Mapping, env: TemplateEnv, now, charset) -> DataFrame:
    rule = search["rows"]
    selector = _constant(rule["selector"], env)
    path, _, filters = selector.partition(":")
    parsed = pages.withColumn("__doc", F.try_parse_json("body")).drop("body")
    target = jsonpath.lookup(F.col("__doc"), path)
    counted = F.lit(False)
    if rule.get("count"):
        count = _json_field(F.col("__doc"), F.col("__doc"), rule["count"], env)
        count = coerce.trim_space(apply_chain(count, rule["count"]["filters"], now=now, charset=charset))
        counted = F.coalesce(F.when(count.rlike("^[+-]?[0-9]+$"), count.try_cast("bigint")) < 1, F.lit(False))
    quiet = F.col("__no_results") | counted
    missing = F.lit(False) if rule["missing_is_empty"] else F.col("__target").isNull() & ~F.col("__quiet")
    invalid = F.col("__doc").isNull()
    with_target = parsed.withColumn("__target", target).withColumn("__quiet", quiet)
    with_target = with_target.withColumn(
        "error",
        F.when(invalid, F.lit("invalid JSON response")).when(
            missing, F.lit(f'the row selector "{selector}" matched nothing in the answer')
        ),
    )
    nothing = F.array().cast("array<variant>")
    items = F.coalesce(
        jsonpath.array_of(F.col("__target")),
        F.when(_is_object(F.col("__target")), F.array("__target")),
        nothing,
    )
    items = F.when(F.col("error").isNull() & ~F.col("__quiet"), items)
    if filters:
        items = F.filter(items, lambda v: jsonpath.select(v, ":" + filters).isNotNull())
    shaped = with_target.withColumn("__items", items)
    pairs = F.transform("__items", lambda v: F.struct(v.alias("parent"), jsonpath.lookup(v, rule["attribute"]).alias("value")))
    if rule["attribute"]:
        pairs = F.filter(pairs, lambda p: p["value"].isNotNull() & ~F.is_variant_null(p["value"]))
    if rule["multiple"]:

        def entries(v: Column) -> Column:
            by_key = F.try_variant_get(v, "$", "map<string,variant>")
            ordered = F.transform(F.array_sort(F.map_keys(by_key)), lambda k: F.try_element_at(by_key, k))
            found = F.coalesce(jsonpath.array_of(v), F.when(_is_object(v), ordered), nothing)
            return F.filter(found, _is_object)

        pairs = F.flatten(
            F.transform(pairs, lambda p: F.transform(entries(p["value"]), lambda e: F.struct(p["parent"].alias("parent"), e.alias("value"))))
        )
    slots = _slots(search, env)

    def read_row(pair: Column) -> Column:
        return F.struct(*[_json_field(pair["value"], pair["parent"], f, env).alias(name) for name, f in slots])

    # Fields and the page's error are settled before they are exploded: a filter on them would otherwise carry all that makes
    # them down to the scan and have it worked out again there, once for every test.
    read = shaped.withColumn("__rows", F.transform(_after(pairs, rule["after"]), read_row)).drop("__doc", "__target", "__quiet", "__items")
    carried = [c for c in read.columns if c != "error"]
    settled = read.select(*carried, F.explode_outer(F.array("error")).alias("error"))
    return settled.select("*", F.posexplode_outer("__rows").alias("row_no", "__row")).drop("__rows")


# --- fields -----------------------------------------------------------------------------


def carry_headers(rows: DataFrame, header: Column, out: str, page: str = "page_id", order: str = "row_no") -> DataFrame:
    """The latest non-NULL header at or above each row of its page. A page is bounded by the body cap."""
    above = W.partitionBy(page).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(header, ignorenulls=True).over(above))


def _date_headers(rows: DataFrame, header_rule: Mapping, env: TemplateEnv, now, charset) -> DataFrame:
    """__header of a date-header row, and __date: the header above a row of the same page."""
    text = F.col("__row.header")
    is_header = F.coalesce(coerce.trim_space(text) != "", F.lit(False))
    lenient = TemplateEnv(env.config, {}, env.query, env.keywords, env.categories, env.now, strict=False)
    dated = apply_chain(F.when(is_header, text), header_rule["filters"], lenient, now, charset)
    return carry_headers(rows.withColumn("__header", is_header), dated, "__date")


def _read_fields(rows: DataFrame, search: Mapping, env: TemplateEnv, now, charset) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """Fold the fields in their declared order; later ones read earlier ones by column."""
    result: dict[str, str] = {}
    reasons: list[Column] = []
    for i, field in enumerate(search["fields"]):
        scope = env.with_result({name: F.col(col) for name, col in result.items()})
        raw = _chosen(i, field, scope) if field["selector"] or field["arms"] else None
        if field["arms"]:
            value = F.lit(None).cast("string")
            for k, arm in reversed(list(enumerate(field["arms"]))):
                value = F.when(raw == str(k), as_column(template_col(arm["value"], scope))).otherwise(value)
            matched = raw.isNotNull()
        elif field["selector"]:
            value, matched = raw, raw.isNotNull()
        else:
            value, matched = as_column(template_col(field["text"], scope)), F.lit(True)
        value = apply_chain(value, field["filters"], scope, now, charset)
        name = field["name"]
        if field["optional"]:
            filled = F.coalesce(value, F.lit(""))
            if field["default"]:
                default = F.coalesce(as_column(template_col(field["default"], scope)), F.lit(""))
                unresolved = matched & value.isNull()
                filled = F.when(~unresolved & coerce.is_blank(filled), default).otherwise(filled)
        else:
            filled = value
            reasons.append(
                F.when(~matched, F.lit(f"required missing: {name}")).when(value.isNull(), F.lit(f"variable not set: {name}"))
            )
        if name in ("title", "description") and "append" in field["modifiers"]:
            earlier = F.col(result[name]) if name in result else F.lit("")
            filled = F.concat(earlier, filled)
        column = f"__f{i}"
        rows = rows.withColumn(column, filled)
        result[name] = column
    return rows, result, reasons


def extract_rows(
    pages: DataFrame,
    definition: Mapping,
    now=None,
    config: Mapping[str, str] | None = None,
    keywords: str | Column | None = None,
    stand_down: Column | None = None,
    kind: str | None = None,
) -> DataFrame:
    """Rows of one source's pages of one response format.

    Result: page_id, source, url, row_no, fields map<string,string>, reason, error.
    `reason` says why a row is not a listing; `error` marks a page that failed (row_no is
    then NULL, as it is for a page without rows). `keywords` enables the and-match row
    filter; `stand_down` switches it off per request.
    """
    search, charset = definition["search"], definition.get("encoding")
    kind = kind or (search["paths"][0]["response"] if search["paths"] else "html")
    env = TemplateEnv(config=dict(config or {}), keywords=keywords if keywords is not None else "", now=now)
    message = next((p["no_results"] for p in search["paths"] if p["response"] == kind), "")
    carried = [c for c in pages.columns if c not in ("body", "format", "error")]
    ready = preprocess(pages.select(*carried, "body"), search["preprocessingfilters"], now, charset)
    ready = ready.withColumn("__no_results", no_results(F.col("body"), message if kind != "html" else None))
    rows = _json(ready, search, env, now, charset) if kind == "json" else _markup(ready, kind, search, env, now, charset)
    rows = rows.drop("__no_results")

    header_rule = search["rows"].get("dateheaders")
    if header_rule:
        rows = _date_headers(rows, header_rule, env, now, charset)
    rows, result, reasons = _read_fields(rows, search, env, now, charset)
    if header_rule and "date" in result:
        own = F.col(result["date"])
        rows = rows.withColumn(result["date"], F.when(F.coalesce(own, F.lit("")) == "", F.coalesce("__date", own)).otherwise(own))
    elif header_rule:
        rows = rows.withColumn("__fdate", F.coalesce("__date", F.lit("")))
        result["date"] = "__fdate"
    title = F.col(result["title"]) if "title" in result else F.lit("")
    checks = ([F.when(F.col("__header"), F.lit("header"))] if header_rule else []) + reasons
    for step in search["rows"]["filters"]:
        if step["name"] == "andmatch" and keywords is not None:
            limit = step["args"][0].strip() if step["args"] else ""
            words = apply_chain(as_column(keywords), search["keywordsfilters"], now=now, charset=charset)
            fails = ~and_match(title, words, int(limit) if limit.lstrip("+-").isdigit() else 0)
            if stand_down is not None:
                fails = fails & ~stand_down
            checks.append(F.when(fails, F.lit("andmatch")))
    checks.append(F.when(title == "", F.lit("no title")))
    reason = F.when(F.col("row_no").isNotNull(), F.coalesce(*checks))
    pairs = [part for name, col in result.items() for part in (F.lit(name), F.col(col))]
    fields = F.when(F.col("row_no").isNotNull(), F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))
    return rows.select(*carried, "row_no", fields.alias("fields"), reason.alias("reason"), "error")


def extract_all(pages: DataFrame, definitions: Sequence[Mapping], now=None, configs: Mapping[str, Mapping] | None = None, **options) -> DataFrame:
    """extract_rows over every source and response format; each branch filters its own source."""
    parts = []
    for definition in definitions:
        for kind in sorted({p["response"] for p in definition["search"]["paths"]} or {"html"}):
            mine = pages.filter((F.col("source") == definition["id"]) & (F.col("format") == kind))
            parts.append(extract_rows(mine, definition, now, (configs or {}).get(definition["id"]), kind=kind, **options))
    return reduce(DataFrame.unionByName, parts)


def extract_each(
    pages: DataFrame, definitions: Sequence[Mapping], now=None, configs: Mapping[str, Mapping] | None = None, **options
) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """extract_all with every source compiled on its own: (rows, [(source, why its rules do not compile)]).

    Pages stored by source let each branch open its own files only.
    """
    parts, failed = [], []
    for definition in definitions:
        try:
            parts.append(extract_all(pages, [definition], now, configs, **options))
        except Exception as problem:  # noqa: BLE001 a rule may be wrong in any way, and must cost no other source
            failed.append((definition["id"], str(problem).splitlines()[0] if str(problem) else type(problem).__name__))
    return (reduce(DataFrame.unionByName, parts) if parts else None), failed


def kept_rows(extracted: DataFrame) -> DataFrame:
    return extracted.filter("row_no IS NOT NULL AND reason IS NULL AND error IS NULL").drop("reason", "error")


def page_errors(extracted: DataFrame) -> DataFrame:
    return extracted.filter("error IS NOT NULL").select(*PAGE, "error")


def yield_report(extracted: DataFrame) -> DataFrame:
    """(source, reason, rows, pages): what became of the rows and pages of each source."""
    outcome = (
        F.when(F.col("error").isNotNull(), F.lit("page failed"))
        .when(F.col("row_no").isNull(), F.lit("no rows"))
        .otherwise(F.coalesce("reason", F.lit("kept")))
    )
    per_page = extracted.groupBy("source", outcome.alias("reason"), "page_id").agg(F.count("row_no").alias("rows"))
    return per_page.groupBy("source", "reason").agg(F.sum("rows").alias("rows"), F.count("*").alias("pages"))


def to_listings(
    rows: DataFrame,
    sources: DataFrame,
    mappings: DataFrame,
    tax: DataFrame,
    now,
    announce: Sequence[str] = (),
) -> DataFrame:
    """Typed listings from extracted rows: one projection, after one join for the source's type
    and the category joins."""

    def text(name: str) -> Column:
        return F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))

    typed = rows.join(sources.select(F.col("id").alias("source"), F.col("type").alias("__type")), "source", "left")
    typed = typed.withColumn("__cat", text("category")).withColumn("__catdesc", text("categorydesc"))
    typed = map_categories(typed, mappings, tax, "__cat", "__catdesc")
    links = coerce.link_fields(text("download"), text("magnet"), text("infohash"), text("title"), F.col("__type"), tuple(announce))
    page_url = F.col("url")
    numbers = {
        "seeders": coerce.peer_count(text("seeders")),
        "leechers": coerce.peer_count(text("leechers")),
        "size": coerce.parse_size(text("size")),
        **{c: coerce.coerce_int(text(c)) for c in ("grabs", "files", "year")},
        "minimum_seed_time": coerce.coerce_int(text("minimumseedtime")),
        "minimum_ratio": coerce.coerce_double(text("minimumratio")),
        "download_volume_factor": coerce.factor(text("downloadvolumefactor")),
        "upload_volume_factor": coerce.factor(text("uploadvolumefactor")),
    }
    ids = {c: coerce.digits(text(c)) for c in ("tvdbid", "tmdbid", "tvmazeid", "traktid", "doubanid", "rageid")}
    plain = ("description", "author", "booktitle", "publisher", "artist", "album", "label", "track")
    listing = typed.filter(text("title") != "").select(
        F.col("source").alias("tracker"),
        "page_id",
        "row_no",
        text("title").alias("name"),
        resolve_url(page_url, text("details")).alias("details_url"),
        resolve_url(page_url, links["download"]).alias("download_url"),
        links["magnet"].alias("magnet"),
        links["infohash"].alias("infohash"),
        parse_unknown(text("date"), now).alias("published"),
        "categories",
        coerce.digits(coerce.first_non_empty(text("imdb"), text("imdbid"))).alias("imdbid"),
        coerce.genres(text("genre")).alias("genres"),
        resolve_url(page_url, text("poster")).alias("poster"),
        *[c.alias(n) for n, c in {**numbers, **ids}.items()],
        *[text(n).alias(n) for n in plain],
    )
    return listing
