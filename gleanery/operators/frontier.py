"""Planning what to fetch: request x routed source x mirror x search path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions.urls import request_url


def candidate_mirrors(sources: DataFrame) -> DataFrame:
    """(source, ordinal, mirror): links, then legacy links, in order; unparseable ones are left out."""
    links = F.concat(
        F.coalesce("links", F.array().cast("array<string>")), F.coalesce("legacy_links", F.array().cast("array<string>"))
    )
    good = F.filter(links, lambda u: ~u.rlike(r"[\x00-\x20\x7F]|%(?![0-9A-Fa-f]{2})"))
    return sources.select(F.col("id").alias("source"), F.posexplode(good).alias("ordinal", "mirror"))


def choose_path(mapped: Column, declared: Column) -> tuple[Column, Column]:
    """(runs, categories) of a path: it runs without declared categories, or when it shares one
    with the search; a leading ! turns the test around and leaves the path no categories.
    """
    nothing = F.array().cast("array<string>")
    declared = F.coalesce(declared, nothing)
    shared = F.filter(F.coalesce(mapped, nothing), lambda c: F.array_contains(declared, c))
    negated = F.coalesce(F.get(declared, 0) == "!", F.lit(False))
    open_path = F.size(declared) == 0
    runs = open_path | ((F.size(shared) > 0) != negated)
    return runs, F.when(open_path, F.coalesce(mapped, nothing)).when(runs, shared).otherwise(nothing)


def plan_frontier(
    requests: DataFrame,
    sources: DataFrame,
    paths: DataFrame,
    rendered: Callable[[Column], Column] | None = None,
    form: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Every address to fetch: requests on the mirrors and search paths of their source that serve them.

    requests: request_id, source, site_categories and whatever `rendered` (a path struct to the path asked, default
    its own text) and `form` (a path struct to the encoded form) read; paths: source, path_ordinal, path, method, categories.

    A source's paths are one array beside each of its mirrors, so a request chooses among them, and leaves out a
    GET that an earlier path of it already makes, before anything is multiplied out; POSTs all run.
    """
    listed = paths.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("path_ordinal", *[c for c in paths.columns if c not in ("source", "path_ordinal")]))).alias("__paths"))
    mirrors = candidate_mirrors(sources).select("source", F.col("ordinal").alias("mirror_ordinal"), "mirror").join(listed, "source")
    if rendered is None:
        # The address does not depend on the request: resolve it once per source, path and mirror.
        mirrors = mirrors.withColumn("__paths", F.transform("__paths", lambda p: p.withField("url", request_url(F.col("mirror"), p["path"]))))
    planned = requests.join(mirrors, "source")

    def asked(p: Column) -> Column:
        _, categories = choose_path(F.col("site_categories"), p["categories"])
        url = p["url"] if rendered is None else request_url(F.col("mirror"), rendered(p))
        return p.withField("url", url).withField("form", form(p) if form else F.lit("")).withField("request_categories", categories)

    runs = F.filter("__paths", lambda p: choose_path(F.col("site_categories"), p["categories"])[0])
    planned = planned.withColumn("__asked", F.transform(runs, asked))

    def is_get(p: Column) -> Column:
        return F.coalesce(F.lower(p["method"]) != "post", F.lit(True))

    def first(p: Column, i: Column) -> Column:
        # A repeat is an equal GET further up the same array; a source has few paths.
        above = F.slice("__asked", F.lit(1), i)
        return ~is_get(p) | ~F.exists(above, lambda q: is_get(q) & (q["url"] == p["url"]) & (q["form"] == p["form"]))

    out = planned.withColumn("__p", F.explode(F.filter("__asked", first)))
    kept = [c for c in paths.columns if c not in ("source", "categories")]
    return out.select(*requests.columns, "mirror_ordinal", "mirror", *[F.col(f"__p.{c}").alias(c) for c in (*kept, "url", "form", "request_categories")])


def with_site_link(config: Column, mirror: Column) -> Column:
    """The sitelink setting names the mirror in use unless the source sets its own."""
    own = F.coalesce(F.try_element_at(config, F.lit("sitelink")), F.lit(""))
    rest = F.map_filter(config, lambda k, _: k != "sitelink")
    return F.map_concat(rest, F.create_map(F.lit("sitelink"), F.when(own != "", own).otherwise(mirror)))
