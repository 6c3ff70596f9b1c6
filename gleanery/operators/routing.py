"""Which sources can answer which requests, and what each source can do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.operators.taxonomy import source_categories, supported_categories

# What a source that declares no search modes can do.
DEFAULT_MODES = {
    "movie-search": ["q", "imdbid"],
    "search": ["q"],
    "tv-search": ["q", "season", "ep", "tvdbid"],
}

SOURCES = (
    "id string, name string, description string, language string, type string, links array<string>,"
    " legacy_links array<string>, replaces array<string>, encoding string, request_delay double,"
    " allow_raw_search boolean, allow_tv_imdb boolean, modes map<string,array<string>>,"
    " requires_login boolean, pages_server_side boolean, file_name string"
)


def _literal_modes() -> Column:
    pairs = []
    for mode, params in DEFAULT_MODES.items():
        pairs += [F.lit(mode), F.array(*[F.lit(p) for p in params])]
    return F.create_map(*pairs)


def effective_modes(modes: Column) -> Column:
    """Declared modes, with q for an empty parameter list; the defaults when none are declared."""
    declared = F.transform_values(
        modes, lambda _, params: F.when(F.size(F.coalesce(params, F.array().cast("array<string>"))) == 0, F.array(F.lit("q"))).otherwise(params)
    )
    return F.when(F.coalesce(F.size(F.map_keys(modes)), F.lit(0)) <= 0, _literal_modes()).otherwise(declared)


def search_modes(sources: DataFrame) -> DataFrame:
    """(source, mode, ordinal, param), one row per accepted parameter."""
    flat = sources.select(F.col("id").alias("source"), F.explode(effective_modes(F.col("modes"))).alias("mode", "params"))
    return flat.select("source", "mode", F.posexplode("params").alias("ordinal", "param"))


def _takes(modes: Column, mode: str, param: str) -> Column:
    return F.coalesce(F.array_contains(F.try_element_at(modes, F.lit(mode)), param), F.lit(False))


def capabilities(sources: DataFrame) -> DataFrame:
    """(source, capability): one row per thing the source can be asked for."""
    modes = effective_modes(F.col("modes"))
    has = F.map_keys(modes)
    granted = [
        ("any", F.lit(True)),
        ("movie:imdbid", _takes(modes, "movie-search", "imdbid")),
        ("tv:imdb", F.coalesce(F.col("allow_tv_imdb"), F.lit(False))),
        ("tv:rid", _takes(modes, "tv-search", "rid")),
        ("tv:tvdbid", _takes(modes, "tv-search", "tvdbid")),
        ("mode:tvsearch", F.array_contains(has, "tv-search")),
        ("mode:movie", F.array_contains(has, "movie-search")),
        ("mode:music", F.array_contains(has, "music-search") | F.array_contains(has, "audio-search")),
        ("mode:book", F.array_contains(has, "book-search")),
    ]
    caps = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in granted]))
    return sources.select(F.col("id").alias("source"), F.explode(caps).alias("capability"))


def needed_capabilities() -> Column:
    """Capabilities any one of which lets a source answer the request."""
    kind = F.col("type")
    by_type = F.when(kind.isin("tvsearch", "movie", "music", "book"), F.concat(F.lit("mode:"), kind)).otherwise(F.lit("any"))
    by_id = F.array_compact(F.array(F.lit("movie:imdbid"), F.when(kind == "tvsearch", F.lit("tv:imdb"))))
    general = F.array_compact(
        F.array(
            by_type,
            F.when(F.col("tvrageid") != "", F.lit("tv:rid")),
            F.when(F.col("tvdbid") != "", F.lit("tv:tvdbid")),
        )
    )
    return F.when(F.col("imdbid") != "", by_id).otherwise(general)


def route_requests(requests: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with `needs`, routes (needs, source)): what each request asks for, and who answers each such set.

    Requests fall into a handful of need sets, so the sources of a set are worked out and kept once, by an
    equi-join on capability. Requests never meet sources: join the two on `needs` for the pairs wanted.
    """
    needing = requests.withColumn("needs", F.array_join(F.array_sort(needed_capabilities()), " "))
    sets = needing.select("needs").distinct().withColumn("capability", F.explode(F.split("needs", " ")))
    return needing, sets.join(capabilities(sources), "capability").select("needs", "source").distinct()


def unsupported(needing: DataFrame, routes: DataFrame) -> DataFrame:
    """Requests no source can answer."""
    return needing.join(routes.select("needs").distinct(), "needs", "left_anti").drop("needs")


def restrict_sources(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sources among the wanted ids; unknown ids are ignored and no hit means no source."""
    return sources.join(wanted.select(F.col("source").alias("id")), "id", "left_semi")


def live_replaces(sources: DataFrame) -> DataFrame:
    """(old_id, id, rank): former ids that no loaded source owns itself."""
    former = sources.select("id", "file_name", F.posexplode("replaces").alias("rank", "old_id"))
    owned = sources.select(F.col("id").alias("old_id"))
    return former.join(owned, "old_id", "left_anti")


def resolve_source(requests: DataFrame, sources: DataFrame, col: str = "source") -> DataFrame:
    """resolved: the id itself when loaded, else the source (first by file name) that replaced it."""
    exact = sources.select(F.col("id").alias(col), F.col("id").alias("__exact"))
    renamed = (
        live_replaces(sources)
        .groupBy(F.col("old_id").alias(col))
        .agg(F.min_by("id", F.struct("file_name", "id")).alias("__renamed"))
    )
    return (
        requests.join(exact, col, "left")
        .join(renamed, col, "left")
        .withColumn("resolved", F.coalesce("__exact", "__renamed"))
        .drop("__exact", "__renamed")
    )


def resolve_settings(settings: DataFrame, overrides: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, config map): defaults overlaid by the source's overrides, or by those of the
    first former id that has any when the source itself has none.

    settings: source, name, type, default (text, NULL for none); overrides: source, name, value.
    """
    own = overrides.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("__own"))
    inherited = (
        sources.select(F.col("id").alias("source"), F.posexplode("replaces").alias("rank", "old"))
        .join(own.select(F.col("source").alias("old"), F.col("__own").alias("__old")), "old")
        .groupBy("source")
        .agg(F.min_by("__old", "rank").alias("__old"))
    )
    value = F.col("default")
    overlay = F.coalesce("__own", "__old")
    overlaid = F.when(F.map_contains_key(overlay, F.col("name")), F.try_element_at(overlay, F.col("name"))).otherwise(value)
    truthy = F.lower("__value").isin("1", "t", "true")
    text = (
        F.when(F.col("type") == "checkbox", F.when(truthy, F.lit("True")).otherwise(F.lit("")))
        .otherwise(F.coalesce("__value", F.lit("")))
    )
    return (
        settings.join(own, "source", "left")
        .join(inherited, "source", "left")
        .withColumn("__value", F.coalesce(overlaid, F.when(overlay.isNull(), value)))
        .groupBy("source")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", text.alias("value"))))).alias("config"))
    )


# --- selecting sources by expression --------------------------------------------------


class UnsupportedFilter(ValueError):
    """A source filter with a name or value that means nothing."""


def source_predicate(expression: str) -> Column:
    """`type:public+lang:en,!status:failing` as a predicate over sources joined with their
    health (failures, scraped). Comma is OR, plus is AND and binds tighter, ! negates.
    """
    failures, scraped = F.coalesce(F.col("failures"), F.lit(0)), F.coalesce(F.col("scraped"), F.lit(False))
    # Health words and what they test.
    health = {
        ("status", "healthy"): failures == 0,
        ("test", "passed"): failures == 0,
        ("status", "failing"): failures > 0,
        ("test", "failed"): failures > 0,
        ("status", "unknown"): ~scraped,
    }

    def term(text: str) -> Column:
        text = text.strip()
        negated = text.startswith("!")
        text = text.removeprefix("!").strip()
        name, colon, value = text.partition(":")
        if not colon:
            raise UnsupportedFilter(f"{text!r} names no filter")
        name, value = name.strip().lower(), value.strip().lower()
        if name == "lang":
            test = F.lower("language").startswith(value)
        elif name == "type":
            test = F.lower("type") == value
        elif name == "tag":
            test = F.lit(False)
        elif name in ("status", "test"):
            if (name, value) not in health:
                raise UnsupportedFilter(f"{name!r} has no value {value!r}")
            test = health[(name, value)]
        else:
            raise UnsupportedFilter(repr(name))
        test = F.coalesce(test, F.lit(False))
        return ~test if negated else test

    groups = [[term(t) for t in group.split("+")] for group in expression.split(",")]
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, terms) for terms in groups])


def id_search_supported() -> Column:
    """Whether a request's external id is one the source advertises (and-match then stands down).

    Reads request columns beside the source's declared `modes` and `allow_tv_imdb`.
    """
    modes = F.col("modes")
    movie_imdb = _takes(modes, "movie-search", "imdbid")
    tv_imdb = F.coalesce(F.col("allow_tv_imdb"), F.lit(False))
    any_imdb = movie_imdb | tv_imdb
    gates = [
        ("imdbid", any_imdb),
        ("tmdbid", _takes(modes, "movie-search", "tmdbid") | _takes(modes, "tv-search", "tmdbid")),
        ("tvdbid", _takes(modes, "tv-search", "tvdbid")),
        ("doubanid", any_imdb),
        ("traktid", any_imdb),
        ("tvmazeid", tv_imdb),
        ("tvrageid", tv_imdb),
    ]
    return reduce(lambda a, b: a | b, [(F.col(c) != "") & ok for c, ok in gates])


# --- capabilities --------------------------------------------------------------------


def merged_modes(sources: DataFrame, by: Column | None = None) -> DataFrame:
    """(mode, params): the union over a set of sources, sorted; a set of one source keeps its own order.

    With `by` every value of it is a set of its own, and a column `by` comes first.
    """
    keyed = sources.withColumn("__by", F.lit(0) if by is None else by)
    sizes = keyed.groupBy("__by").agg(F.count_distinct("id").alias("__size"))
    flat = keyed.select("__by", F.explode(effective_modes(F.col("modes"))).alias("mode", "params"))
    rows = flat.select("__by", "mode", F.posexplode_outer("params").alias("ordinal", "param"))
    merged = rows.groupBy("__by", "mode").agg(
        F.array_sort(F.collect_set("param")).alias("sorted"),
        F.array_sort(F.collect_set(F.when(F.col("param").isNotNull(), F.struct("ordinal", "param")))).alias("own"),
    )
    params = F.when(F.col("__size") == 1, F.transform("own", lambda p: p["param"])).otherwise(F.col("sorted"))
    out = merged.join(sizes, "__by").select(*([] if by is None else [F.col("__by").alias("by")]), "mode", params.alias("params"))
    return out


def _searching(modes: Column, raw: Column) -> Column:
    engine = F.when(raw, F.lit("raw")).otherwise(F.lit(""))

    def mode(*names: str) -> Column:
        params = F.coalesce(*[F.try_element_at(modes, F.lit(n)) for n in names])
        return F.struct(
            F.when(params.isNotNull(), F.lit("yes")).otherwise(F.lit("no")).alias("available"),
            engine.alias("searchEngine"),
            F.coalesce(F.array_join(params, ","), F.lit("")).alias("supportedParams"),
        )

    return F.struct(
        mode("music-search", "audio-search").alias("audio_search"),
        mode("book-search").alias("book_search"),
        mode("movie-search").alias("movie_search"),
        mode("search").alias("search"),
        mode("tv-search").alias("tv_search"),
    )


def caps(sources: DataFrame, mappings: DataFrame, tax: DataFrame) -> DataFrame:
    """Per source: its own categories and search modes, and the page limits."""
    from gleanery.operators.search import FEED_DEFAULT, FEED_MAX

    cats = source_categories(mappings, tax).withColumnRenamed("source", "id")
    nothing = F.array().cast("array<struct<id:int,name:string>>")
    return sources.join(cats, "id", "left").select(
        "id",
        "name",
        F.coalesce("categories", nothing).alias("categories"),
        F.struct(F.lit(FEED_DEFAULT).alias("default"), F.lit(FEED_MAX).alias("max")).alias("limits"),
        _searching(effective_modes(F.col("modes")), F.coalesce("allow_raw_search", F.lit(False))).alias("searching"),
    )


def aggregate_caps(sources: DataFrame, mappings: DataFrame, tax: DataFrame) -> DataFrame:
    """One row for all sources together: merged modes, raw search if any allows it, no custom categories."""
    modes = merged_modes(sources).agg(F.map_from_entries(F.collect_list(F.struct("mode", "params"))).alias("m"))
    cats = supported_categories(mappings, tax).agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("c"))
    raw = sources.agg(F.coalesce(F.bool_or("allow_raw_search"), F.lit(False)).alias("raw"))
    return raw.select(
        cats.scalar().alias("categories"),
        _searching(modes.scalar(), F.col("raw")).alias("searching"),
    )


def source_list(sources: DataFrame, mappings: DataFrame, tax: DataFrame, configured: bool = True) -> DataFrame:
    """Every source with its own capabilities; asking for unconfigured ones is an empty answer."""
    listed = caps(sources, mappings, tax).drop("name").join(sources, "id")
    return listed.filter(F.lit(configured)).select(
        "id", F.lit(True).alias("configured"), F.col("name").alias("title"), "description", "language", "type",
        F.coalesce(F.get("links", 0), F.lit("")).alias("link"), "categories", "limits", "searching",
    )


def source_directory_json(sources: DataFrame, mappings: DataFrame, tax: DataFrame) -> DataFrame:
    """(id, json): the directory entry of every source."""
    listed = caps(sources, mappings, tax).select("id", "categories").join(sources, "id")
    cats = F.transform("categories", lambda c: F.struct(c["id"].cast("string").alias("ID"), c["name"].alias("Name")))
    entry = F.struct(
        F.slice("links", 2, F.greatest(F.size("links") - 1, F.lit(0))).alias("alternativesitelinks"),
        cats.alias("caps"),
        F.lit(True).alias("configured"),
        "description",
        "id",
        "language",
        F.lit("").alias("last_error"),
        "name",
        F.lit(False).alias("potatoenabled"),
        F.coalesce(F.get("links", 0), F.lit("")).alias("site_link"),
        F.array().cast("array<string>").alias("tags"),
        "type",
    )
    return listed.select("id", F.to_json(entry).alias("json"))
