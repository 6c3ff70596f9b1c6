"""Categories: the shared taxonomy, mapping a source's own to it, and expanding requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gleanery.session import literal_table

# The standard category names and ids, by group.
STANDARD_CATEGORIES = {
    "Console": 1000,
    "Console/NDS": 1010,
    "Console/PSP": 1020,
    "Console/Wii": 1030,
    "Console/XBox": 1040,
    "Console/XBox 360": 1050,
    "Console/Wiiware": 1060,
    "Console/XBox 360 DLC": 1070,
    "Console/PS3": 1080,
    "Console/Other": 1090,
    "Console/3DS": 1110,
    "Console/PS Vita": 1120,
    "Console/WiiU": 1130,
    "Console/XBox One": 1140,
    "Console/PS4": 1180,
    "Movies": 2000,
    "Movies/Foreign": 2010,
    "Movies/Other": 2020,
    "Movies/SD": 2030,
    "Movies/HD": 2040,
    "Movies/UHD": 2045,
    "Movies/BluRay": 2050,
    "Movies/3D": 2060,
    "Movies/DVD": 2070,
    "Movies/WEB-DL": 2080,
    "Audio": 3000,
    "Audio/MP3": 3010,
    "Audio/Video": 3020,
    "Audio/Audiobook": 3030,
    "Audio/Lossless": 3040,
    "Audio/Other": 3050,
    "Audio/Foreign": 3060,
    "PC": 4000,
    "PC/0day": 4010,
    "PC/ISO": 4020,
    "PC/Mac": 4030,
    "PC/Mobile-Other": 4040,
    "PC/Games": 4050,
    "PC/Mobile-iOS": 4060,
    "PC/Mobile-Android": 4070,
    "TV": 5000,
    "TV/WEB-DL": 5010,
    "TV/Foreign": 5020,
    "TV/SD": 5030,
    "TV/HD": 5040,
    "TV/UHD": 5045,
    "TV/Other": 5050,
    "TV/Sport": 5060,
    "TV/Anime": 5070,
    "TV/Documentary": 5080,
    "XXX": 6000,
    "XXX/DVD": 6010,
    "XXX/WMV": 6020,
    "XXX/XviD": 6030,
    "XXX/x264": 6040,
    "XXX/UHD": 6045,
    "XXX/Pack": 6050,
    "XXX/ImageSet": 6060,
    "XXX/Other": 6070,
    "XXX/SD": 6080,
    "XXX/WEB-DL": 6090,
    "Books": 7000,
    "Books/Mags": 7010,
    "Books/EBook": 7020,
    "Books/Comics": 7030,
    "Books/Technical": 7040,
    "Books/Other": 7050,
    "Books/Foreign": 7060,
    "Other": 8000,
    "Other/Misc": 8010,
    "Other/Hashed": 8020,
}

CUSTOM_BASE = 100_000
GROUP_SIZE = 1000

MAPPING_COLUMNS = "source string, ordinal int, cat_id string, cat string, desc string, is_default boolean"


def taxonomy(spark: SparkSession) -> DataFrame:
    """The fixed 71-row dimension (name, id, parent_id)."""
    rows = [(name, i, i - i % GROUP_SIZE) for name, i in STANDARD_CATEGORIES.items()]
    return literal_table(spark, rows, "name string, id int, parent_id int")


def custom_id(cat_id: Column, desc: Column) -> Column:
    """A described mapping's own id: 100000 + its 32-bit number, else + two SHA-1 bytes, low byte first."""
    numeric = F.when(cat_id.rlike(r"^[+-]?[0-9]+$"), cat_id.try_cast("int"))
    digest = F.sha1(cat_id.cast("binary"))
    hashed = F.conv(F.concat(F.substring(digest, 3, 2), F.substring(digest, 1, 2)), 16, 10).cast("int")
    return F.when(F.coalesce(desc, F.lit("")) != "", F.lit(CUSTOM_BASE) + F.coalesce(numeric, hashed))


def resolved_mappings(mappings: DataFrame, tax: DataFrame) -> DataFrame:
    """Mappings whose standard name is known, with std_id and custom_id; the others drop out."""
    known = tax.select(F.col("name").alias("cat"), F.col("id").alias("std_id"))
    return mappings.join(F.broadcast(known), "cat").withColumn("custom_id", custom_id(F.col("cat_id"), F.col("desc")))


def _fold_key(c: Column) -> Column:
    from gleanery.functions.coerce import trim_space

    return F.lower(trim_space(c))


def _ids_by(mappings: DataFrame, key: str, out: str) -> DataFrame:
    """(source, key) -> distinct ids in mapping order. Mappings are rule data: one row per rule line."""
    pair = F.array_compact(F.array("std_id", "custom_id"))
    return (
        mappings.select("source", F.lower(key).alias("map_key"), "ordinal", pair.alias("ids"))
        .groupBy("source", "map_key")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "ids"))).alias("arms"))
        .select(
            "source",
            "map_key",
            F.array_distinct(F.flatten(F.transform("arms", lambda a: a["ids"]))).alias(out),
        )
    )


def map_categories(
    rows: DataFrame,
    mappings: DataFrame,
    tax: DataFrame,
    category: str = "category",
    category_desc: str | None = "categorydesc",
    out: str = "categories",
) -> DataFrame:
    """Every mapping whose id (then whose description) equals the row's text applies, in mapping order.

    The mappings are reduced to one row per (source, key) before the join, so no row of
    the big side is ever multiplied; Spark broadcasts the reduced side when it is small.
    """
    known = resolved_mappings(mappings, tax)
    empty = F.array().cast("array<int>")
    by_id = _ids_by(known, "cat_id", "__by_id").withColumnRenamed("map_key", "__key_id")
    result = rows.withColumn("__key_id", _fold_key(F.col(category))).join(by_id, ["source", "__key_id"], "left")
    ids = F.when(F.col("__key_id") != "", F.coalesce("__by_id", empty)).otherwise(empty)
    drop = ["__key_id", "__by_id"]
    if category_desc is not None and category_desc in rows.columns:
        by_desc = _ids_by(known.filter(F.coalesce("desc", F.lit("")) != ""), "desc", "__by_desc")
        by_desc = by_desc.withColumnRenamed("map_key", "__key_desc")
        result = result.withColumn("__key_desc", _fold_key(F.col(category_desc))).join(
            by_desc, ["source", "__key_desc"], "left"
        )
        ids = F.array_union(ids, F.coalesce("__by_desc", empty))
        drop += ["__key_desc", "__by_desc"]
    return result.withColumn(out, ids).drop(*drop)


def _groups() -> Column:
    """Constant map: whole-group id -> the known ids strictly inside it, as text."""
    parts = []
    for parent in sorted({i for i in STANDARD_CATEGORIES.values() if i % GROUP_SIZE == 0}):
        inside = sorted(i for i in STANDARD_CATEGORIES.values() if parent < i < parent + GROUP_SIZE)
        parts += [F.lit(parent), F.array(*[F.lit(str(i)) for i in inside])]
    return F.create_map(*parts)


def expand_categories(requests: DataFrame, col: str = "categories", out: str = "expanded") -> DataFrame:
    """Requested ids (text) plus every known id of a requested whole group, distinct, sorted as text.

    The fixed taxonomy is one constant map, so requests need neither explode nor shuffle.
    """
    groups, nothing = _groups(), F.array().cast("array<string>")

    def group_of(c: Column) -> Column:
        number = F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("int"))
        return F.coalesce(F.try_element_at(groups, number), nothing)

    widened = F.flatten(F.transform(F.col(col), lambda c: F.concat(F.array(c), group_of(c))))
    return requests.withColumn(out, F.array_sort(F.array_distinct(F.coalesce(widened, nothing))))


def site_categories(
    requests: DataFrame, mappings: DataFrame, tax: DataFrame, col: str = "categories"
) -> DataFrame:
    """(request, source) -> the source's own ids for the requested ones, in mapping order.

    Nothing mapped, or nothing requested, falls back to the mappings flagged default.
    `requests` carries `source`; the mapping table is reduced before it meets them.
    """
    asked = "__asked"
    known = resolved_mappings(mappings, tax)
    targets = known.select(
        "source", "ordinal", "cat_id", F.explode(F.array_compact(F.array("std_id", "custom_id")).cast("array<string>")).alias("wanted")
    )
    # Requests that ask a source for the same categories are answered once.
    keyed = requests.withColumn(asked, F.array_sort(F.array_distinct(F.coalesce(col, F.array().cast("array<string>")))))
    distinct = expand_categories(keyed.select("source", asked).distinct(), asked, "__expanded")
    hits = (
        distinct.select("source", asked, F.explode("__expanded").alias("wanted"))
        .join(targets, ["source", "wanted"])
        .groupBy("source", asked)
        .agg(F.array_sort(F.collect_set(F.struct("ordinal", "cat_id"))).alias("arms"))
        .select("source", asked, F.array_distinct(F.transform("arms", lambda a: a["cat_id"])).alias("mapped"))
    )
    defaults = (
        mappings.filter("is_default")
        .groupBy("source")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "cat_id"))).alias("arms"))
        .select("source", F.array_distinct(F.transform("arms", lambda a: a["cat_id"])).alias("defaults"))
    )
    return (
        keyed.join(hits, ["source", asked], "left")
        .join(defaults, "source", "left")
        .withColumn("site_categories", F.coalesce("mapped", "defaults", F.array().cast("array<string>")))
        .drop("mapped", "defaults", asked)
    )


def supported_categories(mappings: DataFrame, tax: DataFrame) -> DataFrame:
    """Distinct standard categories the given mappings reach, by id."""
    return (
        resolved_mappings(mappings, tax).select(F.col("std_id").alias("id"), F.col("cat").alias("name")).distinct().orderBy("id")
    )


def custom_categories(mappings: DataFrame, tax: DataFrame) -> DataFrame:
    """(source, id, name): described mappings, first description per id, with their display position."""
    firsts = (
        resolved_mappings(mappings, tax)
        .filter("custom_id IS NOT NULL")
        .groupBy("source", F.col("custom_id").alias("id"))
        .agg(F.min_by("desc", "ordinal").alias("name"))
    )
    return firsts.withColumn("position", F.row_number().over(W.partitionBy("source").orderBy(*name_order("name"))))


def source_categories(mappings: DataFrame, tax: DataFrame) -> DataFrame:
    """Per source: its standard categories by id, then its custom ones by name, as one array."""
    std = (
        resolved_mappings(mappings, tax)
        .groupBy("source")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("std_id").alias("id"), F.col("cat").alias("name")))).alias("std"))
    )
    own = (
        custom_categories(mappings, tax)
        .groupBy("source")
        .agg(F.array_sort(F.collect_list(F.struct("position", "id", "name"))).alias("own"))
        .select("source", F.transform("own", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"))).alias("own"))
    )
    return std.join(own, "source", "left").select(
        "source", F.concat("std", F.coalesce("own", F.array().cast("array<struct<id:int,name:string>>"))).alias("categories")
    )


def name_order(name: str) -> list[Column]:
    """Case-insensitive, the lower-case spelling first on ties."""
    return [F.lower(name).asc(), F.col(name).desc()]
