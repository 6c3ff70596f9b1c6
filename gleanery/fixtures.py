"""Listing, request, attempt and page tables derived from the driver's star schema.

Every view is a plain projection or join, so filters and column pruning still reach the
parquet scans. Each has the same definition in SQL in plans/sql.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.operators import taxonomy
from gleanery.operators.listings import identity, merge_apart, merge_rows
from gleanery.session import Stage, literal_table, shared_path, write_step

SEQ = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

# One mapping row per part type.
TYPE_MAPPINGS = [
    (0, "ECONOMY", "Movies/SD", "", True),
    (1, "SMALL", "Movies/HD", "", False),
    (2, "SMALL", "TV/HD", "", False),
    (3, "MEDIUM", "TV/SD", "Medium", False),
    (4, "STANDARD", "Audio/MP3", "", True),
    (5, "LARGE", "Books/EBook", "Large", False),
    (6, "PROMO", "Promotions", "Promo", False),
]

# What the synthetic requests ask for, picked by event number.
REQUEST_TERMS = [
    ["hot", "rod"],
    ["cold", "plate"],
    ["blue"],
    ["small", "gizmo", "brand#1"],
    ["e"],
    ["RED", "Widget"],
    ["old", "zz"],
    [],
    ["an", "il"],
    ["large", "ring", "economy"],
    ["new bolt"],
]
REQUEST_CATEGORIES = [[], ["2000"], ["5040"], ["7000", "3000"], ["105034"], ["2040", "2030"], ["abc", "02030"]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table dealt evenly over the session's partitions, for projections that cost far more than
    moving a row: the driver's tables are files of one row group each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def category_mappings(spark: SparkSession, source: str = "shop") -> DataFrame:
    rows = [(source, o, i, c, d, flag) for o, i, c, d, flag in TYPE_MAPPINGS]
    return literal_table(spark, rows, taxonomy.MAPPING_COLUMNS)


def sightings(spark: SparkSession, sf_dir: str, with_categories: bool = True, lines: DataFrame | None = None) -> DataFrame:
    """One row per lineitem (batch or stream): one sighting of a listing. Later in SEQ order wins."""
    li = table(spark, sf_dir, "lineitem") if lines is None else lines
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_type", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name")
    )
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("tracker"))
    if with_categories:
        # The category depends on the part alone, so it is mapped on the part table, before the big join.
        part = taxonomy.map_categories(
            part.withColumn("source", F.lit("shop")),
            category_mappings(spark),
            taxonomy.taxonomy(spark),
            category="p_type",
            category_desc=None,
        ).drop("source")
    key = F.col("l_orderkey").cast("string")
    hashed = F.concat(F.md5(key.cast("binary")), F.lit("00000000"))
    odd = F.col("l_linenumber") % 2 == 1
    joined = li.join(part, "l_partkey").join(supplier, "l_suppkey")
    shipped = F.col("l_shipdate").cast("timestamp")
    return joined.select(
        "tracker",
        "name",
        F.when(F.col("l_returnflag") == "R", F.when(odd, F.upper(hashed)).otherwise(hashed)).otherwise("").alias("infohash"),
        F.when(
            F.col("l_returnflag") == "A",
            F.concat(F.lit("https://x.invalid/"), key, F.lit("/"), F.col("l_linenumber").cast("string")),
        ).otherwise("").alias("details_url"),
        F.when(F.col("l_linestatus") == "O", shipped).alias("published"),
        F.timestamp_add("DAY", F.col("l_linenumber"), shipped).alias("last_seen"),
        F.col("l_quantity").cast("int").alias("seeders"),
        F.col("l_linenumber").alias("leechers"),
        (F.col("l_quantity").cast("bigint") * 1048576).alias("size"),
        *(["categories"] if with_categories else []),
        F.when(F.col("l_partkey") % 3 == 0, F.lpad(F.col("l_partkey").cast("string"), 7, "0")).otherwise("").alias("imdbid"),
        F.when(F.col("l_partkey") % 5 == 0, F.col("l_suppkey").cast("string")).otherwise("").alias("tvdbid"),
        (~odd).alias("search_managed"),
        F.col("l_returnflag").alias("search_key"),
        *SEQ,
    ).withColumn("identity", identity())


def merged_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue merged from all sightings; `id` is the first sighting's place in SEQ order, as a struct."""
    return merge_rows(_placed_sightings(spark, sf_dir), ["id"], id_col="id")


def _placed_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark, sf_dir).withColumn("id", F.struct(*SEQ)).drop("search_key", *SEQ)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a file stream."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}*.parquet")


def store_batch(seen: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """Sightings with their order as the long columns a store merge wants, and those columns' names."""
    order = {
        "o_day": F.unix_seconds(F.col("l_shipdate").cast("timestamp")),
        "o_order": F.col("l_orderkey"),
        "o_line": F.col("l_linenumber").cast("bigint"),
        "o_part": F.col("l_partkey"),
        "o_supp": F.col("l_suppkey"),
        "o_price": F.round(F.col("l_extendedprice") * 100).cast("bigint"),
    }
    kept = [c for c in seen.columns if c not in SEQ and c not in ("search_key", "search_managed", "last_seen", "identity")]
    return seen.select(*kept, *[c.alias(n) for n, c in order.items()]), tuple(order)


_CATALOGUES: dict[tuple[str, str], str] = {}


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored catalogue: merged once per application, written to the shared folder, read by every search.

    Every file is sorted by source and date, so a search over named sources or recent dates
    skips row groups by their min/max; rows stay where the merge left them, so none is moved a second time.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CATALOGUES:
        path = shared_path(spark, "catalogue")
        with Stage(spark, "sightings") as stage:
            merged = merge_apart(stage.keep(_placed_sightings(spark, sf_dir)), ["id"], stage.keep, id_col="id")
            write_step(merged.sortWithinPartitions("tracker", "published"), path)
        _CATALOGUES[key] = path
    return spark.read.parquet(_CATALOGUES[key])


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance: managed sightings were produced by the search named by their return flag."""
    return (
        sightings(spark, sf_dir, with_categories=False)
        .filter("search_managed")
        .groupBy("tracker", "search_key", "identity")
        .agg(F.max("last_seen").alias("last_seen"))
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search request per event, from fixed lists picked by event number."""
    events = table(spark, sf_dir, "events")

    def pick(lists: list[list[str]], index) -> F.Column:
        choices = F.array(*[F.array(*[F.lit(v) for v in row]).cast("array<string>") for row in lists])
        return F.get(choices, (index % len(lists)).cast("int"))

    source = F.concat(F.lit("Supplier#"), F.lpad((F.col("user_id") % 10).cast("string"), 9, "0"))
    return events.select(
        F.col("event_id").alias("request_id"),
        "ts",
        source.alias("source"),
        F.col("event_type").alias("key"),
        pick(REQUEST_TERMS, F.col("event_id")).alias("terms"),
        pick(REQUEST_CATEGORIES, F.floor(F.col("event_id") / 3)).alias("categories"),
        F.when(F.col("event_type") == "purchase", F.array(source)).otherwise(F.array().cast("array<string>")).alias("trackers"),
        (F.col("event_type") == "view").alias("needs_category"),
        F.lit(5).alias("limit"),
        F.when(F.col("event_type") == "click", F.lit(3)).otherwise(F.lit(0)).alias("offset"),
    )


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search per event, its words, ids and sources taken from a part of its own; pages lie up to 300 rows deep and hold up to 10,000."""
    events, part = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    many = part.agg(F.count("*")).scalar()
    e = events.withColumn("p_partkey", (F.col("event_id") * 7) % many + 1).join(part, "p_partkey")
    n, kind = F.col("event_id"), F.col("event_id") % 20
    word = F.split("p_name", " ")
    none = F.array().cast("array<string>")
    brand = F.lower("p_brand")
    source = F.concat(F.lit("Supplier#"), F.lpad((F.col("user_id") % 10).cast("string"), 9, "0"))
    # One in twenty browses everything of a source, one looks for an id, three for a single letter in a named source.
    terms = (
        F.when(kind < 2, none)
        .when(kind < 5, F.array(F.substring("p_type", 1, 1)))
        .when(kind < 9, F.array(F.substring(word[1], 1, 3), brand))
        .when(kind < 14, F.array(word[0], F.upper(word[1]), brand))
        .otherwise(F.array(F.concat_ws(" ", word[1], brand), F.lower(F.substring("p_type", 2, 4))))
    )
    imdb = F.concat(F.lit("tt"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    return e.select(
        n.alias("request_id"),
        terms.alias("terms"),
        F.when(kind.isin(5, 10, 15), F.array(F.lit("2000"), F.lit("5040"))).when(kind == 16, F.array(F.lit("3010"))).otherwise(none).alias("categories"),
        F.when(kind < 5, F.array(source)).otherwise(none).alias("trackers"),
        (kind == 11).alias("needs_category"),
        F.when(kind.isin(12, 13), F.array(F.lower("p_type"))).otherwise(none).alias("unsearched_terms"),
        F.when(kind.isin(1, 6), F.create_map(F.lit("imdbid"), imdb)).otherwise(F.create_map().cast("map<string,string>")).alias("ids"),
        F.when(kind.isin(3, 7, 17, 18), F.get(F.array(F.lit("R"), F.lit("A"), F.lit("N")), (n % 3).cast("int"))).otherwise("").alias("query_key"),
        F.when(n % 997 == 0, F.lit(10_000)).otherwise(F.lit(5)).alias("limit"),
        F.when(kind.isin(2, 8), n % 300).otherwise(F.lit(0)).alias("offset"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scrape attempt per event: error events failed, value is the elapsed seconds."""
    events = table(spark, sf_dir, "events")
    started = F.col("ts").cast("timestamp")
    return events.select(
        F.col("user_id").cast("string").alias("source"),
        F.col("event_type").alias("key"),
        F.col("event_id").alias("attempt_id"),
        started.alias("started"),
        F.timestamp_micros(F.unix_micros(started) + F.round(F.col("value") * 1_000_000).cast("bigint")).alias("ended"),
        (F.col("event_type") != "error").alias("ok"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages: source is the host of the address."""
    pages = spread(table(spark, sf_dir, "pages"))
    return pages.select(
        "page_id",
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("source"),
        "url",
        F.lit("html").alias("format"),
        F.col("html").alias("body"),
    )
