"""The listing table: identity, merge, provenance, retention, statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.session import cut_lineage

KEY = ["tracker", "identity"]

#: As many hashes as every task may be told.
FEW = 2_000_000


def identity() -> Column:
    """What tells one listing of a source from another: hash, else details page, else title."""
    # translate, not lower: only ASCII letters fold.
    folded = F.translate("infohash", ascii_uppercase, ascii_lowercase)
    return (
        F.when(F.col("infohash") != "", F.concat(F.lit("btih:"), folded))
        .when(F.col("details_url") != "", F.concat(F.lit("url:"), F.col("details_url")))
        .otherwise(F.concat(F.lit("title:"), F.col("name")))
    )


def with_identity(df: DataFrame) -> DataFrame:
    return df.withColumn("identity", identity())


def merge_rows(sightings: DataFrame, order: Sequence[str], id_col: str | None = None) -> DataFrame:
    """One current row per (tracker, identity): the newest sighting in `order` wins, except that

    * a newer row with no date keeps the last known one,
    * search_managed sticks once set,
    * id_col (if any) keeps the value of the first sighting that had one.

    All aggregates are associative, so sightings are combined map-side before the shuffle
    and a hot listing costs one partial row per task.
    """
    at = F.struct(*order)
    special = {"published", "search_managed", id_col, *KEY}
    payload = [c for c in sightings.columns if c not in special and c not in order]
    newest = F.max(F.struct(at.alias("at"), F.struct(*payload).alias("row"))).alias("newest")
    aggs = [newest]
    if "published" in sightings.columns:
        # A NULL struct field would win nothing: only dated sightings carry the pair.
        dated = F.when(F.col("published").isNotNull(), F.struct(at.alias("at"), F.col("published").alias("value")))
        aggs.append(F.max(dated).alias("dated"))
    if "search_managed" in sightings.columns:
        aggs.append(F.max("search_managed").alias("search_managed"))
    if id_col and list(order) == [id_col]:  # the place is the id: the first one is the least
        aggs.append(F.struct(F.min(id_col).alias("value")).alias("first_id"))
    elif id_col:
        held = F.when(F.col(id_col).isNotNull(), F.struct(at.alias("at"), F.col(id_col).alias("value")))
        aggs.append(F.min(held).alias("first_id"))
    # The leading 64-bit hash gives the sort a numeric prefix; long strings then rarely meet.
    merged = sightings.groupBy(F.xxhash64(*KEY).alias("__hash"), *KEY).agg(*aggs)
    restored = {
        **{c: F.col(f"newest.at.{c}") for c in order},
        "published": F.col("dated.value"),
        "search_managed": F.col("search_managed"),
        **({id_col: F.col("first_id.value")} if id_col else {}),
    }
    return merged.select(
        *[
            (F.col(c) if c in KEY else restored.get(c, F.col(f"newest.row.{c}"))).alias(c)
            for c in sightings.columns
        ]
    )


def seen_again(sightings: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """The hashes of keys that more than one of the sightings holds; None if they are too many to tell every task.

    Eight bytes a row are shuffled. Keys of one hash by chance are among them, which costs a merge of two rows that stay two.
    """
    hashes = sightings.select(F.xxhash64(*KEY).alias("__hash")).groupBy("__hash").agg(F.count("*").alias("n"))
    again = keep(hashes.where("n > 1").select("__hash"))
    return again if again.count() <= FEW else None


def held_by(sightings: DataFrame, again: DataFrame, held: bool) -> DataFrame:
    """Rows whose key has one of the hashes, or none of them, where they lie."""
    rows = sightings.withColumn("__hash", F.xxhash64(*KEY))
    return rows.join(F.broadcast(again), "__hash", "left_semi" if held else "left_anti").drop("__hash")


def merge_apart(sightings: DataFrame, order: Sequence[str], keep: Callable[[DataFrame], DataFrame], id_col: str | None = None) -> DataFrame:
    """merge_rows of stored sightings, moving only rows of listings sighted more than once: any other is current as it stands.

    Where too many were sighted again, all rows are merged; the result is the same.
    """
    again = seen_again(sightings, keep)
    if again is None:
        return merge_rows(sightings, order, id_col)
    return held_by(sightings, again, False).unionByName(merge_rows(held_by(sightings, again, True), order, id_col))


def assign_ids(new: DataFrame, order: Sequence[str], start: int, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Ids for rows never stored before: above `start`, dense, increasing in `order`.

    Rows are dealt by range and numbered where they land; one count per partition reaches the
    driver, so no single task ever sees all rows. `keep` holds the dealt rows until they are read again.
    """
    ranked = new.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    dealt = keep(ranked.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    offsets, before = [], start + 1
    for row in dealt.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first")).orderBy("__part").collect():
        offsets += [F.lit(row["__part"]), F.lit(before - row["first"]).cast("bigint")]
        before += row.n
    if not offsets:
        return dealt.withColumn("id", F.lit(None).cast("bigint")).drop("__part", "__at")
    return dealt.withColumn("id", F.element_at(F.create_map(*offsets), F.col("__part")) + F.col("__at")).drop("__part", "__at")


def merge_searches(bridge: DataFrame, batch: DataFrame) -> DataFrame:
    """One provenance row per (tracker, search_key, identity), refreshed to the latest sighting."""
    return (
        bridge.unionByName(batch.select(*bridge.columns))
        .groupBy("tracker", "search_key", "identity")
        .agg(F.max("last_seen").alias("last_seen"))
    )


def expired(cutoff: Column) -> Column:
    """Retention is by release date; an undated row ages by when it was last seen, if that is known."""
    dated = F.col("published").isNotNull() & (F.col("published") < cutoff)
    undated = F.col("published").isNull() & F.col("last_seen").isNotNull() & (F.col("last_seen") < cutoff)
    return dated | undated


def prune(listings: DataFrame, cutoff: Column) -> DataFrame:
    return listings.filter(~expired(cutoff))


def prune_searches(bridge: DataFrame, cutoff: Column) -> DataFrame:
    return bridge.filter(F.col("last_seen").isNull() | (F.col("last_seen") >= cutoff))


def cascade(bridge: DataFrame, listings: DataFrame) -> DataFrame:
    """Provenance goes with its listing."""
    return bridge.join(listings.select(*KEY), KEY, "left_semi")


def sweep(listings: DataFrame, bridge: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(surviving listings, surviving provenance).

    The cascade needs no join with all survivors: only provenance of expired rows falls,
    and those are the small side of an anti join.
    """
    gone = listings.filter(expired(cutoff)).select(*KEY)
    kept = prune_searches(bridge, cutoff).join(gone, KEY, "left_anti")
    return prune(listings, cutoff), kept


def sweep_report(listings: DataFrame, cutoff: Column) -> DataFrame:
    """How many rows a sweep removes, by rule, from the same scan."""
    dated = F.col("published").isNotNull()
    return listings.agg(
        F.count_if(dated & (F.col("published") < cutoff)).alias("removed_dated"),
        F.count_if(~dated & (F.col("last_seen") < cutoff)).alias("removed_undated"),
        F.count_if(~F.coalesce(expired(cutoff), F.lit(False))).alias("kept"),
    )


def clear_source(listings: DataFrame, bridge: DataFrame, tracker: str) -> tuple[DataFrame, DataFrame]:
    """Drop one source's rows and their provenance."""
    return listings.filter(F.col("tracker") != tracker), bridge.filter(F.col("tracker") != tracker)


def stats(listings: DataFrame) -> DataFrame:
    """Per source: how many listings, and the newest known date."""
    return listings.groupBy("tracker").agg(F.count("*").alias("torrents"), F.max("published").alias("newest"))


def stats_with_total(listings: DataFrame) -> DataFrame:
    """stats() plus the grand total as a row whose tracker is NULL."""
    return listings.rollup("tracker").agg(F.count("*").alias("torrents"), F.max("published").alias("newest"))
