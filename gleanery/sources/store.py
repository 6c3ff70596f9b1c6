"""The listing and provenance tables as bucketed Parquet, merged bucket by bucket."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gleanery.operators import listings as ops
from gleanery.schema import LISTING, SEARCHES, check_schema, default_for
from gleanery.session import Stage, literal_table, shuffles_dropped

BUCKETS = 64
ROWS_PER_FILE = 5_000_000
# Rows are not dealt by bucket if files hold this many on average without that.
LEAST_ROWS = 10_000
COLUMNS = LISTING.names


class ListingStore:
    """Listings under <root>/listings, provenance under <root>/searches, both by bucket.

    A bucket is a hash of the source, so a search over named sources opens only their
    buckets. Rows are merged by an aggregate keyed on (tracker, identity); those that are neither
    stored nor in the batch twice need none and are not moved for it. A large merge writes
    rows where they lie; a small one, which would leave crumbs, deals them so that a bucket is
    written by as many tasks as its rows fill files, spread by identity. Either way a source
    holding a third of all rows is never one task's work.

    A write goes to a staging folder first, since it reads the table it replaces; the staged
    buckets then take the place of the touched ones by renaming. Staging and table share one
    root on the shared file system. One writer at a time: a merge and a sweep must not overlap.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets, self.rows_per_file = buckets, rows_per_file

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _filled(self, path: str) -> set[int]:
        """The buckets that hold rows."""
        fs, p = self._fs(path)
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return {int(name.removeprefix("bucket=")) for name in found if name.startswith("bucket=")}

    def _remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("tracker"), F.lit(self.buckets)).cast("int")

    # -- reading

    def _read(self, name: str) -> DataFrame:
        schema = T.StructType([*(LISTING if name == "listings" else SEARCHES).fields, T.StructField("bucket", T.IntegerType())])
        path = f"{self.root}/{name}"
        if not self._filled(path):
            return self.spark.createDataFrame([], schema)
        table = self.spark.read.parquet(path)
        return check_schema(table, schema).select(*schema.names)

    def listings(self, trackers: list[str] | None = None) -> DataFrame:
        """The current listings; naming sources prunes to their buckets."""
        table = self._read("listings")
        if trackers:
            table = table.filter(F.col("bucket").isin(self._buckets_of(trackers)) & F.col("tracker").isin(trackers))
        return table.drop("bucket")

    def searches(self) -> DataFrame:
        return self._read("searches").drop("bucket")

    def _buckets_of(self, trackers: list[str]) -> list[int]:
        named = literal_table(self.spark, [(t,) for t in trackers], "tracker string")
        return sorted({r.b for r in named.select(self._bucket().alias("b")).collect()})

    def _part(self, name: str, touched: list[int]) -> DataFrame:
        return self._read(name).filter(F.col("bucket").isin(touched)).drop("bucket")

    # -- writing

    def _files(self, name: str, touched: list[int]) -> int:
        """How many files the touched buckets of a table hold."""
        folders = [self._fs(f"{self.root}/{name}/bucket={b}") for b in touched]
        return sum(len(fs.listStatus(p)) for fs, p in folders if fs.exists(p))

    def _replace(self, name: str, content: DataFrame, touched: list[int], order: list[str], pieces: float = math.inf) -> None:
        """Swap the touched buckets of a table for `content`; buckets left without rows disappear.

        pieces: how many files come of `content` at most if it is written where it lies. That is done if they are large enough; 0 for
        rows that only lost some of their number, which always are.
        """
        target, stage = f"{self.root}/{name}", f"{self.root}/.stage-{name}-{uuid.uuid4().hex}"
        bucketed = content.withColumn("bucket", self._bucket())
        # At most one row per touched bucket reaches the driver.
        counts = {r.bucket: r["count"] for r in bucketed.groupBy("bucket").count().collect()} if pieces else {}
        if pieces * LEAST_ROWS > sum(counts.values()):
            files = {b: -(-n // self.rows_per_file) for b, n in counts.items()}
            writers = F.element_at(F.create_map(*[F.lit(int(x)) for pair in files.items() for x in pair]), F.col("bucket")) if files else F.lit(1)
            spread = F.pmod(F.xxhash64("tracker", "identity"), writers)
            bucketed = bucketed.repartition(max(sum(files.values()), 1), "bucket", spread)
        with shuffles_dropped(bucketed.sparkSession):
            laid = bucketed.sortWithinPartitions("bucket", *order).write.option("maxRecordsPerFile", self.rows_per_file)
            laid.option("compression", "zstd").partitionBy("bucket").parquet(stage)
        filled = self._filled(stage)
        fs, root = self._fs(target)
        fs.mkdirs(root)
        for bucket in sorted({*touched, *filled}):
            self._remove(f"{target}/bucket={bucket}")
            if bucket in filled:
                fs.rename(self._fs(f"{stage}/bucket={bucket}")[1], self._fs(f"{target}/bucket={bucket}")[1])
        self._remove(stage)

    def _highest(self) -> int:
        """The highest id given so far, from a file of its own; the table is asked only where there is none."""
        path = f"{self.root}/highest"
        fs, p = self._fs(path)
        if fs.exists(p):
            return self.spark.read.schema("id bigint").parquet(path).agg(F.max("id")).first()[0] or 0
        return self._read("listings").agg(F.max("id")).first()[0] or 0

    def _record_highest(self, highest: int) -> None:
        """One row is added per merge that gave ids, before its rows appear: a crash leaves a gap, never a repeat."""
        self.spark.range(1).select(F.lit(highest).cast("bigint").alias("id")).coalesce(1).write.mode("append").parquet(f"{self.root}/highest")

    def merge(self, batch: DataFrame, seen_at: Column, search_key: str = "", order: tuple[str, ...] = ("page_id", "row_no")) -> int:
        """Upsert a batch of listings; later rows of a batch, by the long columns `order`, win.

        With a search key the rows become search-managed and their provenance is recorded.
        Returns how many rows were not stored before.
        """
        place = F.array(F.lit(1).cast("bigint"), *[F.col(c).cast("bigint") for c in order])
        arriving = ops.with_identity(
            batch.withColumns(
                {
                    "id": F.lit(None).cast("bigint"),
                    "last_seen": seen_at.cast("timestamp"),
                    "search_managed": F.lit(bool(search_key)),
                    "__order": place,
                }
            )
        )
        with Stage(self.spark, "merge") as stage:
            return self._merge(arriving, search_key, stage, order)

    def _merge(self, arriving: DataFrame, search_key: str, stage: Stage, order: tuple[str, ...]) -> int:
        stored_place = F.array(*[F.lit(0).cast("bigint")] * (len(order) + 1))
        have = set(arriving.columns)
        missing = {f.name: default_for(f).alias(f.name) for f in LISTING.fields if f.name not in have}
        # Columns that the batch does not carry are added when its rows are written, not moved with them.
        fresh = stage.keep(arriving.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LISTING.fields if f.name in have], "__order"))
        touched = [r.b for r in fresh.select(self._bucket().alias("b")).distinct().collect()]
        if not touched:
            return 0
        stored = self._part("listings", touched).withColumn("__order", stored_place)
        both = stored.unionByName(fresh.withColumns(missing))
        again = ops.seen_again(both, stage.keep)
        merged = stage.keep(ops.merge_rows(both if again is None else ops.held_by(both, again, True), ["__order"], id_col="id"))
        # A row without an id was sighted in this batch only.
        known, new = merged.filter("id IS NOT NULL"), merged.filter("id IS NULL").select(*fresh.columns)
        if again is not None:
            known = ops.held_by(stored, again, False).unionByName(known)
            new = ops.held_by(fresh, again, False).unionByName(new)
        highest = self._highest()
        new = ops.assign_ids(new, ["__order"], highest, stage.keep)
        added = new.count()
        if added:
            self._record_highest(highest + added)
        # A file of stored rows gives one at most, one of new rows one to each bucket.
        held = self._files("listings", touched) if again is not None else len(merged.inputFiles()) * len(touched)
        pieces = max(held + len(new.inputFiles()) * len(touched), 1)
        written = known.select(*COLUMNS).unionByName(new.withColumns(missing).select(*COLUMNS))
        self._replace("listings", written, touched, ["tracker", "published"], pieces)
        if search_key:
            produced = fresh.select("tracker", F.lit(search_key).alias("search_key"), "identity", "last_seen")
            bridge = stage.keep(ops.merge_searches(self._part("searches", touched), produced))
            self._replace("searches", bridge, touched, ["tracker", "search_key"], max(len(bridge.inputFiles()) * len(touched), 1))
        return added

    def _rewrite(self, listings: DataFrame, bridge: DataFrame, touched: list[int]) -> None:
        # Provenance first: a search row must not outlive its listing.
        self._replace("searches", bridge, touched, ["tracker", "search_key"])
        self._replace("listings", listings, touched, ["tracker", "published"], pieces=0)

    def prune(self, cutoff: Column) -> int:
        """Apply retention; only buckets that hold something expired are rewritten. Returns rows removed."""
        table, bridge = self._read("listings"), self._read("searches")
        gone = table.filter(ops.expired(cutoff)).groupBy("bucket").agg(F.count("*").alias("n")).collect()
        stale = bridge.filter(F.col("last_seen") < cutoff).select("bucket").distinct().collect()
        touched = sorted({r.bucket for r in gone} | {r.bucket for r in stale})
        if touched:
            self._rewrite(*ops.sweep(self._part("listings", touched), self._part("searches", touched), cutoff), touched)
        return sum(r.n for r in gone)

    def clear(self, tracker: str) -> int:
        """Drop one source with its provenance; returns rows removed."""
        touched = self._buckets_of([tracker])
        table = self._part("listings", touched)
        removed = table.filter(F.col("tracker") == tracker).count()
        if removed:
            self._rewrite(*ops.clear_source(table, self._part("searches", touched), tracker), touched)
        return removed
