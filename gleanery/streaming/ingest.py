"""Continuous ingest, retention sweeps and rule reloads."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators import extract, taxonomy
from gleanery.schema import PAGES
from gleanery.session import shared_path
from gleanery.sources import pages as page_source, rules as rule_files
from gleanery.sources.store import ListingStore

DEFAULT_RETENTION_DAYS = 30
SWEEP_INTERVAL = timedelta(hours=1)


def _utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def ingest(
    listings: DataFrame,
    store: ListingStore,
    checkpoint: str,
    search_key: str = "",
    seen_at: Callable[[int], datetime] | None = None,
    order: tuple[str, ...] = ("page_id", "row_no"),
    once: bool = True,
) -> StreamingQuery:
    """Merge every micro-batch of listings into the store as it arrives.

    The merge is idempotent for a batch that is replayed after a failure: the same rows
    win again, and ids already given stay.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        moment = seen_at(epoch) if seen_at else _utc_now()
        store.merge(batch, F.lit(moment), search_key, order)

    writer = listings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_pages(
    pages: DataFrame,
    store: ListingStore,
    rules_dir: str,
    checkpoint: str,
    now: Callable[[], datetime] = _utc_now,
    on_errors: Callable[[DataFrame, int], None] | None = None,
    once: bool = True,
    overrides_dir: str | None = None,
    max_bytes: int = page_source.MAX_BODY,
) -> StreamingQuery:
    """Guard, decode, extract, type and merge captured pages; rules and settings are read again for each micro-batch.

    A batch is staged by source, so that a source's rules open its own pages only however many sources there are.
    What fails costs itself alone: a page over the size cap or in an unknown charset, a source whose
    rule file is broken, missing, or does not compile. All of it is reported to `on_errors` as (page_id, source, url,
    error), once the store has the batch; a batch replayed after a failure starts again from its pages.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        moment = now()
        ready = page_source.with_format(batch)
        if "raw" in batch.columns:
            ready = page_source.decode_body(ready)
        else:
            ready = ready.withColumn("error", F.lit(None).cast("string"))
        about = ["page_id", "source", "url", "error"]
        kept, rejects = page_source.split_oversize(ready, max_bytes)
        broken = ready.filter("error IS NOT NULL").select(*about)
        stage = shared_path(spark, "pages")
        fields = [f for f in PAGES.fields if f.name != "source"]
        kept.filter("error IS NULL").select(*[f.name for f in fields], "source").write.partitionBy("source").parquet(stage)
        staged = spark.read.schema(T.StructType([*fields, PAGES["source"]])).parquet(stage)
        usable, _ = rule_files.reject_duplicate_ids(rule_files.read_rules(spark, rules_dir), f"{stage}-rules")
        definitions = rule_files.definitions(usable)
        configs: dict[str, dict[str, str]] = {}
        for row in rule_files.read_overrides(spark, overrides_dir).collect() if overrides_dir else []:  # configuration
            configs.setdefault(row.source, {})[row.name] = row.value
        extracted, failed = extract.extract_each(staged, definitions, moment, configs)
        known = {d["id"] for d in definitions}
        failed += [(r.source, "no usable rules") for r in staged.select("source").distinct().collect() if r.source not in known]
        try:
            errors = broken.union(rejects.select(*about))
            if failed:
                why = F.create_map(*[F.lit(x) for pair in failed for x in pair])
                hit = F.try_element_at(why, F.col("source"))
                errors = errors.union(staged.withColumn("error", hit).filter("error IS NOT NULL").select(*about))
            if extracted is not None:
                extracted = extracted.persist()
                errors = errors.union(extract.page_errors(extracted).select(*about))
                listed = extract.to_listings(
                    extract.kept_rows(extracted),
                    rule_files.sources_table(usable),
                    rule_files.mappings_table(usable),
                    taxonomy.taxonomy(spark),
                    moment,
                )
                store.merge(listed, F.lit(moment))
            if on_errors is not None:
                on_errors(errors, epoch)
        finally:
            if extracted is not None:
                extracted.unpersist()
            for folder in (stage, f"{stage}-rules"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    writer = pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def sweep(store: ListingStore, now: datetime, retention_days: int = DEFAULT_RETENTION_DAYS) -> int:
    """One retention sweep, to be scheduled at start and every SWEEP_INTERVAL; zero days disables it.

    A plain batch rather than a watermark: release dates may be arbitrarily old.
    """
    if retention_days <= 0:
        return 0
    return store.prune(F.lit(now - timedelta(days=retention_days)))
