"""The stored tables, rule files and streams: merges, sweeps, reloads, continuous jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gleanery import fixtures as fx
from gleanery.functions.chain import apply_chain
from gleanery.operators import search as s
from gleanery.plans import pacing, sql
from gleanery.plans.catalogue import CUT, CUTOFF
from gleanery.plans.registry import ORACLES, flag, joined, query
from gleanery.session import shared_path
from gleanery.sources import rules as rule_files
from gleanery.sources.store import ListingStore
from gleanery.streaming import gate, ingest

SEEN = datetime(2003, 1, 1)
STORED = """tracker, identity, name, size, coalesce(strftime(published, '%Y-%m-%d'), '') AS published,
  array_to_string(categories, ',') AS categories, {managed} AS search_managed"""


def _two_batches(spark, sf) -> ListingStore:
    """A store that got the older sightings unmanaged, then the newer ones for search 'later'."""
    store = ListingStore(spark, shared_path(spark, "store"), buckets=8)
    batch, order = fx.store_batch(fx.sightings(spark, sf))
    early = F.col("o_day") < F.unix_seconds(F.lit(CUTOFF))
    store.merge(batch.filter(early), F.lit(CUTOFF), "", order)
    store.merge(batch.filter(~early), F.lit(SEEN), "later", order)
    return store


def _stored(df):
    return df.select(
        "tracker", "identity", "name", "size", F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit("")).alias("published"),
        joined("categories").alias("categories"), flag("search_managed").alias("search_managed"),
    )


@query(
    "store_merge",
    f"""WITH {sql.LISTINGS}, late AS (SELECT DISTINCT tracker, identity FROM sightings WHERE last_seen - to_days(leechers) >= {CUT})
      SELECT {STORED.format(managed='(late.tracker IS NOT NULL)::INT')} FROM listings LEFT JOIN late USING (tracker, identity)""",
)
def store_merge(spark, sf):
    """Two batches merged into the bucketed store, read back."""
    return _stored(_two_batches(spark, sf).listings())


@query(
    "store_ids",
    f"""WITH {sql.LISTINGS}, late AS (SELECT DISTINCT tracker, identity FROM sightings WHERE last_seen - to_days(leechers) >= {CUT}),
      early AS (SELECT tracker, identity, max(seq) AS place FROM sightings WHERE last_seen - to_days(leechers) < {CUT} GROUP BY ALL),
      later AS (SELECT tracker, identity, max(seq) AS place FROM sightings WHERE last_seen - to_days(leechers) >= {CUT} GROUP BY ALL),
      placed AS (SELECT l.tracker, l.identity, e.tracker IS NULL AS second, coalesce(e.place, n.place) AS "at"
        FROM listings l LEFT JOIN early e USING (tracker, identity) LEFT JOIN later n ON n.tracker = l.tracker AND n.identity = l.identity)
      SELECT tracker, identity, row_number() OVER (ORDER BY second, "at") AS place, (SELECT count(*) FROM late) AS searched FROM placed""",
)
def store_ids(spark, sf):
    """Ids are dense and follow the order of arrival: the first batch's listings first, each batch in its own order."""
    store = _two_batches(spark, sf)
    searched = store.searches().agg(F.count("*")).scalar()
    return store.listings().select("tracker", "identity", F.col("id").alias("place"), searched.alias("searched"))


@query(
    "store_sweep",
    f"""WITH {sql.LISTINGS}, late AS (SELECT DISTINCT tracker, identity FROM sightings WHERE last_seen - to_days(leechers) >= {CUT})
      SELECT {STORED.format(managed='(late.tracker IS NOT NULL)::INT')} FROM listings LEFT JOIN late USING (tracker, identity)
      WHERE tracker != 'Supplier#000000003' AND (published >= TIMESTAMP '2000-01-01' OR (published IS NULL AND late.tracker IS NOT NULL))""",
)
def store_sweep(spark, sf):
    """Retention, then one source cleared, on the stored table."""
    store = _two_batches(spark, sf)
    store.prune(F.lit(datetime(2000, 1, 1)))
    store.clear("Supplier#000000003")
    return _stored(store.listings())


@query(
    "store_lookup",
    f"""WITH {sql.LISTINGS}, first AS (SELECT tracker, min(identity) AS identity FROM listings GROUP BY tracker ORDER BY tracker LIMIT 3)
      SELECT tracker, identity, name FROM listings JOIN first USING (tracker, identity)""",
)
def store_lookup(spark, sf):
    """One row by source and id, through the source's bucket, for three sources; another source's id finds nothing."""
    store = _two_batches(spark, sf)
    first = store.listings().groupBy("tracker").agg(F.min_by("id", "identity").alias("id")).orderBy("tracker").limit(3).collect()
    found = None
    for at, row in enumerate(first):
        mine = s.find(store.listings([row.tracker]), row.tracker, row.id)
        other = s.find(store.listings([row.tracker]), row.tracker, first[at - 1].id)
        both = mine if len(first) == 1 else mine.unionByName(other)
        found = both if found is None else found.unionByName(both)
    return found.select("tracker", "identity", "name")


# --- rule files ----------------------------------------------------------------------------


def _rule_files(spark, sf):
    """One YAML document per supplier, some broken, some under a shared id."""
    sup = fx.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    text = F.concat(
        F.lit("id: "), F.when(k % 9 == 0, F.lit("shared")).otherwise(F.concat(F.lit("s"), k.cast("string"))), F.lit("\nname: "), F.col("s_name").substr(1, 8),
        F.lit("\ntype: public\nlinks: [https://s"), k.cast("string"), F.lit(".invalid/]\nreplaces: [old"), k.cast("string"), F.lit("]\ncaps:\n  categories:\n    01: Movies/HD\n"),
        F.lit("  categorymappings:\n    - {id: "), F.col("s_nationkey").cast("string"), F.lit(", cat: TV/SD, desc: Series, default: true}\n"),
        F.lit("  modes: {search: [q], tv-search: [q, season]}\nsettings:\n  - {name: sort, type: select, default: "), F.col("s_nationkey").cast("string"),
        F.lit("}\nsearch:\n  path: old.php\n  paths:\n    - {path: new.php, categories: [01, 5]}\n  rows: {selector: tr}\n  fields:\n    title|append: {selector: a}\n    imdb: {selector: b}\n"),
    )
    broken = F.when(k % 7 == 3, F.concat(F.lit("id: [unclosed "), k.cast("string"))).otherwise(text)
    return sup.select(
        F.concat(F.lit("/rules/"), F.col("s_name"), F.lit(".yml")).alias("path"), F.length(broken).cast("bigint").alias("length"),
        F.lit(SEEN).cast("timestamp").alias("modificationTime"), F.encode(broken, "UTF-8").alias("content"),
    )


@query(
    "rule_tables",
    """WITH g AS (SELECT s_suppkey AS k, s_nationkey AS n, s_name FROM supplier WHERE s_suppkey % 7 != 3 AND (s_suppkey % 9 != 0
        OR (SELECT count(*) FROM supplier WHERE s_suppkey % 7 != 3 AND s_suppkey % 9 = 0) < 2))
      SELECT 's' || k AS source, '0:01=Movies/HD,1:' || n || '=TV/SD' AS mappings, 'new.php,old.php' AS paths, n::VARCHAR AS sort, 'title|append,imdb' AS fields FROM g""",
)
def rule_tables(spark, sf):
    """Rule documents to typed tables: legacy spellings folded in, order and verbatim ids kept."""
    usable, _ = rule_files.reject_duplicate_ids(rule_files.parse_rules(_rule_files(spark, sf)))

    def listed(df, order, text, out):
        return df.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda x: x["t"]), ",").alias(out))

    mappings = listed(rule_files.mappings_table(usable), "ordinal", F.concat(F.col("ordinal").cast("string"), F.lit(":"), F.col("cat_id"), F.lit("="), F.col("cat")), "mappings")
    paths = listed(rule_files.paths_table(usable), "path_ordinal", F.col("path"), "paths")
    fields = listed(rule_files.fields_table(usable), "ordinal", F.concat_ws("|", "name", "modifiers"), "fields")
    settings = rule_files.settings_table(usable).select("source", F.col("default").alias("sort"))
    return mappings.join(paths, "source").join(settings, "source").join(fields, "source")


@query(
    "rule_errors",
    """SELECT '/rules/' || s_name || '.yml' AS path, CASE WHEN s_suppkey % 7 = 3 THEN 'broken' ELSE 'duplicate' END AS error FROM supplier
      WHERE s_suppkey % 7 = 3 OR (s_suppkey % 9 = 0 AND (SELECT count(*) FROM supplier WHERE s_suppkey % 7 != 3 AND s_suppkey % 9 = 0) > 1)""",
)
def rule_errors(spark, sf):
    _, errors = rule_files.reject_duplicate_ids(rule_files.parse_rules(_rule_files(spark, sf)))
    return errors.select("path", F.when(F.col("error").startswith("duplicate"), "duplicate").otherwise("broken").alias("error"))


@query(
    "last_good_rules",
    """SELECT o_custkey::VARCHAR AS path, max(o_orderkey) AS version, arg_max(o_totalprice::VARCHAR, o_orderkey) FILTER (o_orderstatus != 'F') AS document,
      CASE WHEN arg_max(o_orderstatus, o_orderkey) = 'F' THEN 'bad' ELSE '' END AS error FROM orders GROUP BY o_custkey HAVING bool_or(o_orderstatus != 'F')""",
)
def last_good_rules(spark, sf):
    bad = F.col("o_orderstatus") == "F"
    versions = fx.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("version"), F.lit("x").alias("id"),
        F.when(~bad, F.col("o_totalprice").cast("string")).alias("document"), F.when(bad, F.lit("bad")).alias("error"),
    )
    out = rule_files.last_good(versions)
    return out.select("path", "version", "document", F.coalesce("error", F.lit("")).alias("error"))


@query(
    "changed_rules",
    """SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 13 = 0 THEN 'gone' WHEN o_orderkey % 10 = 0 THEN 'new' ELSE 'changed' END AS change FROM orders
      WHERE (o_orderkey % 13 = 0) != (o_orderkey % 10 = 0) OR (o_orderkey % 13 != 0 AND o_orderkey % 10 != 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0))""",
)
def changed_rules(spark, sf):
    o = fx.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    path, size, modified = k.cast("string").alias("path"), F.col("o_totalprice").cast("bigint"), F.col("o_orderdate").cast("timestamp")
    before = o.filter(k % 10 != 0).select(path, size.alias("size"), modified.alias("modified"))
    after = o.filter(k % 13 != 0).select(
        path, F.when(k % 7 == 0, size + 1).otherwise(size).alias("size"),
        F.when(k % 11 == 0, F.timestamp_add("DAY", F.lit(1), modified)).otherwise(modified).alias("modified"),
    )
    return rule_files.changed_files(before, after)


# --- streams -------------------------------------------------------------------------------


@query("stream_ingest", f"WITH {sql.LISTINGS} SELECT {STORED.format(managed='1')} FROM listings")
def stream_ingest(spark, sf):
    """Sightings arriving as a file stream, merged by foreachBatch; equals the batch merge."""
    root = shared_path(spark, "ingest")
    store = ListingStore(spark, f"{root}/store", buckets=8)
    batch, order = fx.store_batch(fx.sightings(spark, sf, lines=fx.stream(spark, sf, "lineitem")))
    ingest.ingest(batch, store, f"{root}/checkpoint", "stream", lambda _: SEEN, order).awaitTermination()
    return _stored(store.listings())


@query("stream_gate", ORACLES["request_gate"])
def stream_gate(spark, sf):
    """The repeat-search gate as keyed state over the event stream; equals the batch gate."""
    root = shared_path(spark, "gate")
    events = fx.stream(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"), F.lit(True).alias("ok"),
    )
    gated = gate.gate_stream(events, pacing.GATE_HOURS * 3600, idle_seconds=None)
    out = f"{root}/decisions"
    gated.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("request_id", flag("accepted").alias("accepted"))


@query("stream_pacing")
def stream_pacing(spark, sf):
    """Backoff and spacing as keyed state; no SQL counterpart and no loop to check it against yet."""
    root = shared_path(spark, "pacing")
    events = fx.stream(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "error").alias("ok"), F.col("value").alias("seconds"),
    )
    out = f"{root}/decisions"
    paced = gate.pace_stream(events, 3600, 5 * 3600, idle_seconds=None)
    paced.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("request_id", "source", "decision", "wait_ms")


@query(
    "trimmed_terms",
    """SELECT doc_id, length(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) AS chars FROM documents""",
)
def trimmed_terms(spark, sf):
    """White space collapsed by a rule chain over whole documents."""
    steps = [{"name": "re_replace", "args": ["[ \\t\\n\\r]+", " "]}, {"name": "trim"}]
    return fx.table(spark, sf, "documents").select("doc_id", F.length(apply_chain(F.col("text"), steps)).alias("chars"))
