from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gleanery.operators import search as s
from gleanery.schema import LISTING, SchemaMismatch, check_schema
from gleanery.session import shared_root
from gleanery.sources.store import ListingStore

T0, T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)
ROW = "page_id bigint, row_no bigint, tracker string, name string, published timestamp, categories array<int>, infohash string, details_url string, size bigint"


def batch(spark, *rows):
    data = [(0, i, r.get("tracker", "alpha"), r["name"], r.get("published"), r.get("categories", [2000]), r.get("infohash", ""), r.get("details_url", ""), r.get("size", 1)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ROW)


def names(df):
    return [r.name for r in df.collect()]


@pytest.fixture()
def store(spark, tmp_path):
    return ListingStore(spark, str(tmp_path / "store"), buckets=4)


def test_merge_identity_dates_and_ids(spark, store):
    first = [dict(name="A", infohash="AB", published=T0), dict(name="B", details_url="u"), dict(name="C"), dict(name="C", size=5)]
    assert store.merge(batch(spark, *first), F.lit(T0)) == 3
    before = {r.identity: r.id for r in store.listings().collect()}
    assert store.merge(batch(spark, dict(name="A2", infohash="ab"), dict(name="B", details_url="v")), F.lit(T1), "key") == 1
    rows = {r.identity: r for r in store.listings().collect()}
    assert set(rows) == {"btih:ab", "url:u", "title:C", "url:v"}
    assert rows["btih:ab"].name == "A2" and rows["btih:ab"].published == T0 and rows["btih:ab"].search_managed
    assert rows["title:C"].size == 5 and not rows["title:C"].search_managed
    assert all(rows[k].id == i for k, i in before.items()) and rows["url:v"].id > max(before.values())
    assert {r.identity for r in store.searches().collect()} == {"btih:ab", "url:v"}
    found = s.find(store.listings(), "alpha", rows["url:v"].id)
    assert names(found) == ["B"] and names(s.find(store.listings(), "beta", rows["url:v"].id)) == []


def test_search_contract(spark, store):
    store.merge(batch(spark, dict(name="Sample Unmanaged", published=T0), dict(name="Тест 50%_x", published=T1, tracker="beta", categories=[]),
                      dict(name="Undated", categories=[5000, 100011])), F.lit(T0))
    store.merge(batch(spark, dict(name="Sample For First", published=T2)), F.lit(T1), "first")

    def run(**q):
        page, total = s.search(store.listings(), s.Query(**q), store.searches())
        return names(page), total.first().total

    assert run(limit=2) == (["Sample For First", "Тест 50%_x"], 4)
    assert run(limit=2, offset=9) == ([], 4)
    assert run(limit=0)[0] == []
    assert run()[0][-1] == "Undated"
    assert run(terms=["SAMPLE", "first"])[0] == ["Sample For First"]
    assert run(terms=["ТЕСТ", "%_"])[0] == ["Тест 50%_x"]
    assert run(categories=["100011"])[0] == ["Тест 50%_x", "Undated"]
    assert run(categories=["11"], needs_category=True)[0] == []
    assert run(trackers=["beta", "gone"])[0] == ["Тест 50%_x"]
    assert run(query_key="first", terms=["sample"])[0] == ["Sample For First", "Sample Unmanaged"]
    assert run(query_key="other", terms=["sample"])[0] == ["Sample Unmanaged"]
    assert run(terms=["sample"], unsearched_terms=["unmanaged"])[0] == ["Sample For First", "Sample Unmanaged"]


def test_prune_and_clear(spark, store):
    store.merge(batch(spark, dict(name="old", published=T0), dict(name="new", published=T2), dict(name="undated")), F.lit(T0), "k")
    store.merge(batch(spark, dict(name="late undated", tracker="beta")), F.lit(T2), "k")
    assert store.prune(F.lit(T1)) == 2
    assert sorted(names(store.listings())) == ["late undated", "new"]
    assert {r.tracker for r in store.searches().collect()} == {"beta"}
    assert store.clear("beta") == 1 and store.clear("beta") == 0
    assert names(store.listings()) == ["new"] and store.searches().count() == 0


def test_schema_contract(spark):
    with pytest.raises(SchemaMismatch, match="missing columns: .*magnet"):
        check_schema(spark.range(1).withColumn("name", F.lit("x")), LISTING)


def test_batch_search_equals_single_searches(spark, store):
    rows = [dict(name=f"{a} {b} {i % 3}", tracker=f"t{i % 2}", categories=[[], [2000], [5000, 2040]][i % 3], details_url=str(i), published=datetime(2024, 1, 1 + i % 20) if i % 5 else None)
            for i, (a, b) in enumerate((a, b) for a in ("Hot", "cold", "ab") for b in ("rod", "Plate", "zz%") for _ in range(4))]
    store.merge(batch(spark, *rows), F.lit(T0))
    listings = store.listings()
    asked = [(["hot"], [], [], False), (["PLATE", "o"], ["2040"], [], False), ([], ["2000"], ["t1"], True), ([], [], [], False), (["zz%", "c"], [], ["t0"], False), (["nothing"], [], [], False), (["b"], [], [], True)]
    requests = spark.createDataFrame([(i, *q, 4, i % 3) for i, q in enumerate(asked)],
                                     "request_id int, terms array<string>, categories array<string>, trackers array<string>, needs_category boolean, limit int, offset int")
    got = s.search_many(requests, listings).collect()
    for i, (terms, categories, trackers, needs) in enumerate(asked):
        page, total = s.search(listings, s.Query(terms=terms, categories=categories, trackers=trackers, needs_category=needs, limit=4, offset=i % 3))
        want = [(n, r.identity, total.first().total) for n, r in enumerate(page.collect(), start=1)]
        assert sorted((r.rank, r.identity, r.total) for r in got if r.request_id == i) == want


def test_batch_search_by_ids_meets_rows_by_the_id(spark):
    """Ids count only without terms, so searches by terms that differ in ids are one; the others equal single searches."""
    ids = [("12", ""), ("12", "7"), ("", "7"), ("9", "7"), ("", ""), ("012", "8")]
    rows = [(f"t{i % 2}", f"k{i}", f"name {i % 3}", datetime(2024, 1, 1 + i % 9) if i % 4 else None, i, [[], [2000]][i % 2], i % 5 == 0, *ids[i % 6]) for i in range(60)]
    listings = spark.createDataFrame(rows, "tracker string, identity string, name string, published timestamp, id int, categories array<int>, search_managed boolean, imdbid string, tvdbid string")
    bridge = listings.where("id % 10 = 0").select("tracker", "identity", F.lit("key").alias("search_key"))
    one, both = {"imdbid": "tt0012"}, {"imdbid": "tt12", "tvdbid": "7"}
    asked = [([], ["t0", "t1"], one, [], ""), ([], ["t1"], both, [], ""), ([], [], both, ["name 1"], "key"), ([], [], {"tvdbid": ""}, [], ""), (["name"], ["t0"], one, [], ""), (["name"], ["t0"], both, [], "")]
    requests = spark.createDataFrame([(i, t, [], w, False, m, u, k, 7, i) for i, (t, w, m, u, k) in enumerate(asked)],
                                     "request_id int, terms array<string>, categories array<string>, trackers array<string>, needs_category boolean, ids map<string,string>, unsearched_terms array<string>, query_key string, limit int, offset int")
    assert s._canonical(requests.where("request_id > 3"), ["imdbid", "tvdbid"]).select("search").distinct().count() == 1
    got = s.search_many(requests, listings, bridge=bridge).collect()
    for i, (terms, trackers, named, unsearched, key) in enumerate(asked):
        page, total = s.search(listings, s.Query(terms=terms, trackers=trackers, ids=named, unsearched_terms=unsearched, query_key=key, limit=7, offset=i), bridge)
        want = [(n, r.identity, total.first().total) for n, r in enumerate(page.collect(), start=1)]
        assert want and sorted((r.rank, r.identity, r.total) for r in got if r.request_id == i) == want


def test_a_hot_source_is_written_by_many_tasks(spark, tmp_path):
    store = ListingStore(spark, str(tmp_path / "hot"), buckets=4, rows_per_file=10)
    store.merge(batch(spark, *[dict(name=f"n{i}", tracker="hot") for i in range(95)], dict(name="other", tracker="cold")), F.lit(T0))
    files = sorted((tmp_path / "hot" / "listings").glob("bucket=*/*.parquet"))
    assert len(files) >= 5 and store.listings().count() == 96
    assert sorted(r.id for r in store.listings().collect()) == list(range(1, 97))
    store.merge(batch(spark, dict(name="late", tracker="cold")), F.lit(T1))
    assert {r.name: r.id for r in store.listings(["cold"]).collect()}["late"] == 97


def test_deep_pages_equal_a_whole_sort(spark, monkeypatch):
    """Ties, nulls, texts alike in their first bytes, structs and odd numbers; cells of sixteen values a pass."""
    import math
    import random

    monkeypatch.setattr(s, "SHALLOW", 5)
    monkeypatch.setattr(s, "CELL_BITS", 4)
    rng = random.Random(4)
    texts = [None, "", "a", "a\0", "same beginning 1", "same beginning 2", "same beginning 22", "é", "z" * 30]
    floats = [None, 0.5, -1e300, 1e300, math.inf, -math.inf, math.nan, 3.0]
    rows = [(i, rng.choice(texts), rng.choice([None, T0, T1]), rng.choice(floats), rng.choice([-(2**63), 2**63 - 1, 0, 5]), (rng.choice([None, 1, 2]), str(i % 3))) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, t string, d timestamp, f double, n long, st struct<a:int,b:string>").coalesce(1).cache()
    for order in ([("d", True), ("i", True)], [("t", True), ("n", False), ("i", False)], [("f", False), ("st", True), ("i", False)]):
        whole = [r.i for r in df.orderBy(*s.by_order(order)).collect()]
        for offset, limit in ((57, 40), (199, 6), (399, 1), (400, 5)):
            assert [r.i for r in s.page(df, limit, offset, order).collect()] == whole[offset : offset + limit], (order, offset)
    df.unpersist()


def test_deep_pages_sort_few_rows(spark, monkeypatch):
    monkeypatch.setattr(s, "SHALLOW", 50)
    df = spark.range(20_000).select((F.col("id") % 7).alias("g"), F.expr("if(id % 3 = 0, NULL, timestamp_seconds(id * 37 % 9001))").alias("published"), "id")
    parts, before = s._near(df, 15_000, 15_020, 20_000, s._fields(df, s.NEWEST))
    assert sum(p.count() for p in parts) <= 20 + 2 * 50 and 14_900 <= before <= 15_000


def test_deep_pages_by_clock_times(spark, monkeypatch):
    """Times without a zone order as they read, also where the session's zone skips or repeats an hour, and before 1970."""
    monkeypatch.setattr(s, "SHALLOW", 5)
    monkeypatch.setattr(s, "CELL_BITS", 4)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        clock = "if(id % 17 = 0, NULL, timestamp_ntz'2001-10-28 00:00:00.5' + make_dt_interval(if(id % 5 = 0, -20000, 0), 0, id * 37 % 300, 0.000001))"
        df = spark.range(400).selectExpr(f"{clock} AS d", "id").withColumn("st", F.struct("d", "id"))
        for order in ([("d", True), ("id", False)], [("st", False)]):
            whole = [r.id for r in df.orderBy(*s.by_order(order)).collect()]
            for offset, limit in ((57, 40), (199, 6), (399, 1)):
                assert [r.id for r in s.page(df, limit, offset, order).collect()] == whole[offset : offset + limit], (order, offset)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_merge_leaves_nothing_but_its_tables(spark, tmp_path):
    """What a merge and a sweep keep while they work is gone when they end, and no checkpoint is written."""
    shared = shared_root(spark)
    held = lambda: sorted(p.name for p in Path(shared).glob("gleanery/*")) + sorted(str(p) for p in Path(shared).glob("gleanery/rdd/*/rdd-*"))
    store, before = ListingStore(spark, str(tmp_path / "lean"), buckets=4), held()
    assert store.merge(batch(spark, dict(name="a"), dict(name="b", tracker="other")), F.lit(T0), "key") == 2
    assert store.merge(batch(spark, dict(name="a"), dict(name="c")), F.lit(T1)) == 1
    assert held() == before and not list((tmp_path / "lean").glob(".stage*"))


def test_a_merge_moves_only_rows_met_again(spark, tmp_path, monkeypatch):
    """Stored rows that no row of the batch meets, and rows met by none, are not merged; the table is the same as if all were."""
    from gleanery.operators import listings as ops
    from gleanery.sources import store as module

    first = [dict(name=f"n{i}", tracker=f"t{i % 3}", published=T0 if i % 2 else None) for i in range(30)] + [dict(name="twice"), dict(name="twice", size=7)]
    then = [dict(name="n4", tracker="t1", size=9), dict(name="n0", tracker="other"), dict(name="new", tracker="t0"), dict(name="new", tracker="t0", size=3)]
    merge_rows, found = ops.merge_rows, []
    for few, least in ((ops.FEW, module.LEAST_ROWS), (ops.FEW, 0), (0, 0)):
        met = []
        monkeypatch.setattr(ops, "FEW", few)
        monkeypatch.setattr(module, "LEAST_ROWS", least)
        monkeypatch.setattr(ops, "merge_rows", lambda df, *a, **k: met.append(df.count()) or merge_rows(df, *a, **k))
        store = ListingStore(spark, str(tmp_path / f"{few}-{least}"), buckets=4)
        assert store.merge(batch(spark, *first), F.lit(T0)) == 31 and store.merge(batch(spark, *then), F.lit(T1), "key") == 2
        assert met == ([2, 4] if few else [32, 35])
        found.append((sorted(store.listings().collect(), key=lambda r: r.id), sorted(store.searches().collect())))
    assert found[0] == found[1] == found[2] and [r.id for r in found[0][0]] == list(range(1, 34))
    assert {r.name: r.size for r in found[0][0] if r.tracker in ("t0", "alpha")}["new"] == 3


def test_shuffles_of_a_written_step_are_gone(spark, tmp_path):
    import glob
    import tempfile
    import time

    from gleanery.session import write_step

    files = lambda: set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data"))
    before, step = files(), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    write_step(step, str(tmp_path / "step"))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert sorted(step.collect()) == sorted(spark.read.parquet(str(tmp_path / "step")).collect())


def test_the_catalogue_moves_only_listings_sighted_again(spark, sf_dir, monkeypatch):
    """Of all sightings only those that share a listing are merged; the rows are those of a merge of all."""
    from gleanery import fixtures as fx
    from gleanery.operators import listings as ops

    merge_rows, met, found = ops.merge_rows, [], []
    for few in (ops.FEW, 0):
        monkeypatch.setattr(fx, "_CATALOGUES", {})
        monkeypatch.setattr(ops, "FEW", few)
        monkeypatch.setattr(ops, "merge_rows", lambda df, *a, **k: met.append(df.count()) or merge_rows(df, *a, **k))
        rows = fx.listings(spark, sf_dir)
        found.append(sorted(rows.select(F.to_json(F.struct(*sorted(rows.columns)))).toPandas().iloc[:, 0]))
    everything = fx.table(spark, sf_dir, "lineitem").count()
    assert found[0] == found[1] and 0 < met[0] < everything == met[1]


def test_batch_search_moves_a_row_once(spark, monkeypatch):
    """What the order, the answer and the name share is dealt once, and the order's own columns are not stored."""
    rows = [("t0", f"k{i}", f"Name {i % 3}", datetime(2024, 1, 1 + i % 9), i, [2000]) for i in range(30)]
    listings = spark.createDataFrame(rows, "tracker string, identity string, name string, published timestamp, id int, categories array<int>")
    requests = spark.createDataFrame([(1, ["name 1"], [], [], False, 4, 2)], "request_id int, terms array<string>, categories array<string>, trackers array<string>, needs_category boolean, limit int, offset int")
    placed, seen = s._placed, []

    def watched(*args):
        found = placed(*args)
        seen.append((args[0].columns, found.columns))
        return found

    monkeypatch.setattr(s, "_placed", watched)
    got = sorted((r["rank"], r.identity, r.total) for r in s.search_many(requests, listings).collect())
    page, _ = s.search(listings, s.Query(terms=["name 1"], limit=4, offset=2))
    assert got == [(n, r.identity, 10) for n, r in enumerate(page.collect(), start=1)]
    (dealt, stored), = seen
    assert sorted(dealt) == ["_id", "_identity", "_name", "_published", "cats", "managed", "tracker"]
    assert sorted(stored) == ["cats", "cell", "folded", "managed", "place", "row", "tracker"]
