"""Written results and feeds."""

from pyspark.sql import functions as F

from gleanery.sources import feeds


def test_written_files_are_compressed_and_whole(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("a title "), "id").alias("Title"), F.lit(None).cast("int").alias("Files"))
    feeds.write_results(rows, str(tmp_path / "results"))
    parts = [p.name for p in (tmp_path / "results").glob("part-*")]
    assert parts and all(p.endswith(".gz") for p in parts)
    back = spark.read.schema("Title string, Files int").json(str(tmp_path / "results"))
    assert back.count() == 500 and back.exceptAll(rows).isEmpty()
    item = F.array(F.struct(F.concat(F.lit("t"), "id").alias("title")))
    channels = spark.range(20).select(F.col("id").cast("string").alias("request_id"), F.struct(F.col("id").alias("_total")).alias("response"), item.alias("item"))
    feeds.write_feed(channels, str(tmp_path / "feeds"))
    assert all(p.name.endswith(".gz") for p in (tmp_path / "feeds").glob("part-*"))
    schema = "_request string, response struct<_total:bigint>, item array<struct<title:string>>"
    read = spark.read.format("xml").option("rowTag", "channel").option("attributePrefix", "_").schema(schema).load(str(tmp_path / "feeds"))
    assert sorted((r._request, r.response._total, r.item[0].title) for r in read.collect()) == sorted((str(i), i, f"t{i}") for i in range(20))


def test_rule_files_are_parsed_once_and_spread(spark):
    """Documents that arrive in one split are parsed in many tasks, and not again for each table made of them."""
    from gleanery.sources import rules

    files = spark.range(6).coalesce(1).selectExpr(
        "concat('/r/', id, '.yml') AS path", "1L AS length", "timestamp '2024-01-01 00:00:00' AS modificationTime",
        "cast(CASE WHEN id = 5 THEN 'a: [' WHEN id < 2 THEN 'id: same' ELSE concat('id: s', id) END AS binary) AS content",
    )
    parsed = rules.parse_rules(files)
    assert parsed.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    usable, errors = rules.reject_duplicate_ids(parsed)
    for df in (usable, errors):
        assert "MapInPandas" not in df._jdf.queryExecution().toString()
    assert sorted(r.id for r in usable.collect()) == ["s2", "s3", "s4"]
    assert sorted(r.path for r in errors.collect()) == ["/r/0.yml", "/r/1.yml", "/r/5.yml"]
