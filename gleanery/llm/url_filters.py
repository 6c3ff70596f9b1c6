"""URL filters: host-suffix and path-prefix expressions met by short hash, confirmed by full digest.

A rule is (host, path, verdict). It fits a URL whose host is the rule's or a subdomain of it and whose
path starts with the rule's. The longest fitting rule (host plus path) wins; between equal ones `block` does.

Every URL is expanded into the expressions that a rule could equal: the last n labels of its host with the
first m characters of its path, for each shape (n, m) that occurs among the rules. Expressions meet rules in
an equi-join on the first four bytes of their SHA-256; the whole digest is compared afterwards. The shapes
are few however many rules there are (labels of a host times lengths of a path), and only shapes cross the driver.

Defined cases: a null URL or one without `://` has an empty host and path and fits no rule. A rule with a
null part is ignored, as is an empty host. An empty rule table leaves every URL to the default verdict.
Repeated rows stay repeated rows; extra columns are not read unless named in `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.llm.common import LOWER, UPPER, ascii_lower, table

#: The rules of the query (fixed values).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL, both empty where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    part = lambda group: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group), F.lit(""))
    return ascii_lower(part(1)), part(2)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = (), default: str = "allow") -> DataFrame:
    """One row per row of `urls`: the columns in `keep`, then host, path, rule and verdict."""
    known = (
        rules.select(ascii_lower(F.col("host")).alias("_rh"), F.col("path").alias("_rp"), F.col("verdict").alias("_rv"))
        .where((F.col("_rh") != "") & F.col("_rp").isNotNull() & F.col("_rv").isNotNull())
        .groupBy("_rh", "_rp")
        .agg(F.max("_rv").alias("_rv"))
    )
    shapes = known.select(F.size(F.split("_rh", r"\.")).alias("n"), F.length("_rp").alias("m")).distinct().collect()
    host, path = url_parts(F.col(f"`{url}`"))
    rows = urls.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep") if keep else F.lit(0).alias("_keep"), host.alias("_h"), path.alias("_p"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    if shapes:
        table_of = F.array(*[F.struct(F.lit(s.n).alias("n"), F.lit(s.m).alias("m")) for s in sorted(shapes)])
        labels = F.size(F.split("_h", r"\."))
        fit = F.filter(table_of, lambda s: (s.n <= labels) & (s.m <= F.length("_p")) & (F.col("_h") != ""))
        # Only the expression travels; the row's host and path stay beside it for the grouping.
        wide = rows.withColumn("_s", F.explode_outer(fit))
        parts = F.expr("substring_index(_h, '.', -_s.n)"), F.expr("left(_p, _s.m)")
        wide = wide.withColumn("_digest", F.when(F.col("_s").isNotNull(), _digest(*parts)))
        index = known.select(_digest(F.col("_rh"), F.col("_rp")).alias("_rd"), "_rh", "_rp", "_rv").withColumn("_short", F.substring("_rd", 1, 8))
        hit = F.col("_rd") == F.col("_digest")
        size = F.length("_rh") + F.length("_rp")
        best = F.max(F.when(hit, F.struct(size.alias("n"), F.concat("_rh", "_rp").alias("rule"), F.col("_rv").alias("verdict"))))
        rows = (
            wide.withColumn("_short", F.substring("_digest", 1, 8))
            .join(index, "_short", "left")
            .groupBy("_row", "_keep", "_h", "_p")
            .agg(best.alias("_best"))
        )
    else:
        rows = rows.withColumn("_best", F.lit(None).cast("struct<n:int,rule:string,verdict:string>"))
    return rows.select(
        *[F.col("_keep")[c].alias(c) for c in keep],
        F.col("_h").alias("host"),
        F.col("_p").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"),
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL under the rules above; pages no rule fits are allowed."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages"), rules, keep=("page_id",))


OP9_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM cut
)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'allow'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'block'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'allow'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""
