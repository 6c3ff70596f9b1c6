"""Raw text to typed values: numbers, sizes, dates, filters, links, redaction."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from gleanery import fixtures as fx
from gleanery.functions import coerce, dates, redact, text as txt, urls
from gleanery.functions.chain import apply_chain, html_encode
from gleanery.operators import profile
from gleanery.plans import sql
from gleanery.plans.registry import flag, query, stamp

NOW = datetime(2002, 1, 15, 12, 30, 0)
NOW_SQL = "TIMESTAMP '2002-01-15 12:30:00'"


def _lines(spark, sf):
    return fx.spread(fx.table(spark, sf, "lineitem"))


def _grouped(c: Column) -> Column:
    return F.format_number(c.cast("bigint"), 0)


@query(
    "parse_sizes",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity::BIGINT * 1048576 AS mib,
        trunc(l_extendedprice * 1024)::BIGINT AS kb, trunc(l_extendedprice * 1024 * 1024 * 1024)::BIGINT AS cyrillic,
        l_orderkey AS raw, trunc(l_extendedprice)::BIGINT * 1024 * 1024 * 1024 * 1024 AS grouped, 0 AS unknown FROM lineitem""",
)
def parse_sizes(spark, sf):
    price = F.format_string("%.2f", "l_extendedprice")
    whole = _grouped(F.floor("l_extendedprice"))
    return _lines(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        coerce.parse_size(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" MiB"))).alias("mib"),
        coerce.parse_size(F.concat(F.lit("Size: "), F.translate(price, ".", ","), F.lit("KB"))).alias("kb"),
        coerce.parse_size(F.concat(F.lit("Размер: "), price, F.lit(" ГБ"))).alias("cyrillic"),
        coerce.parse_size(F.col("l_orderkey").cast("string")).alias("raw"),
        coerce.parse_size(F.concat(F.translate(whole, ",", "."), F.lit(",0 TB"))).alias("grouped"),
        coerce.parse_size(F.concat(price, F.lit(" furlongs"))).alias("unknown"),
    )


@query(
    "lenient_numbers",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_orderkey * 1000 AS grouped, floor(l_extendedprice)::BIGINT AS both,
      l_linenumber AS signed, CASE WHEN l_orderkey * 1000 < 5000000 THEN l_orderkey * 1000 ELSE 0 END AS peers,
      l_extendedprice AS number, l_discount AS discount, 0 AS none FROM lineitem""",
)
def lenient_numbers(spark, sf):
    price = F.format_string("%.2f", "l_extendedprice")
    key = F.col("l_orderkey").cast("string")
    return _lines(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        coerce.coerce_long(F.concat(key, F.lit(".000 peers"))).alias("grouped"),
        F.when(F.col("l_extendedprice") >= 1000, coerce.coerce_long(F.format_number("l_extendedprice", 2)))
        .otherwise(F.floor("l_extendedprice")).alias("both"),
        coerce.coerce_long(F.concat(F.lit("-"), F.col("l_linenumber").cast("string"))).alias("signed"),
        coerce.peer_count(F.concat(key, F.lit(",000"))).alias("peers"),
        coerce.coerce_double(F.concat(F.lit("$"), F.translate(price, ".", ","))).alias("number"),
        coerce.coerce_double(F.format_string("%.2f%%", "l_discount")).alias("discount"),
        coerce.coerce_long(F.lit("n/a")).alias("none"),
    )


@query(
    "factors_and_digits",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
      CASE WHEN l_linenumber % 3 = 0 THEN 1.0 ELSE l_tax END AS factor, l_partkey::VARCHAR AS digits,
      CASE WHEN l_returnflag = 'R' THEN l_suppkey::VARCHAR ELSE l_partkey::VARCHAR END AS first_id FROM lineitem""",
)
def factors_and_digits(spark, sf):
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    return _lines(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        coerce.factor(F.when(F.col("l_linenumber") % 3 == 0, F.lit("free")).otherwise(F.format_string("x%.2f", "l_tax"))).alias("factor"),
        coerce.digits(F.concat(F.lit("id/tt"), part, F.lit("?v=2"))).alias("digits"),
        coerce.first_non_empty(F.when(F.col("l_returnflag") == "R", supp).otherwise(""), part).alias("first_id"),
    )


@query(
    "genre_lists",
    """SELECT p_partkey, p_name.replace(' ', ', ') || CASE WHEN contains(p_name, lower(p_type)) THEN '' ELSE ', ' || lower(p_type) END || ', Sci Fi' AS genres FROM part""",
)
def genre_lists(spark, sf):
    raw = F.concat(F.col("p_name"), F.lit(" / "), F.lower("p_type"), F.lit(";["), F.regexp_extract("p_name", "^(\\S+)", 1), F.lit("] Sci_Fi"))
    return fx.table(spark, sf, "part").select("p_partkey", coerce.genres(raw).alias("genres"))


# --- dates ------------------------------------------------------------------------------

DATE_FORMATS = {
    "dmy": ("dd/MM/yyyy", "dd/MM/yyyy"),
    "named": ("d MMM yyyy 'at' HH:mm", "d MMM yyyy 'at' HH:mm"),
    "american": ("M/d/yy h:mm a", "M/d/yy h:mm tt"),
    "weekday": ("EEEE, MMMM dd yyyy", "dddd, MMMM dd yyyy"),
    "reference": ("MMM dd yyyy HH:mm:ss", "Jan 02 2006 15:04:05"),
    "zoned": ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", "yyyy-MM-ddTHH:mm:sszzz"),
}


@query(
    "declared_dates",
    f"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS dmy,
      strftime(o_orderdate + to_hours(o_orderkey % 24), '%Y-%m-%d %H:00:00') AS named,
      strftime(o_orderdate + to_hours(o_orderkey % 24), '%Y-%m-%d %H:00:00') AS american,
      strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS weekday,
      strftime(o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60), '%Y-%m-%d %H:%M:00') AS reference,
      strftime(o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:00') AS zoned,
      '2002-01-15 ' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':05:00' AS time_only,
      CASE WHEN strftime(o_orderdate, '%m-%d') = '02-29' THEN '2002-03-01' ELSE '2002-' || strftime(o_orderdate, '%m-%d') END || ' 00:00:00' AS no_year,
      CASE WHEN strftime(o_orderdate, '%m-%d') = '02-29' THEN '2001-03-01' WHEN strftime(o_orderdate, '%m-%d') <= '01-15'
        THEN '2002-' || strftime(o_orderdate, '%m-%d') ELSE '2001-' || strftime(o_orderdate, '%m-%d') END || ' 00:00:00' AS rolled_back,
      '' AS mismatch FROM orders""",
)
def declared_dates(spark, sf):
    """Order dates printed in many formats and read back by the declared format."""
    moment = F.timestamp_add("HOUR", F.col("o_orderkey") % 24, F.col("o_orderdate").cast("timestamp"))
    exact = F.timestamp_add("MINUTE", F.col("o_orderkey") % 60, moment)
    written = {"dmy": F.col("o_orderdate"), "named": moment, "american": moment, "weekday": F.col("o_orderdate"), "reference": exact, "zoned": exact}
    out = {}
    for name, (pattern, declared) in DATE_FORMATS.items():
        out[name] = dates.parse_declared(F.date_format(written[name], pattern), declared, NOW)
    out["time_only"] = dates.parse_declared(F.concat((F.col("o_orderkey") % 24).cast("string"), F.lit(":05")), "H:mm", NOW)
    out["no_year"] = dates.parse_declared(F.date_format("o_orderdate", "dd.MM"), "dd.MM", NOW)
    out["rolled_back"] = dates.parse_declared(F.date_format("o_orderdate", "MMM d"), "Jan 2", NOW)
    out["mismatch"] = dates.parse_declared(F.date_format("o_orderdate", "yyyy-MM-dd"), "dd/MM/yyyy", NOW)
    return fx.spread(fx.table(spark, sf, "orders")).select("o_orderkey", *[stamp(c).alias(n) for n, c in out.items()])


@query(
    "relative_dates",
    f"""SELECT event_id, strftime({NOW_SQL} - to_hours(user_id % 40) - to_minutes(event_id % 90), '%Y-%m-%d %H:%M:%S') AS pair,
      strftime({NOW_SQL} - to_days((event_id % 50)::INT * 30 + (user_id % 5)::INT * 365 + (user_id % 3)::INT * 7), '%Y-%m-%d %H:%M:%S') AS calendar,
      strftime({NOW_SQL} - to_seconds(((event_id % 8) * 2250)::INT), '%Y-%m-%d %H:%M:%S') AS fraction,
      '2002-01-15 12:30:00' AS just_now, '' AS unknown_unit FROM events""",
)
def relative_dates(spark, sf):
    n, u = F.col("event_id"), F.col("user_id")
    ago = {
        "pair": F.concat((u % 40).cast("string"), F.lit(" hours and "), (n % 90).cast("string"), F.lit(" mins ago")),
        "calendar": F.concat((n % 50).cast("string"), F.lit(" Months, "), (u % 5).cast("string"), F.lit("y "), (u % 3).cast("string"), F.lit(" weeks")),
        "fraction": F.concat(F.format_string("%.3f", (n % 8) * 0.625), F.lit(" hr")),
        "just_now": F.concat(n.cast("string"), F.lit(" known")),
        "unknown_unit": F.concat((n % 9).cast("string"), F.lit(" fortnights ago 2 days")),
    }
    return fx.spread(fx.table(spark, sf, "events")).select("event_id", *[stamp(dates.time_ago(c, NOW)).alias(k) for k, c in ago.items()])


@query(
    "unknown_dates",
    f"""UNPIVOT (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS epoch, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS iso,
      strftime(o_orderdate + INTERVAL 5 HOUR, '%Y-%m-%d %H:00:00') AS rfc, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS long_text,
      '2002-01-14 ' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':10:00' AS yesterday,
      strftime(TIMESTAMP '2002-01-15' - to_days(((1 - (o_orderkey % 7) + 14) % 7)::INT), '%Y-%m-%d 14:22:00') AS weekday,
      CASE WHEN strftime(o_orderdate, '%m-%d') = '02-29' THEN '' WHEN strftime(o_orderdate, '%m-%d') <= '01-15' THEN '2002-' || strftime(o_orderdate, '%m-%d') || ' 00:00:00'
        ELSE '2001-' || strftime(o_orderdate, '%m-%d') || ' 00:00:00' END AS no_year,
      '2002-01-15 ' || lpad((12 + o_orderkey % 12)::VARCHAR, 2, '0') || ':07:00' AS clock,
      strftime({NOW_SQL} - to_days((o_orderkey % 400)::INT), '%Y-%m-%d %H:%M:%S') AS ago, '' AS hopeless,
      strftime(o_orderdate + INTERVAL 3 HOUR, '%Y-%m-%d 03:00:00') AS year_last, strftime(o_orderdate, '%Y-%m-%d 12:00:00') AS short_year,
      strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS slashes, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d 00:00:00') AS month_only,
      strftime(o_orderdate, '%Y-%m-%d 10:20:30') AS abbreviation, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS padded_epoch,
      (5000 + o_orderkey % 4000)::VARCHAR || '-01-01 00:00:00' AS far_epoch,
      strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS dots, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS short_dots, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS named,
      strftime(o_orderdate, '%Y-%m-%d 00:12:00') AS offset_name, strftime(o_orderdate, '%Y-%m-%d 22:00:00') AS name_offset,
      strftime(o_orderdate, '%Y-%m-%d 14:14:20') AS digits_in_line, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS colons FROM orders)
      ON COLUMNS(* EXCLUDE o_orderkey) INTO NAME shape VALUE parsed""",
)
def unknown_dates(spark, sf):
    """Dates in no declared format, one row per shape."""
    d, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    names = F.array(*[F.lit(x) for x in ("Monday", "Tuesday", "WEDNESDAY", "Thursday", "friday", "Saturday", "Sunday")])
    shapes = {
        "epoch": F.unix_seconds(d).cast("string"),
        "iso": F.date_format(d, "yyyy-MM-dd"),
        "rfc": F.date_format(d, "EEE, dd MMM yyyy HH:mm:ss '-0500'"),
        "long_text": F.date_format(d, "  MMMM d,  yyyy "),
        "yesterday": F.concat(F.lit("Yesterday, at "), (k % 24).cast("string"), F.lit(":10")),
        "weekday": F.concat(F.get(names, (k % 7).cast("int")), F.lit(" at 2:22pm")),
        "no_year": F.date_format(d, "M-d"),
        "clock": F.concat(F.when(k % 12 == 0, F.lit("12")).otherwise((k % 12).cast("string")), F.lit(":07 PM")),
        "ago": F.concat((k % 400).cast("string"), F.lit(" days ago")),
        "hopeless": F.concat(F.lit("soon "), k.cast("string"), F.lit(" or never")),
        "year_last": F.date_format(d, "EEE MMM d 03:00:00 'UTC' yyyy"),
        "short_year": F.date_format(d, "d MMM yy '12:00 UTC'"),
        "slashes": F.date_format(d, "M/d/yy"),
        "month_only": F.date_format(d, "yyyy-MM"),
        "abbreviation": F.date_format(d, "yyyy-MM-dd '10:20:30 EST'"),
        "padded_epoch": F.lpad(F.unix_seconds(d).cast("string"), 20, "0"),
        "far_epoch": F.unix_seconds(F.make_timestamp((5000 + k % 4000).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).cast("string"),
        "dots": F.date_format(d, "M.d.yyyy"),
        "short_dots": F.date_format(d, "MM.dd.yy"),
        "named": F.date_format(d, "yyyy-MMM-dd"),
        "offset_name": F.date_format(d, "yyyy-MM-dd '00:12:00 +0000 GMT'"),
        "name_offset": F.date_format(d, "MMMM d, yyyy 'at 5:00pm UTC-05'"),
        "digits_in_line": F.date_format(d, "yyMMdd '14:14:20'"),
        "colons": F.date_format(d, "yyyy:MM:dd"),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("shape"), c.alias("text")) for n, c in shapes.items()])
    written = fx.spread(fx.table(spark, sf, "orders")).select("o_orderkey", F.inline(rows))
    return written.select("o_orderkey", "shape", stamp(dates.parse_unknown(F.col("text"), NOW)).alias("parsed"))


@query(
    "wall_clock_dates",
    """WITH seen AS (SELECT o_orderkey AS k, o_orderdate + to_hours(o_orderkey % 24) AS instant,
        CASE WHEN o_orderkey % 2 = 0 THEN 'America/New_York' ELSE 'Europe/Berlin' END AS zone FROM orders),
      here AS (SELECT *, timezone(zone, timezone('UTC', instant))::DATE AS day FROM seen)
    SELECT k AS o_orderkey, strftime(timezone('UTC', timezone(zone, day - 1 + to_hours(3 + k % 20) + INTERVAL 30 MINUTE)), '%Y-%m-%d %H:%M:%S') AS yesterday,
      strftime(timezone('UTC', timezone(zone, day + INTERVAL 735 MINUTE)), '%Y-%m-%d %H:%M:%S') AS today,
      strftime(timezone('UTC', timezone(zone, day - ((isodow(day) + 6 - k % 7) % 7)::INT + INTERVAL 862 MINUTE)), '%Y-%m-%d %H:%M:%S') AS weekday,
      strftime(instant - INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS elapsed FROM here""",
)
def wall_clock_dates(spark, sf):
    """Days and clocks as pages of two zones write them, on every order's date: a day back is a day of the calendar, also where
    a clock change makes it 23 or 25 hours long, while a day that has passed is always 24 hours."""
    k = F.col("o_orderkey")
    seen = F.timestamp_add("HOUR", k % 24, F.col("o_orderdate").cast("timestamp"))
    zone = F.when(k % 2 == 0, F.lit("America/New_York")).otherwise(F.lit("Europe/Berlin"))
    names = F.array(*[F.lit(x) for x in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")])
    written = {
        "yesterday": F.concat(F.lit("yesterday, "), (3 + k % 20).cast("string"), F.lit(":30")),
        "today": F.lit("Today at 12:15 PM"),
        "weekday": F.concat(F.get(names, (k % 7).cast("int")), F.lit(" at 14:22")),
    }
    rows = fx.spread(fx.table(spark, sf, "orders")).select("o_orderkey", seen.alias("seen"), zone.alias("zone"))
    here = F.from_utc_timestamp("seen", F.col("zone"))
    read = {n: F.to_utc_timestamp(dates.parse_unknown(c, here), F.col("zone")) for n, c in written.items()}
    read["elapsed"] = dates.time_ago(F.lit("24 hours ago"), F.col("seen"))
    return rows.select("o_orderkey", *[stamp(c).alias(n) for n, c in read.items()])


@query(
    "feed_dates",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Tue, 15 Jan 2002 12:30:00 +0000'
      ELSE strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S') || ' +0000' END AS pub_date, '2001' AS template_year FROM orders""",
)
def feed_dates(spark, sf):
    known = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate").cast("timestamp"))
    return fx.spread(fx.table(spark, sf, "orders")).select(
        "o_orderkey", dates.feed_date(known, NOW).alias("pub_date"), F.lit(dates.template_year(NOW)).alias("template_year")
    )


# --- filters ----------------------------------------------------------------------------


def _chain(c: Column, *steps) -> Column:
    return apply_chain(c, [{"name": name, "args": list(args)} for name, *args in steps], now=NOW)


@query(
    "filter_chain",
    r"""SELECT p_partkey, '<' || p_name || '>' AS wrapped, replace(p_name, 'o', '0') AS replaced,
      regexp_replace(p_name, '(\w+) (\w+)', '\2x-\1$', 'g') AS swapped, regexp_extract(p_brand, '#(\d+)', 1) AS number,
      '' AS no_group, split_part(p_name, ' ', 2) AS last_word, p_name AS out_of_range, upper(p_type) AS upper_type, lower(p_brand) AS lower_brand,
      reverse(p_name) AS reversed, trim(p_name, 's') AS trimmed, replace(p_brand, '#', '#') || '_' AS file_name, p_name AS skipped FROM part""",
)
def filter_chain(spark, sf):
    name, brand = F.col("p_name"), F.col("p_brand")
    return fx.table(spark, sf, "part").select(
        "p_partkey",
        _chain(name, ("append", ">"), ("prepend", "<")).alias("wrapped"),
        _chain(name, ("replace", "o", "0")).alias("replaced"),
        _chain(name, ("re_replace", r"(\w+) (\w+)", "$2x-${1}$$")).alias("swapped"),
        _chain(brand, ("regexp", r"#(\d+)")).alias("number"),
        _chain(brand, ("regexp", r"#\d+")).alias("no_group"),
        _chain(name, ("split", " ", -1)).alias("last_word"),
        _chain(name, ("split", " ", 9)).alias("out_of_range"),
        _chain(F.lower("p_type"), ("toupper",)).alias("upper_type"),
        _chain(brand, ("tolowercase",)).alias("lower_brand"),
        _chain(name, ("reverse",), ("strdump", "tag"), ("hexdump",)).alias("reversed"),
        _chain(name, ("trim", "sx")).alias("trimmed"),
        _chain(F.concat(brand, F.lit("?")), ("validfilename",)).alias("file_name"),
        _chain(name, ("nosuchfilter", 1), ("append",), ("re_replace", "(", "x"), ("replace", "a")).alias("skipped"),
    )


@query(
    "word_filters",
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[, /().;\[\]"|:]+'), lambda x: x != '') AS words FROM documents)
      SELECT doc_id, array_to_string(list_filter(['the', 'de', 'und', 'of', 'que', 'la'], lambda x: list_contains(words, x)), ',') AS accepted,
        '["the"' AS kept FROM w""",
)
def word_filters(spark, sf):
    """Accepted words in the order of the accepted list, over whole documents."""
    return fx.spread(fx.table(spark, sf, "documents")).select(
        "doc_id",
        _chain(F.col("text"), ("validate", "The, de", "und;of", "que la", "the")).alias("accepted"),
        _chain(F.lit('["the"'), ("jsonjoinarray", "$", ",")).alias("kept"),
    )


@query(
    "html_entities",
    r"""SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS encoded,
      md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS round_trip,
      length(list_aggregate(list_transform(string_split(html, ''), lambda c: CASE WHEN unicode(c) BETWEEN 160 AND 255 OR unicode(c) > 65535
        THEN '&#' || unicode(c) || ';' ELSE c END), 'string_agg', '')) AS numbered_length FROM pages""",
)
def html_entities(spark, sf):
    """Encode whole pages; decoding what was encoded gives the page back."""
    from gleanery.functions.codec import html_decode

    encoded = html_encode(F.col("html"))
    plain = F.col("html")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        plain = F.replace(plain, F.lit(char), F.lit(entity))
    markup = F.length(encoded) - (F.length(plain) - F.length("html"))
    return fx.table(spark, sf, "pages").select(
        "page_id",
        html_encode(F.col("url")).alias("encoded"),
        F.when(html_decode(encoded) == F.col("html"), F.md5(plain.cast("binary"))).alias("round_trip"),
        markup.alias("numbered_length"),
    )


@query(
    "diacritics",
    """SELECT doc_id, strip_accents(text) = text AS plain, length(strip_accents(text)) AS bare_length FROM documents""",
)
def diacritics(spark, sf):
    bare = _chain(F.col("text"), ("diacritics", "replace"))
    return fx.spread(fx.table(spark, sf, "documents")).select("doc_id", (bare == F.col("text")).alias("plain"), F.length(bare).alias("bare_length"))


@query(
    "url_parts",
    r"""SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref, '' AS missing,
      replace(replace(replace(replace(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D'), '&', '%26'), '#', '%23') AS encoded,
      url AS decoded, url || '%zz' AS malformed FROM pages""",
)
def url_parts(spark, sf):
    url = F.col("url")
    return fx.table(spark, sf, "pages").select(
        "page_id",
        _chain(url, ("querystring", "page")).alias("page"),
        urls.query_param(url, "ref").alias("ref"),
        _chain(url, ("querystring", "missing")).alias("missing"),
        _chain(url, ("urlencode",)).alias("encoded"),
        _chain(url, ("urlencode",), ("urldecode",)).alias("decoded"),
        _chain(F.concat(url, F.lit("%zz")), ("urldecode",)).alias("malformed"),
    )


@query(
    "resolve_links",
    r"""WITH b AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
        regexp_extract(url, '^[^?#]*(\?[^#]*)?', 1) AS q FROM pages)
      SELECT page_id, site || '/a/c%20d' AS rooted, site || regexp_replace(path, '[^/]*$', '') || 'x?y=1' AS relative,
        site || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') || 'up' AS parent, site || path || '?z' AS query_only,
        site || path || coalesce(q, '') || '#f' AS fragment, regexp_extract(url, '^(https?:)', 1) || '//cdn.invalid/i.png' AS other_host,
        'magnet:?xt=1' AS absolute, '' AS empty FROM b""",
)
def resolve_links(spark, sf):
    refs = {"rooted": "/a/./b/../c d", "relative": "x?y=1", "parent": "../up", "query_only": "?z", "fragment": "#f",
            "other_host": "//cdn.invalid/i.png", "absolute": "magnet:?xt=1", "empty": ""}
    return fx.table(spark, sf, "pages").select("page_id", *[urls.resolve_url(F.col("url"), F.lit(r)).alias(n) for n, r in refs.items()])


@query(
    "link_fields",
    f"""WITH {sql.SIGHTINGS}, t AS (SELECT tracker, identity, max(seq) AS seq, arg_max(infohash, seq) AS infohash, arg_max(name, seq) AS name,
        (arg_max(leechers, seq) % 2 = 0) AS public FROM sightings GROUP BY ALL)
      SELECT tracker, identity, CASE WHEN infohash != '' AND public THEN 'magnet:?xt=urn:btih:' || infohash || '&dn=' || replace(replace(name, '#', '%23'), ' ', '+')
          || '&tr=udp%3A%2F%2Ft.invalid%3A80' ELSE '' END AS minted, CASE WHEN infohash != '' THEN 'magnet:?dn=x&xt=urn:btmh:1220&xt=urn%3ABTIH%3A' || infohash ELSE '' END AS moved,
        infohash AS read_back, (length(infohash) = 40)::INT AS is_hash FROM t""",
)
def link_fields(spark, sf):
    """Magnets minted for public sources only, moved out of the download field, and read for their hash."""
    L = fx.listings(spark, sf)
    held = F.col("infohash") != ""
    given = F.when(held, F.concat(F.lit(" magnet:?dn=x&xt=urn:btmh:1220&xt=urn%3ABTIH%3A"), F.col("infohash"))).otherwise(F.lit(""))
    kind = F.when(F.col("leechers") % 2 == 0, F.lit(" Public")).otherwise(F.lit("private"))
    none = F.lit("")
    minted = coerce.link_fields(none, F.lit("not a magnet"), F.col("infohash"), F.col("name"), kind, ["udp://t.invalid:80"])
    moved = coerce.link_fields(given, none, none, F.col("name"), kind)
    return L.select(
        "tracker", "identity", minted["magnet"].alias("minted"), moved["magnet"].alias("moved"),
        moved["infohash"].alias("read_back"), flag(coerce.is_info_hash(F.col("infohash"))).alias("is_hash"),
    )


@query(
    "human_text",
    r"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_orderkey < 1024 THEN l_orderkey || ' B'
          WHEN l_orderkey < 1048576 THEN printf('%.2f KB', l_orderkey / 1024.0) ELSE printf('%.2f MB', l_orderkey / 1048576.0) END AS bytes,
      CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' WHEN s < 31536000 THEN s // 86400 || 'd'
          ELSE printf('%.1fy', s / 31536000.0) END AS duration,
      CASE WHEN l_tax = 0 THEN '0' ELSE l_tax::VARCHAR END AS factor
      FROM (SELECT *, l_orderkey * l_linenumber * l_linenumber * 97 AS s FROM lineitem)""",
)
def human_text(spark, sf):
    s = F.col("l_orderkey") * F.col("l_linenumber") * F.col("l_linenumber") * 97
    return _lines(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", txt.human_bytes(F.col("l_orderkey")).alias("bytes"),
        txt.human_duration(-s).alias("duration"), txt.number_text(F.col("l_tax")).alias("factor"),
    )


@query(
    "file_names",
    r"""SELECT doc_id, md5(CASE WHEN strlen(c) <= 150 THEN c ELSE rtrim(list_aggregate(list_filter(list_transform(range(1, 151),
        lambda i: CASE WHEN strlen(substr(c, 1, i)) <= 150 THEN substr(c, i, 1) END), lambda x: x IS NOT NULL), 'string_agg', ''), '. ') END || '.torrent') AS name
      FROM (SELECT doc_id, CASE WHEN c = '' THEN 'torrent' ELSE c END AS c FROM (SELECT doc_id,
        trim(trim(regexp_replace(text, '[^\p{L}\p{N} .,_+()\[\]-]', '_', 'g')), '.') AS c FROM documents))""",
)
def file_names(spark, sf):
    """A document's whole text as a title: cleaned, cut to 150 bytes at a character boundary."""
    return fx.spread(fx.table(spark, sf, "documents")).select("doc_id", F.md5(txt.torrent_filename(F.col("text")).cast("binary")).alias("name"))


# --- redaction and profiles ---------------------------------------------------------------

TOKENS_SQL = r"list_filter(regexp_extract_all({c}, '[A-Za-z0-9]{{16,}}'), lambda t: regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Za-z]'))"


@query(
    "redact_tokens",
    f"""SELECT doc_id, md5(list_reduce(list_prepend(text, list_sort(list_distinct({TOKENS_SQL.format(c='text')}), 'DESC')),
      lambda a, t: regexp_replace(a, '(^|[^A-Za-z0-9])' || t || '($|[^A-Za-z0-9])', '\\1…\\2', 'g'))) AS redacted FROM documents""",
)
def redact_tokens(spark, sf):
    return fx.spread(fx.table(spark, sf, "documents")).select("doc_id", F.md5(redact.redact_tokens(F.col("text")).cast("binary")).alias("redacted"))


@query(
    "redaction_report",
    f"""WITH d AS (SELECT source, len({TOKENS_SQL.format(c='text')}) AS t, len({TOKENS_SQL.format(c="lang || text || source")}) AS u FROM documents)
      SELECT source, 'text' AS "column", count(*) FILTER (t > 0) AS rows, sum(t)::BIGINT AS tokens FROM d GROUP BY source
      UNION ALL SELECT source, 'joined', count(*) FILTER (u > 0), sum(u)::BIGINT FROM d GROUP BY source""",
)
def redaction_report(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumn("joined", F.concat("lang", "text", "source"))
    return profile.redaction_report(docs, ["text", "joined"], ["source"])


@query(
    "redact_urls",
    r"""SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN url LIKE '%?%' THEN ' (query redacted)' ELSE '' END
        || CASE WHEN url LIKE '%#_%' THEN ' (fragment redacted)' ELSE '' END AS plain,
      'ftp://h.invalid/…/x (query redacted)' || CASE WHEN url LIKE '%#_%' THEN ' (fragment redacted)' ELSE '' END AS secret,
      'GET "' || regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN url LIKE '%?%' THEN ' (query redacted)' ELSE '' END
        || CASE WHEN url LIKE '%#_%' THEN ' (fragment redacted)' ELSE '' END || '": timeout with (query redacted)' AS message FROM pages""",
)
def redact_urls(spark, sf):
    url = F.col("url")
    secret = F.concat(F.lit("ftp://me:pw@h.invalid/"), F.md5(url.cast("binary")), F.lit("a1/x?k="), url)
    message = F.concat(F.lit('GET "'), url, F.lit('": timeout with passkey='), F.col("page_id").cast("string"))
    queries = F.array(F.concat(F.lit("passkey="), F.col("page_id").cast("string")), F.lit("plain"))
    return fx.table(spark, sf, "pages").select(
        "page_id", redact.redact_url(url).alias("plain"), redact.redact_url(secret).alias("secret"),
        redact.redact_message(message, queries).alias("message"),
    )


@query(
    "redact_paths",
    r"""SELECT page_id, '/t/…/{{ .Q }}?a=…&b={{ .Config.key }}&…#…' AS redacted FROM pages""",
)
def redact_paths(spark, sf):
    n = F.col("page_id").cast("string")
    path = F.concat(
        F.lit("/t/"), F.md5(F.col("url").cast("binary")), F.lit("a1/{{ .Q }}?a="), n, F.lit("&b={{ .Config.key }}&bare"), n, F.lit("#frag"), n
    )
    return fx.table(spark, sf, "pages").select("page_id", redact.redact_path(path).alias("redacted"))


@query(
    "char_profile",
    """WITH c AS (SELECT doc_id, unicode(c) AS code_point, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY ALL)
      SELECT code_point, sum(n)::BIGINT AS occurrences, count(*) AS values FROM c WHERE code_point BETWEEN 0 AND 31 OR code_point BETWEEN 127 AND 160
        OR code_point IN (173, 5760, 6158, 12288, 65279) OR code_point BETWEEN 8192 AND 8207 OR code_point BETWEEN 8232 AND 8239 OR code_point BETWEEN 8287 AND 8292
      GROUP BY code_point""",
)
def char_profile(spark, sf):
    return profile.char_profile(fx.spread(fx.table(spark, sf, "documents")), "text")
