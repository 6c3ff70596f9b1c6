from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleanery.functions import coerce, dates, redact, text, urls
from gleanery.functions.chain import apply_chain
from gleanery.functions.templates import TemplateEnv, template_col

NOW = datetime(2024, 3, 20, 15, 0, 0)


def test_sizes(evaluate):
    table = {
        "1.5 GB": 1610612736, "700 MB": 734003200, "1,5 GiB": 1610612736, "1.018,29 MB": 1067754455, "12": 12, "Size: 2 kb!": 2048,
        "Размер: 1.5 ГБ": 1610612736, "3 parsecs": 0, "": 0, "GB": 0, "1.2.3 KB": 12595,
    }
    assert evaluate(list(table), coerce.parse_size) == list(table.values())


def test_counts_and_factors(evaluate):
    longs = {"1,234": 1234, "1.234": 1234, "1,234.5": 1234, "-7": 7, "": 0, "n/a": 0, "99999999999999999999": 0, ".,": 0}
    assert evaluate(list(longs), coerce.coerce_long) == list(longs.values())
    assert evaluate(["4999999", "5000000", "12 seeders"], coerce.peer_count) == [4999999, 0, 12]
    assert evaluate(["0,5", "1.234,5", "x", "."], coerce.coerce_double) == [0.5, 1234.5, 0.0, 0.0]
    assert evaluate(["0", "free", "0,5", ""], coerce.factor) == [0.0, 1.0, 0.5, 1.0]
    assert evaluate(["tt0012x34", "none"], coerce.digits) == ["0012", ""]
    assert evaluate(["Drama, Sci_Fi/Drama (new)"], coerce.genres) == ["Drama, Sci Fi, new"]


def test_magnet_hash(evaluate):
    digest = "A" * 40
    got = evaluate([f"magnet:?xt=urn:btmh:12&xt=urn%3Abtih%3A{digest}&dn=x", "magnet:?xt=urn:btih:short", "magnet:?dn=1"], coerce.magnet_info_hash)
    assert got == [digest, "", ""]


@pytest.mark.parametrize(
    "value, fmt, want",
    [
        ("15/03/2024", "dd/MM/yyyy", datetime(2024, 3, 15)),
        ("5/3/24", "d/M/y", datetime(2024, 3, 5)),
        ("Mar 5 2024  7:05 pm", "MMM d yyyy h:mm tt", datetime(2024, 3, 5, 19, 5)),
        ("7:05 A", "h:mm t", datetime(2024, 3, 20, 7, 5)),
        ("2024-03-05 07:05 +5", "yyyy-MM-dd HH:mm z", datetime(2024, 3, 5, 2, 5)),
        ("Mar 25", "Jan 2", datetime(2023, 3, 25)),
        ("25 March", "d MMMM", datetime(2024, 3, 25)),
        ("2024-02-30", "yyyy-MM-dd", None),
        ("Tue, 05 Mar 2024", "ddd, dd MMM yyyy", datetime(2024, 3, 5)),
        ("2024-03-05T07:05:09.250Z", "yyyy-MM-ddTHH:mm:ss.fffK", datetime(2024, 3, 5, 7, 5, 9, 250000)),
    ],
)
def test_declared_dates(evaluate, value, fmt, want):
    assert evaluate([value], lambda c: dates.parse_declared(c, fmt, NOW)) == [want]


def test_roles_of_numbers_in_dates(evaluate):
    """Month first but behind a year; names and offsets of zones in either order; signs and words of no date."""
    table = {
        "3.31.2014": datetime(2014, 3, 31), "08.21.71": datetime(1971, 8, 21), "3.1.2014": datetime(2014, 3, 1), "2013-Feb-03": datetime(2013, 2, 3),
        "2015-02-18 00:12:00 +0000 GMT": datetime(2015, 2, 18, 0, 12), "September 17, 2012 at 5:00pm UTC-05": datetime(2012, 9, 17, 22),
        "171113 14:14:20": datetime(2017, 11, 13, 14, 14, 20), "2014:03:31": datetime(2014, 3, 31), "Mon, 2 Jan 2006 15:04:05 -0700 (MST)": datetime(2006, 1, 2, 22, 4, 5),
        "2006-01-02T15:04:05.5Z": datetime(2006, 1, 2, 15, 4, 5, 500_000), "12 Feb 06": datetime(2006, 2, 12), "Feb 31, 2006": None, "13.13.2014": None,
        "Marchy 3 2014": None, "3/31/2014 25:00": None, "1 of 2 for 2014": None,
    }
    assert evaluate(list(table), lambda c: dates.parse_unknown(c, NOW)) == list(table.values())


def test_unknown_dates(evaluate):
    table = {
        "1710000000": datetime(2024, 3, 9, 16, 0),
        "unknown": NOW,
        "1 day 2 hours ago": datetime(2024, 3, 19, 13, 0),
        "Today 09:10": datetime(2024, 3, 20, 9, 10),
        "yesterday, at 3:30pm": datetime(2024, 3, 19, 15, 30),
        "Saturday at 14:22": datetime(2024, 3, 16, 14, 22),
        "3-25": datetime(2023, 3, 25),
        "25 Mar 10:30": datetime(2023, 3, 25, 10, 30),
        "7:05pm": datetime(2024, 3, 20, 19, 5),
        "2024-03-05 07:05": datetime(2024, 3, 5, 7, 5),
        "Fri, 15 Mar 2024 12:00:00 +0200": datetime(2024, 3, 15, 10, 0),
        "15 Mar 2024": datetime(2024, 3, 15),
        "Fri Mar 15 12:00:00 2024": datetime(2024, 3, 15, 12, 0),
        "15 Mar 24 12:00 UTC": datetime(2024, 3, 15, 12, 0),
        "3/15/24": datetime(2024, 3, 15),
        "2024-03": datetime(2024, 3, 1),
        "2024-03-15 12:00:00 EST": datetime(2024, 3, 15, 12, 0),
        "00001710526200": datetime(2024, 3, 15, 18, 10),
        "99999999999999999999": None,
        "total nonsense": None,
        "--": None,
        "soon": None,
        "": None,
    }
    assert evaluate(list(table), lambda c: dates.parse_unknown(c, NOW)) == list(table.values())


def test_unknown_dates_work_out_names_once(spark):
    """The month and the numbers' roles are read once a value: the plan of one date holds no copies of them for every use."""
    read = spark.range(1).select(dates.parse_unknown(F.col("id").cast("string"), NOW))
    plan = read._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_position") < 20 and plan.count("aggregate(") < 5


def test_unknown_dates_cost_no_more_than_they_hold(spark, evaluate):
    """White space is collapsed only where it is uneven, whole words are read once, and a day alone reads no time of day."""
    read = spark.range(1).select(dates.parse_unknown(F.col("id").cast("string"), NOW))
    plan = read._jdf.queryExecution().analyzed().toString()
    assert "[^ -~]|  " in plan
    known = {"mar 3, 2014": True, "3rd of sept. 2014": True, "thurs 3/4/14": True, "marchy 3": False, "3 ma 2014": False, "xmar 3": False, "3 mar; 2014": False, "3mar2014": True}
    rows = evaluate(list(known), lambda c: c.rlike(dates._PLAIN))
    assert rows == list(known.values())
    odd = {"\u00a015\u2003Mar  2024 ": datetime(2024, 3, 15), "2024-03-15\t10:20": datetime(2024, 3, 15, 10, 20), "3/15/24": datetime(2024, 3, 15), "2024-02-30": None}
    assert evaluate(list(odd), lambda c: dates.parse_unknown(c, NOW)) == list(odd.values())


def test_clock_readings_survive_dst_transitions(spark, evaluate):
    """A time of day is built from its parts: 03:30 stays 03:30 on the day that has no 02:30."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        shown = lambda now: lambda c: dates.parse_unknown(c, now).cast("string")
        assert evaluate(["Yesterday at 03:30"], shown(datetime(2024, 3, 11, 12, 0))) == ["2024-03-10 03:30:00"]
        assert evaluate(["Sunday at 03:30"], shown(datetime(2024, 3, 16, 12, 0))) == ["2024-03-10 03:30:00"]
        assert evaluate(["01:30"], shown(datetime(2024, 11, 3, 12, 0))) == ["2024-11-03 01:30:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_json_scalars(spark):
    from gleanery.functions import jsonpath

    table = {
        "[[1,2],[3]]": "1,2,3", "[[[1],[2,[3,[4]]]],[]]": "1,2,3,4,", "1e-20": "0.00000000000000000001", "1e40": "1" + "0" * 40, "12345": "12345",
        "-1.5e-7": "-0.00000015", '[true,null,"a,b\\"c",0.5]': 'True,,a,b"c,0.5', '[{"a":1},[2,[3]]]': '{"a":1},2,3', "null": "", "[]": "", "false": "False",
    }
    df = spark.createDataFrame([(i, v) for i, v in enumerate(table)], "i int, v string").select("i", jsonpath.scalar_text(F.parse_json("v")).alias("t"))
    assert [r.t for r in df.orderBy("i").collect()] == list(table.values())


def chain(*steps):
    return lambda c: apply_chain(c, [{"name": n, "args": list(a)} for n, *a in steps], now=NOW)


def test_filters(evaluate):
    assert evaluate(["a-b-c"], chain(("split", "-", -1))) == ["c"]
    assert evaluate(["a-b"], chain(("split", "-", 5))) == ["a-b"]
    assert evaluate(["xay"], chain(("re_replace", "(a)", "$1x$&$$"))) == ["xaxa$y"]
    assert evaluate(["ab"], chain(("re_replace", "(", "x"), ("append", "!"))) == ["ab!"]
    assert evaluate(["Ünï"], chain(("diacritics", "replace"))) == ["Uni"]
    assert evaluate(["a&amp;b &eacute;"], chain(("htmldecode",))) == ["a&b é"]
    assert evaluate(['{"a": {"b": ["x", 1.0, true]}}', "oops"], chain(("jsonjoinarray", "$.a.b", "|"))) == ["x|1|True", "oops"]
    assert evaluate(["Drama Action"], chain(("validate", "Action, comedy,DRAMA"))) == ["action,drama"]
    assert evaluate(["a b(c)~"], chain(("urlencode",))) == ["a+b(c)%7E"]
    assert evaluate(["a%2Bb+c", "50%"], chain(("urldecode",))) == ["a+b c", "50%"]
    assert evaluate(["привет"], lambda c: apply_chain(c, [{"name": "urlencode", "args": []}], charset="windows-1251")) == ["%EF%F0%E8%E2%E5%F2"]


def test_templates(spark):
    env = TemplateEnv(config={"sort": "new"}, result={"a": F.lit("x")}, keywords="hot rod", categories=F.array(F.lit("1"), F.lit("2")), now=datetime(2024, 1, 5))

    def render(text):
        value = template_col(text, env)
        return value if value is None or isinstance(value, str) else spark.range(1).select(value.alias("v")).first().v

    assert render("{{ .Config.sort }}/{{ .Today.Year }}") == "new/2023"
    assert render('{{ if eq .Result.a "x" }}yes{{ else }}no{{ end }}') == "yes"
    assert render("{{ range .Categories }}c[]={{.}}&{{ end }}") == "c[]=1&c[]=2&"
    assert render('{{ join .Categories "," }} {{ re_replace .Keywords "o" "0" }}') == "1,2 h0t r0d"
    assert render("{{ .Result.never }}") is None
    assert render('{{ if .Config.sort }}{{ .Result.a }}{{ end }}') == "x"


def test_urls(evaluate):
    base = F.lit("https://h.invalid/a/b.php?x=1")
    table = {"c d": "https://h.invalid/a/c%20d", "../é": "https://h.invalid/%C3%A9", "?q": "https://h.invalid/a/b.php?q", "%zz": "%zz", "magnet:?x": "magnet:?x"}
    assert evaluate(list(table), lambda c: urls.resolve_url(base, c)) == list(table.values())
    assert evaluate(["http://h/?a=1&b=x%20y#f", "b=2"], lambda c: urls.query_param(c, "b")) == ["x y", "2"]


def test_redaction(evaluate):
    assert evaluate(["key abcdef0123456789 kept abcdefghijklmnopqrst"], redact.redact_tokens) == ["key … kept abcdefghijklmnopqrst"]
    assert evaluate(["https://u:p@h.invalid/x?k=1#f"], redact.redact_url) == ["https://h.invalid/x (query redacted) (fragment redacted)"]
    assert evaluate(["/p?a=1&{{ .K }}=2&flag"], redact.redact_path) == ["/p?a=…&{{ .K }}=…&…"]


def test_human_text(evaluate):
    assert evaluate(["1023", "1152", "1048576"], lambda c: text.human_bytes(c.cast("bigint"))) == ["1023 B", "1.12 KB", "1.00 MB"]
    assert evaluate(["..a/b:c..", "..", "é" * 100], text.torrent_filename) == ["a_b_c.torrent", "torrent.torrent", "é" * 75 + ".torrent"]


def test_human_years_round_the_exact_value(evaluate):
    """Ties of the written number are no ties of the double behind it, but for quarters and halves."""
    seconds = [31_536_000, *[31_536_000 // 20 * n for n in (21, 23, 25, 27, 35, 39, 41, 199, 10_001)], 31_536_000 * 2 - 1]
    assert evaluate([str(-s) for s in seconds], lambda c: text.human_duration(c.cast("bigint"))) == [f"{s / 31_536_000:.1f}y" for s in seconds]
    sizes = [1024, 1029, 1152, 1047_552, 1048_575, 3 * 1024**3 + 7, 2**63 - 1]
    units = {1: "KB", 2: "MB", 3: "GB", 6: "EB"}
    power = [1, 1, 1, 1, 1, 3, 6]
    assert evaluate([str(n) for n in sizes], lambda c: text.human_bytes(c.cast("bigint"))) == [f"{n / 1024**p:.2f} {units[p]}" for n, p in zip(sizes, power)]


def _planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_letters_of_a_size_are_picked_out_once(spark):
    sizes = spark.createDataFrame([("1.5 GB",), ("2 furlongs",), ("Размер: 3 МБ",), (None,), ("7",)], "t string")
    got = sizes.select(coerce.parse_size(F.col("t")).alias("s"))
    assert [r.s for r in got.collect()] == [1610612736, 0, 3145728, 0, 7]
    assert _planned(got).count("\\p{L}") == 1


def test_a_path_is_resolved_once(spark):
    refs = spark.createDataFrame([("../a b",), ("/x/./y",), ("?q=1",), ("",), (None,)], "r string")
    got = refs.select(urls.resolve_url(F.lit("https://s.invalid/d/e/f"), F.col("r")).alias("u"))
    assert [r.u for r in got.collect()] == ["https://s.invalid/d/a%20b", "https://s.invalid/x/y", "https://s.invalid/d/e/f?q=1", "", ""]
    assert _planned(got).count("url_encode") + _planned(got).count("UrlCodec, encode") <= 2
    assert _planned(got).count("[^:/?#]+") <= 10
