"""Search requests: normalising parameters, episode text, interactive queries, keys and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions.coerce import SPACE, trim_space
from gleanery.operators.search import FEED_DEFAULT, FEED_MAX

# Request field -> the parameter names it is read from, first non-empty wins.
FIELDS = {
    "album": ["album"],
    "artist": ["artist"],
    "author": ["author"],
    "doubanid": ["doubanid"],
    "ep": ["ep"],
    "extended": ["extended"],
    "genre": ["genre"],
    "imdbid": ["imdbid"],
    "label": ["label"],
    "publisher": ["publisher"],
    "query": ["q", "query"],
    "season": ["season"],
    "tmdbid": ["tmdbid"],
    "tvdbid": ["tvdbid"],
    "tvmazeid": ["tvmazeid"],
    "tvrageid": ["rid", "rageid"],
    "title": ["title"],
    "track": ["track"],
    "traktid": ["traktid"],
    "year": ["year"],
}

# Spellings of the search types.
SEARCH_TYPES = {
    "tvsearch": ["tvsearch", "tv-search"],
    "movie": ["movie", "moviesearch", "movie-search"],
    "music": ["music", "musicsearch", "music-search", "audio", "audiosearch", "audio-search"],
    "book": ["book", "booksearch", "book-search"],
    "search": [""],
}

INTEGER = "^[+-]?[0-9]+$"


def as_integer(c: Column, kind: str = "bigint") -> Column:
    """A strictly written whole number, NULL for anything else (blanks included)."""
    return F.when(c.rlike(INTEGER), c.try_cast(kind))


def canonical_type(c: Column) -> Column:
    return reduce(
        lambda rest, item: F.when(c.isin(*item[1]), F.lit(item[0])).otherwise(rest), SEARCH_TYPES.items(), c
    )


def normalize_requests(
    raw: DataFrame, params: str = "params", default_limit: int = FEED_DEFAULT, max_limit: int = FEED_MAX
) -> DataFrame:
    """Turn a map<string, array<string>> of submitted parameters into typed request columns.

    Names ignore case and a trailing []; a value that is missing is ''.
    """
    entries = F.transform(
        F.map_entries(params),
        lambda e: F.struct(F.lower(F.regexp_replace(e["key"], r"\[\]$", "")).alias("name"), e["value"].alias("vals")),
    )
    nothing = F.array().cast("array<string>")

    def values(*names: str) -> Column:
        return F.coalesce(F.concat(*[named(n) for n in names]), nothing)

    def named(name: str) -> Column:
        return F.flatten(F.transform(F.filter("__e", lambda e: e["name"] == name), lambda e: e["vals"]))

    def first(*names: str) -> Column:
        return F.coalesce(F.get(F.filter(values(*names), lambda v: v != ""), 0), F.lit(""))

    def count(name: str, fallback: int) -> Column:
        n = as_integer(first(name))
        return F.when(n > 0, n).otherwise(F.lit(fallback))

    parts = F.flatten(F.transform(values("cat", "category"), lambda v: F.split(v, ",")))
    listed = F.filter(F.transform(parts, trim_space), lambda p: p != "")
    categories = F.transform(listed, lambda c: F.coalesce(as_integer(c).cast("string"), c))
    return raw.withColumn("__e", entries).select(
        *[c for c in raw.columns if c != params],
        categories.alias("categories"),
        F.least(count("limit", default_limit), F.lit(max_limit)).cast("int").alias("limit"),
        count("offset", 0).cast("bigint").alias("offset"),
        canonical_type(first("t")).alias("type"),
        *[first(*names).alias(name) for name, names in FIELDS.items()],
    )


def season(c: Column) -> Column:
    """A season as a plain number; zero or less is none; other text passes through."""
    n = as_integer(c)
    return F.when(n.isNull(), c).when(n <= 0, F.lit("")).otherwise(n.cast("string"))


def _padded(c: Column) -> Column:
    n = as_integer(c)
    return F.when(n.between(0, 99), F.lpad(n.cast("string"), 2, "0")).otherwise(c)


def episode(season_col: Column, ep: Column) -> Column:
    """S01E02, S01, or the air date of a daily show; '' without a season."""
    s = season(season_col)
    daily = s.rlike("^[0-9]{4}$") & ep.rlike("^[0-9]{2}/[0-9]{2}$")
    aired = F.try_make_timestamp(
        F.when(daily, s.try_cast("int")),
        F.substring(ep, 1, 2).try_cast("int"),
        F.substring(ep, 4, 2).try_cast("int"),
        F.lit(0), F.lit(0), F.lit(0),
    )
    number = F.concat(F.lit("S"), _padded(s))
    return (
        F.when(s == "", F.lit(""))
        .when(aired.isNotNull(), F.date_format(aired, "yyyy.MM.dd"))
        .when(ep == "", number)
        .otherwise(F.concat(number, F.lit("E"), _padded(ep)))
    )


def keywords() -> Column:
    """The text a source is asked for: query, artist, album, track, author, title, episode."""
    text = F.col("query")
    for name in ("artist", "album", "track", "author", "title"):
        text = F.when(F.col(name) != "", trim_space(F.concat(text, F.lit(" "), F.col(name)))).otherwise(text)
    return trim_space(F.concat(text, F.lit(" "), episode(F.col("season"), F.col("ep"))))


def search_terms() -> Column:
    """Words every matching name must hold."""
    fields = ("query", "artist", "album", "track", "author", "title")
    words = F.split(F.concat_ws(" ", *[F.col(c) for c in fields]), f"[{SPACE}]+")
    return F.filter(words, lambda w: w != "")


# The quotes read as an apostrophe, and the signs a search keeps beside letters, digits and spaces.
QUOTES = "`´‘’"
KEPT_SIGNS = r"\-._()@/'\[\]+%"


def sanitize(c: Column) -> Column:
    """Request text with dashes and quotes unified and all signs dropped that no search looks for."""
    c = F.translate(F.regexp_replace(c, r"\p{Pd}+", "-"), QUOTES, "'" * len(QUOTES))
    return F.regexp_replace(c, rf"[^\p{{L}}\p{{Nd}}{SPACE}{KEPT_SIGNS}]", "")


def imdb_query(c: Column) -> Column:
    """tt0000000 form when the query is an IMDb id, else ''."""
    term = sanitize(c)
    number = F.regexp_extract(term, r"^tt([0-9]{1,8})$", 1).try_cast("int")
    width = F.greatest(F.length(number.cast("string")), F.lit(7))
    return F.when(number > 0, F.concat(F.lit("tt"), F.lpad(number.cast("string"), width, "0"))).otherwise(F.lit(""))


_WORD_START = r"(?<![\p{L}\p{Nd}\p{Mn}\p{Pc}\u200c\u200d])"
SEASON_EPISODE = rf"{_WORD_START}S([0-9]{{2,4}})E([0-9]{{2,4}}[A-Za-z]?)\z"
EPISODE_ONLY = rf"{_WORD_START}E([0-9]{{2,4}}[A-Za-z]?)\z"
SEASON_ONLY = rf"{_WORD_START}S([0-9]{{2,4}})\z"


def parse_interactive(requests: DataFrame) -> DataFrame:
    """Move a trailing SxxEyy / Eyy / Sxx out of the query text, and read an IMDb id typed as the query.

    `episode_terms` keeps the moved text for rows no search produced, unless the request
    named a season or episode separately. The type becomes plain search.
    """

    def cut(text: Column, pattern: str) -> Column:
        return trim_space(F.regexp_replace(text, pattern, ""))

    def tail(text: Column, rest: Column) -> Column:
        return trim_space(F.substr(text, F.length(rest) + 1))

    def no_zeros(c: Column) -> Column:
        return F.ltrim(c, F.lit("0"))

    def number(c: Column) -> Column:
        return c.try_cast("int").cast("string")

    q = requests.withColumn("__q", trim_space(F.col("query")))
    both = F.col("__q").rlike(SEASON_EPISODE)
    q = q.withColumn("__both", both)
    q = q.withColumn("__rest1", F.when(F.col("__both"), cut(F.col("__q"), SEASON_EPISODE)).otherwise(cut(F.col("__q"), EPISODE_ONLY)))
    q = q.withColumn("__has_ep", F.col("__both") | F.col("__q").rlike(EPISODE_ONLY))
    q = q.withColumn("__has_season2", ~F.col("__both") & F.col("__rest1").rlike(SEASON_ONLY))
    q = q.withColumn("__rest2", F.when(F.col("__has_season2"), cut(F.col("__rest1"), SEASON_ONLY)).otherwise(F.col("__rest1")))
    new_ep = (
        F.when(F.col("__both"), no_zeros(F.regexp_extract("__q", SEASON_EPISODE, 2)))
        .when(F.col("__has_ep"), no_zeros(F.regexp_extract("__q", EPISODE_ONLY, 1)))
        .otherwise(F.col("ep"))
    )
    new_season = (
        F.when(F.col("__both"), number(F.regexp_extract("__q", SEASON_EPISODE, 1)))
        .when(F.col("__has_season2"), number(F.regexp_extract("__rest1", SEASON_ONLY, 1)))
        .otherwise(F.col("season"))
    )
    q = q.withColumn("ep", new_ep).withColumn("season", new_season)
    season_written = F.col("__both") | F.col("__has_season2")
    named_apart = ((season(F.col("season")) != "") & ~season_written) | ((F.col("ep") != "") & ~F.col("__has_ep"))
    written = F.array_compact(
        F.array(
            F.when(F.col("__has_ep"), tail(F.col("__q"), F.col("__rest1"))),
            F.when(F.col("__has_season2"), tail(F.col("__rest1"), F.col("__rest2"))),
        )
    )
    q = q.withColumn("episode_terms", F.when(named_apart, F.array().cast("array<string>")).otherwise(written))
    q = q.withColumn("__imdb", imdb_query(F.col("__rest2")))
    is_id = F.col("__imdb") != ""
    kept = {"ep", "season"}
    projected = []
    for name in requests.columns:
        if name == "query":
            projected.append(F.when(is_id, F.lit("")).otherwise(F.col("__rest2")).alias("query"))
        elif name == "imdbid":
            projected.append(F.when(is_id, F.col("__imdb")).otherwise(F.col("imdbid")).alias("imdbid"))
        elif name == "type":
            projected.append(F.when(is_id, F.lit("")).otherwise(F.lit("search")).alias("type"))
        elif name in FIELDS and name not in kept:
            projected.append(F.when(is_id, F.lit("")).otherwise(F.col(name)).alias(name))
        else:
            projected.append(F.col(name))
    return q.select(*projected, "episode_terms")


# The fields a search key is made of, in order.
KEY_FIELDS = [
    "album", "artist", "author", "doubanid", "ep", "extended", "genre", "imdbid", "label", "publisher",
    "query", "season", "title", "tmdbid", "track", "traktid", "tvdbid", "tvmazeid", "tvrageid", "type", "year",
]


def search_key(server_paged: Column | bool = False) -> Column:
    """Digest over every parameter that changes what a source returns; paging only where the source pages."""
    parts = [season(F.col(c)) if c == "season" else F.col(c) for c in KEY_FIELDS]
    parts.append(F.array_join(F.array_sort("categories"), ","))
    base = F.concat_ws("\u0000", *parts)
    paged = F.concat_ws("\u0000", base, F.col("limit").cast("string"), F.col("offset").cast("string"))
    flag = server_paged if isinstance(server_paged, Column) else F.lit(server_paged)
    return F.sha2(F.when(flag, paged).otherwise(base), 256)


def request_flags() -> dict[str, Column]:
    """What kind of request this is, as rule templates ask it."""
    narrowing = [
        "imdbid", "tmdbid", "tvdbid", "tvmazeid", "tvrageid", "traktid", "doubanid", "ep", "album", "artist",
        "label", "genre", "track", "author", "title", "publisher", "year",
    ]
    is_id = reduce(lambda a, b: a | b, [F.col(c) != "" for c in narrowing]) | (season(F.col("season")) != "")
    return {
        "is_id_search": is_id,
        "is_rss_search": (keywords() == "") & ~is_id,
        "is_imdb_query": F.col("imdbid") != "",
        "is_genre_query": F.col("genre") != "",
        "is_douban_query": F.col("doubanid") != "",
        "is_tvrage_query": F.col("tvrageid") != "",
        "is_search": F.col("type") == "search",
        "is_tv_search": F.col("type") == "tvsearch",
        "is_movie_search": F.col("type") == "movie",
        "is_music_search": F.col("type") == "music",
        "is_book_search": F.col("type") == "book",
    }


def template_query() -> dict[str, Column]:
    """The .Query.* values rule templates may name, from request columns."""

    def flag(c: Column) -> Column:
        return F.when(c, F.lit("True")).otherwise(F.lit(""))

    def positive(name: str) -> Column:
        return F.when(F.col(name) > 0, F.col(name).cast("string")).otherwise(F.lit(""))

    flags = request_flags()
    return {
        "Album": F.col("album"), "Artist": F.col("artist"), "Author": F.col("author"),
        "DoubanID": F.col("doubanid"), "Ep": F.col("ep"), "Episode": episode(F.col("season"), F.col("ep")),
        "Extended": F.col("extended"), "Genre": F.col("genre"), "IMDBID": F.col("imdbid"),
        "IMDBIDShort": F.regexp_replace("imdbid", "^tt", ""), "Keywords": keywords(), "Label": F.col("label"),
        "Limit": positive("limit"), "Offset": positive("offset"), "Publisher": F.col("publisher"),
        "Q": F.col("query"), "Season": season(F.col("season")), "TMDBID": F.col("tmdbid"),
        "TVDBID": F.col("tvdbid"), "TVMazeID": F.col("tvmazeid"), "TVRageID": F.col("tvrageid"),
        "Title": F.col("title"), "Track": F.col("track"), "TraktID": F.col("traktid"), "Type": F.col("type"),
        "Year": F.col("year"),
        "IsBookSearch": flag(flags["is_book_search"]), "IsDoubanQuery": flag(flags["is_douban_query"]),
        "IsGenreQuery": flag(flags["is_genre_query"]), "IsIdSearch": flag(flags["is_id_search"]),
        "IsImdbQuery": flag(flags["is_imdb_query"]), "IsMovieSearch": flag(flags["is_movie_search"]),
        "IsMusicSearch": flag(flags["is_music_search"]), "IsRssSearch": flag(flags["is_rss_search"]),
        "IsSearch": flag(flags["is_search"]), "IsTVRageQuery": flag(flags["is_tvrage_query"]),
        "IsTVSearch": flag(flags["is_tv_search"]),
    }
