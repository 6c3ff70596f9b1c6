"""Taking secrets out of text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A run of 16 or more letters and digits with at least one of each.
TOKEN = r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,}"
ADDRESS = r"[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>]+"
MARK = "…"


def redact_tokens(c: Column) -> Column:
    return F.regexp_replace(c, TOKEN, MARK)


def token_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)))


def looks_like_token(c: Column) -> Column:
    return c.rlike(f"^{TOKEN}$")


def redact_url(c: Column) -> Column:
    """Scheme, host and path only, with a note for what was dropped."""
    site = F.regexp_replace(F.regexp_extract(c, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?)", 1), "//[^/?#]*@", "//")
    path = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    had_query = c.rlike(r"^[^#]*\?")
    had_fragment = c.rlike("#.")
    return F.concat(
        site,
        redact_tokens(path),
        F.when(had_query, F.lit(" (query redacted)")).otherwise(F.lit("")),
        F.when(had_fragment, F.lit(" (fragment redacted)")).otherwise(F.lit("")),
    )


def redact_message(c: Column, queries: Column | None = None) -> Column:
    """Replace every address inside a message by its redacted form, longest first, then bare queries."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(ADDRESS), F.lit(0)))
    swaps = F.transform(
        found, lambda a: F.struct((-F.length(a)).alias("order"), a.alias("old"), redact_url(a).alias("new"))
    )
    if queries is not None:
        secret = F.filter(queries, lambda q: (q != "") & (F.contains(q, F.lit("=")) | looks_like_token(q)))
        swaps = F.concat(
            swaps,
            F.transform(
                secret,
                lambda q: F.struct((-F.length(q)).alias("order"), q.alias("old"), F.lit("(query redacted)").alias("new")),
            ),
        )
    return F.aggregate(F.array_sort(swaps), c, lambda text, s: F.replace(text, s["old"], s["new"]))


def redact_path(c: Column) -> Column:
    """A search path template with its literal query values hidden; keys and actions stay."""
    action = r"\{\{.*?\}\}"
    closed = F.regexp_replace(c, r"\{\{(?:(?!\}\}).)*$", MARK)
    before = F.regexp_extract(closed, rf"(?s)^((?:{action}|[^?#{{]|\{{(?!\{{))*)", 1)
    query = F.substr(closed, F.length(before) + 1)
    pieces = F.regexp_extract_all(query, F.lit(rf"(?s){action}|[?#&=]|(?:(?!\{{\{{)[^?#&=])+"), F.lit(0))
    # Walk the pieces with a flag: inside a value or not. A key is a piece followed by '='.
    indexed = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), F.get(pieces, i + 1).alias("next")))
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("in_query"), F.lit(False).alias("value"))

    def step(state: Column, piece: Column) -> Column:
        p = piece["p"]
        shown = (
            F.when(p.isin("?", "#", "&", "="), p)
            .when(p.startswith("{{"), redact_tokens(p))
            .when(~state["value"] & (piece["next"] == "="), redact_tokens(p))
            .otherwise(F.lit(MARK))
        )
        value = (
            F.when(p == "?", state["value"] | state["in_query"])
            .when(p == "#", F.lit(True))
            .when(p == "&", F.lit(False))
            .when(p == "=", F.lit(True))
            .otherwise(state["value"])
        )
        return F.struct(
            F.concat(state["out"], shown).alias("out"),
            (state["in_query"] | p.isin("?", "#")).alias("in_query"),
            value.alias("value"),
        )

    return F.concat(redact_tokens(before), F.aggregate(indexed, start, step, lambda s: s["out"]))
