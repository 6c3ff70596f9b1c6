"""URL functions: reference resolution, query parameters, encoders."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from gleanery.functions.bind import let
from gleanery.functions.coerce import trim_space


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$", group)


def _drop_dots(path: Column) -> Column:
    """Remove . and .. segments of an absolute path."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    last = F.element_at(segments, -1)

    def step(kept: Column, segment: Column) -> Column:
        shorter = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return (
            F.when(segment == "..", shorter).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    tail = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    tidy = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), tidy).otherwise(path)


def _escape_path(path: Column) -> Column:
    """Percent-encode what a path may not hold literally (spaces, non-ASCII, quotes ...)."""
    safe = r"[A-Za-z0-9_.~$&+,/:;=@!*'()%\[\]-]"
    escaped = F.array_join(
        F.transform(
            F.split(path, ""),
            lambda ch: F.when(ch.rlike(safe), ch).otherwise(
                F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))
            ),
        ),
        "",
    )
    return F.when(path.rlike(rf"^(?:{safe})*$"), path).otherwise(escaped)


def resolve_url(base: Column, ref: Column) -> Column:
    """RFC 3986 resolution of ref against base; empty, absolute and unparseable refs stay as they are."""
    return let(F.coalesce(ref, F.lit("")), lambda r: _resolved(base, r))


def _resolved(base: Column, ref: Column) -> Column:
    site = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    path, query, fragment = _part(ref, 3), _part(ref, 4), _part(ref, 5)
    suffix = F.concat(query, fragment)
    folder = let(_part(base, 3), lambda p: F.when(p == "", F.lit("/")).otherwise(F.regexp_replace(p, "[^/]*$", "")))

    def tidy(path: Column) -> Column:
        # The path is worked out once, however often these read it.
        return let(let(path, _drop_dots), _escape_path)

    unparseable = ref.rlike(r"[\x00-\x1F\x7F]|%(?![0-9A-Fa-f]{2})|^[^/?#]*[^A-Za-z0-9+.\-/?#:][^/?#]*:|^[0-9+.\-:][^/?#]*:")
    return (
        F.when((ref == "") | base.isNull() | unparseable | ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(_part(base, 1), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(site, tidy(path), suffix))
        .when(ref.startswith("?"), F.concat(site, _part(base, 3), suffix))
        .when(ref.startswith("#"), F.concat(site, _part(base, 3), _part(base, 4), fragment))
        .otherwise(F.concat(site, tidy(F.concat(folder, path)), suffix))
    )


def query_param(c: Column, name: str) -> Column:
    """Value of one query parameter of a URL, or of a bare query; '' when absent."""
    pattern = f"(?:^|&){re.escape(name)}=([^&]*)"

    def lookup(query: Column) -> Column:
        return F.coalesce(F.try_url_decode(F.regexp_extract(query, pattern, 1)), F.lit(""))

    from_url = lookup(F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1))
    return F.when(from_url != "", from_url).otherwise(lookup(c))


def url_safe_encode(c: Column) -> Column:
    """Percent-encode keeping A-Z a-z 0-9 - _ . ! * ( ), with + for a space."""
    encoded = F.url_encode(c)
    for code, char in (("%21", "!"), ("%28", "("), ("%29", ")")):
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return encoded


def path_value(c: Column) -> Column:
    """A template value inside a search path; the finished path turns + into %20."""
    return F.replace(url_safe_encode(c), F.lit("+"), F.lit("%20"))


def request_url(base: Column, path: Column) -> Column:
    """Where a rendered search path is asked: resolved against the mirror."""
    return resolve_url(base, F.replace(path, F.lit("+"), F.lit("%20")))


def with_query(url: Column, encoded: Column) -> Column:
    """Append an encoded form to the query the address already carries."""
    joiner = F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.when(encoded == "", url).otherwise(F.concat(url, joiner, encoded))


def request_form(
    shared: Mapping[str, Column] | None,
    own: Mapping[str, Column] | None,
    inherit: bool = True,
    allow_empty: bool = False,
) -> Column:
    """map<string,array<string>> a search path submits: its own inputs over the shared ones.

    Blank values are left out unless allowed; a "$raw" input is a query fragment whose
    pairs are added to whatever the other inputs hold.
    """
    layers = ([shared or {}] if inherit else []) + [own or {}]
    named: dict[str, Column] = {}
    raw: list[Column] = []
    for layer in layers:
        for key, value in layer.items():
            if key == "$raw":
                raw.append(value)
            elif allow_empty or key not in named:
                named[key] = value
            else:
                named[key] = F.when(trim_space(value) != "", value).otherwise(named[key])
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in named.items()])
    if not named:
        pairs = F.array().cast("array<struct<k:string,v:string>>")
    if not allow_empty:
        pairs = F.filter(pairs, lambda p: trim_space(p["v"]) != "")
    for fragment in raw:
        pairs = F.concat(pairs, _raw_pairs(fragment))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(
        keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])
    )
    return F.map_from_arrays(keys, values)


def _raw_pairs(fragment: Column) -> Column:
    def unescape(c: Column) -> Column:
        return F.coalesce(F.try_url_decode(c), c)

    pieces = F.filter(F.split(F.coalesce(fragment, F.lit("")), "&"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
            unescape(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )


def encode_form(form: Column, charset: str | None = None) -> Column:
    """key=value&... with keys sorted; values in the source's charset when it is not UTF-8."""
    from gleanery.functions.codec import is_utf8, percent_encode_in

    entries = F.array_sort(F.map_entries(form))
    flat = F.flatten(
        F.transform(entries, lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("k"), v.alias("v"))))
    )
    if charset and not is_utf8(charset):
        return percent_encode_in(charset)(flat)
    from gleanery.functions.coerce import query_escape

    return F.array_join(
        F.transform(flat, lambda p: F.concat(query_escape(p["k"]), F.lit("="), query_escape(p["v"]))), "&"
    )
