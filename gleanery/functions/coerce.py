"""Raw text to typed listing values (lenient, never failing)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleanery.functions.bind import let

# Unicode white space, as a regex class body.
SPACE = r"\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

# The prefixes of size units in both scripts, by power of 1024, and the letter of a byte.
SIZE_PREFIXES = {"k": 1, "m": 2, "g": 3, "t": 4, "p": 5, "к": 1, "м": 2, "г": 3, "т": 4}
BYTE_LETTERS = {"b": "kmgtp", "б": "кмгт"}

# Counts from here on are placeholders, not swarms.
PEER_LIMIT = 5_000_000

# Characters that separate words in genre lists and accepted-value lists.
WORD_DELIMITERS = r"[, /().;\[\]\"|:]+"


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def is_blank(c: Column) -> Column:
    return trim_space(c) == ""


def keep_numeric(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9.,]+", "")


def _decimal(kept: Column) -> Column:
    """The number in digits, points and commas: the last of these is the decimal point."""

    def split(point: Column) -> Column:
        part = F.substring_index(point, ".", -1)
        whole = F.translate(F.substr(point, F.lit(1), F.length(point) - F.length(part)), ".", "")
        return F.when(F.contains(point, F.lit(".")), F.concat(whole, F.lit("."), part)).otherwise(point)

    return let(let(F.translate(kept, ",", "."), split).try_cast("double"), lambda value: F.nullif(value, F.lit(float("inf"))))


def coerce_long(c: Column) -> Column:
    kept = keep_numeric(c)
    both = F.contains(kept, F.lit(",")) & F.contains(kept, F.lit("."))
    whole = F.when(both, F.regexp_replace(kept, r"\.[^.]*$", "")).otherwise(kept)
    return F.coalesce(F.translate(whole, ",.", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def coerce_int(c: Column) -> Column:
    return F.coalesce(coerce_long(c).try_cast("int"), F.lit(0))


def coerce_double(c: Column) -> Column:
    return F.coalesce(_decimal(keep_numeric(c)), F.lit(0.0))


def peer_count(c: Column) -> Column:
    value = coerce_long(c)
    return F.when(value < PEER_LIMIT, value).otherwise(F.lit(0)).cast("int")


def parse_size_or_null(c: Column) -> Column:
    """Bytes, or NULL when there is no number or no known unit.

    Units are looked for among the letters alone, the i of binary ones left out: those with a prefix first, in
    the order of their spelling, then bare bytes. No letters at all mean bytes.
    """
    units = sorted((prefix + letter, SIZE_PREFIXES[prefix]) for letter, prefixes in BYTE_LETTERS.items() for prefix in prefixes)

    def scale(letters: Column) -> Column:
        found = F.when(letters == "", F.lit(1.0))
        for unit, power in [*units, *((letter, 0) for letter in BYTE_LETTERS)]:
            found = found.when(F.contains(letters, F.lit(unit)), F.lit(1024.0**power))
        return found

    letters = F.regexp_replace(F.lower(c), r"[^\p{L}]+|i", "")
    return (_decimal(keep_numeric(c)) * let(letters, scale)).try_cast("bigint")


def parse_size(c: Column) -> Column:
    return F.coalesce(parse_size_or_null(c), F.lit(0).cast("bigint"))


def digits(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, "([0-9]+)", 1), F.lit(""))


def genres(c: Column) -> Column:
    words = F.filter(F.split(F.coalesce(c, F.lit("")), WORD_DELIMITERS), lambda w: w != "")
    return F.array_join(F.array_distinct(F.transform(words, lambda w: F.translate(w, "_", " "))), ", ")


def factor(c: Column) -> Column:
    return F.when(keep_numeric(c) != "", coerce_double(c)).otherwise(F.lit(1.0))


def first_non_empty(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def is_info_hash(c: Column) -> Column:
    return F.coalesce(c.rlike("^([0-9A-Fa-f]{40}|[A-Za-z2-7]{32})$"), F.lit(False))


def is_magnet(c: Column) -> Column:
    return F.lower(trim_space(c)).startswith("magnet:")


def magnet_uri(c: Column) -> Column:
    return F.when(is_magnet(c), trim_space(c)).otherwise(F.lit(""))


def magnet_info_hash(c: Column) -> Column:
    """The first v1 hash a magnet names in an xt parameter, else ''."""
    query = F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.startswith("xt="))
    values = F.transform(pairs, lambda p: F.coalesce(F.try_url_decode(F.substr(p, F.lit(4))), F.lit("")))
    hashes = F.transform(values, lambda v: F.regexp_extract(v, "^(?i:urn:btih:)(.+)$", 1))
    return F.coalesce(F.get(F.filter(hashes, is_info_hash), 0), F.lit(""))


def query_escape(c: Column) -> Column:
    """RFC 3986 unreserved kept, space as +."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def info_hash_magnet(infohash: Column, title: Column, announce: list[str] | tuple[str, ...] = ()) -> Column:
    parts = [F.lit("magnet:?xt=urn:btih:"), infohash, F.lit("&dn="), query_escape(title)]
    for url in announce:
        parts += [F.lit("&tr="), query_escape(F.lit(url))]
    return F.concat(*parts)


def is_publicly_shared(source_type: Column) -> Column:
    return F.coalesce(F.lower(trim_space(source_type)).isin("public", "semi-private"), F.lit(False))


def link_fields(
    download: Column,
    magnet: Column,
    infohash: Column,
    title: Column,
    source_type: Column,
    announce: list[str] | tuple[str, ...] = (),
) -> dict[str, Column]:
    """download_url (unresolved), magnet and infohash of a listing from its three raw link fields."""
    download, magnet = F.coalesce(download, F.lit("")), F.coalesce(magnet, F.lit(""))
    given_hash = trim_space(F.coalesce(infohash, F.lit("")))
    given = F.when(is_magnet(download), trim_space(download)).otherwise(magnet_uri(magnet))
    mint = (given == "") & (given_hash != "") & is_publicly_shared(source_type)
    link = F.when(mint, info_hash_magnet(given_hash, title, announce)).otherwise(given)
    return {
        "download": F.when(is_magnet(download), F.lit("")).otherwise(download),
        "magnet": link,
        "infohash": F.when((given_hash == "") & (link != ""), magnet_info_hash(link)).otherwise(given_hash),
    }
