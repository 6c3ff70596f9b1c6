"""Small renderings: file names, human sizes and durations, number text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleanery.functions.bind import let
from gleanery.functions.coerce import trim_space


# Fixed value: the characters a file name may keep.
FILE_NAME_CHARACTERS = r"\p{L}\p{N} .,_+()\[\]-"


def torrent_filename(name: Column) -> Column:
    """A conservative file name: unsafe characters become _, at most 150 bytes before the suffix."""
    cleaned = F.btrim(trim_space(F.regexp_replace(name, f"[^{FILE_NAME_CHARACTERS}]", "_")), F.lit("."))
    cleaned = F.when(cleaned == "", F.lit("torrent")).otherwise(cleaned)
    return F.concat(let(cleaned, _at_most_150_bytes), F.lit(".torrent"))


def _at_most_150_bytes(name: Column) -> Column:
    def cut(head: Column) -> Column:
        fitting = F.filter(F.sequence(F.lit(1), F.lit(150)), lambda i: F.octet_length(F.substr(head, F.lit(1), i)) <= 150)
        return F.regexp_replace(F.substr(head, F.lit(1), F.array_max(fitting)), "[. ]+$", "")

    return F.when(F.octet_length(name) > 150, let(F.substring(name, 1, 150), cut)).otherwise(name)


def fixed_places(x: Column, places: int) -> Column:
    """A double from 1 to 2^52 to so many places, at most two, as its exact binary value rounds: ties to even, and 1.15 is below its tie."""
    whole, one = F.floor(x).cast("bigint"), F.lit(1 << 52)
    # What lies behind the point is a whole number of 2^-52, so tens of it are exact longs.
    scaled = ((x - F.floor(x)) * F.lit(2.0**52)).cast("bigint") * 10**places

    def rounded(v: Column) -> Column:
        tens, left = F.call_function("shiftright", v, F.lit(52)), v.bitwiseAND(one - 1)
        return tens + ((left > F.lit(1 << 51)) | ((left == F.lit(1 << 51)) & (tens % 2 == 1))).cast("bigint")

    return let(rounded(scaled), lambda r: F.format_string(f"%d.%0{places}d", whole + F.floor(r / 10**places), r % 10**places))


def human_bytes(n: Column) -> Column:
    out = F.concat(fixed_places(n / F.lit(1024.0**6), 2), F.lit(" EB"))
    for power, unit in reversed(list(enumerate(["KB", "MB", "GB", "TB", "PB"], start=1))):
        value = n / F.lit(1024.0**power)
        out = F.when(value < 1024, F.concat(fixed_places(value, 2), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n)).otherwise(out)


def human_duration(seconds: Column) -> Column:
    s = F.abs(seconds)

    def whole(divisor: int, unit: str) -> Column:
        return F.concat(F.floor(s / divisor).cast("bigint").cast("string"), F.lit(unit))

    return (
        F.when(s < 60, whole(1, "s"))
        .when(s < 3600, whole(60, "m"))
        .when(s < 86_400, whole(3600, "h"))
        .when(s < 365 * 86_400, whole(86_400, "d"))
        .otherwise(F.concat(fixed_places(s / F.lit(365.0 * 86_400), 1), F.lit("y")))
    )


def plain_double(x: Column) -> Column:
    """A double without an exponent or trailing zeros, every digit kept: 0.00000001, 1, 0.5."""

    def spell(text: Column) -> Column:
        sign = F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
        mantissa, power = F.ltrim(F.substring_index(text, "E", 1), F.lit("-")), F.substring_index(text, "E", -1).try_cast("int")
        whole, part = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
        digits = F.concat(whole, part)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        large = F.when(power >= F.length(part), F.rpad(digits, power + 1, "0")).otherwise(
            F.concat_ws(".", F.substr(digits, F.lit(1), power + 1), F.substr(digits, power + 2))
        )
        return F.when(~F.contains(text, F.lit("E")), F.regexp_replace(text, r"\.0$", "")).otherwise(
            F.concat(sign, F.when(power < 0, small).otherwise(large))
        )

    return let(x.cast("double").cast("string"), spell)


def number_text(x: Column) -> Column:
    """A factor without an exponent or trailing zeros: 1, 0.5."""
    return plain_double(x)
