"""The few text codecs Spark has no expression for, as Arrow-batched pandas UDFs.

Each body is one standard-library call per value; everything else stays in the JVM.
"""

from __future__ import annotations

import codecs
import html
import unicodedata
from functools import lru_cache
import urllib.parse

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def is_utf8(charset: str | None) -> bool:
    name = (charset or "").strip().lower()
    return name in ("", "utf-8", "utf8")


def known_charset(charset: str) -> bool:
    try:
        codecs.lookup(charset.strip())
        return True
    except LookupError:
        return False


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def html_decode(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("&")), _unescape(c)).otherwise(c)


@lru_cache(maxsize=1)
def _bare_letters() -> tuple[str, str]:
    """Composed characters and what is left of each without its marks, by the rule of canonical decomposition."""
    composed, bare = [], []
    for code in range(0xA0, 0x10000):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if parts == char or unicodedata.category(char) == "Mn":
            continue
        left = unicodedata.normalize("NFC", "".join(p for p in parts if unicodedata.category(p) != "Mn"))
        if left != char and len(left) == 1:
            composed.append(char)
            bare.append(left)
    return "".join(composed), "".join(bare)


def remove_diacritics(c: Column) -> Column:
    """Letters without their marks: loose marks are dropped, composed letters become bare ones."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), *_bare_letters())).otherwise(c)


@F.pandas_udf(T.StructType([T.StructField("body", T.StringType()), T.StructField("error", T.StringType())]))
def _decoded(raw: pd.Series, charset: pd.Series) -> pd.DataFrame:
    def one(data, name):
        if data is None:
            return None, "no body"
        codec = (name or "").strip() or "utf-8"
        if not known_charset(codec):
            return None, f'unknown encoding "{codec}"'
        return bytes(data).decode(codec, errors="replace"), None

    rows = [one(d, n) for d, n in zip(raw, charset)]
    return pd.DataFrame(rows, columns=["body", "error"])


def decode_bytes(raw: Column, charset: Column) -> Column:
    """struct<body, error>: the declared charset wins; UTF-8 never leaves the JVM."""
    name = F.lower(F.trim(F.coalesce(charset, F.lit(""))))
    native = F.struct(F.decode(raw, "UTF-8").alias("body"), F.lit(None).cast("string").alias("error"))
    other = name.isin("", "utf-8", "utf8")
    return F.when(other & raw.isNotNull(), native).otherwise(_decoded(raw, charset))


def percent_encode_in(charset: str):
    """A UDF from array<struct<k,v>> to an encoded form in charset."""
    codec = codecs.lookup(charset.strip()).name

    def quote(text: str) -> str:
        return urllib.parse.quote_plus(text.encode(codec, errors="xmlcharrefreplace"), safe="-_.~")

    @F.pandas_udf(T.StringType())
    def encode(pairs: pd.Series) -> pd.Series:
        return pairs.map(lambda ps: "&".join(f"{quote(p['k'])}={quote(p['v'])}" for p in ps))

    return encode


def url_encode_in(charset: str):
    codec = codecs.lookup(charset.strip()).name

    @F.pandas_udf(T.StringType())
    def encode(values: pd.Series) -> pd.Series:
        return values.map(
            lambda v: urllib.parse.quote_plus(v.encode(codec, errors="xmlcharrefreplace"), safe="-_.!*()").replace("~", "%7E"),
            na_action="ignore",
        )

    return encode


def url_decode_in(charset: str):
    codec = codecs.lookup(charset.strip()).name

    @F.pandas_udf(T.StringType())
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: urllib.parse.unquote_to_bytes(v.replace("+", " ")).decode(codec, "replace"), na_action="ignore")

    return decode
