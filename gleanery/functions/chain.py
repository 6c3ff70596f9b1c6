"""Named value filters and the chain that folds them into one Column.

Arity and constant patterns are judged on the driver when the chain is compiled: an
unknown filter, a wrong number of arguments or an unusable pattern is skipped and the
value passes through, as does a step that fails for a single value.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from gleanery.functions import codec, dates, jsonpath, regexes, urls
from gleanery.functions.coerce import WORD_DELIMITERS, collapse_space, trim_space
from gleanery.functions.templates import TemplateEnv, Value, as_column, template_col


@dataclass(frozen=True)
class FilterEnv:
    now: object = None
    charset: str | None = None


@dataclass(frozen=True)
class FilterSpec:
    build: Callable[[Column, Sequence[Value], FilterEnv], Column | None]
    min_args: int = 0
    max_args: int = -1


REGISTRY: dict[str, FilterSpec] = {}


def register_filter(name: str, build, min_args: int = 0, max_args: int = -1) -> None:
    """Add a filter: build(col, args, env) returns a Column, or None to skip the step."""
    REGISTRY[name] = FilterSpec(build, min_args, max_args)


def _constant(arg: Value) -> str:
    if not isinstance(arg, str):
        raise ValueError("this filter argument must be constant for a source")
    return arg


def _re_replace(c, args, env):
    pattern = regexes.to_java_pattern(_constant(args[0]))
    if regexes.group_count(pattern) is None:
        return None
    if isinstance(args[1], str):
        replacement = F.lit(regexes.to_java_replacement(args[1], pattern))
    else:
        replacement = F.regexp_replace(args[1], r"([\\$])", r"\\$1")
    return F.regexp_replace(c, F.lit(pattern), replacement)


def _regexp(c, args, env):
    pattern = regexes.to_java_pattern(_constant(args[0]))
    groups = regexes.group_count(pattern)
    if groups is None:
        return None
    return F.when(c.isNotNull(), F.lit("")) if groups == 0 else F.regexp_extract(c, pattern, 1)


def _split(c, args, env):
    index = _constant(args[1])
    if not re.fullmatch(r"[+-]?\d+", index):
        return None
    separator = _constant(args[0])
    if not separator:
        return None
    parts = F.split(c, re.escape(separator[0]))
    n = int(index)
    return F.try_element_at(parts, F.lit(n + 1 if n >= 0 else n))


def _trim(c, args, env):
    if not args or args[0] == "":
        return trim_space(c)
    return F.btrim(c, F.lit(_constant(args[0])[0]))


def _valid_filename(c, args, env):
    cleaned = F.regexp_replace(c, r'[\x00-\x1F"<>|:*?\\/]', "_")
    return F.when(cleaned == "", F.lit("_")).otherwise(cleaned)


def _url_encode(c, args, env):
    if codec.is_utf8(env.charset):
        return urls.url_safe_encode(c)
    return codec.url_encode_in(env.charset)(c) if codec.known_charset(env.charset) else None


def _url_decode(c, args, env):
    if codec.is_utf8(env.charset):
        return F.try_url_decode(c)
    return codec.url_decode_in(env.charset)(c) if codec.known_charset(env.charset) else None


def html_encode(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    numbered = F.array_join(
        F.transform(
            F.split(c, ""),
            lambda ch: F.when(
                F.ascii(ch).between(160, 255) | (F.ascii(ch) > 0xFFFF),
                F.concat(F.lit("&#"), F.ascii(ch).cast("string"), F.lit(";")),
            ).otherwise(ch),
        ),
        "",
    )
    return F.when(c.rlike(r"[\u00A0-\u00FF\x{10000}-\x{10FFFF}]"), numbered).otherwise(c)


def word_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), WORD_DELIMITERS), lambda w: w != "")


def validate(c: Column, accepted: Sequence[str]) -> Column:
    """Accepted words found in the value, in the accepted list's order."""
    words = [w for w in re.split(WORD_DELIMITERS, ",".join(accepted).lower()) if w]
    if not words:
        return F.when(c.isNotNull(), F.lit(""))
    return F.array_join(F.array_intersect(F.array(*[F.lit(w) for w in words]), word_tokens(c)), ",")


def _json_join(c, args, env):
    found = jsonpath.lookup(F.try_parse_json(c), _constant(args[0]))
    items = F.transform(jsonpath.array_of(found), lambda v: jsonpath.scalar_text(v))
    return F.array_join(items, _constant(args[1]))


def _date(c, args, env):
    if not args or args[0] == "":
        return dates.as_rfc3339(dates.parse_unknown(c, env.now))
    return F.coalesce(dates.as_rfc3339(dates.parse_declared(c, _constant(args[0]), env.now)), collapse_space(c))


def _diacritics(c, args, env):
    return codec.remove_diacritics(c) if args[0] == "replace" else None


for _name, _build, _low, _high in [
    ("append", lambda c, a, e: F.concat(c, as_column(a[0])), 1, 1),
    ("prepend", lambda c, a, e: F.concat(as_column(a[0]), c), 1, 1),
    ("replace", lambda c, a, e: F.replace(c, as_column(a[0]), as_column(a[1])) if a[0] != "" else None, 2, 2),
    ("re_replace", _re_replace, 2, 2),
    ("regexp", _regexp, 1, 1),
    ("split", _split, 2, 2),
    ("trim", _trim, 0, -1),
    ("tolower", lambda c, a, e: F.lower(c), 0, -1),
    ("tolowercase", lambda c, a, e: F.lower(c), 0, -1),
    ("toupper", lambda c, a, e: F.upper(c), 0, -1),
    ("touppercase", lambda c, a, e: F.upper(c), 0, -1),
    ("reverse", lambda c, a, e: F.reverse(c), 0, -1),
    ("diacritics", _diacritics, 1, -1),
    ("validfilename", _valid_filename, 0, -1),
    ("urlencode", _url_encode, 0, -1),
    ("urldecode", _url_decode, 0, -1),
    ("querystring", lambda c, a, e: urls.query_param(c, _constant(a[0])), 1, 1),
    ("htmlencode", lambda c, a, e: html_encode(c), 0, -1),
    ("htmldecode", lambda c, a, e: codec.html_decode(c), 0, -1),
    ("validate", lambda c, a, e: validate(c, [_constant(x) for x in a]), 1, -1),
    ("jsonjoinarray", _json_join, 2, 2),
    ("dateparse", _date, 0, -1),
    ("timeparse", _date, 0, -1),
    ("timeago", lambda c, a, e: dates.as_rfc3339(dates.time_ago(c, e.now)), 0, -1),
    ("reltime", lambda c, a, e: dates.as_rfc3339(dates.time_ago(c, e.now)), 0, -1),
    ("fuzzytime", lambda c, a, e: dates.as_rfc3339(dates.parse_unknown(c, e.now)), 0, -1),
    ("hexdump", lambda c, a, e: c, 0, -1),
    ("strdump", lambda c, a, e: c, 0, -1),
]:
    register_filter(_name, _build, _low, _high)


def read_args(args) -> list[str]:
    """Filter arguments as text: a bare scalar is a list of one."""
    if args is None:
        return []
    if isinstance(args, (list, tuple)):
        return [_text(a) for a in args]
    return [_text(args)]


def _text(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return "" if value is None else str(value)


def apply_chain(
    c: Column,
    steps: Sequence[dict],
    env: TemplateEnv | None = None,
    now=None,
    charset: str | None = None,
) -> Column:
    """Fold steps [{'name': ..., 'args': ...}] into one Column.

    With a strict env, an argument naming a variable never set makes the value NULL.
    """
    env = env or TemplateEnv(strict=False)
    filter_env = FilterEnv(now=now, charset=charset)
    for step in steps or []:
        args = [template_col(a, env) for a in read_args(step.get("args"))]
        if any(a is None for a in args):
            c = F.lit(None).cast("string")
            continue
        spec = REGISTRY.get(step.get("name", ""))
        if spec is None or len(args) < spec.min_args or 0 <= spec.max_args < len(args):
            continue
        built = spec.build(c, args, filter_env)
        if built is not None:
            c = F.when(c.isNotNull(), F.coalesce(built, c))
    return c
