"""Selectors over JSON values held as VARIANT."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from gleanery.functions.bind import let
from gleanery.functions.text import plain_double


def variant_path(path: str) -> str | None:
    """A dotted path with [n] indexes as a Spark variant path; None when it can match nothing."""
    path = path.removeprefix("$.").removeprefix("$")
    out = "$"
    for segment in path.split("."):
        if not segment:
            continue
        key, bracket, rest = segment.partition("[")
        if key:
            if "'" in key:
                return None
            out += f"['{key}']"
        for part in (bracket + rest).split("["):
            part = part.strip().removesuffix("]")
            if re.fullmatch(r"[+-]?\d+", part):
                if int(part) < 0:
                    return None
                out += f"[{int(part)}]"
    return out


def lookup(value: Column, path: str) -> Column:
    """The value at path, SQL NULL when there is nothing there (a JSON null stays a value)."""
    spark_path = variant_path(path)
    if spark_path is None:
        return F.lit(None).cast("variant")
    if spark_path == "$":
        return value
    return F.try_variant_get(value, spark_path, "variant")


def _plain_number(v: Column) -> Column:
    """A JSON number, which is a double, in plain digits."""
    return plain_double(F.try_variant_get(v, "$", "double"))


def _one(v: Column) -> Column:
    return let(F.to_json(v), lambda json: _of_json(v, json))


def _of_json(v: Column, json: Column) -> Column:
    """Text of a value by the first character of its JSON text, which tells its kind."""
    return (
        F.when(F.startswith(json, F.lit('"')), F.try_variant_get(v, "$", "string"))
        .when(F.startswith(json, F.lit("[")) | F.startswith(json, F.lit("{")), json)
        .when(json == "null", F.lit(""))
        .when(json.isin("true", "false"), F.initcap(json))
        .otherwise(_plain_number(v))
    )


def array_of(v: Column) -> Column:
    """array<variant> of a JSON array, NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


#: A scalar of a JSON array, or an empty array, which counts as an empty scalar.
_ITEM = r'"(?:[^"\\]++|\\.)*+"|\[\s*\]|[^\[\],\s"]++'


def scalar_text(v: Column) -> Column:
    """Text of a value: null '', booleans True/False, arrays comma-joined however deep, plain numbers.

    SQL NULL (nothing selected) stays NULL. An array of scalars is read off its own text, so
    nesting has no bound; one that holds objects is joined item by item, an object as its JSON text.
    """
    return let(v, lambda x: F.when(x.isNotNull(), let(F.to_json(x), lambda json: _text(x, json))))


def _item_text(item: Column) -> Column:
    return (
        F.when(F.startswith(item, F.lit('"')) & ~F.contains(item, F.lit("\\")), F.substr(item, F.lit(2), F.length(item) - 2))
        .when(F.startswith(item, F.lit('"')), F.get_json_object(F.concat(F.lit("["), item, F.lit("]")), "$[0]"))
        .when(item.isin("null") | F.startswith(item, F.lit("[")), F.lit(""))
        .when(item.isin("true", "false"), F.initcap(item))
        .otherwise(plain_double(item.try_cast("double")))
    )


def _text(v: Column, whole: Column) -> Column:
    def flat(json: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(json, F.lit(_ITEM), F.lit(0)), _item_text), ",")

    def item_of(x: Column, json: Column) -> Column:
        return F.when(F.startswith(json, F.lit("[")) & ~F.contains(json, F.lit("{")), flat(json)).otherwise(F.coalesce(_of_json(x, json), F.lit("")))

    def item(x: Column) -> Column:
        return let(F.to_json(x), lambda json: item_of(x, json))

    joined = F.when(F.contains(whole, F.lit("{")), F.array_join(F.transform(array_of(v), item), ",")).otherwise(flat(whole))
    return F.when(F.startswith(whole, F.lit("[")), joined).otherwise(_of_json(v, whole))


def value_text(v: Column) -> Column:
    """Text a :contains() test looks in: compact JSON for containers, else the scalar."""
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(v)).otherwise(_one(v))


@dataclass(frozen=True)
class JsonSelector:
    path: str
    tests: tuple[tuple[str, str], ...]


def read_selector(selector: str) -> JsonSelector:
    """Split `path:has(x):not(y):contains(z)`; a filter ends at a ) that closes the text or precedes a colon."""
    path, _, rest = selector.partition(":")
    tests, pos = [], 0
    while (opened := rest.find("(", pos)) >= 0:
        closed = next(
            (j for j in range(opened + 1, len(rest)) if rest[j] == ")" and (j + 1 == len(rest) or rest[j + 1] == ":")),
            -1,
        )
        if closed < 0:
            break
        tests.append((rest[pos:opened].removeprefix(":"), rest[opened + 1 : closed]))
        pos = closed + 1
    return JsonSelector(path, tuple(tests))


def select(value: Column, selector: str) -> Column:
    """The selected value, SQL NULL when the path or one of the filters does not hold."""
    parsed = read_selector(selector)
    target = lookup(value, parsed.path) if parsed.path.strip() else value
    if not parsed.tests:
        return target
    holds = target.isNotNull()
    for name, arg in parsed.tests:
        if name == "has":
            holds = holds & select(target, arg).isNotNull()
        elif name == "not":
            holds = holds & select(target, arg).isNull()
        elif name == "contains":
            holds = holds & F.contains(value_text(target), F.lit(arg))
    return F.when(holds, target)


def resolve(value: Column, parent: Column | None, selector: str) -> Column:
    """A field selector: leading dots climb to the row's parent object."""
    if selector.startswith("..") and parent is not None:
        scope = F.when(parent.isNotNull(), parent).otherwise(value)
    else:
        scope = value
    return select(scope, selector.lstrip("."))
