"""Rule templates as Columns: literals, variables, if/else, eq, and, or, join, re_replace, range.

A variable never set is SQL NULL, and NULL spreads through concat, so a template that
reads one is NULL exactly where that part of it is rendered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, functions as F

from gleanery.functions import regexes
from gleanery.functions.dates import template_year

Value = str | Column


@dataclass
class TemplateEnv:
    """What a template may name. `config` is constant per source; the rest are columns."""

    config: Mapping[str, str] = field(default_factory=dict)
    result: Mapping[str, Column] = field(default_factory=dict)
    query: Mapping[str, Value] = field(default_factory=dict)
    keywords: Value = ""
    categories: Column | None = None
    now: datetime | None = None
    strict: bool = True

    def with_result(self, result: Mapping[str, Column]) -> "TemplateEnv":
        return TemplateEnv(self.config, result, self.query, self.keywords, self.categories, self.now, self.strict)

    def lookup(self, name: str) -> Value | None:
        if name == ".True":
            return "True"
        if name == ".False":
            return ""
        if name == ".Keywords":
            return self.keywords
        if name == ".Categories":
            return self.categories if self.categories is not None else ""
        if name == ".Today.Year" and self.now:
            return template_year(self.now)
        if name == ".Today" and self.now:
            return self.now.strftime("%Y-%m-%d")
        for prefix, table in ((".Config.", self.config), (".Result.", self.result), (".Query.", self.query)):
            if name.startswith(prefix):
                found = table.get(name.removeprefix(prefix))
                if found is None and (prefix == ".Query." or not self.strict):
                    return ""
                return found
        return None


def as_column(value: Value | None) -> Column:
    if value is None:
        return F.lit(None).cast("string")
    return F.lit(value) if isinstance(value, str) else value


def _truthy(value: Value | None) -> Value | Column:
    return as_column(value) != ""


_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|`[^`]*`|[()|]|[^\s()|]+')


def _call(name: str, args: list[Value | None], env: TemplateEnv) -> Value | None:
    if name == "eq":
        hit = as_column(args[0]) == as_column(args[1])
        for other in args[2:]:
            hit = hit | (as_column(args[0]) == as_column(other))
        return F.when(hit, F.lit("true")).when(~hit, F.lit(""))
    if name == "ne":
        hit = as_column(args[0]) != as_column(args[1])
        return F.when(hit, F.lit("true")).when(~hit, F.lit(""))
    if name == "not":
        return F.when(_truthy(args[0]), F.lit("")).when(~_truthy(args[0]), F.lit("true"))
    if name in ("and", "or"):
        out = as_column(args[-1])
        for arg in reversed(args[:-1]):
            col = as_column(arg)
            out = F.when(col != "", out if name == "and" else col).when(col == "", col if name == "and" else out)
        return out
    if name == "join":
        items, sep = args[0], args[1]
        if items is None or isinstance(items, str):
            return items
        return F.array_join(items, sep) if isinstance(sep, str) else F.array_join(items, "")
    if name == "re_replace":
        pattern = regexes.to_java_pattern(str(args[1]))
        if regexes.group_count(pattern) is None:
            raise ValueError(f"re_replace: bad pattern {args[1]!r}")
        return F.regexp_replace(
            as_column(args[0]), F.lit(pattern), F.lit(regexes.to_java_replacement(str(args[2]), pattern))
        )
    raise ValueError(f"unknown template function {name!r}")


FUNCTIONS = ("eq", "ne", "not", "and", "or", "join", "re_replace")


def _evaluate(tokens: list[str], env: TemplateEnv, dot: Value | None) -> Value | None:
    """One pipeline: a function call with its operands, or a single operand."""

    def operand() -> Value | None:
        token = tokens.pop(0)
        if token == "(":
            inner = call()
            if not tokens or tokens.pop(0) != ")":
                raise ValueError("unbalanced parenthesis in template")
            return inner
        if token[0] == '"':
            return token[1:-1].replace('\\"', '"').replace("\\\\", "\\")
        if token[0] == "`":
            return token[1:-1]
        if token == ".":
            return dot
        if token.startswith("."):
            return env.lookup(token)
        return token

    def call() -> Value | None:
        if tokens and tokens[0] in FUNCTIONS:
            name, args = tokens.pop(0), []
            while tokens and tokens[0] not in (")", "|"):
                args.append(operand())
            return _call(name, args, env)
        return operand()

    value = call()
    while tokens and tokens[0] == "|":
        tokens.pop(0)
        value = _call(tokens.pop(0), [operand() for _ in range(len(tokens))] + [value], env)
    return value


def template_col(
    text: str,
    env: TemplateEnv,
    wrap: Callable[[Column], Column] | None = None,
    dot: Value | None = None,
    decide: Callable[[Column], bool] | None = None,
) -> Value | None:
    """A str when everything in it is constant, else a Column; None when it names a variable never set.

    `wrap` is applied to each rendered action (path values are percent-encoded this way). `decide`
    settles each condition that depends on a row, so that only one side of it is rendered.
    """
    pieces = re.split(r"\{\{-?\s*(.*?)\s*-?\}\}", text)
    if len(pieces) == 1:
        return text
    nodes = [("text" if i % 2 == 0 else "action", p) for i, p in enumerate(pieces)]
    unused = 0  # how many sides not taken enclose the block being read

    def block(stops: tuple[str, ...], dot: Value | None) -> tuple[list[Value | None], str]:
        out: list[Value | None] = []
        while nodes:
            kind, body = nodes.pop(0)
            if kind == "text":
                out.append(body)
                continue
            head, _, rest = body.partition(" ")
            if head in stops and (head == "end" or head == "else"):
                return out, body
            if head == "if":
                out.append(branch(rest, dot))
            elif head == "range":
                out.append(loop(rest, dot))
            else:
                value = _evaluate(_TOKEN.findall(body), env, dot)
                if value is not None and wrap is not None:
                    value = wrap(as_column(value))
                out.append(value)
        if stops:
            raise ValueError("template block is not closed")
        return out, ""

    def branch(condition: str, dot: Value | None) -> Value | None:
        nonlocal unused
        test = _evaluate(_TOKEN.findall(condition), env, dot)
        if isinstance(test, Column) and env.categories is test:
            hit = F.size(test) > 0
        else:
            hit = as_column(test) != ""
        settled = bool(test) if isinstance(test, str) else None
        if decide is not None and isinstance(test, Column):
            settled = True if unused else decide(hit)
        unused += settled is False
        yes, stop = block(("else", "end"), dot)
        unused += (settled is True) - (settled is False)
        no: list[Value | None] = [""]
        if stop.startswith("else if"):
            no = [branch(stop.removeprefix("else if").strip(), dot)]
        elif stop.startswith("else"):
            no, _ = block(("end",), dot)
        unused -= settled is True
        if settled is not None:
            return join(yes if settled else no)
        if decide is not None:
            return None
        return F.when(hit, as_column(join(yes))).when(~hit, as_column(join(no)))

    def loop(source: str, dot: Value | None) -> Value | None:
        items = _evaluate(_TOKEN.findall(source), env, dot)
        start = list(nodes)
        if not isinstance(items, Column):
            block(("end",), dot)
            return ""

        def body(item: Column) -> Column:
            nodes[:] = list(start)
            parts, _ = block(("end",), item)
            return as_column(join(parts))

        return F.array_join(F.transform(items, body), "")

    def join(parts: list[Value | None]) -> Value | None:
        if any(p is None for p in parts):
            return None
        if all(isinstance(p, str) for p in parts):
            return "".join(parts)
        return F.concat(*[as_column(p) for p in parts if not (isinstance(p, str) and p == "")])

    parts, _ = block((), dot)
    return join(parts)


def template_variants(text: str, env: TemplateEnv) -> list[tuple[Column | None, str | None]]:
    """Every constant text a template can become, each with the condition under which it does.

    Conditions may depend on a row; what is rendered may not. A text is None where it names a
    variable never set, and a condition is None where there is nothing to decide.
    """
    out: list[tuple[Column | None, str | None]] = []
    sides: list[bool] = []
    while True:
        taken: list[tuple[Column, bool]] = []

        def decide(hit: Column) -> bool:
            side = sides[len(taken)] if len(taken) < len(sides) else True
            taken.append((hit if side else ~hit, side))
            return side

        rendered = template_col(text, env, decide=decide)
        if isinstance(rendered, Column):
            raise ValueError(f"{text!r} may depend on a row by its conditions only")
        out.append((reduce(lambda a, b: a & b, [hit for hit, _ in taken]) if taken else None, rendered))
        sides = [side for _, side in taken]
        while sides and not sides[-1]:
            sides.pop()
        if not sides:
            return out
        sides[-1] = False
