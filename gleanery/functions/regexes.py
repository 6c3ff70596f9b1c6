"""Rule patterns and replacements written for another regex dialect, checked on the driver."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark import SparkContext


@lru_cache(maxsize=4096)
def group_count(pattern: str) -> int | None:
    """Number of groups of a pattern, or None when it does not compile."""
    context = SparkContext._active_spark_context
    try:
        if context is not None:
            return context._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
        return re.compile(pattern).groups
    except Exception:
        return None


def to_java_pattern(pattern: str) -> str:
    """Named groups in Java spelling; case folding reaches beyond ASCII, as rules expect."""
    pattern = re.sub(r"\(\?P<", "(?<", pattern)
    return f"(?u){pattern}" if "(?i" in pattern else pattern


def _reference(text: str, at: int) -> tuple[str, int]:
    """The reference that starts behind a dollar sign, and the place behind it; '' when there is none."""
    if text[at : at + 1] in ("$", "&"):
        return text[at], at + 1
    if text[at : at + 1] == "{":
        end = text.find("}", at)
        name = text[at + 1 : end] if end > 0 else ""
        return (name, end + 1) if name and _is_word(name) else ("", at)
    end = at
    if text[at : at + 1].isdecimal() and text[at].isascii():
        while end < len(text) and text[end].isascii() and text[end].isdecimal():
            end += 1
    else:
        while end < len(text) and _is_word(text[end]):
            end += 1
    return text[at:end], end


def _is_word(text: str) -> bool:
    return text.isascii() and all(ch.isalnum() or ch == "_" for ch in text)


def to_java_replacement(replacement: str, pattern: str) -> str:
    """$1x is group 1 then x, $& the whole match, $$ a dollar; a group that does not exist is empty."""
    groups = group_count(pattern) or 0
    names = {part.partition(">")[0] for part in pattern.split("(?<")[1:] if ">" in part}
    out, i = "", 0
    while i < len(replacement):
        name, end = _reference(replacement, i + 1) if replacement[i] == "$" else ("", i)
        if not name:
            out += "\\" + replacement[i] if replacement[i] in "\\$" else replacement[i]
            i += 1
            continue
        i = end
        if name == "$":
            out += "\\$"
        elif name == "&":
            out += "$0"
        elif name.isdecimal():
            if int(name) <= groups:
                out += f"${int(name)}"
            if i < len(replacement) and replacement[i].isdigit():
                out += "\\" + replacement[i]
                i += 1
        elif name in names:
            out += "${" + name + "}"
    return out
