"""Path patterns as regular expressions, compiled once on the driver.

``glob_regex`` is the plain dialect (``**/``, ``**``, ``*``, ``?``), anchored
at both ends. ``ignore_regex`` is the dialect of ignore files: a pattern with
an inner slash is anchored at the root, one without matches at any depth, one
that ends in a slash matches folders only, and whatever lies below a match
matches too. In a list the last pattern that matches decides; ``!`` negates.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _body(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif pattern[i] in "*?":
            out.append("[^/]*" if pattern[i] == "*" else "[^/]")
            i += 1
        elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inside = pattern[i + 1 : end]
            out.append("[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]")
            i = end + 1
        elif pattern[i] == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
        else:
            out.append(re.escape(pattern[i]))
            i += 1
    return "".join(out)


def glob_regex(pattern: str) -> str:
    return f"^{_body(pattern)}$"


def ignore_regex(pattern: str) -> str | None:
    """The regular expression of one pattern; ``None`` for blanks and comments. Negation is the caller's."""
    pattern = re.sub(r"(?<!\\) +$", "", pattern)
    if not pattern or pattern.startswith("#"):
        return None
    folder = pattern.endswith("/")
    core = pattern.strip("/") if not pattern.startswith("/") else pattern[1:].rstrip("/")
    rooted = pattern.startswith("/") or "/" in core
    if not core:
        return None
    if core.endswith("/**"):
        return f"^{_body(core[:-3])}/.+$"
    return f"^{'' if rooted else '(?:.*/)?'}{_body(core)}{'/.*' if folder else '(?:/.*)?'}$"


def ignore_parts(pattern: str) -> tuple[str, bool] | None:
    """What one pattern says of a path itself, not of what lies below: its regular expression, and whether it means folders only."""
    whole = ignore_regex(pattern)
    if whole is None:
        return None
    for tail, folder in (("(?:/.*)?$", False), ("/.*$", True)):
        if whole.endswith(tail):
            return whole.removesuffix(tail) + "$", folder
    return whole, False


def ignored(path: Column, patterns: str | list[str]) -> Column:
    """Does the list of patterns match (the last one that does decides)?"""
    result = F.lit(False)
    for p in [patterns] if isinstance(patterns, str) else patterns:
        negated = p.startswith("!")
        if regex := ignore_regex(p[1:] if negated else p):
            result = F.when(path.rlike(regex), F.lit(not negated)).otherwise(result)
    return result
