"""Path aliases: closed under chains once on the driver, then one longest-prefix join with the specifiers.

An alias is ``(pattern, target)`` or ``(pattern, [targets])``. ``x/*`` matches
``x`` and what lies below it, ``x*`` any name that begins so, ``*`` everything,
and a pattern without a star itself only. Of the aliases that match, the one
with the longest prefix counts; its targets are tried in their order, and then,
where a target is itself behind an alias, what that leads to. No alias is used
twice in a chain, so circles end.

Aliases are configuration: hundreds or, with a workspace's packages, thousands
of rows, which become a table of their own beside the specifiers.
"""

from __future__ import annotations

import json
import posixpath
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What follows a prefix: nothing, the end or a slash, anything.
EXACT, BELOW, ANY = "exact", "below", "any"
#: Prefixes that chains of aliases may add; beyond it the configuration is refused.
DERIVED = 20_000


@dataclass(frozen=True)
class Target:
    """``head``, what the specifier has beyond the prefix (if ``rest``), ``tail``."""

    head: str
    rest: bool
    tail: str = ""


def _parsed(pattern: str, targets) -> tuple[str, str, list[Target]]:
    targets = [targets] if isinstance(targets, str) else targets
    clean = [t.removeprefix("./") for t in targets]
    if "*" not in pattern:
        return pattern, EXACT, [Target(t, False) for t in clean if "*" not in t]
    stem = pattern[: pattern.index("*")]
    kind = BELOW if stem.endswith("/") else ANY
    found = []
    for t in clean:
        head, star, tail = t.partition("*")
        found.append(Target(head.removesuffix("/") if kind == BELOW else head, bool(star), tail))
    return stem.removesuffix("/") if kind == BELOW else stem, kind, found


def closure(aliases: list) -> list[tuple[str, str, list[Target]]]:
    """Aliases of prefix and kind with all targets of their chains, and the prefixes that lead into longer ones."""
    own: dict[tuple[str, str], list[Target]] = {}
    for pattern, targets in aliases:
        stem, kind, found = _parsed(pattern, targets)
        own.setdefault((stem, kind), found)
    keys = sorted(own, key=lambda k: (-len(k[0]), k[1] != EXACT))
    by_stem = defaultdict(list)
    for k in keys:
        by_stem[k[0]].append(k)
    lengths = sorted({len(k[0]) for k in keys}, reverse=True)

    def behind(t: Target, used: frozenset) -> tuple[str, str] | None:
        """The alias that a target's own beginning matches."""
        if t.head.startswith((".", "/")):
            return None
        for n in lengths:
            for k in by_stem.get(t.head[:n], ()) if n <= len(t.head) else ():
                rest = t.head[n:]
                hit = k[1] == ANY or k[1] == BELOW and (not rest or rest[0] == "/") or k[1] == EXACT and not rest and not t.rest
                if hit and k not in used:
                    return k
        return None

    def chained(targets: list[Target], used: frozenset) -> list[Target]:
        out = list(targets)
        for t in targets:
            if k := behind(t, used):
                more = t.head[len(k[0]) :]
                out += chained([Target(u.head + more if u.rest else u.head, u.rest and t.rest, t.tail + u.tail) for u in own[k]], used | {k})
        return out

    done: dict[tuple[str, str], list[Target]] = {}
    todo = [(k, own[k], frozenset([k])) for k in keys]
    starts = sorted(keys)
    while todo:
        key, targets, used = todo.pop(0)
        if key in done:
            continue
        done[key] = list(dict.fromkeys(chained(targets, used)))
        if len(done) > DERIVED:
            raise ValueError(f"aliases lead to more than {DERIVED} prefixes")
        if key[1] == EXACT:
            continue
        for t in done[key]:
            # aliases that begin where this target may lead on: a prefix of their own, as only that part reaches them
            for longer in _starting(starts, t.head) if t.rest and not t.tail else ():
                more = longer[0][len(t.head) :]
                if longer not in used and more and (key[1] == ANY or more[0] == "/"):
                    base = [Target(u.head + more if u.rest else u.head, u.rest and longer[1] != EXACT, u.tail) for u in targets]
                    todo.append(((key[0] + more, longer[1]), base, used))
    return [(stem, kind, targets) for (stem, kind), targets in done.items()]


def _starting(keys: list[tuple[str, str]], head: str):
    from bisect import bisect_left

    for k in range(bisect_left(keys, (head, "")), len(keys)):
        if not keys[k][0].startswith(head):
            return
        yield keys[k]


def rewritten(specifiers: DataFrame, aliases: list) -> DataFrame:
    """``specifier, paths`` of distinct specifiers that an alias matches: where to look, in order."""
    spark = specifiers.sparkSession
    rows = [(stem, kind, [(t.head, t.rest, t.tail) for t in targets]) for stem, kind, targets in closure(aliases)]
    table = spark.createDataFrame(rows, "stem string, how string, targets array<struct<head:string,rest:boolean,tail:string>>")
    lengths = sorted({len(r[0]) for r in rows})
    cut = F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("n")
    at = specifiers.select("specifier").where("specifier IS NOT NULL").distinct().select("specifier", cut)
    at = at.where("n <= length(specifier)").withColumn("stem", F.expr("substring(specifier, 1, n)"))
    follows = F.expr("substring(specifier, n + 1, 1)")
    fits = (F.col("how") == ANY) | (follows == "") | (F.col("how") == BELOW) & (follows == "/")
    hits = at.join(table, "stem").where(fits & ~((F.col("how") == EXACT) & (follows != "")))
    best = hits.groupBy("specifier").agg(F.max_by(F.struct("n", "targets"), F.struct("n", F.col("how") == EXACT)).alias("b"))
    rest = F.expr("substring(specifier, b.n + 1)")
    paths = F.transform("b.targets", lambda t: F.concat(t["head"], F.when(t["rest"], rest).otherwise(""), t["tail"]))
    return best.select("specifier", F.array_distinct(paths).alias("paths"))


# --- where aliases come from --------------------------------------------------------

# Aliases that frameworks bring along, and the order of a package's conditions.
FRAMEWORKS = {
    "svelte": [("$lib/*", "src/lib/*"), ("$lib", "src/lib")],
    "nuxt": [("~/*", "*"), ("@/*", "*"), ("~~/*", "*"), ("@@/*", "*")],
}
CONDITIONS = ("types", "import", "require", "default")


def package_targets(value) -> list[str]:
    """The paths an entry of a package's exports or imports may mean, in the order of its conditions."""
    if isinstance(value, str):
        return [value.removeprefix("./")]
    if isinstance(value, list):
        parts = [package_targets(x) for x in value]
    elif isinstance(value, dict):
        parts = [package_targets(value.get(c)) for c in CONDITIONS]
    else:
        parts = []
    return list(dict.fromkeys(x for p in parts for x in p))


def _entries(table, name: str, folder: str) -> list[tuple[str, list[str]]]:
    out = []
    for key, value in table.items():
        starred = "*" in key
        targets = [posixpath.normpath(posixpath.join(folder, t)) for t in package_targets(value) if ("*" in t) == starred]
        if starred:  # what stands before the star decides, on both sides
            targets = [t[: t.index("*")].rstrip("/") + "/*" for t in targets]
            key = key[: key.index("*")].rstrip("/") + "/*"
        if targets and key != "/*":
            out.append((name + key, targets))
    return out


def package_aliases(path: str, text: str) -> list[tuple[str, list[str]]]:
    """Aliases that one ``package.json`` of a workspace brings: its exports (else its folder), or the root's own imports."""
    try:
        data = json.loads(text)
    except ValueError:
        return []
    if not isinstance(data, dict):
        return []
    folder = posixpath.dirname(path)
    if not folder:
        imports = data.get("imports")
        return _entries({k: v for k, v in imports.items() if k.startswith("#")}, "", "") if isinstance(imports, dict) else []
    name, exports = data.get("name"), data.get("exports")
    if not isinstance(name, str) or not name:
        return []
    if isinstance(exports, str) or isinstance(exports, dict) and set(exports) & set(CONDITIONS):
        exports = {".": exports}
    found = _entries({k[1:]: v for k, v in exports.items() if k.startswith(".")}, name, folder) if isinstance(exports, dict) else []
    if found:
        return found
    src = f"{folder}/src"
    return [(name, [src, folder]), (f"{name}/*", [f"{src}/*", f"{folder}/*"])]


def project_aliases(manifests: DataFrame, framework: str = "generic", declared: list = ()) -> list:
    """Declared aliases, then the framework's, then those of the workspace's manifests (``rel_path, content``)."""
    rows = manifests.where(F.col("rel_path").rlike("(^|/)package\\.json$")).select("rel_path", "content").collect()  # one a package
    packages = [a for r in sorted(rows) for a in package_aliases(r.rel_path, r.content or "")]
    return [*declared, *FRAMEWORKS.get(framework, ()), *packages]
