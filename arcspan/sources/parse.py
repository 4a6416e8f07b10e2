"""Imports and exports of source texts, by a tokenizer.

There is no compiler to ask, so the scanner separates comments, strings and
code and reads the import forms from what is left; what it can't decide (a
specifier that is not a literal) is marked approximate and of low confidence.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LEX = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.S | re.I)
_Q = r"\x01(\d+)\x02"  # a string literal's number
_FROM = re.compile(rf"\b(import|export)\b(\s+type\b(?!\s*(?:,|from)))?([^;\x01]*?)\bfrom\s*{_Q}")
_BARE = re.compile(rf"\bimport\s*{_Q}")
_CALL = re.compile(rf"\b(import|require)\s*\(\s*(?:{_Q})?([^)]*)\)")
_GLOB = re.compile(rf"\bimport\.meta\.glob(Eager)?\s*(?:<[^>]*>)?\(\s*(\[[^\]]*\]|{_Q})\s*(?:,\s*\{{([^}}]*)\}})?")
_EXPORT = re.compile(r"\bexport\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:const|let|var|function\*?|class|interface|type|enum)\s+([A-Za-z_$][\w$]*)")
_LIST = re.compile(r"\bexport\s*(?:type\s*)?\{([^}]*)\}")
_TAG = re.compile(r"<([A-Za-z][\w-]*)")
_VUE_TAGS = {"Transition", "TransitionGroup", "KeepAlive", "Teleport", "Suspense", "Component", "Slot", "Template", "RouterLink", "RouterView", "NuxtLink", "NuxtPage", "ClientOnly"}


def scan(text: str) -> tuple[str, list[str]]:
    """Code without comments in which literals are numbers, and the literals."""
    literals: list[str] = []

    def one(m: re.Match) -> str:
        t = m[0]
        lines = "\n" * t.count("\n")
        if t[0] == "/":
            return lines or " "
        literals.append(t[1:-1])
        return (f"\x01{len(literals) - 1}\x02" if t[0] != "`" or "${" not in t else f"\x03{len(literals) - 1}\x04") + lines

    return _LEX.sub(one, text), literals


def imports(code: str, literals: list[str]) -> list[dict]:
    """The imports in the order of the code.

    ``pattern`` is ``prefix`` or ``glob`` for those of which only a beginning or
    a path pattern is known; these are approximate, and less sure.
    """
    found: list[tuple[int, dict]] = []

    def add(at: int, kind: str, specifier: str, pattern: str | None = None, eager: bool = False, name: str | None = None) -> None:
        sure = "high" if pattern is None else "medium" if pattern == "prefix" or eager else "low"
        row = {"kind": kind, "specifier": specifier, "approximate": pattern is not None, "confidence": sure, "pattern": pattern, "eager": eager, "name": name}
        if specifier:
            found.append((at, row))

    for m in _FROM.finditer(code):
        kind = "re-export" if m[1] == "export" else "static"
        names = (m[3] or "").strip()
        inner = re.fullmatch(r"\{(.*)\}", names, re.S)
        typed = bool(m[2]) or bool(inner and inner[1].strip() and all(x.strip().startswith("type ") for x in inner[1].split(",") if x.strip()))
        add(m.start(), "type-only" if typed else kind, literals[int(m[4])])
    for m in _BARE.finditer(code):
        add(m.start(), "side-effect", literals[int(m[1])])
    for m in _CALL.finditer(code):
        kind = "dynamic" if m[1] == "import" else "static"
        if m[2] is not None:
            add(m.start(), kind, literals[int(m[2])], "prefix" if m[3].strip().startswith("+") else None)
        elif t := re.search("\x03(\\d+)\x04", m[3]):
            add(m.start(), kind, literals[int(t[1])].split("${")[0], "prefix")
    for m in _GLOB.finditer(code):
        options = m[4] or ""
        eager = bool(m[1]) or bool(re.search(r"\beager\s*:\s*true\b", options))
        name = re.search(rf"\bimport\s*:\s*{_Q}", options)
        for k in re.findall(_Q, m[2]):
            add(m.start(), "glob", literals[int(k)], "glob", eager, literals[int(name[1])] if name else None)
    return [row for _, row in sorted(found, key=lambda x: x[0])]


def arguments(code: str, at: int) -> list[str]:
    """The arguments of the call whose parenthesis opens at ``at``, split at commas that nothing encloses."""
    parts, depth, start = [], 0, at + 1
    for k in range(at, len(code)):
        c = code[k]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return [x.strip() for x in [*parts, code[start:k]] if x.strip()]
        elif c == "," and depth == 1:
            parts.append(code[start:k])
            start = k + 1
    return []


def literal_calls(code: str, literals: list[str], callees: tuple[str, ...]) -> list[dict]:
    """``callee, arg, value`` of literal arguments in calls of the functions named."""
    out = []
    if callees:
        for m in re.finditer(r"(?<![\w$.])(" + "|".join(map(re.escape, callees)) + r")\s*(?:<[^>()]*>)?\(", code):
            for k, x in enumerate(arguments(code, m.end() - 1)):
                if t := re.fullmatch(_Q, x):
                    out.append({"callee": m[1], "arg": k, "value": literals[int(t[1])]})
    return out


def exports(code: str) -> list[str]:
    out = _EXPORT.findall(code)
    for names in _LIST.findall(code):
        out += [x.split(" as ")[-1].strip().removeprefix("type ").strip() for x in names.split(",") if x.strip()]
    if re.search(r"\bexport\s+default\b", code):
        out.append("default")
    return list(dict.fromkeys(x for x in out if x))


def directives(code: str, literals: list[str]) -> list[str]:
    m = re.match(rf"(?:\s*{_Q}\s*;?)+", code)
    return [literals[int(k)] for k in re.findall(_Q, m[0])] if m else []


def script_of(path: str, text: str) -> str:
    """The code of a file: all of it, or what the scripts of a component hold."""
    if path.rsplit(".", 1)[-1] not in ("vue", "svelte"):
        return text
    return "\n".join(s for _, s in sorted(SCRIPT.findall(text), key=lambda s: "setup" not in s[0]))


def parse_text(path: str, text: str, callees: tuple[str, ...] = ()) -> dict:
    language = path.rsplit(".", 1)[-1]
    tags: list[str] = []
    if language == "vue":
        markup = SCRIPT.sub("", text)
        names = {"".join(p[:1].upper() + p[1:] for p in t.split("-")) for t in _TAG.findall(markup) if "-" in t or t[0].isupper()}
        tags = sorted(names - _VUE_TAGS)
    code, literals = scan(script_of(path, text))
    return {
        "language": language, "loc": 0 if not text else text.count("\n") + 1, "imports": imports(code, literals), "exports": exports(code),
        "directives": directives(code, literals), "tags": tags, "calls": sorted(set(re.findall(r"\b(use[A-Z]\w*)\s*\(", code))),
        "defines_store": bool(re.search(r"\bdefineStore\s*\(", code)), "literal_calls": literal_calls(code, literals, callees), "marks": marks(code, language),
    }


IMPORT = "kind:string,specifier:string,approximate:boolean,confidence:string,pattern:string,eager:boolean,name:string"
MARK = "what:string,name:string,start:int,stop:int,line:int,scope:int"
SCHEMA = (
    f"rel_path string, language string, loc long, imports array<struct<{IMPORT}>>, exports array<string>, directives array<string>, tags array<string>, "
    f"calls array<string>, defines_store boolean, literal_calls array<struct<callee:string,arg:int,value:string>>, marks array<struct<{MARK}>>"
)


MARKED = f"rel_path string, marks array<struct<{MARK}>>"


def parse(files: DataFrame, limit: int = 1_000_000, callees: tuple[str, ...] = ()) -> DataFrame:
    """``files`` (``rel_path, content``) parsed; texts over ``limit`` characters are left out (see :func:`unparsed`)."""
    return _read(files, limit, SCHEMA, lambda path, text: parse_text(path, text, callees))


def marked(files: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """``rel_path, marks`` of :func:`parse` alone."""
    return _read(files, limit, MARKED, lambda path, text: {"marks": marks(scan(script_of(path, text))[0], path.rsplit(".", 1)[-1])})


def _read(files: DataFrame, limit: int, schema: str, one: Callable[[str, str], dict]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            pairs = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_pylist([{"rel_path": p} | one(p, t or "") for p, t in pairs], schema=arrow)

    return files.where(F.length("content") <= limit).select("rel_path", "content").mapInArrow(run, schema)


def unparsed(files: DataFrame, limit: int = 1_000_000) -> DataFrame:
    return files.where(F.length("content") > limit).select(F.lit("parse-failed").alias("code"), F.col("rel_path").alias("file"))


# --- what lifecycle heuristics need of a code -----------------------------------------

# What acquires something, the name it goes by, and the calls that give it back.
ACQUIRES = (
    ("event-listener-cleanup", "addEventListener", r"\baddEventListener\s*\("), ("timer-cleanup", "setInterval", r"\bsetInterval\s*\("),
    ("timer-cleanup", "setTimeout", r"(?:=|:|\breturn|[\w$]\s*\(|,)\s*(?:\(\s*)*(?:[\w$]+\s*\.\s*)*\bsetTimeout\s*\("),
    ("observer-cleanup", "observer", r"\bnew\s+(?:IntersectionObserver|MutationObserver|ResizeObserver)\b"),
    ("object-url-cleanup", "createObjectURL", r"\bcreateObjectURL\s*\("), ("subscription-cleanup", "subscribe", r"\bsubscribe\s*\("),
)
CLEANUPS = {
    "addEventListener": ("removeEventListener",), "setInterval": ("clearInterval",), "setTimeout": ("clearTimeout",), "observer": ("disconnect",),
    "createObjectURL": ("revokeObjectURL",), "subscribe": ("unsubscribe", "stop"),
}
_CLEANUP = re.compile(r"\b(" + "|".join(sorted({x for v in CLEANUPS.values() for x in v})) + r")\s*\(")
_HOOK = re.compile(r"(?<![\w$.])(useEffect|onMounted|onMount|onUnmounted)\s*\(")
_ASYNC = re.compile(r"\bawait\b|\b(?:fetch|then|catch|finally)\s*\(")
_GUARD = re.compile(r"\bnew\s+AbortController\b|\b(?:abort|cancel|unsubscribe|stop)\s*\(")
_STALE = re.compile(r"\b(?:cancelled|canceled|stale|ignore|ignored|mounted|isMounted)\b")
_CALLBACK = re.compile(r"\s*(?:async\b\s*)?(?:function\b[\s\w$*]*|[A-Za-z_$][\w$]*\s*(?==>))?")
_ACQUIRE = [(kind, name, re.compile(p)) for kind, name, p in ACQUIRES]
_ANY = re.compile("|".join(["addEventListener|setInterval|setTimeout|Observer|createObjectURL|subscribe", _HOOK.pattern]))


def _pairs(code: str) -> dict[int, int]:
    """Closing places by opening ones."""
    out, stack = {}, []
    for m in re.finditer(r"[()\[\]{}]", code):
        if m[0] in "([{":
            stack.append(m.start())
        elif stack and code[stack[-1]] + m[0] in ("()", "[]", "{}"):
            out[stack.pop()] = m.start()
    return out


def _block(code: str, at: int, pairs: dict[int, int]) -> int | None:
    """The brace that opens the body of the function that begins at ``at``, if it has one."""
    k = _CALLBACK.match(code, at).end()
    if k < len(code) and code[k] == "(":
        if k not in pairs:
            return None
        k = pairs[k] + 1
    m = re.compile(r"\s*(?::[^={]*)?(?:=>)?\s*").match(code, k)
    return m.end() if code[m.end() : m.end() + 1] == "{" and m.end() in pairs else None


def _returned(code: str, start: int, stop: int, pairs: dict[int, int]) -> tuple[int, int] | None:
    """What a block's own first ``return`` gives back."""
    k = start + 1
    word = re.compile(r"\breturn\b[ \t]*(?=[^\s;}])")
    while k < stop:
        if code[k] in "([{":
            k = pairs.get(k, k) + 1
            continue
        before = code[start:k].rstrip()[-4:]
        if (m := word.match(code, k)) and not (before.endswith(")") and "\n" not in code[start:k][len(code[start:k].rstrip()) :]) and before != "else":
            end = m.end()
            while end < stop and code[end] not in ";}":
                if code[end] == "\n" and not re.match(r"\s*(?:[.?&|:=]|=>|\{)", code[end:]):
                    break
                end = pairs.get(end, end) + 1 if code[end] in "([{" else end + 1
            return m.end(), end
        k += 1
    return None


def marks(code: str, language: str = "ts") -> list[dict]:
    """Intervals and places that lifecycle heuristics join (see :mod:`..operators.lifecycle`).

    ``scope`` intervals are the bodies of hooks, ``cleanup`` ones what their
    own ``return`` gives back (``scope`` names which) or the body of a teardown
    hook; ``acquire``, ``release``, ``async``, ``guard`` and ``stale`` are places.
    """
    if not _ANY.search(code):
        return []
    out: list[dict] = []

    def add(what: str, name: str, start: int, stop: int | None = None, scope: int | None = None) -> None:
        out.append({"what": what, "name": name, "start": start, "stop": start + 1 if stop is None else stop, "line": code.count("\n", 0, start) + 1, "scope": scope})

    pairs = _pairs(code)
    for m in _HOOK.finditer(code):
        b = _block(code, m.end(), pairs)
        if m[1] == "onUnmounted":  # its callback may be an expression
            stop = pairs.get(b if b is not None else m.end() - 1)
            if stop is not None:
                add("cleanup", m[1], m.end(), stop)
            continue
        if b is None:
            continue
        add("scope", m[1], b, pairs[b], b)
        if r := _returned(code, b, pairs[b], pairs):
            add("cleanup", m[1], *r, b)
    for _, name, pattern in _ACQUIRE:
        for m in pattern.finditer(code):
            add("acquire", name, m.end() - 1)
    for what, pattern in (("release", _CLEANUP), ("async", _ASYNC), ("guard", _GUARD), ("stale", _STALE)):
        for m in pattern.finditer(code):
            add(what, m[1] if what == "release" else what, m.start())
    return out
