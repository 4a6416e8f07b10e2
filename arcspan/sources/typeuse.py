"""Whether imported names are used as types only, read from tokens.

There is no compiler to ask. Tokens are read with their brackets, and a use
counts as a type only where the text leaves no doubt: inside an interface, a
type alias, after ``implements``, ``as`` or ``satisfies``, in annotations of
variables, parameters, results and class members, and in type arguments of
calls. Every other use, ``typeof x`` and ``class extends X`` too, is a value;
so an import is never taken for erasable by mistake of this reading, while some
that a compiler would erase are not found.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .parse import SCRIPT, scan, script_of

SHORT = 1_000
_TOKEN = re.compile(r"\n|[A-Za-z_$][\w$]*|\d[\w.]*|[\x01\x03]\d+[\x02\x04]|=>|\?\.|\.\.\.|[^\s\w]")
_NAME = re.compile(r"[A-Za-z_$]")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_CONTROL = {"if", "for", "while", "switch", "catch", "with", "return", "typeof", "await", "in", "of"}
_MODIFIERS = {"private", "public", "protected", "readonly", "override", "static", "declare", "abstract", "accessor"}
_IMPORT = re.compile(r"\bimport\s+(?!type\b(?!\s*(?:,|from\b)))([^;\x01]*?)\bfrom\s*\x01(\d+)\x02")


class Reading:
    """Tokens of a source without comments; ``typed`` holds the places in type positions."""

    def __init__(self, code: str) -> None:
        self.tokens: list[str] = []
        self.fresh: list[bool] = []  # the first of its line
        line = True
        for t in _TOKEN.findall(code):
            if t == "\n":
                line = True
                continue
            self.tokens.append(t)
            self.fresh.append(line)
            line = False
        self.tokens += [""]
        self.fresh += [True]
        self.match: dict[int, int] = {}
        self.around: list[int] = []
        self.typed: set[int] = set()
        stack: list[int] = []
        for k, t in enumerate(self.tokens):
            if t in _CLOSE and stack and _OPEN[self.tokens[stack[-1]]] == t:
                self.match[stack[-1]] = k
                self.match[k] = stack.pop()
            self.around.append(stack[-1] if stack else -1)
            if t in _OPEN:
                stack.append(k)
        self.values: set[int] = set()
        self.classes = {b for k, t in enumerate(self.tokens) if t == "class" and (b := self._body(k)) is not None}
        self._read()

    def _body(self, k: int) -> int | None:
        """The brace that opens the body of a class or an interface."""
        while (t := self.tokens[k]) and t not in ";)}":
            if t == "{":
                return k
            k = self.match.get(k, k) + 1 if t in _OPEN else k + 1
        return None

    def angles(self, k: int) -> int:
        """The place after the bracket that closes ``<`` at ``k`` if what lies between can only be types, else -1."""
        depth = 0
        while t := self.tokens[k]:
            depth += (t == "<") - (t == ">")
            if not depth:
                return k + 1
            if t in _OPEN and k in self.match:
                k = self.match[k]
            elif not (_NAME.match(t) or t[0] in "\x01\x03" or t in "<>,.|&=?:" or t == "=>" or t.isdigit()):
                return -1
            k += 1
        return -1

    def type_end(self, k: int) -> int:
        """The place after the type that begins at ``k``."""
        wanted, conditional = True, 0
        while t := self.tokens[k]:
            if wanted:
                if t in "|&" or t in ("keyof", "readonly", "unique", "infer", "asserts", "new", "abstract") and (_NAME.match(self.tokens[k + 1]) or self.tokens[k + 1] in "([{<"):
                    k += 1
                elif t == "typeof":
                    self.values.update((k + 1, k + 2))
                    k += 1
                elif t in _OPEN and k in self.match:
                    end = self.match[k]
                    k, wanted = end + 1, False
                    if t == "(" and self.tokens[k] == "=>":
                        k, wanted = k + 1, True
                elif t == "<":
                    if (k := self.angles(k)) < 0:
                        return k
                elif _NAME.match(t) or t[0] in "\x01\x03" or t.isdigit() or t == "-":
                    k += 1
                    while self.tokens[k] == "." and not self.fresh[k]:
                        k += 2
                    if self.tokens[k] == "<":
                        if (k := self.angles(k)) < 0:
                            return k
                    wanted = t == "-"
                else:
                    return k
            elif t in "|&":
                k, wanted = k + 1, True
            elif t == "[" and not self.fresh[k] and k in self.match:
                k = self.match[k] + 1
            elif t in ("extends", "is") and not self.fresh[k]:
                k, wanted, conditional = k + 1, True, conditional + (t == "extends")
            elif conditional and t in "?:":
                k, wanted, conditional = k + 1, True, conditional - (t == ":")
            else:
                return k
        return k

    def _mark(self, k: int) -> None:
        end = self.type_end(k)
        self.typed.update(range(k, end))

    def _parameters(self, k: int) -> bool:
        """Is the parenthesis at ``k`` a list of parameters?"""
        end = self.match.get(k)
        if end is None:
            return False
        j, after = k - 1, self.tokens[end + 1]
        if j > 0 and self.tokens[j] == ">":  # type parameters stand between the name and the list
            depth = 1
            while j > 0 and depth:
                j -= 1
                depth += (self.tokens[j] == ">") - (self.tokens[j] == "<")
            j -= 1
        before, head = self.tokens[j] if j >= 0 else "", self.tokens[j - 1] if j > 0 else ""
        named = bool(_NAME.match(before)) and before not in _CONTROL
        if after == "=>":
            return True
        if after == ":" and before in ("=", "(", ",", "async", "return", "=>", "default", ""):
            past = self.type_end(end + 2)
            return past > 0 and self.tokens[past] == "=>"
        declared = before == "function" or head in ("function", "get", "set", "async") or self.around[k] in self.classes and named
        if after == "{":
            return declared or before == "constructor"
        return declared and after == ":"

    def _annotates(self, k: int) -> bool:
        """Does the colon at ``k`` begin an annotation?"""
        t, around = self.tokens, self.around[k]
        if k and t[k - 1] == ")":
            return self._parameters(self.match.get(k - 1, -1)) if k - 1 in self.match else False
        j = k - 1
        if j >= 0 and t[j] in "?!":
            j -= 1
        if j < 1 or not (_NAME.match(t[j]) or t[j] in "]}"):
            return False
        j = self.match.get(j, j) if t[j] in "]}" else j
        before = t[j - 1]
        if around >= 0 and t[around] == "(":
            return self._parameters(around) and (before in ("(", ",", "...") or before in _MODIFIERS)
        if around in self.classes:
            return before in "{;}" or before in _MODIFIERS or self.fresh[j]
        return before in ("let", "const", "var")

    def _read(self) -> None:
        t = self.tokens
        for k, x in enumerate(t):
            after = t[k + 1] if k + 1 < len(t) else ""
            before = t[k - 1] if k else ""
            if x == "interface" and _NAME.match(after) and (b := self._body(k)) is not None and b in self.match:
                self.typed.update(range(k, self.match[b]))
            elif x == "type" and _NAME.match(after) and k + 2 < len(t) and t[k + 2] in ("=", "<") and before != ".":
                eq = self.angles(k + 2) if t[k + 2] == "<" else k + 2
                if eq > 0 and t[eq] == "=":
                    self.typed.update(range(k, eq))
                    self._mark(eq + 1)
            elif x == "implements" and (b := self._body(k)) is not None and before != ".":
                self.typed.update(range(k, b))
            elif x in ("as", "satisfies") and not self.fresh[k] and (_NAME.match(before) or before in ")]}" or before[:1] in ("\x01", "\x03")) and after != "const":
                head = self.tokens[self.around[k] - 1] if self.around[k] > 0 else ""
                if head not in ("import", "export", "type", ","):
                    self._mark(k + 1)
            elif x == "<" and (_NAME.match(before) or before == "]") and (end := self.angles(k)) > 0 and t[end] == "(":
                self.typed.update(range(k, end))
            elif x == ":" and k not in self.typed and self._annotates(k):
                self._mark(k + 1)
        # marks inside types are types too, but for what typeof names
        self.typed -= self.values


def type_only_names(path: str, text: str, specifier: str) -> list[str]:
    """The names that the first import of a specifier brings, if all uses of them are types and there is one; else none.

    A path says nothing but its language, so short texts that are alike are read once.
    """
    language = path.rsplit(".", 1)[-1]
    return list((_short if len(text) <= SHORT else _names)(language, text, specifier))


def _names(language: str, text: str, specifier: str) -> list[str]:
    code, literals = scan(script_of(f"x.{language}", text))
    found = next((m for m in _IMPORT.finditer(code) if literals[int(m[2])] == specifier), None)
    if found is None:
        return []
    names = []
    for x in re.sub(r"[{}]", ",", found[1]).split(","):
        x = x.strip()
        if x and not x.startswith("type "):
            names.append(re.split(r"\s+as\s+", x)[-1].strip())
    if not names:
        return []
    rest = code[: found.start()] + " " * (found.end() - found.start()) + code[found.end() :]
    # names inside templates may be values of theirs
    inside = " ".join(x for x in literals if "${" in x)
    reading = Reading(rest)
    used = {k: t for k, t in enumerate(reading.tokens) if t in names}
    if not used or any(k not in reading.typed for k in used) or any(re.search(rf"\b{re.escape(n)}\b", inside) for n in names):
        return []
    if language in ("vue", "svelte") and any(re.search(rf"\b{re.escape(n)}\b", SCRIPT.sub("", text)) for n in names):
        return []
    return sorted(set(used.values()))


_short = lru_cache(20_000)(_names)
