"""Personal data replaced by keyed surrogates.

Entities are found by pattern, brought to a canonical form (case, spacing and
punctuation of a number don't make another person) and encrypted with a
format-preserving permutation: an unbalanced Feistel network over the
positions of the canonical form, each with its own alphabet (digits, hex
digits, letters of the same script). So a surrogate keeps the type, length,
punctuation and script; it depends on the key, the type and the canonical
form only, so all mentions of an entity agree in every document (coreference);
and being a permutation of the forms of one shape, it gives two entities two
surrogates. Checksums keep their state (cards by Luhn, IBANs by mod 97). What a
name keeps besides is its gender: the title before it decides the list its
given name comes from. A name found with its title is also replaced where the
same text has it without one, whole or as the surname alone; if several people
of a text share a surname, it stands for the first of them.

Given names are drawn from short lists, so there the surname alone carries the
difference. The collision check looks at all of it: distinct entities of the
corpus are grouped by surrogate, and those that share one are given another
attempt until none do. From the first further attempt on the surname's
permutation depends on the given name too, and from attempt ``LONGER`` on the
surname grows by a letter an attempt, so there is room for any number of
people. The exceptions are a table that is joined to the texts that mention
them; it has no limit.

Defined cases: a null text stays null and holds no entity, an empty one stays
empty; texts of any length are rewritten whole; repeated rows give repeated
results; other columns pass through.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, written

LONGER = 4
KEY = b"arcspan surrogate key"  # for tests; a deployment sets KEY_CONF or passes its own secret
KEY_CONF = "spark.arcspan.surrogateKey"

# Titles, and given names by gender and script.
TITLES = {"Dr": "n", "Prof": "n", "Dra": "f", "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "г-н": "m", "г-жа": "f"}
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Martin", "Oscar", "Paul", "Robert", "Simon", "Victor"],
    ("f", "latin"): ["Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Olivia", "Rosa", "Vera"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Нина"],
}
GIVEN |= {("n", script): GIVEN["m", script] + GIVEN["f", script] for script in ("latin", "cyrillic")}

_UP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
_TITLE = "(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")(?:\.|\b)"
_NAME = rf"[{_UP}](?:[{_LOW}]+|['’][{_UP}][{_LOW}]+)(?:['’\-][{_UP}]?[{_LOW}]+)*"

PATTERNS = [
    ("email", r"(?<![A-Za-z0-9_%+\-À-ÖØ-öø-ÿ])[A-Za-z0-9_%+\-À-ÖØ-öø-ÿ]+(?:\.[A-Za-z0-9_%+\-À-ÖØ-öø-ÿ]+){0,7}@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}"),
    # what follows a telling name; the value alone is the entity
    ("credential", r"(?i:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?P<value>(?=[A-Za-z0-9+/_\-]*[0-9])[A-Za-z0-9+/_\-]{6,})"),
    ("awskey", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("secret", r"\b(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"(?<![\d.\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("card", r"(?<![\d.\-])\d{4}([ \-]?)\d{4}\1\d{4}\1\d{1,7}(?![\d\-]|\.\d)"),
    ("ipv6", r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![\w:]|\.\d)"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("phone", r"(?<![\w+.])\+\d{1,3}[ .\-]\(?\d{1,4}\)?(?:[ .\-]\d{2,4}){2,5}(?![\w]|[.\-]\d)|(?<![\w+.])0\d(?:[ .\-]\d{2}){4}(?![\w]|[ .\-]\d)|(?<![\w+.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}(?:[ .\-]?\d{3,4})?(?![\w]|[.\-]\d)|(?<![\w+])\+\d{8,15}(?!\w)|(?<![\w+.\-])0[1-9]\d{8,9}(?![\w]|[.\-]\d)"),
    ("name", rf"\b{_TITLE}(?: +{_TITLE})? +{_NAME}(?: +{_NAME})?"),
]
TYPES = [name for name, _ in PATTERNS]
_FIND = re.compile("|".join(f"(?P<{name}>{pattern.replace(chr(92) + '1', '(?P=gap)').replace('([ ' + chr(92) + '-]?)', '(?P<gap>[ ' + chr(92) + '-]?)')})" for name, pattern in PATTERNS))
#: A text without any of these holds no entity.
_HINT = re.compile(r"[0-9@]|\b(?:" + "|".join(TITLES) + r")\b|\b[A-F]{32}|\b[a-f]{32}|:[A-Fa-f]{1,4}:")
_WORD = re.compile(rf"(?<!\w){_NAME}(?!\w)")


def _parts(found: str) -> tuple[list[str], list[str]]:
    """The titles and the names of a titled mention."""
    words = found.split()
    many = 1 + (len(words) > 2 and words[1].rstrip(".") in TITLES)
    return words[:many], words[many:]


def _gender(titles: list[str]) -> str:
    return next((g for t in titles if (g := TITLES[t.rstrip(".")]) != "n"), "n")

_DIGIT, _HEX, _LOWER = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
_ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
_CYRILLIC = "".join(map(chr, range(0x430, 0x450)))
_ALPHABET = {c: a for a in (_DIGIT, _LOWER, _ACCENTED, _CYRILLIC) for c in a}


def _permuted(key: bytes, tweak: str, symbols: str, alphabets: list[str]) -> str:
    """A keyed permutation of the strings whose k-th symbol is of the k-th alphabet: six rounds of a Feistel network."""
    half = len(symbols) // 2
    sizes = [len(a) for a in alphabets]

    def number(part: slice) -> tuple[int, int]:
        value, of = 0, 1
        for c, a in zip(symbols[part], alphabets[part]):
            value, of = value * len(a) + a.index(c), of * len(a)
        return value, of

    (left, n), (right, m) = number(slice(0, half)), number(slice(half, None))
    for turn in range(6):
        word = f"{tweak}|{turn}|{left if turn % 2 else right}"
        drawn = int.from_bytes(hmac.digest(key, word.encode(), hashlib.sha512), "big")
        if turn % 2:
            right = (right + drawn) % m
        else:
            left = (left + drawn) % n
    out = []
    for value, part in ((right, range(len(symbols) - 1, half - 1, -1)), (left, range(half - 1, -1, -1))):
        for k in part:
            out.append(alphabets[k][value % sizes[k]])
            value //= sizes[k]
    return "".join(reversed(out))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def canonical(kind: str, found: str) -> str:
    """The entity a mention names; what the surrogate is a function of."""
    if kind in ("card", "ssn", "phone"):
        return re.sub(r"[^\d+]", "", found)
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(x)) for x in found.split("."))
    if kind == "ipv6":
        return ipaddress.ip_address(found).exploded
    if kind == "name":
        return " ".join(_parts(found)[1])
    return found.lower() if kind in ("email", "secret") else found


def _valid(kind: str, symbols: str, like: str) -> bool:
    """What a surrogate has to keep besides its shape; the permutation is walked until it does."""
    if kind == "card":
        return _luhn(symbols) == _luhn(like)
    if kind == "iban":
        return (_mod97(symbols) == 1) == (_mod97(like) == 1)
    return True


def surrogate(kind: str, entity: str, key: bytes = KEY, attempt: int = 0) -> str:
    """The canonical form of the replacement for a canonical form."""
    if kind == "ip":
        value, at = int.from_bytes(bytes(map(int, entity.split("."))), "big"), 0
        public = lambda v: 1 <= v >> 24 <= 223
        nibbles = f"{value:08x}"
        while at == 0 or public(value) != public(int(nibbles, 16)):
            nibbles, at = _permuted(key, f"ip|{attempt}", nibbles, [_HEX] * 8), at + 1
        return ".".join(map(str, bytes.fromhex(nibbles)))
    if kind == "name":
        *given, last = entity.split()
        more = _CYRILLIC if last[-1].lower() in _CYRILLIC else _LOWER
        longer = max(0, attempt - LONGER + 1)
        shape = [*(_ALPHABET.get(c, c) for c in last.lower()), *[more] * longer]
        tweak = f"name|{len(last)}|{attempt}" + (f"|{' '.join(given)}" if attempt else "")
        return " ".join([*given, _permuted(key, tweak, last.lower() + more[0] * longer, shape)])
    fixed = 0
    if kind == "phone" and entity.startswith("+"):
        fixed = len(entity) - 10 if len(entity) > 11 else 2  # the country's code stays
    elif kind == "phone" and entity.startswith("0"):
        fixed = 1  # a national number keeps its leading zero, and what follows it stays another digit
    elif kind == "iban":
        valid = _mod97(entity) == 1  # then the check digits follow from the rest, which is permuted alone
        fixed = 4 if valid else 2
    elif kind in ("awskey", "ipv6"):
        fixed = 4  # an address keeps its first group, which tells what kind it is
    alphabets = []
    for k, c in enumerate(entity):
        low = c.lower()
        alphabet = _HEX if kind in ("secret", "ipv6") and c != ":" else _LOWER.upper() if c in _LOWER.upper() else _ALPHABET.get(low, c)
        if kind == "phone" and k == fixed == 1:
            alphabet = _DIGIT[1:] if c != "0" else c
        alphabets.append(c if k < fixed else alphabet)
    if kind == "email":  # the last label of the domain stays
        keep = entity.rindex(".")
        alphabets = [c if k >= keep else a for k, (c, a) in enumerate(zip(entity, alphabets))]
    shape = "".join(a[0] for a in alphabets)
    if kind == "iban" and valid:
        shape, alphabets = shape[:2] + shape[4:], [*alphabets[:2], *alphabets[4:]]
        rest = _permuted(key, f"iban|{shape}|{attempt}|valid", entity[:2] + entity[4:], alphabets)
        return f"{rest[:2]}{98 - _mod97(rest[:2] + '00' + rest[2:]):02d}{rest[2:]}"
    out = entity
    while True:
        out = _permuted(key, f"{kind}|{shape}|{attempt}", out, alphabets)
        if _valid(kind, out, entity):
            return out


def _cased(like: str, text: str) -> str:
    return "".join(t.upper() if c.isupper() else t for c, t in zip(like, text)) if len(like) == len(text) else text


def replacement(kind: str, found: str, key: bytes = KEY, attempt: int = 0) -> str:
    """The surrogate in the form of the mention: its case, blanks and punctuation."""
    entity = canonical(kind, found)
    new = surrogate(kind, entity, key, attempt)
    if kind == "name":
        titles, names = _parts(found)
        gender = _gender(titles)
        script = "cyrillic" if any("а" <= c.lower() <= "я" for c in entity) else "latin"
        *given, last = names
        lists = GIVEN[gender, script]
        first = [lists[int.from_bytes(hmac.digest(key, f"given|{gender}|{entity}|{attempt}".encode(), hashlib.sha256)[:8], "big") % len(lists)] for _ in given]
        surname = new.split()[-1]
        return " ".join([*titles, *first, _cased(last, surname[: len(last)]) + surname[len(last) :]])
    if kind == "ipv6":
        new = ipaddress.ip_address(new).compressed if "::" in found else new if len(found) == 39 else ":".join(f"{int(x, 16):x}" for x in new.split(":"))
        return new.upper() if any(c.isupper() for c in found) and not any(c.islower() for c in found) else new
    if kind in ("card", "ssn", "phone", "iban"):
        symbols = iter(new)
        return "".join(next(symbols) if c.isalnum() or c == "+" else c for c in found)
    return new.upper() if kind == "secret" and found.upper() == found else _cased(found, new)


_SECRET, _AWS = (re.compile(p) for p in (r"[0-9a-f]{12,}|[0-9A-F]{12,}", r"(?:AKIA|ASIA)[A-Z0-9]{16}"))


def entities(text: str) -> list[tuple[str, int, int]]:
    """``(type, start, end)`` of all mentions, from left to right and without overlap; names with their titles."""
    out = []
    for m in _FIND.finditer(text) if _HINT.search(text) else ():
        kind, (start, end) = m.lastgroup, m.span()
        if kind == "credential":  # a key that would be found by itself is the same entity here
            start, end = m.span("value")
            kind = "secret" if _SECRET.fullmatch(m["value"]) else "awskey" if _AWS.fullmatch(m["value"]) else kind
        elif kind == "ipv6" and not _is_address(m[0]):
            continue
        out.append((kind, start, end))
    return out


def _is_address(found: str) -> bool:
    try:
        ipaddress.ip_address(found)
    except ValueError:
        return False
    return True


def untitled(text: str, found: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """``(start, end, which)`` of mentions without a title of names in ``found`` (its place there)."""
    whole: dict[tuple[str, ...], int] = {}
    for k, (kind, start, end) in enumerate(found):
        if kind == "name":
            names = _parts(text[start:end])[1]
            whole.setdefault(tuple(names), k)
            whole.setdefault((names[-1],), k)
    if not whole:
        return []
    out, edges = [], [(0, 0), *((s, e) for _, s, e in found), (len(text), len(text))]
    for (_, a), (b, _) in zip(edges, edges[1:]):  # between the mentions
        words, k = [m.span() for m in _WORD.finditer(text, a, b)], 0
        while k < len(words):
            start, end = words[k]
            two = words[k + 1][1] if k + 1 < len(words) and text[end : words[k + 1][0]].strip(" ") == "" else None
            if two and (which := whole.get((text[start:end], text[words[k + 1][0] : two]))) is not None:
                out.append((start, two, which))
                k += 1
            elif (which := whole.get((text[start:end],))) is not None:
                out.append((start, end, which))
            k += 1
    return out


def rewrite(text: str, key: bytes = KEY, attempts: dict[tuple[str, str], int] | None = None) -> tuple[str, list[str]]:
    """The text with surrogates, and the types found."""
    found = entities(text)
    done = []  # (start, end, type, surrogate)
    for kind, start, end in found:
        mention = text[start:end]
        done.append((start, end, kind, replacement(kind, mention, key, (attempts or {}).get((kind, _entity_key(kind, mention)), 0))))
    for start, end, which in untitled(text, found):
        names = _parts(done[which][3])[1]
        done.append((start, end, "name", " ".join(names) if " " in text[start:end] else names[-1]))
    if not done:
        return text, []
    out, at = [], 0
    for start, end, _, new in sorted(done):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), [kind for _, _, kind, _ in sorted(done)]


def _entity_key(kind: str, found: str) -> str:
    """The canonical form, a name with the gender its title gives."""
    return canonical(kind, found) if kind != "name" else f"{_gender(_parts(found)[0])} {canonical(kind, found)}"


def _plain_surrogate(kind: str, found: str, key: bytes, attempt: int) -> str:
    new = replacement(kind, found, key, attempt)
    return canonical(kind, new)


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(kind, entity, found)`` of all mentions, repeats within a batch once."""

    def run(batch: pa.RecordBatch) -> dict:
        seen: dict[tuple[str, str], str] = {}
        for t in batch.column(0).to_pylist():
            for kind, start, end in entities(t) if t else ():
                seen.setdefault((kind, _entity_key(kind, t[start:end])), t[start:end])
        return {"kind": [k for k, _ in seen], "entity": [e for _, e in seen], "found": list(seen.values())}

    return by_batch(docs.select(text), run, "kind string, entity string, found string")


def exceptions(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """``(kind, entity, attempt)`` of entities that need another attempt, so that distinct ones have distinct surrogates.

    Works on the distinct entities of the corpus. The first of those that
    share a surrogate (by text) keeps it. An attempt's results are compared
    with all surrogates, so they can't run into ones given before. Only names
    can share one, and their room grows with the attempts, so the rounds end.
    """

    def surrogates(batch: pa.RecordBatch) -> dict:
        kinds, names, texts = (batch.column(k).to_pylist() for k in range(3))
        tries = batch.column(3).to_pylist()
        return {"kind": kinds, "entity": names, "found": texts, "attempt": tries, "sur": [_plain_surrogate(k, t, key, a) for k, t, a in zip(kinds, texts, tries)]}

    schema = "kind string, entity string, found string, attempt int, sur string"
    distinct = found.groupBy("kind", "entity").agg(F.min("found").alias("found"))
    table = written(by_batch(distinct.withColumn("attempt", F.lit(0)), surrogates, schema), "surrogates")
    while True:
        # one number for each surrogate first: a hot one never meets in a task
        owners = table.groupBy("kind", "sur").agg(F.min("entity").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
        again = written(table.join(owners, ["kind", "sur"]).where("entity <> owner").select("kind", "entity", "found", (F.col("attempt") + 1).alias("attempt")), "again")
        if again.isEmpty():
            return table.where("attempt > 0").select("kind", "entity", "attempt")
        redone = by_batch(again, surrogates, schema)
        table = written(table.join(again, ["kind", "entity"], "left_anti").select(*table.columns).union(redone), "surrogates")


def collisions(found: DataFrame, key: bytes = KEY) -> dict[tuple[str, str], int]:
    """The table of :func:`exceptions` on the driver, for few entities."""
    return {(r.kind, r.entity): r.attempt for r in exceptions(found, key).collect()}


def _with_attempts(plain: DataFrame, text: str, attempts: DataFrame) -> DataFrame:
    """Adds ``attempts``, the exceptions that a text mentions; texts are told apart by a hash, as an exception holds for all texts alike."""

    def run(batch: pa.RecordBatch) -> dict:
        seen = {(h, kind, _entity_key(kind, t[start:end])) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for kind, start, end in entities(t)}
        return {name: [x[k] for x in seen] for k, name in enumerate(("hash", "kind", "entity"))}

    hashed = plain.withColumn("hash", F.xxhash64(text))
    named = by_batch(hashed.select("hash", text), run, "hash long, kind string, entity string")
    wanted = named.join(attempts, ["kind", "entity"]).groupBy("hash").agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("attempts"))
    return hashed.join(wanted, "hash", "left").select(*plain.columns, "attempts")


def pseudonymised(docs: DataFrame, key: bytes | None = None, text: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` rewritten; with ``counts``, also ``n_entities`` and ``kinds`` (distinct, sorted, comma-joined).

    Without ``key``, the session's ``KEY_CONF`` is the secret.
    """
    key = key or docs.sparkSession.conf.get(KEY_CONF, "").encode() or KEY
    attempts = exceptions(mentions(docs, text), key)
    place = docs.columns.index(text)
    names = [f"c{k}" for k in range(len(docs.columns))]  # columns by place: names may clash with ours
    fields = [f"{n} {docs.schema[k].dataType.simpleString()}" for k, n in enumerate(names)]
    plain = docs.toDF(*names)
    shared = not attempts.isEmpty()
    if shared:
        plain = _with_attempts(plain, names[place], attempts)

    def run(batch: pa.RecordBatch) -> dict:
        others = batch.column(len(names)).to_pylist() if shared else [None] * batch.num_rows
        tries = ({(x["kind"], x["entity"]): x["attempt"] for x in o or ()} for o in others)
        done = [(None, []) if t is None else rewrite(t, key, o) for t, o in zip(batch.column(place).to_pylist(), tries)]
        out = {n: batch.column(k) for k, n in enumerate(names)} | {names[place]: [t for t, _ in done]}
        return out | {"n_entities": [len(k) for _, k in done], "kinds": [",".join(sorted(set(k))) for _, k in done]}

    out = by_batch(plain, run, ", ".join([*fields, "n_entities long", "kinds string"]))
    extra = ["n_entities", "kinds"] if counts else []
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)), *extra)
