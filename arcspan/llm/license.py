"""License scans: template markup compiled into one token automaton.

A template is a licence wording with two kinds of soft regions::

    [[ ... ]]        optional: its words may be left out as a whole
    {{a b|c d}}      replaceable: exactly one of the listed wordings
    {{*min-max}}     replaceable: between min and max words of any kind

All other words are mandatory and must match exactly and in order. Every
template becomes a piece of one nondeterministic automaton over words, which
is made deterministic lazily while texts are read, so a text is scanned once
however many templates there are.

Defined cases: a null or empty text has no words, no labels and score 0; ties
cannot arise (every place counts, overlapping ones too); repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, by_batch

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wordings of public licences and of the notices that name them.
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the {{authors or copyright holders|authors|copyright holders|copyright holder|author}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and {{*0-3}} associated documentation files {{*0-3}} to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_1 = "{{*0-1}} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_2 = "{{*0-1}} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_3 = "{{*0-1}} neither the name of {{*1-8}} nor the names of {{its|the}} contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = "this software is provided by {{the copyright holders and contributors|the author and contributors|the author|the regents and contributors}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{the copyright holder or contributors|the copyright owner or contributors|the copyright holders or contributors|the author or contributors|the author|the regents or contributors}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_ISC_GRANT = "permission to use copy modify {{and or|and}} distribute this software for any purpose with or without fee is hereby granted"
_GNU = "{{you can redistribute it and or modify it|it is licensed}} under the terms of the {name} as published by the free software foundation {{either version|version}} {version} of the license [[or at your option any later version]]"
_GNU_NOTICE = "{{is licensed|licensed|is distributed|is released|released}} under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] {versions} [[of the license]]"
TEMPLATES = {
    "mit-text": f"{_MIT_GRANT} the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software {_AS_IS}",
    "mit-0-text": f"{_MIT_GRANT.removesuffix(' subject to the following conditions')} {_AS_IS}",
    "mit-notice": "{{released|licensed|distributed|available|provided}} under the [[terms of the]] mit license",
    "apache-2-text": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{http|https}} www apache org licenses license 2 0 [[html|txt]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-2-notice": "licensed under the apache license [[version]] {{2 0|2}}",
    "gpl-3-text": "this program is free software " + _GNU.replace("{name}", "gnu general public license").replace("{version}", "3"),
    "gpl-2-text": "this program is free software " + _GNU.replace("{name}", "gnu general public license").replace("{version}", "2"),
    "lgpl-3-text": "is free software " + _GNU.replace("{name}", "gnu lesser general public license").replace("{version}", "3"),
    "lgpl-2.1-text": "is free software " + _GNU.replace("{name}", "gnu lesser general public license").replace("{version}", "2 1"),
    "agpl-3-text": "is free software " + _GNU.replace("{name}", "gnu affero general public license").replace("{version}", "3"),
    "gpl-3-notice": _GNU_NOTICE.replace("{versions}", "{{version 3|v3}}"),
    "gpl-2-notice": _GNU_NOTICE.replace("{versions}", "{{version 2|v2}}"),
    "cc-by-nc-notice": "licensed under [[a|the]] {{cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial}} [[{{4 0|3 0|2 0}}]] [[international]] [[license]]",
    "cc-by-notice": "licensed under [[a|the]] {{cc by|creative commons attribution}} {{4 0|3 0|2 0}} [[international]] [[license]]",
    "bsd-2-text": f"{_BSD_GRANT} {_BSD_1} {_BSD_2} {_BSD_END}",
    "bsd-3-text": f"{_BSD_GRANT} {_BSD_1} {_BSD_2} {_BSD_3} {_BSD_END}",
    "isc-text": f"{_ISC_GRANT} provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{{{the author|isc|internet systems consortium}}}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{{{the author|isc|internet systems consortium}}}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mpl-2-text": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {{http|https}} mozilla org mpl 2 0",
    # only the beginning of a wording that may go on otherwise: what is granted, on conditions that aren't known
    "mit-grant": _MIT_GRANT,
    "bsd-grant": _BSD_GRANT,
    "isc-grant": _ISC_GRANT,
    "mpl-2-grant": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
SPDX = ("0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib")
TEMPLATES |= {f"spdx-{x.lower()}": "spdx license identifier " + re.sub(r"[-.]", " ", x.lower()) + (" [[only|or later]]" if "GPL" in x else "") for x in SPDX}
PARTIAL = "-grant"  # names of templates that hold a part of a licence

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TOKEN = re.compile(r"\[\[|\]\]|\{\{.*?\}\}|\||[^\s\[\]{}|]+")


def parse(markup: str) -> list:
    """Markup as a nested list: words, ``("opt", [alternatives])``, ``("any", min, max)``, ``("alt", [alternatives])``."""
    tokens, at = _TOKEN.findall(markup), 0

    def sequence() -> list[list]:
        nonlocal at
        found: list[list] = [[]]
        while at < len(tokens) and tokens[at] != "]]":
            token, at = tokens[at], at + 1
            if token == "[[":
                found[-1].append(("opt", sequence()))
                if at >= len(tokens):
                    raise ValueError(f"[[ without ]] in {markup!r}")
                at += 1
            elif token == "|":
                found.append([])
            elif token.startswith("{{*"):
                low, high = token[3:-2].split("-")
                found[-1].append(("any", int(low), int(high)))
            elif token.startswith("{{"):
                found[-1].append(("alt", [x.split() for x in token[2:-2].split("|")]))
            else:
                found[-1].append(token)
        return found

    out = sequence()
    if at != len(tokens) or len(out) != 1:
        raise ValueError(f"markup does not close: {markup!r}")
    return out[0]


def as_regex(markup: str) -> str:
    """The same language as a regular expression over words that each end in a blank."""

    def of(items: list) -> str:
        parts = []
        for x in items:
            if isinstance(x, str):
                parts.append(f"{x} ")
            elif x[0] == "any":
                parts.append(f"(?:[^ ]+ ){{{x[1]},{x[2]}}}")
            else:
                parts.append(f"(?:{'|'.join(of(y) for y in x[1])}){'?' if x[0] == 'opt' else ''}")
        return "".join(parts)

    return of(parse(markup))


class Automaton:
    """States are bit sets over positions of all templates; transitions are found when first needed."""

    KEPT = 200_000  # transitions kept at most; they are cheap to find again

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.moves: list[list[tuple[str | None, int]]] = []  # of a node: (word or None for any, next node)
        self.skips: list[list[int]] = []
        self.final: dict[int, int] = {}
        starts = []
        for k, name in enumerate(self.names):
            start, end = self._node(), self._node()
            self._build(parse(templates[name]), start, end)
            self.final[end] = k
            starts.append(start)
        self.words = sorted({w for out in self.moves for w, _ in out if w is not None})
        self.ids = {w.encode(): i + 1 for i, w in enumerate(self.words)}
        self.start = self._closed(sum(1 << s for s in starts))
        self.memo: dict[tuple[int, int], tuple[int, int]] = {}
        heads = {w for n in self._nodes(self.start) for w, _ in self.moves[n]}
        if None in heads or any(self.start >> e & 1 for e in self.final):
            raise ValueError("a template must begin with a word and hold at least one")
        self.heads = {self.ids[w.encode()] for w in heads}

    def _node(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def _build(self, items: list, start: int, end: int) -> None:
        at = start
        for x in items:
            to = self._node()
            if isinstance(x, str):
                self.moves[at].append((x, to))
            elif x[0] == "any":
                here = at
                for k in range(x[2]):
                    if k >= x[1]:
                        self.skips[here].append(to)
                    there = self._node()
                    self.moves[here].append((None, there))
                    here = there
                self.skips[here].append(to)
            else:
                for option in x[1]:
                    self._build(option, at, to)
                if x[0] == "opt":
                    self.skips[at].append(to)
            at = to
        self.skips[at].append(end)

    @staticmethod
    def _nodes(state: int) -> list[int]:
        found = []
        while state:
            low = state & -state
            found.append(low.bit_length() - 1)
            state ^= low
        return found

    def _closed(self, state: int) -> int:
        todo = self._nodes(state)
        while todo:
            for n in self.skips[todo.pop()]:
                if not state >> n & 1:
                    state |= 1 << n
                    todo.append(n)
        return state

    def step(self, state: int, word: int) -> tuple[int, int]:
        """The next state and the bits of the templates accepted there; word 0 is any other word."""
        if found := self.memo.get((state, word)):
            return found
        text, after = self.words[word - 1] if word else None, 0
        for n in self._nodes(state):
            for w, to in self.moves[n]:
                if w is None or w == text:
                    after |= 1 << to
        after = self._closed(after)
        accepted = sum(1 << k for e, k in self.final.items() if after >> e & 1)
        if len(self.memo) >= self.KEPT:
            self.memo.clear()
        self.memo[state, word] = after, accepted
        return after, accepted

    def scan(self, words: list[bytes]) -> dict[str, list[int]]:
        """For each accepted template, every place (in words) where a match starts."""
        found: dict[str, list[int]] = {}
        ids = list(map(self.ids.get, words, [0] * len(words)))
        heads, n = self.heads, len(ids)
        for i, first in enumerate(ids):
            if first in heads:
                state, k, got = self.start, i, 0
                while state and k < n:
                    state, accepted = self.step(state, ids[k])
                    got |= accepted
                    k += 1
                while got:
                    low = got & -got
                    found.setdefault(self.names[low.bit_length() - 1], []).append(i)
                    got ^= low
        return found


def score_of(names: set[str], plain: set[str]) -> float:
    return 1.0 if any(not n.endswith(PARTIAL) for n in names) else 0.75 if names else 0.5 if plain else 0.0


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: words, places of base phrases, base labels, all labels, score.

    ``score`` is 1 where the mandatory wording of a whole licence or notice is
    accepted, 0.75 where that of a part (``PARTIAL``) is, 0.5 where only a base
    phrase stands, else 0.
    """
    kind = docs.schema[key].dataType.simpleString()
    machine = Automaton({f"={p}": p for p in base} | templates)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for raw in as_bytes(batch.column(1)):
            words = _WORD.findall(raw.lower())
            found = machine.scan(words)
            places = [i for p in base for i in found.get(f"={p}", ())]
            plain = {base[p] for p in base if f"={p}" in found}
            more = {x for x in found if x[0] != "="}
            for k, v in (("n_words", len(words)), ("n_base", len(places)), ("first_word", min(places, default=None)), ("last_word", max(places, default=None)), ("base_labels", ",".join(sorted(plain))), ("labels", ",".join(sorted(plain | more))), ("score", score_of(more, plain))):
                out[k].append(v)
        return out | {key: batch.column(0)}

    return by_batch(docs.select(key, text), run, f"{key} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
