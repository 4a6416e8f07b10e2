import re

import pytest

from arcspan.llm import license as lic


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in lic.BASE}
    places = sorted(i for v in at.values() for i in v)
    line = " " + " ".join(words) + " "
    more = {n for n, m in lic.TEMPLATES.items() if re.search(" " + lic.as_regex(m), line)}
    base = {lic.BASE[p] for p, v in at.items() if v}
    return len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if [n for n in more if not n.endswith("-grant")] else 0.75 if more else 0.5 if base else 0.0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
CLAUSE
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
WHOLE = [MIT, BSD.replace("CLAUSE\n", ""), BSD.replace("CLAUSE", CLAUSE)]
TEXTS = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0 (the License)", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "under the MIT under the mit license CC BY-NC cc by nc", "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: Apache-2.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    *WHOLE, WHOLE[0].replace("subject to the following conditions", "subject to the following conditions: used for Good, not Evil, and"), WHOLE[1].replace("binary form", "any form"), "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: not known",
    "permission is hereby granted free of cost to any person", "under the mit license", "UNDER THE MİT LICENSE",
]


def test_against_brute_force(spark):
    rows = lic.scan_licenses(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_whole_wordings_are_told_from_changed_ones():
    machine = lic.Automaton(lic.TEMPLATES)
    found = lambda t: set(machine.scan(re.findall(rb"[0-9a-z]+", t.lower().encode())))
    assert found(MIT) == {"mit-text", "mit-grant"}
    assert found(WHOLE[1]) == {"bsd-2-text", "bsd-grant"} and found(WHOLE[2]) == {"bsd-3-text", "bsd-grant"}
    assert found(MIT.replace("conditions:", "conditions: The Software shall be used for Good, not Evil.")) == {"mit-grant"}
    assert found(MIT.replace("OR OTHERWISE", "")) == {"mit-grant"}
    assert found("SPDX-License-Identifier: BSD-3-Clause") == {"spdx-bsd-3-clause"} and not found("SPDX-License-Identifier: some words")


def test_odd_rows(odd, empty, odd_rows):
    got = sorted((tuple(r) for r in lic.scan_licenses(odd).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in odd_rows), key=str)
    assert lic.scan_licenses(empty).collect() == []


def test_mandatory_words_must_match():
    machine = lic.Automaton({"a": "one [[two [[three]]]] {{four|five six}} {{*1-2}} end"})
    ok = ["one four x end", "one two five six x y end", "one two three four x end"]
    bad = ["one three four x end", "one four end", "one four x y z end", "one five x end", "two four x end"]
    assert all(machine.scan([w.encode() for w in t.split()]) == {"a": [0]} for t in ok)
    assert not any(machine.scan([w.encode() for w in t.split()]) for t in bad)


def test_markup_errors():
    for markup in ("[[a", "a]]", "[[a]] b"):
        with pytest.raises(ValueError):
            lic.Automaton({"x": markup}) if markup != "[[a]] b" else lic.Automaton({"x": "{{*0-2}} b"})
