"""Rescans through the cache equal full scans; only what changed is parsed."""

import pytest

from arcspan.plans import config, scan, store, verbs
from arcspan.sources import files, parse

FILES = {
    "src/a.ts": "import { b } from './b'\nimport { late } from './late'\nexport const a = b",
    "src/b.ts": "import { a } from './a'\nimport x from '@lib/x'\nexport const b = a",
    "lib/x/index.ts": "export default 1",
    "src/glob.ts": "const all = import.meta.glob('./parts/*.ts')",
    "src/parts/one.ts": "import type { a } from '../a'\nexport const one = 1",
    "src/types.ts": "import { U } from './user'\nexport type T = U",
    "src/user.ts": "import { T } from './types'\nexport const U = (t: T) => new T()",
}
ALIASES = [("@lib/*", "lib/*")]
STEPS = [
    ({}, "fresh", set()),
    ({"src/late.ts": "import { a } from './a'\nexport const late = a", "lib/x.ts": "export default 2"}, "incremental", {"src/late.ts", "lib/x.ts"}),  # found by files that aren't parsed
    ({"lib/x.ts": None, "src/parts/two.ts": "export const two = 2", "src/parts/one.ts": None, "src/b.ts": "import x from '@lib/x'\nimport './parts/one'"}, "incremental", {"src/parts/two.ts", "src/b.ts"}),
    ({"src/user.ts": "import { T } from './types'\nlet t: T"}, "incremental", {"src/user.ts"}),
]


def graph(base):
    edges = {tuple(r) for r in base.edges.select("ord", "src", "dst", "kind", "specifier", "confidence").collect()}
    rest = (base.modules.select("id", "kind", "loc"), base.warnings, base.probed, base.quality, base.facts, base.lifecycles)
    return edges, *({tuple(r) for r in t.collect()} for t in rest)


def test_steps(spark, tmp_path, monkeypatch):
    parsed = []
    real = parse.parse

    def counted(rows, *a, **k):
        parsed.append({r.rel_path for r in rows.select("rel_path").collect()})
        return real(rows, *a, **k)

    monkeypatch.setattr(parse, "parse", counted)
    now, place = dict(FILES), str(tmp_path / "cache")
    _, outcome = store.refreshed(spark, files.in_memory(spark, now), place, aliases=ALIASES)
    assert outcome == "miss" and parsed.pop() == set(FILES)
    for change, want, read in STEPS:
        now = {k: v for k, v in (now | change).items() if v is not None}
        got, outcome = store.refreshed(spark, files.in_memory(spark, now), place, aliases=ALIASES)
        assert (outcome, parsed) == (want, [read] if read else [])
        parsed.clear()
        assert graph(got) == graph(scan.read(files.in_memory(spark, now), config.Config(), ALIASES, "generic")), change
        parsed.clear()
    settings = config.load('{"layers": {"lib/**": "core"}}')[0]
    got, outcome = store.refreshed(spark, files.in_memory(spark, now), place, settings, aliases=ALIASES)
    assert outcome == "invalidated" and parsed == [set(now)]
    assert store.noted(spark, f"{place}/key")["key"] and store.noted(spark, f"{place}/nothing") == {}


def test_stored_scan_keeps_its_framework(spark, tmp_path):
    s = scan.analyse(spark, files.in_memory(spark, {"app/page.ts": "import '../lib/x'", "lib/x.ts": "export const x = 1"}), framework="next")
    verbs.baseline(s, str(tmp_path), "p", "1")
    again = verbs.stored(spark, str(tmp_path), "p", "1")
    assert again.framework == "next" and {tuple(r) for r in again.risks.select("id", "risk").collect()} == {tuple(r) for r in s.risks.select("id", "risk").collect()}


def test_project_folder(spark, tmp_path, monkeypatch):
    texts = {
        "package.json": '{"dependencies": {"vue": "3"}, "imports": {"#k": "./src/k.ts"}}', "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./src/*", "./more/*"]}}}',
        "packages/ui/package.json": '{"name": "@o/ui", "exports": "./index.ts"}', "packages/ui/index.ts": "export const ui = 1", "index.html": "<script type='module' src='/src/start.ts'></script>",
        "src/start.ts": "import '#k'\nimport { ui } from '@o/ui'\nimport m from '@/m'\nexport const s = 1", "src/k.ts": "", "more/m.ts": "export default 1", ".gitignore": "junk/", "junk/j.ts": "",
        "dist/stats.json": '{"chunks": [{"id": 1, "modules": [{"name": "./src/start.ts", "size": 900000}]}]}', "dist/out.ts": "x",
    }
    for name, text in texts.items():
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_text(text)
    s = verbs.scan(spark, str(tmp_path / "p"), cache=str(tmp_path / "cache"))
    assert s.framework == "vue" and {(r.src, r.dst) for r in s.edges.collect()} == {("src/start.ts", x) for x in ("src/k.ts", "packages/ui/index.ts", "more/m.ts")}
    assert {r.kind for r in s.bundle.collect()} == {"heavy-chunk", "solo-hot"} and "junk/j.ts" not in {r.id for r in s.modules.collect()}
    assert verbs.check(s, ["bundle-bloat:high"])[0] == 1
    # nothing changed: what was found is read, nothing is made again
    monkeypatch.setattr(store, "measured", lambda *a: 1 / 0)
    monkeypatch.setattr(parse, "parse", lambda *a: 1 / 0)
    again = verbs.scan(spark, str(tmp_path / "p"), cache=str(tmp_path / "cache"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert all(rows(again.tables()[k]) == rows(t) for k, t in s.tables().items()) and again.tables().keys() == s.tables().keys()


@pytest.mark.parametrize("text, problem", [('{"loaders": [{"name": "x"}]}', "loaders[0]"), ('{"suppressions": [{"stableKey": 1}]}', "suppressions[0]"), ('{"generatedMode": "maybe"}', "generatedMode"), ('{"git": {"window": "soon"}}', "git.window")])
def test_configuration_problems(text, problem):
    assert config.load(text)[1][0].startswith(problem)
