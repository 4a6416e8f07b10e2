"""Parts of a scan: type-only erasure, facts, loaders, lifecycle scopes, aliases."""

import random
import time

import pytest

from arcspan.operators import graph, lifecycle, recommend
from arcspan.plans import config, report, scan, verbs, views
from arcspan.sources import aliases, facts, files, parse, resolve
from arcspan.sources.typeuse import type_only_names


def components(pairs):
    """Members of cycles by reach, without any search order: ``{id: smallest of its component}``."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    ways = {x: reach(x) for x in out}
    return {x: min(y for y in ways[x] if x in ways.get(y, ())) for x in ways if x in ways[x]}


def test_erasure_equals_a_new_search(spark):
    """Rings of 3 to 30 members with chords; some lose edges, some don't, some edges stand twice."""
    r, edges, erased = random.Random(5), [], []
    for ring in range(40):
        n = r.randrange(3, 31)
        name = [f"r{ring:02}/m{k:02}" for k in range(n)]
        links = [(name[k], name[(k + 1) % n]) for k in range(n)] + [(r.choice(name), r.choice(name)) for _ in range(n // 3)]
        edges += [(a, b, s, "static") for a, b in links for s in ("./x", "./y")[: 1 + (r.random() < 0.2)]]
        if ring % 3:
            erased += [e[:3] for e in edges[-len(links) :] if r.random() < 0.15]
    edges += [("r00/m00", "r01/m00", "./z", "static"), ("a", "b", "./t", "type-only"), ("b", "a", "./t", "static")]
    erased.append(("a", "b", "./t"))
    e = spark.createDataFrame(edges, "src string, dst string, specifier string, kind string")
    gone = spark.createDataFrame(erased, "src string, dst string, specifier string")
    members = graph.scc(e)
    got = {x.id: x.comp for x in graph.scc_after(e, members, gone).collect()}
    assert got == components([(a, b) for a, b, s, k in edges if k != "type-only" and (a, b, s) not in set(erased)])
    assert {x.id: x.comp for x in graph.scc_after(e, members, gone.where("false")).collect()} == {x.id: x.comp for x in members.collect()}


TYPED = [
    "let x: B = make()", "const y = z as B", "function f(a: B, c?: B[]): B { return a }", "interface X extends B { b: B }", "type T = B | { a: B }", "class C implements B { m: B; n?: Map<string, B> = new Map<string, B>() }",
    "const f = async (a: B): Promise<B> => { return a }", "useState<B>(null)", "x satisfies B", "class A { constructor(private readonly b: B) {} get(x: B): B { return x } }", "function g<T>(a: T): a is B { return true }",
]
VALUED = [
    "new B()", "const o = { a: B }", "cond ? x : B", "class C extends B {}", "let x: typeof B", "export { B }", "B.run()", "foo(B)", "<B/>", "let x: B = B", "switch (x) { case B: }", "a < B", "const t = `${B}`", "type T = typeof B", "a ? (b) : B", "",
]


@pytest.mark.parametrize("code, typed", [*((c, True) for c in TYPED), *((c, False) for c in VALUED)])
def test_type_positions(code, typed):
    assert type_only_names("a.ts", f"import {{ B }} from './b'\n{code}", "./b") == (["B"] if typed else [])


PROJECT = {
    "src/core/a.ts": "import { B } from './b'\nexport class A { b: B }\n",
    "src/core/b.ts": "import { A } from './a'\nexport const B = () => new A()\n",
    "src/core/c.ts": "import { d } from './d'\nexport const c = d\n",
    "src/core/d.ts": "import { c } from './c'\nexport const d = c\nloadView('big')\n",
    "src/views/big.ts": "export const big = 1\n",
    "src/gen/x.ts": "import { big } from '../views/big'\nexport const x = big\n",
    "src/pages/p.tsx": "'use client'\nuseEffect(() => { window.addEventListener('x', f) })\nuseEffect(() => { const t = setInterval(f); return () => clearInterval(t) })\nuseEffect(() => {\n  fetch(u).then(set)\n})\nuseEffect(() => { let stale = false; fetch(u).then(set) })\nimport './style.css'\nimport { secret } from '../core/s.server'",
    "src/core/s.server.ts": "setInterval(f)\nexport const secret = 1",
}
SETTINGS = {
    "loaders": [{"name": "loadView", "resolveAs": "../views/{0}"}], "generated": ["src/gen/**"], "budgets": [{"name": "small", "module": "src/pages/**", "maxLoc": 3}],
    "boundaries": [{"name": "no-views", "from": "src/gen/**", "to": "src/views/**"}], "hotZones": 2,
}


@pytest.fixture(scope="module")
def whole(spark):
    settings, problems = config.load(__import__("json").dumps(SETTINGS))
    assert not problems
    chunks = spark.createDataFrame([("main", "src/views/big.ts", 600_000), ("other", "src/views/big.ts", 5_000)], "chunk_id string, path string, size long")
    return scan.analyse(spark, files.in_memory(spark, PROJECT), settings, framework="react", chunks=chunks)


def test_whole(spark, whole):
    s = whole
    assert {tuple(r.modules) for r in s.cycles.collect()} == {("src/core/c.ts", "src/core/d.ts")}  # a imports only a type of b
    recs = {(r.kind, tuple(r.modules)) for r in s.recommendations.collect()}
    assert ("type-only-candidate", ("src/core/a.ts", "src/core/b.ts")) in recs
    assert ("src/core/d.ts", "src/views/big.ts", "dynamic") in {(r.src, r.dst, r.kind) for r in s.edges.collect()}
    assert {r.id for r in s.modules.where("is_generated").collect()} == {"src/gen/x.ts"}
    rules = [(r.rule, r.src, r.dst) for r in s.contracts.orderBy("ord").collect()]
    assert rules == [("rsc-leak", "src/pages/p.tsx", "src/core/s.server.ts"), ("no-views", "src/gen/x.ts", "src/views/big.ts"), ("small", "src/pages/p.tsx", None)]
    assert [(r.rule, r.metric, r.value) for r in s.budgets.collect()] == [("small", "loc", 9)]
    risks = {(r.id, r.kind, r.line, r.confidence) for r in s.base.lifecycles.collect()}
    assert risks == {("src/pages/p.tsx", "event-listener-cleanup", 2, "high"), ("src/pages/p.tsx", "async-effect-cleanup", 4, "high")}
    kinds = {r.kind: r for r in s.signals.collect()}
    assert {"memory-risk", "async-lifecycle-risk", "type-only-candidate", "contract-violation"} <= kinds.keys() and "warning:resolve-failed" not in kinds
    assert {(r.kind, r.severity) for r in s.bundle.collect()} >= {("heavy-chunk", "low"), ("duplicate", "low"), ("solo-hot", "high")}
    got = {g["gate"]: g["failed"] for g in report.check(s, ["bundle-bloat:high", "cycles:0", "cycles:1", "contract-errors:2", "contract-violations:3", "signals:medium", "signals:critical"])[1]}
    assert got == {"bundle-bloat:high": True, "cycles:0": True, "cycles:1": False, "contract-errors:2": True, "contract-violations:3": False, "signals:medium": True, "signals:critical": False}


def test_suppressions(spark, whole):
    key = whole.signals.where("kind = 'contract-violation' AND array_contains(modules, 'src/gen/x.ts')").first().stable_key
    hide = lambda **x: {r.stable_key for r in recommend.suppressed_by(whole.signals.drop("suppressed"), ({"stableKey": key, **x},), "2024-05-01").where("suppressed").collect()}
    assert hide() == {key} == hide(expires="2024-06-01") == hide(module="src/gen/x.ts") and hide(expires="2024-04-01") == hide(module="src/pages/p.tsx") == set()


def test_facts(spark):
    texts = {
        "app/page.tsx": "'use server'\nimport a from './x.png?url'\nexport default 1\nexport const q = 1", "pages/api/u.ts": "const g = import.meta.glob(['./*.ts', '!./no.ts'], { eager: true })\nimport(`./v/${x}.ts`)",
        "server/z.ts": "", "plain.ts": "defineStore('a')\nimport('./y')",
    }
    parsed = parse.parse(files.in_memory(spark, texts))
    got = {(r.id, r.fact, r.kind, r.confidence) for r in facts.facts(facts.summarised(parsed, "next")).collect()}
    assert got == {
        ("app/page.tsx", "runtime", "server", "high"), ("app/page.tsx", "route", "page", "medium"), ("app/page.tsx", "asset", "image", "high"), ("app/page.tsx", "export", "default", "medium"), ("app/page.tsx", "export", "named", "medium"),
        ("pages/api/u.ts", "runtime", "shared", "low"), ("pages/api/u.ts", "route", "api", "medium"), ("server/z.ts", "runtime", "shared", "high"), ("plain.ts", "runtime", "shared", "low"), ("plain.ts", "state", "pinia-store", "high"),
    }
    rows = {(r.id, r.specifier): (r.resolution, r.confidence, r.approximate, r.negative) for r in facts.import_facts(parsed).collect()}
    assert rows["pages/api/u.ts", "!./no.ts"] == ("glob", "medium", True, True) and rows["pages/api/u.ts", "./v/"] == ("prefix", "medium", True, False)
    assert rows["plain.ts", "./y"] == ("dynamic-literal", "high", False, False) and rows["app/page.tsx", "./x.png?url"][0] == "asset"
    quality = {r.id: (r.n_approximate, r.n_low, r.n_limitations) for r in facts.quality(facts.summarised(parsed, "next")).collect()}
    assert quality == {"app/page.tsx": (0, 0, 1), "pages/api/u.ts": (3, 0, 2)}


def test_doubt_lowers_confidence(spark):
    recs = spark.createDataFrame([("c", "cycle-break-cluster", ["a"], None, 0.5), ("d", "cycle-break-cluster", ["b"], None, 0.5), ("e", "cycle-break-cluster", ["z"], None, 0.5)], "id string, kind string, modules array<string>, params map<string,string>, weight double")
    doubt = spark.createDataFrame([("a", 1, 0, 0), ("b", 0, 0, 2)], "id string, n_approximate long, n_low long, n_limitations long")
    got = {r.recommendation: (r.confidence, r.score) for r in recommend.signals(recs, doubt).collect()}
    assert {k: v[0] for k, v in got.items()} == {"c": "medium", "d": "high", "e": "high"} and got["e"][1] - got["d"][1] == 3


@pytest.mark.parametrize("framework, code, want", [
    ("vue", "onMounted(() => { const t = setInterval(f) })\nonUnmounted(() => clearInterval(t))", set()),
    ("vue", "onMounted(() => { o = new ResizeObserver(f) })\nfunction stop() { o.disconnect() }", {("observer-cleanup", 1)}),
    ("vue", "onMounted(async () => {\n await load() })", {("async-effect-cleanup", 1)}), ("vue", "onMounted(async () => { await load() })\nonUnmounted(() => { c.abort() })", set()),
    ("svelte", "onMount(function () { s = store.subscribe(f); return () => s.unsubscribe() })", set()), ("svelte", "onMount(() => { if (x) { return () => stop() }\n store.subscribe(f) })", {("subscription-cleanup", 2)}),
    ("react", "window.addEventListener('x', f)", set()), ("react", "useEffect(() => { setTimeout(f, 1) })", set()), ("react", "useEffect(() => { const t = setTimeout(f, 1) })", {("timer-cleanup", 1)}),
    ("react", "useEffect(() => { const u = URL.createObjectURL(b); return () => URL.revokeObjectURL(u) })", set()), ("react", "useEffect(() => go())", set()),
    ("generic", "window.addEventListener('x', f)\nawait fetch(u)", {("event-listener-cleanup", 1)}), ("generic", "addEventListener('x', f); removeEventListener('x', f)", set()), ("generic", "// addEventListener('x')", set()),
])
def test_lifecycle_scopes(spark, framework, code, want):
    rows = parse.parse(files.in_memory(spark, {"a.ts": code})).selectExpr("rel_path AS id", "'shared' AS runtime", "marks")
    found = lifecycle.risks(rows, framework).collect()
    assert {(r.kind, r.line) for r in found} == want and {r.confidence for r in found} <= {"medium" if framework == "generic" else "high"}


def test_aliases(spark):
    many = [(f"@p{k}/*", [f"@p{(k + 1) % 50}/*", f"packages/p{k}/src/*"]) for k in range(50)]
    declared = [*many, ("@x/*", "@y/*"), ("@y/*", "@x/*"), ("#cfg", "./config/main.ts"), ("~*", "lib/*"), ("@ui/*", ["nowhere/*", "src/ui/*.ts"]), ("*", "base/*"), ("@ui/core/*", "core/*"), ("@long/*", "@ui/*")]
    known = ["packages/p7/src/a.ts", "config/main.ts", "lib/q/index.ts", "src/ui/button.ts", "base/deep/x.ts", "core/k.vue"]
    want = {"@p7/a": known[0], "@p3/a": known[0], "@x/a": None, "#cfg": known[1], "~q": known[2], "@ui/button": known[3], "deep/x": known[4], "@ui/core/k": known[5], "@long/button": known[3], "@long/core/k": known[5], "#cfg/x": None}
    imports = spark.createDataFrame([("m.ts", s) for s in want], "src string, specifier string")
    began = time.time()
    rows = resolve.resolve(imports, spark.createDataFrame([(p,) for p in known], "rel_path string"), declared)
    assert time.time() - began < 5
    assert {r.specifier: r.dst for r in rows.collect()} == want


def test_package_aliases():
    text = '{"name": "@o/ui", "exports": {".": {"import": "./src/index.ts", "default": "./dist/index.js"}, "./theme": ["./src/theme.ts"], "./parts/*": "./src/parts/*.ts", "./*": "./src/*"}}'
    assert aliases.package_aliases("packages/ui/package.json", text) == [("@o/ui", ["packages/ui/src/index.ts", "packages/ui/dist/index.js"]), ("@o/ui/theme", ["packages/ui/src/theme.ts"]), ("@o/ui/parts/*", ["packages/ui/src/parts/*"])]
    assert aliases.package_aliases("p/package.json", '{"name": "q"}') == [("q", ["p/src", "p"]), ("q/*", ["p/src/*", "p/*"])]
    assert aliases.package_aliases("package.json", '{"name": "root", "imports": {"#a/*": "./src/a/*.js", "#b": "./b.ts", "c": "./c"}}') == [("#a/*", ["src/a/*"]), ("#b", ["b.ts"])]
    assert aliases.package_aliases("p/package.json", "{") == [] and aliases.package_aliases("p/package.json", "{}") == []


def test_fix_plan(spark):
    """By hand: a tenth for what is generated as a whole, nothing of tests, groups by their own first ones."""
    frame = spark.createDataFrame
    rings = frame([("cycle:1", 2, "direct", ["a/index.ts", "a/x.ts"]), ("cycle:2", 3, "indirect", ["gen/a.ts", "gen/b.ts", "gen/c.ts"]), ("cycle:3", 9, "indirect", ["t/a.test.ts"])], "id string, length long, severity string, modules array<string>")
    lines = frame([("e1", "1", "a.ts", "b.ts", "error"), ("e2", "2", "a.ts", "__tests__/b.ts", "error"), ("e3", "3", "gen/a.ts", "b.ts", "warning")], "edge_id string, ord string, src string, dst string, severity string")
    dead = frame([("old.ts", 100), ("tiny.ts", 1), ("huge.ts", 5000)], "id string, loc long")
    contracts = frame([("k1", "0", "a.ts", None, "warning")], "id string, ord string, src string, dst string, severity string")
    hot = frame([("a.ts", 3.0), ("b.ts", 30.0)], "id string, hotness double")
    recs = frame([("r1", 0.7, ["a.ts"]), ("r2", 0.9, ["x/fixtures/y.ts"])], "id string, weight double, modules array<string>")
    found = views.fix_findings(rings, lines, dead, contracts, hot, recs)
    got = [(r.type, r.id, round(r.weight, 3), r.generated, ",".join(r.groups)) for r in views.fix_plan(found, frame([("gen/a.ts",), ("gen/b.ts",), ("gen/c.ts",)], "id string"), group=2).orderBy("place").collect()]
    assert got == [
        ("cycle", "cycle:1", 100.0, False, "high-impact,review-before-change"), ("barrel-cycle", "cycle:1:barrel", 92.0, False, "safe-first,high-impact"), ("layer-violation", "e1", 88.0, False, "review-before-change"),
        ("move-module", "e1:move", 84.0, False, ""), ("hot-zone", "b.ts", 80.0, False, ""), ("unreachable-from-entries", "huge.ts:unreachable", 70.0, False, "safe-first"), ("layer-violation", "e3", 66.0, False, ""),
        ("contract-violation", "k1", 64.0, False, ""), ("move-module", "e3:move", 58.0, False, ""), ("unreachable-from-entries", "old.ts:unreachable", 45.0, False, ""), ("unreachable-from-entries", "tiny.ts:unreachable", 35.1, False, ""),
        ("hot-zone", "a.ts", 30.0, False, ""), ("cycle", "cycle:2", 8.2, True, ""), ("recommendation", "r1", 0.7, False, ""),
    ]


def test_fix_plan_of_a_scan(whole):
    types = {r.type for r in verbs.fix_plan(whole).collect()}
    assert types >= {"cycle", "contract-violation", "hot-zone", "recommendation"}


def test_reports_of_a_scan(spark, whole, tmp_path):
    assert report.summary(whole)["status"] == "blocking"
    found = whole.signals.where("kind = 'contract-violation'").first()
    told = report.explain(whole, found.id)
    assert told["signal"]["stable_key"] == found.stable_key and told["findings"][0]["id"] == found.recommendation and {m["id"] for m in told["modules"]} == set(found.modules)
    assert report.explain(whole, "signal:nothing") == {}
    alone, again = verbs.review(whole).first(), verbs.review(whole, whole).first()
    assert alone == again and alone.level in ("high", "critical")
    verbs.save(whole, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/edges").count() == whole.edges.count() and (tmp_path / "facts").exists()
