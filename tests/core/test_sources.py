import time

import pytest
from pyspark.sql import functions as F

from arcspan.plans import config, report, scan
from arcspan.sources import files, gitlog, parse, resolve
from arcspan.streaming import watch

PROJECT = {
    "src/app/main.ts": "import { a } from '@/features/a/index'\nimport './style.css'\nimport React from 'react'\nexport const x = 1\n",
    "src/features/a/index.ts": "export * from './one'\nexport * from './two'\n",
    "src/features/a/one.ts": "import { two } from './two'\nimport type { T } from '../../core/t'\nexport function one() { return two }\n",
    "src/features/a/two.ts": "import { one } from './one' // import 'no'\nexport const two = () => import('../../core/lazy')\n",
    "src/core/t.ts": "import { x } from '../app/main'\nexport type T = string\n",
    "src/core/lazy.ts": "const m = import.meta.glob(['../features/**/*.ts', '!../features/**/two.ts'])\nexport default m\n",
    "src/core/dyn.ts": "export const load = (n: string) => import(`../features/a/${n}.ts`)\nimport './missing'\n",
    "src/core/Big.vue": "<template><my-card/></template><script setup lang=\"ts\">import { one } from '../features/a/one'\nonMounted(async () => { await one() })\nwindow.addEventListener('x', one)</script>",
    "src/shared/MyCard.vue": "<template><div/></template><script>export default {}</script>",
    "src/app/main.test.ts": "import './main'",
}


def test_scan_of_a_project(spark):
    s = scan.analyse(spark, files.in_memory(spark, PROJECT), aliases=[("@/*", "src/*")])
    got = {(r.src, r.dst, r.kind) for r in s.edges.collect()}
    assert ("src/app/main.ts", "src/features/a/index.ts", "static") in got and ("src/features/a/one.ts", "src/core/t.ts", "type-only") in got
    assert ("src/core/lazy.ts", "src/features/a/one.ts", "dynamic") in got and not any(a == "src/core/lazy.ts" and b.endswith("two.ts") for a, b, _ in got)
    assert ("src/core/dyn.ts", "src/features/a/two.ts", "dynamic") in got and ("src/core/Big.vue", "src/shared/MyCard.vue", "dynamic") in got
    assert {tuple(r.modules) for r in s.cycles.collect()} >= {("src/core/lazy.ts", "src/features/a/index.ts", "src/features/a/one.ts", "src/features/a/two.ts")}
    assert {(r.src, r.dst) for r in s.violations.collect()} >= {("src/core/t.ts", "src/app/main.ts")}
    assert [r.detail for r in s.warnings.collect()] == ["./missing"]
    assert not s.modules.where("id LIKE '%test%'").count()
    assert '"schema": 1' in report.as_json(s) and "# Architecture report" in report.as_markdown(s) and "<testsuite" in report.as_junit(s) and "<pre>" in report.as_html(s)
    assert report.check(s, ["cycles:any"])[0] == 1 and report.check(s, ["nonsense"])[0] == 2 and report.check(s, ["cycles:>50"])[0] == 0
    assert report.explain(s, "src/core/t.ts")["importers"][0]["src"] == "src/features/a/one.ts" and report.explain(s, "project")["modules"] == 9
    assert scan.compared(s, s).where("change NOT IN ('existing')").count() == 0


def test_files_on_disk_equal_files_in_memory(spark, tmp_path):
    for name, text in PROJECT.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "notes.txt").write_text("no")
    got = {r.rel_path: r.content for r in files.read(spark, str(tmp_path)).collect()}
    assert got == PROJECT


@pytest.mark.parametrize("text, want", [
    ("import a from 'x'", [("static", "x")]), ("import type { T } from 'x'", [("type-only", "x")]), ("import { type A, type B } from 'x'", [("type-only", "x")]), ("import { type A, b } from 'x'", [("static", "x")]),
    ("export { a } from './x'", [("re-export", "./x")]), ("import 'x'", [("side-effect", "x")]), ("const a = require('x')", [("static", "x")]), ("import('x')", [("dynamic", "x")]), ("// import 'x'\n/* import 'y' */", []),
    ("const s = \"import 'x'\"", []), ("import(`./a/${b}`)", [("dynamic", "./a/")]), ("import type from 'x'", [("static", "x")]),
])
def test_import_forms(text, want):
    assert [(i["kind"], i["specifier"]) for i in parse.parse_text("a.ts", text)["imports"]] == want


def test_parsed_details():
    p = parse.parse_text("a.ts", "'use client'\nexport const a = 1\nexport default function b() {}\nexport { c as d, type E }\nuseThing(); defineStore('x')")
    assert p["directives"] == ["use client"] and p["exports"] == ["a", "b", "d", "E", "default"] and p["calls"] == ["useThing"] and p["defines_store"] and p["loc"] == 5
    assert parse.parse_text("a.ts", "")["loc"] == 0


def test_oversized_files_are_reported(spark):
    rows = files.in_memory(spark, {"a.ts": "x" * 30, "b.ts": "import 'x'"})
    assert parse.parse(rows, 20).count() == 1 and parse.unparsed(rows, 20).first().file == "a.ts"


def test_probe_order(spark):
    known = spark.createDataFrame([(p,) for p in ("a.ts", "a.tsx", "b/index.js", "b.vue", "c", "c.ts")], "rel_path string")
    wanted = spark.createDataFrame([("x.ts", s) for s in ("./a", "./b", "./c", "./a.tsx", "./zz", "../../a", "vue")], "src string, specifier string")
    assert {r.specifier: r.dst for r in resolve.resolve(wanted, known).collect()} == {"./a": "a.ts", "./b": "b.vue", "./c": "c", "./a.tsx": "a.tsx", "./zz": None, "../../a": "a.ts", "vue": None}


def test_configuration_files():
    store = {"tsconfig.json": '{ // base\n "extends": "./base", }', "base.json": '{"compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["*"], "~x": ["x/index.ts"]}}}'}
    assert resolve.tsconfig_aliases(store.get) == [("@/*", "src/*"), ("~x", "src/x/index.ts")]
    assert resolve.tsconfig_aliases({"tsconfig.json": '{"extends": "./tsconfig.json"}'}.get) == []
    assert ("@/*", "src/*") in resolve.vite_aliases("export default { resolve: { alias: { '@': path.resolve(__dirname, './src') } } }")
    assert resolve.framework('{"dependencies": {"vue": "3", "nuxt": "3"}}') == "nuxt" and resolve.framework("{}") == "generic"
    good, problems = config.load('{"layers": {"src/x/**": "core", "y": "nope"}, "budgets": [{"name": "b", "module": "**", "maxLoc": 5}], "hotZones": 0, "what": 1}')
    assert good.layers == {"src/x/**": "core"} and good.budgets[0].limits == {"loc": 5} and len(problems) == 3
    assert config.load("{")[1] and config.type_only("import { A } from 'x'") == "import type { A } from 'x'"
    assert config.load(config.initial(["core"], ["src/main.ts"]))[1] == []


def test_git_log(spark, tmp_path):
    log = f"{gitlog.SENTINEL}abc\x01A@B.c\x01Ann\x012024-03-01T00:00:00Z\x01first\n\n3\t1\tsrc/a.ts\n-\t-\timg.png\n2\t0\tsrc/{{x => y}}/b.ts\n0\t0\told.ts => new.ts\n{gitlog.SENTINEL}def\x01b@b.c\x01Bo\x012024-01-01T00:00:00Z\x01second\n"
    (tmp_path / "log.txt").write_text(log)
    commits, changes = gitlog.read(spark, str(tmp_path / "log.txt"))
    assert {(r.sha, r.author) for r in commits.collect()} == {("abc", "a@b.c"), ("def", "b@b.c")}
    assert {tuple(r)[1:] for r in changes.collect()} == {("src/a.ts", None, 3, 1), ("img.png", None, None, None), ("src/y/b.ts", "src/x/b.ts", 2, 0), ("new.ts", "old.ts", 0, 0)}
    assert gitlog.within(commits, "5w", "2024-03-10T00:00:00Z").count() == 1 and gitlog.since_days("3m") == 90
    with pytest.raises(ValueError):
        gitlog.since_days("soon")


def test_discovery(spark):
    rows = spark.createDataFrame([(p,) for p in ("src/a.ts", "node_modules/x.ts", "src/a.test.ts", "a.stories.tsx", "x.d.ts", "vite.config.ts", "src/gen/a.ts", "readme.md")], "rel_path string")
    assert [r.rel_path for r in files.discover(rows, exclude=["src/gen/**"]).collect()] == ["src/a.ts"]


def test_watching_a_folder(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    rows = [(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:00:05", "b"), (1, "2024-01-01 00:01:00", "a"), (9, "2024-01-01 02:00:00", "z")]
    schema = "watch_id long, ts timestamp, path string"
    spark.createDataFrame(rows, "watch_id long, ts string, path string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("overwrite").json(str(src))
    stream = watch.debounced(spark.readStream.schema(schema).json(str(src)), "10 seconds", "1 minute")
    q = watch.on_batches(stream, lambda batch, n: batch, str(out), str(tmp_path / "ck"))
    try:
        end = time.time() + 90
        while time.time() < end and not (out.exists() and spark.read.json(str(out)).count() >= 2):
            q.processAllAvailable()
            time.sleep(0.5)
    finally:
        q.stop()
    got = {tuple(r.paths) for r in spark.read.json(str(out)).collect()}
    assert {("a", "b"), ("a",)} <= got


def test_single_flight():
    runs = []

    def run(reason):
        runs.append(reason)
        if reason == "first":
            flight.request("second")
            flight.request("third")

    flight = watch.SingleFlight(run)
    flight.request("first")
    assert runs == ["first", "third"]


def test_cache_outcomes():
    key = watch.cache_key(root="a", config={"x": 1})
    assert key == watch.cache_key(config={"x": 1}, root="a") and len(key) == 24
    assert [watch.cache_outcome(*x) for x in ((None, key, {}), ("old", key, {}), (key, key, {}), (key, key, {"changed": 2}), (key, key, {"added": 1}))] == ["miss", "invalidated", "fresh", "incremental", "invalidated"]
    assert watch.needs_full_scan(0, 0, False, True) and not watch.needs_full_scan(0, 0, False, False)
