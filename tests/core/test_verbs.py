from test_sources import PROJECT

from arcspan.operators import findings, graph
from arcspan.plans import config, scan, verbs
from arcspan.sources import files


def test_verbs(spark, tmp_path):
    sources = files.in_memory(spark, PROJECT)
    now = scan.analyse(spark, sources, aliases=[("@/*", "src/*")])
    verbs.baseline(now, str(tmp_path), "p", "1")
    again = verbs.stored(spark, str(tmp_path), "p", "1")
    assert verbs.diff(again, now).where("change <> 'existing'").count() == 0
    assert verbs.trend(again, now).first().direction == "stable"
    assert config.load(verbs.init(now))[0].layers == {f"src/{x}/**": x for x in ("app", "core", "features", "shared")}
    less = {k: v for k, v in PROJECT.items() if k != "src/core/lazy.ts"}
    then = scan.analyse(spark, files.in_memory(spark, less), aliases=[("@/*", "src/*")])
    got = {(r.what, r.change): r.n for r in verbs.diff(then, now).collect()}
    assert got["modules", "added"] == 1 and got["cycles", "new"] >= 1 and got["cycles", "resolved"] >= 1
    assert {r.status for r in verbs.signals_since(then, now).collect()} <= {"new", "existing", "regressed", "resolved"}
    assert {r.id for r in verbs.targets(now, "core").collect()} == {k for k in PROJECT if k.startswith("src/core/")}
    assert verbs.targets(now, "src/app/main.ts").count() == 1 and verbs.targets(now, "nowhere").count() == 0
    near = verbs.impact(now, "src/core/t.ts", 1, "dependents").collect()
    assert [r.id for r in near] == ["src/features/a/one.ts"]
    assert verbs.impact(now, "core", 2, group="layer").count() > 0
    assert verbs.matrix(now).count() > 0 and verbs.ownership(now).count() > 0 and verbs.semantic(now).count() > 0 and verbs.suggest(now).count() > 0
    assert {r.list for r in verbs.hygiene(now).collect()} >= {"side-effect-owner"}
    assert verbs.check(now, ["cycles:any"])[0] == 1 and verbs.explain(now, "nothing") == {}
    everything = findings.union(now.cycles, now.violations, now.contracts, now.hot, now.recommendations)
    assert findings.triaged(everything, ["cycle"], "high").count() <= findings.triaged(everything).count() == everything.count()
    assert findings.in_change_set(everything, now.modules.where("id = 'src/core/t.ts'")).where("in_change_set").count() > 0
    assert findings.counts(everything).count() >= 3


def test_type_only_candidates(spark):
    texts = {"a.ts": "import { B } from './b'\nimport { run } from './b'\nexport type A = string\nlet x: B = make()\nconst y = z as B", "b.ts": "import { A } from './a'\nexport class B {}\nexport const run = (a: A) => new A()"}
    s = scan.analyse(spark, files.in_memory(spark, texts))
    got = findings.type_only_candidates(files.in_memory(spark, texts).withColumnRenamed("rel_path", "id"), s.edges, graph.scc(s.edges)).collect()
    assert [(r.src, r.names) for r in got] == [("a.ts", "B")]
    assert not s.members.count() and s.recommendations.where("kind = 'type-only-candidate'").count() == 1


def test_hot_zone_severities(spark):
    hot = spark.createDataFrame([(c, 9.0 - k) for k, c in enumerate("abcd")], "id string, hotness double")
    assert {r.id: r.severity for r in findings.hot_severity(hot).collect()} == {"a": "high", "b": "high", "c": "medium", "d": "medium"}
    none = findings.unsuppressed(spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("x", True), ("y", False)], "recommendation string, suppressed boolean"))
    assert [r.id for r in none.collect()] == ["y"]
