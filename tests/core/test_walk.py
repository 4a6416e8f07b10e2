"""The walk: ignore files, folders never read, names that look like patterns."""

import fnmatch
import random

import pytest

from arcspan.sources import files


def by_hand(paths, rules):
    """Ignored paths, folder by folder as a walk meets them; ``rules``: folder -> lines."""

    def fits(pattern, node):
        """A pattern against one path (folders end in a slash), segment by segment."""
        if pattern.endswith("/") and not node.endswith("/"):
            return False
        want, have = pattern.strip("/").split("/"), node.strip("/").split("/")
        if "/" not in pattern.rstrip("/"):
            return fnmatch.fnmatchcase(have[-1], want[0])

        def meet(w, h):
            if not w:
                return not h
            if w[0] == "**":
                return bool(h) if len(w) == 1 else any(meet(w[1:], h[k:]) for k in range(len(h) + 1))
            return bool(h) and fnmatch.fnmatchcase(h[0], w[0]) and meet(w[1:], h[1:])

        return meet(want, have)

    def ignores(node):
        verdict = False
        folder = ""
        for piece in ["", *node.rstrip("/").split("/")[:-1]]:
            folder = f"{folder}/{piece}".strip("/")
            for line in rules.get(folder, ()):
                if line and not line.startswith("#") and fits(line.removeprefix("!"), node[len(folder) + 1 if folder else 0 :]):
                    verdict = not line.startswith("!")
        return verdict

    out = set()
    for p in paths:
        parts = p.split("/")
        if any(ignores("/".join(parts[:k]) + "/") for k in range(1, len(parts))) or ignores(p):
            out.add(p)
    return out


def ignored(spark, paths, rules):
    rows = [(folder, n, line) for folder, lines in rules.items() for n, line in enumerate(lines)]
    table = spark.createDataFrame(rows, "folder string, n int, pattern string")
    return {r.rel_path for r in files.ignored_paths(spark.createDataFrame([(p,) for p in paths], "rel_path string"), table).collect()}


def test_nested_and_negated(spark):
    paths = ["a.ts", "gen/a.ts", "gen/keep.ts", "src/gen/a.ts", "src/x/a.ts", "src/x/b.ts", "src/x/deep/b.ts", "lib/only.ts", "lib/other.ts", "docs/[id].ts"]
    rules = {"": ["# comment", "gen/", "!gen/keep.ts", "lib/*", "!lib/only.ts", ""], "src": ["b.ts", "!/gen"], "src/x": ["!b.ts"]}
    got = ignored(spark, paths, rules)
    # a folder that is ignored takes what a later line would keep with it; the deeper file has the last word
    assert got == {"gen/a.ts", "gen/keep.ts", "lib/other.ts"} == by_hand(paths, rules)


@pytest.mark.parametrize("seed", range(3))
def test_against_a_walk(spark, seed):
    r = random.Random(seed)
    names = ["a", "b", "gen", "x.ts", "y.ts"]
    paths = sorted({"/".join(r.choice(names[:3]) for _ in range(r.randrange(4))) + ("/" if k else "") + r.choice(names[3:]) for k in range(60)})
    paths = [p.lstrip("/") for p in paths]
    lines = ["gen", "gen/", "/a", "!a", "b/*", "!b/gen", "**/x.ts", "!x.ts", "a/**", "*.ts", "!y.ts", "a/b/"]
    rules = {f: r.sample(lines, r.randrange(1, 5)) for f in ["", "a", "b", "a/b"] if r.random() < 0.8}
    assert ignored(spark, paths, rules) == by_hand(paths, rules)


def test_ignored_files_are_not_read(spark, tmp_path):
    texts = {"src/a.ts": "1", "src/[id].ts": "2", "src/{x}.vue": "3", "gen/b.ts": "4", "src/node_modules/c.ts": "5", "src/d.md": "6", "src/e.ts": "7", "pages/_app.tsx": "8", "src/.dot.ts": "9 é"}
    for name, text in (texts | {".gitignore": "gen/\n", "src/.gitignore": "/e.ts\n", "package.json": "{}", "node_modules/q/package.json": "{}"}).items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "gen/b.ts").chmod(0)  # could not be read
    got = files.read(spark, str(tmp_path))
    assert {r.rel_path: r.content for r in got.collect()} == {k: texts[k] for k in ("src/a.ts", "src/[id].ts", "src/{x}.vue", "pages/_app.tsx", "src/.dot.ts")}
    assert not any("gen" in f or f.endswith("e.ts") for f in got.inputFiles())
    assert {r.rel_path for r in files.read(spark, str(tmp_path), gitignore=False).select("rel_path").collect()} == {"src/a.ts", "src/[id].ts", "src/{x}.vue", "gen/b.ts", "src/e.ts", "pages/_app.tsx", "src/.dot.ts"}
    assert {r.rel_path for r in files.manifests(spark, str(tmp_path)).collect()} == {"package.json", ".gitignore", "src/.gitignore"}


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "x.md").write_text("x")
    assert files.read(spark, str(tmp_path)).collect() == []
