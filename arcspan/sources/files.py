"""Source files: walking, what counts as source, and line counts."""

from __future__ import annotations

import datetime
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import glob_regex, ignore_parts

# Extensions, folders never read, and names that are not product code.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "vue", "svelte")
SKIPPED_DIRS = ("node_modules", ".git", "dist", "build", "out", ".cache", ".next", ".nuxt", "coverage", ".turbo", ".svelte-kit", ".output", ".idea", ".vscode")
TEST_DIRS = ("__tests__", "__mocks__", "__snapshots__", "cypress", "playwright", "e2e", ".storybook")
TOOLS = ("vite", "vitest", "rollup", "webpack", "esbuild", "jest", "cypress", "playwright", "tailwind", "postcss", "svgo", "babel", "eslint", "prettier", "stylelint", "tsup", "rolldown", "nuxt", "astro")
MAX_CHARS = 1_000_000


#: Files beside the sources that say something about a project.
NOTES = r"(^|/)(package\.json|tsconfig[^/]*\.json|vite\.config\.[cm]?[jt]s|[^/]*\.html|\.gitignore)$|^(bundle-stats|dist/stats)\.json$"
LISTED = "path string, rel_path string, size long, mtime timestamp"
_STATUS = re.compile(r"path=(.*?); isDirectory=(true|false); (?:length=(\d+); )?.*?modification_time=(\d+)")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``path, rel_path, size, mtime`` of all files below a folder of any store; folders that are never read aren't entered.

    The driver walks, as it does for Spark's own file index, which would enter
    every folder and leaves out names that begin with a dot or underscore.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/") + "/"
    rows, todo = [], [base.rstrip("/")]
    while todo:
        found = jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.listStatus(jvm.org.apache.hadoop.fs.Path(todo.pop())))
        for path, folder, size, mtime in _STATUS.findall(found):
            if folder == "true":
                name = path.rpartition("/")[2]
                if name not in SKIPPED_DIRS or path == f"{base}dist":
                    todo.append(path)
            else:
                rows.append((path, path.removeprefix(base), int(size or 0), datetime.datetime.fromtimestamp(int(mtime) / 1000, datetime.UTC)))
    out = spark.createDataFrame(sorted(rows), LISTED)
    # of that one folder only what a bundler says of itself
    return out.where(~F.startswith("rel_path", F.lit("dist/")) | (F.col("rel_path") == "dist/stats.json"))


def _texts(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """``rel_path, content, size, mtime`` of a listing's files; no other file is opened.

    Spark's reader leaves out names that begin with a dot or an underscore; the
    few files of such names are read by the driver.
    """
    hidden = F.col("rel_path").rlike("(^|/)[._][^/]*$")
    filled = listing.where("size > 0")  # Spark's reader gives no row for an empty file
    there = [r.path for r in filled.where(~hidden | F.contains("path", F.lit("="))).select("path").toLocalIterator()]
    parts = []
    if there:  # names of files are no patterns
        rows = spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in there])
        parts.append(rows.select("path", F.decode("content", "UTF-8").alias("content")))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = []
    for r in filled.where(hidden & ~F.contains("path", F.lit("="))).select("path").toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(r.path)
        stream = at.getFileSystem(conf).open(at)
        own.append((r.path, bytes(stream.readAllBytes()).decode("utf-8", "replace")))
        stream.close()
    parts.append(spark.createDataFrame(own, "path string, content string"))
    texts = reduce(DataFrame.union, parts)
    rows = filled.join(texts, "path").select("rel_path", "content", "size", "mtime")
    return rows.union(listing.where("size = 0").select("rel_path", F.lit(""), "size", "mtime"))


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The ``rel_path`` that ignore files leave out; ``rules`` holds their lines: ``folder, n, pattern``.

    A pattern counts below its file's folder. Of the patterns that match a
    path the last one of the deepest file decides, and what lies below an
    ignored folder is ignored, whatever else is said of it.
    """
    compiled = F.udf(lambda p: ignore_parts(p[1:] if p.startswith("!") else p), "regex string, folders boolean")  # one row a line of an ignore file
    table = rules.where("pattern IS NOT NULL").select("folder", "n", compiled("pattern").alias("p"), F.startswith("pattern", F.lit("!")).alias("back"))
    table = table.where("p IS NOT NULL").select("folder", "n", "p.*", "back")
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    files = paths.select("rel_path").distinct()
    folders = files.select(F.explode(above).alias("node")).where("node <> ''").distinct()
    nodes = folders.withColumn("is_folder", F.lit(True)).union(files.withColumn("is_folder", F.lit(False)))
    pieces = F.split("node", "/")
    at = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda k: F.array_join(F.slice(pieces, F.lit(1), k), "/"))
    hits = nodes.select("node", "is_folder", F.explode(at).alias("folder")).join(table, "folder").where("is_folder OR NOT folders")
    below = F.when(F.col("folder") == "", F.col("node")).otherwise(F.expr("substring(node, length(folder) + 2)"))
    hits = hits.where(F.rlike(below, F.col("regex")))
    last = hits.groupBy("node", "is_folder").agg(F.max_by("back", F.struct(F.length("folder"), "n")).alias("back")).where("NOT back").select("node", "is_folder")
    ways = files.select("rel_path", F.explode(above).alias("node"), F.lit(True).alias("is_folder")).union(files.select("rel_path", "rel_path", F.lit(False)))
    return ways.join(last, ["node", "is_folder"], "left_semi").select("rel_path").distinct()


def rules_of(notes: DataFrame) -> DataFrame:
    """``folder, n, pattern`` of the ignore files among ``rel_path, content``."""
    own = notes.where(F.col("rel_path").rlike(r"(^|/)\.gitignore$"))
    lines = own.select(F.regexp_replace("rel_path", r"/?\.gitignore$", "").alias("folder"), F.posexplode(F.split("content", "\r?\n")).alias("n", "pattern"))
    return lines.where("pattern <> ''")


def read(spark: SparkSession, root: str, gitignore: bool = True) -> DataFrame:
    """``rel_path, content, size, mtime`` of all source files below a folder of any store.

    Which files those are is decided on paths: folders that are never read,
    other extensions and what ignore files name are gone before a text is read.
    """
    found = listed(spark, root)
    sources = found.where(F.col("rel_path").rlike(r"\.(" + "|".join(EXTENSIONS) + ")$") & ~F.startswith("rel_path", F.lit("dist/")))
    if gitignore:
        rules = rules_of(_texts(spark, found.where(F.col("rel_path").rlike(r"(^|/)\.gitignore$"))))
        sources = sources.join(ignored_paths(sources, rules), "rel_path", "left_anti").select(*found.columns)
    return _texts(spark, sources)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """``rel_path, content`` of the files that say something about the project, packages below too."""
    return _texts(spark, listed(spark, root).where(F.col("rel_path").rlike(NOTES))).select("rel_path", "content")


def in_memory(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(files.items()), "rel_path string, content string")


def skipped(path: Column, exclude: list[str] | None = None) -> Column:
    """Why a file is left out: ``dir, test, story, types, config, excluded``; null for source files."""
    why = F.when(path.rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS) + ")/"), "dir")
    why = why.when(path.rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in TEST_DIRS) + r")/|\.(test|spec)\.[cm]?[jt]sx?$"), "test")
    why = why.when(path.rlike(r"\.stories\.([cm]?[jt]sx?|vue)$"), "story").when(path.rlike(r"\.d\.[cm]?ts$"), "types")
    why = why.when(path.rlike("(^|/)(" + "|".join(TOOLS) + r")\.config\.[cm]?[jt]sx?$"), "config")
    for g in exclude or ():
        why = why.when(path.rlike(glob_regex(g)), "excluded")
    return why


def discover(files: DataFrame, path: str = "rel_path", exclude: list[str] | None = None) -> DataFrame:
    """The files that are source."""
    p = F.col(path)
    return files.where(p.rlike(r"\.(" + "|".join(EXTENSIONS) + ")$") & skipped(p, exclude).isNull())


def line_count(text: Column) -> Column:
    """0 for empty texts, else line breaks and one."""
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


# What a path says about a module, in the order in which it is asked.
_KINDS = (
    (r"(^|/)(__tests__|tests?|spec|e2e)(/|\.)", "test"), (r"\.(test|spec)\.[cm]?[jt]sx?$", "test"), (r"\.config\.[cm]?[jt]sx?$", "config"), (r"(^|/)config(/|\.)", "config"),
    (r"(^|/)(styles?|theme|tokens)/", "style"), (r"\.(css|scss|sass)$", "style"), (r"(^|/)([A-Za-z0-9]+)?(?:Loader|Plugin|Registry|Provider|Bootstrap)(?:\.[a-z]+)?(?:\.[jt]sx?|\.vue|\.svelte)$", "integration"),
)
_MORE_KINDS = (
    (r"(^|/)(api|openapi|graphql)(/|\.)", "api"), (r"(^|/)(services?|clients?|repositories)(/|\.)", "service"), (r"(^|/)(model|state)(/|\.)", "model"), (r"(^|/)(schemas?|dto|types)(/|\.)", "schema"),
    (r"(^|/)composables/|(^|/)use[A-Z][A-Za-z0-9]*\.[jt]sx?$", "composable"),
)
_LAST_KINDS = ((r"(^|/)router(/|\.)", "route"), (r"(^|/)(utils|lib|helpers)(/|\.)", "util"), (r"(^|/)(main|index|entry)\.[jt]sx?$", "entry"))
_INFRA = r"\.d\.ts$|(^|/)eslint\.[a-z]+\.[cm]?[jt]sx?$|(^|/)\.eslintrc\.[a-z]+$|\.config\.[cm]?[jt]sx?$"


def module_kind(path: Column, exports: Column | None = None, defines_store: Column | None = None) -> Column:
    """One cascade over path, language, exports."""
    out = F.lit("module")
    steps = [(path.rlike(p), k) for p, k in _KINDS] + [(path.rlike(r"\.(vue|svelte)$"), "component")]
    if defines_store is not None:
        steps.append((defines_store, "store"))
    steps += [(path.rlike(p), k) for p, k in _MORE_KINDS]
    if exports is not None:
        steps.append((F.exists(exports, lambda e: e.rlike("^use[A-Z]")), "composable"))
    steps += [(path.rlike(p), k) for p, k in _LAST_KINDS]
    for test, kind in reversed(steps):
        out = F.when(test, kind).otherwise(out)
    return out


def is_infra(path: Column) -> Column:
    return path.rlike(_INFRA)


def runtime(path: Column, directives: Column, server_only: Column, client_only: Column, framework: str = "generic") -> Column:
    """Directives decide, then marker imports, then names and the framework's folders; else shared."""
    out = F.when(F.array_contains(directives, "use server"), "server").when(F.array_contains(directives, "use client"), "client").when(server_only, "server").when(client_only, "client")
    out = out.when(path.rlike(r"(^|/)\+server\.[mc]?[jt]s$|\.server\.[mc]?[jt]sx?$"), "server").when(path.rlike(r"\.client\.[mc]?[jt]sx?$|(^|/)\+(?:page|layout)\.svelte$"), "client")
    if framework == "next":
        out = out.when(path.rlike("(^|/)pages/api/|(^|/)app/"), "server")
    if framework == "nuxt":
        out = out.when(path.rlike("(^|/)server/"), "server")
    return out.otherwise("shared")


_ASSET = r"\.(css|scss|sass|less|styl|svg|png|jpe?g|gif|webp|avif|ico|woff2?|ttf|otf|eot|mp[34]|webm|json|wasm|md|txt|html|graphql|gql)(\?.*)?$"


def is_asset(specifier: Column) -> Column:
    return specifier.rlike(_ASSET)


def is_external(specifier: Column) -> Column:
    """A package: neither relative, rooted, nor behind a usual alias."""
    return ~specifier.rlike(r"^(\.|/|~/|@/|#)")
