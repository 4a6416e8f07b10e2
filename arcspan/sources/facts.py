"""Facts of parsed files: one nested row a file, exploded into a table of facts.

Six kinds: ``runtime``, ``framework``, ``route``, ``state``, ``asset`` and
``export``, each with what it says, a value and how sure it is; besides the
``limitations`` of what the parser could read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import is_asset

# What paths say about routes, by framework.
ROUTES = {
    "next": (
        (r"(^|/)app(?:/.*)?/page\.[jt]sx?$", "page"), (r"(^|/)app(?:/.*)?/layout\.[jt]sx?$", "layout"), (r"(^|/)app/api/.*/route\.[jt]s$", "api"),
        (r"(^|/)pages/api/.*\.[jt]sx?$", "api"), (r"(^|/)pages/(?!api/).*\.[jt]sx?$", "page"), (r"(^|/)middleware\.[jt]s$", "middleware"),
    ),
    "nuxt": (
        (r"(^|/)pages/.*\.vue$", "page"), (r"(^|/)layouts/.*\.vue$", "layout"), (r"(^|/)server/api/.*\.[cm]?[jt]s$", "api"), (r"(^|/)middleware/.*\.[cm]?[jt]s$", "middleware"),
    ),
    "svelte": (
        (r"(^|/)\+page\.svelte$", "page"), (r"(^|/)\+page\.[cm]?[jt]s$", "page"), (r"(^|/)\+layout\.svelte$", "layout"), (r"(^|/)\+layout\.[cm]?[jt]s$", "layout"),
        (r"(^|/)\+page\.server\.[cm]?[jt]s$", "server-route"), (r"(^|/)\+server\.[jt]s$", "server-route"),
    ),
    "react": ((r"(^|/)src/routes/__root\.[jt]sx?$", "layout"), (r"(^|/)src/routes/(?!__root\.)[^/]+\.[jt]sx?$", "page")),
}
ASSETS = ((r"\.(css|scss|sass|less)$", "style"), (r"\.json$", "json"), (r"\.(svg|png|jpg|jpeg|gif|webp|avif|ico)$", "image"), (r"\.(woff2?|ttf|otf)$", "font"))
LIMITATIONS = {
    "glob": "import.meta.glob edges are expanded statically and marked low-confidence approximate",
    "prefix": "dynamic import prefix edges are approximate",
    "exports": "export facts are name-only; type/value provenance is not fully resolved yet",
}


def asset_kind(specifier: Column) -> Column:
    clean, out = F.lower(F.regexp_replace(specifier, r"\?.*$", "")), F.lit("other")
    for pattern, kind in reversed(ASSETS):
        out = F.when(clean.rlike(pattern), kind).otherwise(out)
    return out


def _fact(fact: str, kind, value, confidence) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(fact).alias("fact"), as_column(kind).cast("string").alias("kind"), as_column(value).cast("string").alias("value"), as_column(confidence).cast("string").alias("confidence"))


def limitations() -> Column:
    """What the parser could not read of a file, as a list."""
    has = lambda p: F.exists("imports", lambda i: i["pattern"] == p)
    return F.array_compact(F.array(F.when(has("glob"), LIMITATIONS["glob"]), F.when(has("prefix"), LIMITATIONS["prefix"]), F.when(F.size("exports") > 0, LIMITATIONS["exports"])))


def summarised(parsed: DataFrame, framework: str = "generic") -> DataFrame:
    """Parsed files with ``facts`` and ``limitations``."""
    path = F.col("rel_path")
    folder = lambda name: path.rlike(f"(^|/){name}/")
    directive = F.array_contains("directives", "use server"), F.array_contains("directives", "use client")
    runtime = F.when(directive[0], "server").when(directive[1], "client").otherwise("shared")
    source = F.when(F.size("directives") > 0, "directive").when(path.rlike(r"(^|/)(server|app/api)/|\+server\.[jt]s$"), "framework-convention").otherwise("default")
    one = [_fact("runtime", runtime, source, F.when(source == "default", "low").otherwise("high"))]
    if framework == "svelte":
        one.append(F.when(path.rlike(r"(^|/)\+(page|layout|server)\.svelte$|(^|/)\+server\.[jt]s$"), _fact("framework", "sveltekit-route", path, "medium")))
    if framework == "nuxt":
        one.append(F.when(path.endswith(".vue") & folder("components"), _fact("framework", "nuxt-auto-component", path, "medium")))
        one.append(F.when(path.rlike(r"\.[cm]?[jt]s$") & folder("composables"), _fact("framework", "nuxt-auto-composable", path, "medium")))
    one += [F.when(path.rlike(p), _fact("route", kind, path, "low" if framework == "react" else "medium")) for p, kind in ROUTES.get(framework, ())]
    one.append(F.when(F.col("defines_store"), _fact("state", "pinia-store", path, "high")))
    listed = [
        F.transform("tags", lambda t: _fact("framework", "vue-template-ref", t, "medium")),
        F.transform(F.filter("imports", lambda i: is_asset(i["specifier"])), lambda i: _fact("asset", asset_kind(i["specifier"]), i["specifier"], "high")),
        F.transform("exports", lambda e: _fact("export", F.when(e == "default", "default").when(e == "*", "namespace").otherwise("named"), e, "medium")),
    ]
    return parsed.withColumns({"facts": F.concat(F.array_compact(F.array(*one)), *listed), "limitations": limitations()})


def facts(summaries: DataFrame) -> DataFrame:
    """``id, fact, kind, value, confidence``, a row for each fact."""
    return summaries.select(F.col("rel_path").alias("id"), F.explode("facts").alias("f")).select("id", "f.*")


def import_facts(parsed: DataFrame) -> DataFrame:
    """``id, n, specifier, kind, resolution, confidence, approximate, asset, eager, negative`` of every import."""
    rows = parsed.select(F.col("rel_path").alias("id"), F.posexplode("imports").alias("n", "i")).select("id", "n", "i.*")
    asset = is_asset(F.col("specifier"))
    resolution = F.coalesce("pattern", F.when(asset, "asset").when(F.col("kind") == "dynamic", "dynamic-literal").otherwise("literal"))
    negative = (F.col("pattern") == "glob") & F.startswith("specifier", F.lit("!"))
    return rows.select("id", "n", "specifier", "kind", resolution.alias("resolution"), "confidence", "approximate", asset.alias("asset"), "eager", F.coalesce(negative, F.lit(False)).alias("negative"))


def quality(summaries: DataFrame) -> DataFrame:
    """``id, n_approximate, n_low, n_limitations`` of files of which something is unsure."""
    n = lambda test: F.size(F.filter("imports", test)).cast("long")
    rows = summaries.select(
        F.col("rel_path").alias("id"), n(lambda i: i["approximate"]).alias("n_approximate"), n(lambda i: i["confidence"] == "low").alias("n_low"), F.size("limitations").cast("long").alias("n_limitations")
    )
    return rows.where("n_approximate > 0 OR n_low > 0 OR n_limitations > 0")
