"""Reports of small results: JSON, Markdown, HTML, JUnit; explanations and verbs."""

from __future__ import annotations

import html
import json
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, recommend, rules
from . import views
from .scan import Scan, compared

SCHEMA_VERSION = 1
LISTED = 50  # lines of a table in the Markdown report, which says how many there are


def _rows(df: DataFrame) -> list[dict]:
    """All rows of a table of findings, partition by partition."""
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


def summary(scan: Scan) -> dict:
    debt = scan.debt.first().asDict()
    status = views.report_status(scan.debt, scan.cycles, scan.violations, scan.contracts, scan.hot, scan.signals, scan.warnings).first().status
    return {"status": status, "modules": scan.modules.count(), "edges": scan.edges.count(), "cycles": scan.cycles.count(), "layer_violations": scan.violations.count(), "contract_violations": scan.contracts.count(), "debt": debt}


def as_json(scan: Scan) -> str:
    tables = {k: _rows(getattr(scan, k)) for k in ("cycles", "violations", "contracts", "hot", "recommendations", "signals", "warnings")}
    return json.dumps({"schema": SCHEMA_VERSION, "summary": summary(scan), **tables}, default=str, sort_keys=True)


def as_markdown(scan: Scan) -> str:
    s = summary(scan)
    out = ["# Architecture report", "", f"Grade **{s['debt']['grade']}** ({s['debt']['score']} of 100)", "", "| | |", "|-|-|"]
    out += [f"| {k.replace('_', ' ')} | {v} |" for k, v in s.items() if k != "debt"]
    for title, table, line in (("Cycles", scan.cycles, lambda r: f"- {r['severity']}: {' → '.join(r['modules'])}"), ("Layer violations", scan.violations, lambda r: f"- {r['severity']}: `{r['src']}` → `{r['dst']}`"), ("Recommendations", scan.recommendations, lambda r: f"- {r['kind']} ({r['weight']:.2f}): {', '.join(r['modules'])}")):
        if rows := [r.asDict(recursive=True) for r in table.limit(LISTED + 1).collect()]:
            out += ["", f"## {title}", "", *map(line, rows[:LISTED])]
            if len(rows) > LISTED:
                out += ["", f"The first {LISTED} of {table.count()}; the JSON report has all."]
    return "\n".join(out) + "\n"


def as_html(scan: Scan) -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Architecture report</title></head><body><pre>{html.escape(as_markdown(scan))}</pre></body></html>"


def as_junit(scan: Scan) -> str:
    """A test case for each recommendation and cycle; weights from 0.6 and direct cycles fail."""
    cases = [(r["kind"], r["id"], r["weight"] >= 0.6, ", ".join(r["modules"])) for r in _rows(scan.recommendations)]
    cases += [("cycle", r["id"], r["severity"] == "direct", ", ".join(r["modules"])) for r in _rows(scan.cycles)]
    body = "".join(f"<testcase classname={quoteattr(k)} name={quoteattr(n)}>" + (f"<failure message={quoteattr(text)}/>" if bad else "") + "</testcase>" for k, n, bad, text in cases)
    return f'<?xml version="1.0" encoding="UTF-8"?><testsuite name="architecture" tests="{len(cases)}" failures="{sum(c[2] for c in cases)}">{body}</testsuite>'


def explain(scan: Scan, what: str) -> dict:
    """A module, a cycle or a signal (by its id) or, for ``project``, the whole."""
    if what == "project":
        return summary(scan)
    if what.startswith("signal:"):
        rows = _rows(scan.signals.where(F.col("id") == what))
        if not rows:
            return {}
        named = [r["recommendation"] for r in rows if r["recommendation"]]
        modules = sorted({m for r in rows for m in r["modules"]})
        return {"signal": rows[0], "findings": _rows(scan.recommendations.where(F.col("id").isin(named))), "modules": _rows(scan.risks.where(F.col("id").isin(modules)))}
    if what.startswith("cycle:"):
        rows = _rows(scan.cycles.where(F.col("id") == what))
        return {"cycle": rows[0], "breaks": _rows(scan.breaks.where(F.col("comp") == rows[0]["comp"]))} if rows else {}
    one = scan.modules.where(F.col("id") == what)
    rows = _rows(scan.risks.where(F.col("id") == what))
    if not rows:
        return {}
    near = scan.edges.where((F.col("src") == what) | (F.col("dst") == what))
    return {"module": rows[0], "imports": _rows(near.where(F.col("src") == what).select("dst", "kind")), "importers": _rows(near.where(F.col("dst") == what).select("src", "kind")), "impact": _rows(views.impact(one, graph.importers(scan.edges, one), scan.members, scan.violations)), "findings": _rows(scan.recommendations.where(F.array_contains("modules", what)))}


def check(scan: Scan, gates: list[str], before: Scan | None = None) -> tuple[int, list[dict]]:
    """0 if all gates hold, 1 if one fails, 2 if one can't be read. Without ``before`` nothing counts as new."""
    try:
        for g in gates:
            rules.parse_gate(g)
    except ValueError as e:
        return 2, [{"gate": str(e), "actual": None, "failed": True}]
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = scan.debt.select("grade")
    for df, name in ((scan.cycles, "cycles"), (scan.violations, "layer_violations"), (scan.contracts, "contract_violations"), (scan.contracts.where("severity = 'error'"), "contract_errors"), (scan.recommendations, "recommendations")):
        one = one.crossJoin(n(df, name))
    active = scan.signals.withColumn("status", F.lit("active"))
    severities = rules.BY_SEVERITY["signals"]
    count = lambda where, name: F.coalesce(F.sum(F.when(where, 1)), F.lit(0)).cast("long").alias(name)
    one = one.crossJoin(active.agg(*(count(recommend.can_fail_ci(s), f"signals_{s}") for s in severities)))
    heavy, zero = rules.BY_SEVERITY["bundle-bloat"], []
    if scan.bundle is None:  # without statistics there is nothing to find
        zero += [f"bundle_bloat_{s}" for s in heavy]
    else:
        worse = {s: F.col("severity").isin(*heavy[k:]) for k, s in enumerate(heavy)}
        one = one.crossJoin(scan.bundle.agg(*(count(test, f"bundle_bloat_{s}") for s, test in worse.items())))
    if before is None:
        zero += ["new_cycles", "new_layer_violations", "new_contract_violations", *(f"{k}_signals_{s}" for k in ("new", "regressed") for s in severities)]
    else:
        found = compared(before, scan)
        one = one.crossJoin(found.agg(*(count((F.col("what") == w) & (F.col("change") == "new"), f"new_{w}") for w in ("cycles", "layer_violations", "contract_violations"))))
        status = recommend.lifecycle(before.signals, scan.signals).select("stable_key", F.col("status").alias("now")).distinct()
        aged = active.join(status, "stable_key")
        one = one.crossJoin(aged.agg(*(count((F.col("now") == k) & recommend.can_fail_ci(s), f"{k}_signals_{s}") for k in ("new", "regressed") for s in severities)))
    one = one.withColumns({c: F.lit(0).cast("long") for c in zero})
    rows = _rows(rules.gates(one, gates))
    return int(any(r["failed"] for r in rows)), rows
