"""SQL for the queries of :mod:`more_queries`."""

from __future__ import annotations

from ..adapters.testdata import SQL_ID
from .oracle import _BARREL, _HALF, _LAYER, _part, _whole, _with

_SIX = "CAST(floor(({0}) * 1000000 + 0.5) AS DOUBLE) / 1000000"
_AREA = """CASE WHEN string_split({0}, '/')[2] IN ('domains','entities','features','mfes','modules','pages','services','shared','widgets') THEN string_split({0}, '/')[2] || '/' || string_split({0}, '/')[3] ELSE string_split({0}, '/')[2] END"""

_part("p95", "SELECT fan_in AS cut FROM (SELECT fan_in, row_number() OVER (ORDER BY fan_in) - 1 AS i, count(*) OVER () AS n FROM fan) WHERE i = CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT)", "fan")
_part("god", "SELECT 'god:' || id AS id, 'split-god-module' AS kind, [id] AS modules, least(1.0, CAST(fan_in AS DOUBLE) / 30 + CAST(loc AS DOUBLE) / 1000) AS weight, 0 AS stage, lpad(CAST(ord AS VARCHAR), 20, '0') AS seq FROM fan, p95 WHERE NOT is_infra AND fan_in >= cut AND fan_in >= 2 AND loc >= 300", "fan", "p95")
_part("unused", "SELECT 'unused:' || id AS id, 'unused-utility' AS kind, [id] AS modules, CAST(0.4 AS DOUBLE) AS weight, 1 AS stage, lpad(CAST(ord AS VARCHAR), 20, '0') AS seq FROM fan WHERE NOT is_infra AND kind = 'util' AND fan_in = 0", "fan")
_part("violator", "SELECT 'vhot:' || src AS id, 'misplaced-by-layer' AS kind, [src] AS modules, CAST(0.6 AS DOUBLE) + least(CAST(0.3 AS DOUBLE), n / 20) AS weight, 6 AS stage, ord AS seq FROM (SELECT src, CAST(sum(CASE severity WHEN 'error' THEN 2 ELSE 1 END) AS DOUBLE) AS n, min(ord) AS ord FROM violation GROUP BY src ORDER BY n DESC, ord LIMIT 3) WHERE n >= 2", "violation")
_part("contract", "SELECT 'contract:' || id AS id, 'contract-violation' AS kind, [src, dst] AS modules, CASE severity WHEN 'error' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS weight, 7 AS stage, rule || ord AS seq, severity, rule, CAST(string_split(id, ':')[3] AS INTEGER) AS place FROM (SELECT * FROM boundary)", "boundary", "e")
_TEXT_RANKED = """SELECT id, kind, CASE WHEN bool_or(h) THEN least(1.0, any_value(weight) + CAST(0.1 AS DOUBLE)) ELSE any_value(weight) END AS w, any_value(weight) AS weight, any_value(stage) AS stage, any_value(seq) AS seq FROM (
  SELECT r.*, m IN (SELECT id FROM zone) AS h FROM (SELECT *, unnest(modules) AS m FROM (SELECT id, kind, modules, weight, stage, seq FROM god UNION ALL SELECT id, kind, modules, weight, stage, seq FROM unused UNION ALL SELECT id, kind, modules, weight, stage, seq FROM violator UNION ALL SELECT id, kind, modules, weight, stage, seq FROM contract WHERE place < 20)) r) GROUP BY id, kind"""
_part("zone", f"SELECT id FROM hot WHERE NOT ({_BARREL})", "hot")
_part("ranked", _TEXT_RANKED, "god", "unused", "violator", "contract", "zone")
_part("unsure", "SELECT src AS id FROM {edges} GROUP BY src HAVING count(*) FILTER (WHERE kind = 'dynamic') > 0 OR count(*) FILTER (WHERE NOT resolved) > 0", "edge")
_SIGNAL = """SELECT id AS recommendation, kind, modules, severity, CASE WHEN kind = 'unused-utility' THEN 'low' WHEN doubt THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN kind = 'unused-utility' THEN 'experimental' ELSE 'stable' END AS maturity,
  greatest(0.0, CASE severity WHEN 'high' THEN 65 WHEN 'medium' THEN 35 ELSE 15 END * CASE WHEN kind = 'unused-utility' THEN CAST(0.55 AS DOUBLE) WHEN doubt THEN CAST(0.8 AS DOUBLE) ELSE 1.0 END + least(20.0, weight) - CASE WHEN kind = 'unused-utility' THEN 22 WHEN doubt THEN 3 ELSE 0 END) AS score
  FROM (SELECT id, kind, modules, weight, CASE severity WHEN 'error' THEN 'high' ELSE 'medium' END AS severity, modules[1] IN (SELECT id FROM unsure) OR modules[2] IN (SELECT id FROM unsure) AS doubt FROM contract WHERE place < 1000
  UNION ALL SELECT id, kind, modules, weight, 'low', modules[1] IN (SELECT id FROM unsure) FROM unused)"""
_part("signal", _SIGNAL, "contract", "unused", "unsure")
_part("whole_signal", _SIGNAL.replace(" WHERE place < 1000", ""), "contract", "unused", "unsure")
_part("before_module", "SELECT * REPLACE (CASE WHEN ord % 17 = 0 THEN loc + 20 ELSE loc END AS loc) FROM module WHERE ord % 13 <> 0", "module")
_part("before_e", "SELECT * FROM e WHERE src NOT LIKE '%7.ts'", "e")
_part("before_closure", "SELECT DISTINCT src, dst FROM before_e UNION SELECT c.src, e.dst FROM before_closure c JOIN before_e e ON c.dst = e.src", "before_e")
_part("before_member", "SELECT a.src AS id, least(min(a.dst), a.src) AS comp FROM before_closure a JOIN before_closure b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src", "before_closure")
_part("ring", "SELECT 'now' AS t, string_agg(id, ',' ORDER BY id) AS k FROM member GROUP BY comp UNION ALL SELECT 'old', string_agg(id, ',' ORDER BY id) FROM before_member GROUP BY comp", "member", "before_member")
_part("bad", "SELECT DISTINCT 'now' AS t, src || '>' || dst AS k FROM violation UNION ALL SELECT DISTINCT 'old', v.src || '>' || v.dst FROM violation v WHERE v.src NOT LIKE '%7.ts' AND v.src IN (SELECT id FROM before_module) AND v.dst IN (SELECT id FROM before_module)", "violation", "before_module")
_part("cell", f"SELECT {{group_src}} AS from_group, {{group_dst}} AS to_group, (e2.src, e2.dst) IN (SELECT (src, dst) FROM violation) AS bad, a.comp IS NOT NULL AND a.comp = b.comp AS ring FROM edge e2 LEFT JOIN member a ON a.id = e2.src LEFT JOIN member b ON b.id = e2.dst WHERE e2.resolved", "edge", "member", "violation")
_part("matrix", "SELECT from_group, to_group, count(*) AS imports, count(*) FILTER (WHERE bad) AS violations, count(*) FILTER (WHERE ring) AS cycle_edges FROM cell WHERE from_group <> to_group GROUP BY ALL", "cell")
_part("ring_of", "SELECT id, count(DISTINCT comp) AS n FROM member GROUP BY id", "member")
_part("layer_end", "SELECT id, count(*) AS n FROM (SELECT src AS id FROM violation UNION ALL SELECT dst FROM violation WHERE dst <> src) GROUP BY id", "violation")
_part("bound_end", "SELECT id, count(*) AS n FROM (SELECT src AS id FROM boundary UNION ALL SELECT dst FROM boundary WHERE dst <> src) GROUP BY id", "boundary")
_part("risk", f"SELECT m.*, CAST(CASE WHEN member.id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS cycle_count, (SELECT count(*) FROM violation v WHERE v.src = m.id) + (SELECT count(*) FROM violation v WHERE v.dst = m.id) + coalesce(b.n, 0) AS violation_count, zone.id IS NOT NULL AS is_hot FROM metric m LEFT JOIN member USING (id) LEFT JOIN zone USING (id) LEFT JOIN bound_end b USING (id)", "metric", "member", "violation", "zone", "bound_end")
_part("risky", f"SELECT *, {_HALF.format('hotness + coupling + fan_in + fan_out + cycle_count * 12 + violation_count * 10 + CASE WHEN is_hot THEN 10 ELSE 0 END')} AS risk FROM risk", "risk")
_part("item", "SELECT *, CAST(loc + n_exports * 4 + fan_in * 3 + fan_out * 2 AS BIGINT) AS worth FROM fan WHERE loc > 0", "fan")
_part("lived", "SELECT id, kind, CAST(CASE ord % 7 WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS n FROM fan WHERE runtime <> 'server'", "fan")
_part("marked", "SELECT src, dst, max(CASE severity WHEN 'error' THEN 2 ELSE 1 END) AS bad FROM violation GROUP BY ALL", "violation")
_part("lane", "SELECT e2.ord, e2.src, e2.dst, {area_src} AS from_group, {area_dst} AS to_group, bad FROM edge e2 LEFT JOIN marked ON marked.src = e2.src AND marked.dst = e2.dst WHERE {area_src} <> {area_dst}", "edge", "marked")
_part("place", "SELECT g, row_number() OVER (ORDER BY met) - 1 AS place FROM (SELECT g, min(at_) AS met FROM (SELECT from_group AS g, ord || '|0' AS at_ FROM lane UNION ALL SELECT to_group, ord || '|1' FROM lane) GROUP BY g)", "lane")
_part("follow", "SELECT m[k] AS src, m[k % len(m) + 1] AS dst FROM (SELECT m, unnest(range(1, len(m) + 1)) AS k FROM (SELECT string_split(modules, ',') AS m FROM cycle))", "cycle")
_part(
    "plan_found",
    """SELECT 'cycle' AS type, comp AS id, CAST(CASE severity WHEN 'direct' THEN 100 ELSE 82 END AS DOUBLE) AS weight, string_split(modules, ',') AS targets, 0 AS stage, CAST(-length AS DOUBLE) AS by_, comp AS then_ FROM (SELECT * FROM cycle ORDER BY length DESC, comp LIMIT 20)
  UNION ALL SELECT 'barrel-cycle', comp || ':barrel', CASE severity WHEN 'direct' THEN 92 ELSE 74 END, string_split(modules, ','), 0, -length, comp FROM (SELECT * FROM cycle ORDER BY length DESC, comp LIMIT 20) WHERE regexp_matches(modules, '(^|[/,])index\\.[cm]?[jt]sx?(,|$)')
  UNION ALL SELECT 'layer-violation', src || chr(1) || dst, CASE severity WHEN 'error' THEN 88 ELSE 66 END, [src, dst], 1, 0, ord FROM (SELECT * FROM violation ORDER BY ord LIMIT 50)
  UNION ALL SELECT 'move-module', src || chr(1) || dst || ':move', CASE severity WHEN 'error' THEN 84 ELSE 58 END, [src, dst], 1, 0, ord FROM (SELECT * FROM violation ORDER BY ord LIMIT 50)
  UNION ALL SELECT 'unreachable-from-entries', id || ':unreachable', least(70.0, 35 + loc / 10), [id], 2, -loc, id FROM dead
  UNION ALL SELECT 'contract-violation', id, CASE severity WHEN 'error' THEN 86 ELSE 64 END, [src, dst], 3, 0, ord FROM (SELECT * FROM boundary ORDER BY ord LIMIT 50)
  UNION ALL SELECT 'hot-zone', id, least(80.0, hotness * 10), [id], 4, -hotness, id FROM (SELECT * FROM hot JOIN zone USING (id) ORDER BY hotness DESC, id LIMIT 50)
  UNION ALL SELECT 'recommendation', 'contract:' || id, CASE severity WHEN 'error' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END, [src, dst], 5, -CASE severity WHEN 'error' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END, 'contract:' || id FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY ord) AS k FROM boundary) WHERE k <= 5
  UNION ALL SELECT 'recommendation', 'unused:' || id, CAST(0.4 AS DOUBLE), [id], 5, -CAST(0.4 AS DOUBLE), 'unused:' || id FROM fan WHERE NOT is_infra AND kind = 'util' AND fan_in = 0""",
    "cycle", "violation", "dead", "boundary", "hot", "zone", "fan",
)
_part("dead", "SELECT id, loc, kind, 'isolated' AS \"group\" FROM fan WHERE fan_in + fan_out + n_exports = 0 AND kind NOT IN ('entry', 'test') AND NOT is_infra", "fan")
_part("surface", "SELECT *, n_exports * 2 + fan_in * 3 + fan_out AS risk FROM fan WHERE NOT is_infra", "fan")
_part("known", f"SELECT {SQL_ID.format('p_partkey')} AS id, string_split(p_name, ' ') AS exports FROM part")
_part("searchable", "SELECT id, exports, kind FROM known JOIN module USING (id)", "known", "module")
_part("snapshot", "SELECT o_custkey % 40 AS project, strftime(o_orderdate, '%Y-%m') AS scanned_at, max_by(CAST(floor(o_totalprice / 5000) AS BIGINT), o_orderkey) AS score FROM orders GROUP BY ALL")
_ROLL = "(SELECT '{0}' AS \"by\", {1} AS name, count(*) AS modules, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(cycle_count) AS BIGINT) AS cycles, " + _HALF.format("sum(risk)") + " AS risk FROM risky GROUP BY 2 ORDER BY risk DESC, name LIMIT 8)"
_WORD = "CASE WHEN list_contains(exports, '{0}') THEN CAST(0.5 AS DOUBLE) WHEN len(list_filter(exports, lambda x: contains(x, '{0}'))) > 0 THEN CAST(0.25 AS DOUBLE) ELSE 0.0 END"
_AT = "CASE WHEN regexp_extract(id, '([^/]*)\\.ts$', 1) = '{0}' THEN CAST(0.4 AS DOUBLE) WHEN contains(id, '{0}') THEN CAST(0.2 AS DOUBLE) ELSE 0.0 END"
_hit = lambda w: f"greatest({_WORD.format(w)}, {_AT.format(w)})"

MORE = {
    "god_modules": _with(f"SELECT id, kind, {_SIX.format('weight')} AS weight FROM god", "god"),
    "unused_utilities": _with(f"SELECT id, kind, {_SIX.format('weight')} AS weight FROM unused WHERE id NOT LIKE 'unused:src/app/%'", "unused"),
    "misplaced_modules": _with(
        f"""SELECT 'layer:' || dst AS id, 'misplaced-by-layer' AS kind, {_SIX.format('CAST(0.5 AS DOUBLE) + CAST(0.3 AS DOUBLE) * n / total')} AS weight FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY n DESC, l DESC) AS r FROM (SELECT dst, {_LAYER.format('src')} AS l, count(*) AS n, sum(count(*)) OVER (PARTITION BY dst) AS total FROM e GROUP BY 1, 2) WHERE l <> 'unknown') JOIN module ON id = dst
        WHERE r = 1 AND NOT is_infra AND total >= 2 AND l <> {_LAYER.format('dst')} AND {_LAYER.format('dst')} <> 'unknown' AND n >= total * CAST(0.5 AS DOUBLE)""",
        "e", "module",
    ),
    "top_violators": _with(f"SELECT id, kind, {_SIX.format('weight')} AS weight FROM violator", "violator"),
    "contract_findings": _with(f"SELECT id, kind, {_SIX.format('weight')} AS weight FROM contract WHERE place < 20", "contract"),
    "coupling_findings": _with(
        f"""SELECT 'temporal-coupling' AS kind, a || ',' || b AS modules, {_SIX.format('CAST(0.5 AS DOUBLE) + least(CAST(0.4 AS DOUBLE), risk * CAST(0.45 AS DOUBLE))')} AS weight FROM (SELECT *, least(1.0, {_HALF.format('score * (CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * least(1.0, co / 10)) * CASE WHEN hidden THEN CAST(1.25 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END * CASE WHEN hidden AND cross_boundary THEN CAST(1.15 AS DOUBLE) ELSE 1.0 END')}) AS risk FROM co_score WHERE score >= CAST(0.02 AS DOUBLE) ORDER BY risk DESC, score DESC, co DESC, a, b LIMIT 200)
        WHERE hidden AND cross_boundary ORDER BY risk DESC, floor(score * 1000000 + 0.5) DESC, co DESC, a, b LIMIT 10""",
        "co_score",
    ),
    "recommendations": _with(f"SELECT id, kind, {_SIX.format('w')} AS weight FROM ranked ORDER BY w DESC, ranked.weight DESC, stage, seq LIMIT 1000", "ranked", n=40),
    "signals": _with(f"SELECT recommendation, severity, confidence, maturity, {_HALF.format('score')} AS score FROM signal", "signal", edges="edge"),
    "ci_signals": _with("SELECT kind, recommendation LIKE '%:0' AS suppressed, recommendation NOT LIKE '%:0' AND confidence = 'high' AND severity = 'high' AND maturity = 'stable' AS blocks, count(*) AS n FROM (SELECT s.* REPLACE (CASE WHEN (kind, modules, severity) IN (SELECT (kind, modules, severity) FROM signal WHERE recommendation LIKE '%:0') THEN 'x:0' ELSE recommendation END AS recommendation) FROM signal s) GROUP BY ALL", "signal", edges="edge"),
    "insights": _with(f"SELECT modules[1] AS module, count(*) AS n_signals, ['info','low','medium','high','critical'][max(list_position(['info','low','medium','high','critical'], severity))] AS severity, ['low','medium','high'][min(list_position(['low','medium','high'], confidence))] AS confidence, {_HALF.format('sum(score)')} AS score FROM signal GROUP BY 1 ORDER BY score DESC, module LIMIT 50", "signal", edges="edge"),
    "module_diff": _with("SELECT id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM before_module a FULL JOIN (SELECT * FROM module WHERE ord % 19 <> 0) b USING (id) WHERE a.id IS NULL OR b.id IS NULL OR a.loc <> b.loc OR a.kind <> b.kind OR a.language <> b.language", "module", "before_module"),
    "scan_diff": _with(
        """SELECT what, CASE t WHEN 'now' THEN 'new' ELSE 'resolved' END AS change, count(*) AS n FROM (SELECT 'cycles' AS what, * FROM ring UNION ALL SELECT 'layer_violations', * FROM bad) x
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'cycles' AS what, * FROM ring UNION ALL SELECT 'layer_violations', * FROM bad) y WHERE y.what = x.what AND y.k = x.k AND y.t <> x.t) GROUP BY ALL""",
        "ring", "bad",
    ),
    "manifest_diff": _with("SELECT CASE WHEN ord % 13 = 0 THEN 'added' WHEN ord % 19 = 0 THEN 'removed' WHEN ord % 17 = 0 THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS n FROM module WHERE NOT (ord % 13 = 0 AND ord % 19 = 0) GROUP BY ALL", "module"),
    "edge_recall": _with(
        """, a AS (SELECT DISTINCT src, dst FROM edge WHERE kind <> 'dynamic'), b AS (SELECT DISTINCT src, dst FROM edge WHERE resolved), c AS (SELECT id FROM (SELECT src AS id FROM a UNION SELECT dst FROM a) INTERSECT SELECT id FROM (SELECT src AS id FROM b UNION SELECT dst FROM b)),
        x AS (SELECT * FROM a WHERE src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c)), y AS (SELECT * FROM b WHERE src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c))
        SELECT (SELECT count(*) FROM y) AS n_other, (SELECT count(*) FROM (SELECT * FROM y EXCEPT SELECT * FROM x)) AS n_missed, (SELECT count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y)) AS n_extra""",
        "edge",
    ).replace("\n, a AS", ", a AS"),
    "trend": "SELECT worse, better, CASE WHEN worse > better + 5 THEN 'regressed' WHEN better > worse + 5 THEN 'improved' ELSE 'stable' END AS direction FROM (SELECT CAST(greatest(0, n % 9 - 4) + n % 3 * 12 + n % 2 * 10 + n % 5 * 4 AS BIGINT) AS worse, CAST(greatest(0, 4 - n % 9) + n % 4 * 8 + n % 7 * 3 AS BIGINT) AS better FROM (SELECT count(*) AS n FROM part))",
    "matrix_by_area": _with("SELECT * FROM matrix", "matrix", group_src=_AREA.format("e2.src"), group_dst=_AREA.format("e2.dst")),
    "matrix_by_layer": _with("SELECT * FROM matrix WHERE violations > 0 ORDER BY violations * 1000 + cycle_edges * 100 + imports DESC, from_group, to_group LIMIT 10", "matrix", group_src=_LAYER.format("e2.src"), group_dst=_LAYER.format("e2.dst")),
    "impact_risk": _with(
        """SELECT source, affected, cycles, violations, CASE WHEN cycles > 0 OR violations > 1 OR affected >= 10 THEN 'high' WHEN violations > 0 OR affected >= 3 THEN 'medium' ELSE 'low' END AS risk FROM (
        SELECT i.source, count(*) - 1 AS affected, coalesce(any_value(r.n), 0) AS cycles, coalesce(any_value(l.n), 0) AS violations FROM importer i LEFT JOIN ring_of r ON r.id = i.source LEFT JOIN layer_end l ON l.id = i.source GROUP BY i.source)""",
        "importer", "ring_of", "layer_end",
    ),
    "ownership": _with(
        f"""SELECT area, count(*) AS modules, CAST(sum(hit) AS BIGINT) AS findings, {_HALF.format('sum(hotness + coupling + fan_in + fan_out + hit * 10)')} AS risk, coalesce(max_by(kind, ord) FILTER (WHERE kind <> 'module'), 'module') AS primary_kind, count(*) >= 3 AND sum(hit) / count(*) >= CAST(0.3 AS DOUBLE) AS drift FROM (
        SELECT *, {_AREA.format('id')} AS area, CASE WHEN in_cycle OR id IN (SELECT id FROM layer_end) OR id IN (SELECT id FROM bound_end) OR id IN (SELECT id FROM zone) THEN 1 ELSE 0 END AS hit FROM metric) GROUP BY area""",
        "metric", "layer_end", "bound_end", "zone", n=40,
    ),
    "semantic_surface": _with("(SELECT 'broad' AS list, id, n_exports, risk FROM surface WHERE n_exports >= 8 OR (n_exports >= 4 AND fan_in >= 4) ORDER BY risk DESC, id LIMIT 20) UNION ALL (SELECT 'quiet', id, n_exports, risk FROM surface WHERE n_exports > 0 AND fan_in = 0 AND kind NOT IN ('entry', 'test') ORDER BY n_exports DESC, id LIMIT 20) UNION ALL (SELECT 'types', id, n_exports, risk FROM surface WHERE kind = 'schema' OR regexp_matches(id, '(^|/)(types?|schemas?|models?)(/|\\.)') ORDER BY risk DESC, id LIMIT 20)", "surface"),
    "dead_code": _with('SELECT id, loc, kind, "group" FROM dead', "dead"),
    "module_risk": _with("SELECT id, cycle_count, violation_count, risk FROM risky", "risky", n=40),
    "overview": _with(" UNION ALL ".join((_ROLL.format("area", _AREA.format("id")), _ROLL.format("folder", "regexp_replace(id, '/[^/]*$', '')"), _ROLL.format("layer", _LAYER.format("id")))), "risky", n=40),
    "folder_explorer": _with(f"SELECT folder, count(*) AS modules, CAST(sum(loc) AS BIGINT) AS loc, {_HALF.format('sum(risk) FILTER (WHERE place <= 5)')} AS top_risk, min_by(id, place) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY risk DESC, id) AS place FROM (SELECT *, array_to_string(string_split(regexp_replace(id, '/[^/]*$', ''), '/')[1:3], '/') AS folder FROM risky)) GROUP BY folder", "risky", n=40),
    "cycles_model": _with(f"SELECT string_agg(id, ',' ORDER BY id) AS modules, count(*) AS length, CASE WHEN count(*) <= 2 THEN 'direct' ELSE 'indirect' END AS severity, count(DISTINCT {_AREA.format('id')}) AS n_areas, count(DISTINCT {_AREA.format('id')}) > 1 AS crosses, {_HALF.format('sum(risk)')} AS risk FROM member JOIN risky USING (id) GROUP BY comp", "risky", "member", n=40),
    "rules_model": _with("SELECT 'layer:' || src_layer || '>' || dst_layer AS rule, severity, count(*) AS n, count(DISTINCT src) AS n_modules FROM violation GROUP BY ALL UNION ALL SELECT 'contract:' || rule, severity, count(*), count(DISTINCT src) FROM boundary GROUP BY ALL", "violation", "boundary"),
    "review_risk": _with(
        f"""SELECT raw, greatest(0, least(100, raw)) AS score, CASE WHEN greatest(0, least(100, raw)) >= 80 THEN 'critical' WHEN greatest(0, least(100, raw)) >= 55 THEN 'high' WHEN greatest(0, least(100, raw)) >= 25 THEN 'medium' ELSE 'low' END AS level FROM (
        SELECT CAST((SELECT {_whole('s')} FROM graded) + (SELECT count(*) FROM cycle WHERE severity = 'direct') * 12 + (SELECT count(*) FROM violation WHERE severity = 'error') * 10 + (SELECT count(*) FROM boundary WHERE severity = 'error') * 10 + least(15, (SELECT count(*) FROM zone) * 2) + (SELECT count(*) FROM whole_signal WHERE severity = 'high' AND confidence = 'high' AND maturity = 'stable') * 8 + least(22, (SELECT count(*) FROM lived WHERE n > 0 AND kind NOT IN ('component', 'service', 'store')) * 12 + (SELECT sum(n) FROM lived) * 3) AS BIGINT) AS raw)""",
        "graded", "boundary", "zone", "whole_signal", "lived", n=40, edges="edge",
    ),
    "briefing": _with(f"SELECT id, kind, {_SIX.format('w')} AS weight FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {_SIX.format('w')} DESC, id) AS place FROM ranked) WHERE place <= 2 ORDER BY {_SIX.format('w')} DESC, id LIMIT 6", "ranked", n=40).replace(f"{_SIX.format('w')} AS weight", "CAST(floor(w * 1000 + 0.5) AS DOUBLE) / 1000 AS weight"),
    "affected_areas": _with(f"SELECT {_AREA.format('id')} AS area, count(*) AS n, count(DISTINCT id) AS n_modules FROM (SELECT src AS id FROM violation UNION ALL SELECT dst FROM violation) GROUP BY ALL", "violation"),
    "fix_plan": _with(
        """SELECT place, type, id, floor(weight * 1000000 + 0.5) / 1000000 AS weight, targets, generated,
  array_to_string(list_filter([CASE WHEN safe AND safe_n <= 8 THEN 'safe-first' END, CASE WHEN high AND high_n <= 8 THEN 'high-impact' END, CASE WHEN look AND look_n <= 8 THEN 'review-before-change' END], lambda x: x IS NOT NULL), ',') AS groups
FROM (SELECT *, row_number() OVER w AS place, count(*) FILTER (WHERE safe) OVER w AS safe_n, count(*) FILTER (WHERE high) OVER w AS high_n, count(*) FILTER (WHERE look) OVER w AS look_n FROM (
  SELECT *, type IN ('unreachable-from-entries', 'barrel-cycle') AS safe, weight >= 80 AND NOT generated AS high, type IN ('cycle', 'layer-violation', 'contract-violation', 'hot-zone') AS look FROM (
    SELECT type, id, CASE WHEN generated THEN weight * CAST(0.1 AS DOUBLE) ELSE weight END AS weight, array_to_string(targets, ',') AS targets, generated, stage, by_, then_ FROM (
      SELECT *, len(list_filter(targets, lambda t: t NOT LIKE 'src/core/%' AND CAST(regexp_extract(t, '/(\\d+)(/index)?\\.ts$', 1) AS BIGINT) % 3 <> 0)) = 0 AS generated FROM plan_found))
  ORDER BY weight DESC, stage, by_, then_, type LIMIT 100) WINDOW w AS (ORDER BY weight DESC, stage, by_, then_, type ROWS UNBOUNDED PRECEDING))""",
        "plan_found", n=40,
    ),
    "hygiene": _with(
        """SELECT list, row_number() OVER (PARTITION BY list ORDER BY a DESC, b DESC, id) AS place, id, value, note FROM (
  SELECT 'removable' AS list, id, worth AS a, 0 AS b, worth AS value, '' AS note FROM item WHERE kind NOT IN ('entry', 'test') AND ord % 6 <> 0 AND fan_in = 0 AND fan_out = 0 AND n_exports = 0 AND NOT is_infra
  UNION ALL SELECT 'entry-candidate', id, fan_out, worth, worth, '' FROM item WHERE kind NOT IN ('entry', 'test') AND ord % 6 <> 0 AND fan_in = 0 AND fan_out > 0
  UNION ALL SELECT 'generated-pressure', id, worth, 0, worth, '' FROM item WHERE ord % 6 = 0 AND (fan_in + fan_out >= 20 OR loc >= 500)
  UNION ALL SELECT 'lifecycle-risk', id, n, 0, n, 'medium' FROM lived WHERE n > 0
  UNION ALL SELECT 'side-effect-owner', id, CASE WHEN kind IN ('component', 'service', 'store') THEN 0 ELSE 1 END, n, n, CASE WHEN kind IN ('component', 'service', 'store') THEN 'owned' ELSE 'review' END FROM lived WHERE n > 0) QUALIFY place <= 30""",
        "item", "lived",
    ),
    "report_status": _with(
        """SELECT layer, CASE WHEN EXISTS (SELECT 1 FROM violation WHERE src_layer = layer AND severity = 'error') OR EXISTS (SELECT 1 FROM boundary WHERE src LIKE 'src/' || layer || '/%' AND severity = 'error') THEN 'blocking'
  WHEN EXISTS (SELECT 1 FROM zone WHERE id LIKE 'src/' || layer || '/%') THEN 'review' ELSE 'clean' END AS status FROM (SELECT unnest(['app', 'pages', 'widgets', 'features', 'entities', 'shared', 'core']) AS layer)
UNION ALL SELECT 'all', CASE WHEN (SELECT grade FROM graded) IN ('D', 'F') OR EXISTS (SELECT 1 FROM violation WHERE severity = 'error') OR EXISTS (SELECT 1 FROM boundary WHERE severity = 'error') OR EXISTS (SELECT 1 FROM cycle WHERE severity = 'direct') THEN 'blocking'
  WHEN EXISTS (SELECT 1 FROM cycle) OR EXISTS (SELECT 1 FROM zone) THEN 'review' ELSE 'clean' END""",
        "violation", "boundary", "zone", "cycle", "graded", n=40,
    ),
    "ui_matrix": _with(
        f"""SELECT c.from_group, f.place AS from_place, c.to_group, t.place AS to_place, imports, violations, severity, cycle_edges FROM (
  SELECT from_group, to_group, count(*) AS imports, count(bad) AS violations, CASE max(bad) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'normal' END AS severity, count(*) FILTER (WHERE (src, dst) IN (SELECT (src, dst) FROM follow)) AS cycle_edges FROM lane GROUP BY ALL) c
JOIN place f ON f.g = c.from_group JOIN place t ON t.g = c.to_group""",
        "lane", "place", "follow", area_src=_AREA.format("e2.src"), area_dst=_AREA.format("e2.dst"),
    ),
    "history_trend": _with("SELECT *, score - lag(score) OVER (PARTITION BY project ORDER BY scanned_at) AS delta FROM snapshot", "snapshot"),
    "kept_snapshots": _with("SELECT * FROM snapshot QUALIFY row_number() OVER (PARTITION BY project ORDER BY scanned_at DESC) <= 10", "snapshot"),
    "scan_totals": _with("SELECT (SELECT count(*) FROM module) AS modules, (SELECT CAST(sum(loc) AS BIGINT) FROM module) AS loc, count(*) AS edges, count(*) FILTER (WHERE kind = 'type-only') AS type_only, count(*) FILTER (WHERE kind = 'dynamic') AS dynamic FROM edge", "module", "edge"),
    "search_words": _with(f"SELECT id, {_SIX.format('s')} AS score FROM (SELECT id, least(1.0, (0.0 + {_hit('widget')} + {_hit('red')} + {_hit('12')}) / (3 * 0.5)) AS s FROM searchable) WHERE s > 0 ORDER BY s DESC, length(id), id LIMIT 100", "searchable"),
    "search_prefixes": _with(f"SELECT id, {_SIX.format('CASE WHEN s > 0 THEN s ELSE 0.5 END')} AS score FROM (SELECT id, least(1.0, {_hit('blue')} / 0.5) AS s FROM searchable WHERE (contains(id, 'core') OR contains(id, 'shared')) AND kind = 'util' AND len(list_filter(exports, lambda x: contains(x, 'bolt'))) > 0) ORDER BY CASE WHEN s > 0 THEN s ELSE 0.5 END DESC, length(id), id LIMIT 100", "searchable"),
    "search_imports": _with("SELECT id, CAST(0.5 AS DOUBLE) AS score FROM module WHERE id IN (SELECT src FROM e WHERE contains(specifier, './1')) ORDER BY length(id), id LIMIT 1000", "module", "e"),
    "module_matches": _with("SELECT id FROM module WHERE contains(id, 'core/small/1') ORDER BY length(id), id LIMIT 25", "module"),
    "discovery": """
        WITH p AS (SELECT p_partkey % 11 AS h, p_partkey % 9 AS t, ['src/','tests/','e2e/','out/','.storybook/','src/__snapshots__/','lib/.idea/','test/','.vercel/','src/__tests__/','src/app/'][CAST(p_partkey % 11 AS INTEGER) + 1] || ['a.ts','a.config.js','vite.config.ts','a.stories.vue','a.d.mts','a.spec.tsx','a.story.ts','1a.ts','eslint.config.tsx'][CAST(p_partkey % 9 AS INTEGER) + 1] AS path FROM part)
        SELECT path, CASE WHEN h IN (3, 6) THEN 'dir' WHEN h IN (2, 4, 5, 9) OR t = 5 THEN 'test' WHEN t = 3 THEN 'story' WHEN t = 4 THEN 'types' WHEN t IN (2, 8) THEN 'config' WHEN h = 10 AND t = 7 THEN 'excluded' ELSE 'source' END AS why, count(*) AS n FROM p GROUP BY ALL""",
    "module_kinds": """
        WITH p AS (SELECT ['src/api/','src/model/','tests/','src/types/','src/utils/','src/theme/','src/services/','src/router/','src/'][CAST(p_partkey % 9 AS INTEGER) + 1] AS head, ['.ts','.vue','.test.ts','.config.js','Loader.ts','.server.ts','.client.tsx'][CAST(p_partkey % 7 AS INTEGER) + 1] AS tail FROM part)
        SELECT CASE WHEN head = 'tests/' OR tail = '.test.ts' THEN 'test' WHEN tail = '.config.js' THEN 'config' WHEN head = 'src/theme/' THEN 'style' WHEN tail = '.vue' THEN 'component'
          WHEN head = 'src/api/' THEN 'api' WHEN head = 'src/services/' THEN 'service' WHEN head = 'src/model/' THEN 'model' WHEN head = 'src/types/' THEN 'schema' WHEN head = 'src/router/' THEN 'route' WHEN head = 'src/utils/' THEN 'util' ELSE 'module' END AS kind,
        tail = '.config.js' AS infra, CASE tail WHEN '.server.ts' THEN 'server' WHEN '.client.tsx' THEN 'client' ELSE 'shared' END AS runtime, count(*) AS n FROM p GROUP BY ALL""",
    "line_counts": "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS lines FROM documents",
    "import_resolution": _with("SELECT DISTINCT src, dst AS wanted, dst FROM edge UNION ALL SELECT DISTINCT src, NULL, NULL FROM edge", "edge"),
    "alias_resolution": _with("SELECT DISTINCT src, dst AS wanted, CASE WHEN split_part(dst, '/', 2) IN ('app', 'core', 'pages') THEN dst END AS dst FROM edge UNION SELECT src, NULL, NULL FROM edge", "edge"),
    "prefix_expansion": _with("SELECT DISTINCT a.id AS src, b.id AS dst FROM module a JOIN module b ON a.id <> b.id AND starts_with(b.id, regexp_extract(a.id, '^(src/[^/]+/[^/]+/)', 1))", "module"),
    "glob_expansion": _with("SELECT 'src/app/main.ts' AS src, id AS dst FROM module WHERE regexp_matches(id, '^src/app/small/[^/]*\\.ts$') AND NOT regexp_matches(id, '^src/app/small/1[^/]*\\.ts$') UNION ALL SELECT 'src/core/all.ts', id FROM module WHERE regexp_matches(id, '^src/core/(.*/)?[^/]*7\\.ts$')", "module"),
    "name_registry": _with("SELECT DISTINCT e2.src, m.id AS dst FROM edge e2 JOIN module m ON regexp_extract(m.id, '([^/]*)\\.ts$', 1) = substr(e2.specifier, 3) WHERE m.id <> e2.src AND (e2.src, m.id) NOT IN (SELECT (src, dst) FROM edge WHERE kind = 'static')", "edge", "module"),
    "entry_points": _with("SELECT id AS rel_path FROM module WHERE regexp_matches(id, '^src/app/(.*/)?[^/]*5\\.ts$')", "module"),
    "page_links": "SELECT regexp_matches(s, '\\.(css|scss|sass|less|styl|svg|png|jpe?g|gif|webp|avif|ico|woff2?|ttf|otf|eot|mp[34]|webm|json|wasm|md|txt|html|graphql|gql)(\\?.*)?$') AS asset, NOT regexp_matches(s, '^(\\.|/|~/|@/|#)') AS external, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS s FROM pages) GROUP BY ALL",
    "parsed_sources": "SELECT 'src/' || p_partkey || '.ts' AS rel_path, CAST(6 AS BIGINT) AS loc, 'static:./' || p_name || ',type-only:./t,dynamic:./lazy' || p_size || CASE WHEN p_size % 2 = 0 THEN ',re-export:./all' ELSE ',side-effect:./side' END AS imports, lower(p_type) AS exports FROM part",
    "git_log": "SELECT 'a@x.org' AS author, CASE WHEN l_linenumber % 4 = 0 THEN 'src/new/' ELSE 'src/' END || l_partkey || '.ts' AS path, CASE WHEN l_linenumber % 4 = 0 THEN 'src/old/' || l_partkey || '.ts' END AS renamed_from, count(*) AS n, CAST(sum(CASE WHEN l_linenumber <> 5 THEN CAST(trunc(l_quantity) AS BIGINT) END) AS BIGINT) AS added, CAST(sum(l_suppkey) AS BIGINT) AS removed FROM lineitem GROUP BY ALL",
    "debounced_changes": "SELECT user_id AS watch_id, min(ts) AS started, count(*) AS n_events, string_agg(DISTINCT 'src/' || event_type || '.ts', ',' ORDER BY 'src/' || event_type || '.ts') AS paths FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 12 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY user_id, s",
    "incremental_edges": _with("SELECT 'edge' AS what, src, dst, specifier FROM edge WHERE src NOT IN (SELECT id FROM module WHERE ord % 10 = 7) AND dst NOT IN (SELECT id FROM module WHERE ord % 10 = 7) UNION ALL SELECT 'warning', src, '', specifier FROM edge WHERE src NOT IN (SELECT id FROM module WHERE ord % 10 = 7) AND dst IN (SELECT id FROM module WHERE ord % 10 = 7)", "edge", "module"),
}
