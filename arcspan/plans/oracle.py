"""SQL for the registered queries, written apart from the operators, for an engine that runs plain SQL."""

from __future__ import annotations

from ..adapters.testdata import SQL

# reusable relations; a query names what it needs
_PARTS: dict[str, tuple[str, ...]] = {}
_TEXT: dict[str, str] = {}


def _part(name: str, text: str, *needs: str) -> None:
    _TEXT[name], _PARTS[name] = text, needs


for _name in SQL:
    _part(_name, SQL[_name])

_LAYER = "CASE WHEN regexp_extract({0}, '^(?:src/)*([^/]+)(?:/|$)', 1) IN ('app','pages','widgets','features','entities','shared','core') THEN regexp_extract({0}, '^(?:src/)*([^/]+)(?:/|$)', 1) ELSE 'unknown' END"
_RANK = "list_position(['app','pages','widgets','features','entities','shared','core'], {0}) - 1"
_HALF = "CAST(floor(({0}) * 1000 + 0.5) AS DOUBLE) / 1000"

_part("e", "SELECT * FROM edge WHERE kind <> 'type-only'", "edge")
_part("closure", "SELECT DISTINCT src, dst FROM e UNION SELECT c.src, e.dst FROM closure c JOIN e ON c.dst = e.src", "e")
_part("member", "SELECT a.src AS id, least(min(a.dst), a.src) AS comp FROM closure a JOIN closure b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src", "closure")
_part("cycle", "SELECT comp, count(*) AS length, CASE WHEN count(*) <= 2 THEN 'direct' ELSE 'indirect' END AS severity, string_agg(id, ',' ORDER BY id) AS modules FROM member GROUP BY comp", "member")
_part("fan", "SELECT m.*, (SELECT count(*) FROM e WHERE e.dst = m.id) AS fan_in, (SELECT count(*) FROM e WHERE e.src = m.id) AS fan_out FROM module m", "module", "e")
_part("top", "SELECT max(log2(fan_in + 1) * log2(fan_out + 1)) AS raw, max(loc) AS loc FROM fan", "fan")
_part(
    "metric",
    f"""SELECT f.*, {_HALF.format('CASE WHEN fan_in + fan_out = 0 THEN 0.0 ELSE CAST(fan_out AS DOUBLE) / (fan_in + fan_out) END')} AS instability, member.id IS NOT NULL AS in_cycle,
  {_HALF.format('CASE WHEN top.raw = 0 THEN 0.0 ELSE log2(fan_in + 1) * log2(fan_out + 1) / top.raw END')} AS coupling,
  {_HALF.format('CASE WHEN top.raw = 0 THEN 0.0 ELSE log2(fan_in + 1) * log2(fan_out + 1) / top.raw END * CASE WHEN member.id IS NOT NULL THEN 1.5 ELSE 1.0 END * CASE WHEN top.loc = 0 THEN 1.0 ELSE 1 + log2(1 + f.loc) / log2(1 + top.loc) END')} AS hotness
  FROM fan f LEFT JOIN member USING (id), top""",
    "fan", "top", "member",
)
_part("hot", "SELECT id, hotness, fan_out, n_exports, loc FROM metric WHERE NOT is_infra AND hotness > 0 ORDER BY hotness DESC, id LIMIT {n}", "metric")
_BARREL = "fan_out >= 3 AND greatest(fan_out, n_exports) >= 5 AND loc < 4 * greatest(fan_out, n_exports)"
_part("layered", f"SELECT id, {_LAYER.format('id')} AS layer FROM module", "module")
_OVER = "CASE WHEN regexp_matches(id, '^src/core/small/.+') THEN 'shared' WHEN regexp_matches(id, '^src/app/large/.') THEN 'entities' ELSE " + _LAYER.format("id") + " END"
_part("overridden", f"SELECT id, {_OVER} AS layer FROM module", "module")
for _src, _to in (("layered", "violation"), ("overridden", "violation_over")):
    _part(_to, f"SELECT e.*, a.layer AS src_layer, b.layer AS dst_layer, CASE WHEN {_RANK.format('b.layer')} <= 1 AND {_RANK.format('a.layer')} >= 4 THEN 'error' ELSE 'warning' END AS severity FROM e JOIN {_src} a ON a.id = e.src JOIN {_src} b ON b.id = e.dst WHERE e.resolved AND a.layer <> 'unknown' AND b.layer <> 'unknown' AND {_RANK.format('a.layer')} > {_RANK.format('b.layer')}", "e", _src)
_part(
    "boundary",
    """SELECT 'boundary:' || rule || ':' || (row_number() OVER (PARTITION BY rule ORDER BY ord) - 1) AS id, rule, severity, src, dst, specifier, ord FROM (
  SELECT 'core-alone' AS rule, 'error' AS severity, * EXCLUDE (kind, resolved) FROM e WHERE resolved AND src <> dst AND src LIKE 'src/core/%' AND dst LIKE 'src/app/%'
  UNION ALL SELECT 'features-apart', 'warning', * EXCLUDE (kind, resolved) FROM e WHERE resolved AND src <> dst AND src LIKE 'src/features/%/%' AND dst LIKE 'src/features/%/%' AND split_part(src, '/', 3) <> split_part(dst, '/', 3)
  UNION ALL SELECT 'shared-only', 'error', * EXCLUDE (kind, resolved) FROM e WHERE resolved AND src <> dst AND src LIKE 'src/shared/%' AND dst NOT LIKE 'src/core/%' AND dst NOT LIKE 'src/shared/%' AND dst NOT LIKE 'src/entities/small/%')""",
    "e",
)
_part("debt_in", f"""SELECT greatest(1, count(*) FILTER (WHERE NOT is_infra)) AS n, coalesce(avg(instability) FILTER (WHERE NOT is_infra), 0.0) AS inst,
  (SELECT coalesce(sum(CASE severity WHEN 'direct' THEN 2 ELSE 1 END), 0) FROM cycle) AS rings, (SELECT coalesce(sum(CASE severity WHEN 'error' THEN 3 ELSE 1 END), 0) FROM violation) AS bad, (SELECT count(*) FROM hot WHERE NOT ({_BARREL})) AS hots FROM metric""", "metric", "cycle", "violation", "hot")
_part("debt_part", "SELECT 1 - 1 / (1 + rings / greatest(1.0, n * CAST(0.05 AS DOUBLE))) AS c, 1 - 1 / (1 + bad / greatest(1.0, n * CAST(0.03 AS DOUBLE))) AS l, 1 - 1 / (1 + hots * 10 / n) AS h, inst FROM debt_in", "debt_in")
_part("debt", "SELECT least(100.0, 100 * (c * CAST(0.35 AS DOUBLE) + l * CAST(0.3 AS DOUBLE) + h * CAST(0.15 AS DOUBLE) + inst * CAST(0.2 AS DOUBLE))) AS s, c, l, h, inst FROM debt_part", "debt_part")
_part("graded", "SELECT CASE WHEN s < 15 THEN 'A' WHEN s < 30 THEN 'B' WHEN s < 50 THEN 'C' WHEN s < 70 THEN 'D' ELSE 'F' END AS grade, * FROM debt", "debt")
_part("comp", "SELECT m.id, coalesce(k.comp, m.id) AS comp FROM module m LEFT JOIN (SELECT id, comp FROM member WHERE comp IN (SELECT comp FROM cycle WHERE length > 1)) k USING (id)", "module", "member", "cycle")
_part("link", "SELECT DISTINCT a.comp AS src, b.comp AS dst FROM e JOIN comp a ON a.id = e.src JOIN comp b ON b.id = e.dst WHERE a.comp <> b.comp", "e", "comp")
_part("way", "SELECT DISTINCT comp, 0 AS depth FROM comp WHERE {start} UNION SELECT l.dst, w.depth + 1 FROM way w JOIN link l ON l.src = w.comp", "comp", "link")
_part("weak", "SELECT id, id AS other FROM module UNION SELECT w.id, CASE WHEN e.src = w.other THEN e.dst ELSE e.src END FROM weak w JOIN e ON e.src = w.other OR e.dst = w.other", "module", "e")
_part("root", "SELECT id, min(other) AS root FROM weak GROUP BY id", "weak")
_part("client_way", "SELECT DISTINCT e.src AS client, e.dst AS id FROM e JOIN module a ON a.id = e.src JOIN module b ON b.id = e.dst WHERE a.runtime = 'client' AND b.runtime = 'shared' UNION SELECT w.client, e.dst FROM client_way w JOIN e ON e.src = w.id JOIN module b ON b.id = e.dst WHERE b.runtime = 'shared'", "e", "module")
_part("direct_leak", "SELECT DISTINCT e.src, e.dst FROM e JOIN module a ON a.id = e.src JOIN module b ON b.id = e.dst WHERE a.runtime = 'client' AND b.runtime = 'server' AND NOT b.is_server_actions", "e", "module")
_part("touch", "SELECT sha, path AS id, sum(coalesce(added, 0) + coalesce(removed, 0)) AS lines FROM git_change GROUP BY sha, path", "git_change")
_part("by_author", "SELECT id, author, count(*) AS n, sum(lines) AS lines, max(authored_at) AS last, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, author) AS place FROM touch JOIN git_commit USING (sha) GROUP BY id, author", "touch", "git_commit")
_part("co_set", "SELECT * FROM supplier_change WHERE sha IN (SELECT sha FROM supplier_change GROUP BY sha HAVING count(*) <= 8)", "supplier_change")
_part("co_one", "SELECT path, count(*) AS n FROM co_set GROUP BY path", "co_set")
_part("co_pair", "SELECT x.path AS a, y.path AS b, count(*) AS co FROM co_set x JOIN co_set y ON x.sha = y.sha AND x.path < y.path GROUP BY ALL HAVING count(*) >= 20", "co_set")
_part("co_score", "SELECT p.*, co / x.n AS score_a, co / y.n AS score_b, least(co / x.n, co / y.n) AS score, NOT EXISTS (SELECT 1 FROM supplier_edge s WHERE least(s.src, s.dst) = a AND greatest(s.src, s.dst) = b) AS hidden, split_part(a, '/', 2) <> split_part(b, '/', 2) AS cross_boundary FROM co_pair p JOIN co_one x ON x.path = a JOIN co_one y ON y.path = b", "co_pair", "co_one", "supplier_edge")
_part("attached", "SELECT c.*, coalesce(a.id, b.id) AS id FROM chunk_module c LEFT JOIN module a ON a.id = c.path LEFT JOIN module b ON b.id = 'src/' || c.path", "chunk_module", "module")
_part("near", "SELECT id, 0 AS distance, id AS source, true AS up FROM module UNION SELECT id, 0, id, false FROM module UNION SELECT CASE WHEN up THEN e.src ELSE e.dst END, distance + 1, source, up FROM near n JOIN edge e ON CASE WHEN up THEN e.dst ELSE e.src END = n.id WHERE distance < 3", "module", "edge")
_part("importer", "SELECT id AS source, id FROM module UNION SELECT i.source, edge.src FROM importer i JOIN edge ON edge.dst = i.id", "module", "edge")


def _with(body: str, *needs: str, **values) -> str:
    """The query with the relations it needs, each after those that it needs itself."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in _PARTS[name]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    text = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_TEXT[n]})" for n in order) + "\n" + body
    for k, v in values.items():
        text = text.replace("{" + k + "}", str(v))
    return text


_whole = lambda x: f"CAST(floor(({x}) + 0.5) AS BIGINT)"
_BUDGET_SQL = """
SELECT 'budget:' || rule || ':' || (row_number() OVER (PARTITION BY rule ORDER BY ord, k) - 1) AS id, * EXCLUDE (ord, k) FROM (
  SELECT 'app' AS rule, 'error' AS severity, id AS module, metric, value, CAST("limit" AS BIGINT) AS "limit", ord, k FROM (SELECT id, ord, unnest([{'metric': 'fan_in', 'value': fan_in, 'limit': 2, 'k': 0}, {'metric': 'fan_out', 'value': fan_out, 'limit': 3, 'k': 1}, {'metric': 'loc', 'value': loc, 'limit': 900, 'k': 2}], recursive := true) FROM fan WHERE id LIKE 'src/app/%') WHERE value > "limit"
  UNION ALL SELECT 'indexes', 'warning', id, 'fan_out', fan_out, 1, ord, 1 FROM fan WHERE id LIKE '%/index.ts' AND fan_out > 1
  UNION ALL SELECT 'rings', 'error', 'src/**', 'cycles', count(DISTINCT comp), 0, 0, 9 FROM member HAVING count(DISTINCT comp) > 0)"""

ORACLE = {
    "module_metrics": _with("SELECT id, fan_in, fan_out, instability, in_cycle, coupling, hotness FROM metric", "metric"),
    "hot_zones": _with(f"SELECT id, hotness FROM hot WHERE NOT ({_BARREL})", "hot", n=40),
    "barrels": _with("SELECT id, fan_out, n_exports FROM fan WHERE fan_out >= 2 AND greatest(fan_out, n_exports) >= 4 AND loc < 40 * greatest(fan_out, n_exports)", "fan"),
    "module_depth": _with("SELECT id, CAST(coalesce(d, 0) AS BIGINT) AS depth FROM comp LEFT JOIN (SELECT comp, max(depth) AS d FROM way GROUP BY comp) USING (comp)", "way", start="comp NOT IN (SELECT dst FROM link)"),
    "module_depth_from_entries": _with("SELECT id, CAST(coalesce(d, 0) AS BIGINT) AS depth FROM comp LEFT JOIN (SELECT comp, max(depth) AS d FROM way GROUP BY comp) USING (comp)", "way", start="id LIKE 'src/app/%'"),
    "scc_members": _with("SELECT id, comp FROM member", "member"),
    "cycle_list": _with("SELECT length, severity, modules FROM cycle", "cycle"),
    "cycle_edge_list": _with("SELECT DISTINCT src, dst, specifier FROM e JOIN member a ON a.id = src JOIN member b ON b.id = dst WHERE a.comp = b.comp", "e", "member"),
    "arch_debt": _with(f"SELECT {_whole('s')} AS score, grade, {_whole('c * 100')} AS cycles, {_whole('l * 100')} AS layer_violations, {_whole('h * 100')} AS hot_zones, {_whole('inst * 100')} AS coupling FROM graded", "graded", n=10),
    "layers": _with("SELECT id, layer FROM layered", "layered"),
    "layers_overridden": _with("SELECT id, layer FROM overridden", "overridden"),
    "layer_violations": _with("SELECT src, dst, src_layer, dst_layer, severity FROM violation", "violation"),
    "layer_violations_overridden": _with("SELECT src_layer, dst_layer, severity, count(*) AS n FROM violation_over GROUP BY ALL", "violation_over"),
    "boundary_violations": _with("SELECT * EXCLUDE (ord) FROM boundary", "boundary"),
    "budget_violations": _with(_BUDGET_SQL, "fan", "member"),
    "contract_suggestions": _with(
        f"""SELECT 'boundary' AS kind, 'features-isolation' AS name, count(DISTINCT split_part(id, '/', 3)) AS n FROM module WHERE id LIKE 'src/features/%/%' HAVING count(DISTINCT split_part(id, '/', 3)) >= 2
        UNION ALL SELECT 'boundary', 'layer-' || a || '-not-' || b, count(*) FROM (SELECT {_LAYER.format('src')} AS a, {_LAYER.format('dst')} AS b FROM e) WHERE a <> 'unknown' AND b <> 'unknown' AND {_RANK.format('a')} > {_RANK.format('b')} GROUP BY a, b
        UNION ALL SELECT 'budget', 'no-cycles-' || replace(x, '/', '-'), count(*) FROM module, (VALUES ('shared'), ('entities'), ('core'), ('shared/ui')) t(x) WHERE starts_with(id, 'src/' || x || '/') AND NOT EXISTS (SELECT 1 FROM member WHERE starts_with(member.id, 'src/' || x || '/')) GROUP BY x""",
        "module", "e", "member",
    ),
    "ci_gates": _with(
        """SELECT gate, actual, failed FROM (SELECT (SELECT grade FROM graded) AS g, (SELECT count(*) FROM cycle) AS c, (SELECT count(*) FROM violation) AS l, (SELECT count(*) FROM boundary) AS b, (SELECT count(*) FROM boundary WHERE severity = 'error') AS x),
        LATERAL (VALUES ('grade:C', g, g >= 'C'), ('cycles:any', CAST(c AS VARCHAR), c > 0), ('cycles:0', CAST(c AS VARCHAR), c > 0), ('layer-violations:>100', CAST(l AS VARCHAR), l > 100), ('contract-violations:5000', CAST(b AS VARCHAR), b > 5000), ('contract-errors:>=1', CAST(x AS VARCHAR), x >= 1)) t(gate, actual, failed)""",
        "graded", "cycle", "violation", "boundary", n=10,
    ),
    "runtime_leaks": _with("SELECT src, dst, true AS direct FROM direct_leak UNION ALL (SELECT DISTINCT w.client AS src, e.dst, false FROM client_way w JOIN e ON e.src = w.id JOIN module b ON b.id = e.dst WHERE b.runtime = 'server' AND NOT b.is_server_actions AND NOT EXISTS (SELECT 1 FROM direct_leak x WHERE x.src = w.client AND x.dst = e.dst))", "direct_leak", "client_way"),
    "transitive_importers": _with("SELECT DISTINCT source, id FROM importer WHERE source <> id", "importer"),
    "importer_counts": _with("SELECT source AS id, count(DISTINCT id) - 1 AS importers FROM importer GROUP BY source", "importer"),
    "bounded_impact": _with("SELECT source, id, CAST(min(distance) AS BIGINT) AS distance FROM near WHERE id <> source GROUP BY source, id", "near"),
    "weak_components": _with("SELECT id, root FROM root", "root"),
    "isolated_clusters": _with("SELECT root, count(*) AS n FROM root JOIN module USING (id) GROUP BY root HAVING count(*) >= 5 AND NOT bool_or(is_infra) AND count(*) <= 0.5 * (SELECT count(*) FROM module)", "root"),
    "folder_tree": _with("SELECT array_to_string(p[1:k], '/') AS folder, k AS depth, count(*) AS n_files, CAST(sum(loc) AS BIGINT) AS loc FROM (SELECT loc, string_split(id, '/') AS p, unnest(range(0, len(string_split(id, '/')))) AS k FROM module) GROUP BY ALL", "module"),
    "churn": _with("SELECT id, CAST(sum(n) AS BIGINT) AS commits, CAST(sum(lines) AS BIGINT) AS lines_changed, count(*) AS author_count, max(last) AS last_touched_at, array_to_string(list_concat(list(author || '=' || n ORDER BY place) FILTER (WHERE place <= 5), CASE WHEN count(*) > 5 THEN ['__other__=' || CAST(sum(n) FILTER (WHERE place > 5) AS BIGINT)] ELSE [] END), ',') AS authors FROM by_author GROUP BY id", "by_author"),
    "temporal_coupling": _with(
        f"""SELECT a, b, co, CAST(floor(score_a * 1000000 + 0.5) AS DOUBLE) / 1000000 AS score_a, CAST(floor(score_b * 1000000 + 0.5) AS DOUBLE) / 1000000 AS score_b, CAST(floor(score * 1000000 + 0.5) AS DOUBLE) / 1000000 AS score, hidden, cross_boundary, risk FROM (
        SELECT *, least(1.0, {_HALF.format('score * (CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * least(1.0, co / 10)) * CASE WHEN hidden THEN CAST(1.25 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END * CASE WHEN hidden AND cross_boundary THEN CAST(1.15 AS DOUBLE) ELSE 1.0 END')}) AS risk, score AS raw FROM co_score WHERE score >= CAST(0.02 AS DOUBLE)) ORDER BY risk DESC, raw DESC, co DESC, a, b LIMIT 200""",
        "co_score",
    ),
    "hotness_against_churn": _with(f"SELECT count(*) AS n, {_HALF.format('corr(x, y)')} AS rho FROM (SELECT rank() OVER (ORDER BY hotness) + (count(*) OVER (PARTITION BY hotness) - 1) / 2 AS x, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2 AS y FROM (SELECT hotness, (SELECT count(*) FROM touch t WHERE t.id = m.id) AS c FROM metric m) WHERE c > 0)", "metric", "touch"),
    "finding_accuracy": _with(
        f"""SELECT tp, nf - tp AS fp, ne - hit AS fn, {_HALF.format('p')} AS precision, {_HALF.format('r')} AS recall, {_HALF.format('2 * p * r / (p + r)')} AS f1 FROM (SELECT *, tp / nf AS p, hit / ne AS r FROM (
        SELECT (SELECT count(DISTINCT (src, dst)) FROM violation) AS nf, (SELECT count(*) FROM boundary) AS ne, (SELECT count(DISTINCT (v.src, v.dst)) FROM violation v JOIN boundary b ON v.src IN (b.src, b.dst) OR v.dst IN (b.src, b.dst)) AS tp, (SELECT count(DISTINCT b.id) FROM violation v JOIN boundary b ON v.src IN (b.src, b.dst) OR v.dst IN (b.src, b.dst)) AS hit))""",
        "violation", "boundary",
    ),
    "extension_counts": _with("SELECT regexp_extract(path, '(\\.[^./]+)$', 1) AS extension, count(*) AS n FROM chunk_module GROUP BY ALL", "chunk_module"),
    "severity_counts": _with("SELECT severity, (SELECT count(*) FROM violation v WHERE v.severity = d.severity) AS n FROM (VALUES ('critical'), ('error'), ('warning'), ('info')) d(severity)", "violation"),
    "bundle_modules": _with("SELECT id, string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id) AS chunks FROM attached WHERE id IS NOT NULL GROUP BY id", "attached"),
    "bundle_duplicates": _with("SELECT id, count(*) AS n_chunks, CAST(sum(size) AS BIGINT) AS size, CASE WHEN count(*) >= 4 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT id, chunk_id, max(size) AS size FROM attached WHERE id IS NOT NULL GROUP BY ALL) GROUP BY id HAVING count(*) >= 2", "attached"),
    "bundle_heavy_chunks": _with("SELECT chunk_id, CAST(sum(size) AS BIGINT) AS chunk_size, CASE WHEN sum(size) >= 8000000 THEN 'high' WHEN sum(size) >= 4000000 THEN 'medium' ELSE 'low' END AS severity FROM attached GROUP BY chunk_id HAVING sum(size) >= 2000000", "attached"),
    "bundle_solo_hot": _with(f"SELECT chunk_id, id, size, {_whole('size / total * 100')} AS share, CASE WHEN total >= 2000000 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT *, sum(size) OVER (PARTITION BY chunk_id) AS total, row_number() OVER (PARTITION BY chunk_id ORDER BY id IS NULL, size DESC, id DESC) AS r FROM attached) WHERE r = 1 AND id IS NOT NULL AND total >= 1000000 AND size / total >= CAST(0.02 AS DOUBLE)", "attached"),
    "bundle_barrel_leaks": _with(
        """SELECT src, count(*) AS n_targets, count(*) FILTER (WHERE w) AS n_together, CASE WHEN count(*) FILTER (WHERE w) >= 8 THEN 'high' ELSE 'medium' END AS severity
        FROM (SELECT regexp_replace(id, '[^/]*$', 'index.ts') AS src, id IN (SELECT id FROM attached WHERE chunk_id IN ('n1', 'n2')) AS w FROM module WHERE id NOT LIKE '%/index.ts') GROUP BY src HAVING count(*) >= 4 AND count(*) FILTER (WHERE w) >= 4 AND count(*) FILTER (WHERE w) / count(*) >= CAST(0.02 AS DOUBLE)""",
        "module", "attached",
    ),
    "display_ids": _with("SELECT id, CASE WHEN len(p) <= 3 THEN id ELSE '…/' || array_to_string(p[-3:], '/') END AS short FROM (SELECT id, string_split(id, '/') AS p FROM module)", "module"),
}
