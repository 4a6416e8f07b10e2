"""The registered queries of the text operators, over whole tables, and their SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, dominance
from . import license as lic
from . import mixing, packing, pii, quality, rules, simhash, suffixes, toxicity, webp, webtext
from .common import table, written

TOKENIZER = "word_bpe_49k.json"
TREE = ["domain", "lang", "source"]
#: Whole-number weights; children that aren't listed have 1.
WEIGHTS = {"domain": {"web": 5, "books": 3, "forum": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
SHARE, EPOCHS, SEED = (8, 10), 3, "mix-1"
#: The domain of a source, by the last digit of its name.
DOMAIN = "CASE WHEN source RLIKE '[0-4]$' THEN 'web' WHEN source RLIKE '[5-7]$' THEN 'books' ELSE 'forum' END"


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lic.scan_licenses(table(spark, sf_dir, "documents"))


def op2_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digests(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_policy(rules.stored(table(spark, sf_dir, "documents")))
    base = F.col("fail_bits").bitwiseAND(F.lit(rules.mask(rules.BASE_RULES))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "n_upper", "n_letters", "n_marks", "fail_bits")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ablations(rules.stored(table(spark, sf_dir, "documents")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), TOKENIZER)


def with_tree(docs: DataFrame) -> DataFrame:
    """Adds ``domain`` and ``n_tokens``; nulls in tree columns become empty strings."""
    named = docs.withColumns({c: F.coalesce(c, F.lit("")) for c in ("lang", "source")})
    return named.withColumns({"domain": F.expr(DOMAIN), "n_tokens": mixing.n_tokens()})


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(with_tree(table(spark, sf_dir, "documents")).select("doc_id", *TREE, "n_tokens"), "tokens")
    ends = mixing.prefixes(docs, TREE, WEIGHTS, SHARE, EPOCHS, SEED)
    return mixing.taken(docs, ends, TREE, SEED).select("doc_id", *TREE, "n_tokens", "epoch", "taken")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dominance.dominated(table(spark, sf_dir, "sales"), "sale_id", "sold_at", "total")
    return rows.withColumnsRenamed({"n_above": "n_sales", "w_above": "n_rows"})


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.extracted(table(spark, sf_dir, "pages"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license, op2_webp, op3_simhash, op4_toxicity, op5_suffixes, op6_rules, op7_packing, op8_mixing, op9_pii, op10_quality,
        op11_dominance, op12_html, op13_divergence, rule_ablations,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    places, labels = [], []
    for phrase, label in lic.BASE.items():
        words = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        places.append(f"list_filter(range(1, greatest(len(w) - {len(words) - 2}, 1)), lambda i: {same})")
        labels.append(f"CASE WHEN len(p{len(places)}) > 0 THEN '{label}' END")
    more = [f"CASE WHEN regexp_matches(t, ' {lic.as_regex(markup)}') THEN '{name}' END" for name, markup in lic.TEMPLATES.items()]
    return f"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
found AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t, {', '.join(f'{x} AS p{k}' for k, x in enumerate(places, 1))} FROM words),
named AS (SELECT doc_id, w, list_concat({', '.join(f'p{k}' for k in range(1, len(places) + 1))}) AS p, list_filter([{', '.join(labels)}], lambda x: x IS NOT NULL) AS base, list_filter([{', '.join(more)}], lambda x: x IS NOT NULL) AS more FROM found)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) - 1 AS BIGINT) AS first_word, CAST(list_max(p) - 1 AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(base, more))), ','), '') AS labels,
  CAST(CASE WHEN len(list_filter(more, lambda x: NOT ends_with(x, '{lic.PARTIAL}'))) > 0 THEN 1.0 WHEN len(more) > 0 THEN 0.75 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
FROM named"""


_LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
w AS (SELECT row, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT row, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM w),
windows AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM grams),
twice AS (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM windows),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM (SELECT row, i, unnest([0, 1, 2]) AS k FROM twice WHERE n > 1) GROUP BY row),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters, length(t) - length(replace(t, '!', '')) AS n_marks
  FROM w LEFT JOIN covered c USING (row)),
ledger AS (SELECT *, CAST(BITS AS BIGINT) AS fail_bits FROM m)
""".replace("BITS", " + ".join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, (_, condition) in enumerate(rules.RULES)))

_RULES_SQL = f"""{_LEDGER_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {rules.mask(rules.BASE_RULES)}) <> 0 AS base_failed, (fail_bits & {rules.mask(rules.POLICIES[rules.CURRENT])}) = 0 AS kept, n_lines, CAST(n_upper AS BIGINT) AS n_upper, CAST(n_letters AS BIGINT) AS n_letters, CAST(n_marks AS BIGINT) AS n_marks, fail_bits FROM ledger"""


def _ablations_sql() -> str:
    names = [name for name, _ in rules.RULES]
    pairs = ", ".join(f"({v}, '{r}', {rules.mask(rules.POLICIES[v])}, {1 << names.index(r)})" for v in rules.POLICIES for r in rules.POLICIES[v])
    count = lambda condition, to: f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT) AS {to}"
    return f"""{_LEDGER_SQL}, p AS (SELECT CAST(col0 AS BIGINT) AS policy, col1 AS rule, CAST(col2 AS BIGINT) AS mask, CAST(col3 AS BIGINT) AS bit FROM (VALUES {pairs}))
SELECT policy, rule, {count('(fail_bits & bit) <> 0', 'n_failing')}, {count('(fail_bits & mask) = bit', 'n_failing_alone')}, {count('(fail_bits & mask & ~bit) = 0', 'n_kept_without')}, {count('(fail_bits & mask) = 0', 'n_kept')}
FROM ledger, p GROUP BY policy, rule"""


def _mixing_sql() -> str:
    """The same budgets by plain windows; each leaf's last pass is one sorted running sum."""

    def weight(c: str) -> str:
        return "CASE " + c + "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS[c].items()) + " ELSE 1 END" if c in WEIGHTS else "1"

    parts = [f"""
WITH docs AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, ''), '[0-4]$') THEN 'web' WHEN regexp_matches(coalesce(source, ''), '[5-7]$') THEN 'books' ELSE 'forum' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORDS}')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CAST(sum(n_tokens) AS HUGEINT) * {EPOCHS} AS cap FROM docs GROUP BY ALL),
level0 AS (SELECT least(sum(tokens) * {SHARE[0]} // {SHARE[1]}, sum(cap)) AS alloc FROM leaves)"""]
    for depth, name in enumerate(TREE):
        parents, own = TREE[:depth], TREE[: depth + 1]
        by, alias = ", ".join(parents) or "1", depth + 1
        join = f"JOIN level{depth} USING ({', '.join(parents)})" if parents else "CROSS JOIN level0"
        parts.append(f"""
n{alias} AS (SELECT {', '.join(own)}, c.cap, c.tokens, alloc AS budget, CAST({weight(name)} AS HUGEINT) AS weight FROM (SELECT {', '.join(own)}, CAST(sum(cap) AS HUGEINT) AS cap, CAST(sum(tokens) AS HUGEINT) AS tokens FROM leaves GROUP BY ALL) c {join}),
f{alias} AS (SELECT *, cap * sum(weight) OVER (PARTITION BY {by} ORDER BY CAST(cap AS DOUBLE) / CAST(greatest(weight, 1) AS DOUBLE), {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= (budget - coalesce(sum(cap) OVER (PARTITION BY {by} ORDER BY CAST(cap AS DOUBLE) / CAST(greatest(weight, 1) AS DOUBLE), {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS is_full FROM n{alias}),
o{alias} AS (SELECT *, CASE WHEN is_full THEN 0 ELSE weight END AS w, budget - coalesce(sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {by}), 0) AS rest FROM f{alias}),
u{alias} AS (SELECT *, sum(w) OVER (PARTITION BY {by} ORDER BY {name}) AS upto, greatest(sum(w) OVER (PARTITION BY {by}), 1) AS whole FROM o{alias}),
level{alias} AS (SELECT {', '.join(own)}, tokens, CAST(CASE WHEN is_full THEN cap ELSE rest * upto // whole - rest * (upto - w) // whole END AS HUGEINT) AS alloc FROM u{alias})""")
    leaf = ", ".join(TREE)
    parts.append(f"""
given AS (SELECT {leaf}, CAST(alloc // tokens AS BIGINT) AS passes, CAST(alloc % tokens AS BIGINT) AS rest FROM level{len(TREE)} WHERE alloc > 0),
hashed AS (SELECT docs.*, passes, rest, md5('{SEED}|' || passes || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || n_tokens) AS hash FROM docs JOIN given USING ({leaf}) WHERE n_tokens > 0),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS start FROM hashed),
cut AS (SELECT *, CASE WHEN start < rest THEN least(n_tokens, rest - start) ELSE 0 END AS part FROM placed),
out AS (SELECT *, unnest(range(0, passes + CASE WHEN part > 0 THEN 1 ELSE 0 END)) AS epoch FROM cut)
SELECT doc_id, {leaf}, n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(CASE WHEN epoch < passes THEN n_tokens ELSE part END AS BIGINT) AS taken FROM out""")
    return ",".join(parts)


#: DuckDB has no crc32: its table from the polynomial, then one step a byte.
_DOMINANCE_SQL = """
WITH steps AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
coded AS (SELECT sale_id, CAST(floor(epoch(sold_at) / 3600) AS BIGINT) AS slot, CAST(floor(floor(100 * total + 0.5) / 100) AS BIGINT) AS level,
  list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM sales),
placed AS (SELECT sale_id, slot, level, 1 + coalesce(xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 2, 0) AS w FROM coded, steps),
points AS (SELECT slot, level, count(*) AS n, sum(w) AS w FROM placed WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY ALL),
above AS (SELECT a.slot, a.level, coalesce(sum(b.n), 0) AS n, coalesce(sum(b.w), 0) AS w FROM points a LEFT JOIN points b ON b.slot <= a.slot AND b.level > a.level GROUP BY ALL)
SELECT sale_id, slot, level, CAST(n AS BIGINT) AS n_sales, CAST(above.w AS BIGINT) AS n_rows FROM placed LEFT JOIN above USING (slot, level)"""


_P = "1 + CAST(1000000000 AS HUGEINT) * (coalesce({c}, 0) + 2) // nullif({n} + 2 * v, 0)"
_F = "({p} - {q}) * ({p} - {q}) // ({p} + {q})"
#: Every pair of sources over every kept term, without vectors.
_DIVERGENCE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
words AS (SELECT row, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 10),
own AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(lang_n, 0) AS lang_n, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN sizes USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM own GROUP BY ALL) USING (lang, source)),
shares AS (SELECT g.lang, g.source, k.term, c, {_P.format(c='c', n='n')} AS p, {_P.format(c='total', n='lang_n')} AS q FROM groups g JOIN kept k USING (lang) LEFT JOIN own USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum({_F.format(p='a.p', q='b.p')}) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, {_F.format(p='p', q='q')} AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms QUALIFY rank <= 10))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked"""


ORACLE = {"op11_dominance": _DOMINANCE_SQL, "op13_divergence": _DIVERGENCE_SQL, "op1_license": _license_sql(), "op6_rules": _RULES_SQL, "rule_ablations": _ablations_sql(), "op8_mixing": _mixing_sql()}
