import re
from collections import Counter

from arcspan.llm import queries, rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(odd_rows):
    for _, t, *_ in odd_rows + [(0, "a b c a b c a b"), (0, "x y z w x y z\nq\nq\n q"), (0, "## $5 <b>|")]:
        assert rules.measure((t or "").encode())[:5] == brute(t)


def test_policies_and_ablations(odd, empty):
    rows = rules.ledger(odd).cache()
    kept = {v: rules.apply_policy(rows, v).where("kept").count() for v in rules.POLICIES}
    assert kept[1] >= kept[2] >= kept[3]
    bits = [r.fail_bits for r in rows.collect()]
    for r in rules.ablations(rows).collect():
        mask, bit = rules.mask(rules.POLICIES[r.policy]), rules.mask((r.rule,))
        assert (r.n_failing, r.n_failing_alone, r.n_kept_without, r.n_kept) == (sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits), sum(b & mask & ~bit == 0 for b in bits), kept[r.policy])
    assert rules.ledger(empty).collect() == []


def test_query_on_tables(spark, sf):
    rows = queries.op6_rules(spark, sf).collect()
    assert rows and all(not r.kept for r in rows if r.base_failed)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
