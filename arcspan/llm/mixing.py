"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A tree of columns (domain, language, source) carries weights at every node. A
node's budget goes to its children by weight; a child can't take more than
``max_epochs`` times the tokens below it. What it can't take goes to its
siblings, again by weight, and only what a whole subtree can't take has gone
to the siblings of an ancestor: capacities are summed from the leaves up
before budgets go from the root down. Sharing out under caps needs no loop:
children in order of capacity over weight saturate one after another until
the common level holds, which is a window over a node's children. All of it is
integer arithmetic, and the parts of a node add up to it exactly.

A leaf then takes its budget as a prefix of its epochs: whole passes over its
documents, then those documents of one more pass, in an order given by a hash
of seed, epoch and the columns that tell rows apart, whose tokens come first;
the last one is cut, so a leaf's tokens are its budget exactly. The prefix is
found without sorting a leaf: hashes fall into ``4096`` ranges, one sum each;
only the range that holds the end is looked at document by document, and what
is left to know is one hash per leaf. Rows that share it (copies of one row)
are numbered within the task that wrote them, and tasks' counts are added up.
So neither a hot leaf nor a text goes through a task or a shuffle whole.

Defined cases: a null or blank text has no tokens and is never taken; a null in
a tree column is a child named with the empty string; children without a
weight have ``default``, those of weight 0 take nothing; repeated rows stand
next to each other in the order and each takes its own tokens (which of rows
that are equal is cut makes no difference); rows whose key is null or shared
are told apart by the other columns of the order; an empty table gives no rows;
other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WHOLE = "decimal(38,0)"
WORDS = r"[^\x20\x09-\x0D]+"


def n_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def _weight(name: str, weights: dict[str, int], default: int) -> Column:
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]
    return (F.coalesce(F.element_at(F.create_map(*pairs), F.col(name)), F.lit(default)) if pairs else F.lit(default)).cast(WHOLE)


def shared_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds ``alloc`` to children with ``weight``, ``cap`` and the parent's ``budget``.

    ``cap`` is 0 where the weight is; budgets don't exceed the children's sum.
    """
    node = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    in_order = node.orderBy(F.col("cap").cast("double") / F.greatest(F.col("weight"), F.lit(1)).cast("double"), name)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, -1)
    rest = in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(so_far), F.lit(0)).cast(WHOLE)
    full = F.col("cap") * F.sum("weight").over(rest).cast(WHOLE) <= (F.col("budget") - before) * F.col("weight")
    nodes = nodes.withColumn("full", full).withColumn("open_weight", F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight")).cast(WHOLE))
    nodes = nodes.withColumn("open_budget", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0).cast(WHOLE))).over(node).cast(WHOLE))
    upto = F.sum("open_weight").over(node.orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast(WHOLE)
    nodes = nodes.withColumn("upto", upto).withColumn("whole", F.greatest(F.sum("open_weight").over(node).cast(WHOLE), F.lit(1).cast(WHOLE)))
    edge = lambda w: F.expr(f"CAST(CAST(open_budget * ({w}) AS {WHOLE}) DIV whole AS {WHOLE})")
    part = edge("upto") - edge("upto - open_weight")
    return nodes.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(part).cast("long")).drop("full", "open_weight", "open_budget", "upto", "whole")


def budgets(leaves: DataFrame, tree: list[str], weights: dict[str, dict[str, int]], budget: Column, max_epochs: int, default: int = 1) -> DataFrame:
    """``tree columns, tokens, alloc`` of each leaf; ``leaves`` has its ``tokens``.

    ``budget`` is an aggregate over the leaves, such as a share of ``sum(tokens)``.
    """
    zero = reduce(lambda a, b: a | b, [_weight(c, weights.get(c, {}), default) == 0 for c in tree])
    leaves = leaves.withColumn("cap", F.when(zero, F.lit(0)).otherwise(F.col("tokens") * max_epochs).cast(WHOLE))
    level = leaves.groupBy().agg(F.least(budget.cast(WHOLE), F.sum("cap").cast(WHOLE)).cast("long").alias("alloc"))
    for depth, name in enumerate(tree):
        parents, own = tree[:depth], tree[: depth + 1]
        nodes = leaves.groupBy(*own).agg(F.sum("cap").cast(WHOLE).alias("cap"), F.sum("tokens").cast("long").alias("tokens"))
        above = level.select(*parents, F.col("alloc").cast(WHOLE).alias("budget"))
        nodes = nodes.join(above, parents) if parents else nodes.crossJoin(above)  # one row above
        level = shared_out(nodes.withColumn("weight", _weight(name, weights.get(name, {}), default)), parents, name)
    return level.select(*tree, "tokens", "alloc")


ORDER = ("doc_id", "n_tokens")


def _hash(seed: str, epoch: Column, order: tuple[str, ...]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order)))


def prefixes(docs: DataFrame, tree: list[str], weights: dict[str, dict[str, int]], share: tuple[int, int], max_epochs: int, seed: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """One row per leaf that gets tokens: its whole passes and where the next one ends.

    ``docs`` has the tree columns (no nulls) and those of ``order``, which
    holds ``n_tokens``, so rows at one place have as many tokens each; the
    budget is ``share`` (a fraction) of all tokens. Columns: tree, ``passes``,
    ``rest`` (tokens of the last pass), ``end_hash`` and ``end_before`` (the
    hash of the document in which it ends and the tokens before that).
    """
    leaves = docs.groupBy(*tree).agg(F.sum("n_tokens").alias("tokens"))
    budget = F.expr(f"CAST(SUM(tokens) AS {WHOLE}) * {share[0]} DIV {share[1]}")
    given = budgets(leaves, tree, weights, budget, max_epochs).where("alloc > 0")
    given = written(given.select(*tree, F.expr("CAST(alloc DIV tokens AS INT)").alias("passes"), (F.col("alloc") % F.col("tokens")).alias("rest")), "budgets")
    hashed = docs.where("n_tokens > 0").join(given.where("rest > 0"), tree).select(*tree, "rest", "n_tokens", _hash(seed, F.col("passes"), order).alias("hash")).withColumn("range", F.substring("hash", 1, 3))
    sums = hashed.groupBy(*tree, "rest", "range").agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy(*tree).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    last = sums.where("before < rest AND rest <= before + n").select(*tree, "range", "before")
    near = hashed.join(last, [*tree, "range"]).groupBy(*tree, "rest", "before", "hash").agg(F.sum("n_tokens").alias("n"))
    near = near.withColumn("start", F.col("before") + F.sum("n").over(Window.partitionBy(*tree).orderBy("hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    ends = near.where("start < rest AND rest <= start + n").select(*tree, F.col("hash").alias("end_hash"), F.col("start").alias("end_before"))
    return written(given.join(ends, tree, "left"), "prefixes")


def taken(docs: DataFrame, ends: DataFrame, tree: list[str], seed: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """A row for each document and epoch that takes of it: all columns, ``epoch`` and ``taken`` tokens."""
    rows = docs.where("n_tokens > 0").join(ends, tree).withColumn("hash", F.when(F.col("rest") > 0, _hash(seed, F.col("passes"), order)))
    at_end = F.coalesce(F.col("hash") == F.col("end_hash"), F.lit(False))
    others = rows.where(~at_end).withColumn("part", F.when(F.col("hash") < F.col("end_hash"), F.col("n_tokens")).otherwise(F.lit(0)).cast("long"))
    # the rows at the end of a leaf's prefix, most often one: numbered by task, then taken one after another
    tied = written(rows.where(at_end).withColumn("task", F.spark_partition_id()), "ends")
    counts = tied.groupBy(*tree, "task").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("earlier", F.sum("n").over(Window.partitionBy(*tree).orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy(*tree, "task").orderBy(F.xxhash64(*order))) - 1
    left = F.col("rest") - F.col("end_before") - (F.col("earlier") + F.col("nth")) * F.col("n_tokens")
    tied = tied.withColumn("nth", nth).join(counts, [*tree, "task"]).withColumn("part", F.greatest(F.lit(0), F.least(F.col("n_tokens"), left)).cast("long"))
    both = others.unionByName(tied.select(*others.columns)).where("passes > 0 OR part > 0")
    epochs = F.sequence(F.lit(0), F.col("passes") - F.when(F.col("part") > 0, 0).otherwise(1))
    out = both.withColumn("epoch", F.explode(epochs)).withColumn("taken", F.when(F.col("epoch") < F.col("passes"), F.col("n_tokens")).otherwise(F.col("part")))
    return out.drop("passes", "rest", "end_hash", "end_before", "hash", "part")
