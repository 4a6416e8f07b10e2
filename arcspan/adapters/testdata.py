"""The driver's star schema seen as an architecture: modules, edges, commits, chunks.

The operators know only the canonical tables; this is the one place that
knows Parquet names. Modules are parts, edges lead from one line item of an
order to the next (of large quantities only, which keeps the graph sparse),
commits are orders, bundle chunks are supplier nations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAYERS = ("app", "pages", "widgets", "features", "entities", "shared", "core")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def module_id(key: str, kind: str):
    """``src/<layer>/<type>/<key>.ts``; every 40th part is a folder's index."""
    layer = F.element_at(F.array(*map(F.lit, LAYERS)), (F.col(key) % len(LAYERS) + 1).cast("int"))
    tail = F.when(F.col(key) % 40 == 0, F.lit("/index.ts")).otherwise(F.lit(".ts"))
    return F.concat(F.lit("src/"), layer, F.lit("/"), F.lower(kind), F.lit("/"), F.col(key).cast("string"), tail)


def modules(spark: SparkSession, d: str) -> DataFrame:
    """``id, kind, language, loc, n_exports, is_infra, runtime, is_server_actions, ord``.

    A table that grows with the project is not sent to the driver to be broadcast, however small its file is.
    """
    k = F.col("p_partkey")
    kind = F.when(F.col("p_type") == "SMALL", "util").when(F.col("p_type") == "LARGE", "component").when(F.col("p_type") == "PROMO", "store").when(F.col("p_type") == "ECONOMY", "service").otherwise("module")
    return table(spark, d, "part").select(
        module_id("p_partkey", "p_type").alias("id"), kind.alias("kind"),
        F.when(F.col("p_size") % 5 == 0, "vue").otherwise("ts").alias("language"),
        (F.col("p_size") * 20).cast("long").alias("loc"), (F.col("p_size") % 9).cast("long").alias("n_exports"),
        (k % 97 == 0).alias("is_infra"),
        F.when(k % 5 == 0, "client").when(k % 5 == 1, "server").otherwise("shared").alias("runtime"),
        (k % 35 == 1).alias("is_server_actions"), k.alias("ord"),
    ).hint("merge")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """``ord, src, dst, kind, specifier, resolved``; a multigraph in principle."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    # what stands before an order's first large quantity is part of no edge: a tenth of the rows is left before any text is made
    items = items.withColumn("begun", F.max(F.col("l_quantity") >= 49).over(order)).where("begun").drop("begun")
    items = items.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type").hint("merge"), "l_partkey")
    items = items.withColumns({"src": module_id("l_partkey", "p_type"), "dst_key": F.lead("l_partkey").over(order)})
    items = items.withColumn("dst", F.lead("src").over(order)).where("dst IS NOT NULL AND l_quantity >= 49")
    kind = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "type-only").when(F.col("l_returnflag") == "N", "dynamic").otherwise("static")
    place = F.concat_ws("|", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), "src", "dst")
    return items.select(place.alias("ord"), "src", "dst", kind.alias("kind"), F.concat(F.lit("./"), F.col("dst_key").cast("string")).alias("specifier"), (F.col("l_linenumber") != 7).alias("resolved"))


def commits(spark: SparkSession, d: str) -> DataFrame:
    """``sha, author, authored_at``."""
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("sha"), F.concat(F.lit("u"), (F.col("o_custkey") % 50).cast("string")).alias("author"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("authored_at"))


def changes(spark: SparkSession, d: str, by: str = "part") -> DataFrame:
    """``sha, path, renamed_from, added, removed``; ``by`` takes the path from parts or suppliers."""
    items = table(spark, d, "lineitem")
    if by == "part":
        items = items.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
        path = module_id("l_partkey", "p_type")
    else:
        path = supplier_path("l_suppkey")
    return items.select(F.col("l_orderkey").cast("string").alias("sha"), path.alias("path"), F.lit(None).cast("string").alias("renamed_from"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("long")).alias("added"), F.floor(F.col("l_tax") * 100).cast("long").alias("removed"))


def supplier_path(key: str):
    layer = F.element_at(F.array(*map(F.lit, LAYERS)), (F.col(key) % len(LAYERS) + 1).cast("int"))
    return F.concat(F.lit("src/"), layer, F.lit("/s"), F.col(key).cast("string"), F.lit(".ts"))


def supplier_modules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(supplier_path("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"))


def supplier_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier imports the next one of its nation."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return table(spark, d, "supplier").withColumn("next", F.lead("s_suppkey").over(w)).where("next IS NOT NULL").select(supplier_path("s_suppkey").alias("src"), supplier_path("next").alias("dst"), F.lit("static").alias("kind"))


def chunk_modules(spark: SparkSession, d: str) -> DataFrame:
    """``chunk_id, path, size``: parts that suppliers of a nation ship; every fifth lies outside the project."""
    items = table(spark, d, "lineitem").where("l_quantity >= 48").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    own = module_id("l_partkey", "p_type")
    path = F.when(F.col("l_partkey") % 5 == 4, F.concat(F.lit("node_modules/p"), F.col("l_partkey").cast("string"), F.lit("/index.js"))).when(F.col("l_partkey") % 5 == 3, F.regexp_replace(own, "^src/", "")).otherwise(own)
    return items.groupBy(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("chunk_id"), path.alias("path")).agg(F.floor(F.max("l_extendedprice")).cast("long").alias("size"))


def watch_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("watch_id"), "ts", F.concat(F.lit("src/"), F.col("event_type"), F.lit(".ts")).alias("path"))


#: The same projections for the SQL that checks the operators.
SQL_LAYER = "['" + "', '".join(LAYERS) + "'][CAST({0} % 7 AS INTEGER) + 1]"
SQL_ID = "'src/' || " + SQL_LAYER + " || '/' || lower(p_type) || '/' || {0} || CASE WHEN {0} % 40 = 0 THEN '/index.ts' ELSE '.ts' END"
SQL_SUPPLIER = "'src/' || " + SQL_LAYER + " || '/s' || {0} || '.ts'"
SQL = {
    "module": f"SELECT {SQL_ID.format('p_partkey')} AS id, CASE p_type WHEN 'SMALL' THEN 'util' WHEN 'LARGE' THEN 'component' WHEN 'PROMO' THEN 'store' WHEN 'ECONOMY' THEN 'service' ELSE 'module' END AS kind, CASE WHEN p_size % 5 = 0 THEN 'vue' ELSE 'ts' END AS language, CAST(p_size * 20 AS BIGINT) AS loc, CAST(p_size % 9 AS BIGINT) AS n_exports, p_partkey % 97 = 0 AS is_infra, CASE p_partkey % 5 WHEN 0 THEN 'client' WHEN 1 THEN 'server' ELSE 'shared' END AS runtime, p_partkey % 35 = 1 AS is_server_actions, p_partkey AS ord FROM part",
    "edge": f"SELECT ord, src, dst, kind, specifier, resolved FROM (SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '|' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '|' || src || '|' || dst AS ord, * FROM (SELECT *, lead(src) OVER w AS dst, './' || lead(l_partkey) OVER w AS specifier, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'type-only' WHEN l_returnflag = 'N' THEN 'dynamic' ELSE 'static' END AS kind, l_linenumber <> 7 AS resolved FROM (SELECT l.*, {SQL_ID.format('l_partkey')} AS src FROM lineitem l JOIN part ON p_partkey = l_partkey) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) WHERE dst IS NOT NULL AND l_quantity >= 49)",
    "git_commit": "SELECT CAST(o_orderkey AS VARCHAR) AS sha, 'u' || (o_custkey % 50) AS author, strftime(o_orderdate, '%Y-%m-%d') AS authored_at FROM orders",
    "git_change": f"SELECT CAST(l_orderkey AS VARCHAR) AS sha, {SQL_ID.format('l_partkey')} AS path, CASE WHEN l_linenumber <> 3 THEN CAST(trunc(l_quantity) AS BIGINT) END AS added, CAST(floor(l_tax * 100) AS BIGINT) AS removed FROM lineitem JOIN part ON p_partkey = l_partkey",
    "supplier_change": f"SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS sha, {SQL_SUPPLIER.format('l_suppkey')} AS path FROM lineitem",
    "supplier_edge": f"SELECT {SQL_SUPPLIER.format('s_suppkey')} AS src, {SQL_SUPPLIER.format('nxt')} AS dst FROM (SELECT s_suppkey, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nxt FROM supplier) WHERE nxt IS NOT NULL",
    "chunk_module": f"SELECT 'n' || s_nationkey AS chunk_id, CASE l_partkey % 5 WHEN 4 THEN 'node_modules/p' || l_partkey || '/index.js' WHEN 3 THEN substr({SQL_ID.format('l_partkey')}, 5) ELSE {SQL_ID.format('l_partkey')} END AS path, CAST(floor(max(l_extendedprice)) AS BIGINT) AS size FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 48 GROUP BY ALL",
}
