"""Queries between tables: declared and used, grouped and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features
from ..operators import relations as rel
from . import base
from .registry import query


@query("SELECT o_orderkey FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem) USING (o_orderkey)")
def unreferenced_keys(spark, sf):
    used = base.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return rel.unreferenced(base.table(spark, sf, "orders").select("o_orderkey"), used, ["o_orderkey"])


@query("SELECT DISTINCT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def unknown_references(spark, sf):
    return rel.unknown(base.table(spark, sf, "documents").select("doc_id"), base.table(spark, sf, "labels"), ["doc_id"]).distinct()


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id) ANTI JOIN (SELECT doc_id FROM documents WHERE n_chars < 500) USING (doc_id) ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'de') USING (doc_id)")
def orphan_rows(spark, sf):
    docs = base.table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    left = rel.unreferenced(docs, base.table(spark, sf, "labels"), ["doc_id"])
    return rel.unreferenced(rel.unreferenced(left, docs.where("n_chars < 500"), ["doc_id"]), docs.where("lang = 'de'"), ["doc_id"]).select("doc_id")


@query("SELECT p_brand, count(DISTINCT p_size) AS n, array_to_string(list_sort(list(DISTINCT CAST(p_size AS VARCHAR))), ', ') AS listed FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) > 1")
def incompatible_versions(spark, sf):
    return rel.several(base.table(spark, sf, "part"), "p_brand", "p_size")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 10")
def many_suppliers(spark, sf):
    rows = base.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return rows.groupBy("l_partkey").agg(F.count("*").alias("suppliers")).where("suppliers >= 10")


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned, bool_or(l_linestatus = 'O') AS open, bool_or(l_quantity > 45) AS large FROM lineitem GROUP BY l_orderkey")
def reference_sites(spark, sf):
    return rel.flags(base.table(spark, sf, "lineitem"), ["l_orderkey"], returned=F.col("l_returnflag") == "R", open=F.col("l_linestatus") == "O", large=F.col("l_quantity") > 45)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 50 THEN 0 ELSE 1 END, ts, event_id) = 1")
def group_representative(spark, sf):
    located = F.when(F.col("value") > 50, F.col("value"))
    return rel.representative(base.table(spark, sf, "events"), "user_id", located, ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT doc_id, n_chars AS published, strlen(coalesce(text, '')) AS recomputed FROM documents WHERE n_chars IS DISTINCT FROM strlen(coalesce(text, ''))")
def published_vs_recomputed(spark, sf):
    docs = base.documents(spark, sf)
    return rel.compare(docs.select("doc_id", "n_chars"), docs.select("doc_id", F.octet_length("text").cast("bigint").alias("n_chars")), "doc_id", "n_chars")


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS published, recomputed FROM orders FULL JOIN (SELECT l_orderkey AS o_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS recomputed FROM lineitem GROUP BY l_orderkey) USING (o_orderkey) WHERE CAST(round(o_totalprice * 100) AS BIGINT) IS DISTINCT FROM recomputed")
def order_totals(spark, sf):
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    told = base.table(spark, sf, "orders").select("o_orderkey", cents("o_totalprice").alias("total"))
    own = base.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(cents("l_extendedprice")).alias("total"))
    return rel.compare(told, own, "o_orderkey", "total")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return base.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT l_orderkey, count(*) AS defects FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM lineitem) WHERE before >= l_linenumber GROUP BY l_orderkey")
def sorted_unique_defects(spark, sf):
    rows = base.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return rel.order_defects(rows, "l_orderkey", ["l_linenumber"], "l_linenumber").groupBy("l_orderkey").agg(F.count("*").alias("defects"))


# Regions hold nations, these suppliers and customers; some suppliers lead back to another nation, others nowhere.
EDGES = """SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child, n_nationkey % 3 = 0 AS gated FROM {nation} UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, s_suppkey % 4 = 0 FROM {supplier}
  UNION ALL SELECT 's' || s_suppkey, 'n' || (s_suppkey % 25), s_suppkey % 2 = 0 FROM {supplier} WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, false FROM {customer} WHERE c_custkey % 2 = 0"""


@query(f"""WITH RECURSIVE e AS ({EDGES.format(nation='nation', supplier='supplier', customer='customer')}), walk(node, gated) AS (SELECT 'r0', false UNION SELECT e.child, w.gated OR e.gated FROM walk w JOIN e ON e.parent = w.node) SELECT node, bool_and(gated) AS gated FROM walk GROUP BY node""")
def module_closure(spark, sf):
    """What the first region reaches, and whether every way there is gated."""
    edges = spark.sql(EDGES, **{t: base.table(spark, sf, t) for t in ("nation", "supplier", "customer")})
    return rel.closure(spark.createDataFrame([("r0", False)], "node string, gated boolean"), edges)


@query("SELECT lang, source, count(*) AS n FROM (SELECT DISTINCT lang, source, text FROM documents) GROUP BY lang, source")
def distinct_rows(spark, sf):
    rows = base.table(spark, sf, "documents").select("lang", "source", F.sha2("text", 256).alias("digest"))
    return rows.distinct().groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000")
def coverage_queue(spark, sf):
    orders = base.table(spark, sf, "orders")
    used = lambda w: orders.where(w).select(F.col("o_custkey").alias("c_custkey"))
    every = base.table(spark, sf, "customer").select("c_custkey").distinct()
    return rel.unreferenced(rel.unreferenced(every, used("o_orderstatus = 'F'"), ["c_custkey"]), used("o_totalprice > 250000"), ["c_custkey"])


@query("""WITH left_ AS (SELECT DISTINCT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'deny' WHEN 'MACHINERY' THEN 'warn' ELSE 'allow' END AS level FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 250000) USING (c_custkey))
  SELECT c_custkey, level, row_number() OVER (ORDER BY level <> 'warn', c_custkey) - 1 AS place FROM left_ WHERE level <> 'deny'""")
def coverage_order(spark, sf):
    """Customers as rules with levels, those with a large order as decided: what is left to decide, in order."""
    level = F.when(F.col("c_mktsegment") == "BUILDING", "deny").when(F.col("c_mktsegment") == "MACHINERY", "warn").otherwise("allow")
    decided = base.table(spark, sf, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return rel.queue(base.table(spark, sf, "customer").select("c_custkey", level.alias("level")), decided, "c_custkey", "level")


# Documents as files of the workspace that is their source.
TREE = """f AS (SELECT source, doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN 'tests' WHEN doc_id % 7 = 1 THEN 'target' WHEN doc_id % 7 = 2 THEN '.git' ELSE 'src' END || '/d' || doc_id || '/' AS folder, 'f' || doc_id % 50 || CASE WHEN doc_id % 9 = 0 THEN '.txt' ELSE '.rs' END AS name, n_chars % 11 = 0 AS generated FROM documents)"""


@query(f"""WITH {TREE}, e AS (SELECT *, folder || name AS path, row_number() OVER (PARTITION BY source ORDER BY folder || name) AS n FROM f)
  SELECT source, path, CASE WHEN path LIKE 'tests/%' THEN 'tests' END AS context FROM e WHERE n <= 40 AND name LIKE '%.rs' AND path NOT LIKE 'target/%' AND path NOT LIKE '.git/%' AND NOT coalesce(generated, false)
  AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0) AND doc_id % 5 > 0 AND (source, name) NOT IN (SELECT (source, name) FROM f WHERE doc_id % 41 = 0)""")
def orphan_files(spark, sf):
    """Files that nothing compiles, includes or names, of the first 40 entries of each workspace."""
    docs, k = base.table(spark, sf, "documents"), F.col("doc_id")
    text = k.cast("string")
    folder = F.when(k % 7 == 0, "tests").when(k % 7 == 1, "target").when(k % 7 == 2, ".git").otherwise("src")
    name = F.concat(F.lit("f"), (k % 50).cast("string"), F.when(k % 9 == 0, ".txt").otherwise(".rs"))
    files = docs.select("source", k, name.alias("name"), F.concat(folder, F.lit("/d"), text, F.lit("/"), name).alias("path"), (F.col("n_chars") % 11 == 0).alias("generated"))
    compiled = files.join(base.table(spark, sf, "labels").where("doc_id % 2 = 0").select("doc_id"), "doc_id", "left_semi")
    return rel.orphans(files.select("source", "path", "generated"), compiled, files.where("doc_id % 5 = 0"), files.where("doc_id % 41 = 0"), "source", 40)


# Suppliers as packages: the lines they sold declare features, some with an entry; the orders of first lines read one.
FEATURES = """k AS (SELECT l_suppkey AS package, l_orderkey, l_linenumber, l_orderkey + l_partkey AS n FROM lineitem),
declared AS (SELECT package, CASE WHEN n % 997 = 0 THEN 'default' ELSE 'f' || n % 997 END AS feature, CASE l_linenumber WHEN 5 THEN 'f' || (n + 1) % 997 WHEN 6 THEN 'dep:f' || (n + 2) % 997 WHEN 7 THEN 'd/f' || (n + 3) % 997 END AS entry FROM k),
read_ AS (SELECT DISTINCT l_orderkey AS place, package, 'f' || l_orderkey * 5 % 997 AS feature FROM k WHERE l_linenumber <= 2)"""


def _features(spark, sf):
    lines = base.table(spark, sf, "lineitem")
    n = F.col("l_orderkey") + F.col("l_partkey")
    name = lambda x: F.concat(F.lit("f"), (x % 997).cast("string"))
    at = F.col("l_linenumber")
    entry = F.when(at == 5, name(n + 1)).when(at == 6, F.concat(F.lit("dep:"), name(n + 2))).when(at == 7, F.concat(F.lit("d/"), name(n + 3)))
    declared = lines.select(F.col("l_suppkey").alias("package"), F.when(n % 997 == 0, "default").otherwise(name(n)).alias("feature"), F.array_compact(F.array(entry)).alias("activates"))
    # An order has two such lines at most.
    read = lines.where(at <= 2).groupBy(F.col("l_orderkey").alias("place")).agg(F.collect_set("l_suppkey").alias("packages")).withColumn("feature", name(F.col("place") * 5))
    return declared, read


@query(f"WITH {FEATURES} SELECT package, feature FROM declared WHERE feature <> 'default' GROUP BY package, feature HAVING count(entry) = 0 EXCEPT SELECT package, entry FROM declared WHERE entry NOT LIKE '%/%' AND entry NOT LIKE 'dep:%' EXCEPT SELECT package, feature FROM read_ EXCEPT SELECT s_suppkey, 'f' || s_nationkey FROM supplier")
def unread_features(spark, sf):
    """Declared without effect, listed by no other feature, read by no place of its package, not of an optional dependency."""
    optional = base.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("package"), F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("feature"))
    return features.unread(*_features(spark, sf), optional)


@query(f"WITH {FEATURES}, known AS (SELECT DISTINCT package, feature FROM declared) SELECT place, feature FROM read_ r LEFT JOIN (SELECT *, true AS known FROM known) USING (package, feature) GROUP BY place, feature HAVING NOT bool_or(coalesce(known, false))")
def undeclared_features(spark, sf):
    """Read where no package that compiles the place declares it."""
    declared, read = _features(spark, sf)
    return features.undeclared(read, declared, ["place"])
