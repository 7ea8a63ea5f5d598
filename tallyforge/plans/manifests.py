"""Queries of the rules of manifests, build settings, attributes and sizes, over parts and suppliers as such."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import manifests as M
from ..functions import text as T
from ..sources import catalog
from . import base
from .registry import query

SETTINGS = """SELECT p_partkey, p_size % 2 = 0 AS binary_, p_size % 3 > 0 AS released, CASE WHEN p_size % 3 > 0 THEN CASE p_size % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END END AS checks,
  CASE WHEN p_size % 3 > 0 THEN CASE p_partkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN '2' WHEN 2 THEN 'full' WHEN 3 THEN '1' WHEN 4 THEN 'false' END END AS debug,
  CASE WHEN p_size % 3 > 0 THEN CASE p_partkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'symbols' WHEN 2 THEN 'none' END END AS strip FROM part"""


@query(f"SELECT p_partkey, binary_ AND coalesce(checks, '') <> 'true' AS unchecked_overflow, released AND coalesce(debug IN ('true', '2', 'full'), false) AND NOT coalesce(strip IN ('true', 'symbols', 'debuginfo'), false) AS debug_symbols FROM ({SETTINGS})")
def release_profile(spark, sf):
    """Each part as a workspace with a release profile."""
    size, key = F.col("p_size"), F.col("p_partkey")
    released = size % 3 > 0
    checks = F.when(released, F.when(size % 5 == 0, "true").when(size % 5 == 1, "false"))
    debug = F.when(released, F.when(key % 6 == 0, "true").when(key % 6 == 1, "2").when(key % 6 == 2, "full").when(key % 6 == 3, "1").when(key % 6 == 4, "false"))
    strip = F.when(released, F.when(key % 4 == 0, "true").when(key % 4 == 1, "symbols").when(key % 4 == 2, "none"))
    return base.table(spark, sf, "part").select("p_partkey", M.unchecked_overflow(size % 2 == 0, checks).alias("unchecked_overflow"), M.debug_symbols(released, debug, strip).alias("debug_symbols"))


ARGUMENTS = ["--cap-lints", "allow", "--cap-lints=allow", "-A", "warnings", "-Awarnings", "-C", "overflow-checks=off", "-Coverflow-checks=no", "--codegen=overflow-checks=0", "opt-level=3", "-D", "--allow", "overflow-checks=on", "--codegen"]
CHOSEN = " || ' ' || ".join(f"list_extract({ARGUMENTS}, (p_partkey * {k} + p_size * {k + 2}) % {len(ARGUMENTS)} + 1)" for k in (1, 3, 5, 7))
FLAG = """CASE WHEN a = '--cap-lints' AND n = 'allow' OR a = '--cap-lints=allow' THEN '--cap-lints allow'
  WHEN a IN ('-A', '--allow') AND n = 'warnings' OR a IN ('-Awarnings', '--allow=warnings') THEN '-A warnings'
  WHEN a IN ('-C', '--codegen') AND regexp_matches(n, '^overflow-checks=(off|false|no|n|0)$') OR regexp_matches(a, '^(-C|--codegen=)overflow-checks=(off|false|no|n|0)$') THEN '-C overflow-checks=off' END"""


@query(f"WITH s AS (SELECT p_partkey, string_split({CHOSEN}, ' ') AS l FROM part), x AS (SELECT p_partkey, unnest(l) AS a, unnest(l[2:] || ['']) AS n, generate_subscripts(l, 1) AS i FROM s), f AS (SELECT p_partkey, i, {FLAG} AS flag FROM x) SELECT p_partkey, string_agg(flag, ', ' ORDER BY i) AS flags FROM f WHERE flag IS NOT NULL GROUP BY p_partkey")
def rustflags(spark, sf):
    """Flags that switch checks off, of a setting written as one text."""
    some = F.array(*map(F.lit, ARGUMENTS))
    pick = lambda k: F.element_at(some, ((F.col("p_partkey") * k + F.col("p_size") * (k + 2)) % len(ARGUMENTS) + 1).cast("int"))
    setting = F.concat_ws(" ", *map(pick, (1, 3, 5, 7)))
    flags = base.table(spark, sf, "part").select("p_partkey", M.neutralizing(F.split(setting, r"\s+")).alias("f"))
    return flags.where(F.size("f") > 0).select("p_partkey", F.array_join("f", ", ").alias("flags"))


KNOWN = sorted(r[0] for r in catalog.rules() if r[2] == "clippy")[:24]
ENTRIES = f"SELECT p_partkey % 40 AS package, list_extract({KNOWN}, p_partkey % 24 + 1) AS rule, CASE WHEN p_partkey % 3 = 0 THEN 'allow' WHEN p_partkey % 3 = 1 THEN 'warn' ELSE 'deny' END AS level FROM part"


@query(f"WITH e AS ({ENTRIES}), p AS (SELECT DISTINCT package, package % 4 = 0 AS inherits FROM e WHERE package <> 39), own AS (SELECT e.* FROM e JOIN p USING (package) WHERE NOT inherits), root AS (SELECT e.* FROM e WHERE package = 39 AND EXISTS (SELECT 1 FROM p WHERE inherits)) SELECT DISTINCT package, rule FROM (SELECT * FROM own UNION ALL SELECT * FROM root) WHERE level = 'allow' AND rule <> '{KNOWN[3]}'")
def permissive_lint_table(spark, sf):
    """Active catalogued lints that a package's own table allows, and the root's (39) once if any package inherits it."""
    k = F.col("p_partkey")
    rule = F.element_at(F.array(*map(F.lit, KNOWN)), (k % 24 + 1).cast("int"))
    entries = base.table(spark, sf, "part").select((k % 40).alias("package"), rule.alias("rule"), F.when(k % 3 == 0, "allow").when(k % 3 == 1, "warn").otherwise("deny").alias("level"))
    active = F.broadcast(catalog.rule_table(spark).where(F.col("id") != KNOWN[3]).select(F.col("id").alias("rule")))  # the catalog
    inherits = F.col("package") % 4 == 0
    judged = entries.where((F.col("package") != 39) & inherits).select(F.lit(39).cast("bigint").alias("package")).distinct()
    own = entries.where((F.col("package") != 39) & ~inherits)
    every = own.unionByName(entries.where("package = 39").join(judged, "package", "left_semi"))
    return every.where("level = 'allow'").join(active, "rule", "left_semi").select("package", "rule").distinct()


# Each supplier as a workspace: no lock file, one that can't be read, one without packages, or one with two.
LOCK = """CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'version = 4' || chr(10) || 'oops [[' WHEN 2 THEN '# empty' || chr(10) || 'version = 4' ELSE 'version = 4' || chr(10) || '[[package]]' || chr(10) || 'name = "' || s_name || '"' || chr(10) || 'version = "' || s_nationkey || '.1.0"' || chr(10) || '[[package]]' || chr(10) || 'name = "b"' || chr(10) || 'version = "0.1.0"' || chr(10) || 'dependencies = [' || chr(10) || ' "a",' || chr(10) || ']' END"""


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'absent' WHEN 1 THEN 'unusable' ELSE 'packages' END AS state, CASE WHEN s_suppkey % 5 > 2 THEN s_name || ' ' || s_nationkey || '.1.0, b 0.1.0' ELSE '' END AS packages, s_suppkey % 5 = 0 AND s_nationkey % 4 > 0 AS missing FROM supplier")
def missing_lockfile(spark, sf):
    """What each workspace's lock file says; missing is told of those with dependencies and none beside them."""
    rows = base.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.expr(LOCK.replace("chr(10)", "char(10)")).alias("lock"))
    state, packages = M.lock_state(F.col("lock"))
    listed = F.array_join(F.transform(packages, lambda p: F.concat_ws(" ", p["name"], p["version"])), ", ")
    return rows.select("s_suppkey", state.alias("state"), F.coalesce(listed, F.lit("")).alias("packages"), ((state == "absent") & (F.col("s_nationkey") % 4 > 0)).alias("missing"))


PATHS = "SELECT s_suppkey, '/w/n' || s_nationkey AS root, CASE s_suppkey % 4 WHEN 0 THEN '/w/n' || s_nationkey || '/a' WHEN 1 THEN '/w/n' || s_nationkey WHEN 2 THEN '/w/n' || s_nationkey || 'x/a' END AS path FROM supplier"


@query(f"SELECT s_suppkey, path IS NOT NULL AND path <> root AND NOT starts_with(path, root || '/') AS outside FROM ({PATHS})")
def path_outside_workspace(spark, sf):
    root = F.concat(F.lit("/w/n"), F.col("s_nationkey").cast("string"))
    k = F.col("s_suppkey") % 4
    path = F.when(k == 0, F.concat(root, F.lit("/a"))).when(k == 1, root).when(k == 2, F.concat(root, F.lit("x/a")))
    return base.table(spark, sf, "supplier").select("s_suppkey", F.coalesce(T.leaves(root, path), F.lit(False)).alias("outside"))


TAILS = ('reason = "so, it is"', "", "any(all(x, y), [z, {u, v}]), w", "k(a, b) /* c, d */, e", "dup, dup)")
WRITTEN = "SELECT p_partkey, p_size, replace(p_name, ' ', ', ') || ',' || " + "CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN ' {t}'" for i, t in enumerate(TAILS)) + " END AS written FROM part"
#: Characters with their depth outside of quotes and comments; those at commas of depth 0 are cut.
SPLIT = f"""w AS ({WRITTEN}), c AS (SELECT p_partkey, p_size, unnest(string_split(regexp_replace(written, '/\\*.*?\\*/', '', 'g'), '')) AS c, generate_subscripts(string_split(regexp_replace(written, '/\\*.*?\\*/', '', 'g'), ''), 1) AS i FROM w),
q AS (SELECT *, sum(CASE WHEN c = '"' THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) % 2 = 1 AS quoted FROM c),
d AS (SELECT *, sum(CASE WHEN quoted THEN 0 WHEN c IN ('(', '[', '{{') THEN 1 WHEN c IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS s FROM q),
e AS (SELECT *, s - least(min(s) OVER (PARTITION BY p_partkey ORDER BY i), 0) AS depth FROM d),
f AS (SELECT *, c = ',' AND NOT quoted AND depth = 0 AS cut FROM e),
g AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS part FROM f),
arguments AS (SELECT p_partkey, p_size, part, string_agg(c, '' ORDER BY i) AS a FROM g WHERE NOT cut AND (quoted OR c NOT IN (' ', chr(10), chr(9))) GROUP BY p_partkey, p_size, part)"""


def _arguments(spark, sf):
    from ..operators import nesting

    k = F.col("p_partkey") % 5
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (k + 1).cast("int"))
    rows = base.table(spark, sf, "part").select("p_partkey", F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")), F.lit(", "), tail).alias("written"))
    return nesting.split_arguments(rows, "p_partkey", "written")


@query(f"WITH {SPLIT} SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY part) AS place, a AS argument FROM arguments")
def attribute_arguments(spark, sf):
    """Attributes written out with nested lists, quotes and comments, and split again."""
    return _arguments(spark, sf).select("p_partkey", F.col("place").cast("bigint").alias("place"), "argument")


@query(f"""WITH {SPLIT} SELECT p_partkey, coalesce(array_to_string(list_sort(list_distinct(list(a) FILTER (WHERE NOT starts_with(a, 'reason="')))), '|'), '') AS lints, count(*) FILTER (WHERE NOT starts_with(a, 'reason="')) > 0 AND NOT bool_or(starts_with(a, 'reason="')) AS unreasoned, any_value(p_size) % 2 = 0 AND any_value(p_size) % 3 < 2 AND count(*) FILTER (WHERE NOT starts_with(a, 'reason="')) > 0 AS crate_level FROM arguments GROUP BY p_partkey""")
def suppressions(spark, sf):
    """The lints of each attribute, and the two rules of single attributes."""
    each = _arguments(spark, sf).groupBy("p_partkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "argument"))), lambda x: x["argument"]).alias("a"))
    size = F.col("p_size")
    place = F.when(size % 3 == 0, "file").when(size % 3 == 1, "module").otherwise("fn")
    rows = base.table(spark, sf, "part").select("p_partkey", (size % 2 == 0).alias("inner_"), place.alias("place")).join(each, "p_partkey")
    return rows.select("p_partkey", F.array_join(M.lints_of(F.col("a")), "|").alias("lints"), M.unreasoned(F.col("a")).alias("unreasoned"), M.crate_level(F.col("inner_"), F.col("place"), F.col("a")).alias("crate_level"))


BOUND = "CASE kind WHEN 'file' THEN 1000 WHEN 'fn' THEN 150 WHEN 'other' THEN 1000000000 ELSE 500 END"


@query(f"SELECT doc_id, kind, CASE WHEN doc_id % 6 = 0 THEN {BOUND} ELSE lines END AS lines, kind <> 'other' AND (doc_id % 6 = 0 OR lines >= {BOUND}) AS oversized FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'file' WHEN 1 THEN 'mod' WHEN 2 THEN 'impl' WHEN 3 THEN 'fn' ELSE 'other' END AS kind, n_chars // 10 AS lines FROM documents)")
def unit_sizes(spark, sf):
    """Documents as units of four kinds, and one that isn't judged; a line has ten characters, and every sixth unit is at its bound."""
    k = F.col("doc_id") % 5
    kind = F.when(k == 0, "file").when(k == 1, "mod").when(k == 2, "impl").when(k == 3, "fn").otherwise("other")
    bound = F.when(F.col("kind") == "file", 1000).when(F.col("kind") == "fn", 150).when(F.col("kind") == "other", 1_000_000_000).otherwise(500)
    rows = base.table(spark, sf, "documents").select("doc_id", kind.alias("kind"), F.expr("n_chars div 10").alias("lines"))
    rows = rows.withColumn("lines", F.when(F.col("doc_id") % 6 == 0, bound).otherwise(F.col("lines")).cast("bigint"))
    return rows.withColumn("oversized", M.oversized(F.col("kind"), F.col("lines")))


@query("SELECT source, coalesce(nullif(count(l.doc_id), 0), nullif(count(*) FILTER (WHERE lang = 'de'), 0), count(*)) AS files, CASE WHEN count(l.doc_id) > 0 THEN count(l.doc_id) = count(*) WHEN count(*) FILTER (WHERE lang = 'de') > 0 THEN bool_and(lang = 'de') ELSE false END AS complete FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def file_inventory(spark, sf):
    """Files of a source: those the compiler saw (labelled ones), else those a walk found (German ones), else all."""
    from ..sources import metadata

    seen = base.table(spark, sf, "labels").select("doc_id").distinct().withColumn("seen", F.lit(1))
    d = base.table(spark, sf, "documents").select("doc_id", "source", "lang").join(seen, "doc_id", "left")
    n = d.groupBy("source").agg(F.count("seen").alias("c"), F.count_if(F.col("lang") == "de").alias("w"), F.count("*").alias("n"), F.bool_and(F.col("lang") == "de").alias("all_de"))
    files, complete = metadata.inventory(F.nullif("c", F.lit(0)), F.nullif("w", F.lit(0)), F.col("n"), F.col("c") == F.col("n"), F.col("all_de"))
    return n.select("source", files.alias("files"), complete.alias("complete"))
