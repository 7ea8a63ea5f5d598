"""Queries of evidence and budgets, versions of a table, runs over many units, hand-off and ignore rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as ev
from ..operators import harness, ignore, ordered, report
from ..operators import snapshot as snap
from . import base
from .base import AGGREGATES, CONTRIBUTIONS, FINDINGS, SIZES
from .registry import query

# The tables' sources are small workspaces: limits as small as these are met there, at and on both sides of their edge.
ROWS, FILE, BUDGET = 60, 12_000, 60_000


@query(f"""WITH RECURSIVE d AS (SELECT source, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents), g AS (SELECT source, count(*) AS n FROM d GROUP BY source),
  j AS (SELECT d.*, g.n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM d JOIN g USING (source)),
  s AS (SELECT source, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS doc_id, '' AS outcome FROM g
    UNION ALL SELECT j.source, j.k, s.used + CASE WHEN j.size <= {FILE} AND s.used + j.size <= {BUDGET} THEN j.size ELSE 0 END, j.doc_id,
      CASE WHEN j.n > {ROWS} THEN 'refused' WHEN j.size > {FILE} THEN 'too large' WHEN s.used + j.size <= {BUDGET} THEN 'read' ELSE 'over budget' END FROM s JOIN j ON j.source = s.source AND j.k = s.k + 1)
  SELECT source, doc_id, outcome FROM s WHERE doc_id IS NOT NULL""")
def delta_budget(spark, sf):
    """Which documents a comparison of each source would read: in order, while its budget lasts."""
    files = base.documents(spark, sf).select("source", "doc_id", F.octet_length("text").cast("bigint").alias("size"))
    return ev.readable(files, "source", "doc_id", "size", FILE, BUDGET, ROWS)


# Each document's first words as the paths of a dep-info file, escaped; every 7th has no rule.
DEP_BYTES = 1500


@query(f"""WITH w AS (SELECT doc_id, source, list_filter(string_split_regex(coalesce(text, ''), '[{base.WHITE}]+'), lambda x: x <> '')[1:6] AS w FROM documents),
  t AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'nothing here' ELSE 'target/x.d: ' || array_to_string(list_transform(w, lambda x: replace(replace(replace(x, chr(92), chr(92) || chr(92)), '#', chr(92) || '#'), ':', chr(92) || ':') || chr(92) || ' a'), ' ' || chr(92) || chr(10)) || chr(10) || 'other: z' END AS t FROM w),
  r AS (SELECT *, sum(strlen(t)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM t)
  SELECT doc_id, unnest(list_transform(w, lambda x: x || ' a')) AS path FROM r WHERE used <= {DEP_BYTES} AND doc_id % 7 <> 0""")
def dep_info_files(spark, sf):
    """Paths of the dep-info files that a source's budget of bytes reaches, in order of the documents."""
    back = lambda c, x: F.replace(c, F.lit(x), F.lit("\\" + x))
    words = F.slice(F.filter(F.split("text", f"[{T.WHITE}]+"), lambda x: x != ""), 1, 6)
    escaped = F.transform(words, lambda x: F.concat(back(back(back(x, "\\"), "#"), ":"), F.lit("\\ a")))
    written = F.when(F.col("doc_id") % 7 == 0, "nothing here").otherwise(F.concat(F.lit("target/x.d: "), F.array_join(escaped, " \\\n"), F.lit("\nother: z")))
    files = base.documents(spark, sf).select("doc_id", "source", written.alias("written")).withColumn("size", F.octet_length("written").cast("bigint"))
    placed = ordered.placed(files.select("source", "doc_id", "size"), ["source"], ["doc_id"])
    within = ordered.spend(placed, ["source"], "place", "size", DEP_BYTES, skips=False).where("within").select("doc_id")
    return files.join(within, "doc_id", "left_semi").select("doc_id", F.explode(T.dep_info(F.col("written"))).alias("path"))


# A finding in each document's neighbour: from a line to up to three below, some of them backwards or out of reach.
SPANS = "SELECT doc_id AS id, doc_id - doc_id % 5 AS path, doc_id % 3 + 1 AS line_start, doc_id % 17 + 1 AS column_start, doc_id % 3 + 1 + doc_id % 4 AS line_end, doc_id % 23 + 1 AS column_end FROM documents"


@query(f"""WITH c AS ({SPANS}), f AS (SELECT doc_id AS path, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
  j AS (SELECT c.*, t, s, CASE WHEN line_end <= len(s) AND column_start <= length(s[line_start]) + 1 AND column_end <= length(s[line_end]) + 1 THEN coalesce(list_sum(list_transform(s[1:line_start - 1], lambda x: length(x) + 1)), 0) + column_start END AS a, coalesce(list_sum(list_transform(s[1:line_end - 1], lambda x: length(x) + 1)), 0) + column_end AS b FROM c LEFT JOIN f USING (path)),
  r AS (SELECT id, CASE WHEN a <= b THEN substring(t, CAST(a AS BIGINT), CAST(b - a AS BIGINT)) END AS raw FROM j)
  SELECT id, CASE WHEN strlen(raw) <= 65536 THEN nullif(trim(regexp_replace(raw, '[{base.WHITE}]+', ' ', 'g')), '') END AS proof FROM r""")
def span_proofs(spark, sf):
    """What findings show of the files that they lie in, over one line and several."""
    docs = base.documents(spark, sf).select("doc_id", "text")
    k = F.col("doc_id")
    line = k % 3 + 1
    asked = docs.select(k.alias("id"), (k - k % 5).alias("path"), line.alias("line_start"), (k % 17 + 1).alias("column_start"), (line + k % 4).alias("line_end"), (k % 23 + 1).alias("column_end"))
    return ev.proofs(asked, docs.select(k.alias("path"), "text"))


VERSIONS = """o AS (SELECT 'd/' || doc_id AS path, sha256(coalesce(text, '')) AS digest, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents WHERE doc_id % 13 <> 0),
n AS (SELECT CASE WHEN doc_id % 17 = 0 THEN 'moved/' || doc_id ELSE 'd/' || doc_id END AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN 'new ' || coalesce(text, '') ELSE coalesce(text, '') END) AS digest,
  CAST(strlen(coalesce(text, '')) + CASE WHEN doc_id % 7 = 0 THEN 4 WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size FROM documents WHERE doc_id % 11 <> 0)"""


def _versions(spark, sf):
    docs = base.documents(spark, sf)
    k = F.col("doc_id")
    path = F.concat(F.lit("d/"), k.cast("string"))
    old = snap.manifest(docs.where(k % 13 != 0).withColumn("path", path), "path", "text")
    later = docs.where(k % 11 != 0).withColumns({"path": F.when(k % 17 == 0, F.concat(F.lit("moved/"), k.cast("string"))).otherwise(path), "text": F.when(k % 7 == 0, F.concat(F.lit("new "), "text")).otherwise(F.col("text"))})
    new = snap.manifest(later, "path", "text")
    grown = F.regexp_extract("path", "([0-9]+)$", 1).cast("bigint")
    return old, new.withColumn("size", F.col("size") + F.when((grown % 19 == 0) & (grown % 7 != 0), 1).otherwise(0))


@query(f"WITH {VERSIONS} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'gone' WHEN o.digest <> n.digest THEN 'changed' WHEN o.size <> n.size THEN 'inconsistent' ELSE 'same' END AS state FROM o FULL JOIN n ON o.path = n.path")
def snapshot_states(spark, sf):
    """Two versions of the documents compared by path, digest and size."""
    return snap.compare(*_versions(spark, sf))


@query(f"WITH {VERSIONS}, g AS (SELECT o.digest, min(o.path) AS before FROM o ANTI JOIN n USING (path) GROUP BY o.digest HAVING count(*) = 1), a AS (SELECT n.digest, min(n.path) AS path FROM n ANTI JOIN o USING (path) GROUP BY n.digest HAVING count(*) = 1) SELECT before, path FROM g JOIN a USING (digest)")
def snapshot_moves(spark, sf):
    """Documents that went from one path to another with their content."""
    return snap.moved(*_versions(spark, sf))


LISTED = "SELECT CASE page_id % 9 WHEN 0 THEN '/' || page_id WHEN 1 THEN 'a/../' || page_id WHEN 2 THEN 'a//b' WHEN 3 THEN 'twice' WHEN 4 THEN NULL ELSE 'ok/' || page_id END AS path, CASE WHEN page_id % 10 = 0 THEN 'xyz' WHEN page_id % 10 = 1 THEN sha256(html)[1:40] WHEN page_id % 10 = 2 THEN NULL ELSE sha256(html) END AS digest, CASE WHEN page_id % 14 <> 6 THEN CAST(strlen(html) AS BIGINT) END AS size FROM pages WHERE html IS NOT NULL"
LIMITS = (100, 4000, 100_000)


@query(f"""WITH e AS ({LISTED}) SELECT path, CASE WHEN path IS NULL OR path = '' OR strlen(path) > 4096 OR len(list_filter(string_split(path, '/'), lambda p: p IN ('', '.', '..'))) > 0 THEN 'entry-invalid: path' WHEN digest IS NULL OR NOT regexp_full_match(digest, '[0-9a-fA-F]{{40}}|[0-9a-fA-F]{{64}}') THEN 'entry-invalid: digest' WHEN size IS NULL OR size < 0 THEN 'inventory-failed: size' WHEN size > {LIMITS[1]} THEN 'limit-exceeded: entry' END AS defect FROM e WHERE defect IS NOT NULL
  UNION ALL SELECT path, 'entry-invalid: twice' FROM e WHERE path IS NOT NULL GROUP BY path HAVING count(*) > 1
  UNION ALL SELECT NULL, 'limit-exceeded: entries' FROM e HAVING count(*) > {LIMITS[0]} UNION ALL SELECT NULL, 'limit-exceeded: bytes' FROM e HAVING sum(size) > {LIMITS[2]}""")
def snapshot_defects(spark, sf):
    """What makes an inventory of the pages unusable."""
    k, html = F.col("page_id"), F.col("html")
    s = k.cast("string")
    path = F.when(k % 9 == 0, F.concat(F.lit("/"), s)).when(k % 9 == 1, F.concat(F.lit("a/../"), s)).when(k % 9 == 2, "a//b").when(k % 9 == 3, "twice").when(k % 9 == 4, None).otherwise(F.concat(F.lit("ok/"), s))
    digest = F.when(k % 10 == 0, "xyz").when(k % 10 == 1, F.substring(F.sha2(html, 256), 1, 40)).when(k % 10 == 2, None).otherwise(F.sha2(html, 256))
    size = F.when(k % 14 != 6, F.octet_length(html).cast("bigint"))
    return snap.defects(base.table(spark, sf, "pages").where("html is not null").select(path.alias("path"), digest.alias("digest"), size.alias("size")), LIMITS)


# Each source is a unit of JSON records; some records are damaged, some units have none that count.
@query("""WITH r AS (SELECT source, doc_id, lang, CASE WHEN source = 'src3' AND doc_id % 90 = 3 THEN '{"lines": ' ELSE '{"lines": ' || (n_chars // 20) || '}' END AS record, n_chars // 20 AS lines FROM documents WHERE source <> 'src9'),
  j AS (SELECT source, doc_id, lines, lang <> 'es' AND source <> 'src5' AS measured, CASE WHEN NOT json_valid(record) THEN 'malformed-record' WHEN source = 'src8' AND lines > 150 THEN 'record-too-large' END AS code FROM r),
  u AS (SELECT source, bool_or(measured) AS any_, min(CASE code WHEN 'malformed-record' THEN 0 WHEN 'record-too-large' THEN 1 END) AS first, count(code) AS bad, count(*) FILTER (WHERE measured AND code IS NULL) AS files, sum(lines) FILTER (WHERE measured AND code IS NULL) AS lines FROM j GROUP BY source),
  a AS (SELECT DISTINCT source FROM documents)
  SELECT a.source, CASE WHEN u.any_ IS NULL OR first IS NOT NULL THEN 'failed' WHEN NOT any_ THEN 'skipped' ELSE 'processed' END AS outcome, CASE WHEN u.any_ IS NULL THEN 'missing' WHEN first = 0 THEN 'malformed-record' WHEN first = 1 THEN 'record-too-large' END AS code, coalesce(bad, 0) AS bad,
    CASE WHEN first IS NULL AND any_ THEN coalesce(files, 0) END AS files, CAST(CASE WHEN first IS NULL AND any_ THEN coalesce(lines, 0) END AS BIGINT) AS lines FROM a LEFT JOIN u USING (source)""")
def harness_outcomes(spark, sf):
    """Every source by how its scan went: a damaged record fails its own source alone."""
    docs = base.table(spark, sf, "documents")
    lines = F.expr("n_chars div 20")
    record = F.when((F.col("source") == "src3") & (F.col("doc_id") % 90 == 3), '{"lines": ').otherwise(F.concat(F.lit('{"lines": '), lines.cast("string"), F.lit("}")))
    rows = docs.where("source <> 'src9'").select("source", "lang", record.alias("record"))
    read = F.get_json_object("record", "$.lines").cast("bigint")
    checks = [("malformed-record", F.try_parse_json("record").isNull()), ("record-too-large", (F.col("source") == "src8") & (read > 150))]
    measured = (F.col("lang") != "es") & (F.col("source") != "src5")
    return harness.outcomes(rows, "source", measured, checks, {"files": F.lit(1).cast("bigint"), "lines": read}, docs.select("source"))


GROUPS = f"""told AS (SELECT g.source, g.rule, g.worst_severity, g.occurrences, row_number() OVER (PARTITION BY g.source ORDER BY g.worst_severity, coalesce(r.repair_value, 0) DESC, coalesce(r.contribution, 0) DESC, g.occurrences DESC, g.rule) AS place FROM agg g LEFT JOIN repairs r USING (source, rule)),
sites AS (SELECT f.source, t.place, row_number() OVER (PARTITION BY f.source, f.rule ORDER BY f.doc_id) AS n, 'src/' || f.doc_id || '.rs' AS path, f.doc_id % 90 AS line, f.doc_id % 7 AS col FROM findings f JOIN told t USING (source, rule) WHERE t.place <= 3),
counted AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place, n) AS every FROM sites)"""


@query(f"""WITH {FINDINGS}, {SIZES}, {AGGREGATES}, {CONTRIBUTIONS}, {GROUPS}, lines AS (
  SELECT source, 0 AS g, 0 AS k, 0 AS n, '{report.HAND_OFF}' AS line FROM sizes UNION ALL SELECT source, 0, 1, 0, 'Audit: ' || source_files || ' files.' FROM sizes UNION ALL SELECT source, 4, 0, 0, 'Validate with: scan ' || source FROM sizes
  UNION ALL SELECT source, place, 0, 0, place || '. ' || rule || ' (' || CASE worst_severity WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END || ', ' || occurrences || ' occurrences)' FROM told WHERE place <= 3
  UNION ALL SELECT source, place, 1, 0, '   Help: look at ' || rule FROM told WHERE place <= 3 AND rule <> 'email'
  UNION ALL SELECT source, place, 2, n, '   - ' || path || ':' || greatest(line, 1) || ':' || greatest(col, 1) FROM counted WHERE every <= 24),
  taken AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY source ORDER BY g, k, n) <= 600 AS ok FROM lines)
  SELECT source, coalesce(string_agg(line || chr(10), '' ORDER BY g, k, n) FILTER (WHERE ok), '') AS body, CASE WHEN bool_and(ok) THEN NULL ELSE 'payload-too-large' END AS refused FROM taken GROUP BY source""")
def hand_off_prompts(spark, sf):
    """Each source's first groups as a text for hand-off; a budget of 600 bytes cuts most of them at a line."""
    from pyspark.sql import Window

    from ..operators import score
    from .findings import _rules

    rules, sizes = _rules(spark, sf)
    valued = score.contributions(rules, "source").select("source", "rule", "repair_value", "contribution")
    zero = lambda c: F.coalesce(c, F.lit(0))
    order = Window.partitionBy("source").orderBy("worst_severity", zero("repair_value").desc(), zero("contribution").desc(), F.desc("occurrences"), "rule")
    severity = F.when(F.col("worst_severity") == 0, "error").when(F.col("worst_severity") == 1, "warning").otherwise("info")
    groups = rules.join(valued, ["source", "rule"], "left").withColumn("place", F.row_number().over(order))
    groups = groups.select("source", "rule", "place", severity.alias("severity"), "occurrences", F.when(F.col("rule") != "email", F.concat(F.lit("look at "), "rule")).alias("help"))
    k = F.col("doc_id")
    sites = base.findings(spark, sf).select("source", "rule", k.alias("at"), F.concat(F.lit("src/"), k.cast("string"), F.lit(".rs")).alias("path"), (k % 90).alias("line"), (k % 7).alias("column"))
    units = sizes.select("source", F.concat(F.lit("Audit: "), F.col("source_files").cast("string"), F.lit(" files.")).alias("audit"), F.concat(F.lit("scan "), "source").alias("rescan"))
    return report.hand_off(units, groups, sites, "source", 600)


# Rules of a workspace, the last that matches decides; paths are those of the pages' addresses.
IGNORE = ((1, "/en/*"), (2, "!/en/7*"), (3, "*.html"), (4, "!44*.html"), (5, "# nothing"), (6, ""), (7, "de/"), (8, "/fr/**/8?"), (9, "**/es/1*"), (10, "!/de/1"), (11, "1[0-4]5"))
_HIT = {
    1: "regexp_full_match(prefix, 'en/[^/]*')", 2: "regexp_full_match(prefix, 'en/7[^/]*')", 3: "regexp_full_match(name, '[^/]*\\.html')", 4: "regexp_full_match(name, '44[^/]*\\.html')", 7: "name = 'de' AND folder",
    8: "regexp_full_match(prefix, 'fr/(.*/)?8[^/]')", 9: "regexp_full_match(prefix, '(.*/)?es/1[^/]*')", 10: "prefix = 'de/1'", 11: "regexp_full_match(name, '1[0-4]5')",
}


@query(f"""WITH p AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', ''), '/') AS path FROM pages WHERE url IS NOT NULL), s AS (SELECT path, string_split(path, '/') AS s FROM p WHERE path <> ''),
  x AS (SELECT path, unnest(range(1, len(s) + 1)) AS depth, s FROM s), n AS (SELECT path, depth, array_to_string(s[1:depth], '/') AS prefix, s[depth] AS name, depth < len(s) AS folder FROM x),
  h AS (SELECT path, depth, greatest({', '.join(f'CASE WHEN {c} THEN {i} ELSE 0 END' for i, c in _HIT.items())}) AS last FROM n)
  SELECT path, bool_or(last > 0 AND last NOT IN (2, 4, 10)) AS ignored FROM h GROUP BY path""")
def ignored_paths(spark, sf):
    """Which paths the rules pass over: also what stands in an ignored folder, whatever is said of it later."""
    path = F.btrim(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[?#].*$", ""), F.lit("/"))
    paths = base.table(spark, sf, "pages").select(path.alias("path"), F.lit(False).alias("folder")).where("path <> ''").distinct()
    return ignore.ignored(paths, ignore.rules(spark.createDataFrame(IGNORE, "place int, line string")))


IDENTITIES = "SELECT 'reviewed' || chr(9) || l_linestatus || chr(9) || l_returnflag || chr(9) || l_suppkey || chr(9) || l_partkey || chr(9) || l_orderkey || chr(9) || l_linenumber AS line FROM lineitem"


@query(f"WITH l AS ({IDENTITIES}), a AS (SELECT line, row_number() OVER (ORDER BY line) - 1 AS i FROM l), b AS (SELECT i // 1000 AS i, sha256(string_agg(line, chr(10) ORDER BY i)) AS d FROM a GROUP BY i // 1000), c AS (SELECT i // 1000 AS i, sha256(string_agg(d, chr(10) ORDER BY i)) AS d FROM b GROUP BY i // 1000) SELECT sha256(string_agg(d, chr(10) ORDER BY i)) AS digest, (SELECT count(*) FROM l) AS lines FROM c")
def site_digest(spark, sf):
    """One digest of all reviewed sites in the order of their identity lines."""
    parts = [F.lit("reviewed"), *[F.col(c).cast("string") for c in ("l_linestatus", "l_returnflag", "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")]]
    lines = base.table(spark, sf, "lineitem").select(F.concat_ws("\t", *parts).alias("line"))
    return ordered.digest(ordered.placed(lines.withColumn("all", F.lit(0)), ["all"], ["line"]), "line", "place")


@query(f"WITH {FINDINGS}, c AS (SELECT doc_id % 7 AS column_start, doc_id % 7 + 4 AS column_end, doc_id % 90 AS line_start, doc_id % 90 AS line_end, occurrences, 'src/' || doc_id AS path, rule, context, CAST(doc_id AS VARCHAR) AS id FROM findings WHERE category IS NOT NULL) SELECT *, row_number() OVER (ORDER BY column_start, column_end, line_start, line_end, occurrences, path, rule, context NULLS FIRST, id) - 1 AS place FROM c")
def curated_findings(spark, sf):
    """Findings of catalogued rules with their places in the order in which they are digested."""
    k = F.col("doc_id")
    rows = base.findings(spark, sf).select((k % 7).alias("column_start"), (k % 7 + 4).alias("column_end"), (k % 90).alias("line_start"), (k % 90).alias("line_end"), "occurrences", F.concat(F.lit("src/"), k.cast("string")).alias("path"), F.col("rule").alias("code"), "context", k.cast("string").alias("id"), "category")
    kept = harness.curated(rows).withColumn("all", F.lit(0))
    order = ["column_start", "column_end", "line_start", "line_end", "occurrences", "path", "rule", F.col("context").asc_nulls_first(), "id"]
    return ordered.placed(kept, ["all"], order).drop("all")
