"""Queries over the findings of documents: tallies, policy, scores, repairs, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as fd
from ..operators import policy, score
from ..operators.graph import settle
from ..sources import catalog
from . import base
from .base import AGGREGATES, CONTRIBUTIONS, FINDINGS, LABEL, SIZES, score_sql
from .registry import query

SUMMARY = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}_distinct, CAST(coalesce(sum(occurrences) FILTER (WHERE severity = '{s}'), 0) AS BIGINT) AS {s}_occurrences" for s in ("error", "warning", "info", "unknown"))
#: Parts of a source's findings that are worked on apart, so that no task gathers all findings of a source.
PARTS = 1024
BUCKET = "CASE WHEN category = 'security' THEN 'Security' WHEN category IN ('correctness', 'reliability') THEN 'Bugs' WHEN category = 'performance' THEN 'Performance' WHEN category IN ('cargo', 'dependencies') THEN 'Dependencies' WHEN category = 'maintainability' THEN 'Maintainability' ELSE 'Other' END"


@query(f"WITH {FINDINGS} SELECT rule, doc_id, source, occurrences, category, producer, tier, severity, context FROM findings")
def findings_view(spark, sf):
    return base.findings(spark, sf).select("rule", "doc_id", "source", "occurrences", "category", "producer", "tier", "severity", "context")


@query("""SELECT source, lang, count(*) AS occurrences, CASE WHEN count(quality) = count(*) AND min(quality) = max(quality) THEN min(quality) END AS quality,
  CASE WHEN count(toxic) = count(*) AND min(toxic) = max(toxic) THEN min(toxic) END AS toxic, CAST(min(n_chars) AS BIGINT) AS least
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang""")
def finding_merge(spark, sf):
    rows = base.table(spark, sf, "documents").join(base.table(spark, sf, "labels"), "doc_id", "left").withColumn("occurrences", F.lit(1))
    return fd.merge(rows, ["source", "lang"], "occurrences", ["quality", "toxic"], ["n_chars"]).withColumnRenamed("n_chars", "least")


@query(f"""WITH e AS (SELECT CASE WHEN event_type IN ('error', 'purchase') THEN 'error' WHEN event_type IN ('click', 'view') THEN 'warning' ELSE 'info' END AS severity, 1 + event_id % 3 AS occurrences FROM events)
  SELECT {SUMMARY} FROM e""")
def severity_summary(spark, sf):
    e = base.table(spark, sf, "events")
    s = F.when(F.col("event_type").isin("error", "purchase"), "error").when(F.col("event_type").isin("click", "view"), "warning").otherwise("info")
    return fd.by_severity(e.select(s.alias("severity"), (1 + F.col("event_id") % 3).alias("occurrences")))


@query(f"WITH {FINDINGS}, b AS (SELECT *, {BUCKET} AS bucket FROM findings) SELECT source, bucket, {SUMMARY} FROM b GROUP BY source, bucket")
def category_tallies(spark, sf):
    return fd.by_severity(base.findings(spark, sf).withColumn("bucket", fd.bucket(F.col("category"))), "source", "bucket")


@query(f"WITH {FINDINGS} SELECT coalesce(bucket, 'Total') AS bucket, n_distinct, n_occurrences FROM (SELECT bucket, count(*) AS n_distinct, CAST(sum(occurrences) AS BIGINT) AS n_occurrences FROM (SELECT *, {BUCKET} AS bucket FROM findings) GROUP BY ROLLUP (bucket))")
def category_rollup(spark, sf):
    rows = base.findings(spark, sf).withColumn("bucket", fd.bucket(F.col("category")))
    return rows.rollup("bucket").agg(F.count("*").alias("n_distinct"), F.sum("occurrences").alias("n_occurrences")).withColumn("bucket", F.coalesce("bucket", F.lit("Total")))


OVERRIDES = [("rule", "email", "off", "config"), ("category", "security", "warn", "request"), ("category", "maintainability", "error", "config"), ("rule", "repeated_line", "warn", "request"), ("category", "dependencies", "off", "config"), ("rule", "license_line", "error", "config")]
PLAN = f"""over_(kind, selector, level, layer) AS (VALUES {", ".join(map(str, OVERRIDES))}),
plan AS (SELECT r.rule, coalesce(a.level, b.level, c.level, d.level, 'warn') AS level,
  CASE WHEN a.level IS NOT NULL THEN 'request_rule' WHEN b.level IS NOT NULL THEN 'request_category' WHEN c.level IS NOT NULL THEN 'config_rule' WHEN d.level IS NOT NULL THEN 'config_category' ELSE 'default' END AS level_source
  FROM rules r LEFT JOIN over_ a ON a.kind = 'rule' AND a.layer = 'request' AND a.selector = r.rule LEFT JOIN over_ b ON b.kind = 'category' AND b.layer = 'request' AND b.selector = r.category
  LEFT JOIN over_ c ON c.kind = 'rule' AND c.layer = 'config' AND c.selector = r.rule LEFT JOIN over_ d ON d.kind = 'category' AND d.layer = 'config' AND d.selector = r.category)"""


def _plan(spark):
    rules = catalog.document_rules(spark).withColumn("default_level", F.lit("warn"))
    return policy.compile_plan(rules, spark.createDataFrame(OVERRIDES, "kind string, selector string, level string, layer string"))


# Each source as a project: every 9th document is one of the overrides in its requests and configuration.
PROJECT = f"""own AS (SELECT DISTINCT source, doc_id // 9 % {len(OVERRIDES)} AS k FROM documents WHERE doc_id % 9 = 0), named AS (SELECT row_number() OVER () - 1 AS k, * FROM over_), mine AS (SELECT source, kind, selector, level, layer FROM own JOIN named USING (k)),
projects AS (SELECT DISTINCT source FROM documents), every AS (SELECT source, rule, category FROM projects, rules),
held AS (SELECT e.source, e.rule, max(level) FILTER (WHERE layer = 'request' AND kind = 'rule') AS a, max(level) FILTER (WHERE layer = 'request' AND kind = 'category') AS b, max(level) FILTER (WHERE layer = 'config' AND kind = 'rule') AS c, max(level) FILTER (WHERE layer = 'config' AND kind = 'category') AS d
  FROM every e LEFT JOIN mine m ON m.source = e.source AND m.selector = CASE kind WHEN 'rule' THEN e.rule ELSE e.category END GROUP BY e.source, e.rule)"""


@query(f"WITH {FINDINGS}, {PLAN}, {PROJECT} SELECT source, rule, coalesce(a, b, c, d, 'warn') AS level, CASE WHEN a IS NOT NULL THEN 'request_rule' WHEN b IS NOT NULL THEN 'request_category' WHEN c IS NOT NULL THEN 'config_rule' WHEN d IS NOT NULL THEN 'config_category' ELSE 'default' END AS level_source FROM held")
def policy_precedence(spark, sf):
    """The level of every rule in every project, and where it comes from."""
    docs = base.table(spark, sf, "documents").select("source", "doc_id")
    some = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("kind", "selector", "level", "layer"), o, strict=True)]) for o in OVERRIDES])
    own = docs.where("doc_id % 9 = 0").select("source", F.get(some, F.expr(f"cast(doc_id div 9 % {len(OVERRIDES)} as int)")).alias("o")).select("source", "o.*").distinct()
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v[0]).alias("category"), F.lit("warn").alias("default_level")) for r, v in catalog.DOCUMENT_RULES.items()])
    rules = docs.select("source").distinct().select("source", F.explode(listed).alias("r")).select("source", "r.*")
    return policy.compile_plan(rules, own, ["source"])


@query(f"""WITH {FINDINGS}, {PLAN} SELECT f.rule, f.source, CASE WHEN coalesce(p.level_source, 'default') = 'default' THEN f.severity WHEN p.level = 'warn' THEN 'warning' ELSE p.level END AS severity, count(*) AS n
  FROM findings f LEFT JOIN plan p USING (rule) WHERE coalesce(p.level, 'warn') <> 'off' GROUP BY ALL""")
def policy_restamp(spark, sf):
    plan = F.broadcast(_plan(spark))  # six rows
    return fd.restamp(fd.drop_inactive(base.findings(spark, sf), plan), plan).groupBy("rule", "source", "severity").agg(F.count("*").alias("n"))


def _rules(spark, sf):
    """Rules with their densities, and the sources' sizes."""
    rules, sizes = base.rules_and_sizes(spark, sf)
    return score.densities(rules, sizes, "source"), sizes


@query(f"WITH {FINDINGS}, {SIZES}, {AGGREGATES} SELECT source, rule, CAST(occurrences AS BIGINT) AS occurrences, worst_severity, CAST(numerator AS BIGINT) AS numerator, dimension, tier FROM dens")
def rule_aggregation(spark, sf):
    return _rules(spark, sf)[0].select("source", "rule", "occurrences", "worst_severity", "numerator", "dimension", "tier")


@query(f"WITH {FINDINGS}, {SIZES}, {AGGREGATES}, {score_sql()} SELECT source, dimension, CAST(round(density * 1000000) AS BIGINT) AS density_millionths, tier FROM dims")
def dimension_density(spark, sf):
    return score.by_dimension(_rules(spark, sf)[0], "source").select("source", "dimension", F.round(F.col("density") * 1_000_000).cast("bigint").alias("density_millionths"), "tier")


@query(f"WITH {FINDINGS}, {SIZES}, {AGGREGATES}, {score_sql()} SELECT *, {LABEL} AS label FROM scores")
def health_score(spark, sf):
    rules, sizes = _rules(spark, sf)
    return score.score(sizes, score.by_dimension(rules, "source"), "source")


@query(f"""WITH {FINDINGS}, x AS (SELECT source, CASE WHEN doc_id % 7 = 3 THEN 'unknown' ELSE severity END AS severity, context, rule, category FROM findings)
  SELECT s.source, coalesce(bool_and(x.rule IS NULL OR x.context IS NOT NULL OR x.severity <> 'unknown' AND x.category IS NOT NULL), true) AS authoritative FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN x USING (source) GROUP BY s.source""")
def score_authoritative(spark, sf):
    """Findings whose severity isn't known take a source's authority; those with a context don't."""
    odd = base.findings(spark, sf).withColumn("severity", F.when(F.col("doc_id") % 7 == 3, "unknown").otherwise(F.col("severity")))
    rules = score.aggregate_rules(odd, "source").groupBy("source").agg(F.bool_and("authoritative").alias("authoritative"))
    return base.sizes(spark, sf).select("source").join(rules, "source", "left").withColumn("authoritative", F.coalesce("authoritative", F.lit(True)))


@query(f"""WITH {FINDINGS}, u AS (SELECT source, CASE WHEN bool_or(n_chars > 17000) THEN 'failed' WHEN bool_or(coalesce(text, '') = '') THEN 'incomplete' ELSE 'complete' END AS status, bool_and(n_chars = length(coalesce(text, ''))) AND count(*) FILTER (WHERE lang = 'de') % 3 > 0 AS inventory FROM documents GROUP BY source),
  r AS (SELECT source, bool_and(context IS NOT NULL OR category IS NOT NULL AND tier IS NOT NULL) AS sure FROM findings GROUP BY source)
  SELECT source, status = 'complete' AND inventory AND coalesce(sure, true) AS authoritative FROM u LEFT JOIN r USING (source)""")
def score_authority(spark, sf):
    """A source's score stands if its scan is complete, its inventory agrees with the texts, and its rules are sure."""
    text = F.coalesce("text", F.lit(""))
    seen = base.table(spark, sf, "documents").groupBy("source").agg(F.bool_or(F.col("n_chars") > 17_000).alias("failed"), (~F.bool_or(text == "")).alias("whole"), F.count("*").alias("n"), (F.bool_and(F.col("n_chars") == F.length(text)) & (F.count_if(F.col("lang") == "de") % 3 > 0)).alias("inventory"))
    units = seen.select("source", policy.status(F.col("failed"), F.col("whole"), F.col("n")).alias("status"), "inventory")
    return score.authority(units, score.aggregate_rules(base.findings(spark, sf), "source"), "source")


LEVELS = "levels AS (SELECT source, CASE WHEN length(source) % 3 = 0 THEN 'warning' WHEN source LIKE '%4' THEN 'none' END AS request, CASE WHEN source LIKE '%5' OR source LIKE '%4' THEN 'warning' WHEN source LIKE '%7' THEN 'none' END AS config FROM (SELECT DISTINCT source FROM documents))"


@query(f"""WITH {FINDINGS}, {LEVELS}, l AS (SELECT source, coalesce(request, config, 'error') AS level, CASE WHEN request IS NOT NULL THEN 'request' WHEN config IS NOT NULL THEN 'config' ELSE 'default' END AS level_source FROM levels)
  SELECT l.source, level, level_source, count(*) FILTER (WHERE f.rule IS NOT NULL AND context IS NULL AND (level = 'error' AND severity = 'error' OR level = 'warning' AND severity IN ('error', 'warning'))) AS blocking_findings FROM l LEFT JOIN findings f USING (source) GROUP BY l.source, level, level_source""")
def gate_levels(spark, sf):
    """Each source at its own blocking level: as requested, as configured, or that of errors."""
    s = F.col("source")
    levels = base.table(spark, sf, "documents").select("source").distinct()
    request, config = F.when(F.length(s) % 3 == 0, "warning").when(s.endswith("4"), "none"), F.when(s.endswith("5") | s.endswith("4"), "warning").when(s.endswith("7"), "none")
    level, origin = policy.blocking_level(request, config)
    found = base.findings(spark, sf).where("context is null").groupBy("source", "severity").agg(F.count("*").alias("n"))
    met = levels.select("source", level.alias("level"), origin.alias("level_source")).join(found, "source", "left")
    blocking = F.when(policy.blocks_at(F.col("severity"), F.col("level")), F.col("n")).otherwise(0)
    return met.groupBy("source", "level", "level_source").agg(F.sum(blocking).cast("bigint").alias("blocking_findings"))


def _valued(spark, sf):
    return score.contributions(_rules(spark, sf)[0], "source")


def _sure(spark, sf):
    """Contributions in the sources whose score can be relied on; all rules are asked, also those without a dimension."""
    return score.contributions(score.published(_rules(spark, sf)[0], "source"), "source")


@query(f"WITH {FINDINGS}, {SIZES}, {AGGREGATES}, {CONTRIBUTIONS} SELECT source, rule, contribution, repair_value FROM repairs")
def repair_contribution(spark, sf):
    return _valued(spark, sf).select("source", "rule", "contribution", "repair_value")


@query(f"WITH {FINDINGS}, {SIZES}, {AGGREGATES}, {CONTRIBUTIONS} SELECT source, rule, repair_value, row_number() OVER (PARTITION BY source ORDER BY repair_value DESC, contribution DESC, rule) AS rank FROM repairs SEMI JOIN sure USING (source) WHERE contribution > 0 AND repair_value > 0")
def repair_ranking(spark, sf):
    return score.ranking(_sure(spark, sf), "source").select("source", "rule", "repair_value", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {FINDINGS}, {SIZES}, {AGGREGATES}, {CONTRIBUTIONS} SELECT source, rule, contribution, row_number() OVER (PARTITION BY source ORDER BY contribution DESC, rule) AS rank FROM repairs SEMI JOIN sure USING (source) WHERE contribution > 0 AND repair_value = 0")
def withheld_rules(spark, sf):
    return score.withheld(_sure(spark, sf), "source").select("source", "rule", "contribution", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {FINDINGS}, {SIZES}, {AGGREGATES}, {CONTRIBUTIONS},
  top AS (SELECT source, rule FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY repair_value DESC, contribution DESC, rule) AS rank FROM repairs WHERE contribution > 0 AND repair_value > 0) WHERE rank <= 3),
  rest AS (SELECT d.* FROM dens d ANTI JOIN top USING (source, rule)), {score_sql("rest")} SELECT source, score AS projected_score FROM scores ANTI JOIN (SELECT source FROM agg GROUP BY source HAVING NOT bool_and(authoritative)) USING (source)""")
def top3_projection(spark, sf):
    """The score of each source that can be relied on, once its three best repairs are made."""
    rules, sizes = _rules(spark, sf)
    sure = score.published(rules, "source")
    rest = score.without_top(sure, score.ranking(score.contributions(sure, "source"), "source"), "source")
    unsure = rules.where("not authoritative").select("source").distinct()
    told = score.score(sizes.join(unsure, "source", "left_anti"), score.by_dimension(rest, "source"), "source")
    return told.select("source", F.col("score").alias("projected_score"))


@query(f"""WITH {FINDINGS} SELECT source, count(*) FILTER (WHERE context IS NULL AND severity = 'error') AS blocking_findings,
  CASE WHEN count(*) FILTER (WHERE context IS NULL AND severity = 'error') > 0 THEN 'failed' ELSE 'passed' END AS gate FROM findings GROUP BY source""")
def gate_count(spark, sf):
    return policy.gate(base.findings(spark, sf), "source")


@query(f"WITH {FINDINGS} SELECT count(*) AS blocking_findings FROM findings WHERE doc_id % 3 = 0 AND severity = 'error'")
def gate_baseline(spark, sf):
    found = base.findings(spark, sf)
    return policy.baseline_gate(found, found.where("doc_id % 3 = 0"), ["rule", "doc_id"])


@query("""WITH s AS (SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 90) THEN 'failed' WHEN count(*) % 3 = 0 THEN 'incomplete' ELSE 'complete' END AS status, CASE WHEN sum(value) IS NULL OR max(value) < 20 THEN 'not-evaluated' WHEN count(*) FILTER (WHERE event_type = 'error') > 2 THEN 'failed' ELSE 'passed' END AS gate FROM events GROUP BY user_id)
  SELECT user_id, status, gate, CASE WHEN status = 'failed' THEN 2 WHEN status = 'complete' AND gate = 'passed' THEN 0 ELSE 1 END AS exit_code FROM s""")
def exit_codes(spark, sf):
    """Each user as a run: its status, its gate and what it exits with."""
    error, value = F.col("event_type") == "error", F.col("value")
    status = F.when(F.bool_or(error & (value > 90)), "failed").when(F.count("*") % 3 == 0, "incomplete").otherwise("complete")
    gate = F.when(F.sum(value).isNull() | (F.max(value) < 20), "not-evaluated").when(F.count_if(error) > 2, "failed").otherwise("passed")
    runs = base.table(spark, sf, "events").groupBy("user_id").agg(status.alias("status"), gate.alias("gate"))
    return runs.withColumn("exit_code", policy.exit_code(F.col("status"), F.col("gate")))


@query(f"""WITH {FINDINGS}, {SIZES}, {AGGREGATES}, {score_sql()}, c AS (SELECT source, coalesce(sum(occurrences) FILTER (WHERE severity = 'error'), 0) AS e, coalesce(sum(occurrences) FILTER (WHERE severity = 'warning'), 0) AS w, coalesce(sum(occurrences) FILTER (WHERE severity = 'info'), 0) AS i FROM findings GROUP BY source),
  sure AS (SELECT source FROM agg GROUP BY source HAVING bool_and(authoritative))
  SELECT source, CASE WHEN greatest(e, w, i, source_files, production_lines) <= 1000000 THEN concat_ws('&', 's=' || score, 'm=core-v3', CASE WHEN e > 0 THEN 'e=' || e END, CASE WHEN w > 0 THEN 'w=' || w END, CASE WHEN i > 0 THEN 'i=' || i END, CASE WHEN source_files > 0 THEN 'f=' || source_files END, CASE WHEN production_lines > 0 THEN 'l=' || production_lines END) END AS payload
  FROM scores JOIN c USING (source) JOIN sure USING (source) WHERE score IS NOT NULL""")
def share_payload(spark, sf):
    """Occurrences, not distinct findings, are shared; a source without a reliable score has no payload."""
    found = fd.detect(base.documents(spark, sf), sized=True)
    counts = {k: F.coalesce(F.sum(F.when((F.col("severity") == s) & (F.col("rule") != fd.SIZE), F.col("occurrences"))), F.lit(0)).alias(k) for k, s in (("e", "error"), ("w", "warning"), ("i", "info"))}
    every = settle(score.aggregate_rules(found, "source", extra=[F.count("*").alias("rows"), *counts.values()]))
    rules = every.where(F.col("rule") != fd.SIZE)
    sizes = every.where(F.col("rule") == fd.SIZE).select("source", F.expr("occurrences div 20").alias("production_lines"), F.col("rows").alias("source_files"))
    told = score.score(sizes, score.by_dimension(score.densities(rules, sizes, "source"), "source"), "source")
    sums = rules.groupBy("source").agg(*[F.sum(k).alias(k) for k in counts], F.bool_and("authoritative").alias("sure")).where("sure")
    keys = {k: F.col(k) for k in counts} | {"f": F.col("source_files"), "l": F.col("production_lines")}
    return told.where("score is not null").join(sums, "source").select("source", score.share_payload(F.col("score"), keys).alias("payload"))


@query("SELECT event_type, count(DISTINCT user_id) AS paths, count(*) AS findings FROM events GROUP BY event_type HAVING count(DISTINCT user_id) >= 40")
def migration_advisory(spark, sf):
    return fd.advisories(base.table(spark, sf, "events"), "event_type", "user_id")


@query("SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R') USING (o_orderkey)")
def scope_semi(spark, sf):
    changed = base.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return fd.in_scope(base.table(spark, sf, "orders"), changed, "o_orderkey").select("o_orderkey", "o_custkey")


@query(f"""WITH {FINDINGS}, t AS (SELECT source, rule, severity, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, doc_id, rule) AS place, count(*) OVER (PARTITION BY source) AS n FROM findings)
  SELECT source, string_agg(rule || '@' || doc_id, ', ' ORDER BY place) || CASE WHEN max(n) > 8 THEN ' +' || (max(n) - 8) || ' more' ELSE '' END AS sites FROM t WHERE place <= 8 GROUP BY source""")
def issue_sites(spark, sf):
    """The first 8 sites of each source in order, and how many more there are.

    Each part of a source keeps its own first 8 and its number, and these few are put
    together, so that no task orders all findings of a source.
    """
    from pyspark.sql import Window

    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    site = F.struct(rank.alias("rank"), "doc_id", "rule")
    rows = base.findings(spark, sf).select("source", (F.col("doc_id") % PARTS).alias("part"), site.alias("site"))
    part = Window.partitionBy("source", "part")
    first = rows.select("source", "part", "site", F.row_number().over(part.orderBy("site")).alias("place"), F.count("*").over(part).alias("n")).where("place <= 8")
    held = first.groupBy("source", "part").agg(F.collect_list("site").alias("sites"), F.max("n").alias("n"))
    every = held.groupBy("source").agg(F.slice(F.sort_array(F.flatten(F.collect_list("sites"))), 1, 8).alias("sites"), F.sum("n").alias("n"))
    listed = F.array_join(F.transform("sites", lambda s: F.concat(s["rule"], F.lit("@"), s["doc_id"].cast("string"))), ", ")
    more = F.when(F.col("n") > 8, F.concat(F.lit(" +"), (F.col("n") - 8).cast("string"), F.lit(" more"))).otherwise("")
    return every.select("source", F.concat(listed, more).alias("sites"))


@query(f"""WITH {FINDINGS}, p AS (SELECT source, doc_id % {PARTS} AS part, sha256(string_agg(rule || ':' || doc_id || ':' || occurrences, chr(10) ORDER BY rule, doc_id)) AS digest FROM findings GROUP BY source, doc_id % {PARTS})
  SELECT source, sha256(string_agg(part || ':' || digest, chr(10) ORDER BY part)) AS digest FROM p GROUP BY source""")
def findings_digest(spark, sf):
    """A digest of the digests of a source's parts."""
    line = F.struct("rule", "doc_id", F.concat_ws(":", "rule", F.col("doc_id").cast("string"), F.col("occurrences").cast("string")).alias("line"))
    joined = lambda rows: F.sha2(F.array_join(F.sort_array(F.collect_list(rows))["line"], "\n"), 256).alias("digest")
    parts = base.findings(spark, sf).groupBy("source", (F.col("doc_id") % PARTS).alias("part")).agg(joined(line))
    return parts.groupBy("source").agg(joined(F.struct("part", F.concat_ws(":", F.col("part").cast("string"), "digest").alias("line"))))
