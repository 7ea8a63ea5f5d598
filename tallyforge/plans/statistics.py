"""Queries of rates, intervals, agreement, samples and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import score, stats
from . import base
from .base import AGGREGATES, FINDINGS, SIZES, score_sql
from .registry import query


def _wilson(fp: str, n: str, name: str) -> str:
    z = "1.959963985::DOUBLE"
    p = f"({fp}::DOUBLE / {n})"
    centre, spread = f"({p} + {z} * {z} / (2 * {n}))", f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n})))"
    bound = lambda op: f"CASE WHEN {n} = 0 OR {fp} > {n} THEN {0 if op == '-' else 10000} ELSE CAST(round(least(greatest(({centre} {op} {spread}) / (1 + {z} * {z} / {n}), 0.0), 1.0) * 10000) AS BIGINT) END"
    return f"{bound('-')} AS {name}low, {bound('+')} AS {name}high"


REVIEWED = "r AS (SELECT d.source, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"
BY_LANG = f"WITH {REVIEWED}, t AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS fp FROM r GROUP BY lang), w AS (SELECT *, CAST(CASE WHEN n > 0 THEN fp * 10000 // n ELSE 0 END AS BIGINT) AS rate, {_wilson('fp', 'n', '')} FROM t)"


def _reviewed(spark, sf):
    return base.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(base.table(spark, sf, "labels"), "doc_id")


def _by_lang(spark, sf):
    t = _reviewed(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("fp"))
    low, high = stats.wilson(F.col("fp"), F.col("n"))
    return t.select("lang", "n", "fp", stats.rate(F.col("fp"), F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


@query(f"{BY_LANG} SELECT * FROM w")
def wilson_interval(spark, sf):
    return _by_lang(spark, sf)


@query(f"WITH v AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS fp, count(*) - o_custkey % 4 AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, fp, n, {_wilson('fp', 'n', '')} FROM v")
def wilson_vectors(spark, sf):
    """Each customer as a rule with reviews; some with more failures than reviews, some with none."""
    v = base.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("fp"), F.count("*").alias("n")).withColumn("n", F.col("n") - F.col("o_custkey") % 4)
    low, high = stats.wilson(F.col("fp"), F.col("n"))
    return v.select("o_custkey", "fp", "n", low.alias("low"), high.alias("high"))


@query(f"{BY_LANG} SELECT lang, CASE WHEN low > 500 THEN 'above' WHEN high < 500 THEN 'below' ELSE 'indecisive' END AS separation FROM w")
def separation(spark, sf):
    return _by_lang(spark, sf).select("lang", stats.separation(F.col("low"), F.col("high")).alias("separation"))


PAIRED = f"""{BY_LANG}, g AS (SELECT a.lang AS first, b.lang AS second, a.n AS n1, b.n AS n2, b.rate - a.rate AS gap,
  CAST(round(least(greatest(b.rate - a.rate - sqrt(pow(greatest(b.rate - b.low, 0), 2) + pow(greatest(a.high - a.rate, 0), 2)), -10000), 10000)) AS BIGINT) AS low,
  CAST(round(least(greatest(b.rate - a.rate + sqrt(pow(greatest(b.high - b.rate, 0), 2) + pow(greatest(a.rate - a.low, 0), 2)), -10000), 10000)) AS BIGINT) AS high FROM w a JOIN w b ON a.lang < b.lang)"""


def _paired(spark, sf):
    w = _by_lang(spark, sf)  # a row a language
    both = w.alias("a").join(w.alias("b"), F.col("a.lang") < F.col("b.lang"))
    gap, low, high = stats.newcombe(F.col("a.fp"), F.col("a.n"), F.col("b.fp"), F.col("b.n"))
    return both.select(F.col("a.lang").alias("first"), F.col("b.lang").alias("second"), F.col("a.n").alias("n1"), F.col("b.n").alias("n2"), gap.alias("gap"), low.alias("low"), high.alias("high"))


@query(f"{PAIRED} SELECT * FROM g")
def newcombe_difference(spark, sf):
    return _paired(spark, sf)


@query(f"{PAIRED} SELECT first, second, CASE WHEN low > 0 OR high < 0 THEN 'separated' ELSE 'indistinguishable' END AS verdict, n1 < 40 OR n2 < 40 AS thin FROM g")
def rate_comparison(spark, sf):
    return _paired(spark, sf).select("first", "second", stats.verdict(F.col("low"), F.col("high")).alias("verdict"), ((F.col("n1") < stats.LEAST_ARM) | (F.col("n2") < stats.LEAST_ARM)).alias("thin"))


CELLS = "count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS both_yes, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS first_only, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS second_only, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS neither"


@query(f"WITH {REVIEWED} SELECT lang, {CELLS} FROM r GROUP BY lang")
def contingency(spark, sf):
    return stats.contingency(_reviewed(spark, sf), "quality", "toxic", "lang")


@query(f"""WITH {REVIEWED}, c AS (SELECT lang, {CELLS} FROM r GROUP BY lang), q AS (SELECT lang, (both_yes + first_only + second_only + neither)::DOUBLE AS n, both_yes::DOUBLE AS a, first_only::DOUBLE AS b, second_only::DOUBLE AS c, neither::DOUBLE AS d FROM c),
  p AS (SELECT lang, n, (a + d) / n AS po, (a + b) / n AS p1, (a + c) / n AS p2 FROM q)
  SELECT lang, CASE WHEN p1 NOT IN (0, 1) AND p2 NOT IN (0, 1) THEN CAST(round((po - (p1 * p2 + (1 - p1) * (1 - p2))) / (1 - (p1 * p2 + (1 - p1) * (1 - p2))) * 10000) AS BIGINT) END AS kappa,
  CAST(round((po - 2 * ((p1 + p2) / 2) * (1 - (p1 + p2) / 2)) / (1 - 2 * ((p1 + p2) / 2) * (1 - (p1 + p2) / 2)) * 10000) AS BIGINT) AS ac1 FROM p""")
def kappa_ac1(spark, sf):
    kappa, ac1 = stats.agreement()
    return stats.contingency(_reviewed(spark, sf), "quality", "toxic", "lang").select("lang", kappa.alias("kappa"), ac1.alias("ac1"))


SOURCES = f"WITH {REVIEWED}, a AS (SELECT source, count(*) AS findings FROM documents GROUP BY source), s AS (SELECT a.source, a.findings, count(r.source) AS n, count(*) FILTER (WHERE r.toxic = 1) AS fp FROM a LEFT JOIN r USING (source) GROUP BY a.source, a.findings)"


def _by_source(spark, sf):
    r = _reviewed(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("fp"))
    every = base.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("findings"))
    return every.join(r, "source", "left").fillna(0, ["n", "fp"])


# Reviews of a source's findings: a repository is a language, findings are documents of 500 characters and more.
REVIEWS = """o AS (SELECT source, lang, count(*) AS n FROM documents WHERE n_chars >= 500 GROUP BY source, lang),
f AS (SELECT d.source, coalesce(sum(o.n), 0) AS findings FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN o USING (source) GROUP BY d.source),
v AS (SELECT d.source, d.lang, d.n_chars AS line FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id % 3 = 0),
dup AS (SELECT DISTINCT source FROM (SELECT source FROM v GROUP BY source, lang, line HAVING count(*) > 1)), st AS (SELECT DISTINCT source FROM v ANTI JOIN o USING (source, lang)),
c AS (SELECT source, count(*) AS n FROM v GROUP BY source)"""


@query(f"""WITH {REVIEWS} SELECT source, CAST(findings AS BIGINT) AS findings, coalesce(n, 0) AS n, CASE WHEN findings = 0 THEN 'unobserved' WHEN coalesce(n, 0) >= least(5, findings) AND coalesce(n, 0) <= findings AND source NOT IN (SELECT source FROM dup) AND source NOT IN (SELECT source FROM st) THEN 'publishable' ELSE 'incomplete' END AS status FROM f LEFT JOIN c USING (source)""")
def precision_status(spark, sf):
    """Reviews that repeat a site, or whose site isn't observed any more, hold a rule's rate back."""
    docs = base.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    observed = docs.where("n_chars >= 500").groupBy("source", "lang").agg(F.count("*").alias("k"))
    reviews = docs.where("doc_id % 3 = 0").join(base.table(spark, sf, "labels").select("doc_id"), "doc_id").select("source", "lang", F.col("n_chars").alias("line"))
    twice = reviews.groupBy("source", "lang", "line").agg(F.count("*").alias("k")).where("k > 1").select("source").distinct().withColumn("duplicated", F.lit(True))
    stale = reviews.join(observed, ["source", "lang"], "left_anti").select("source").distinct().withColumn("stale", F.lit(True))
    counted = reviews.groupBy("source").agg(F.count("*").alias("n"))
    found = docs.select("source").distinct().join(observed.groupBy("source").agg(F.sum("k").alias("findings")), "source", "left")
    every = found.join(counted, "source", "left").join(twice, "source", "left").join(stale, "source", "left").fillna(0, ["findings", "n"]).fillna(False, ["duplicated", "stale"])
    return every.select("source", "findings", "n", stats.precision_status(F.col("n"), F.col("findings"), F.col("stale"), F.col("duplicated")).alias("status"))


GATE = f"""{SOURCES}, w AS (SELECT *, CASE WHEN source LIKE '%1' THEN 'P0' ELSE 'P3' END AS tier, {_wilson('fp', 'n', '')} FROM s WHERE source NOT LIKE '%7'),
g AS (SELECT source, CASE WHEN n = 0 THEN 'unproven' WHEN tier = 'P0' AND fp > 0 THEN 'refused' WHEN fp * 10000 // n > 500 THEN 'noisy' WHEN NOT high < 500 THEN 'indecisive' ELSE 'admitted' END AS admission FROM w)"""


def _gate(spark, sf):
    """Rules (sources) that are on by default, and how the gate takes them."""
    tier = F.when(F.col("source").endswith("1"), "P0").otherwise("P3")
    low, high = stats.wilson(F.col("fp"), F.col("n"))
    rules = _by_source(spark, sf).where(~F.col("source").endswith("7"))
    return rules.select("source", stats.admission(tier, F.col("fp"), F.col("n"), low, high).alias("admission"))


@query(f"{GATE} SELECT source, admission, admission <> 'refused' AS admitted FROM g")
def corpus_gate(spark, sf):
    return _gate(spark, sf).withColumn("admitted", F.col("admission") != "refused")


@query(f"{GATE} SELECT CASE WHEN bool_or(admission = 'refused') THEN 'failed' ELSE 'passed' END AS verdict, count(*) FILTER (WHERE admission = 'refused') AS refused FROM g")
def corpus_verdict(spark, sf):
    """The gate fails if it refuses any rule."""
    n = F.count_if(F.col("admission") == "refused")
    return _gate(spark, sf).agg(F.when(n > 0, "failed").otherwise("passed").alias("verdict"), n.alias("refused"))


@query("""WITH p AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) - 1 AS position, count(*) OVER (PARTITION BY source) AS n FROM documents)
  SELECT source, doc_id, position FROM p WHERE position IN (SELECT unnest(list_transform(range(least(20, n)), lambda i: i * n // least(20, n))))""")
def stride_sample(spark, sf):
    docs = base.table(spark, sf, "documents").select("source", "lang", "doc_id")
    return stats.stride_sample(docs, "source", ["lang", "doc_id"]).select("source", "doc_id", F.col("position").cast("bigint").alias("position"))


@query("SELECT source, count(*) AS carried, count(*) FILTER (WHERE doc_id % 5 = 0) AS twice FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 0 GROUP BY source HAVING count(*) FILTER (WHERE doc_id % 15 = 0) > 0")
def carry_over_check(spark, sf):
    """Plans of which sampled and carried sites are not disjoint."""
    docs = base.table(spark, sf, "documents").select("source", "doc_id")
    sampled, carried = docs.where("doc_id % 5 = 0"), docs.where("doc_id % 3 = 0")
    shared = sampled.join(carried, ["source", "doc_id"], "left_semi").select("source").distinct()
    union = sampled.unionByName(carried).dropDuplicates(["source", "doc_id"])
    return union.join(shared, "source", "left_semi").groupBy("source").agg(F.count("*").alias("carried"), F.count_if(F.col("doc_id") % 5 == 0).alias("twice"))


@query(f"""WITH {FINDINGS}, {SIZES}, {AGGREGATES}, {score_sql()} SELECT count(*) FILTER (WHERE score >= 75) AS great, count(*) FILTER (WHERE score >= 50 AND score < 75) AS needs_work, count(*) FILTER (WHERE score < 50) AS critical,
  CAST(min(score) AS BIGINT) AS least, CAST(max(score) AS BIGINT) AS most, CAST(max(score) - min(score) AS BIGINT) AS spread, CAST(round(median(score) * 100) AS BIGINT) AS median_centi, count(DISTINCT score) <= 1 AS collapsed FROM scores""")
def score_distribution(spark, sf):
    from .findings import health_score

    s = F.col("score")
    return health_score(spark, sf).agg(F.count_if(s >= 75).alias("great"), F.count_if((s >= 50) & (s < 75)).alias("needs_work"), F.count_if(s < 50).alias("critical"), F.min(s).cast("bigint").alias("least"), F.max(s).cast("bigint").alias("most"), (F.max(s) - F.min(s)).cast("bigint").alias("spread"), stats.median_centi(s).alias("median_centi"), (F.count_distinct(s) <= 1).alias("collapsed"))


POPULATIONS = f"""{FINDINGS}, {SIZES}, {AGGREGATES}, {score_sql()}, c AS (SELECT source, count(*) AS n FROM findings WHERE producer = 'structure' GROUP BY source), t AS (SELECT source, min(tier) AS worst FROM dims GROUP BY source),
  x AS (SELECT CASE WHEN right(source, 1) IN ('0', '2', '4', '6', '8') THEN 'healthy' ELSE 'agent' END AS population, score, coalesce(n, 0) AS n, production_lines, worst FROM scores LEFT JOIN c USING (source) LEFT JOIN t USING (source)),
  told AS (SELECT population, count(*) FILTER (WHERE score >= 75) AS great, count(*) FILTER (WHERE score >= 50 AND score < 75) AS needs_work, count(*) FILTER (WHERE score < 50) AS critical, CAST(coalesce(min(score), 0) AS BIGINT) AS least, CAST(coalesce(max(score), 0) AS BIGINT) AS most,
  count(*) FILTER (WHERE score IS NOT NULL AND worst <= 1) AS ceilings, count(DISTINCT score) <= 1 AS one_value, CAST(CASE WHEN sum(production_lines) > 0 THEN sum(n) * 1000000 // sum(production_lines) ELSE 0 END AS BIGINT) AS density_milli,
  CAST(coalesce(round(median(score) * 100), 0) AS BIGINT) AS median_centi FROM x GROUP BY population)"""


@query(f"WITH {POPULATIONS} SELECT *, most - least AS spread, CAST(great > 0 AS INT) + CAST(needs_work > 0 AS INT) + CAST(critical > 0 AS INT) <= 1 AS one_band FROM told")
def score_populations(spark, sf):
    """Sources of two populations: the distribution of their scores and the density of their structural findings."""
    from .findings import _rules

    rules, sizes = _rules(spark, sf)
    dimensions = score.by_dimension(rules, "source")
    found = rules.where("producer = 'structure'").groupBy("source").agg(F.sum("rows").alias("findings"))
    worst = dimensions.groupBy("source").agg(F.min("tier").alias("worst"))
    every = score.score(sizes, dimensions, "source").join(found, "source", "left").join(worst, "source", "left")
    population = F.when(F.substring("source", -1, 1).isin("0", "2", "4", "6", "8"), "healthy").otherwise("agent")
    ceiling = F.when(F.col("worst") == 0, score.OVERALL_CEILING[0]).when(F.col("worst") == 1, score.OVERALL_CEILING[1])
    return stats.populations(every.select(population.alias("population"), "score", F.coalesce("findings", F.lit(0)).alias("findings"), F.col("production_lines").alias("lines"), ceiling.alias("ceiling")), "population")


@query(f"WITH {POPULATIONS} SELECT min(least) AS least, max(most) AS most, max(most) - min(least) AS spread, CAST(coalesce(max(median_centi) FILTER (WHERE population = 'healthy'), 0) - coalesce(max(median_centi) FILTER (WHERE population = 'agent'), 0) AS BIGINT) AS separation_centi FROM told")
def score_separation(spark, sf):
    """How far the two populations' medians lie apart, and the bounds of both."""
    return stats.apart(score_populations(spark, sf), "population", "healthy", "agent")


@query("SELECT o_orderpriority, CAST(round(median(o_custkey) * 100) AS BIGINT) AS median_centi FROM orders GROUP BY o_orderpriority")
def median_centi(spark, sf):
    found = stats.order_statistics(base.table(spark, sf, "orders"), "o_orderpriority", "o_custkey", median=stats.middle())
    return found.select("o_orderpriority", F.round(F.col("median") * 100).cast("bigint").alias("median_centi"))


@query(f"WITH {FINDINGS}, {SIZES}, c AS (SELECT source, count(*) AS n FROM findings WHERE producer = 'structure' GROUP BY source) SELECT source, CAST(CASE WHEN production_lines > 0 THEN coalesce(n, 0) * 1000000 // production_lines ELSE 0 END AS BIGINT) AS density FROM sizes LEFT JOIN c USING (source)")
def density_ratio(spark, sf):
    n = base.findings(spark, sf).where("producer = 'structure'").groupBy("source").agg(F.count("*").alias("n"))
    return base.sizes(spark, sf).join(n, "source", "left").select("source", stats.density_milli(F.coalesce("n", F.lit(0)), F.col("production_lines")).alias("density"))


@query(f"WITH {REVIEWED} SELECT count(*) FILTER (WHERE quality <> toxic) AS escalations FROM r")
def open_escalations(spark, sf):
    return _reviewed(spark, sf).agg(F.count_if(F.col("quality") != F.col("toxic")).alias("escalations"))


@query("SELECT event_type, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM events GROUP BY event_type")
def percentile_rank(spark, sf):
    return stats.order_statistics(base.table(spark, sf, "events"), "event_type", "value", p95=stats.discrete(95))
