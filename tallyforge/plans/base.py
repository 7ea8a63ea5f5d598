"""Tables that the queries share, and the SQL of the findings view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as fd
from ..operators import score
from ..operators.graph import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.detect(documents(spark, sf_dir))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a workspace: a line counts 20 characters, a document is a file."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.expr("coalesce(sum(n_chars), 0) div 20").alias("production_lines"), F.count("*").alias("source_files"))


def rules_and_sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings by source and rule (with their number in ``rows``), and the sources' sizes: one settled aggregate of a few rows, from two scans."""
    found = fd.detect(documents(spark, sf_dir), sized=True)
    every = settle(score.aggregate_rules(found, "source", extra=[F.count("*").alias("rows")]))
    sizes_ = every.where(F.col("rule") == fd.SIZE).select("source", F.expr("occurrences div 20").alias("production_lines"), F.col("rows").alias("source_files"))
    return every.where(F.col("rule") != fd.SIZE), sizes_


#: White space of Unicode, as DuckDB's patterns write it.
WHITE = r"\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

FINDINGS = r"""
docs AS (SELECT doc_id, source, lang, n_chars, coalesce(text, '') AS text FROM documents),
long_lines AS (SELECT doc_id, source, line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE length(line) > 20),
raw AS (
  SELECT 'oversized_unit' AS rule, doc_id, source, 1 AS occurrences FROM docs WHERE n_chars >= 10000
  UNION ALL SELECT 'duplicate_body', min(doc_id), arg_min(source, doc_id), count(*) FROM docs GROUP BY text HAVING count(*) > 1
  UNION ALL SELECT 'repeated_line', doc_id, source, count(*) FROM (SELECT doc_id, source, line FROM long_lines GROUP BY doc_id, source, line HAVING count(*) > 1) GROUP BY doc_id, source
  UNION ALL SELECT 'email', doc_id, source, 1 FROM docs WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')
  UNION ALL SELECT 'license_line', doc_id, source, 1 FROM docs WHERE regexp_matches(text, '(?i)(copyright|license|spdx)')
  UNION ALL SELECT 'token_literal', doc_id, source, 1 FROM docs WHERE regexp_matches(text, 'token = "[0-9a-f]{40}"')
  UNION ALL SELECT 'enormous_unit', doc_id, source, 1 FROM docs WHERE n_chars >= 20000
),
rules(rule, category, producer, tier, severity, noise_bp) AS (VALUES
  ('oversized_unit', 'maintainability', 'structure', 'P3', 'warning', 3333), ('duplicate_body', 'maintainability', 'structure', 'P3', 'warning', 4000),
  ('repeated_line', 'maintainability', 'structure', 'P3', 'info', 10000), ('email', 'security', 'repo', 'P1', 'error', NULL),
  ('license_line', 'dependencies', 'cargo', 'P2', 'warning', 0), ('token_literal', 'security', 'repo', 'P1', 'error', NULL)),
findings AS (SELECT r.rule, r.doc_id, r.source, CAST(r.occurrences AS BIGINT) AS occurrences, u.category, u.producer, u.tier, coalesce(u.severity, 'warning') AS severity, u.noise_bp,
  CASE WHEN r.doc_id % 10 = 0 THEN 'tests' END AS context FROM raw r LEFT JOIN rules u USING (rule))"""

SIZES = """
sizes AS (SELECT source, CAST(coalesce(sum(n_chars), 0) // 20 AS BIGINT) AS production_lines, count(*) AS source_files FROM documents GROUP BY source)"""

#: The score of each source, step by step.
AGGREGATES = """
weighed AS (SELECT *, CASE WHEN severity = 'error' THEN 2 ELSE 1 END AS w FROM findings),
agg AS (SELECT source, rule, sum(occurrences) AS occurrences, min(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS worst_severity,
  coalesce(sum(CASE WHEN context IS NULL AND category IS NOT NULL THEN w END), 0) AS numerator, bool_and(context IS NOT NULL OR tier IS NOT NULL) AS authoritative, min(CASE WHEN context IS NULL THEN category END) AS dimension,
  min(CAST(tier[2:2] AS INT)) AS tier, min(producer) AS producer, min(noise_bp) AS noise_bp FROM weighed GROUP BY source, rule),
dens AS (SELECT a.*, s.production_lines, a.numerator / CASE WHEN a.producer = 'structure' THEN greatest(s.production_lines / 1000.0, 2.0) ELSE 1.0 END AS density
  FROM agg a JOIN sizes s USING (source)),
params(dimension, lam, w) AS (VALUES ('security', 1.0, 4), ('reliability', 10.0, 3), ('maintainability', 3.0, 2), ('performance', 4.0, 2), ('dependencies', 3.0, 2))"""


def score_sql(dens: str = "dens") -> str:
    """CTEs that lead from rule densities to ``scores``."""
    return f"""
dims AS (SELECT source, dimension, sum(density) AS density, min(CASE WHEN numerator > 0 THEN tier END) AS tier FROM {dens} WHERE dimension IS NOT NULL GROUP BY source, dimension),
grid AS (SELECT s.source, s.production_lines, s.source_files, p.dimension, p.w, d.tier,
  least(CAST(round(100 * exp(-coalesce(d.density, 0.0) / CAST(p.lam AS DOUBLE))) AS INT), CASE d.tier WHEN 0 THEN 20 WHEN 1 THEN 50 WHEN 2 THEN 75 ELSE 100 END) AS points
  FROM sizes s CROSS JOIN params p LEFT JOIN dims d ON d.source = s.source AND d.dimension = p.dimension),
scores AS (SELECT source, production_lines, source_files,
  max(CASE WHEN dimension = 'security' THEN points END) AS security, max(CASE WHEN dimension = 'reliability' THEN points END) AS reliability,
  max(CASE WHEN dimension = 'maintainability' THEN points END) AS maintainability, max(CASE WHEN dimension = 'performance' THEN points END) AS performance,
  max(CASE WHEN dimension = 'dependencies' THEN points END) AS dependencies,
  CASE WHEN source_files > 0 AND production_lines > 0 THEN
    CAST(least((sum(points * w) + 6) // 13, CASE min(tier) WHEN 0 THEN 40 WHEN 1 THEN 65 ELSE 100 END) AS INT) END AS score
  FROM grid GROUP BY source, production_lines, source_files)"""


LABEL = "CASE WHEN score >= 75 THEN 'Great' WHEN score >= 50 THEN 'Needs work' WHEN score IS NOT NULL THEN 'Critical' END"

#: Contribution and repair value of each rule.
CONTRIBUTIONS = """
gains AS (SELECT d.source, d.rule, d.dimension, d.noise_bp, d.density, d.numerator, d.tier, p.lam, p.w, sum(d.density) OVER (PARTITION BY d.source, d.dimension) AS total
  FROM dens d JOIN params p USING (dimension)),
valued AS (SELECT *, CAST(greatest(round(1e6 * w / 13 * 100.0 * (exp(-(total - density) / CAST(lam AS DOUBLE)) - exp(-total / CAST(lam AS DOUBLE)))), 0) AS BIGINT) AS contribution FROM gains),
sure AS (SELECT source FROM agg GROUP BY source HAVING bool_and(authoritative)),
repairs AS (SELECT *, CAST(contribution * (10000 - coalesce(noise_bp, 0)) // 10000 AS BIGINT) AS repair_value FROM valued)"""
