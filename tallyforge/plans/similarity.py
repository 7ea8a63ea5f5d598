"""Queries of exact and near clones, and of two scans compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import delta
from ..operators.graph import settle
from ..operators import similarity as sim
from . import base
from .registry import query

DOCS = "docs AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)"


@query(f"WITH {DOCS} SELECT sha256(text) AS digest, count(*) AS members, min(doc_id) AS anchor FROM docs GROUP BY text HAVING count(*) > 1")
def exact_clones(spark, sf):
    return sim.families(base.documents(spark, sf))


@query(f"WITH {DOCS} SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS anchor FROM docs QUALIFY count(*) OVER (PARTITION BY text) > 1")
def clone_family_members(spark, sf):
    docs = base.documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.join(sim.families(base.documents(spark, sf)), "digest").select("doc_id", "anchor")


BAGS = r"""reps AS (SELECT min(doc_id) AS doc_id, text FROM docs GROUP BY text),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS w FROM reps),
bags AS (SELECT doc_id, token, count(*) AS cnt FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS token FROM words WHERE len(w) >= 3) GROUP BY doc_id, token),
freq AS (SELECT token, sum(cnt) AS df, count(*) AS docs FROM bags GROUP BY token),
heads AS (SELECT doc_id, token FROM (SELECT b.doc_id, b.token, coalesce(sum(b.cnt) OVER (PARTITION BY b.doc_id ORDER BY f.df, b.token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bags b JOIN freq f USING (token) WHERE f.docs >= 2) WHERE before < 16),
sizes AS (SELECT doc_id, sum(cnt) AS n FROM bags GROUP BY doc_id),
nominated AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, sx.n AS na, sy.n AS nb FROM heads x JOIN heads y ON x.token = y.token AND x.doc_id < y.doc_id JOIN sizes sx ON sx.doc_id = x.doc_id JOIN sizes sy ON sy.doc_id = y.doc_id
  WHERE greatest(sx.n, sy.n) * 8000 <= least(sx.n, sy.n) * 12000),
scored AS (SELECT a, b, CAST(2 * sum(least(l.cnt, r.cnt)) * 10000 // (na + nb) AS BIGINT) AS score FROM nominated JOIN bags l ON l.doc_id = a JOIN bags r ON r.doc_id = b AND r.token = l.token GROUP BY a, b, na, nb)"""


def _texts(spark, sf):
    """All texts, and the ids of one document a text."""
    docs = base.documents(spark, sf).select("doc_id", "text")
    return docs, settle(sim.distinct_texts(docs))


@query(f"WITH {DOCS}, {BAGS} SELECT a, b, score FROM scored WHERE score >= 8000")
def near_clone_pairs(spark, sf):
    docs, kept = _texts(spark, sf)
    return sim.pairs(docs, kept=kept)


@query(f"""WITH RECURSIVE {DOCS}, {BAGS}, e AS (SELECT a, b, score FROM scored WHERE score >= 8000), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  walk(node, seen) AS (SELECT a, a FROM both_ UNION SELECT w.node, b.b FROM walk w JOIN both_ b ON b.a = w.seen), roots AS (SELECT node, min(seen) AS root FROM walk GROUP BY node)
  SELECT root, count(*) AS members, (SELECT min(score) FROM e JOIN roots r2 ON r2.node = e.a WHERE r2.root = roots.root) AS weakest FROM roots GROUP BY root""")
def near_clone_families(spark, sf):
    docs, kept = _texts(spark, sf)
    return sim.near_families(settle(sim.pairs(docs, kept=kept, forest=True)))


@query(f"WITH {DOCS}, {BAGS} SELECT doc_id, token FROM heads")
def rare_tokens_topk(spark, sf):
    docs, kept = _texts(spark, sf)
    return sim.heads(docs, kept=kept)


@query(f"""WITH {DOCS}, {BAGS}, every AS (SELECT l.doc_id AS q, r.doc_id AS o, CAST(2 * sum(least(l.cnt, r.cnt)) * 10000 // (any_value(sx.n) + any_value(sy.n)) AS BIGINT) AS score FROM bags l JOIN bags r ON l.token = r.token AND l.doc_id <> r.doc_id JOIN sizes sx ON sx.doc_id = l.doc_id JOIN sizes sy ON sy.doc_id = r.doc_id WHERE l.doc_id % 100 = 0 GROUP BY 1, 2)
  SELECT (SELECT count(*) FROM scored WHERE score >= 8000 AND (a % 100 = 0 OR b % 100 = 0)) AS nominated, (SELECT count(DISTINCT (least(q, o), greatest(q, o))) FROM every WHERE score >= 8000) AS exhaustive""")
def nomination_recall(spark, sf):
    """Pairs of the documents whose id 100 divides, with all others: those found by heads, and all by every shared token."""
    docs, kept = _texts(spark, sf)
    found = settle(sim.candidates(docs, kept=kept))
    asked = found.where("doc_id % 100 = 0").select("doc_id")
    both = [sim.nominated_of(found, asked), sim.near_rows(found, asked)]
    by_heads, every = (x.select(F.least("q", "o"), F.greatest("q", "o")).distinct() for x in both)
    counts = by_heads.select(F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(every.select(F.lit(0).alias("x"), F.lit(1).alias("y")))
    return counts.agg(F.coalesce(F.sum("x"), F.lit(0)).cast("bigint").alias("nominated"), F.coalesce(F.sum("y"), F.lit(0)).cast("bigint").alias("exhaustive"))


# Two scans: documents as they are, and with some dropped, moved or edited.
SCANS = f"""base AS (SELECT doc_id AS idx, source AS path, lang AS origin, CASE WHEN doc_id % 4 > 0 THEN 'c' || doc_id % 3 END AS code, 'len ' || n_chars % 50 AS message, CASE WHEN doc_id % 6 > 0 AND words <> '' AND strlen(coalesce(text, '')) <= 65536 THEN words END AS proof FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '[{base.WHITE}]+', ' ', 'g')) AS words FROM documents)),
now AS (SELECT idx, CASE WHEN idx % 11 = 0 THEN path || '-moved' ELSE path END AS path, origin, code, message, CASE WHEN idx % 17 = 0 THEN NULL WHEN idx % 13 = 0 THEN 'edited ' || proof ELSE proof END AS proof FROM base WHERE idx % 7 <> 0),
b0 AS (SELECT idx, path, origin, code, message, CASE WHEN proof IS NOT NULL THEN sha256(concat_ws('|', origin, coalesce(code, '-'), message, proof)) END AS fp FROM base),
n0 AS (SELECT idx, path, origin, code, message, CASE WHEN proof IS NOT NULL THEN sha256(concat_ws('|', origin, coalesce(code, '-'), message, proof)) END AS fp FROM now)"""


def _pass_sql(k: int, key: str, left: str, right: str) -> str:
    on = " AND ".join(f"b.{c} IS NOT DISTINCT FROM n.{c}" for c in [*key.split(", "), "k"])
    return f"""p{k} AS (SELECT b.idx AS baseline_idx, n.idx AS current_idx, {k} AS pass FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY idx) AS k FROM b{k - 1} WHERE {left}) b JOIN (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY idx) AS k FROM n{k - 1} WHERE {right}) n ON {on}),
b{k} AS (SELECT * FROM b{k - 1} WHERE idx NOT IN (SELECT baseline_idx FROM p{k})), n{k} AS (SELECT * FROM n{k - 1} WHERE idx NOT IN (SELECT current_idx FROM p{k}))"""


DELTA = f"WITH {SCANS}, " + ", ".join([_pass_sql(1, "path, fp", "fp IS NOT NULL", "fp IS NOT NULL"), _pass_sql(2, "path, origin, code, message", "fp IS NULL", "fp IS NOT NULL"), _pass_sql(3, "path, origin, code, message", "true", "fp IS NULL"), _pass_sql(4, "fp", "fp IS NOT NULL", "fp IS NOT NULL")]) + ", pairs AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)"


def _scans(spark, sf):
    docs = base.table(spark, sf, "documents")
    text = T.proof_words(F.coalesce("text", F.lit("")))
    b = docs.select(F.col("doc_id").alias("idx"), F.col("source").alias("path"), F.col("lang").alias("origin"), F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string"))).alias("code"), F.concat(F.lit("len "), (F.col("n_chars") % 50).cast("string")).alias("message"), F.when(F.col("doc_id") % 6 > 0, text).alias("proof"))
    i = F.col("idx")
    n = b.where(i % 7 != 0).withColumn("path", F.when(i % 11 == 0, F.concat("path", F.lit("-moved"))).otherwise(F.col("path"))).withColumn("proof", F.when(i % 17 == 0, None).when(i % 13 == 0, F.concat(F.lit("edited "), "proof")).otherwise(F.col("proof")))
    mark = lambda d: d.withColumn("fp", delta.fingerprint(F.col("origin"), F.col("code"), F.col("message"), F.col("proof"))).drop("proof")
    # Whole texts are read and digested once; what is left of them are narrow rows.
    sides = settle(mark(b).withColumn("side", F.lit(0)).unionByName(mark(n).withColumn("side", F.lit(1))))
    return sides.where("side = 0").drop("side"), sides.where("side = 1").drop("side")


@query(f"{DELTA} SELECT * FROM pairs")
def delta_pairing(spark, sf):
    return delta.pair(*_scans(spark, sf))


@query(f"{DELTA} SELECT idx, path FROM n0 WHERE idx NOT IN (SELECT current_idx FROM pairs)")
def delta_introduced(spark, sf):
    b, n = _scans(spark, sf)
    return delta.introduced(n, delta.pair(b, n)).select("idx", "path")


@query(f"{DELTA} SELECT idx, path FROM b0 WHERE idx NOT IN (SELECT baseline_idx FROM pairs)")
def delta_fixed(spark, sf):
    b, n = _scans(spark, sf)
    return delta.fixed(b, delta.pair(b, n)).select("idx", "path")


@query(f"{DELTA} SELECT (SELECT count(*) FROM n4) AS introduced, (SELECT count(*) FROM pairs) AS pre_existing, (SELECT count(*) FROM b4) AS fixed, (SELECT count(*) FROM p4) AS cross_file_matches")
def delta_summary(spark, sf):
    b, n = _scans(spark, sf)
    pairs = delta.pair(b, n)
    one = lambda d, name: d.select(F.lit(name).alias("kind"))
    rows = one(delta.introduced(n, pairs), "introduced").unionByName(one(delta.fixed(b, pairs), "fixed")).unionByName(pairs.select(F.when(F.col("pass") == 4, "cross").otherwise("same").alias("kind")))
    k = F.col("kind")
    return rows.agg(F.count_if(k == "introduced").alias("introduced"), F.count_if(k.isin("cross", "same")).alias("pre_existing"), F.count_if(k == "fixed").alias("fixed"), F.count_if(k == "cross").alias("cross_file_matches"))
