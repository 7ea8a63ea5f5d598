"""Queries of identities, of the one schema of all producers, and of evidence under spans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import text as T
from ..operators import findings as fd
from ..operators import normalize, presentation, score
from ..operators import policy as pol
from ..sources import catalog
from . import base
from .base import AGGREGATES, CONTRIBUTIONS, FINDINGS, SIZES
from .registry import query

# Events as messages of a compiler: some without a code, a path or a span.
EVENTS = """ev AS (SELECT event_id, event_type AS source, CASE WHEN event_id % 5 > 0 THEN 'k' || user_id % 7 END AS code, CASE WHEN event_id % 4 > 0 THEN 'src/u' || user_id || '.rs' END AS path,
  CASE WHEN event_id % 3 > 0 THEN event_id % 97 + 1 END AS line, event_id % 13 + 1 AS col, CASE WHEN value > 100 THEN 'error' WHEN value > 50 THEN 'warning' WHEN value > 10 THEN 'info' ELSE 'unknown' END AS severity, props AS message, CAST(user_id AS VARCHAR) AS package FROM events)"""
SPAN = """CASE WHEN line IS NULL THEN 'null' ELSE '{"line_start":' || line || ',"column_start":' || col || ',"line_end":' || line || ',"column_end":' || (col + 4) || '}' END"""


def _inside(*names: str) -> str:
    """The inside of a JSON list of the columns."""
    listed = f"CAST(json_array({', '.join(names)}) AS VARCHAR)"
    return f"{listed}[2:length({listed}) - 1]"


POSITIONAL = f"sha256('[' || {_inside('source', 'code', 'path')} || ',' || {SPAN} || ',' || {_inside('severity', 'message')} || ']')"
MANIFEST = f"sha256('[' || {_inside('source', 'code', 'path')} || ',null,' || {_inside('severity', 'message')} || ']')"


def _events(spark, sf):
    i, v = F.col("event_id"), F.col("value")
    columns = {
        "source": F.col("event_type"),
        "code": F.when(i % 5 > 0, F.concat(F.lit("k"), (F.col("user_id") % 7).cast("string"))),
        "path": F.when(i % 4 > 0, F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".rs"))),
        "line": F.when(i % 3 > 0, i % 97 + 1),
        "column": i % 13 + 1,
        "severity": F.when(v > 100, "error").when(v > 50, "warning").when(v > 10, "info").otherwise("unknown"),
        "message": F.col("props"),
        "package": F.col("user_id").cast("string"),
    }
    columns["line_end"], columns["column_end"] = columns["line"], columns["column"] + 4
    return base.table(spark, sf, "events"), columns


@query(f"WITH {EVENTS} SELECT event_id, {POSITIONAL} AS id FROM ev")
def positional_identity(spark, sf):
    rows, c = _events(spark, sf)
    span = identity.span_json(c["line"], c["column"], c["line_end"], c["column_end"])
    return rows.select("event_id", identity.positional(c["source"], c["code"], c["path"], span, c["severity"], c["message"]).alias("id"))


@query(f"WITH {EVENTS} SELECT event_id, {MANIFEST} AS id FROM ev")
def manifest_identity(spark, sf):
    """The same wherever the span is."""
    rows, c = _events(spark, sf)
    return rows.select("event_id", identity.of_manifest(c["source"], c["code"], c["path"], c["severity"], c["message"]).alias("id"))


def _field(text: str) -> str:
    n = f"strlen({text})"
    low = " || ".join(f"printf('%02X', ({n} >> {8 * i}) & 255)" for i in range(4))
    return f"unhex({low} || '00000000') || encode({text})"


FAMILY = f"sha256({_field(chr(39) + identity.FAMILY_DOMAIN + chr(39))} || {_field('code')} || {_field('key')})"
CLONES = f"""fam AS (SELECT 'structure' AS source, 'structure::duplicate_function_body' AS code, 'warning' AS severity, sha256(text) AS key, count(*) AS members, min(doc_id) AS anchor FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY text HAVING count(*) > 1),
keyed AS (SELECT *, {FAMILY} AS structure FROM fam),
named AS (SELECT *, sha256('[' || {_inside('source', 'code')} || ',null,' || {_inside('structure', 'severity')} || ']') AS id FROM keyed)"""


def _families(spark, sf):
    rows = base.documents(spark, sf).groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("members"), F.min("doc_id").alias("anchor")).where("members > 1")
    return rows.withColumns({"source": F.lit("structure"), "code": F.lit("structure::duplicate_function_body"), "severity": F.lit("warning")})


@query(f"WITH {CLONES} SELECT key, structure FROM keyed")
def family_hash(spark, sf):
    return _families(spark, sf).select("key", identity.family(F.col("code"), F.col("key")).alias("structure"))


@query(f"WITH {CLONES} SELECT anchor, members, id FROM named")
def structural_identity(spark, sf):
    """Families of equal texts: no path is part of their identity."""
    structure = identity.family(F.col("code"), F.col("key"))
    return _families(spark, sf).select("anchor", "members", identity.structural(F.col("source"), F.col("code"), F.col("severity"), structure).alias("id"))


PART = "'cargo' AS source, 'cargo::' || lower(p_type) AS code, 'Cargo.toml' AS path, CASE WHEN p_size > 25 THEN 'error' ELSE 'info' END AS severity, p_name AS message"
SUPPLIER = "'repo' AS source, 'repo::tracked_secret_file' AS code, 'keys/' || s_suppkey || '.pem' AS path, 'error' AS severity, s_name AS message"
UNION = f"""every AS (SELECT {POSITIONAL} AS id, source, code, severity, message, path, line, col AS column_, package FROM ev
  UNION ALL SELECT {MANIFEST}, source, code, severity, message, path, NULL, NULL, NULL FROM (SELECT {PART} FROM part)
  UNION ALL SELECT {MANIFEST}, source, code, severity, message, path, NULL, NULL, NULL FROM (SELECT {SUPPLIER} FROM supplier)
  UNION ALL SELECT id, source, code, severity, 'seen ' || members || ' times', 'doc/' || anchor, 1, 1, NULL FROM named)"""


def _union(spark, sf):
    rows, c = _events(spark, sf)
    parts = {"source": F.lit("cargo"), "code": F.concat(F.lit("cargo::"), F.lower("p_type")), "path": F.lit("Cargo.toml"), "severity": F.when(F.col("p_size") > 25, "error").otherwise("info"), "message": F.col("p_name")}
    secrets = {"source": F.lit("repo"), "code": F.lit("repo::tracked_secret_file"), "path": F.concat(F.lit("keys/"), F.col("s_suppkey").cast("string"), F.lit(".pem")), "severity": F.lit("error"), "message": F.col("s_name")}
    said = F.concat(F.lit("seen "), F.col("members").cast("string"), F.lit(" times"))
    clones = {"source": F.col("source"), "code": F.col("code"), "severity": F.col("severity"), "message": said, "path": F.concat(F.lit("doc/"), F.col("anchor").cast("string")), "line": F.lit(1), "column": F.lit(1)}
    return normalize.union(normalize.compiler(rows, **c), normalize.manifests(base.table(spark, sf, "part"), **parts), normalize.manifests(base.table(spark, sf, "supplier"), **secrets), normalize.structures(_families(spark, sf), F.col("key"), **clones))


@query(f"WITH {EVENTS}, {CLONES}, {UNION} SELECT id, source, code, severity, message, path, line, column_, package FROM every")
def native_union(spark, sf):
    """Messages, manifest findings, repository findings and families in one schema."""
    return _union(spark, sf).withColumnRenamed("column", "column_")


@query(f"WITH {EVENTS}, {CLONES}, {UNION} SELECT e.id, c.c_name AS package FROM every e LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = e.package")
def package_join(spark, sf):
    """Each finding with the name of its package, if it has a known one."""
    return normalize.with_package(_union(spark, sf), base.table(spark, sf, "customer"), "c_custkey", "c_name").select("id", "package")


RANK = "CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END"


@query(f"WITH {EVENTS}, {CLONES}, {UNION} SELECT path, id, lag(id) OVER (PARTITION BY path ORDER BY line NULLS LAST, column_ NULLS LAST, {RANK}, code NULLS FIRST, id) AS before FROM every WHERE path IS NOT NULL")
def diagnostic_order(spark, sf):
    """Each finding with the one before it in the order of its file: the order's later four keys, told within the first."""
    from ..operators.graph import settle
    from ..operators.ordered import ranked

    found = settle(_union(spark, sf).where("path is not null").select("path", "line", "column", "severity", "code", "id"))
    order = [F.col("line").asc_nulls_last(), F.col("column").asc_nulls_last(), normalize.severity_rank(F.col("severity")), F.col("code").asc_nulls_first(), "id"]
    # A file with many findings is ranked over ranges; each finding then asks for the place before its own.
    at = settle(ranked(found, ["path"], order).select("path", "place", "id"))
    before = at.select("path", (F.col("place") + 1).alias("place"), F.col("id").alias("before"))
    return at.join(before, ["path", "place"], "left").select("path", "id", "before")


@query(f"WITH {EVENTS}, {CLONES}, {UNION} SELECT id, source, code, severity, path, line, column_ FROM every ORDER BY path NULLS LAST, line NULLS LAST, column_ NULLS LAST, {RANK}, code NULLS FIRST, id")
def sorted_findings(spark, sf):
    return normalize.ordered(_union(spark, sf)).select("id", "source", "code", "severity", "path", "line", F.col("column").alias("column_"))


# Evidence: from the third character of a line to the end of the next.
LINES = "l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s, doc_id % 6 + 1 AS line, doc_id % 11 + 1 AS col FROM documents)"


@query(f"WITH {LINES} SELECT doc_id, line, col, CASE WHEN line <= len(s) AND col <= length(s[line]) + 1 THEN CAST(coalesce(list_sum(list_transform(s[1:line - 1], lambda x: strlen(x) + 1)), 0) + strlen(s[line][1:col - 1]) AS BIGINT) END AS byte_offset FROM l")
def position_offset(spark, sf):
    """Bytes before a position; null where the text doesn't reach it."""
    docs = base.documents(spark, sf).select("doc_id", "text", (F.col("doc_id") % 6 + 1).alias("line"), (F.col("doc_id") % 11 + 1).alias("col"))
    return docs.select("doc_id", "line", "col", T.byte_offset(F.col("text"), F.col("line"), F.col("col")).alias("byte_offset"))


@query(f"WITH {LINES}, r AS (SELECT doc_id, s[line][col:] || CASE WHEN line < len(s) THEN chr(10) || s[line + 1] ELSE '' END AS raw FROM l WHERE line <= len(s) AND col <= length(s[line])), e AS (SELECT doc_id, raw, trim(regexp_replace(raw, '[{base.WHITE}]+', ' ', 'g')) AS proof FROM r) SELECT doc_id, proof FROM e WHERE proof <> '' AND strlen(raw) <= 65536")
def span_evidence(spark, sf):
    """What a finding's span shows: from its place to the end of the line after it, as words."""
    docs = base.documents(spark, sf).select("doc_id", F.split("text", "\n").alias("s"), (F.col("doc_id") % 6 + 1).cast("int").alias("line"), (F.col("doc_id") % 11 + 1).cast("int").alias("col"))
    here, after = F.try_element_at("s", F.col("line")), F.try_element_at("s", F.col("line") + 1)
    shown = F.concat(F.substr(here, F.col("col")), F.coalesce(F.concat(F.lit("\n"), after), F.lit("")))
    found = docs.where(F.col("col") <= F.length(here)).select("doc_id", T.proof_words(shown).alias("proof"))
    return found.where("proof is not null")


@query(f"WITH {LINES} SELECT doc_id, line <= len(s) AND contains(s[line], 'the') AS holds FROM l")
def evidence_holds(spark, sf):
    """Whether the line of a finding says what the finding quotes."""
    docs = base.documents(spark, sf)
    line = F.try_element_at(F.split("text", "\n"), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs.select("doc_id", F.coalesce(F.contains(line, F.lit("the")), F.lit(False)).alias("holds"))


@query("WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i + 1] = 'the' AND length(w[i]) > 2 AND length(w[i + 2]) > 2)) AS hit FROM w) WHERE hit GROUP BY doc_id")
def token_window(spark, sf):
    """Windows of three words: a named one between two longer ones."""
    docs = base.documents(spark, sf).select("doc_id", F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "").alias("w"))
    three = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"), F.slice("w", F.lit(3), F.size("w")).alias("c"))
    hits = F.size(F.filter(three, lambda x: (x["b"] == "the") & (F.length(x["a"]) > 2) & (F.length(x["c"]) > 2))).cast("bigint")
    return docs.select("doc_id", hits.alias("n")).where("n > 0")


GROUPS = f"""told AS (SELECT g.source, g.rule, g.worst_severity, g.occurrences, r.repair_value, r.contribution FROM agg g LEFT JOIN repairs r USING (source, rule)),
members AS (SELECT source, rule, count(*) AS members FROM findings GROUP BY source, rule)"""


@query(f"WITH {FINDINGS}, {SIZES}, {AGGREGATES}, {CONTRIBUTIONS}, {GROUPS} SELECT source, rule, worst_severity AS severity, CAST(occurrences AS BIGINT) AS occurrences, members, row_number() OVER (PARTITION BY source ORDER BY worst_severity, coalesce(repair_value, 0) DESC, coalesce(contribution, 0) DESC, occurrences DESC, rule) AS place FROM told JOIN members USING (source, rule)")
def presentation_groups(spark, sf):
    """Groups of each source's report: by worst severity, repair value, contribution, occurrences and rule."""
    from .findings import _rules

    rules, _ = _rules(spark, sf)
    valued = score.contributions(rules, "source").select("source", "rule", "repair_value", "contribution")
    every = rules.withColumnRenamed("rows", "members").join(valued, ["source", "rule"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    order = Window.partitionBy("source").orderBy("worst_severity", zero("repair_value").desc(), zero("contribution").desc(), F.desc("occurrences"), "rule")
    return every.select("source", "rule", F.col("worst_severity").alias("severity"), "occurrences", "members", F.row_number().over(order).cast("bigint").alias("place"))


@query(f"""WITH {FINDINGS}, {SIZES}, {AGGREGATES}, {CONTRIBUTIONS}, {GROUPS}, placed AS (SELECT source, rule, row_number() OVER (PARTITION BY source ORDER BY worst_severity, coalesce(repair_value, 0) DESC, coalesce(contribution, 0) DESC, occurrences DESC, rule) AS place FROM told),
  items AS (SELECT p.source, p.place, CASE r.category WHEN 'security' THEN 1 WHEN 'dependencies' THEN 4 WHEN 'maintainability' THEN 5 ELSE 6 END AS rank FROM placed p LEFT JOIN rules r USING (rule)),
  every AS (SELECT source, rank, place FROM items UNION ALL SELECT DISTINCT source, rank, NULL FROM items)
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY rank, place NULLS FIRST) AS position, list_extract(['Security', 'Bugs', 'Performance', 'Dependencies', 'Maintainability', 'Other'], rank) AS category, place FROM every""")
def interactive_list(spark, sf):
    """The groups of each source's report below the heading of their category."""
    rules = catalog.document_rules(spark).select("rule", "category")
    groups = presentation_groups(spark, sf).join(F.broadcast(rules), "rule", "left")
    return presentation.interactive(groups.withColumn("category", fd.bucket(F.col("category"))), "source")


@query("""WITH m AS (SELECT DISTINCT lang, n_chars // 500 AS size, doc_id, CASE doc_id % 10 WHEN 0 THEN 'tests' WHEN 1 THEN 'benches' END AS context FROM documents),
  w AS (SELECT lang, size, count(*) AS occurrences, CASE WHEN count(context) = count(*) AND min(context) = max(context) THEN min(context) END AS family_context FROM m GROUP BY lang, size)
  SELECT m.lang, m.size, m.doc_id, m.context, row_number() OVER (PARTITION BY m.lang, m.size ORDER BY m.doc_id, m.context) - 1 AS place, occurrences, family_context FROM m JOIN w ON m.lang IS NOT DISTINCT FROM w.lang AND m.size IS NOT DISTINCT FROM w.size""")
def family_places(spark, sf):
    """Documents of a language and size as a family: its anchor, what is related to it, and the context that all share."""
    k = F.col("doc_id") % 10
    docs = base.table(spark, sf, "documents").select("lang", F.expr("n_chars div 500").alias("size"), "doc_id", F.when(k == 0, "tests").when(k == 1, "benches").alias("context"))
    # Told twice, as two producers would: members count once.
    return presentation.family_members(docs.unionByName(docs.where("doc_id % 2 = 0")), ["lang", "size"], ["doc_id"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem l ANTI JOIN (SELECT DISTINCT o_orderkey AS l_orderkey FROM orders WHERE o_totalprice > 100000) o USING (l_orderkey) WHERE l_returnflag = 'R'")
def stale_reviews(spark, sf):
    """Reviewed rows whose order isn't observed any more."""
    seen = base.table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    return base.table(spark, sf, "lineitem").where("l_returnflag = 'R'").join(seen, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


IDENTITY = ("event_type", "user_id", "k", "day", "big")
REVIEWED = "SELECT event_id, event_type, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, dayofyear(ts) AS day, value > 50 AS big FROM events"


@query(f"WITH r AS ({REVIEWED}), pairs AS (SELECT event_type, user_id, k, day, big FROM r WHERE event_id % 3 = 0 GROUP BY ALL HAVING count(*) = 1) SELECT r.event_id, p.k IS NOT NULL AS backed FROM r LEFT JOIN pairs p USING (event_type, user_id, k, day, big) WHERE r.event_id % 2 = 0")
def reviewed_pairs(spark, sf):
    """Reviews by whether an agreeing pair of the same five-part identity backs them."""
    e = base.table(spark, sf, "events")
    r = e.select("event_id", "event_type", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.dayofyear("ts").alias("day"), (F.col("value") > 50).alias("big"))
    pairs = r.where("event_id % 3 = 0").groupBy(*IDENTITY).agg(F.count("*").alias("n")).where("n = 1").withColumn("backed", F.lit(True)).drop("n")
    return r.where("event_id % 2 = 0").join(pairs, list(IDENTITY), "left").select("event_id", F.coalesce("backed", F.lit(False)).alias("backed"))


CODED = "array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9._~-]$') THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END), '')"


@query(f"SELECT doc_id, CASE WHEN t = '' THEN t ELSE {CODED} END AS coded FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def percent_encoding(spark, sf):
    """Every whole text as one component of an address."""
    return base.documents(spark, sf).select("doc_id", T.encode_component(F.col("text")).alias("coded"))


@query(r"SELECT event_id, regexp_matches(d, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS dated, regexp_matches(event_type, '^[a-z0-9_:]{1,128}$') AS rule_like, regexp_matches(d, '^[a-z]{1,32}$') AS category_like FROM (SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y/%m/%d') WHEN 2 THEN event_type ELSE '2024-1-1' END AS d FROM events)")
def shapes_of_selectors(spark, sf):
    """Shapes of dates, rules and categories."""
    i = F.col("event_id") % 4
    e = base.table(spark, sf, "events").withColumn("d", F.when(i == 0, F.date_format("ts", "yyyy-MM-dd")).when(i == 1, F.date_format("ts", "yyyy/MM/dd")).when(i == 2, F.col("event_type")).otherwise("2024-1-1"))
    return e.select("event_id", T.iso_date(F.col("d")).alias("dated"), T.valid_rule(F.col("event_type")).alias("rule_like"), T.valid_category(F.col("d")).alias("category_like"))


@query("WITH s AS (SELECT event_type, count(*) FILTER (WHERE value > 195) AS bad, bool_and(value IS NOT NULL) AS whole, count(*) FILTER (WHERE value > 100) AS outcomes FROM events GROUP BY event_type, user_id % 9) SELECT event_type, CASE WHEN bad > 2 OR outcomes = 0 THEN 'failed' WHEN whole THEN 'complete' ELSE 'incomplete' END AS status, count(*) AS n FROM s GROUP BY 1, 2")
def status_of_runs(spark, sf):
    """Runs by their status: failed, complete or incomplete."""
    runs = base.table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 9).alias("run")).agg(F.count_if(F.col("value") > 195).alias("bad"), F.bool_and(F.col("value").isNotNull()).alias("whole"), F.count_if(F.col("value") > 100).alias("outcomes"))
    return runs.withColumn("status", pol.status(F.col("bad") > 2, F.col("whole"), F.col("outcomes"))).groupBy("event_type", "status").agg(F.count("*").alias("n"))


@query("SELECT level, CASE WHEN level IN ('error', 'failure-note', 'error: internal compiler error') THEN 'error' WHEN level = 'warning' THEN 'warning' WHEN level IN ('note', 'help') THEN 'info' ELSE 'unknown' END AS severity, count(*) AS n FROM (SELECT CASE event_id % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'failure-note' WHEN 2 THEN 'warning' WHEN 3 THEN 'note' WHEN 4 THEN 'help' ELSE event_type END AS level FROM events) GROUP BY level")
def severity_of_levels(spark, sf):
    from ..sources import messages

    levels = F.element_at(F.array(*map(F.lit, ("error", "failure-note", "warning", "note", "help")), F.col("event_type")), (F.col("event_id") % 6 + 1).cast("int"))
    rows = base.table(spark, sf, "events").select(levels.alias("level"))
    return rows.groupBy("level").agg(F.count("*").alias("n")).select("level", messages.severity(F.col("level")).alias("severity"), "n")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'tests' WHEN p_size % 4 = 1 THEN 'benches' WHEN p_size % 4 = 2 THEN 'build_script' END AS context FROM part")
def context_of_kinds(spark, sf):
    """The context of a part's kinds: the first that has one; libraries have none."""
    from ..sources import messages

    size = F.col("p_size") % 4
    kinds = F.when(size == 0, F.array(F.lit("lib"), F.lit("test"), F.lit("bench"))).when(size == 1, F.array(F.lit("bench"))).when(size == 2, F.array(F.lit("bin"), F.lit("custom-build"))).otherwise(F.array(F.lit("lib"), F.lit("bin")))
    return base.table(spark, sf, "part").select("p_partkey", messages.context_of_kinds(kinds).alias("context"))
