"""Queries of structure: canonical forms of texts, element trees of pages, names resolved in scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aliases as al
from ..operators import canonical as ca
from ..operators import nesting, trees
from ..operators import similarity as sim
from ..operators.graph import settle
from . import base
from .registry import query

FORMS = r"""t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, source, CASE WHEN (length(text) - length(replace(text, '"', ''))) % 2 = 0 THEN regexp_extract_all(text, '"[^"]*"|[\p{L}_][\p{L}\p{N}_]*|[0-9]+(?:\.[0-9]+)?|[^\x09-\x0D\x20]') END AS l FROM t),
e AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM l),
o AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS k FROM e WHERE regexp_matches(t, '^[\p{L}_]') AND t NOT IN ('true', 'false') GROUP BY doc_id, t),
w AS (SELECT e.doc_id, string_agg(CASE WHEN o.k IS NOT NULL THEN '$' || o.k WHEN e.t[1] = '"' THEN '#str' WHEN regexp_matches(e.t, '^[0-9]+\.') THEN '#float' WHEN regexp_matches(e.t, '^[0-9]') THEN '#int' WHEN e.t IN ('true', 'false') THEN '#bool' ELSE e.t END, ' ' ORDER BY e.i) AS form,
  count(*) AS nodes, count(*) FILTER (WHERE e.t IN ('.', ';')) + CASE WHEN arg_max(e.t, e.i) IN ('.', ';') THEN 0 ELSE 1 END AS statements FROM e LEFT JOIN o ON o.doc_id = e.doc_id AND o.t = e.t GROUP BY e.doc_id),
forms AS (SELECT l.doc_id, l.source, CASE WHEN l.l IS NOT NULL THEN coalesce(w.form, '') END AS form, CASE WHEN l.l IS NOT NULL THEN coalesce(w.nodes, 0) END AS nodes, CASE WHEN l.l IS NOT NULL THEN coalesce(w.statements, 0) END AS statements FROM l LEFT JOIN w USING (doc_id))"""


def _forms(spark, sf):
    return ca.canonical(base.documents(spark, sf).select("doc_id", "source", "text"), digest=True)


@query(f"WITH {FORMS} SELECT doc_id, sha256(form) AS digest, CAST(nodes AS BIGINT) AS nodes, CAST(statements AS BIGINT) AS statements FROM forms")
def canonical_form(spark, sf):
    """Each text's form by its digest; null where a quote stays open."""
    return _forms(spark, sf).select("doc_id", "digest", F.col("nodes").cast("bigint").alias("nodes"), F.col("statements").cast("bigint").alias("statements"))


@query(f"WITH {FORMS}, big AS (SELECT * FROM forms WHERE nodes >= 30 AND statements >= 3) SELECT sha256(form) AS digest, count(*) AS members, count(DISTINCT source) AS sources, min(doc_id) AS anchor FROM big GROUP BY form HAVING count(*) > 1")
def canonical_families(spark, sf):
    """Texts above the floor that are equal but for their names and values."""
    big = ca.admitted(_forms(spark, sf)).select("doc_id", "source", "digest")
    per = big.groupBy("digest", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))  # a hot form is summed in parts
    return per.groupBy("digest").agg(F.sum("n").alias("members"), F.count("*").alias("sources"), F.min("first").alias("anchor")).where("members > 1")


_NAMES = ", ".join(f"'{t}'" for t in trees.ENDLESS)
#: Tags in order, and those of pages that can be read. A parent is the last tag before that opens one level up.
NODES = rf"""p AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|</?[a-z][^<>]*>') AS l FROM pages),
n AS (SELECT page_id, lower(regexp_extract(unnest(l), '^<(/?[a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, generate_subscripts(l, 1) - 1 AS pos FROM p),
tags AS (SELECT page_id, pos, ltrim(name, '/') AS tag, CASE WHEN ltrim(name, '/') IN ({_NAMES}) THEN 0 WHEN name[1] = '/' THEN -1 ELSE 1 END AS mark FROM n WHERE name <> '' AND NOT (name[1] = '/' AND ltrim(name, '/') IN ({_NAMES}))),
leveled AS (SELECT *, sum(mark) OVER (PARTITION BY page_id ORDER BY pos) - CASE WHEN mark > 0 THEN 1 ELSE 0 END AS level FROM tags),
sound AS (SELECT page_id FROM leveled GROUP BY page_id HAVING sum(mark) = 0 AND min(level) >= 0 AND max(level) < 64),
good AS (SELECT * FROM leveled SEMI JOIN sound USING (page_id)),
nodes AS (SELECT g.page_id, g.pos AS node, (SELECT max(h.pos) FROM good h WHERE h.page_id = g.page_id AND h.pos < g.pos AND h.mark = 1 AND h.level = g.level - 1) AS parent, g.level AS depth, g.tag FROM good g WHERE g.mark >= 0)"""


def _pages(spark, sf):
    return base.table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))


@query(f"WITH {NODES} SELECT page_id, CAST(node AS BIGINT) AS node, CAST(parent AS BIGINT) AS parent, CAST(depth AS BIGINT) AS depth, tag FROM nodes")
def page_nodes(spark, sf):
    n = trees.page_nodes(_pages(spark, sf))
    return n.select("page_id", F.col("node").cast("bigint").alias("node"), F.col("parent").cast("bigint").alias("parent"), "depth", "tag")


# A subtree is the run of nodes behind its own until one that is no deeper; two are equal if tags and depths from there are.
SUBTREES = f"""{NODES},
spans AS (SELECT a.page_id, a.node, (SELECT coalesce(min(b.node), 1000000000) FROM nodes b WHERE b.page_id = a.page_id AND b.node > a.node AND b.depth <= a.depth) AS stop, a.depth FROM nodes a),
shapes AS (SELECT s.page_id, s.node, string_agg(n.depth - s.depth || n.tag, ' ' ORDER BY n.node) AS shape FROM spans s JOIN nodes n ON n.page_id = s.page_id AND n.node >= s.node AND n.node < s.stop GROUP BY s.page_id, s.node),
bags AS (SELECT page_id, shape, count(*) AS cnt FROM shapes GROUP BY page_id, shape),
sizes AS (SELECT page_id, sum(cnt) AS n FROM bags GROUP BY page_id HAVING sum(cnt) >= 30)"""


def _bags(spark, sf):
    return trees.bags(trees.subtree_hashes(trees.page_nodes(_pages(spark, sf)), "page_id"), "page_id", ca.LEAST_NODES)


@query(f"WITH {SUBTREES} SELECT page_id, CAST(any_value(n) AS BIGINT) AS nodes, count(*) AS shapes, CAST(max(cnt) AS BIGINT) AS most FROM bags JOIN sizes USING (page_id) GROUP BY page_id")
def subtree_bags(spark, sf):
    """Pages of 30 nodes and more: how many different subtrees they have, and how often the most common one stands there."""
    return _bags(spark, sf).groupBy(F.col("doc_id").alias("page_id")).agg(F.sum("cnt").alias("nodes"), F.count("*").alias("shapes"), F.max("cnt").alias("most"))


@query(f"""WITH {SUBTREES}, own AS (SELECT b.*, n FROM bags b JOIN sizes USING (page_id)),
  scored AS (SELECT q.page_id AS q, o.page_id AS o, CAST(2 * sum(least(q.cnt, o.cnt)) * 10000 // (any_value(q.n) + any_value(o.n)) AS BIGINT) AS score FROM own q JOIN own o ON o.shape = q.shape AND o.page_id <> q.page_id WHERE q.page_id % 100 = 0 GROUP BY q.page_id, o.page_id)
  SELECT q, o, score FROM scored WHERE score >= 8000""")
def template_neighbours(spark, sf):
    """For the pages whose id 100 divides, all pages of which four fifths of the subtrees are the same."""
    bags = settle(_bags(spark, sf))
    return sim.near_of(bags, bags.where("doc_id % 100 = 0"))


#: What elements do in the measure of a page: links, buttons and forms are decisions, lists and tables repeat, their rows are paths.
KINDS = {"a": "branch", "button": "branch", "form": "branch", "article": "branch", "section": "branch", "ul": "loop", "ol": "loop", "table": "loop", "nav": "choice", "select": "choice", "li": "arm", "option": "arm", "tr": "arm", "div": "closure", "aside": "closure", "br": "jump", "input": "try", "b": "logic", "i": "logic"}
_KIND = "CASE tag " + " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in KINDS.items()) + " ELSE 'none' END"


@query(f"""WITH {NODES}, k AS (SELECT *, {_KIND} AS kind FROM nodes),
  h AS (SELECT c.*, coalesce(p.kind = 'branch' AND c.kind = 'branch', false) AS chained, coalesce(p.tag = c.tag, false) AS same FROM k c LEFT JOIN k p ON p.page_id = c.page_id AND p.node = c.parent),
  d AS (SELECT h.*, g.mark > 0 AND (h.kind IN ('loop', 'choice', 'closure') OR h.kind = 'branch' AND NOT h.chained) AS deepens, (SELECT coalesce(min(b.node), 1000000000) FROM nodes b WHERE b.page_id = h.page_id AND b.node > h.node AND b.depth <= h.depth) AS stop FROM h JOIN good g ON g.page_id = h.page_id AND g.pos = h.node),
  m AS (SELECT x.*, (SELECT count(*) FROM d a WHERE a.page_id = x.page_id AND a.deepens AND a.node < x.node AND x.node < a.stop) AS nesting FROM d x),
  s AS (SELECT page_id, 1 + count(*) FILTER (WHERE kind IN ('branch', 'loop', 'arm', 'try', 'logic')) AS cyclomatic,
    CAST(sum(CASE WHEN kind IN ('branch', 'loop', 'choice') THEN 1 + CASE WHEN chained THEN 0 ELSE nesting END WHEN kind = 'jump' THEN 1 WHEN kind = 'logic' AND NOT same THEN 1 ELSE 0 END) AS BIGINT) AS cognitive FROM m GROUP BY page_id)
  SELECT page_id, cyclomatic, cognitive, cyclomatic >= 20 OR cognitive >= 25 AS complex_function FROM s""")
def page_complexity(spark, sf):
    """Both measures of every page that can be read."""
    pages = _pages(spark, sf)
    marks = nesting.levels(trees.tag_marks(pages, "page_id", "html"), "page_id", nesting.parts_of(pages, "html"))
    good = nesting.sound(marks, "page_id").drop("level")
    found = trees.complexity(good, "page_id", KINDS)
    return found.select("page_id", F.col("cyclomatic").cast("bigint").alias("cyclomatic"), F.col("cognitive").cast("bigint").alias("cognitive"), "complex_function")


# Sentences and lines as a little source: by its number of words one opens or closes a scope, binds a name, declares one, takes in all names, or calls.
BOUND = ("reqwest", "reqwest::Client", "reqwest::blocking", "std::process::Command", "std::process", "rq::Client", "crate::x")
REST = ("Client::builder", "builder", "Command::new", "new")
METHODS = ("danger_accept_invalid_certs", "tls_danger_accept_invalid_hostnames", "arg", "arg")
GIVEN = ("true", "false", 'format!("x {v}")', '"a" + b', '"a"', 'format!("{{}}")')
SHELL = ("bash", "fish", "sh", "zsh")
_list = lambda items: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"
LINES = rf"""raw AS (SELECT doc_id AS unit, unnest(string_split_regex(coalesce(text, ''), '[.\n]')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '[.\n]'), 1) - 1 AS pos FROM documents),
cut AS (SELECT unit, pos, list_filter(string_split(line, ' '), lambda x: x <> '') AS w, length(line) AS n FROM raw),
src AS (SELECT unit, pos, n, lower(w[1][1:1]) AS name, len(w) % 8 AS role FROM cut WHERE len(w) > 0),
marks AS (SELECT unit, pos, CASE WHEN role = 2 THEN -1 WHEN role IN (0, 1) THEN 1 ELSE 0 END AS mark, role = 1 AS module FROM src),
sums AS (SELECT *, sum(mark) OVER (PARTITION BY unit ORDER BY pos) AS after FROM marks),
scopes AS (SELECT unit, pos AS start, (SELECT min(b.pos) FROM sums b WHERE b.unit = a.unit AND b.pos > a.pos AND b.after < a.after) AS stop, module FROM sums a WHERE mark = 1
  UNION ALL SELECT DISTINCT unit, -1, NULL, true FROM marks),
bindings AS (SELECT unit, pos, CASE WHEN role = 5 AND n % 5 = 0 THEN '*' ELSE name END AS key, CASE WHEN role = 3 OR role = 5 AND n % 5 > 0 THEN {_list(BOUND)}[n % 7 + 1] END AS path FROM src WHERE role IN (3, 4, 5)),
uses AS (SELECT unit, pos, name, {_list(REST)}[n % 4 + 1] AS rest, {_list(METHODS)}[n // 4 % 4 + 1] AS method, {_list(GIVEN)}[n % 6 + 1] AS argument, {_list(SHELL)}[n // 2 % 4 + 1] AS shell, CASE WHEN n % 7 > 0 THEN '-c' ELSE '-l' END AS flag, unit % 10 = 0 AS test FROM src WHERE role >= 6),
inner_of AS (SELECT r.unit, r.pos, max(s.start) AS start, max(s.start) FILTER (WHERE s.module) AS inside FROM (SELECT unit, pos FROM bindings UNION ALL SELECT unit, pos FROM uses) r JOIN scopes s ON s.unit = r.unit AND s.start < r.pos AND (s.stop IS NULL OR r.pos < s.stop) GROUP BY r.unit, r.pos),
bound AS (SELECT b.unit, i.start, i.inside, b.key, arg_max(struct_pack(p := b.path), b.pos).p AS path FROM bindings b JOIN inner_of i USING (unit, pos) GROUP BY b.unit, i.start, i.inside, b.key),
met AS (SELECT u.unit, u.pos, arg_max(struct_pack(k := b.key, p := b.path), b.start * 2 + CASE WHEN b.key = '*' THEN 0 ELSE 1 END) AS b FROM uses u JOIN inner_of i USING (unit, pos) JOIN bound b ON b.unit = u.unit AND b.inside = i.inside AND b.key IN (u.name, '*')
  JOIN scopes s ON s.unit = b.unit AND s.start = b.start AND s.start < u.pos AND (s.stop IS NULL OR u.pos < s.stop) GROUP BY u.unit, u.pos),
resolved AS (SELECT u.*, CASE WHEN m.b IS NULL THEN 'unbound' WHEN m.b.k <> '*' AND m.b.p IS NOT NULL THEN 'item' ELSE 'indeterminate' END AS verdict, m.b.p AS bound_path FROM uses u LEFT JOIN met m USING (unit, pos))"""


def _source(spark, sf):
    """(marks, bindings, uses) of the documents' sentences and lines, and over how many parts to deal them; uses have n, from which what is called follows."""
    w = F.filter(F.split("line", " "), lambda x: x != "")
    docs = base.documents(spark, sf)
    lines = docs.select(F.col("doc_id").alias("unit"), F.posexplode(F.split("text", "[.\n]")).alias("pos", "line"))
    src = lines.select("unit", "pos", F.length("line").alias("n"), w.alias("w")).where(F.size("w") > 0)
    # Texts are split once; what is left of them are narrow rows.
    src = settle(src.select("unit", "pos", "n", F.lower(F.substring(F.get("w", F.lit(0)), 1, 1)).alias("name"), (F.size("w") % 8).alias("role")))
    role, n = F.col("role"), F.col("n")
    marks = src.select("unit", "pos", F.when(role == 2, -1).when(role.isin(0, 1), 1).otherwise(0).alias("mark"), (role == 1).alias("module"))
    every = (role == 5) & (n % 5 == 0)
    bindings = src.where(role.isin(3, 4, 5)).select("unit", "pos", F.when(~every, F.col("name")).alias("name"), F.when((role == 3) | ((role == 5) & ~every), _pick(BOUND, n % 7)).alias("path"))
    return marks, bindings, src.where(role >= 6).select("unit", "pos", "name", "n"), nesting.parts_of(docs, "text")


def _pick(items, k):
    return F.element_at(F.array(*map(F.lit, items)), (k + 1).cast("int"))


def _resolved(spark, sf):
    """Resolved uses, and over how many parts they are dealt."""
    marks, bindings, uses, parts = _source(spark, sf)
    return al.resolve(al.scopes(marks, parts), bindings, uses, marks, parts=parts), parts


@query(f"WITH {LINES} SELECT unit, CAST(pos AS BIGINT) AS pos, name, verdict, CASE WHEN verdict = 'item' THEN bound_path END AS path FROM resolved")
def alias_resolution(spark, sf):
    """What each called name stands for, by the imports of the scopes around it."""
    return _resolved(spark, sf)[0].select("unit", F.col("pos").cast("bigint").alias("pos"), "name", "verdict", "path")


@query(rf"""WITH {LINES}, c AS (SELECT *, CASE verdict WHEN 'item' THEN bound_path || '::' || rest WHEN 'unbound' THEN name || '::' || rest END AS written FROM resolved),
  w AS (SELECT *, split_part(written, '::', 1) AS root, written[length(split_part(written, '::', 1)) + 3:] AS item FROM c),
  k AS (SELECT *, CASE WHEN root IN ('std', 'core', 'alloc') THEN root WHEN unit % 2 = 0 AND root = 'reqwest' OR unit % 2 = 1 AND root = 'rq' THEN 'reqwest' END AS crate FROM w),
  d AS (SELECT unit, pos, CASE
    WHEN crate = 'reqwest' AND item IN ('Client::builder', 'blocking::Client::builder') AND argument = 'true' AND NOT test AND method LIKE '%certs' THEN 'certificates'
    WHEN crate = 'reqwest' AND item IN ('Client::builder', 'blocking::Client::builder') AND argument = 'true' AND NOT test AND method LIKE '%hostnames' THEN 'host names'
    WHEN crate = 'std' AND item = 'process::Command::new' AND method = 'arg' AND flag = '-c' AND shell <> 'fish' AND argument IN ('format!("x {{v}}")', '"a" + b') THEN 'interpolated command' END AS message FROM k)
  SELECT unit, CAST(pos AS BIGINT) AS pos, CASE WHEN message = 'interpolated command' THEN 'dynamic_shell' ELSE 'disabled_tls_verification' END AS rule, message FROM d WHERE message IS NOT NULL""")
def source_detections(spark, sf):
    """Clients that don't verify, and shells that are given values, under whatever name they were imported."""
    docs = base.table(spark, sf, "documents").select(F.col("doc_id").alias("unit"))
    crates = docs.select("unit", F.when(F.col("unit") % 2 == 0, "reqwest").otherwise("rq").alias("alias"), F.lit("reqwest").alias("crate"))
    n = F.col("n")
    written = {"rest": _pick(REST, n % 4), "method": _pick(METHODS, F.floor(n / 4) % 4), "argument": _pick(GIVEN, n % 6), "shell": _pick(SHELL, F.floor(n / 2) % 4), "flag": F.when(n % 7 > 0, "-c").otherwise("-l"), "test": F.col("unit") % 10 == 0}
    resolved, parts = _resolved(spark, sf)
    found = al.detect(al.called(resolved.withColumns(written), crates, parts))
    return found.select("unit", F.col("pos").cast("bigint").alias("pos"), "rule", "message")
