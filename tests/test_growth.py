"""Steps that have to grow with the input: what they send, how often they read, over how many parts they deal."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import aliases, canonical, nesting, trees
from tallyforge.operators import similarity as sim
from tallyforge.plans import registry, structure

COPIES = 300


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """A group of near copies larger than a chunk, and texts with words of their own."""
    r = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(COPIES):
        words = list(base)
        for _ in range(r.randrange(4)):
            words[r.randrange(60)] = f"x{r.randrange(5)}"
        rows.append((k, " ".join(words)))
    rows += [(COPIES + k, " ".join(f"u{k}.{j}" for j in range(30))) for k in range(20)] + [(COPIES + 20, ""), (COPIES + 21, None), (COPIES + 22, "w w w w w w w w"), (COPIES + 23, "w w w w w w w w w")]
    folder = str(tmp_path_factory.mktemp("copies"))
    spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("s").alias("source"), F.lit("en").alias("lang")).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return folder, con


def same(spark, copies, name):
    folder, con = copies
    df = registry.QUERIES[name](spark, folder)
    cursor = con.execute(registry.ORACLE[name])
    names = [d[0] for d in cursor.description]
    got = sorted(tuple(map(str, (r[c] for c in names))) for r in df.collect())
    assert got == sorted(tuple(map(str, r)) for r in cursor.fetchall())
    return got


def test_near_clone_pairs_of_a_large_group(spark, copies):
    """Pairs are compared within blocks of documents; no row is made for a pair and a token."""
    assert len(same(spark, copies, "near_clone_pairs")) > sim.CHUNK * 50
    docs = spark.createDataFrame([(k, f"a b c {k}") for k in range(4)], "doc_id bigint, text string")
    assert "FlatMapGroupsInArrow" in plan(sim.pairs(docs))
    assert "Exchange" not in plan(sim.tokens(docs))


def test_nomination_recall_of_a_large_group(spark, copies):
    assert same(spark, copies, "nomination_recall")
    docs = spark.createDataFrame([(0, "a b c d e f"), (1, "a b c d e g")], "doc_id bigint, text string")
    found = sim.candidates(docs)
    assert "FlatMapGroupsInArrow" in plan(sim.near_rows(found, found.where("doc_id = 0")))


def test_near_clone_families_of_a_large_group(spark, copies):
    """Candidates are those of which two thirds occur elsewhere: texts of words of their own go no further."""
    got = same(spark, copies, "near_clone_families")
    assert max(int(row[1]) for row in got) == len(spark.read.parquet(f"{copies[0]}/documents.parquet").where(f"doc_id < {COPIES}").select("text").distinct().collect())
    docs = spark.createDataFrame([(0, "a b c d e f"), (1, "a b c d e g"), (2, "a b c x y z")], "doc_id bigint, text string")
    assert {r.doc_id for r in sim.candidates(docs).collect()} == {0, 1}


def test_rare_tokens_are_dealt_once(spark, copies):
    assert same(spark, copies, "rare_tokens_topk")
    docs = spark.createDataFrame([(0, "a b c d"), (1, "a b c e")], "doc_id bigint, text string")
    assert plan(sim.heads(docs)).count("hashpartitioning(token") == 1


def test_nodes_of_pages_are_dealt_by_length(spark, monkeypatch):
    pages = spark.createDataFrame([(k, "<div><ul><li></ul></div>" * 10) for k in range(20)], "page_id bigint, html string")
    monkeypatch.setattr(nesting, "CHARS", 100)
    nodes = trees.page_nodes(pages)
    assert "hashpartitioning(page_id" in plan(nodes) and ", 49)" in plan(nodes)
    assert plan(nodes).count("Generate posexplode") == 1  # tags are taken from a page once
    assert nodes.count() == 20 * 30


def test_complexity_reads_pages_once(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "<div><a></a></div>"), (2, "<div>")], "page_id bigint, html string")
    monkeypatch.setattr(nesting, "CHARS", 1)
    marks = nesting.sound(nesting.levels(trees.tag_marks(pages, "page_id", "html"), "page_id", nesting.parts_of(pages, "html")), "page_id").drop("level")
    found = trees.complexity(marks, "page_id", {"div": "closure", "a": "branch"})
    assert plan(found).count("Generate posexplode") == 1 and ", 24)" in plan(found)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 2, False)]


def test_scopes_are_dealt_by_length(spark):
    marks = spark.createDataFrame([(u, p, m, True) for u in range(3) for p, m in enumerate((1, 1, -1, -1))], "unit bigint, pos int, mark int, module boolean")
    found = aliases.scopes(marks, 37)
    assert ", 37)" in plan(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, aliases.scopes(marks).collect()))


def test_uses_stay_narrow(spark):
    _, _, uses, parts = structure._source(spark, "/root/testdata/sf0.001")
    assert uses.columns == ["unit", "pos", "name", "n"] and parts >= 1


def test_patterns_of_credentials_wait_for_their_prefix(spark):
    rows = spark.createDataFrame([("key AKIA" + "Q7" * 8,), ("plain sentence",), ("-----BEGIN x",), (None,)], "line string")
    assert [r[0] for r in rows.select(T.may_hold_credential(F.col("line"))).collect()] == [True, False, True, None]
    assert [r[0] for r in rows.select(T.credential(F.col("line"))).collect()] == ["aws_access_key", None, None, None]


def test_canonical_form_relabels_without_sorting(spark):
    docs = spark.createDataFrame([(1, 'b = "x\ny" + a ; 1.5 2 true b'), (2, '"'), (3, None), (4, " "), (5, "é² ² ß_1 _")], "doc_id bigint, text string")
    forms = canonical.canonical(docs)
    assert "array_sort" not in plan(forms)
    assert [(r.form, r.nodes, r.statements) for r in forms.orderBy("doc_id").collect()] == [("$0 = #str + $1 ; #float #int #bool $0", 10, 2), (None, None, None), (None, None, None), ("", 0, 0), ("$0 ² $1 $2", 4, 1)]


def test_canonical_families_over_relabelled_forms(spark):
    docs = spark.createDataFrame([(k, f"n{k} is here . " * 10 + f"{k} ;") for k in range(3)], "doc_id bigint, text string")
    big = canonical.admitted(canonical.canonical(docs))
    assert "MapInArrow" in plan(big) and big.select("form").distinct().count() == 1 and big.count() == 3


@pytest.mark.parametrize("remembered", [200_000, 3])
def test_forms_without_a_step_for_each_name(monkeypatch, remembered):
    """Names known from earlier texts take no call of their own, and what is remembered changes no form."""
    monkeypatch.setattr(canonical, "REMEMBERED", remembered)
    monkeypatch.setattr(canonical, "ORDINALS", canonical.ORDINALS[:40])
    r, asked = random.Random(2), []

    class Names(canonical._Names):
        def __missing__(self, t):
            asked.append(t)
            return super().__missing__(t)

    names, kinds = Names(), {"true": "#bool", "false": "#bool", '""': "#str", "1": "#int", "1.5": "#float", ".": ".", "²": "²"}
    for _ in range(60):
        listed = [r.choice([f"n{r.randrange(90)}", "_", "x" * 70, *kinds]) for _ in range(r.choice((0, 1, 30, 300)))]
        own = list(dict.fromkeys(t for t in listed if t not in kinds))
        assert canonical._form(listed, names) == " ".join(kinds.get(t) or f"${own.index(t)}" for t in listed)
    assert remembered == 3 or len(asked) < 200


def test_digests_stay_where_forms_are_made(spark):
    docs = spark.createDataFrame([(1, 'b = "x" + é ; 1.5'), (2, '"'), (3, "")], "doc_id bigint, text string")
    both = canonical.canonical(docs).select("doc_id", F.sha2("form", 256).alias("digest"), "nodes", "statements")
    assert canonical.canonical(docs, digest=True).collect() == both.collect()
    assert "sha2" not in plan(structure.canonical_families(spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("shared", [True, False])
def test_tokens_are_sent_packed(spark, monkeypatch, shared):
    """Many small batches and parts give the multisets that plain rows give, and heads by (df, text) over them."""
    r = random.Random(5)
    rows = [(k * 7 - 40, " ".join(r.choice("abcdé") for _ in range(r.choice((0, 2, 3, 9, 40))))) for k in range(40)] + [(999, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(sim, "TEXTS", 60)
    monkeypatch.setattr(sim, "COUNTED", 90)
    found = sim.marked(docs, shared)
    assert "FlatMapCoGroupsInArrow" in plan(found) and "Window" not in plan(found)
    bags = {d: Counter(zip(w, w[1:], w[2:])) for d, t in rows if len(w := (t or "").split()) > 2}
    df, held = sum(bags.values(), Counter()), Counter(t for b in bags.values() for t in b)
    want = {}
    for d, bag in bags.items():
        order, heads, before = sorted((df[t], " ".join(t)) for t in bag if held[t] > 1 or not shared), [], 0
        for _, text in order:
            if before < sim.HEAD:
                heads.append(text)
            before += bag[tuple(text.split())]
        if order:
            want[d] = sum(bag.values()), sorted((df[t], bag[t]) for t in bag if held[t] > 1 or not shared), heads
    got = {x.doc_id: (x.n, sorted((b.df, b.cnt) for b in x.bag), [h.text for h in x.heads]) for x in found.collect()}
    assert got == want
    token = {h.token: h.text for x in found.collect() for h in x.heads}
    assert len(set(token.values())) == len(token)


def test_joins_of_names_are_dealt_by_length(spark):
    """No join of scopes, bindings, uses and crates is left to the number of shuffle partitions."""
    marks = spark.createDataFrame([(u, p, m, True) for u in range(3) for p, m in enumerate((1, 0, 0, -1))], "unit bigint, pos int, mark int, module boolean")
    bindings = spark.createDataFrame([(u, 1, "a", "std::process") for u in range(2)], "unit bigint, pos int, name string, path string")
    uses = spark.createDataFrame([(u, 2, "a") for u in range(3)], "unit bigint, pos int, name string")
    crates = spark.createDataFrame([(0, "x", "y")], "unit bigint, alias string, crate string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = aliases.called(aliases.resolve(aliases.scopes(marks, 37), bindings, uses, marks, parts=37).withColumn("rest", F.lit("z")), crates, 37)
        asked = re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", plan(found))
        # Only the distinct units are gathered first, before they are dealt.
        assert asked.count("37") >= len(asked) - 2 and set(asked) <= {"37", spark.conf.get("spark.sql.shuffle.partitions")}
        assert sorted((r.unit, r.verdict, r.crate) for r in found.collect()) == [(0, "item", "std"), (1, "item", "std"), (2, "unbound", None)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_families_need_no_list_of_all_pairs(spark, copies):
    """Blocks give spanning trees with their least pair: as many pairs as documents, the same families."""
    docs = spark.read.parquet(f"{copies[0]}/documents.parquet").withColumn("text", F.coalesce("text", F.lit("")))
    kept = sim.distinct_texts(docs)
    every, few = (sim.settle(sim.pairs(docs, kept=kept, forest=forest)) for forest in (False, True))
    n = kept.count()
    assert few.count() < n * (n // sim.CHUNK + 2) < every.count() / 4
    assert sorted(map(tuple, sim.near_families(few).collect())) == sorted(map(tuple, sim.near_families(every).collect()))
    assert few.exceptAll(every).isEmpty()


def test_bags_are_not_ordered(spark, tmp_path):
    """Only keys are ordered and dealt; bags are sent to their chunk, and packed from there."""
    bag = "array<struct<df:bigint,cnt:int,token:bigint>>"
    found = spark.createDataFrame([(k, 2, [(2, 1, 5), (2, 1, 6)], [5, 6]) for k in range(300)], f"doc_id bigint, n bigint, bag {bag}, keys array<bigint>")
    pairs = sim.compared(found, found.select("doc_id", "keys"))
    assert "rangepartitioning" not in plan(pairs) and "FlatMapCoGroupsInArrow" in plan(pairs)
    assert pairs.count() == 300 * 299 // 2
    assert sim.dealt(found.select("doc_id", "keys")).columns == ["doc_id", "keys", "chunk"]


def test_copies_of_texts_are_told_by_ids(spark):
    """Only ids are chosen among copies; texts are dealt once, all of them, and those of other ids count nothing."""
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "a b c e"), (4, "x y z"), (5, "x y z"), (6, None)], "doc_id bigint, text string")
    kept = sim.distinct_texts(docs)
    assert "text" not in kept.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id != 6) == [1, 3, 4]
    assert sorted((r.doc_id, r.token) for r in sim.heads(docs, kept=kept).collect()) == [(1, "a b c"), (3, "a b c")]


def test_nomination_recall_compares_asked_documents_alone(spark):
    docs = spark.createDataFrame([(k, "a b c d e f g h") for k in range(4)], "doc_id bigint, text string")
    found = sim.settle(sim.candidates(docs))
    asked = found.where("doc_id = 0").select("doc_id")
    assert sorted(map(tuple, sim.nominated_of(found, asked).collect())) == [(0, k, 10000) for k in (1, 2, 3)]


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Texts with more bindings than the 1,024 that the surveyed engine keeps, and (unit, pos, name, n, verdict, path) of their uses by a walk."""
    r = random.Random(5)
    rows, found = [], []
    for unit in range(1, 6):
        lines, stack, known = [], [(-1, True)], {}
        for pos in range(2600):
            words = r.choice([1, 8, 2, 2, 3, 3, 3, 4, 5, 5, 6, 7])
            name, longest = r.choice("abcdefgh"), r.choice([2, 9, 13])
            line = " ".join([name, *("v" * r.randint(1, longest) for _ in range(words - 1))])
            n = len(line)
            lines.append(line)
            if words in (1, 8):
                stack.append((pos, words == 1))
            elif words == 2 and len(stack) > 1:
                stack.pop()
            elif words in (3, 4, 5):
                every = words == 5 and n % 5 == 0
                known[stack[-1][0], None if every else name] = None if every or words == 4 else structure.BOUND[n % 7]
            elif words in (6, 7):
                found.append([unit, pos, name, n, list(stack)])
        # What is bound behind a use counts too: names are looked up when all are known.
        for use in found:
            if use[0] == unit:
                verdict = ("unbound", None)
                for start, module in reversed(use.pop()):
                    if (start, use[2]) in known:
                        verdict = ("item", known[start, use[2]]) if known[start, use[2]] else ("indeterminate", None)
                        break
                    if (start, None) in known:
                        verdict = ("indeterminate", None)
                        break
                    if module:
                        break
                use += verdict
        assert sum(len(x.split()) in (3, 4, 5) for x in lines) > 1024
        rows.append((unit, "\n".join(lines)))
    folder = str(tmp_path_factory.mktemp("crowded"))
    spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("s").alias("source"), F.lit("en").alias("lang")).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return (folder, con), found


def test_all_bindings_of_a_unit_count(spark, crowded):
    tables, found = crowded
    got = same(spark, tables, "alias_resolution")
    assert got == sorted(tuple(map(str, (unit, pos, name, verdict, path))) for unit, pos, name, _, verdict, path in found)
    assert {row[3] for row in got} == {"item", "indeterminate", "unbound"}


def test_names_meet_their_scopes_in_order(spark):
    """Uses and bindings of a name are ordered together; no pairs of them are made, and rows are dealt by unit once."""
    marks = spark.createDataFrame([(1, 2 * p, 1 if p % 2 else -1, False) for p in range(1, 4001)], "unit bigint, pos int, mark int, module boolean")
    bindings = marks.where("mark = 1").select("unit", "pos", F.lit("a").alias("name"), F.concat(F.lit("p"), "pos").alias("path")).withColumn("pos", F.expr("pos + 1"))
    uses = bindings.select("unit", "pos", "name")
    found = aliases.resolve(aliases.scopes(marks, 3), bindings, uses, marks, parts=3)
    joins = re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[([^\]]*)\]", plan(found))
    assert joins and not any("key" in keys for keys in joins)
    assert found.where("verdict = 'item' and path = concat('p', pos - 1)").count() == 2000


def test_detections_in_units_of_many_bindings(spark, crowded):
    tables, found = crowded
    want = []
    for unit, pos, _, n, verdict, path in found:
        # Names are single letters and no crates, so that only items lead to one.
        root, _, item = f"{path}::{structure.REST[n % 4]}".partition("::") if verdict == "item" else ("", "", "")
        method, given, shell = structure.METHODS[n // 4 % 4], structure.GIVEN[n % 6], structure.SHELL[n // 2 % 4]
        crate = {"std": "std", ("reqwest", "rq")[unit % 2]: "reqwest"}.get(root)
        if crate == "reqwest" and item in ("Client::builder", "blocking::Client::builder") and given == "true" and unit % 10 and method != "arg":
            want.append((unit, pos, "disabled_tls_verification", "certificates" if method.endswith("certs") else "host names"))
        if crate == "std" and item == "process::Command::new" and method == "arg" and n % 7 and shell != "fish" and given in structure.GIVEN[2:4]:
            want.append((unit, pos, "dynamic_shell", "interpolated command"))
    assert {row[3] for row in want} == {"certificates", "host names", "interpolated command"}
    assert same(spark, tables, "source_detections") == sorted(tuple(map(str, row)) for row in want)
