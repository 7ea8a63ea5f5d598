"""Operators on small inputs with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import delta, graph, policy, report, score, stats
from tallyforge.operators.findings import merge
from tallyforge.sources import catalog, files, messages
from tallyforge.streaming import ingest

FINDING = "source string, rule string, category string, producer string, tier string, severity string, context string, occurrences bigint, noise_bp int"


def scored(spark, sites, lines=1000):
    """sites: (category, tier, number), each site a finding of a rule of its own."""
    rows = [("w", f"r{i}-{k}", c, "clippy", t, "warning", None, 1, None) for i, (c, t, n) in enumerate(sites) for k in range(n)]
    sizes = spark.createDataFrame([("w", lines, 1)], "source string, production_lines bigint, source_files bigint")
    found = score.densities(score.aggregate_rules(spark.createDataFrame(rows, FINDING), "source"), sizes, "source")
    return score.score(sizes, score.by_dimension(found, "source"), "source").first()


@pytest.mark.parametrize(
    ("sites", "want"),
    [
        ([("correctness", "P1", 3), ("correctness", "P2", 2), ("maintainability", "P3", 1)], (100, 50, 85, 100, 100, 65)),
        ([("reliability", "P3", 5), ("reliability", "P2", 1), ("correctness", "P2", 2), ("maintainability", "P3", 2)], (100, 67, 72, 100, 100, 88)),
        ([("performance", "P3", 9), ("performance", "P2", 1)], (100, 100, 100, 29, 100, 89)),
        ([], (100, 100, 100, 100, 100, 100)),
    ],
)
def test_scores(spark, sites, want):
    got = scored(spark, sites)
    assert (got.security, got.reliability, got.maintainability, got.performance, got.dependencies, got.score) == want


def test_scores_scale(spark):
    few, many = [("performance", "P3", 6)], [("performance", "P3", 60)]
    assert scored(spark, few, 4000).score == scored(spark, many, 40_000).score
    assert scored(spark, many, 4000).score <= scored(spark, few, 4000).score
    assert scored(spark, few, 0).score is None


def test_catalog():
    rules = catalog.rules()
    assert len(rules) == 62 and len({r[0] for r in rules}) == 62 and len(catalog._NOISE) == 24
    assert set(catalog._NOISE) <= {r[0] for r in rules}


def test_merge_keeps_what_all_agree_on(spark):
    rows = [("a", 1, "x", None), ("a", 2, "x", "t"), ("b", 1, None, "t"), ("b", 4, None, "t")]
    got = {r.id: r for r in merge(spark.createDataFrame(rows, "id string, occurrences bigint, package string, context string"), ["id"], "occurrences", ["package", "context"], []).collect()}
    assert (got["a"].occurrences, got["a"].package, got["a"].context) == (3, "x", None)
    assert (got["b"].occurrences, got["b"].package, got["b"].context) == (5, None, "t")


SIDE = "idx bigint, path string, origin string, code string, message string, fp string"


@pytest.mark.parametrize(
    ("before", "now", "want"),
    [
        ([("p", "f1")], [("p", "f1")], (0, 1, 0, 0)),
        ([("p", "f1"), ("p", "f1")], [("p", "f1"), ("p", "f1")], (0, 2, 0, 0)),
        ([("p", "f1")], [("q", "f1"), ("p", "f1")], (1, 1, 0, 0)),
        ([("p", "f1")], [("q", "f1")], (0, 1, 0, 1)),
        ([("p", "f1")], [("p", "f2")], (1, 0, 1, 0)),
        ([("p", None)], [("p", "f1")], (0, 1, 0, 0)),
        ([("p", "f1")], [("p", None)], (0, 1, 0, 0)),
        ([(None, "f1")], [(None, "f1")], (0, 1, 0, 0)),
        ([], [("p", "f1"), ("p", "f2")], (2, 0, 0, 0)),
        ([("p", "f1"), ("p", "f2")], [], (0, 0, 2, 0)),
    ],
)
def test_delta(spark, before, now, want):
    side = lambda rows: spark.createDataFrame([(i, p, "o", None, "m", f) for i, (p, f) in enumerate(rows)], SIDE)
    b, n = side(before), side(now)
    pairs = delta.pair(b, n)
    got = (delta.introduced(n, pairs).count(), pairs.count(), delta.fixed(b, pairs).count(), pairs.where("pass = 4").count())
    assert got == want


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 101)]
    got = dict(graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert all(got[i] == 0 for i in range(41)) and {got[100], got[101], got[105]} == {100}


def test_stride(spark):
    rows = spark.createDataFrame([("k", i) for i in range(811)], "k string, i bigint")
    got = sorted(r.position for r in stats.stride_sample(rows, "k", ["i"]).collect())
    assert got == [i * 811 // 20 for i in range(20)] and got[:3] == [0, 40, 81]


def test_policy():
    assert policy.parse_override("email=off") == ("email", "off")
    for bad in ("email", "email=loud", "E=off"):
        with pytest.raises(ValueError, match="override"):
            policy.parse_override(bad)
    with pytest.raises(ValueError, match="repeated"):
        policy.validate([("a", "off"), ("a", "warn")], {"a"})
    with pytest.raises(ValueError, match="unknown"):
        policy.validate([("b", "off")], {"a"})


def test_configuration():
    got = files.configuration('blocking = "warning"\n[rules]\na = "off"\n')
    assert got.blocking == "warning" and got.rules == {"a": "off"}
    for bad in ("x = 1", "blocking = 'all'", "[rules]\na = 'no'", "[", "#" * 70_000):
        with pytest.raises(ValueError):
            files.configuration(bad)


def test_lock_and_dependency_lists(spark):
    assert files.lock_packages(None)[0] == "absent" and files.lock_packages("[")[0] == "unusable"
    assert files.lock_packages('[[package]]\nname = "a"\nversion = "1"')[1] == [("a", "1")]
    rows = [("o: a.rs b\\ c.rs \\\n d.rs\nz: y",), ("no rule",), ("o: a\\",), (None,), ("a:b: x\\\\y \\q\\#\r\nz",), ("o: " + "p/\\ q \\\n" * 20_000,), ("o:",)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(T.dep_info(F.col("c"))).collect()]
    assert got[:5] == [["a.rs", "b c.rs", "d.rs"], None, None, None, ["x\\y", "\\q#"]] and got[5] == ["p/ q"] * 20_000 and got[6] is None
    zero = spark.createDataFrame([("b\0a\0b\0",)], "c string").select(files.zero_separated(F.col("c"))).first()[0]
    assert zero == ["a", "b"]


def test_paths(spark):
    rows = [("a%b\x01/c",), ("/a",), ("",), ("a/../b",), ("./a//b",)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(T.encode_path(F.col("p"))).collect()]
    assert got == ["a%25b%01/c", None, None, None, "a/b"]
    refs = [("main",), ("a/b-1.x",), ("-x",), ("a..b",), ("a//b",), ("a.lock",), ("f" * 40,), ("a/.b",), ("",)]
    got = [r[0] for r in spark.createDataFrame(refs, "p string").select(T.valid_base(F.col("p"))).collect()]
    assert got == [True, True, False, False, False, False, True, False, False]


def test_messages(spark):
    span = {"file_name": "b.rs", "line_start": 3, "line_end": 3, "column_start": 1, "column_end": 2, "is_primary": True}
    line = json.dumps({"reason": "compiler-message", "package_id": "p", "target": {"name": "t", "kind": ["lib", "test"]}, "message": {"message": "m", "level": "note", "code": {"code": ""}, "spans": [span, span | {"file_name": "a.rs"}, span | {"file_name": "0", "is_primary": False}]}})
    got = messages.findings(spark.createDataFrame([(line,), ("noise",)], "value string")).collect()
    assert len(got) == 1
    assert (got[0].code, got[0].severity, got[0].context, got[0].path, got[0].span.line_start) == (None, "info", "tests", "a.rs", 3)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"reason":"build-finished","success":true}\nnoise\n\n{"x":\n')
    q = ingest.counts(ingest.read_lines(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("kinds").start()
    q.processAllAvailable()
    q.stop()
    assert dict(spark.table("kinds").collect()) == {"known": 1, "noise": 1, "empty": 1, "malformed": 1}


def test_report(spark):
    summary = spark.createDataFrame([("a", 2), ("b", 0)], "rule string, n bigint")
    details = spark.createDataFrame([("a", "p2"), ("a", "p1")], "rule string, path string")
    report.check(summary, details, "rule", "n")
    with pytest.raises(ValueError, match="invariant"):
        report.check(summary, details.limit(1), "rule", "n")
    text = "1\n2\r\n3\n4\n5\n6\n7"
    rows = [("p", text, 4), ("q", "a\x00\nb", 1), ("r", "é" * 5000 + "\nz", 1), ("s", "x" + "é" * 5000, 1), ("t", "\U0001f600" * 2048 + "y", 9), (None, None, 1)]
    frame = report.code_frame(spark.createDataFrame(rows, "path string, text string, line bigint"), ["path"]).orderBy("path", "number").collect()
    assert [(r.path, r.number, r.content) for r in frame] == [("p", n, str(n)) for n in range(2, 7)] + [("r", 1, "é" * 4096), ("r", 2, "z"), ("s", 1, "x" + "é" * 4095)]


def test_hand_off(spark):
    units = spark.createDataFrame([("a", "Audit.", "scan a"), ("b", "Audit.", "scan\nb"), ("c", "Audit.", "scan c")], "unit string, audit string, rescan string")
    groups = [("a", p, f"r{p}", "error", 40 + p, "look" if p == 2 else None) for p in (1, 2, 3, 4)] + [("b", 1, "r1", "info", 1, None), ("c", 1, "r 1", "info", 1, None)]
    sites = [("a", f"r{p}", k, f"s/{k}.rs", k % 3, k) for p in (1, 2, 4) for k in range(p * 9)] + [("c", "r 1", 1, "x", 1, 1)]
    groups = spark.createDataFrame(groups, "unit string, place int, rule string, severity string, occurrences bigint, help string")
    sites = spark.createDataFrame(sites, "unit string, rule string, at bigint, path string, line bigint, column bigint")

    def plain(most):
        lines = [report.HAND_OFF, "Audit."]
        told = 0
        for p in (1, 2, 3):
            lines.append(f"{p}. r{p} (error, {40 + p} occurrences)")
            lines += ["   Help: look"] if p == 2 else []
            for k in range(p * 9 if p < 3 else 0):
                if told < 24:
                    lines.append(f"   - s/{k}.rs:{max(k % 3, 1)}:{max(k, 1)}")
                    told += 1
        body = ""
        for line in [*lines, "Validate with: scan a"]:
            if len(body.encode()) + len(line.encode()) + 1 > most:
                return body, "payload-too-large"
            body += line + "\n"
        return body, None

    whole = len(plain(10**6)[0].encode())
    for most in (report.PROMPT_BYTES, whole, whole - 1, 200, 10):
        got = {r.unit: (r.body, r.refused) for r in report.hand_off(units, groups, sites, "unit", most).collect()}
        assert got["a"] == plain(most)
    assert report.hand_off(units, groups, sites, "unit").where("unit = 'b'").first().refused == "unsafe-payload"
    assert report.hand_off(units, groups, sites, "unit").where("unit = 'c'").first()["body"] == report.HAND_OFF + "\nAudit.\n"


def test_inactive_detectors_do_not_run(spark):
    from tallyforge.operators import findings as fd

    docs = spark.createDataFrame([(1, "s", 15_000, "me@example.org\n" + "a line said more than once\n" * 2), (2, "s", 3, None)], "doc_id bigint, source string, n_chars bigint, text string")
    rules = lambda active: sorted(r.rule for r in fd.detect(docs, active).collect())
    assert rules(None) == ["email", "oversized_unit", "repeated_line"]
    assert rules({"email"}) == ["email"] and rules(set()) == []
    plan = fd.detect(docs, {"email"})._jdf.queryExecution().optimizedPlan().toString()
    assert "license" not in plan and "sha2" not in plan


def test_metadata_tables(spark):
    from tallyforge.sources import metadata

    whole = {"workspace_root": "/w", "workspace_members": ["a 1"], "packages": [
        {"name": "a", "id": "a 1", "edition": "2021", "dependencies": [{"name": "x", "rename": "y", "req": "^1", "kind": None}, {"name": "z", "req": "*", "kind": "dev", "path": "/w/z"}],
         "targets": [{"name": "a", "kind": ["lib"], "src_path": "/w/src/lib.rs"}], "features": {"default": ["y"], "y": []}},
        {"name": "b", "id": "b 1", "dependencies": [], "targets": [], "features": {}},
    ]}
    packages = metadata.parse(spark.createDataFrame([(json.dumps(whole),), ("{",), (None,)], "value string"))
    assert sorted((r.name, r.member) for r in packages.collect()) == [("a", True), ("b", False)]
    assert sorted((r.alias, r.kind, r.path) for r in metadata.dependencies(packages).collect()) == [("y", "normal", None), ("z", "dev", "/w/z")]
    assert [(r.kinds, r.edition) for r in metadata.targets(packages).collect()] == [(["lib"], "2021")]
    assert sorted((r.feature, r.activates) for r in metadata.features(packages).collect()) == [("default", "y"), ("y", None)]


def test_records_that_do_not_fit_fail(spark, tmp_path):
    from tallyforge.sources import metadata

    (tmp_path / "good.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "bad.json").write_text('{"a": 1}\n{"a": "x"}\n')
    assert metadata.read_records(spark, str(tmp_path / "good.json"), "a int").count() == 2
    with pytest.raises(Exception):
        metadata.read_records(spark, str(tmp_path / "bad.json"), "a int").collect()


def test_trees_lines_and_sinks(spark, tmp_path):
    (tmp_path / "tree" / "src").mkdir(parents=True)
    (tmp_path / "tree" / "src" / "a.rs").write_text("fn a() {}\n// b\n")
    (tmp_path / "tree" / "b.rs").write_text("x" * 50)
    (tmp_path / "tree" / "c.txt").write_text("no")
    tree = files.read_tree(spark, str(tmp_path / "tree"), longest=40)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.too_long) for r in tree.collect()}
    assert got == {"a.rs": ("fn a() {}\n// b\n", False), "b.rs": (None, True)}
    assert files.line_count(tree).first().lines == 2
    assert {r.value for r in files.read_lines(spark, str(tmp_path / "tree" / "c.txt")).collect()} == {"no"}
    part, more = files.bounded(F.col("c"), 3)
    assert [tuple(r) for r in spark.createDataFrame([(b"abcd",), (b"ab",)], "c binary").select(part, more).collect()] == [(b"abc", True), (b"ab", False)]
    report.write_json(spark.createDataFrame([(1, "a")], "i int, s string"), str(tmp_path / "report"))
    assert [tuple(r) for r in spark.read.schema("i int, s string").json(str(tmp_path / "report")).collect()] == [(1, "a")]
    for tsv in (False, True):
        report.write_catalog(catalog.rule_table(spark), str(tmp_path / f"catalog{tsv}"), tsv)
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "catalogTrue")).count() == spark.read.json(str(tmp_path / "catalogFalse")).count() == len(catalog.rules())


def test_words_paths_and_selectors(spark):
    rows = [("use a_b;", "a_b", "src/tests/a.rs"), ("xa_b", "a_b", "src/a.rs"), ("a.b", "a.b", "fixtures"), ("axb", "a.b", None)]
    got = spark.createDataFrame(rows, "t string, n string, p string").select(T.mentions(F.col("t"), F.col("n")), T.test_material(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (True, True), (False, None)]
    marks = [("structure::a_b-c", "ab", "é/ %~"), ("A", "a1", ""), ("", "", None)]
    got = spark.createDataFrame(marks, "r string, c string, e string").select(T.valid_rule(F.col("r")), T.valid_category(F.col("c")), T.encode_component(F.col("e")), T.rule_title(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [(False, True, "%C3%A9%2F%20%25~", "A b c"), (False, False, "", "A"), (False, False, None, "")]


def test_byte_offsets(spark):
    text = "aé\nxyz\n\U0001f600"
    raw = text.encode()
    places = [(line, column) for line in range(0, 5) for column in range(0, 6)]
    got = spark.createDataFrame([(text, a, b) for a, b in places], "t string, l int, c int").select("l", "c", T.byte_offset(F.col("t"), F.col("l"), F.col("c")).alias("o")).collect()
    lines = text.split("\n")
    for r in got:
        fits = 1 <= r.l <= len(lines) and 1 <= r.c <= len(lines[r.l - 1]) + 1
        want = len("\n".join([*lines[: r.l - 1], lines[r.l - 1][: r.c - 1]]).encode()) if fits else None
        assert r.o == want and (want is None or want <= len(raw))


def test_repeated_lines_take_time_in_proportion(spark):
    import time

    from tallyforge.operators import findings as fd

    text = "\n".join(f"a line of some length, number {i % 30_000}" for i in range(40_000))
    began = time.time()
    row = fd.detect(spark.createDataFrame([(1, "s", len(text), text)], "doc_id bigint, source string, n_chars bigint, text string"), {"repeated_line"}).first()
    assert row.occurrences == 10_000 and time.time() - began < 30
