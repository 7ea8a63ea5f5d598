"""Canonical forms, nesting, trees, scopes, budgets and versions against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import manifests as M
from tallyforge.functions import text as T
from tallyforge.operators import aliases, canonical, evidence, features, graph, harness, ignore, nesting, ordered, policy, presentation, relations, score, snapshot, stats, trees
from tallyforge.operators import similarity as sim


def test_canonical_form(spark):
    rows = [(1, "a + b ; a . 1 2.5 true \"x y\""), (2, "q + r ; q . 7 0.1 false \"\""), (3, "x + x"), (4, 'open "quote'), (5, ""), (6, None), (7, "é1 _é é1")]
    got = {r.i: (r.form, r.nodes, r.statements) for r in canonical.canonical(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert got[1] == got[2] == ("$0 + $1 ; $0 . #int #float #bool #str", 10, 3)
    assert got[3][0] == "$0 + $0" and got[4] == (None, None, None) and got[5] == ("", 0, 0) and got[6] == (None, None, None) and got[7][0] == "$0 $1 $0"
    long = "abc def 1 . " * 6_000 + " ".join(f"n{k}" for k in range(12_000))
    form = canonical.canonical(spark.createDataFrame([(1, long)], "i int, text string")).first()
    assert form.nodes == 36_000 and form.form.endswith("$12000 $12001")
    assert canonical.admitted(canonical.canonical(spark.createDataFrame([(1, "a . " * 30)], "i int, text string"))).count() == 1


def test_arguments(spark):
    cases = {
        "all(any(a, b), c), d": ["all(any(a,b),c)", "d"],
        'reason = "so, (it", x': ['reason="so, (it"', "x"],
        "a{b, [c, d], }, e,": ["a{b,[c,d],}", "e"],
        "a), b": ["a)", "b"],
        "a /* x, y */, b // c, d\n, e": ["a", "b", "e"],
        'a "\\", " b': ['a"\\", "b'],
        "": [],
        ", ,": [],
    }
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(cases)] + [(99, None)], "k int, t string")
    got = {}
    for r in nesting.split_arguments(rows, "k", "t").orderBy("k", "place").collect():
        got.setdefault(r.k, []).append(r.argument)
    assert [got.get(k, []) for k in range(len(cases))] == list(cases.values()) and 99 not in got
    flags = spark.createDataFrame([(["b", "a", "b"],), (['reason="x"'],), (["a", 'reason="x"'],)], "a array<string>")
    assert [tuple(r) for r in flags.select(M.lints_of(F.col("a")), M.unreasoned(F.col("a"))).collect()] == [(["a", "b"], True), ([], False), (["a"], False)]


def brute_tree(html):
    """Nodes (place, parent, depth, tag) by a stack; None for a damaged page."""
    import re

    stack, nodes, pos = [], [], -1
    for m in re.finditer(trees.TAG.replace("(?is)", "(?is)").replace(r"\z", r"\Z"), html):
        pos += 1
        name = re.match(r"</?[a-zA-Z][a-zA-Z0-9]*", m.group())
        if not name:
            continue
        tag = name.group().strip("</").lower()
        if m.group().startswith("</"):
            if tag in trees.ENDLESS:
                continue
            if not stack:
                return None
            stack.pop()
            continue
        nodes.append((pos, stack[-1] if stack else None, len(stack), tag))
        if tag not in trees.ENDLESS:
            stack.append(pos)
            if len(stack) > nesting.DEEPEST:
                return None
    return None if stack else nodes


def test_trees(spark):
    r = random.Random(7)
    pages = []
    for k in range(120):
        out, open_ = [], 0
        for _ in range(r.randrange(0, 60)):
            x = r.random()
            if x < 0.45:
                out.append(f"<{r.choice(['div', 'a', 'ul', 'section', 'DIV class=x'])}>")
                open_ += 1
            elif x < 0.8 and open_:
                out.append("</div>")
                open_ -= 1
            else:
                out.append(r.choice(["<br>", "<p>", "</p>", "text < 3", "<!-- <div> -->", "<script>var a='<div>';</script>", "<li>x"]))
        pages.append((k, "".join(out) + "</div>" * (open_ if k % 5 else max(open_ - 1, 0))))
    pages += [(500, ""), (501, None), (502, "<div>" * 80 + "</div>" * 80), (503, "<div" + "a" * 200_000), (504, "<!--" * 50_000), (505, "<a <b <c>")]
    got = {}
    nodes = trees.page_nodes(spark.createDataFrame(pages, "page_id int, html string"))
    for n in nodes.orderBy("page_id", "node").collect():
        got.setdefault(n.page_id, []).append((n.node, n.parent, n.depth, n.tag))
    for k, html in pages:
        assert got.get(k, []) == (brute_tree(html or "") or []), k

    hashes = {}
    for h in trees.subtree_hashes(nodes, "page_id").collect():
        hashes[h.page_id, h.node] = h.hash
    shapes = {}
    for k, own in got.items():
        for i, (node, _, depth, _) in enumerate(own):
            stop = next((j for j in range(i + 1, len(own)) if own[j][2] <= depth), len(own))
            shapes[k, node] = tuple((d - depth, t) for _, _, d, t in own[i:stop])
    assert len(set(zip(map(hashes.get, shapes), shapes.values(), strict=True))) == len(set(shapes.values())) == len(set(hashes.values()))
    assert trees.subtree_hashes(nodes.where("page_id < 0"), "page_id").count() == 0


def test_complexity(spark):
    kinds = {"if": "branch", "for": "loop", "match": "choice", "arm": "arm", "fn": "closure", "and": "logic", "or": "logic", "break": "jump", "try": "try"}
    cases = {
        "if": (2, 1), "if(if)": (3, 2), "if(for)": (3, 3), "for(if(if))": (4, 4), "match(arm arm(if))": (4, 3), "fn(if)": (2, 2), "and(and)": (3, 1), "and(or)": (3, 2),
        "break": (1, 1), "try": (2, 0), "if(match(if))": (3, 6), "for(fn(for))": (3, 4), "": None, "x(x)": (1, 0),
    }
    marks = []
    for k, text in enumerate(cases):
        pos = 0
        word = ""
        for c in text + " ":
            if c.isalpha():
                word += c
                continue
            if word:
                marks.append((k, pos, word, 1))
                pos += 1
                if c != "(":
                    marks.append((k, pos, word, -1))
                    pos += 1
                word = ""
            if c == ")":
                marks.append((k, pos, "end", -1))
                pos += 1
    got = {r.u: (r.cyclomatic, r.cognitive) for r in trees.complexity(spark.createDataFrame(marks, "u int, pos int, tag string, mark int"), "u", kinds).collect()}
    assert [got.get(k) for k in range(len(cases))] == list(cases.values())
    edge = spark.createDataFrame([(19, 24), (20, 0), (1, 25)], "a int, b int").select(trees.is_complex(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in edge] == [False, True, True]


def test_aliases(spark):
    """Random nested scopes against a walk outwards."""
    r = random.Random(3)
    marks, bindings, uses, want = [], [], [], {}
    for unit in range(40):
        stack, known, asked = [(-1, True)], {}, []
        for pos in range(r.randrange(1, 90)):
            x = r.random()
            mark, module = 0, False
            if x < 0.15:
                mark, module = 1, r.random() < 0.3
                stack.append((pos, module))
            elif x < 0.28 and len(stack) > 1:
                mark = -1
                stack.pop()
            elif x < 0.6:
                name, path = r.choice("abc") if r.random() < 0.9 else None, r.choice(["p", "q", None])
                bindings.append((unit, pos, name, path))
                known[stack[-1][0], name] = path
            else:
                asked.append((pos, r.choice("abcd"), list(stack)))
            marks.append((unit, pos, mark, module))
        for pos, name, chain in asked:
            uses.append((unit, pos, name))
            verdict = ("unbound", None)
            for start, module in reversed(chain):
                if (start, name) in known:
                    verdict = ("item", known[start, name]) if known[start, name] else ("indeterminate", None)
                    break
                if (start, None) in known:
                    verdict = ("indeterminate", None)
                    break
                if module:
                    break
            want[unit, pos] = verdict
    m = spark.createDataFrame(marks, "unit int, pos int, mark int, module boolean")
    b = spark.createDataFrame(bindings, "unit int, pos int, name string, path string")
    u = spark.createDataFrame(uses, "unit int, pos int, name string")
    scoped = graph.settle(aliases.scopes(m))
    got = {(x.unit, x.pos): (x.verdict, x.path) for x in aliases.resolve(scoped, b, u, m).collect()}
    assert got == want and {v for v, _ in got.values()} == {"item", "indeterminate", "unbound"}
    few = {k for k, n in {k: sum(x[0] == k for x in bindings) for k in range(40)}.items() if n > 20}
    limited = aliases.resolve(scoped, b, u, m, limit=20).collect()
    assert few and {(x.unit, x.pos) for x in limited if x.unit in few and x.verdict != "indeterminate"} == set()
    assert all((x.verdict, x.path) == want[x.unit, x.pos] for x in limited if x.unit not in few)


def test_detectors(spark):
    rows = [
        (1, "C", "item", "reqwest::Client", "builder", "danger_accept_invalid_certs", "true", None, None, False, "certificates"),
        (2, "C", "item", "reqwest::Client", "builder", "danger_accept_invalid_certs", "true", None, None, True, None),
        (3, "C", "item", "reqwest::Client", "builder", "danger_accept_invalid_hostnames", "false", None, None, False, None),
        (4, "rq", "unbound", None, "blocking::Client::builder", "tls_danger_accept_invalid_hostnames", "true", None, None, False, "host names"),
        (5, "reqwest", "unbound", None, "Client::builder", "danger_accept_invalid_certs", "true", None, None, False, "certificates"),
        (6, "other", "unbound", None, "Client::builder", "danger_accept_invalid_certs", "true", None, None, False, None),
        (7, "Command", "item", "std::process::Command", "new", "arg", 'format!("rm {x}")', "sh", "-c", True, "interpolated command"),
        (8, "Command", "item", "std::process::Command", "new", "arg", 'format!("rm {{x}}")', "sh", "-c", False, None),
        (9, "Command", "item", "std::process::Command", "new", "arg", '&("a" + name)', "zsh", "-c", False, "interpolated command"),
        (10, "Command", "item", "std::process::Command", "new", "arg", '"a" + "b"', "zsh", "-c", False, None),
        (11, "Command", "indeterminate", None, "new", "arg", "a + b", "sh", "-c", False, None),
        (12, "Command", "item", "std::process::Command", "new", "arg", "a + b", "fish", "-c", False, None),
    ]
    calls = spark.createDataFrame([(1, *r[:-1]) for r in rows], "unit int, pos int, name string, verdict string, path string, rest string, method string, argument string, shell string, flag string, test boolean")
    crates = spark.createDataFrame([(1, "rq", "reqwest"), (1, "reqwest", "reqwest")], "unit int, alias string, crate string")
    got = {r.pos: r.message for r in aliases.detect(aliases.called(calls, crates)).collect()}
    assert got == {r[0]: r[-1] for r in rows if r[-1]}


@pytest.mark.parametrize("hot", [False, True])
def test_places_and_budgets(spark, monkeypatch, hot):
    r = random.Random(5)
    rows = [(0 if hot and r.random() < 0.9 else r.randrange(4), k, r.choice([0, 1, 3, 10, 40, 95])) for k in range(900)]
    df = spark.createDataFrame(rows, "g int, k int, size bigint").repartition(5)
    monkeypatch.setattr(ordered, "PART", 70)
    by = {}
    for g, k, size in sorted(rows):
        by.setdefault(g, []).append((k, size))
    places = {(g, k): i for g, own in by.items() for i, (k, _) in enumerate(own)}
    at = graph.settle(ordered.placed(df, ["g"], ["k"]))
    assert {(x.g, x.k): x.place for x in at.collect()} == places
    assert {(x.g, x.k): x.place for x in ordered.ranked(df, ["g"], ["k"]).collect()} == places
    for budget in (95, 300):
        for skips in (True, False):
            want = {}
            for g, own in by.items():
                used = 0
                for k, size in own:
                    want[g, k] = used + size <= budget
                    used += size if want[g, k] or not skips else 0
            got = {(x.g, x.k): x.within for x in ordered.spend(at, ["g"], "place", "size", budget, skips).collect()}
            assert got == want, (budget, skips)


def test_digest(spark):
    import hashlib

    lines = [f"line {k:05d}" for k in range(2345)]
    sha = lambda xs: hashlib.sha256("\n".join(xs).encode()).hexdigest()
    want = lines
    for _ in range(3):
        want = [sha(want[i : i + 50]) for i in range(0, len(want), 50)]
    for n in (1, 7):
        df = spark.createDataFrame([(x,) for x in reversed(lines)], "line string").repartition(n).withColumn("all", F.lit(0))
        got = ordered.digest(ordered.placed(df, ["all"], ["line"]), "line", "place", fan=50).collect()
        assert [tuple(r) for r in got] == [(want[0], 2345)]


def test_proofs(spark):
    files = {"a": "one  two\n\tthree four\r\nfive", "b": "x" * 70_000 + "\ny", "c": "\n" * 70_000, "d": "é" * 32_768}
    spans = []
    for path, text in files.items():
        lines = text.split("\n")
        for a, b in ((1, 1), (1, 2), (2, 3), (1, 3), (3, 2), (1, 70_001), (0, 1)):
            for ca, cb in ((1, 3), (2, 1), (3, 9), (1, 70_001), (1, 32_769), (1, 1)):
                spans.append((path, a, ca, b, cb))
    spans += [("zz", 1, 1, 1, 2), (None, 1, 1, 1, 2)]

    def plain(path, a, ca, b, cb):
        text = files.get(path)
        if text is None or a < 1:
            return None
        lines, starts = text.split("\n"), [0]
        for x in lines:
            starts.append(starts[-1] + len(x) + 1)
        at = lambda n, c: starts[n - 1] + c - 1 if 1 <= n <= len(lines) and 1 <= c <= len(lines[n - 1]) + 1 else None
        lo, hi = at(a, ca), at(b, cb)
        if lo is None or hi is None or lo > hi or len(text[lo:hi].encode()) > T.PROOF_BYTES:
            return None
        return " ".join(text[lo:hi].split()) or None

    c = spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "id int, path string, line_start bigint, column_start bigint, line_end bigint, column_end bigint")
    got = {r.id: r.proof for r in evidence.proofs(c, spark.createDataFrame(list(files.items()), "path string, text string")).collect()}
    assert got == {i: plain(*s) for i, s in enumerate(spans)}
    evidence.refuse_large(c, rows=len(spans))
    with pytest.raises(ValueError, match="limit-exceeded"):
        evidence.refuse_large(c, rows=len(spans) - 1)


def test_versions(spark, tmp_path):
    old = snapshot.manifest(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", None)], "p string, t string"), "p", "t")
    new = snapshot.manifest(spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3"), ("e", "")], "p string, t string"), "p", "t")
    snapshot.write_version(old, str(tmp_path / "m"), 1)
    snapshot.write_version(new, str(tmp_path / "m"), 2)
    with pytest.raises(Exception, match="(?i)exist"):
        snapshot.write_version(new, str(tmp_path / "m"), 2)
    read = [snapshot.read_version(spark, str(tmp_path / "m"), v) for v in (1, 2)]
    assert dict(map(tuple, snapshot.compare(*read).collect())) == {"a": "same", "b": "changed", "c": "gone", "d": "added", "e": "same"}
    assert [tuple(r) for r in snapshot.moved(*read).collect()] == [("c", "d")]
    every = spark.read.parquet(str(tmp_path / "m"))
    assert {r.path: r.version for r in snapshot.latest(every).collect()} == {"a": 2, "b": 2, "c": 1, "d": 2, "e": 2}
    assert snapshot.defects(old).count() == 0
    assert sorted(r.defect for r in snapshot.defects(old, (3, 0, 1)).collect()) == ["limit-exceeded: bytes", "limit-exceeded: entries"] + ["limit-exceeded: entry"] * 3


def test_harness(spark):
    rows = [("a", 1, "x"), ("a", 2, None), ("b", 1, "bad"), ("b", 5, "x"), ("c", 3, "skip"), ("d", None, None)]
    df = spark.createDataFrame(rows, "u string, n bigint, t string")
    every = spark.createDataFrame([(x,) for x in "abcde"], "u string")
    got = harness.outcomes(df, "u", F.col("t") != "skip", [("bad-row", F.col("t") == "bad"), ("no-number", F.col("n").isNull())], {"n": F.col("n")}, every)
    assert {r.u: tuple(r)[1:] for r in got.collect()} == {"a": ("processed", None, 0, 1), "b": ("failed", "bad-row", 1, None), "c": ("skipped", None, 0, None), "d": ("failed", "no-number", 1, None), "e": ("failed", "missing", 0, None)}


def test_ignore(spark):
    def verdicts(rules, paths):
        known = ignore.rules(spark.createDataFrame(list(enumerate(rules)), "place int, line string"))
        return dict(map(tuple, ignore.ignored(spark.createDataFrame(paths, "path string, folder boolean"), known).collect()))

    got = verdicts(["/target", "*.o", "!keep.o", "a/**/z", "logs/", "**/tmp?", "x/*", "!x/y", "\\!odd", "  ", "#c", "[ab].c", "sp ace  "], [(p, p == "logs") for p in ("target", "b/target", "q/m.o", "keep.o", "target/keep.o", "a/z", "a/b/c/z", "a/z2", "logs", "d/logs/x", "d/logs", "tmp1", "k/tmp2", "tmp", "x/y", "x/w", "x/y/v", "!odd", "a.c", "c.c", "sp ace")])
    assert {p for p, v in got.items() if v} == {"target", "q/m.o", "target/keep.o", "a/z", "a/b/c/z", "logs", "d/logs/x", "tmp1", "k/tmp2", "x/w", "!odd", "a.c", "sp ace"}


def test_build_output(spark):
    """The workspace's own rule: its build folder has to be ignored as a folder."""
    for line, want in (("/target", True), ("/target/", True), ("target/*", False), ("!/target", False), ("/tar?et/", True)):
        known = ignore.rules(spark.createDataFrame([(1, line)], "place int, line string"))
        assert ignore.ignored(spark.createDataFrame([("target", True)], "path string, folder boolean"), known).first().ignored is want


def test_lock_state(spark):
    texts = [None, "", "version = 4\n", '[[package]]\nname = "a"\nversion = "1.0"\nsource = "r"\ndependencies = [\n "b",\n]\n', "oops", '[[package]]\r\nname = "a"\r\nversion = "2"\r\n']
    state, packages = M.lock_state(F.col("c"))
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "c string").select(state, F.transform(packages, lambda p: F.concat_ws(" ", p["name"], p["version"]))).collect()]
    assert got == [("absent", None), ("packages", []), ("packages", []), ("packages", ["a 1.0"]), ("unusable", None), ("packages", ["a 2"])]


def test_near_of(spark):
    """No pair is missed, also among multisets of few kinds of tokens."""
    r = random.Random(9)
    bags = {k: [r.choice("abcdefgh") * r.choice([1, 2]) for _ in range(r.randrange(5, 40))] for k in range(80)}
    for k in range(80, 110):
        bags[k] = bags[k - 80][1:] + ["zz"] * (k % 3)
    rows = [(k, t, v.count(t)) for k, v in bags.items() for t in set(v)]
    df = spark.createDataFrame(rows, "doc_id int, token string, cnt bigint")
    got = {(x.q, x.o): x.score for x in sim.near_of(df, df.where("doc_id % 4 = 0")).collect()}
    want = {}
    for q in bags:
        for o in bags:
            common = sum(min(bags[q].count(t), bags[o].count(t)) for t in set(bags[q]))
            score = 2 * common * 10_000 // (len(bags[q]) + len(bags[o]))
            if q % 4 == 0 and q != o and score >= sim.THRESHOLD:
                want[q, o] = score
    assert got == want and len(want) > 10


def test_settled_tables_go(spark):
    import os

    df = graph.settle(spark.range(5))
    path = df._settled.removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 5
    graph.release(df)
    assert not os.path.exists(path)


@pytest.mark.parametrize("shares", [1, 10_000])
def test_order_statistics(spark, monkeypatch, shares):
    """Against a sort, with keys ranked by a window only and over ranges only; nulls, ties, a null key, a key without values."""
    import math
    import statistics

    monkeypatch.setattr(ordered, "SHARES", shares)
    r = random.Random(3)
    rows = [("hot", r.randint(0, 9)) for _ in range(400)] + [(k, r.randint(-5, 5)) for k in ("a", None) for _ in range(21)]
    rows += [("one", 7), ("two", 1), ("two", 4), ("void", None), ("hot", None)]
    data = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = {g.k: (g.mid, g.p95, g.least) for g in stats.order_statistics(data, "k", "v", mid=stats.middle(), p95=stats.discrete(95), least=F.array(F.lit(0))).collect()}
    want = {}
    for key in {k for k, _ in rows}:
        own = sorted(v for k, v in rows if k == key and v is not None)
        want[key] = (statistics.median(own), own[max(math.ceil(0.95 * len(own)), 1) - 1], own[0]) if own else (None, None, None)
    assert got == want
    assert stats.order_statistics(data.limit(0), "k", "v", mid=stats.middle()).count() == 0


def test_features(spark):
    """Each way in which a feature is read or has an effect, against plain loops."""
    declared = [("p", "idle", []), ("p", "none", None), ("p", "default", []), ("p", "opt", []), ("p", "listed", []), ("p", "read", []), ("p", "acts", ["listed", "dep:far", "x/there"])]
    declared += [("p", "far", []), ("p", "there", []), ("p", "elsewhere", []), ("q", "read", []), ("p", "twice", []), ("p", "twice", ["dep:z"]), ("p", "idle", [])]
    read = [(1, "read", ["p"]), (2, "elsewhere", ["q"]), (3, "unknown", ["p", "q"]), (4, "read", ["r", "q"]), (5, "unknown", []), (6, "unknown", None), (7, None, ["p"]), (3, "unknown", ["p", "q"]), (8, "idle", ["r"])]
    d = spark.createDataFrame(declared, "package string, feature string, activates array<string>")
    u = spark.createDataFrame(read, "place int, feature string, packages array<string>")
    optional = spark.createDataFrame([("p", "opt"), ("q", "idle")], "package string, feature string")
    got = sorted(map(tuple, features.unread(d, u, optional).collect()))
    # A place that q compiles reads q's feature.
    assert got == [("p", "elsewhere"), ("p", "far"), ("p", "idle"), ("p", "none"), ("p", "there")]
    assert sorted(map(tuple, features.undeclared(u, d, ["place"]).collect())) == [(2, "elsewhere"), (3, "unknown"), (8, "idle")]
    assert features.unread(d.limit(0), u, optional).count() == 0 and features.undeclared(u.limit(0), d, ["place"]).count() == 0


@pytest.mark.parametrize("shares", [1, 10_000])
def test_family_members(spark, monkeypatch, shares):
    monkeypatch.setattr(ordered, "SHARES", shares)
    rows = [("a", "x.rs", 3, "tests"), ("a", "x.rs", 3, "tests"), ("a", "w.rs", 9, "tests"), ("b", "z.rs", 1, None), ("b", "y.rs", 1, "tests"), (None, "n.rs", 1, "tests"), (None, "m.rs", 2, "benches")]
    found = presentation.family_members(spark.createDataFrame(rows, "k string, path string, line int, context string"), ["k"], ["path", "line"])
    got = {(r.k, r.path): (r.place, r.occurrences, r.family_context) for r in found.collect()}
    assert got == {("a", "w.rs"): (0, 2, "tests"), ("a", "x.rs"): (1, 2, "tests"), ("b", "y.rs"): (0, 2, None), ("b", "z.rs"): (1, 2, None), (None, "m.rs"): (0, 2, None), (None, "n.rs"): (1, 2, None)}


def test_interactive(spark):
    groups = spark.createDataFrame([("u", "Bugs", 1), ("u", "Security", 2), ("u", "Bugs", 3), ("u", None, 4), ("u", "strange", 5), ("v", "Other", 1)], "unit string, category string, place bigint")
    got = [tuple(r)[1:] for r in presentation.interactive(groups, "unit").where("unit = 'u'").orderBy("position").collect()]
    assert got == [(1, "Security", None), (2, "Security", 2), (3, "Bugs", None), (4, "Bugs", 1), (5, "Bugs", 3), (6, "Other", None), (7, "Other", 4), (8, "Other", 5)]
    assert presentation.interactive(groups.limit(0), "unit").count() == 0


def test_authority_and_levels(spark):
    units = spark.createDataFrame([("good", "complete", True), ("late", "incomplete", True), ("lost", "complete", False), ("odd", "complete", True), ("bare", "complete", True), ("null", None, True), (None, "complete", True)], "k string, status string, inventory boolean")
    rules = spark.createDataFrame([("good", True), ("late", True), ("lost", True), ("odd", True), ("odd", False), ("null", True), (None, False)], "k string, authoritative boolean")
    got = {r.k: r.authoritative for r in score.authority(units, rules, "k").collect()}
    assert got == {"good": True, "late": False, "lost": False, "odd": False, "bare": True, "null": False, None: False}
    level, origin = policy.blocking_level(F.col("request"), F.col("config"))
    rows = spark.createDataFrame([("none", "error"), (None, "warning"), (None, None), ("warning", None)], "request string, config string").select(level.alias("level"), origin.alias("origin"))
    assert [tuple(r) for r in rows.collect()] == [("none", "request"), ("warning", "config"), ("error", "default"), ("warning", "request")]
    cells = spark.createDataFrame([(s, x) for s in ("error", "warning", "info", None) for x in ("error", "warning", "none", None)], "s string, x string").select("s", "x", policy.blocks_at(F.col("s"), F.col("x")).alias("b"))
    assert {(r.s, r.x) for r in cells.collect() if r.b} == {("error", "error"), ("error", "warning"), ("warning", "warning")}


@pytest.mark.parametrize("shares", [1, 10_000])
def test_orphans(spark, monkeypatch, shares):
    monkeypatch.setattr(ordered, "SHARES", shares)
    paths = ["src/a.rs", "src/b.rs", "src/c.rs", "src/gen.rs", "src/notes.txt", ".git/x.rs", "src/.hid/y.rs", "target/z.rs", "src/target/w.rs", "src/target.rs", "tests/t.rs", "src/s.rs", "src/a.rs"]
    files = [("u", p, p == "src/gen.rs") for p in paths] + [("u", None, False), ("v", "src/b.rs", None), ("v", "src/s.rs", False), (None, "src/q.rs", False)]
    f = spark.createDataFrame(files, "k string, path string, generated boolean")
    compiled = spark.createDataFrame([("u", "src/a.rs"), ("v", "src/x.rs")], "k string, path string")
    included = spark.createDataFrame([("u", "src/b.rs")], "k string, path string")
    scripted = spark.createDataFrame([("u", "s.rs")], "k string, name string")
    got = sorted((r.k or "", r.path, r.context) for r in relations.orphans(f, compiled, included, scripted, "k").collect())
    assert got == [("", "src/q.rs", None), ("u", "src/c.rs", None), ("u", "src/target.rs", None), ("u", "tests/t.rs", "tests"), ("v", "src/b.rs", None), ("v", "src/s.rs", None)]
    # Entries by path: .git/x.rs, src/.hid/y.rs, src/a.rs, src/b.rs, src/c.rs; what comes behind them isn't looked at.
    for most, want in [(4, []), (5, ["src/c.rs"])]:
        assert [r.path for r in relations.orphans(f.where("k = 'u'"), compiled, included, scripted, "k", most).collect()] == want
    assert relations.orphans(f.limit(0), compiled, included, scripted, "k").count() == 0


def test_queue(spark):
    universe = spark.createDataFrame([("c", "allow"), ("b", "warn"), ("a", "deny"), ("d", "warn"), ("e", None), ("f", "allow"), ("b", "warn")], "id string, level string").repartition(5)
    decided = spark.createDataFrame([("f",), ("f",), (None,)], "id string")
    got = sorted((r.place, r.id) for r in relations.queue(universe, decided, "id", "level").collect())
    assert got == [(0, "b"), (1, "d"), (2, "c"), (3, "e")]
    assert relations.queue(universe.limit(0), decided, "id", "level").count() == 0


def test_populations(spark):
    rows = [("h", 80, 1, 1000, None), ("h", 91, 2, 500, 65), ("h", None, 5, 0, 40), ("a", 40, 0, 100, 40), ("a", 60, 1, 100, None), ("a", 60, 0, 0, None), ("n", None, 0, 0, None), (None, 70, 0, 10, 65)]
    told = stats.populations(spark.createDataFrame(rows, "p string, score int, findings int, lines int, ceiling int"), "p")
    got = {r.p: (r.great, r.needs_work, r.critical, r.least, r.most, r.spread, r.median_centi, r.ceilings, r.one_band, r.one_value, r.density_milli) for r in told.collect()}
    assert got["h"] == (2, 0, 0, 80, 91, 11, 8550, 1, True, False, 8 * 1_000_000 // 1500)
    assert got["a"] == (0, 2, 1, 40, 60, 20, 6000, 1, False, False, 5000)
    assert got["n"] == (0, 0, 0, 0, 0, 0, 0, 0, True, True, 0)
    assert got[None] == (0, 1, 0, 70, 70, 0, 7000, 1, True, True, 0)
    assert tuple(stats.apart(told, "p", "h", "a").select("least", "most", "spread", "separation_centi").first()) == (40, 91, 51, 2550)


def test_overrides(spark):
    rows = [(1, "u", "email=off"), (2, "u", "email=warn"), (3, "v", "email=off"), (4, "u", "other=off"), (5, "u", "emailoff"), (6, "u", "email=deny"), (7, "u", "=off"), (8, "u", "Email=off"), (9, "u", "email=off=warn"), (10, "u", None), (11, "u", ""), (12, None, "size=error"), (13, None, "size=error"), (14, "u", "size=error\n"), (15, "w", "a" * 129 + "=off"), (16, "w", "email\n=off"), (17, "u", "size=off")]
    known = spark.createDataFrame([("email",), ("size",), ("size",), (None,)], "selector string")
    made = spark.createDataFrame(rows, "i int, unit string, override string")
    got = {r.i: r.code for r in policy.checked(made, known, ["unit"]).collect()}
    assert len(got) == len(rows)
    for i, unit, text in rows:
        try:
            policy.parse_override(text or "")
            want = None
        except ValueError as e:
            want = str(e)
        if want is None:
            key = text.partition("=")[0]
            every = [t for _, u, t in rows if u == unit and t and t.startswith(f"{key}=") and t.partition("=")[2] in policy.LEVELS]
            want = "override-unknown" if key not in ("email", "size") else "override-repeated" if len(every) > 1 else None
        assert got[i] == want, (i, text)
    assert policy.checked(made.limit(0), known, ["unit"]).count() == 0
