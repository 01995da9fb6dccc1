"""Operators of the reference's catalogue on hand-made fixtures and invariants."""

import math
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import hashing as H
from palimpsest.functions import naming as N
from palimpsest.functions import scoring as S
from palimpsest.functions import similarity as M
from palimpsest.operators import drift, graphs, hotspots, moves, relational, upserts, vector
from palimpsest.plans import catalogue
from palimpsest.sources import parsers


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


# naming


@pytest.mark.parametrize(
    "name, want",
    [("", "unknown"), ("foo", "camelCase"), ("fooBar", "camelCase"), ("FooBar", "PascalCase"), ("foo_bar", "snake_case"), ("FOO_BAR", "SCREAMING_SNAKE"), ("foo-bar", "kebab-case"), ("Foo_bar", "mixed"), ("_x", "snake_case"), ("X1", "PascalCase"), ("123", "unknown")],
)
def test_convention(spark, name, want):
    assert one(spark, N.convention(F.col("n")), n=name) == want


@pytest.mark.parametrize("target, want", [("camelCase", "parseFileName"), ("PascalCase", "ParseFileName"), ("snake_case", "parse_file_name"), ("SCREAMING_SNAKE", "PARSE_FILE_NAME"), ("kebab-case", "parse-file-name")])
def test_renamed(spark, target, want):
    for name in ("parseFileName", "ParseFileName", "parse_file_name", "PARSE_FILE_NAME", "parse-file-name"):
        assert one(spark, N.renamed(F.col("n"), target), n=name) == want


@pytest.mark.parametrize(
    "path, want",
    [("react", "package"), ("@/x", "alias"), ("@org/p", "package"), ("/abs/x", "absolute"), ("./a", "no-extension"), ("../a/index", "index"), ("./a.ts", "no-extension"), ("./a.svg", "extension"), ("lib/x", "relative"), (None, "package")],
)
def test_import_style(spark, path, want):
    assert one(spark, N.import_style(F.col("p")), p=path) == want


def test_signatures(spark):
    assert one(spark, F.array_join(N.parameters(F.col("s")), ","), s="(a: string, b = 1, c)") == "a,b,c"
    assert one(spark, F.size(N.parameters(F.col("s"))), s="none") == 0
    assert one(spark, H.normal_signature(F.col("s")), s="(First: Number, b : string)") == "(:number,:string)"
    assert one(spark, N.return_convention(F.col("s")), s="(x): Promise<int>") == "promise"


# hashing


def test_dna_is_stable_and_kind_sensitive(spark):
    dna = lambda kind: one(spark, H.symbol_dna(F.col("k"), F.col("s")), k=kind, s="(x: number)")
    assert dna("function") == dna("function") != dna("class") and len(dna("class")) == 16


def test_comments_do_not_change_the_body(spark):
    a, b = "function f(x) { return x + 1; } // one", "function f(x) {\n /* two */ return   x + 1; }"
    assert one(spark, H.body_hash(F.col("a")) == H.body_hash(F.col("b")), a=a, b=b)
    assert one(spark, H.shape_hash(F.col("a")) == H.shape_hash(F.col("b")), a="let a = b(1)", b="let zz = yy(22)")


def test_edges(spark):
    parts = spark.createDataFrame([("src/test.ts: funcA -> src/other.ts: funcB (calls)",)], "e string").select(H.edge_parts(F.col("e")).alias("x")).select("x.*").first()
    assert tuple(parts) == ("src/test.ts: funcA", "src/other.ts: funcB", "calls")
    assert one(spark, H.callee_name(F.col("c")), c="method_a.b:run()") == "run"
    assert one(spark, H.edge_dna(F.col("c")), c="unknown:x") is None


def test_rolling_hash(spark):
    def brute(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) % 2**32
        return h or 1

    for s in ("", "abc", "a" * 50, "é"):
        assert one(spark, H.rolling_hash(F.col("s")), s=s) == brute(s)


def test_versions(spark):
    assert one(spark, H.version_key(F.col("a")) > H.version_key(F.col("b")), a="1.10", b="1.9.3") and one(spark, H.version_key(F.col("a")) == H.version_key(F.col("b")), a="2", b="2.0.x")


# similarity


@pytest.fixture(scope="module")
def texts(spark):
    words = ["", "a", "ab", "load file", "load_file", "save file", "SAVE", "x" * 2500, "é漢"]
    return spark.createDataFrame([(a, b, c) for a in words[:6] for b in words for c in words[:4]], "a string, b string, c string").cache()


@pytest.mark.parametrize("measure", [M.edit, M.dice, M.text, M.jaccard, M.path])
def test_similarity_is_symmetric_and_bounded(texts, measure):
    a, b = F.col("a"), F.col("b")
    assert texts.where((measure(a, b) < 0) | (measure(a, b) > 1) | (F.abs(measure(a, b) - measure(b, a)) > 1e-12)).count() == 0


def test_levenshtein_triangle(texts):
    assert texts.where(F.levenshtein("a", "b") + F.levenshtein("b", "c") < F.levenshtein("a", "c")).count() == 0


def test_similarity_values(spark):
    assert one(spark, M.edit(F.col("a"), F.col("b")), a="", b="") == 1 and one(spark, M.dice(F.col("a"), F.col("b")), a="", b="x") == 1
    assert one(spark, M.jaccard(F.col("a"), F.col("b")), a="", b="") == 0 and one(spark, M.path(F.col("a"), F.col("b")), a="a/b/c", b="a/b/d/e") == 0.5


# scores


def test_hotspot_bounds(spark):
    low, high = (spark.range(1).select(S.hotspot(*[F.lit(float(v))] * 5)).first()[0] for v in (0, 1))
    assert low == 0 and high == pytest.approx(100)
    null = F.lit(None).cast("double")
    assert spark.range(1).select(S.hotspot(*[null] * 5), S.structural_change(null, null), S.clamp(null)).first()[:] == (None, None, None)
    assert [spark.range(1).select(S.risk_level(F.lit(x))).first()[0] for x in (80, 60, 40, 39.9)] == ["critical", "high", "medium", "low"]


def test_burstiness(spark, rows):
    t = datetime(2024, 1, 1)
    data = [("one", t, 1)] + [("even", t + timedelta(days=i), i) for i in range(5)] + [("same", t, i) for i in range(3)] + [("burst", t + timedelta(days=d), i) for i, d in enumerate((0, 1, 9))]
    got = dict(rows(hotspots.burstiness(spark.createDataFrame(data, "e string, at timestamp, i int"), "e", "at", "i")))
    assert got["one"] == got["even"] == got["same"] == 0 and got["burst"] == pytest.approx(min(1, 3.5 / 4.5 / 2))


@pytest.mark.parametrize("flag, path, want", [("schema-migration", "src/db/migrations/001_init.sql", True), ("security", "validatePassword", True), ("payment", "readme", False)])
def test_risk_flags(spark, flag, path, want):
    assert one(spark, S.risk_flag(flag, F.col("p")), p=path) is want


# sources


@pytest.mark.parametrize(
    "path, size, want",
    [("test.xyz", 1, False), ("test.ts", 1, True), ("node_modules/package/index.js", 1, False), ("out/compiled.js", 1, False), ("a/dist/x.ts", 1, False), ("large.ts", 2_000_000, False), ("x.ts", None, False), ("", 1, False), (None, 1, False), (".ts", 1, False), ("a\\b.TS", 1, True)],
)
def test_processable(spark, path, size, want):
    df = spark.createDataFrame([(path, size)], "p string, s long")
    assert bool(df.select(parsers.processable(F.col("p"), F.col("s"))).first()[0]) is want


def test_parsers(spark, rows):
    text = "import x from './a'\n  const y = require('b')\nuse App\\Foo;\ninclude_once('c.php')\n# Title\n##  Sub\nrun(go(1)); if (x) {}\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    assert [r[2:] for r in rows(parsers.import_edges(parsers.lines(df, "id"), "id"))] == [("./a", "import"), ("b", "require"), ("App\\Foo", "use"), ("c.php", "include")]
    assert rows(parsers.declarations(df, "id")) == [(1, 5, "heading", 1, "Title"), (1, 6, "heading", 2, "Sub")]
    facts = spark.createDataFrame([(1, 'a: 1\r\n  - b_c:\n{\n  "k": {\n.x > li {\nplain')], "id int, text string")
    assert rows(parsers.declarations(facts, "id")) == [(1, 1, "yaml_key", 0, "a"), (1, 2, "yaml_key", 1, "b_c"), (1, 4, "json_key", 1, "k"), (1, 5, "css_rule", 0, ".x > li")]
    uses = spark.createDataFrame([(1, "class A extends B { go(new C()); go(1) }")], "id int, text string")
    assert rows(parsers.dependency_edges(uses, "id")) == [(1, "calls", "C", 1), (1, "calls", "go", 2), (1, "uses", "B", 1), (1, "uses", "C", 1)]
    assert {r[1] for r in rows(parsers.call_edges(df, "id"))} == {"require", "include_once", "run", "go"}
    stat = spark.createDataFrame([("3\t1\ta b.ts",), ("-\t-\tx.png",), ("bad",)], "line string")
    assert rows(parsers.numstat(stat), "added", "removed", "path") == [(None, None, "x.png"), (3, 1, "a b.ts")]


# keyed writes and relational operators


def test_upserts(spark, rows):
    df = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 1), ("b", "3", 1), (None, "4", 0)], "k string, v string, seq int")
    assert rows(upserts.upsert(df, ["k"], "seq")) == [(None, "4", 0), ("a", "2", 2), ("b", "3", 1)]
    old = spark.createDataFrame([("a",)], "k string")
    assert rows(upserts.insert_absent(old, df, ["k"], "seq")) == [(None, "4", 0), ("b", "3", 1)]
    assert upserts.upsert(df.limit(0), ["k"], "seq").count() == 0


def test_best_of_group(spark, rows):
    nan = float("nan")
    data = [("one", 0.1, 1), ("two", 0.2, 1), ("two", 0.3, 2), ("three", 0.9, 1), ("three", 0.9, 2), ("bad", nan, 1), ("bad", None, 2)]
    got = rows(relational.best_of_group(spark.createDataFrame(data, "g string, s double, o int"), "g", "s", "o", 0.5), "g", "o")
    assert got == [("bad", 1), ("one", 1), ("three", 1)]


def test_dominant_tie(spark, rows):
    df = spark.createDataFrame([("f", "snake_case"), ("f", "camelCase"), ("g", "zzz"), ("g", "aaa")], "p string, c string")
    assert rows(relational.dominant(df, ["p"], "c", N.CONVENTIONS)) == [("f", "camelCase", 1), ("g", "aaa", 1)]
    assert rows(relational.dominant(df.where("p = 'f'"), ["p"], "c", ["snake_case", "camelCase"])) == [("f", "snake_case", 1)]


def test_diff_of_itself_is_empty(spark, rows):
    a = spark.createDataFrame([("x", 1), ("y", None)], "k string, v int")
    assert {r[1] for r in rows(relational.diff(a, a, ["k"], "v"))} == {"unchanged"}
    b = spark.createDataFrame([("y", 2), ("z", 3)], "k string, v int")
    assert rows(relational.diff(a, b, ["k"], "v")) == [("x", "removed"), ("y", "modified"), ("z", "added")]


def test_tree_rollup(spark):
    df = spark.createDataFrame([("a/b/x", 3.0, 1, 0), ("a/b/y", 4.0, 1, 2), ("a/z", 1.0, 1, 0), ("a/b", 20.0, 0, 0)], "p string, s double, a int, r int")
    got = {r.node: (r.score, r.added, r.removed, round(r.weight, 4)) for r in relational.tree_rollup(df, "p", "s", "a", "r").collect()}
    assert got == {"a": (21.0, 3, 2, 1.0), "a/b": (20.0, 2, 2, 0.9524), "a/b/x": (3.0, 1, 0, 0.1429), "a/b/y": (4.0, 1, 2, 0.1905), "a/z": (1.0, 1, 0, 0.05)}


# graphs


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_blast_radius(spark, rows):
    e = _edges(spark, [("B", "A"), ("C", "A"), ("A", "D"), ("A", "D")])
    ids = spark.createDataFrame([("A",), ("Z",)], "id string")
    assert rows(graphs.blast_radius(e, ids)) == [("A", 2, 1), ("Z", 0, 0)]
    typed = e.withColumn("edge_type", F.lit("c")).unionByName(_edges(spark, [("A", "I"), ("I", "A")]).withColumn("edge_type", F.lit("i")))
    assert rows(graphs.neighbours(typed, "A", "c", "i", 50)) == [("called_by", "B"), ("called_by", "C"), ("calls", "D"), ("imports", "I")]
    assert rows(graphs.neighbours(typed, "A", "c", "i", 1)) == [("called_by", "B"), ("calls", "D"), ("imports", "I")]


def test_reverse_index_of_a_hub(spark, rows, monkeypatch):
    monkeypatch.setattr(graphs, "BUCKET", 7)
    pairs = [(i * 3 % 101, 1) for i in range(150)] + [(5, 2), (None, 2), (5, None)]
    got = rows(graphs.reverse_index(spark.createDataFrame(pairs, "src long, dst long"), 10))
    callers = sorted({a for a, b in pairs if b == 1 and a is not None})
    assert got == [(1, k, callers[k * 10 : k * 10 + 10]) for k in range(-(-len(callers) // 10))] + [(2, 0, [5])]


@pytest.mark.parametrize("a, b, same", [('{"b": 1, "a": {"d": [1, 2], "c": null}}', '{ "a": {"c": null, "d": [1,2]}, "b": 1}', True), ("[2, 1]", "[1, 2]", True), ('{"a": [2, 1]}', '{"a": [1, 2]}', False), ('[[2, 1], "x"]', '["x", [1, 2]]', False)])
def test_canonical_json(spark, a, b, same):
    x, y = (one(spark, H.canonical_json(F.col("t")), t=t) for t in (a, b))
    assert (x == y) == same and one(spark, H.canonical_json(F.col("t")), t="{oops") is None


def test_reach(spark, rows):
    e = _edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("c", "e"), ("e", "f"), ("x", "a"), (None, "q")])
    roots = spark.createDataFrame([("a",), (None,)], "node string")
    assert rows(graphs.reach(e, roots)) == [("a", 0), ("b", 1), ("c", 2), ("d", 1), ("e", 3), ("f", 4)]
    assert ("f", 4) not in rows(graphs.reach(e, roots, 3)) and ("x", 1) in rows(graphs.reach(e, roots, 1, directed=False))
    assert graphs.reach(e.limit(0), roots.limit(0)).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    e = _edges(spark, [(f"{a:02d}", f"{b:02d}") for a, b in pairs])
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in graphs.connected_components(e).collect()}
    assert got == {f"{x:02d}": f"{y:02d}" for x, y in label.items()}


def test_levels(spark, rows):
    e = _edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x")])
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "node string")
    assert rows(graphs.dag_levels(e, nodes)) == [("a", 0), ("b", 1), ("c", 2), ("z", 0)]


def test_levels_of_all_line_items(spark, rows, tmp_path):
    items = [(18 + i % 40, 1 + i % 5, 1 + i % 7, (i % 4) / 100, 0.02) for i in range(150)]
    spark.createDataFrame(items, "l_partkey long, l_suppkey long, l_linenumber long, l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    links = {(p, s * 17 + n) for p, s, n, _, _ in items}
    level = {}
    for node in sorted({x for link in links for x in link}):
        level[node] = max((level[a] + 1 for a, b in links if b == node and a < b), default=0)
    got = catalogue.queries()["GR-10"](spark, str(tmp_path))
    assert rows(got, "node", "level") == sorted(level.items())


# drift


def test_intended_fold(spark, rows):
    t = datetime(2024, 1, 1)
    ch = [("add", 1, "s1", "added"), ("add", 2, "s2", "modified"), ("gone", 1, "s1", "added"), ("gone", 3, "s3", "removed"), ("back", 1, "s1", "removed"), ("back", 2, "s2", "added"), ("old", 1, "s1", "added"), ("old", 2, "s2", "removed")]
    changes = spark.createDataFrame([(k, t + timedelta(days=d), s, c) for k, d, s, c in ch], "key string, at timestamp, sha string, change_type string")
    ren = [("old", "new", 2, "s2"), ("A", "B", 4, "s4"), ("B", "C", 4, "s4")]
    renames = spark.createDataFrame([(a, b, t + timedelta(days=d), s) for a, b, d, s in ren], "old_key string, new_key string, at timestamp, sha string")
    got = {k: e for k, e, _ in rows(drift.intended(changes, renames))}
    assert got == {"add": "present", "gone": "absent", "back": "present", "old": "absent", "new": "present", "A": "absent", "B": "absent", "C": "present"}


def test_symbol_drift(spark, rows):
    want = spark.createDataFrame([("m", "present", "n1", "p1"), ("z", "absent", "n2", "p2"), ("d", "present", "n3", "p3"), ("f", "present", "n5", "p5"), ("ok", "present", "n6", "p6")], "key string, expect string, name string, path string")
    have = spark.createDataFrame([("z", "n2", "p2"), ("d", "other", "p3"), ("other", "n5", "p5"), ("ok", "n6", "p6")], "key string, name string, path string")
    assert rows(drift.symbol_drift(want, have)) == [("d", "divergent"), ("m", "missing"), ("z", "zombie")]


def test_or_else(spark, rows):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert rows(drift.or_else(a, b)) == [(1,)] and rows(drift.or_else(a.limit(0), b)) == [(2,), (3,)]


def test_symbol_diff(spark, rows):
    schema = "key string, name string, signature_hash string, body_hash string"
    a = spark.createDataFrame([("k", "n", "s", "b"), ("r", "n", "s", "b"), ("g", "n", "s", "b"), ("x", "n", None, None)], schema)
    b = spark.createDataFrame([("k", "n", "s2", "b2"), ("r", "n2", "s", "b"), ("new", "n", "s", "b"), ("x", "n", None, None)], schema)
    assert rows(drift.symbol_diff(a, b)) == [("g", "removed"), ("k", "modified_both"), ("new", "added"), ("r", "renamed")]
    assert drift.symbol_diff(a, a).count() == 0


# moves


def test_move_candidates(spark, rows):
    rng = random.Random(7)
    codes = ["function f(x) { return x + 1; }", "let alpha = beta(1)", "let alpha = gamma(1)", "let ä = bé(12)", "", "class A {}\n// one", "class A {} // two", "if (a) { b(); }", None]
    data = [(i, rng.choice(["ts", "js"]), rng.choice(["a/f.ts", None, "b/f.ts"]), rng.choice(codes), 0) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id int, lang string, file_path string, text string, score int")
    hashed = df.where("text IS NOT NULL").select("doc_id", "lang", "file_path", "text", H.body_hash(F.col("text"), 64).alias("h"), H.digest(H.shape(F.col("text"))).alias("s")).collect()

    def score(x, y):
        if x.h == y.h:
            return 1.0
        return round(1 - edit(x.text, y.text) / max(len(x.text), len(y.text)), 6) if x.s == y.s else 0.0

    # a text stands for all its copies of a file name by its first block
    first = {}
    for r in hashed:
        if r.file_path is not None:
            first.setdefault((r.lang, r.h, r.file_path.split("/")[-1]), r)
    want = []
    for x in hashed:
        name = x.file_path and x.file_path.split("/")[-1]
        there = [(-1.0, y.doc_id) for y in hashed if y.lang == x.lang and y.h == x.h and y.doc_id != x.doc_id]
        there += [(-score(first[x.lang, x.h, name], y), y.doc_id) for (lang, h, n), y in first.items() if lang == x.lang and h != x.h and n == name]
        best = min(there, default=(0, 0))
        if best[0] <= -0.6:
            want.append((x.doc_id, best[1], -best[0]))
    assert rows(moves.candidates(df, "lang", 0.6), "a", "b", "score") == sorted(want) and {w[2] for w in want} - {1.0}
    assert moves.candidates(df.limit(0), "lang", 0.6).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.8, 0.6, 0.9])
def test_similar_names_meet_all_of_them(spark, rows, least):
    rng = random.Random(2)

    def name():
        return "".join(rng.choices("abcé", k=rng.randrange(0, 14)))

    left = [(i, name(), "k") for i in range(60)] + [(900, None, "k"), (901, "abc", None)]
    right = []
    for i in range(80):
        chars = list(rng.choice(left[:60])[1]) if rng.random() < 0.7 else list(name())
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(chars) + 1)
            chars[at : at + rng.randrange(2)] = rng.choices("abz", k=rng.randrange(2))
        right.append((i, "".join(chars), rng.choice("kj")))
    want = sorted({(i, j, round(s, 6)) for i, a, p in left for j, b, q in right if p == q and a and b and round(s := 1 - edit(a, b) / max(len(a), len(b)), 6) >= least})
    a, b = spark.createDataFrame(left, "i int, a string, block string"), spark.createDataFrame(right, "j int, b string, block string")
    assert rows(relational.similar_names(a, b, ["block"], "i", "a", "j", "b", least)) == want and want


def test_entry_points(spark):
    cases = [("getName", "function", "src/a.ts", 0, 3, True, False), ("getName", "method", "src/user.controller.ts", 0, 0, True, True), ("main", "function", "x", 9, 0, True, True), ("onClick", "method", "x", 9, 0, False, True),
             ("UserService", "class", "x", 1, 0, True, True), ("thing", "const", "src/main.ts", 1, 0, True, True), ("thing", "function", "x", 0, 2, True, True), ("thing", "function", "x", 0, 2, False, False), ("thing", "function", "x", 1, 2, True, False), (None, None, None, 0, 1, True, True)]
    df = spark.createDataFrame(cases, "name string, kind string, path string, i int, o int, exported boolean, want boolean")
    out = df.select("want", graphs.entry_point(*(F.col(c) for c in ("name", "kind", "path", "i", "o", "exported"))).alias("got")).collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_log_and_status_lines(spark, rows):
    log = spark.createDataFrame([("a\x1fAnn\x1f2020\x1fline 1\nline 2\x1fb",), ("b\x1fBob",), ("",), (None,)], "value string")
    assert rows(parsers.log_records(log, "\x1f")) == [("a", "Ann", "2020", "line 1\nline 2", "b"), ("b", "Bob", "", "", "")]
    changes = spark.createDataFrame([("M\ta b.ts",), ("R087\told.ts\tnew.ts",)], "line string")
    assert rows(parsers.name_status(changes), "status", "similarity", "old_path", "path") == [("M", None, None, "a b.ts"), ("R", 87, "old.ts", "new.ts")]
    assert rows(parsers.status_lines(spark.createDataFrame([("MM x y.ts",), (" D z",), ("A  w",)], "line string"))) == [("w", "A", "staged"), ("x y.ts", "M", "staged"), ("x y.ts", "M", "unstaged"), ("z", "D", "unstaged")]


def test_name_clusters(spark):
    words = ["load main config file now", "load main config file now again", "save image", "image save", "unrelated thing"]
    df = spark.createDataFrame([("function", w) for w in words], "kind string, words string")
    got = {r.words: r.cluster for r in moves.name_clusters(df, 0.8).collect()}
    assert got[words[0]] == got[words[1]] == words[0] and got[words[2]] == got[words[3]] and got[words[4]] == words[4]


def test_name_clusters_with_repeated_words(spark):
    words = ["get get x", "get x", "get get get x y", "a a b c d e f", "a b c d e f", "b c", "b b b c"]
    got = {r.words: r.cluster for r in moves.name_clusters(spark.createDataFrame([("function", w) for w in words], "kind string, words string"), 0.8).collect()}
    sets = {w: set(w.split()) for w in words}
    want = {w: min(v for v in words if len(sets[v] & sets[w]) > 0.8 * len(sets[v] | sets[w])) for w in words}
    assert got == want


# vectors


def test_top_k(spark, rows):
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [1.0]), (8, [3.0, 0.0]), (9, [1.0, 1.0])]
    df = spark.createDataFrame(data, "item_id long, vector array<float>")
    q = df.where("item_id IN (1, 5)").withColumnRenamed("item_id", "query_id")
    got = rows(vector.top_k(q, df, 3, 0.0), "query_id", "rank_no", "item_id", "similarity")
    assert got == [(1, 1, 2, 1.0), (1, 2, 8, 1.0), (1, 3, 9, round(math.sqrt(0.5), 6))]
    assert vector.top_k(q.limit(0), df, 3).count() == 0 and vector.top_k(q, df.limit(0), 3).count() == 0
