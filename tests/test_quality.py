"""Data-quality operators against brute force and on edge cases."""

import json
import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions import keys as K
from palimpsest.functions import zones
from palimpsest.operators import hierarchy, history, instants, lookup, nested, references, walks
from palimpsest.session import Cut

A = "a" * 40
B = "b" * 40


# keys


def test_keys(spark, rows):
    from pyspark.sql import functions as F

    values = [None, "", " \t", "0000", "unknown:x", " AbC\n", "src\\x.ts:DEADBEEF ", "x:000", "a:b:c"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = rows(df.select("i", K.dna_key(F.col("v")), K.commit_key(F.col("v"))))
    assert [r[1] for r in got] == [None, None, None, None, None, "abc", "deadbeef", None, "c"]
    assert got[6][2] == "src\\x.ts:deadbeef" and got[3][2] is None


def test_paths(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(p,) for p in ["a\\b//c", "./a", ".//./a", ".\\a\\\\b", "A/b", "../a", None]], "p string")
    assert [r[0] for r in df.select(K.norm_path(F.col("p"))).collect()] == ["a/b/c", "a", "a", "a/b", "A/b", "../a", None]


# references


def _refs(spark, data):
    return spark.createDataFrame(data, "table_name string, load_batch long, row_key string, kind string, key string")


@pytest.fixture
def hot(monkeypatch):
    """Lets keys count as hot in small tables."""
    monkeypatch.setattr(references, "HOT_SHARE", 5)
    monkeypatch.setattr(lookup, "HOT_SHARE", 5)


def test_surviving_keys(spark, rows):
    targets = spark.createDataFrame([("commit", "x", 1), ("commit", "x", 5), ("commit", "y", 3), ("dna", "y", 9), ("dna", None, 1)], "kind string, key string, load_batch int")
    purges = spark.createDataFrame([("commit", "x", 4), ("commit", "y", 3), ("commit", "y", 2), ("dna", "q", 1)], "kind string, key string, purged_batch int")
    assert rows(references.surviving_keys(targets, purges)) == [("commit", "x"), ("dna", "y")]


def test_orphans_hot_and_light_agree(spark, rows, hot):
    rng = random.Random(1)
    data = [("t", rng.randrange(3), str(i), "dna", "hot" if i % 3 == 0 else rng.choice(["gone", "here", "also", None])) for i in range(60)]
    data += data[:5]
    refs = _refs(spark, data)
    alive = spark.createDataFrame([("dna", "here"), ("commit", "hot")], "kind string, key string")
    marked = references.mark_hot(refs, refs.count())
    assert "hot" in {r.key for r in marked.where("hot").collect()}
    counts = references.orphan_counts(marked, alive)
    assert {r.hot for r in counts.collect()} == {True, False}
    got = rows(references.orphan_records(marked, counts))
    assert got == sorted({(a, b, c) for a, b, c, _, k in data if k in ("hot", "gone", "also")})
    assert sum(r.n for r in counts.collect()) == sum(1 for r in data if r[4] in ("hot", "gone", "also"))


def test_no_task_holds_a_hot_key(spark, hot):
    """With half of the rows under one key, the shuffle of the other keys carries none of its rows."""
    data = [("t", i % 3, str(i), "dna", "hot" if i % 2 == 0 else f"k{i}") for i in range(400)]
    marked = references.mark_hot(_refs(spark, data), 400)
    by = {r.hot: r.n for r in marked.groupBy("hot").count().withColumnRenamed("count", "n").collect()}
    assert by == {True: 200, False: 200}
    light = marked.where("NOT hot").repartition(4, "kind", "key").rdd.glom().map(len).collect()
    assert max(light) <= 2 * sorted(light)[len(light) // 2]


def test_orphans_empty(spark):
    refs, alive = _refs(spark, []), spark.createDataFrame([], "kind string, key string")
    marked = references.mark_hot(refs, 0)
    assert references.orphan_records(marked, references.orphan_counts(marked, alive)).count() == 0


def test_short_references(spark, rows):
    commits = spark.createDataFrame([("ab" + "0" * 37 + "1",), ("ab" + "0" * 37 + "2",), ("cd" * 20,)], "sha string")
    refs = spark.createDataFrame([("cdcd",), ("ab",), ("ab" + "0" * 37,), ("ff",), (None,), ("cd" * 20,)], "ref string")
    assert rows(lookup.resolve_short(refs, commits)) == [("cdcd", "cd" * 20)]


def test_skew_lookup_is_a_left_join(spark, rows, hot):
    left = spark.createDataFrame([(i, "h" if i < 30 else f"k{i % 7}" if i % 5 else None) for i in range(80)], "i int, k string")
    right = spark.createDataFrame([("h", 1), ("k1", 2), ("k3", 3), ("zz", 4)], "k string, v int")
    assert rows(lookup.skew_lookup(left, "k", right, 80), "i", "k", "v") == rows(left.join(right, "k", "left"), "i", "k", "v")


# nested records


@pytest.mark.parametrize(
    "text, paths",
    [
        (None, []),
        ("", []),
        ("undefined", []),
        ("null", []),
        ('"n/a"', []),
        ("{}", []),
        ('{"a": {"b": [1, {"c": {}}]}}', [("a", ""), ("a/b/1", "a"), ("a/b/1/c", "a/b/1")]),
        ("[{}, [[{}]], 3]", [("0", ""), ("1/0/0", "")]),
        (json.dumps('{"x": {}}'), [("x", "")]),
        (json.dumps(json.dumps('{"x": {}}')), []),
        ('Done.\n```json\n{"x": {"y": {}}}\n```\nmore', [("x", ""), ("x/y", "x")]),
        (json.dumps("```\n[{}]\n```"), [("0", "")]),
        ('{"a": "{\\"b\\": {}}"}', []),
        ('{"a": NaN, "b": {}}', []),
        ('{"a": {}} x', []),
        ('{"a": {},}', []),
        ('{"": {"": {}}}', [("", ""), ("/", "")]),
        ('{"k": {}, "k": [{}]}', [("k/0", "")]),
    ],
)
def test_objects(text, paths):
    value = nested.read_value(text)
    got = [] if value is nested._BAD else [(p, q) for p, q, _, _ in nested.objects(value)]
    assert got == paths


def test_deep_nesting(spark):
    depth = 30_000
    text = '{"a":' * depth + "1" + "}" * depth
    value = nested.read_value(text)
    n = 0
    while isinstance(value, dict):
        value, n = value["a"], n + 1
    assert n == depth
    df = spark.createDataFrame([("f", "k", '{"a":' * 3000 + "1" + "}" * 3000)], "source_field string, record_key string, value string")
    assert nested.flatten_objects(df).count() == 2999


_json = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(_json)
def test_deep_parser_agrees(value):
    text = json.dumps(value)
    assert nested.parse_deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", "[1,]", "{1:2}", "[1 2]", '{"a" 1}', "tru", "01", "[}", "{]", '"\n"', "1 2", "{,}", '{"a":1,}'])
def test_deep_parser_rejects(text):
    with pytest.raises(ValueError):
        nested.parse_deep(text)


def test_nodes_link_to_parents_and_variants(spark, rows):
    values = [("f", "1", '{"s": [{"id": "a", "n": 1}, {"id": "b", "at": {"l": 2}}]}'), ("f", "1", '{"s": [{"id": "a", "n": 1}, {"id": "b", "at": {"l": 2}}]}'), ("f", "2", '{"s": [{"id": "c", "n": 1.5}]}'), ("f", "3", "퟿"), ("f", "4", '{"\\ud800": {}}')]
    df = spark.createDataFrame([(*v, 1) for v in values], "source_field string, record_key string, value string, node_path int")
    nodes, states = nested.route(df)
    assert len(rows(nodes.select("source_field", "record_key", "node_path"))) == 5
    v = {tuple(zip(r["keys"], r["states"])): r for r in nested.variants(nodes, states).where("role = 's'").collect()}
    at = next(r.variant for r in states.collect() if r["keys"] == ["l"])
    assert set(v) == {(("id", "str"), ("n", "int")), (("at", at), ("id", "str")), (("id", "str"), ("n", "num"))} and {tuple(r.supertype_keys) for r in v.values()} == {("id",)}
    whole = nested.subtype_table(nodes, states, v[("id", "str"), ("n", "int")].variant)
    assert rows(whole, "record_key", "node_path", "id", "n") == [("1", "s/0", "a", 1)] and dict(whole.dtypes)["n"] == "decimal(38,0)"
    assert rows(nested.subtype_table(nodes, states, v[("at", at), ("id", "str")].variant), "parent_path", "id") == [("", "b")]
    assert nested.subtype_table(nodes, states, "no such variant").count() == 0
    assert nested.flatten_objects(df.limit(0)).count() == 0


def test_every_object_has_typed_rows(spark, rows):
    value = {"symbols": {"0": {"id": "a", "n": 1, "x,y": True}, "1": {"id": "b", "n": 2.5, "flags": ["p", ["q"]], "at": {"l": {}}}}, "claims": [{"text": "t", "evidence": [{"ref": "r", "type": "file"}, {"ref": None}], "none": []}], "big": {"n": 2**70, "s": {"n": 3}}}
    df = spark.createDataFrame([("f", "1", json.dumps(value))], "source_field string, record_key string, value string")
    typed = nested.typed_objects(df)
    assert rows(typed.select("node_path", "parent_path").distinct()) == rows(nested.flatten_objects(df).select("node_path", "parent_path"))
    got = {(r.node_path, r.field, r.at): r for r in typed.collect()}
    assert got["symbols/0", "id", ""].role == "symbols" and got["symbols/0", "id", ""].supertype_keys == ["id", "n"] and got["symbols", None, None].role == "symbols{}"
    assert (got["symbols/0", "n", ""].whole, got["symbols/1", "n", ""].number, got["symbols/0", "x,y", ""].flag) == (1, 2.5, True)
    assert (got["symbols/1", "flags", "0"].value, got["symbols/1", "flags", "1/0"].value, got["claims/0", "none", ""].value) == ("p", "q", "[]")
    assert (got["big", "n", ""].type, got["big", "n", ""].value, got["big/s", "n", ""].whole) == ("big", str(2**70), 3)
    assert rows(nested.role_table(df, "symbols"), "node_path", "id", "n", "`x,y`") == [("symbols/0", "a", 1.0, True), ("symbols/1", "b", 2.5, None)]
    assert rows(nested.role_table(df, "evidence"), "parent_path", "ref", "type") == [("claims/0", None, None), ("claims/0", "r", "file")]
    assert nested.role_table(df, "no such role").count() == 0 and nested.typed_objects(df.limit(0)).count() == 0


def test_state_holds_the_whole_subtree():
    def state(value):
        return nested.Automaton().run(value)[id(value)][0]

    assert state({"k": {"x": 1}}) != state({"k": {"y": [1, {"z": 2}]}})
    assert state({"k": [[1]]}) != state({"k": [[{"z": 1}]]})
    assert state({"k": {"x": {"n": 1}}}) == state({"k": {"x": {"n": 2}}}) != state({"k": {"x": {"n": "s"}}})
    assert state({"0": {"n": 1}}) == state({"0": {"n": 1}, "7/a": {"n": 2}})
    deep = []
    for _ in range(30_000):
        deep = [deep]
    assert state(deep) and nested.Automaton().run(1) == {}
    small = nested.Automaton(remembered=2)  # forgetting transitions changes no state
    assert [small.run(v)[id(v)][0] for v in ({"a": 1}, {"b": 1}, {"c": {"a": 1}})] == [state({"a": 1}), state({"b": 1}), state({"c": {"a": 1}})]


def test_odd_keys_survive_in_variants(spark):
    df = spark.createDataFrame([("f", "1", '{"r": {"a,b": 1, "c:d": {"": 2}, "*": null}}')], "source_field string, record_key string, value string")
    got = [r for r in nested.variants(*nested.route(df)).collect() if r.role == "r"]
    assert len(got) == 1 and got[0].supertype_keys == ["*", "a,b", "c:d"] == got[0]["keys"]


# hierarchies


def brute_tree(parent):
    out = {}
    for x in parent:
        seen, walk = set(), x
        steps = 0
        while parent[walk] is not None and walk not in seen:
            seen.add(walk)
            walk = parent[walk]
            steps += 1
        if parent[walk] is None:
            out[x] = (walk, steps)
        else:
            ring, y = [], walk
            while y not in ring:
                ring.append(y)
                y = parent[y]
            out[x] = (min(ring), -1)
    return out


def _forest(seed, n):
    rng = random.Random(seed)
    names = [f"n{i:04d}" for i in range(n)]
    rng.shuffle(names)
    parent = {x: (None if i == 0 or rng.random() < 0.03 else names[rng.randrange(max(0, i - 4), i)]) for i, x in enumerate(names)}
    for _ in range(3):  # loops, also a node that is its own parent
        a = rng.choice(names)
        parent[a] = a if rng.random() < 0.3 else rng.choice(names)
    return parent


@pytest.mark.parametrize("seed, limit", [(1, 10**6), (2, 10**6), (3, 20), (4, 1)])
def test_hierarchy(spark, seed, limit):
    parent = _forest(seed, 300)
    edges = spark.createDataFrame(list(parent.items()), "node string, parent string")
    got = {r.node: r for r in hierarchy.hierarchy(edges, paths=True, max_component=limit).collect()}
    assert {x: (r.root, r.depth) for x, r in got.items()} == brute_tree(parent)
    for x, r in got.items():
        if r.depth < 0:
            assert r.pre is None and r.path is None
            continue
        names, at = [], x
        while at is not None:
            names.append(at)
            at = parent[at]
        told, at = [], x
        while at is not None:
            told = got[at].path.split("/") + told
            at = got[at].path_after
        assert told == names[::-1] and len(r.path.split("/")) == r.depth % hierarchy.PATH_BLOCK + 1
        below = {y for y, s in got.items() if s.root == r.root and s.depth >= 0 and r.pre < s.pre <= r.last}
        assert len(below) == r.n_descendants and below == {y for y in got if y != x and _under(parent, y, x)}
    loops = {}
    for x, r in got.items():
        if r.depth < 0:
            loops.setdefault(r.root, []).append(x)
    assert {x for x, r in got.items() if r.back_edge} == {next(x for x in xs if parent[x] == root and _on_ring(parent, x)) for root, xs in loops.items()}


def _under(parent, y, x):
    seen = set()
    while y is not None and y not in seen:
        if y == x:
            return True
        seen.add(y)
        y = parent[y]
    return False


def _on_ring(parent, x):
    y, n = parent[x], 0
    while y != x and n <= len(parent):
        y, n = parent[y], n + 1
    return y == x


def test_hierarchy_of_one_loop_at_every_limit(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("t", "b"), ("s", "s"), ("u", "s"), ("v", "u")], "node string, parent string")
    for limit in (100, 1):
        got = rows(hierarchy.hierarchy(edges, paths=True, max_component=limit), "node", "root", "depth", "back_edge")
        assert got == [("a", "a", -1, False), ("b", "a", -1, False), ("c", "a", -1, True), ("s", "s", -1, True), ("t", "a", -1, False), ("u", "s", -1, False), ("v", "s", -1, False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_contract_to_the_ends(spark, seed):
    rng = random.Random(seed)
    parent = {x: p for x, p in _forest(seed, 600).items() if p is not None}
    for k in range(12):  # loops with nothing on them
        size = rng.randrange(1, 30)
        parent |= {f"ring{k}_{j}": f"ring{k}_{(j + 1) % size}" for j in range(size)}
    cut = Cut(spark, "test")
    links = cut.put(spark.createDataFrame([(a, b, b, 1, a) for a, b in parent.items()], walks.LINK))[1]
    got = {r.node: (r.root, r.dist) for r in walks.follow(links, len(parent), cut, spacing=3, task_links=200).collect()}
    assert got == {x: v for x, v in brute_tree(parent | {p: None for p in parent.values() if p not in parent}).items() if x in parent}


def test_long_chain_and_hub(spark, hot):
    parent = {f"c{i:05d}": f"c{i - 1:05d}" if i else None for i in range(700)} | {f"h{i}": "c00001" for i in range(400)}
    edges = spark.createDataFrame(list(parent.items()), "node string, parent string")
    got = {r.node: (r.root, r.depth, r.pre, r.n_descendants) for r in hierarchy.hierarchy(edges, max_component=100).collect()}
    want = {r.node: (r.root, r.depth, r.pre, r.n_descendants) for r in hierarchy.hierarchy(edges).collect()}
    assert got == want and {x: v[:2] for x, v in got.items()} == brute_tree(parent)


def test_links_of_raw_rows(spark, rows):
    raw = [("a", None, 1), ("b", "a", 1), ("b", "a", 1), ("c", "zz", 1), ("d", "c", 1), ("d", "b", 2), (None, "a", 1), ("e", "e", 1)]
    edges = hierarchy.links(spark.createDataFrame(raw, "node string, parent string, root int"))
    assert rows(edges) == [("a", None), ("b", "a"), ("c", None), ("d", "b"), ("e", "e")]
    assert rows(hierarchy.hierarchy(edges), "node", "root", "depth") == [("a", "a", 0), ("b", "a", 1), ("c", "c", 0), ("d", "a", 2), ("e", "e", -1)]


def test_empty_hierarchy(spark):
    assert hierarchy.hierarchy(spark.createDataFrame([], "node string, parent string")).count() == 0


# instants


def us(text, zone="UTC"):
    mask = text.translate({ord(c): "9" for c in "0123456789"} | {ord(c): "A" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    out = instants.to_utc_us(pd.Series([text]), pd.Series([mask]), pd.Series([zone], dtype=object))[0]
    return None if pd.isna(out) else int(out)


def at(*parts, micro=0):
    return int((datetime(*parts, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000 + micro


@pytest.mark.parametrize(
    "text, zone, want",
    [
        ("2020-01-28T20:39:12.646Z", None, at(2020, 1, 28, 20, 39, 12, micro=646000)),
        ("2020-01-28T20:39:12.123456789Z", None, at(2020, 1, 28, 20, 39, 12, micro=123456)),
        ("2020-01-28 20:39:12,5+05:30", None, at(2020, 1, 28, 15, 9, 12, micro=500000)),
        ("20200223T171713Z", None, at(2020, 2, 23, 17, 17, 13)),
        ("08.03.2020 03:33", "UTC", at(2020, 3, 8, 3, 33)),
        ("3.4.2020, 02:01:06", "UTC", at(2020, 4, 3, 2, 1, 6)),
        ("2/1/2020 12:33 AM", "UTC", at(2020, 2, 1, 0, 33)),
        ("2/1/2020 12:33 PM", "UTC", at(2020, 2, 1, 12, 33)),
        ("2/1/2020 13:33 PM", "UTC", None),
        ("Tue Aug 4 16:17:34 2020 +0900", None, at(2020, 8, 4, 7, 17, 34)),
        ("Thu, 12 Mar 2020 05:41:26 GMT", "Asia/Tokyo", at(2020, 3, 12, 5, 41, 26)),
        ("Mon Apr 06 2020 21:18:27 GMT+0200", None, at(2020, 4, 6, 19, 18, 27)),
        ("2020-06-23 12:39:15 BST", None, at(2020, 6, 23, 11, 39, 15)),
        ("2020-06-23 12:39:15 XYZ", "UTC", None),
        ("2020-04-30T21:55:27+01:00[Europe/Berlin]", None, at(2020, 4, 30, 20, 55, 27)),
        ("2020-05-14T03:30:22[Australia/Sydney]", None, at(2020, 5, 13, 17, 30, 22)),
        ("2020-05-14T03:30:22[No/Where]", "UTC", None),
        ("1580455125", None, at(2020, 1, 31, 7, 18, 45)),
        ("1580455125696", None, at(2020, 1, 31, 7, 18, 45, micro=696000)),
        ("1584252522833574", None, at(2020, 3, 15, 6, 8, 42, micro=833574)),
        ("1583917170 +0200", None, 1583917170 * 10**6),
        ("15839171", None, None),
        ("2020-10-25T02:30:00", "Europe/Berlin", at(2020, 10, 25, 0, 30)),
        ("2020-03-29T02:30:00", "Europe/Berlin", at(2020, 3, 29, 1, 30)),
        ("2020-03-29T02:30:00", None, None),
        ("2023-02-29 10:11:12", "UTC", None),
        ("2024-02-29 10:11:12", "UTC", at(2024, 2, 29, 10, 11, 12)),
        ("2020-11-10T25:61:00Z", None, None),
        ("0000-00-00 00:00:00", "UTC", None),
        ("2020-01-01T00:00:00+25:00", None, None),
        ("2020-01-01X00:00:00Z", None, None),
        ("Tue Foo 4 16:17:34 2020 +0900", None, None),
        ("", "UTC", None),
        ("yesterday", "UTC", None),
        ("9" * 200, "UTC", None),
        ("2020-01-28T20:39:12." + "123456789" * 50 + "+01:00", None, at(2020, 1, 28, 19, 39, 12, micro=123456)),
        ("Mon Apr 06 2020 21:18:27 GMT+0200 (" + "Central European Summer Time " * 20 + ")", None, at(2020, 4, 6, 19, 18, 27)),
        ("2101-07-01 12:00", "Europe/Berlin", at(2101, 7, 1, 10)),
        ("9999-12-31 23:59:59", "Europe/Berlin", at(9999, 12, 31, 22, 59, 59)),
    ],
)
def test_notations(text, zone, want):
    assert us(text, zone) == want


@settings(max_examples=300, deadline=None)
@given(st.datetimes(datetime(1700, 1, 1), datetime(9990, 1, 1)), st.sampled_from(["Europe/London", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Los_Angeles", "UTC"]))
def test_local_times_as_in_zoneinfo(local, zone):
    # fold=0 is the first of two and, for a skipped time, the offset before the change
    there = local.replace(tzinfo=ZoneInfo(zone), fold=0)
    want = local - datetime(1970, 1, 1) - there.utcoffset()
    assert us(local.strftime("%Y-%m-%dT%H:%M:%S.%f"), zone) == want // timedelta(microseconds=1)


def test_normalise(spark, rows):
    data = [("f", "1", "2020-01-28T20:39:12.646Z", "UTC"), ("f", "2", " 1580455125", None), ("f", "2", " 1580455125", None), ("f", "3", None, "UTC"), ("f", "4", "x" * 100_000, "UTC"), ("f", "5", "2020-01-28T20:39:12", None)]
    df = spark.createDataFrame([(*d, 5) for d in data], "field_name string, row_key string, value string, zone string, utc_us int")
    assert rows(instants.normalise(df)) == [("f", "2", 1580455125 * 10**6)]
    assert instants.normalise(df.limit(0)).count() == 0


def test_zone_tables():
    assert zones.transitions("No/Where") is None and zones.transitions("../x") is None
    assert len(zones.transitions("UTC")[0]) == 1 and zones.zone_version()


# history


def brute_periods(data):
    best = {}
    for e, t, i, s, b, p in data:
        if e is not None and t is not None and ((e, t) not in best or i > best[e, t][0]):
            best[e, t] = (i, s, b, p)
    out, state, opened = [], {}, {}
    for (e, t), (i, s, b, p) in sorted(best.items()):
        old = state.get(e)
        now = (s if s is not None or old is None else old[0], b if b is not None or old is None else old[1], p)
        if now != old:
            if e in opened:
                out.append((e, opened[e], i))
            opened[e] = i
        state[e] = now
    return sorted(out + [(e, i, -1) for e, i in opened.items()])


@pytest.mark.parametrize("seed, chunk", [(1, 100_000), (2, 4), (3, 10)])
def test_periods(spark, rows, monkeypatch, seed, chunk):
    monkeypatch.setattr(history, "CHUNK_ROWS", chunk)
    rng = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    data = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None]), t0 + timedelta(minutes=rng.randrange(60)) if rng.random() < 0.97 else None, i, rng.choice(["x", "y", None]), rng.choice(["u", None, None]), rng.choice(["p", "p", "q", None])) for i in range(150)]
    data += data[:10]
    df = spark.createDataFrame([(*d, "extra") for d in data], "entity string, at timestamp, id long, s string, b string, p string, chunk string")
    assert rows(history.periods(df, len(data)), "entity", "first_row_id", "next_row_id") == brute_periods(data)


def test_periods_empty_and_single(spark, rows):
    schema = "entity string, at timestamp, id long, s string, b string, p string"
    assert history.periods(spark.createDataFrame([], schema), 0).count() == 0
    one = spark.createDataFrame([("a", datetime(2024, 1, 1), 7, None, None, None)], schema)
    assert rows(history.periods(one, 1), "entity", "first_row_id", "next_row_id", "valid_to") == [("a", 7, -1, None)]
