"""Nested JSON records as flat, linked tables.

A bottom-up tree automaton gives every object of a value the state of its whole
subtree (``Automaton``), and the state routes the object to the table of its
variant, with its path and its nearest enclosing object.  Objects of one role
are the variants of one supertype.  The role is the last object key on the
path, but the keys of a map are no roles: its values have the role of the map.
The keys that all variants of a role share are the supertype's.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import commit_key
from ..session import Cut
from ..sources.tables import table

NODE = "source_field string, record_key string, node_path string, parent_path string, role string, variant string"
ROUTED = NODE + ", body string, is_map boolean, keys array<string>, states array<string>"
CELL = NODE + ", field string, at string, type string, value string"
_SCALARS = ("null", "bool", "int", "num", "str")
#: Nodes per Arrow batch that goes back to the JVM.
OUT_ROWS = 20_000

_FENCE = re.compile(r"```[ \t]*[A-Za-z0-9_+.-]*\s*(.*?)```", re.S)
_BAD = object()
#: A key that can be a field's name; others (indexes, paths, notations) are keys of maps.
_NAME = re.compile(r"[^\W\d][\w$-]*|[$][\w$-]*")


def _integer(digits: str):
    return int(digits) if len(digits) < 4000 else float(digits)


def _no_constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=_integer, parse_constant=_no_constant)
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|(")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))', re.A)
_WORD = {"true": True, "false": False, "null": None}


def parse_deep(text: str):
    """Strict JSON without recursion, for values nested beyond the C parser's reach."""
    at, stack, root = 0, [], []
    holder, expect = root, "value"  # value | first (value or end) | key | firstkey | colon | next
    key = None
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            if expect == "next" and not stack and not text[at:].strip(" \t\n\r"):
                return root[0]
            raise ValueError(at)
        at = m.end()
        mark, quote, number, word = m.groups()
        if mark and mark in "}]":
            if not stack or expect not in ("next", "first" if mark == "]" else "firstkey") or isinstance(holder, dict) != (mark == "}"):
                raise ValueError(at)
            holder, key = stack.pop()
            expect = "next"
        elif mark == ",":
            if expect != "next" or not stack:
                raise ValueError(at)
            expect = "key" if isinstance(holder, dict) else "value"
        elif mark == ":":
            if expect != "colon":
                raise ValueError(at)
            expect = "value"
        else:
            if quote:
                value, at = json.decoder.scanstring(text, at, True)
            elif number:
                value = _integer(number) if re.fullmatch(r"-?\d+", number) else float(number)
            elif word:
                value = _WORD[word]
            else:
                value = {} if mark == "{" else []
            if expect in ("key", "firstkey"):
                if not quote:
                    raise ValueError(at)
                key, expect = value, "colon"
                continue
            if expect not in ("value", "first"):
                raise ValueError(at)
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            expect = "next"
            if mark:
                stack.append((holder, key))
                holder, expect = value, "firstkey" if mark == "{" else "first"


def _json(text: str):
    try:
        return _DECODER.decode(text)
    except RecursionError:
        pass
    except ValueError:
        return _BAD
    try:
        return parse_deep(text)
    except ValueError:
        return _BAD


def read_value(text: str | None):
    """The JSON value of a stored text, or ``_BAD``.

    A JSON string is opened once.  A text that is no JSON but holds a block
    fenced by three backticks is read as that block (the first that is JSON).
    """
    if not text:
        return _BAD
    value = _json(text)
    if isinstance(value, str):
        text = value
        value = _json(text)
    if value is _BAD:
        for block in _FENCE.finditer(text):
            value = _json(block.group(1).strip())
            if value is not _BAD:
                break
    return value


def kind_of(value) -> str:
    """The state of a scalar."""
    if value is None:
        return "null"
    if value is True or value is False:
        return "bool"
    if isinstance(value, int):
        return "int"
    return "num" if isinstance(value, float) else "str"


def is_map(obj: dict) -> bool:
    """Whether an object is a map to objects or arrays: no value is a scalar but null, and no key can be a field's name."""
    return any(isinstance(x, (dict, list)) for x in obj.values()) and all(x is None or isinstance(x, (dict, list)) for x in obj.values()) and not any(_NAME.fullmatch(k) for k in obj)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()


class Automaton:
    """A bottom-up tree automaton over JSON shapes; the transitions met so far are remembered.

    A scalar's state is its kind.  An array's state follows from the set of its
    elements' states, an object's from its keys, each with the state of its
    value, and a map's from the set of its values' states.  So two objects have
    one state exactly if their whole subtrees have one shape.  A state is named
    by a digest, the same on every worker.
    """

    def __init__(self, remembered: int = 100_000):
        self.remembered = remembered
        self.names: dict[tuple, str] = {}

    def step(self, transition: tuple) -> str:
        name = self.names.get(transition)
        if name is None:
            if len(self.names) >= self.remembered:
                self.names.clear()
            name = self.names[transition] = _digest(json.dumps(transition))
        return name

    def run(self, value) -> dict[int, tuple[str, tuple]]:
        """(state, transition) of every object and array of a value by id, children before parents and without recursion."""
        order, stack = [], [value] if isinstance(value, (dict, list)) else []
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(x for x in (node.values() if isinstance(node, dict) else node) if isinstance(x, (dict, list)))
        found: dict[int, tuple[str, tuple]] = {}

        def of(x) -> str:
            return found[id(x)][0] if isinstance(x, (dict, list)) else kind_of(x)

        for node in reversed(order):
            if isinstance(node, list):
                transition = ("array", *sorted({of(x) for x in node}))
            elif is_map(node):
                transition = ("map", *sorted({of(x) for x in node.values()}))
            else:
                transition = ("object", *((k, of(node[k])) for k in sorted(node)))
            found[id(node)] = self.step(transition), transition
        return found


def cells(obj: dict) -> Iterator[tuple[str, str, str, str | None]]:
    """(field, place in the field's arrays, type, text) of every scalar that belongs to an object itself and of every empty array."""
    for k, x in obj.items():
        stack = [(x, "")]
        while stack:
            x, at = stack.pop()
            if isinstance(x, list):
                if not x:
                    yield k, at, "list", "[]"
                stack.extend((y, f"{at}/{i}" if at else str(i)) for i, y in reversed(list(enumerate(x))))
            elif not isinstance(x, dict):
                kind = kind_of(x)
                if kind == "int" and not -(2**63) <= x < 2**63:
                    kind = "big"
                yield k, at, kind, None if x is None else x if kind == "str" else json.dumps(x)


def objects(value) -> Iterator[tuple[str, str, str, dict]]:
    """(path, parent path, role, object) of every object but a root one, in document order, without recursion.

    Members of a map have the map's role, the map itself that role with ``{}``.
    """
    if not isinstance(value, (dict, list)):
        return
    stack = [(value, "", "", "")]
    while stack:
        node, path, parent, role = stack.pop()
        if isinstance(node, dict):
            inner = is_map(node)
            if path or node is not value:
                yield path, parent, role + "{}" if inner else role, node
            parent = path
            kids = [(x, f"{path}/{k}" if path or node is not value else k, parent, role if inner else k) for k, x in node.items() if isinstance(x, (dict, list))]
        else:
            kids = [(x, f"{path}/{i}" if path or node is not value else str(i), parent, role) for i, x in enumerate(node) if isinstance(x, (dict, list))]
        stack.extend(reversed(kids))


def _clean(text: str) -> str:
    """Lone surrogates of an escape cannot be stored as UTF-8 and become '?'."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()


def _scalars(node: dict) -> str:
    """JSON text of the values that belong to an object itself: scalars, and arrays of nothing but scalars."""
    own = {_clean(k): x for k, x in node.items() if not isinstance(x, dict) and not (isinstance(x, list) and any(isinstance(y, (dict, list)) for y in x))}
    return json.dumps(own, ensure_ascii=False)


def _classify(columns: str):
    """Rows of every object of a batch of values, routed by the automaton's state; with ``ROUTED`` also a row per state met."""
    fields = [x.rsplit(" ", 1) if not x.endswith("array<string>") else x.split(" ", 1) for x in columns.split(", ")]
    types = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, types[t]) for n, t in fields])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, told = Automaton(), set()
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out.clear()
            return made

        for batch in it:
            for field, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                value = read_value(text)
                if value is _BAD:
                    continue
                states = automaton.run(value)
                for path, parent, role, node in objects(value):
                    state, transition = states[id(node)]
                    row = (field, key, _clean(path), _clean(parent), _clean(role), state)
                    if columns == CELL:
                        out.extend((*row, *(x and _clean(x) for x in c)) for c in cells(node))
                        if not node or all(isinstance(x, dict) or x and isinstance(x, list) for x in node.values()) and not any(True for _ in cells(node)):
                            out.append((*row, None, None, None, None))
                    else:
                        out.append((*row, _scalars(node), None, None, None))
                        if state not in told:
                            if len(told) >= automaton.remembered:
                                told.clear()
                            told.add(state)
                            named = transition[0] == "object"
                            out.append((None, None, None, None, None, state, None, not named, [_clean(k) for k, _ in transition[1:]] if named else [], [k for _, k in transition[1:]] if named else list(transition[1:])))
                    if len(out) >= OUT_ROWS:
                        yield flush()
        if out:
            yield flush()

    return batches


def _each(values: DataFrame, columns: str) -> DataFrame:
    once = values.select("source_field", "record_key", "value").where("value IS NOT NULL AND record_key IS NOT NULL").distinct()
    return once.mapInArrow(_classify(columns), columns)


def route(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, states): every JSON object but a root one, routed to the table of its variant, and the automaton's states.

    ``values`` has source_field, record_key and value (all string).  Null,
    empty and unreadable values and null record keys give no rows, exact copies
    of an input row give their rows once, a repeated key of an object holds its
    last value.  The objects' table has the keys and the parent link that all
    variants share, the role, the variant and the object's own values as JSON
    text; it is written once, sorted by variant, so that the table of one
    variant (``subtype_table``) reads its own row groups.  A state has its
    variant, whether it is a map's, its keys and the state of each key's value
    (of a map: the states of its values).
    """
    cut = Cut(values.sparkSession, "nested")
    written = cut.put(_each(values, ROUTED).sortWithinPartitions("variant"))[1]
    nodes = written.where("record_key IS NOT NULL").drop("is_map", "keys", "states")
    states = written.where("record_key IS NULL").select("variant", "is_map", "keys", "states").distinct()
    return nodes, states


def flatten_objects(values: DataFrame) -> DataFrame:
    """One row per JSON object, but not for a root object: the link columns of all variants' tables; see ``route``."""
    return route(values)[0].select("source_field", "record_key", "node_path", "parent_path")


def variants(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """Per field, role and variant its number of objects, its keys with the state of each, and the supertype's keys (common to all variants of the role)."""
    role = ["source_field", "role"]
    per = nodes.groupBy(*role, "variant").agg(F.count(F.lit(1)).alias("objects")).join(states, "variant")
    total = per.groupBy(*role).agg(F.count(F.lit(1)).alias("n_variants"))
    common = per.select(*role, F.explode("keys").alias("_k")).groupBy(*role, "_k").agg(F.count(F.lit(1)).alias("_in")).join(total, role).where("_in = n_variants")
    common = common.groupBy(*role).agg(F.array_sort(F.collect_set("_k")).alias("supertype_keys"))  # no more than the keys of one object
    return per.join(total, role).join(common, role, "left").withColumn("supertype_keys", F.coalesce("supertype_keys", F.array().cast("array<string>")))


def typed_objects(values: DataFrame) -> DataFrame:
    """The typed rows of all roles and variants: one row per object and scalar of its own, so no column list bounds it.

    Each has the object's keys and parent link, role, variant, the keys of the
    role's supertype, and of the scalar the field, its place in the field's
    arrays ('' outside of arrays), type, text and typed value (``whole``,
    ``number``, ``flag``).  Empty arrays are listed; an object without either
    has one row with a null field.  Integers beyond 64 bits have the type
    ``big`` and only their text.
    """
    nodes, states = route(values)
    supertype = Cut(values.sparkSession, "typed").put(variants(nodes, states).select("source_field", "role", "supertype_keys").distinct())[1]
    of = F.col("type")
    typed = _each(values, CELL).withColumn("whole", F.when(of == "int", F.col("value")).cast("long")).withColumn("number", F.when(of.isin("int", "num"), F.col("value")).cast("double")).withColumn("flag", F.when(of == "bool", F.col("value") == "true"))
    return typed.join(supertype, ["source_field", "role"])


#: Column types of the scalar states; every other state is kept as text.
_COLUMN = {"int": "decimal(38,0)", "num": "double", "bool": "boolean"}


def subtype_table(nodes: DataFrame, states: DataFrame, variant: str) -> DataFrame:
    """The typed table of one variant: keys and parent link, role, then a column per key of its shape that holds scalars.

    A key named as a column before it gets ``_`` behind its name.
    """
    own = ["source_field", "record_key", "node_path", "parent_path", "role"]
    shape = states.where((F.col("variant") == variant) & ~F.col("is_map")).first()  # one row
    known, taken, columns = set(_SCALARS), {x.lower() for x in own}, []
    for key, state in zip(shape.keys, shape.states) if shape else ():
        if state in known:
            name = key
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            columns.append(F.element_at("t", F.lit(key)).cast(_COLUMN.get(state, "string")).alias(name))
    return nodes.where(F.col("variant") == variant).select(*own, F.from_json("body", "map<string,string>").alias("t")).select(*own, *columns)


def role_table(values: DataFrame, role: str) -> DataFrame:
    """The typed table of one role with all fields that its values have: keys and parent link, variant, then a column per field.

    A field whose values have one type has that type, whole and other numbers
    together are doubles; mixed, long and array values are text.  A field named
    as a column before it gets ``_`` behind its name.
    """
    nodes = route(values)[0].where(F.col("role") == role)
    at = F.from_json("body", "map<string,string>")
    own = ["source_field", "record_key", "node_path", "parent_path", "variant"]
    # the types of the fields of the role's bodies; read from the bodies, since keys may hold the marks of a variant
    found = nodes.select("body").mapInArrow(_field_types, "field string, type string").distinct().groupBy("field").agg(F.collect_set("type").alias("types")).orderBy("field").collect()
    taken, columns = set(own), []
    for r in found:
        types, name = set(r.types) - {"null"}, r.field
        kind = {("int",): "long", ("num",): "double", ("int", "num"): "double", ("bool",): "boolean"}.get(tuple(sorted(types)), "string")
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        columns.append(F.element_at("t", F.lit(r.field)).cast(kind).alias(name))
    return nodes.select(*own, at.alias("t")).select(*own, *columns)


def _field_types(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        found = set()
        for body in batch.column(0).to_pylist():
            for k, x in json.loads(body, parse_int=_integer).items():
                found.add((k, "list" if isinstance(x, list) else next(t for _, _, t, _ in cells({k: x}))))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["field", "type"])


def history_values(spark: SparkSession, where: str) -> DataFrame:
    """The JSON columns of commits_analysis and hybrid_facts as (source_field, record_key, value)."""
    analysis, facts = table(spark, where, "commits_analysis"), table(spark, where, "hybrid_facts")

    def of(df: DataFrame, name: str, column: str, key) -> DataFrame:
        return df.select(F.lit(f"{name}.{column}").alias("source_field"), key.alias("record_key"), F.col(column).alias("value"))

    sha, row = commit_key(F.col("sha")), F.col("id").cast("string")
    parts = [of(analysis, "commits_analysis", c, sha) for c in ("raw_llm_json", "hotspots_json")] + [of(facts, "hybrid_facts", c, row) for c in ("serialized_fact", "timeline_json")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def p3_found(spark: SparkSession, where: str) -> DataFrame:
    return flatten_objects(history_values(spark, where))


def p3_variants(spark: SparkSession, where: str) -> DataFrame:
    """Every variant of every role: its objects, keys, child states and the keys of its supertype."""
    return variants(*route(history_values(spark, where)))


def p3_typed(spark: SparkSession, where: str) -> DataFrame:
    """The typed rows of every object of every role and variant."""
    return typed_objects(history_values(spark, where))


def p3_symbols(spark: SparkSession, where: str) -> DataFrame:
    """The typed table of the symbols inside hotspots."""
    return role_table(history_values(spark, where), "symbols")


def p3_evidence(spark: SparkSession, where: str) -> DataFrame:
    """The typed table of the evidence inside claims."""
    return role_table(history_values(spark, where), "evidence")
