"""Dependency graphs as edge tables: neighbourhoods, reachability, components.

Frontier loops join the edges with the current frontier only, cut the plan
after every round by a written table, and stop when nothing new is reached.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Cut
from .lookup import skew_lookup


#: Rounds of a frontier loop after which the parts found so far are written as one.
FOLD = 8


def neighbours(edges: DataFrame, node, calls: str, imports: str, cap: int) -> DataFrame:
    """(direction, neighbour) of one node: what it calls, what calls it and what it imports; distinct, at most ``cap`` per direction (a display limit)."""

    def side(edge_type: str, at: str, to: str, name: str) -> DataFrame:
        found = edges.where((F.col("edge_type") == edge_type) & (F.col(at) == node)).select(F.lit(name).alias("direction"), F.col(to).alias("neighbour")).distinct()
        return found.orderBy("neighbour").limit(cap)

    return side(calls, "src", "dst", "calls").unionByName(side(calls, "dst", "src", "called_by")).unionByName(side(imports, "src", "dst", "imports"))


def blast_radius(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, callers, callees): distinct direct callers and callees of each changed node, 0 where there are none."""
    callers = edges.join(changed.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("callers"))
    callees = edges.join(changed.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("callees"))
    return changed.select("id").distinct().join(callers, "id", "left").join(callees, "id", "left").na.fill(0, ["callers", "callees"])


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, directed: bool = True) -> DataFrame:
    """(node, depth): nodes reached from the roots and the least number of steps, roots at 0.

    ``edges`` has src and dst, ``roots`` node; null ends reach nothing.
    """
    cut = Cut(edges.sparkSession, "reach")
    links = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    if not directed:
        links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = cut.put(links.distinct())[1]
    frontier, counts = cut.put_counted(roots.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)), n=F.count(F.lit(1)))
    seen, depth = [frontier], 0
    while (max_depth is None or depth < max_depth) and counts["n"]:
        depth += 1
        known = seen[0]
        for part in seen[1:]:
            known = known.unionByName(part)
        step = links.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier, counts = cut.put_counted(step.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), n=F.count(F.lit(1)))
        seen.append(frontier)
        if len(seen) > FOLD:  # few parts to read, however deep the graph is
            every = seen[0]
            for part in seen[1:]:
                every = every.unionByName(part)
            seen = [cut.put(every)[1]]
    out = seen[0]
    for part in seen[1:]:
        out = out.unionByName(part)
    return out


#: Node numbers of one bucket: no more callers of a node are sorted together, however many it has.
BUCKET = 4096


def reverse_index(edges: DataFrame, size: int) -> DataFrame:
    """(node, part, incoming): callers of each node in sorted arrays of at most ``size``, so no array grows with a hub.

    Nodes are numbers.  A caller's rank is its rank in its bucket of numbers
    and the callers in the buckets before.
    """
    pairs = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct().withColumn("_b", F.floor(F.col("src") / BUCKET))
    ahead = W.partitionBy("dst").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    before = pairs.groupBy("dst", "_b").agg(F.count(F.lit(1)).alias("_n")).select("dst", "_b", (F.sum("_n").over(ahead) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("dst", "_b").orderBy("src")) - 1
    parts = pairs.withColumn("_in", inside).join(before, ["dst", "_b"]).withColumn("part", F.floor((F.col("_before") + F.col("_in")) / size))
    return parts.groupBy(F.col("dst").alias("node"), "part").agg(F.sort_array(F.collect_list("src")).alias("incoming"))


def weighted_neighbourhood(edges: DataFrame, roots: DataFrame, confidence: str, max_depth: int = 3) -> DataFrame:
    """(node, weight): undirected neighbourhood, each edge into a node at depth d from depth d - 1 adding confidence / (d + 1)."""
    depths = Cut(edges.sparkSession, "near").put(reach(edges, roots, max_depth, directed=False))[1]
    both = edges.select("src", "dst", F.col(confidence).alias("c")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col(confidence).alias("c")))
    a = depths.select(F.col("node").alias("src"), F.col("depth").alias("d0"))
    b = depths.select(F.col("node").alias("dst"), F.col("depth").alias("d1"))
    met = both.join(a, "src").join(b, "dst").where("d1 = d0 + 1")
    return met.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("c") / (F.col("d1") + 1)).alias("weight"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node is connected with, over undirected edges.

    Alternating large-star and small-star rounds, which need a logarithmic
    number of rounds on any graph and no round gathers a node's neighbours:
    each takes one minimum per node (combined on the map side) and rewrites
    the edges.
    """
    cut = Cut(edges.sparkSession, "components")
    now = cut.put(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())[1]
    nodes = cut.put(now.select(F.col("src").alias("node")).unionByName(now.select(F.col("dst").alias("node"))).distinct())[1]
    now = now.where("src <> dst")

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        if not large:  # each node with its lesser neighbours only
            both = both.where("dst < src")
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        met = skew_lookup(both, "src", least, both.count())
        moved = met.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")) if large else met.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(least.select("src", F.col("m").alias("dst")))
        return moved.where("src <> dst").distinct()

    mark = None
    while True:
        now = cut.put(star(now, True))[1]
        now = cut.put(star(now, False))[1]
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(sign) == mark:
            break
        mark = tuple(sign)
    return nodes.join(now.select(F.col("src").alias("node"), F.col("dst").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def resolve_ends(edges: DataFrame, symbols: DataFrame, end: str) -> DataFrame:
    """Edges with ``end`` resolved to a symbol id: by id, else by a unique name, else by a unique (name, kind), else ``unknown:``.

    ``symbols`` has id, name and kind; the edge's end is an id or a name, and
    ``end_kind`` its kind or null.
    """
    ids = symbols.select(F.col("id").alias(end), F.col("id").alias("_by_id")).distinct()
    names = symbols.groupBy(F.col("name").alias(end)).agg(F.min("id").alias("_by_name"), F.countDistinct("id").alias("_k")).where("_k = 1").drop("_k")
    kinds = symbols.groupBy(F.col("name").alias(end), F.col("kind").alias("end_kind")).agg(F.min("id").alias("_by_kind"), F.countDistinct("id").alias("_k")).where("_k = 1").drop("_k")
    met = edges.join(ids, end, "left").join(names, end, "left").join(kinds, [end, "end_kind"], "left")
    return met.withColumn(end, F.coalesce("_by_id", "_by_name", "_by_kind", F.concat(F.lit("unknown:"), F.col(end)))).drop("_by_id", "_by_name", "_by_kind")


# Words that make a symbol an entry point, by where they stand.
ACCESSORS = ["get", "set", "is", "has", "can"]
STARTS = ["main", "run", "start", "init", "setup", "bootstrap", "create", "build"]
HANDLES = ["handle", "process", "execute", "render", "mount", "unmount", "destroy"]
SERVES = ["controller", "service", "provider", "component", "view", "page"]
SERVING_PATHS = ["controller", "service"]
ENTRY_PATHS = ["controller", "route", "middleware", "bootstrap", "app.", "main.", "index."]


def _any(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def entry_point(name: Column, kind: Column, path: Column, fan_in: Column, fan_out: Column, exported: Column) -> Column:
    """Whether a symbol is an entry point; the first rule that applies decides.

    An accessor outside of controllers and services is none; a function that
    starts, handles or reacts (``onX``), a class that serves, and whatever lies
    where programs begin is one; else an exported symbol that nothing calls and
    that calls something.  Null parts apply to no rule.
    """
    small, where = F.lower(name), F.lower(path)
    begins = reduce(Column.__or__, [name.rlike(f"^{w}[A-Z]") for w in ACCESSORS])
    rules = [
        (begins & ~_any(where, SERVING_PATHS), F.lit(False)),
        (kind.isin("function", "method") & (small.isin(STARTS) | name.rlike("^on[A-Z]") | _any(small, HANDLES)), F.lit(True)),
        ((kind == "class") & _any(small, SERVES), F.lit(True)),
        (_any(where, ENTRY_PATHS), F.lit(True)),
    ]
    decided = reduce(lambda out, rule: F.coalesce(out, F.when(rule[0], rule[1])), rules, F.lit(None).cast("boolean"))
    return F.coalesce(decided, exported & (fan_in == 0) & (fan_out > 0), F.lit(False))


def dag_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): rounds after which each node's predecessors are all done (Kahn's levels); nodes on or behind a cycle have none."""
    cut = Cut(edges.sparkSession, "levels")
    links = cut.put(edges.select("src", "dst").distinct())[1]
    rest = cut.put(nodes.select("node").distinct())[1]
    done, level = None, 0
    while True:
        open_links = links.join(rest.select(F.col("node").alias("src")), "src", "left_semi")
        ready = cut.put(rest.join(open_links.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)))[1]
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        rest = cut.put(rest.join(ready.select("node"), "node", "left_anti"))[1]
        level += 1
    return done if done is not None else rest.withColumn("level", F.lit(0))
