"""Parent-child links as full hierarchies.

Every node's component is found by following the parent links (``walks``), so
a component carries the name of its root, or of the least node of its loop.
Components are co-located, each whole in one partition, and walked one after
the other by an iterative depth-first traversal with node colours, which gives
depths, subtree intervals, paths and back edges.  A component that no task
should hold is walked by its Euler tour instead: the links of the depth-first
order itself (down to the first child, on to the next sibling, back up), which
``walks`` adds up without gathering them.  Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import FULL_SHA, commit_key
from ..session import Cut
from ..sources.tables import commit_rows, table
from . import walks
from .lookup import resolve_short, skew_lookup

#: The largest component that one task traverses, in nodes; a partition of small components holds about BIN_NODES.
MAX_COMPONENT = 200_000
BIN_NODES = 50_000
#: Nodes of a path block: a path is told from the last depth that this number divides.
PATH_BLOCK = 64
#: Rows per Arrow batch that goes back to the JVM.
OUT_ROWS = 5_000

TREE = "node string, root string, depth long, pre long, last long, n_descendants long, path string, path_after string, back_edge boolean"
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in map(str.split, TREE.split(", "))])


def traverse(parents: dict[str, str | None], paths: bool = True) -> Iterator[tuple]:
    """Depth-first traversal of whole components with node colours, without recursion.

    First the parent links are walked from each white node: a grey node met
    again closes a loop.  The least node of a loop is its root (depth -1 for
    all its component), and the back edge is the link into it.  Then the trees
    are walked down from the roots, children in order, for intervals and
    paths.  Yields rows of ``TREE``; a loop's component has no intervals and no
    paths.
    """
    colour: set[str] = set()
    loop_of: dict[str, str] = {}
    back: set[str] = set()
    for start in parents:
        walk, place, x = [], {}, start
        while x is not None and x not in colour and x not in place:
            place[x] = len(walk)
            walk.append(x)
            x = parents[x]
        if x in place:
            ring = walk[place[x] :]
            least = min(ring)
            back.add(ring[ring.index(least) - 1])
            for y in ring:
                loop_of[y] = least
        end = loop_of.get(x) if x is not None else None
        for y in walk:
            colour.add(y)
            if end is not None and y not in loop_of:
                loop_of[y] = end
    children: dict[str, list[str]] = {}
    for x, p in parents.items():
        if x in loop_of:
            yield x, loop_of[x], -1, None, None, None, None, None, x in back
        elif p is not None:
            children.setdefault(p, []).append(x)
    for root in parents:
        if parents[root] is not None:
            continue
        clock, trail = 0, []
        stack: list[tuple[str, int]] = [(root, -1)]  # a node, and when it was entered if it is to be left
        while stack:
            x, begun = stack.pop()
            if begun < 0:
                stack.append((x, clock))
                clock += 1
                trail.append(x)
                stack.extend((c, -1) for c in sorted(children.get(x, ()), reverse=True))
                continue
            depth = len(trail) - 1
            block = depth - depth % PATH_BLOCK
            path, after = ("/".join(trail[block:]), trail[block - 1] if block else None) if paths else (None, None)
            yield x, root, depth, begun, clock - 1, clock - 1 - begun, path, after, False
            trail.pop()


def _walk(paths: bool):
    """Traverses the components of a partition sorted by root, holding one at a time."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            parents: dict[str, str | None] = {}
            now = None
            for b in it:
                for root, node, parent in zip(*(b.column(i).to_pylist() for i in range(3))):
                    if root != now:
                        yield from traverse(parents, paths)
                        parents, now = {}, root
                    parents[node] = parent
            yield from traverse(parents, paths)

        out: list[tuple] = []
        for row in rows():
            out.append(row)
            if len(out) >= OUT_ROWS:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return batches


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


def components(edges: DataFrame, cut: Cut) -> tuple[DataFrame, int]:
    """(node, parent, root, dist) of every node of ``edges`` (node unique, parent null or a node), and their number.

    A node whose walk over parents ends has its root and the steps to it; one
    whose walk runs into a loop has the loop's least node and -1.
    """
    base, counts = cut.put_counted(edges.select("node", "parent"), nodes=F.count(F.lit(1)), links=F.count("parent"))
    links = base.where("parent IS NOT NULL").select("node", F.col("parent").alias("up"), F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("dist"), F.col("node").alias("low"))
    walked = walks.follow(links, counts["links"], cut).select("node", F.col("up").alias("parent"), "root", "dist")
    roots = base.where("parent IS NULL").select("node", "parent", F.col("node").alias("root"), F.lit(0).cast("long").alias("dist"))
    last, out = cut.put(walked.unionByName(roots))
    cut.keep(last)
    return out, counts["nodes"]


def links(edges: DataFrame) -> DataFrame:
    """(node, parent) of raw links, as ``hierarchy`` takes them.

    Null nodes are left out; of several rows of a node the least parent counts;
    a parent that is no node is absent.  Further columns are ignored.
    """
    one = edges.where("node IS NOT NULL").groupBy("node").agg(F.min("parent").alias("parent"))
    known = one.select(F.col("node").alias("parent"), F.col("node").alias("known"))
    return skew_lookup(one, "parent", known, edges.count()).select("node", F.col("known").alias("parent"))


def _euler_links(nodes: DataFrame, n: int, cut: Cut) -> DataFrame:
    """Links of the Euler tours of trees (node, parent): each node is entered (``>``) and left (``<``); entering counts 1."""
    kids = nodes.where("parent IS NOT NULL").select("parent", "node")
    parts = max(1, n // BIN_NODES)
    placed = cut.put(kids.repartitionByRange(parts, "parent", "node").withColumn("part", F.spark_partition_id()))[1]
    # the next sibling within a sorted part; at its end the first node of the next part that has rows
    w = W.partitionBy("part").orderBy("parent", "node")
    heads = placed.groupBy("part").agg(F.min(F.struct("parent", "node")).alias("head")).withColumn("head", F.lead("head").over(W.orderBy("part")))  # a row per part
    following = placed.withColumn("_next", F.lead(F.struct("parent", "node")).over(w)).join(F.broadcast(heads), "part")
    following = following.withColumn("_next", F.coalesce("_next", "head"))
    sibling = following.select("node", F.when(F.col("_next.parent") == F.col("parent"), F.col("_next.node")).alias("sibling"))
    first = kids.groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("child"))
    known = nodes.select("node", "parent").join(first, "node", "left").join(sibling, "node", "left")
    enter, leave = F.concat("node", F.lit(">")), F.concat("node", F.lit("<"))
    down = known.select(enter.alias("node"), F.coalesce(F.concat("child", F.lit(">")), leave).alias("ptr"), F.lit(1).cast("long").alias("dist"))
    on = known.where("parent IS NOT NULL").select(leave.alias("node"), F.coalesce(F.concat("sibling", F.lit(">")), F.concat("parent", F.lit("<"))).alias("ptr"), F.lit(0).cast("long").alias("dist"))
    return down.unionByName(on).select("node", F.lit(None).cast("string").alias("up"), "ptr", "dist", F.col("node").alias("low"))


def _giant(marked: DataFrame, cut: Cut, paths: bool) -> DataFrame:
    """Rows of ``TREE`` of components (node, parent, root, dist, and their number of nodes ``_n``) that no task holds."""
    nodes, counts = cut.put_counted(marked, all=F.count(F.lit(1)))
    n = counts["all"]
    # a loop is opened at its least node, the root, so that its component is a tree for the tour
    opened = nodes.withColumn("parent", F.when((F.col("dist") >= 0) | (F.col("node") != F.col("root")), F.col("parent")))
    tour = cut.put(_euler_links(opened, n, cut))[1]
    ranked = cut.put(walks.follow(tour, 2 * n, cut))[1]
    side = F.substring("node", -1, 1)
    name = F.expr("substring(node, 1, length(node) - 1)")
    sums = ranked.select(name.alias("node"), F.when(side == ">", F.col("dist")).alias("_in"), F.when(side == "<", F.col("dist")).alias("_out"))
    sums = sums.groupBy("node").agg(F.max("_in").alias("_in"), F.coalesce(F.max("_out"), F.lit(0)).alias("_out"))
    pre = F.col("_n") - F.col("_in")
    every = nodes.join(sums, "node").select("node", "parent", "root", F.col("dist").alias("depth"), pre.alias("pre"), (pre + F.col("_in") - F.col("_out") - 1).alias("last"), (F.col("_in") - F.col("_out") - 1).alias("n_descendants"))
    every = cut.put(every)[1]
    # the link into the least node comes from the ancestor of its parent that lies right below it
    loops = every.where("depth < 0")
    ahead = loops.where("node = root").select("root", F.col("parent").alias("node"))  # a row per giant loop
    into = loops.join(F.broadcast(ahead), ["root", "node"]).select("root", F.col("pre").alias("_at"))
    ring = loops.where("parent = root").join(F.broadcast(into), "root").where("_at BETWEEN pre AND last").select("node", F.lit(True).alias("back_edge"))
    tree = F.col("depth") >= 0
    plain = every.select("node", "root", "depth", *(F.when(tree, F.col(c)).alias(c) for c in ("pre", "last", "n_descendants")), "parent").join(ring, "node", "left").withColumn("back_edge", F.coalesce("back_edge", F.lit(False)))
    none = F.lit(None).cast("string")
    if not paths:
        return plain.select("node", "root", "depth", "pre", "last", "n_descendants", none.alias("path"), none.alias("path_after"), "back_edge")
    told = _block_paths(every.where(tree).select("node", "parent", "depth"), n, cut)
    return plain.join(told, "node", "left").select("node", "root", "depth", "pre", "last", "n_descendants", "path", "path_after", "back_edge")


def _block_paths(nodes: DataFrame, n: int, cut: Cut) -> DataFrame:
    """(node, path, path_after) by doubling inside the path blocks; rounds are logarithmic in PATH_BLOCK."""
    head = F.col("depth") % PATH_BLOCK == 0
    state = cut.put(nodes.select("node", F.when(~head, F.col("parent")).alias("ptr"), F.when(head, F.col("parent")).alias("path_after"), F.col("node").alias("path")))[1]
    steps = 1
    while steps < PATH_BLOCK:
        to = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("_p"), F.col("path").alias("_path"), F.col("path_after").alias("_after"))
        met = skew_lookup(state, "ptr", to, n)
        state = cut.put(met.select("node", F.col("_p").alias("ptr"), F.coalesce("path_after", "_after").alias("path_after"), F.concat_ws("/", "_path", "path").alias("path")))[1]
        steps *= 2
    return state.select("node", "path", "path_after")


def hierarchy(edges: DataFrame, paths: bool = False, max_component: int = MAX_COMPONENT, intervals: bool = True) -> DataFrame:
    """Root, depth, subtree interval and path of every node; see ``TREE``.

    ``edges`` has unique ``node`` and ``parent`` (null at a root, else a node);
    ``links`` makes it so of any rows.
    The descendants of a node are exactly the nodes of the same root with
    ``pre`` in (its ``pre``, its ``last``].  ``path`` names the nodes from the
    last depth that PATH_BLOCK divides down to the node, and ``path_after`` the
    node above them (null from the root on): the full path is the full path of
    ``path_after`` and then ``path``.  A full path in every row would grow with
    depth times nodes.  In a component with a loop depth is -1, root is the
    loop's least node, interval and path are null, and ``back_edge`` marks the
    node whose parent link closes the loop at its root.  Components beyond
    ``max_component`` nodes go through their Euler tour, with the same rows;
    without ``intervals`` the tour is left out and these have only root and
    depth.  An empty table gives an empty one.
    """
    cut = Cut(edges.sparkSession, "hierarchy")
    labelled, n = components(edges, cut)
    giant = labelled.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_component)
    small = labelled
    if n > max_component:  # else no component can be that large
        giant = cut.put(giant)[1]
        # at most n / max_component components are that large
        labelled = labelled.join(F.broadcast(giant), "root", "left") if n // max_component <= 10_000 else skew_lookup(labelled, "root", giant, n)
        small = labelled.where("_n IS NULL")
    placed = small.select("root", "node", "parent").repartition(max(1, n // BIN_NODES), "root").sortWithinPartitions("root")
    walked = placed.mapInArrow(_walk(paths), TREE)
    if n <= max_component:
        return walked
    marked = labelled.where("_n IS NOT NULL")
    if intervals:
        return walked.unionByName(_giant(marked, cut, paths))
    none = F.lit(None)
    return walked.unionByName(marked.select("node", "root", F.col("dist").alias("depth"), *(none.cast("long").alias(c) for c in ("pre", "last", "n_descendants")), *(none.cast("string").alias(c) for c in ("path", "path_after")), none.cast("boolean").alias("back_edge")))


def commit_edges(spark: SparkSession, where: str) -> DataFrame:
    """(node, parent) of the Commit rows; a parent that is no commit of the table is null."""
    commits = table(spark, where, "commits_metadata")
    rows = commit_rows(commits, "parent").select(F.col("sha").alias("node"), commit_key(F.col("parent")).alias("ref"))
    nodes = rows.select(F.col("node").alias("sha"))
    full = resolve_short(rows, nodes)
    known = nodes.where(F.length("sha") >= FULL_SHA).select(F.col("sha").alias("ref"), F.col("sha").alias("parent"))
    names = known.unionByName(full.select("ref", F.col("full").alias("parent")))  # the two never share a ref
    return skew_lookup(rows, "ref", names, commits.count()).select("node", "parent")


def p4_found(spark: SparkSession, where: str) -> DataFrame:
    return hierarchy(commit_edges(spark, where), intervals=False).select(F.col("node").alias("sha"), F.col("root").alias("root_sha"), "depth")


def p4_tree(spark: SparkSession, where: str) -> DataFrame:
    """Path, depth, root, subtree interval and number of descendants of every commit, and the loops' back edges."""
    return hierarchy(commit_edges(spark, where), paths=True).withColumnsRenamed({"node": "sha", "root": "root_sha"})
