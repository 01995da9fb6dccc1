"""Walks along one pointer per node: where they end, how far that is, and loops.

A table of links is contracted: branching nodes and one in ``SPACING`` of the
others become stops, every remaining node has at most one child and finds its
next stop by pointer doubling, and the stops alone are links of the same kind
again.  Leaves and chains go at every level, so the levels shrink by a constant
factor, all of them together cost a few passes over the rows, and no doubling
round ever looks up one node from two others, however hot a parent is.  What
fits into one task in the end is walked there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Cut
from .lookup import skew_lookup

#: One in so many nodes of a chain is a stop.
SPACING = 8
#: Links that one task walks to their end.
TASK_LINKS = 50_000

LINK = "node string, up string, ptr string, dist long, low string"
END = "node string, up string, root string, dist long"


def walk_all(links: dict[str, tuple[str, int, str]]) -> Iterator[tuple[str, str, int]]:
    """(node, end, distance) of every node of ``links`` (node -> pointer, weight, least node of the stretch); -1 and the loop's least node where a walk runs into a loop."""
    known: dict[str, tuple[str, int]] = {}
    for start in links:
        trail, place, x = [], {}, start
        while x in links and x not in known and x not in place:
            place[x] = len(trail)
            trail.append(x)
            x = links[x][0]
        if x in place:
            ring = trail[place[x] :]
            end = (min(links[y][2] for y in ring), -1)
        else:
            end = known.get(x, (x, 0))
        for y in reversed(trail):
            end = (end[0], -1 if end[1] < 0 else end[1] + links[y][1])
            known[y] = end
    for x, (end, far) in known.items():
        yield x, end, far


def _walk_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links, ups = {}, {}
    for b in batches:
        for node, up, ptr, dist, low in zip(*(b.column(i).to_pylist() for i in range(5))):
            links[node], ups[node] = (ptr, dist, low), up
    rows = [(x, ups[x], end, far) for x, end, far in walk_all(links)]
    if rows:
        types = [pa.string(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in END.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def follow(links: DataFrame, n: int, cut: Cut, spacing: int = SPACING, task_links: int = TASK_LINKS, level: int = 0) -> DataFrame:
    """(node, up, root, dist): the end of every node's walk and the weights summed up to it.

    ``links`` is a written table of ``n`` rows with node (unique), up (carried
    along), ptr (the next node; one without a row of its own ends the walk),
    dist (the weight of that step) and low (the least node of the stretch from
    node up to ptr, at first the node itself).  A walk that runs into a loop
    has the loop's least node and -1.
    """
    if n <= task_links:
        return cut.put(links.select("node", "up", "ptr", "dist", "low").coalesce(1).mapInArrow(_walk_task, END))[1]
    forks = links.groupBy(F.col("ptr").alias("_f")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_f")
    chosen = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(spacing)) == 0  # other ones at every level
    marked = links.join(forks, F.col("node") == F.col("_f"), "left").withColumn("stop", F.col("_f").isNotNull() | chosen).drop("_f")
    marked = cut.put(marked)[1]
    inner, stops = marked.where("NOT stop").drop("stop"), marked.where("stop").drop("stop")

    def onward(open_: DataFrame, targets: DataFrame, how: str) -> DataFrame:
        """Every pointer one stretch further: both stretches added up."""
        to = targets.select(F.col("node").alias("_n"), F.col("ptr").alias("_p"), F.col("dist").alias("_d"), F.col("low").alias("_l"), F.col("done").alias("_e"))
        met = open_.drop("done").join(to, F.col("ptr") == F.col("_n"), how)
        return met.select("node", "up", F.coalesce("_p", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("_d", F.lit(0))).alias("dist"), F.least("low", "_l").alias("low"), F.coalesce("_e", F.lit(True)).alias("done"))

    def first(rows: DataFrame, targets: DataFrame) -> DataFrame:
        """As ``onward`` for pointers that many rows may share; one that finds no target stays."""
        to = targets.select(F.col("node").alias("ptr"), F.col("ptr").alias("_p"), F.col("dist").alias("_d"), F.col("low").alias("_l"))
        met = skew_lookup(rows, "ptr", to, n)
        return met.select("node", "up", F.coalesce("_p", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("_d", F.lit(0))).alias("dist"), F.least("low", "_l").alias("low"))

    known = inner.select(F.col("node").alias("ptr"), F.lit(False).alias("_e"))
    flagged = skew_lookup(inner, "ptr", known, n).withColumn("done", F.coalesce("_e", F.lit(True))).drop("_e")
    step, counts = cut.put_counted(flagged, left=F.count_if(~F.col("done")))
    done, open_, left = [step.where("done")], step.where("NOT done"), counts["left"]
    while left:
        targets = open_
        for part in done:
            targets = targets.unionByName(part)
        step, counts = cut.put_counted(onward(open_, targets, "inner"), left=F.count_if(~F.col("done")))
        if counts["left"] == left:  # a walk that ends has some node just within reach of the end: only loops without a stop are left
            break
        done.append(step.where("done"))
        open_, left = step.where("NOT done"), counts["left"]
    ended = done[0]
    for part in done[1:]:
        ended = ended.unionByName(part)
    rings = _rings(open_, cut, onward) if left else None

    above, counts = cut.put_counted(first(stops, ended), all=F.count(F.lit(1)))
    far = follow(above, counts["all"], cut, spacing, task_links, level + 1)
    to = far.select(F.col("node").alias("ptr"), F.col("root").alias("_r"), F.col("dist").alias("_d"))
    met = skew_lookup(ended.drop("done", "low"), "ptr", to, n)
    out = met.select("node", "up", F.coalesce("_r", "ptr").alias("root"), F.when(F.col("_d") < 0, F.lit(-1)).otherwise(F.col("dist") + F.coalesce("_d", F.lit(0))).cast("long").alias("dist"))
    out = out.unionByName(far)
    return out if rings is None else out.unionByName(rings)


def _rings(open_: DataFrame, cut: Cut, onward) -> DataFrame:
    """Loops whose nodes are all without a stop: nothing else hangs on them.

    A node knows the least of its stretch.  When doubling changes it nowhere,
    the stretches of equal length that tile a loop all have the same least
    node, which is then the loop's.
    """
    while True:
        further = cut.put(onward(open_, open_, "inner"))[1]
        changed = further.join(open_.select("node", F.col("low").alias("_was")), "node").where("low <> _was")
        open_ = further
        if changed.isEmpty():
            return open_.select("node", "up", F.col("low").alias("root"), F.lit(-1).cast("long").alias("dist"))
