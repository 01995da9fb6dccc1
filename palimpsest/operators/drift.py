"""Expected against actual state: temporal folds, drift and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import naming as N
from .relational import dominant
from .upserts import latest

PRESENT, ABSENT = "present", "absent"


def intended(changes: DataFrame, renames: DataFrame) -> DataFrame:
    """(key, expect, sha): the state that the changes up to now imply for every key.

    ``changes`` has key, at, sha, change_type; ``renames`` old_key, new_key,
    at, sha.  Within a commit additions and modifications come first, then
    renames (old absent, new present; a key that is both in one commit, as in a
    chain, ends absent), then removals, which do not count for a key that the
    same commit renamed away.  One keyed rank over all events, no ordered pass.
    """
    up = changes.where(F.col("change_type").isin("added", "modified", "renamed")).select("key", "at", "sha", F.lit(1).alias("phase"), F.lit(PRESENT).alias("expect"))
    new = renames.select(F.col("new_key").alias("key"), "at", "sha", F.lit(2).alias("phase"), F.lit(PRESENT).alias("expect"))
    old = renames.select(F.col("old_key").alias("key"), "at", "sha", F.lit(3).alias("phase"), F.lit(ABSENT).alias("expect"))
    gone = changes.where("change_type = 'removed'").join(renames.select(F.col("old_key").alias("key"), "sha"), ["key", "sha"], "left_anti")
    gone = gone.select("key", "at", "sha", F.lit(4).alias("phase"), F.lit(ABSENT).alias("expect"))
    events = up.unionByName(new).unionByName(old).unionByName(gone).where("key IS NOT NULL")
    return latest(events, ["key"], F.col("at").desc_nulls_last(), F.col("sha").desc_nulls_last(), F.col("phase").desc()).select("key", "expect", "sha")


def or_else(rows: DataFrame, fallback: DataFrame) -> DataFrame:
    """The rows, or the fallback where there are none; decided by the plan, without an action."""
    return rows.unionByName(fallback.where(~rows.exists()))


def symbol_drift(want: DataFrame, have: DataFrame) -> DataFrame:
    """(key, drift): missing, zombie or divergent keys.

    ``want`` has key, expect, name, path (unique by key), ``have`` key, name,
    path.  A key that is not there but whose (name, path) is counts as present.
    """
    places = have.select("name", "path", F.lit(True).alias("_placed")).distinct()
    there = have.select("key", F.struct("name", "path").alias("_have"))
    met = want.join(there, "key", "left").join(places, ["name", "path"], "left")
    drift = (
        F.when((F.col("expect") == PRESENT) & F.col("_have").isNull() & F.col("_placed").isNull(), "missing")
        .when((F.col("expect") == ABSENT) & F.col("_have").isNotNull(), "zombie")
        .when((F.col("expect") == PRESENT) & F.col("_have").isNotNull() & (~F.col("_have.name").eqNullSafe(F.col("name")) | ~F.col("_have.path").eqNullSafe(F.col("path"))), "divergent")
    )
    return met.select("key", drift.alias("drift")).where("drift IS NOT NULL")


def missing_edges(want: DataFrame, have: DataFrame, keys: DataFrame) -> DataFrame:
    """Wanted edges that are not there and have an end among ``keys`` (key)."""
    on = ["src", "dst", "edge_type"]
    gone = want.select(*on).distinct().join(have, on, "left_anti")
    ends = keys.select(F.col("key").alias("_k"), F.lit(True).alias("_s"))
    met = gone.join(ends.select(F.col("_k").alias("src"), "_s"), "src", "left").join(ends.select(F.col("_k").alias("dst"), F.col("_s").alias("_d")), "dst", "left")
    return met.where("_s OR _d").select(*on)


def zombie_edges(want: DataFrame, have: DataFrame, states: DataFrame) -> DataFrame:
    """Edges that touch a known key and are unwanted or have an absent end; ``states`` has key and expect."""
    on = ["src", "dst", "edge_type"]
    src = states.select(F.col("key").alias("src"), F.col("expect").alias("_s"))
    dst = states.select(F.col("key").alias("dst"), F.col("expect").alias("_d"))
    met = have.select(*on).distinct().join(want.select(*on).distinct().withColumn("_w", F.lit(True)), on, "left").join(src, "src", "left").join(dst, "dst", "left")
    touched = F.col("_s").isNotNull() | F.col("_d").isNotNull()
    return met.where(touched & (F.col("_w").isNull() | (F.col("_s") == ABSENT) | (F.col("_d") == ABSENT))).select(*on)


def unresolved_callers(calls: DataFrame, known: DataFrame, builtins: list[str]) -> DataFrame:
    """(caller, callee, n, severity) of calls to names that are not known.

    ``calls`` has caller and callee; ``known`` name.  Severity grows with the
    number of calls, log1p(n) / log1p(5) plus 0.1, at most 1; names in
    ``builtins`` (lower case) are left out.
    """
    lost = calls.join(known.select(F.col("name").alias("callee")).distinct(), "callee", "left_anti").where(~F.lower("callee").isin(builtins))
    counted = lost.groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("severity", F.least(F.lit(1.0), F.least(F.lit(1.0), F.log1p("n") / F.log1p(F.lit(5))) + 0.1))


def convention_drift(names: DataFrame, group: list[str]) -> DataFrame:
    """Per group the dominant convention, and the share of names in another one in percent; unknown conventions do not count."""
    styled = names.withColumn("_c", N.convention(F.col("name"))).where("_c <> 'unknown'")
    top = dominant(styled, group, "_c", N.CONVENTIONS)
    total = styled.groupBy(*group).agg(F.count(F.lit(1)).alias("relevant"))
    return total.join(top, group).select(*group, "dominant", "relevant", F.round(100 * (F.col("relevant") - F.col("n")) / F.col("relevant"), 4).alias("drift_percent"))


def style_drift(rows: DataFrame, group: list[str], style: str, declared: list[str]) -> DataFrame:
    """Per group the dominant style, and the share of rows in another one in percent."""
    top = dominant(rows, group, style, declared)
    total = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    return total.join(top, group).select(*group, "dominant", F.round(100 * (F.col("total") - F.col("n")) / F.col("total"), 4).alias("drift_percent"))


def fact_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, state) of new facts against old ones, met by id, else by (name, kind): added, modified, unchanged."""
    by_id = old.select("id", F.struct("hash").alias("_i"))
    by_name = old.groupBy("name", "kind").agg(F.min(F.struct("id", "hash")).alias("_n"))
    met = new.join(by_id, "id", "left").join(by_name, ["name", "kind"], "left")
    was = F.coalesce(F.col("_i.hash"), F.col("_n.hash"))
    there = F.col("_i").isNotNull() | F.col("_n").isNotNull()
    return met.select("id", F.when(~there, "added").when(was.eqNullSafe(F.col("hash")), "unchanged").otherwise("modified").alias("state"))


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, state) of two snapshots by key: added, removed, renamed, modified_both, modified_signature, modified_body; unchanged keys are left out."""
    a = old.select("key", F.struct("name", "signature_hash", "body_hash").alias("a"))
    b = new.select("key", F.struct("name", "signature_hash", "body_hash").alias("b"))
    signature, body = (~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("signature_hash", "body_hash"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a.name").eqNullSafe(F.col("b.name")), "renamed").when(signature & body, "modified_both").when(signature, "modified_signature").when(body, "modified_body")
    return a.join(b, "key", "full_outer").select("key", state.alias("state")).where("state IS NOT NULL")


def first_and_last(rows: DataFrame, key: str, position: str) -> DataFrame:
    """(key, introduced, resolved): the first and last position at which a finding was there; resolved is null while it is at the last position of all."""
    per = rows.groupBy(key).agg(F.min(position).alias("introduced"), F.max(position).alias("_last"))
    end = rows.agg(F.max(position)).scalar()
    return per.select(key, "introduced", F.when(F.col("_last") < end, F.col("_last") + 1).alias("resolved"))
