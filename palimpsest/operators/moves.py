"""Moved, renamed and replaced entities by similarity.

No operator compares all pairs: candidates meet by an equal hash of their
normalised text, an equal hash of their shape, or an equal key, and only those
are scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import similarity as M
from ..session import Cut
from .relational import first_n


def candidates(blocks: DataFrame, scope: str, least: float) -> DataFrame:
    """The best other place of each text block: a, b, source, target, score.

    ``blocks`` has doc_id, the scope column, file_path and text.  Equal
    normalised text in the scope scores 1; the two first blocks of a text
    suffice as targets, so copies do not multiply.  Different texts of equal
    shape in files of equal name, whatever the directory, score by their
    similarity, each text standing for all its copies under that name.
    Null texts match nothing, a block without path only equal ones; a block
    without partner gives no row.
    """
    side = blocks.where("text IS NOT NULL").select("doc_id", scope, "file_path", "text", H.body_hash(F.col("text"), 64).alias("body"), H.digest(H.shape(F.col("text"))).alias("shape"), F.substring_index("file_path", "/", -1).alias("_name"))
    side = Cut(blocks.sparkSession, "moves").put(side)[1]
    a = side.select(F.col("doc_id").alias("a"), scope, F.col("file_path").alias("source"), "body", "_name")
    first = first_n(side.select(F.col("doc_id").alias("b"), scope, F.col("file_path").alias("target"), "body"), 2, [scope, "body"], F.col("b"))
    equal = a.join(first, [scope, "body"]).where("a <> b").select("a", "b", "source", "target", F.lit(1.0).alias("score"))
    texts = first_n(side.where("_name IS NOT NULL"), 1, [scope, "body", "_name"], F.col("doc_id"))
    other = texts.select(scope, "shape", "_name", F.col("doc_id").alias("b"), F.col("file_path").alias("target"), F.col("text").alias("_text"), F.col("body").alias("_body"))
    alike = F.least(F.length("text"), F.length("_text")) >= least * F.greatest(F.length("text"), F.length("_text")) - 1e-6
    near = texts.select(scope, "shape", "_name", "body", "text").join(other, [scope, "shape", "_name"]).where("body <> _body").where(alike | (F.greatest(F.length("text"), F.length("_text")) > M.LONG_TEXT)).select(scope, "body", "_name", "b", "target", M.text(F.col("text"), F.col("_text")).alias("score")).where(F.col("score") >= least)
    best = first_n(near.withColumn("score", F.round("score", 6)), 1, [scope, "body", "_name"], F.col("score").desc(), F.col("b"))
    near = a.join(best, [scope, "body", "_name"]).select("a", "b", "source", "target", "score")
    return first_n(equal.unionByName(near), 1, ["a"], F.col("score").desc(), F.col("b"))


def lineage(symbols: DataFrame) -> DataFrame:
    """Symbols removed in one version and added in the next under the same identity: old_id, new_id, move_type."""
    old = symbols.where("change_type = 'removed'").select("dna", F.col("id").alias("old_id"), F.col("name").alias("_n"), F.col("path").alias("_p"), (F.col("pos") + 1).alias("pos"))
    new = symbols.where("change_type = 'added'").select("dna", F.col("id").alias("new_id"), "name", "path", "pos")
    kind = F.when(~F.col("_n").eqNullSafe(F.col("name")), "rename").when(~F.col("_p").eqNullSafe(F.col("path")), "relocate").otherwise("refactor")
    return old.join(new, ["dna", "pos"]).select("old_id", "new_id", kind.alias("move_type"))


def replacements(pairs: DataFrame, least: float = 0.6, lead: float = 0.2) -> DataFrame:
    """The clear replacement of each old symbol: score above ``least``, and alone or ahead of the second by more than ``lead``.

    Of 8 points the name gives 4 (1.5 and, as similar as it is, 2, where equal
    2.5), the kind 1, the path 1 (in the same directory 0.8, else 0.5), and the
    signature 2 (else 1 and as much of 0.5 as the numbers of parameters agree).
    """
    name = F.when(F.col("an") == F.col("bn"), 2.5).otherwise(2 * M.edit(F.col("an"), F.col("bn")))
    home = [F.regexp_extract(c, "^(.*/)?", 1) for c in ("pa", "pb")]
    place = F.when(F.col("pa") == F.col("pb"), 1.0).when(home[0] == home[1], 0.8).otherwise(0.5)
    n = [F.size(F.filter(F.split(F.regexp_extract(c, r"\(([^)]*)\)", 1), ","), lambda p: F.btrim(p) != "")) for c in ("sa", "sb")]
    signature = F.when(F.col("sa") == F.col("sb"), 2.0).when(n[0] == n[1], 1.5).otherwise(1 + 0.5 * F.least(*n) / F.greatest(*n, F.lit(1)))
    scored = pairs.select("a", "b", F.round((1.5 + name + 1 + place + signature) / 8, 6).alias("score")).where(F.col("score") > least)
    w = W.partitionBy("a").orderBy(F.col("score").desc(), "b")
    ranked = scored.withColumn("_second", F.lead("score").over(w)).withColumn("_rn", F.row_number().over(w))
    return ranked.where("_rn = 1").where(F.col("_second").isNull() | (F.col("score") > F.round(F.col("_second") + lead, 6))).select("a", "b", "score")


def divergent(names: DataFrame, least: float) -> DataFrame:
    """Identities under several similar names: dna, mean_similarity, consolidate.

    ``names`` has distinct (dna, name).  Only the names of one identity meet.
    """
    other = names.withColumnRenamed("name", "name2")
    pairs = names.join(other, "dna").where("name < name2").select("dna", M.edit(F.col("name"), F.col("name2")).alias("s"))
    mean = pairs.groupBy("dna").agg(F.avg("s").alias("m"))
    return mean.where(F.round("m", 6) > least).select("dna", F.round("m", 6).alias("mean_similarity"), (F.col("m") > 0.9).alias("consolidate"))


def name_clusters(rows: DataFrame, least: float) -> DataFrame:
    """Clusters of word sets whose Jaccard similarity is above ``least``: kind, words, cluster (its least member).

    Deterministic substitute of a greedy pass in input order: connected
    components over the similar pairs.  Candidates share kind and one of their
    rarest words (prefix filter: sets that similar must share one of their
    first n - ceil(least * n) + 1 words in any fixed order), so no group of all
    members is formed.
    """
    from .graphs import connected_components

    words = rows.select("kind", "words", F.array_distinct(F.split("words", " ")).alias("w")).where("words <> ''")
    freq = words.select("kind", F.explode("w").alias("word")).groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = words.select("kind", "words", F.size("w").alias("size"), F.explode("w").alias("word")).join(freq, ["kind", "word"])
    rank = F.row_number().over(W.partitionBy("kind", "words").orderBy("n", "word"))
    prefix = ranked.withColumn("_r", rank).where(F.col("_r") <= F.col("size") - F.ceil(F.col("size") * least) + 1).select("kind", "word", "words", "size")
    other = prefix.select("kind", "word", F.col("words").alias("words2"), F.col("size").alias("size2"))
    pairs = prefix.join(other, ["kind", "word"]).where("words < words2 AND least(size, size2) > greatest(size, size2) * " + str(least)).select("kind", "words", "words2").distinct()
    similar = pairs.where(M.jaccard(F.col("words"), F.col("words2")) > least)
    tag = F.concat_ws("\t", "kind", "words")
    edges = similar.select(tag.alias("src"), F.concat_ws("\t", "kind", "words2").alias("dst"))
    labels = connected_components(edges)
    return rows.where("words <> ''").join(labels.withColumnRenamed("node", "_t"), tag == F.col("_t"), "left").select("kind", "words", F.coalesce(F.substring_index("component", "\t", -1), "words").alias("cluster"))
