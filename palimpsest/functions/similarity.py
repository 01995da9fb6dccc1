"""Similarities in [0, 1] and match scores, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import normal_signature

#: Length beyond which the edit distance gives way to the bigram measure.
LONG_TEXT = 2000


def edit(a: Column, b: Column) -> Column:
    """Normalised Levenshtein similarity; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise((longest - F.levenshtein(a, b)) / longest)


def bigrams(text: Column) -> Column:
    """Distinct character bigrams."""
    n = F.length(text)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: text.substr(i, F.lit(2)))))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of distinct bigrams; 1 where neither text has any."""
    x, y = bigrams(a), bigrams(b)
    both = F.size(x) + F.size(y)
    return F.when(both == 0, 1.0).otherwise(2 * F.size(F.array_intersect(x, y)) / both)


def text(a: Column, b: Column) -> Column:
    """Edit similarity, or the bigram measure where a text is long."""
    return F.when(F.greatest(F.length(a), F.length(b)) > LONG_TEXT, dice(a, b)).otherwise(edit(a, b))


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"[^A-Za-z0-9_]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of distinct words; 0 where a side has none."""
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def rename(kind: tuple[Column, Column], signature: tuple[Column, Column], name: tuple[Column, Column]) -> Column:
    """Confidence of a rename: kinds must agree (0.3), signatures alike (0.4), names similar (0.3 of it)."""
    same = F.when(normal_signature(signature[0]) == normal_signature(signature[1]), 0.4).otherwise(0.0)
    return F.when(kind[0] == kind[1], F.least(F.lit(1.0), 0.3 + same + F.when(name[0] != name[1], 0.3 * edit(*name)).otherwise(0.0))).otherwise(0.0)


def move(name: tuple[Column, Column], kind: tuple[Column, Column], signature: tuple[Column, Column], language: tuple[Column, Column]) -> Column:
    """Confidence of a move: same name and kind 0.5, signature equal 0.4 or similar 0.3, same language 0.1."""
    sig = F.when(signature[0] == signature[1], 0.4).when(edit(*signature) > 0.8, 0.3).otherwise(0.0)
    return F.when((name[0] == name[1]) & (kind[0] == kind[1]), 0.5).otherwise(0.0) + sig + F.when(language[0] == language[1], 0.1).otherwise(0.0)


def path(a: Column, b: Column) -> Column:
    """Leading path segments in common, over the longer path's number."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1) / F.size(same)


def move_reason(source: Column, target: Column, score: Column) -> Column:
    """Why a block moved, by the two file paths."""
    shared = r"(?i)(^|/)(utils|helpers|lib|common|shared)/"
    name = [F.substring_index(p, "/", -1) for p in (source, target)]
    return F.when((name[0] == name[1]) & (source != target), "file_rename").when(target.rlike(shared) & ~source.rlike(shared), "extraction").when(score >= 0.95, "refactoring").otherwise("unclear")
