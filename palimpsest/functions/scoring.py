"""Scores, levels and flags, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of a hotspot's five measures.
WEIGHTS = {"frequency": 0.35, "recency": 0.2, "authors": 0.15, "intensity": 0.2, "burstiness": 0.1}
# Words in paths and names that raise a risk flag; they match anywhere, whatever the case.
RISK_WORDS = {
    "schema-migration": r"migration|schema|database|db|\.sql$|alter\s+table|create\s+table|drop\s+table",
    "security": "password|secret|token|auth|security|encrypt|decrypt|hash|ssl|tls|certificate|vulnerability|exploit",
    "performance": "performance|optimize|cache|memory|speed|latency|throughput|bottleneck|slow|fast",
    "auth": "auth|login|logout|session|user|permission|role|access",
    "payment": "payment|billing|invoice|charge|refund|stripe|paypal|checkout|transaction|money|currency",
}
# Words that mark control flow and interface lines of a diff.
CONTROL_FLOW = r"\b(if|while|for|switch|return|throw|catch|try|else|do|break|continue)\b"
INTERFACE = r"\b(function|class|interface|type|export|import|const\s+\w+\s*=|let\s+\w+\s*=|var\s+\w+\s*=)\b"
# Words and version marks of old namespaces.
OLD_WORDS = ["old", "legacy", "deprecated"]
OLD_MARKS = ["v1", "v2"]
_TITLES = "|".join(w.capitalize() for w in OLD_WORDS)
#: An old word or mark at the start whatever the case, a capitalised word at a part's start, or a directory or namespace of its own.
OLD_NAMESPACE = rf"^(?i:{'|'.join(OLD_WORDS + OLD_MARKS)})|(?:{_TITLES})(?:[A-Z]|$)|\\(?:{_TITLES})\\|/(?:{'|'.join(OLD_WORDS)})/"


def at_most(c: Column, bound: float) -> Column:
    """The value or the bound, if less; null stays null (``least`` alone would give the bound)."""
    return F.when(c.isNotNull(), F.least(c, F.lit(bound)))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """The value within its bounds; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def hotspot(frequency: Column, recency: Column, authors: Column, intensity: Column, burstiness: Column) -> Column:
    """Hotspot score from 0 to 100 of five measures in [0, 1], compressed by a logarithm."""
    raw = sum((c * WEIGHTS[n] for n, c in zip(WEIGHTS, (frequency, recency, authors, intensity, burstiness))), F.lit(0.0))
    return at_most(F.log10(1 + 9 * raw) * 100, 100.0)


def risk_level(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "medium").otherwise("low")


def recency(last: Column, as_of: Column) -> Column:
    """exp(-days / 30) since the last change."""
    return F.exp(-(F.unix_micros(as_of) - F.unix_micros(last)) / 86_400_000_000.0 / 30)


def risk_flag(flag: str, *texts: Column) -> Column:
    found = F.lit(False)
    for c in texts:
        found = found | F.coalesce(c.rlike(f"(?i){RISK_WORDS[flag]}"), F.lit(False))
    return found


def change_class(signature: Column, visibility: Column, annotation: Column) -> Column:
    """What kind of change: signature before visibility before annotation before body."""
    return F.when(signature, "signature").when(visibility, "visibility").when(annotation, "annotation").otherwise("body")


def structural_change(lines: Column, highlights: Column) -> Column:
    """min(lines / 10, 1), raised by the share of highlighted lines, at most 1."""
    return at_most(at_most(lines / 10, 1.0) * (1 + at_most(highlights / F.greatest(lines, F.lit(1)), 1.0)), 1.0)


def edge_confidence(edge_type: Column, known: Column) -> Column:
    return F.when(edge_type == "imports", 0.9).when((edge_type == "calls") & known, 0.7).when(edge_type == "calls", 0.3).otherwise(0.5)


def edge_threshold(edges: Column) -> Column:
    """Least confidence of an edge that counts: lower where there are few."""
    return F.when(edges < 50, 0.4).otherwise(0.7)


def health(issues: Column, symbols: Column, missing: Column, zombies: Column) -> Column:
    """Health from 0 to 100: share of symbols without issue, less penalties."""
    base = F.greatest(F.lit(0.0), 100 - 100 * F.coalesce(F.try_divide(issues, symbols), F.lit(0.0)))
    return clamp(base - 2 * missing - 0.5 * zombies, 0.0, 100.0)


def keyword_level(text: Column, levels: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The first level one of whose words the text holds, whatever the case."""
    out, lower = None, F.lower(text)
    for level, words in levels:
        held = lower.rlike("|".join(words))
        out = F.when(held, level) if out is None else out.when(held, level)
    return out.otherwise(otherwise)


# Words by which priority, effort and risk of an action are inferred.
PRIORITY = [("urgent", ["urgent", "critical", "breaking"]), ("high", ["high", "important", "missing"]), ("medium", ["medium", "moderate"])]
EFFORT = [("xl", ["complex", "large", "architectural"]), ("l", ["significant", "multiple"]), ("m", ["moderate", "several"]), ("s", ["simple", "single"])]
RISK = [("high", ["high risk", "dangerous", "breaking"]), ("medium", ["medium risk", "careful", "complex"])]
