"""Normal forms of keys and paths, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space around a key.
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

FULL_SHA = 40


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def _real(k: Column) -> Column:
    """k, or null where it is blank or nothing but zeros."""
    return F.when(F.ltrim(k, F.lit("0")) != "", k)


def commit_key(c: Column) -> Column:
    """Lower-case, trimmed commit reference; null where it refers to nothing."""
    k = F.lower(strip(c))
    return F.when(~k.startswith("unknown:"), _real(k))


def dna_key(c: Column) -> Column:
    """Identity key: what follows the last colon; null where it refers to nothing."""
    k = F.lower(strip(c))
    return F.when(~k.startswith("unknown:"), _real(strip(F.substring_index(k, ":", -1))))


def norm_path(c: Column) -> Column:
    """Backslash as slash, repeated slashes as one, leading ``./`` dropped; case kept."""
    slashed = F.regexp_replace(F.translate(c, "\\", "/"), "/{2,}", "/")
    return F.regexp_replace(slashed, r"^(?:\./)+", "")


def norm_source(c: Column) -> Column:
    """Source label: trimmed, lower case, hyphen as underscore."""
    return F.translate(F.lower(strip(c)), "-", "_")
