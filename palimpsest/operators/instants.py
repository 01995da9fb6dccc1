"""Timestamps of many notations and zones as one UTC instant.

A text is reduced to its shape mask (digits to 9, ASCII letters to A; a JVM
translate), so all texts of one mask have their parts at the same positions.
Each distinct mask is mapped to a parser once per worker, and all texts of the
mask are converted together from a matrix of their characters, with local
times going through versioned zone transition tables.
"""

from __future__ import annotations

import functools
import re
import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import strip
from ..functions.zones import ABBREVIATIONS, local_to_utc, transitions, zone_version
from ..sources.tables import commit_rows, table

CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$"
#: Masks kept per worker; any further one is parsed again, with the same result.
MASKS = 50_000

# English month names; abbreviations are their first three letters.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_MONTH = {n: i + 1 for i, m in enumerate(MONTHS) for n in (m, m[:3])} | {"sept": 9}

_ZONE = r"(?: ?(?P<abbr>A{3,5}|A))?(?: ?(?P<sign>[+-])(?P<oh>99)(?::?(?P<om>99))?)?(?: ?\[(?P<region>[A9/_+-]+)\])?(?: \([A ]+\))?"
_CLOCK = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?(?: (?P<ap>AA)(?!A))?"
_DAY = r"(?:A{3,9},? )?"
_FORMS = [
    re.compile(x + "$")
    for x in (
        r"(?P<Y>9999)-(?P<m>99)-(?P<d>99)(?:(?P<t>A)| )" + _CLOCK + _ZONE,
        r"(?P<Y>9999)(?P<m>99)(?P<d>99)(?:(?P<t>A)| )(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9+))?)?" + _ZONE,
        r"(?P<e>9{16}|9{13}|9{10})(?: ?[+-]99:?99)?",
        r"(?P<d>99?)\.(?P<m>99?)\.(?P<Y>9999),? " + _CLOCK + _ZONE,
        r"(?P<m>99?)/(?P<d>99?)/(?P<Y>9999),? " + _CLOCK + _ZONE,
        _DAY + r"(?P<d>99?) (?P<b>A{3,9}),? (?P<Y>9999),? " + _CLOCK + _ZONE,
        _DAY + r"(?P<b>A{3,9}) {1,2}(?P<d>99?),? (?P<Y>9999),? " + _CLOCK + _ZONE,
        _DAY + r"(?P<b>A{3,9}) {1,2}(?P<d>99?) (?P<H>99):(?P<M>99):(?P<S>99)(?: (?P<abbr>A{3,5}))? (?P<Y>9999)(?: (?P<sign>[+-])(?P<oh>99):?(?P<om>99))?",
    )
]


@functools.lru_cache(maxsize=MASKS)
def parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """Where each part of a notation lies; None if the mask is of no known notation."""
    for form in _FORMS:
        if m := form.match(mask):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


def shorten(texts: list[str], plan: dict[str, tuple[int, int]]) -> tuple[list[str], dict[str, tuple[int, int]]]:
    """Texts and plan without finer digits than microseconds and without what follows the last part, so that no character matrix is wide."""
    last = max(b for _, b in plan.values())
    a, b = plan.get("f", (last, last))
    cut = max(0, b - a - 6)
    moved = {k: (x - cut, y - cut) if x >= b else (x, min(y, a + 6)) if k == "f" else (x, y) for k, (x, y) in plan.items()}
    return [t[: b - cut] + t[b:last] for t in texts], moved


def _words(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    part = np.ascontiguousarray(chars[:, span[0] : span[1]])
    return part.view(f"U{span[1] - span[0]}").ravel()


def _look_up(words: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words through ``table`` (a function giving None for no such word), each distinct word once."""
    known, at = np.unique(words, return_inverse=True)
    found = [table(str(w)) for w in known]
    good = np.array([x is not None for x in found])[at]
    return np.array([0 if x is None else x for x in found], dtype=np.int64)[at], good


def convert(texts: list[str], zones: np.ndarray, plan: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds, valid) of texts of one mask; ``zones`` has each row's default zone or None."""
    width = len(texts[0])
    chars = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
    good = np.ones(len(texts), dtype=bool)

    def number(part: str) -> np.ndarray:
        a, b = plan[part]
        return (chars[:, a:b].astype(np.int64) - 48) @ (10 ** np.arange(b - a - 1, -1, -1, dtype=np.int64))

    if "e" in plan:
        a, b = plan["e"]
        return number("e") * {10: 1_000_000, 13: 1_000, 16: 1}[b - a], good
    if "t" in plan:
        good &= np.isin(chars[:, plan["t"][0]], [ord("T"), ord("t")])
    year, day, hour, minute = number("Y"), number("d"), number("H"), number("M")
    if "b" in plan:
        month, ok = _look_up(_words(chars, plan["b"]), lambda w: _MONTH.get(w.lower()))
        good &= ok
    else:
        month = number("m")
    second = number("S") if "S" in plan else np.zeros_like(year)
    micro = np.zeros_like(year)
    if "f" in plan:
        a, b = plan["f"]
        used = min(b - a, 6)
        micro = (chars[:, a : a + used].astype(np.int64) - 48) @ (10 ** np.arange(5, 5 - used, -1, dtype=np.int64))
    if "ap" in plan:
        half, ok = _look_up(_words(chars, plan["ap"]), lambda w: {"AM": 0, "PM": 12}.get(w.upper()))
        good &= ok & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + half
    good &= (year >= 1) & (month >= 1) & (month <= 12) & (hour <= 23) & (minute <= 59) & (second <= 59)
    months = (year - 1970) * 12 + np.clip(month, 1, 12) - 1
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    after = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    good &= (day >= 1) & (day <= after - first)
    local = ((((first + day - 1) * 24 + hour) * 60 + minute) * 60 + second) * 1_000_000 + micro

    if "sign" in plan:
        oh, om = number("oh"), number("om") if "om" in plan else np.zeros_like(year)
        good &= (oh <= 18) & (om <= 59)
        sign = np.where(chars[:, plan["sign"][0]] == ord("-"), -1, 1)
        return local - sign * (oh * 60 + om) * 60_000_000, good
    if "region" in plan:
        zones = _words(chars, plan["region"]).astype(object)
    elif "abbr" in plan:
        minutes, ok = _look_up(_words(chars, plan["abbr"]), lambda w: ABBREVIATIONS.get(w.upper()))
        return local - minutes * 60_000_000, good & ok
    utc = np.zeros_like(local)
    codes, names = pd.factorize(zones)
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(names) + 1))
    good &= codes >= 0  # no zone
    for k, zone in enumerate(names):
        at = order[bounds[k] : bounds[k + 1]]
        at = at[good[at]]
        there = local_to_utc(local[at], zone) if len(at) else local[at]
        if there is None:
            good[at] = False
        else:
            utc[at] = there
    return utc, good


def to_utc_us(values: pd.Series, masks: pd.Series, zones: pd.Series) -> pd.Series:
    """Microseconds since 1970 UTC; null where a text denotes no instant."""
    out = np.zeros(len(values), dtype=np.int64)
    good = np.zeros(len(values), dtype=bool)
    codes, distinct = pd.factorize(masks)
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(distinct) + 1))
    texts, zone = values.to_numpy(dtype=object), zones.where(zones.notna(), None).to_numpy(dtype=object)
    for k, mask in enumerate(distinct):
        plan = parser_of(mask) if isinstance(mask, str) else None
        if plan is not None:
            rows = order[bounds[k] : bounds[k + 1]]
            short, moved = shorten(list(texts[rows]), plan)
            out[rows], good[rows] = convert(short, zone[rows], moved)
    return pd.Series(pd.array(np.where(good, out, 0), dtype="Int64")).mask(~good)


_udf = F.pandas_udf(to_utc_us, T.LongType())


def shape_mask(c: Column) -> Column:
    return F.translate(c, string.digits + string.ascii_letters, "9" * 10 + "A" * 52)


def utc_us(c: Column, zone: Column) -> Column:
    """The instant of a text; ``zone`` (IANA name or null) is for texts that name none.

    Null, blank and unreadable texts, impossible dates and times, unknown zones
    and a missing zone give null.
    """
    text = strip(c)
    return _udf(text, shape_mask(text), zone)


def normalise(rows: DataFrame) -> DataFrame:
    """(field_name, row_key, utc_us) of rows (field_name, row_key, value, zone) that denote an instant and are not canonical yet.

    Copies of a row come out once.
    """
    odd = rows.where(F.col("value").isNotNull() & ~F.col("value").rlike(CANONICAL))
    return odd.select("field_name", "row_key", utc_us(F.col("value"), F.col("zone")).alias("utc_us")).where("utc_us IS NOT NULL").distinct()


def history_times(spark: SparkSession, where: str) -> DataFrame:
    """The textual times: commit dates (local to the author's zone), load times and creation times (UTC)."""
    commits = commit_rows(table(spark, where, "commits_metadata"), "author", "date", "loaded_at")
    zones = table(spark, where, "author_zones").groupBy("author").agg(F.min("tz").alias("zone"))
    dates = commits.where(~F.col("date").rlike(CANONICAL)).join(zones, "author", "left")  # broadcast by Spark only below its size threshold

    def of(df: DataFrame, name: str, key: Column, value: str, zone: Column) -> DataFrame:
        return df.select(F.lit(name).alias("field_name"), key.alias("row_key"), F.col(value).alias("value"), zone.alias("zone"))

    utc = F.lit("UTC")
    return (
        of(dates, "commits_metadata.date", F.col("sha"), "date", F.col("zone"))
        .unionByName(of(commits, "commits_metadata.loaded_at", F.col("sha"), "loaded_at", utc))
        .unionByName(of(table(spark, where, "symbol_history"), "symbol_history.created_at", F.col("id").cast("string"), "created_at", utc))
    )


def p5_found(spark: SparkSession, where: str) -> DataFrame:
    return normalise(history_times(spark, where))


def p5_masks(spark: SparkSession, where: str) -> DataFrame:
    """The distinct masks of each field, how often each occurs and how many of its texts denote an instant."""
    rows = history_times(spark, where).where("value IS NOT NULL")
    rows = rows.select("field_name", shape_mask(strip(F.col("value"))).alias("mask"), utc_us(F.col("value"), F.col("zone")).alias("utc_us"))
    return rows.groupBy("field_name", "mask").agg(F.count(F.lit(1)).alias("texts"), F.count("utc_us").alias("instants"))


def p5_zone_transitions(spark: SparkSession, where: str) -> DataFrame:
    """The transition tables in use for the authors' zones, with the version of the zone data."""

    def rows(it):
        for pdf in it:
            for name in pdf["tz"]:
                if (found := transitions(name)) is not None:
                    at, before, after = found
                    yield pd.DataFrame({"tz": name, "zone_version": zone_version(), "utc_us": at, "offset_before_us": before, "offset_after_us": after})

    names = table(spark, where, "author_zones").select("tz").where("tz IS NOT NULL").distinct()
    return names.mapInPandas(rows, "tz string, zone_version string, utc_us long, offset_before_us long, offset_after_us long")
