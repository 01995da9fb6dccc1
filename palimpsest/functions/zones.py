"""Time-zone transition tables, with the version of the zone data they come from."""

from __future__ import annotations

import functools
import struct
from datetime import datetime, timedelta, timezone
from importlib import metadata, resources
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo

import numpy as np

#: The tables end with this year; later local times are converted one by one.
LAST_YEAR = 2100
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_SECOND = 1_000_000

# Zone abbreviations and their offset in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0,
    "BST": 60,
    "CET": 60, "CEST": 120,
    "EST": -300, "EDT": -240,
    "PST": -480, "PDT": -420,
    "IST": 330,
    "JST": 540,
    "AEST": 600, "AEDT": 660,
}


@functools.cache
def zone_version() -> str:
    try:
        return metadata.version("tzdata")
    except metadata.PackageNotFoundError:
        at = Path("/usr/share/zoneinfo/tzdata.zi")
        return at.open().readline().split()[-1] if at.exists() else "unknown"


def _decreed(name: str) -> list[int]:
    """The instants at which the zone file lists changes, in seconds."""
    files = [Path(at) / name for at in TZPATH]
    try:
        files.append(resources.files("tzdata.zoneinfo").joinpath(name))
    except ModuleNotFoundError:
        pass
    data = next(f.read_bytes() for f in files if f.is_file())

    def counts(at: int) -> tuple[int, ...]:
        return struct.unpack(">6l", data[at + 20 : at + 44])

    utc, std, leap, times, types, chars = counts(0)
    if data[4:5] < b"2":
        return list(struct.unpack(f">{times}l", data[44 : 44 + 4 * times]))
    at = 44 + times * 5 + types * 6 + chars + leap * 8 + std + utc  # the 64-bit part follows the 32-bit one
    times = counts(at)[3]
    return [x for x in struct.unpack(f">{times}q", data[at + 44 : at + 44 + 8 * times]) if x > -6e10]  # a first entry may stand for the beginning of time


@functools.cache
def transitions(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(instants, offsets before, offsets after) in microseconds; None for no zone.

    There is always one row, before the first change, whose offset holds before it.
    """
    try:
        zone = ZoneInfo(name)
    except Exception:  # unknown names, bad characters and directories all raise kinds of their own
        return None

    def offset(second: int) -> int:
        at = _EPOCH + timedelta(seconds=second)
        return round(at.astimezone(zone).utcoffset().total_seconds())

    known = _decreed(name)
    rows = [(known[0] - 1, offset(known[0] - 1), offset(known[0] - 1))] if known else [(0, offset(0), offset(0))]
    rows += [(at, offset(at - 1), offset(at)) for at in known]
    # behind the decreed changes a zone follows a yearly rule, whose periods are longer than a month
    month, at = 30 * 86_400, rows[-1][0]
    end = int((datetime(LAST_YEAR + 1, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    held = rows[-1][2]
    while at < end:
        then = at + month
        now = offset(then)
        if now != held:
            low, high = at, then
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == held else (low, mid)
            rows.append((high, held, now))
            held = now
        at = then
    table = np.array(rows, dtype=np.int64) * _SECOND
    return table[:, 0], table[:, 1], table[:, 2]


def local_to_utc(local_us: np.ndarray, name: str) -> np.ndarray | None:
    """UTC of local times: one that occurs twice is its first, a skipped one is read with the offset before the change."""
    table = transitions(name)
    if table is None:
        return None
    instants, before, after = table
    switch = instants + np.maximum(before, after)
    at = np.searchsorted(switch, local_us, side="right") - 1
    utc = local_us - np.where(at < 0, before[0], after[np.maximum(at, 0)])
    late = local_us >= _us(datetime(LAST_YEAR, 1, 1))
    if late.any():
        zone = ZoneInfo(name)
        distinct, back = np.unique(local_us[late], return_inverse=True)
        utc[late] = np.array([_us((datetime(1970, 1, 1) + timedelta(microseconds=int(x))).replace(tzinfo=zone)) for x in distinct], dtype=np.int64)[back]
    return utc


def _us(at: datetime) -> int:
    """Microseconds of an instant, or of a local time as if it were UTC."""
    if at.tzinfo is None:
        at = at.replace(tzinfo=timezone.utc)
    gone = at.replace(tzinfo=None) - datetime(1970, 1, 1) - at.utcoffset()
    return gone // timedelta(microseconds=1)
