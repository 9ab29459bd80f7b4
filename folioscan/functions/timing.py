"""Schedules, ages and small decisions, as columns over an injected clock."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def schedule(value: str | None) -> tuple[str, int, int]:
    """("interval", hours, 0) of "6h" or "6", ("time", hour, minute) of "05:30", else ("", 0, 0)."""
    text = (value or "").strip()
    if m := re.fullmatch(r"(\d+)\s*[hH]?", text):
        return "interval", int(m[1]), 0
    if (m := re.fullmatch(r"(\d{1,2}):(\d{1,2})", text)) and int(m[1]) < 24 and int(m[2]) < 60:
        return "time", int(m[1]), int(m[2])
    return "", 0, 0


def next_daily(now: Column, hour: int, minute: int) -> Column:
    """Epoch seconds of the next run at HH:MM, today or tomorrow."""
    at = F.floor(now / DAY) * DAY + hour * 3600 + minute * 60
    return F.when(at <= now, at + DAY).otherwise(at)


def expired(last: Column, now: Column, ttl_days: float) -> Column:
    """Older than the time to live; a time to live of 0 or less never ends."""
    return F.lit(False) if ttl_days <= 0 else (now - F.coalesce(last, F.lit(0.0))) > ttl_days * DAY


def age_label(ts: Column, now: Column) -> Column:
    """How long ago, in words; beyond a week the date."""
    age = now - ts
    return (
        F.when(age < 60, F.lit("今"))
        .when(age < 3600, F.concat(F.floor(age / 60).cast("string"), F.lit("分前")))
        .when(age < DAY, F.concat(F.floor(age / 3600).cast("string"), F.lit("時間前")))
        .when(age < 7 * DAY, F.concat(F.floor(age / DAY).cast("string"), F.lit("日前")))
        .otherwise(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd"))
    )


def keep_warm_due(last_search: Column, last_warm: Column, active: Column, now: Column, idle: float, interval: float) -> Column:
    return ((now - last_search) >= idle) & ((now - last_warm) >= interval) & (active <= 0)


def workers(active: Column, budget: int, most: int) -> Column:
    """Workers for one of several concurrent requests."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(budget) / F.greatest(active, F.lit(1))))).cast("bigint")


# Mounts of network shares.
NETWORK_MOUNTS = ("/mnt/", "/net/", "/Volumes/")


def wants_full_hash(path: Column, prefixes: tuple[str, ...] = (), extensions: tuple[str, ...] = ()) -> Column:
    from folioscan.functions.text import extension

    out = F.lit(False)
    for p in (*prefixes, *NETWORK_MOUNTS):
        out = out | F.startswith(path, F.lit(p))
    return out | extension(path).isin([e.lower() for e in extensions]) if extensions else out


def to_int(value: str | None, default: int, least: int | None = None) -> int:
    """Digits only; anything else is the default."""
    text = (value or "").strip()
    number = int(text) if text.isdigit() else default
    return default if least is not None and number < least else number


def to_float(value: str | None, default: float) -> float:
    try:
        return float((value or "").strip())
    except ValueError:
        return default


def to_bool(value: str | None, default: bool) -> bool:
    text = (value or "").strip().lower()
    return default if not text else text in ("1", "true", "yes", "on")
