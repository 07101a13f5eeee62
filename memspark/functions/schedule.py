"""Daily slots in a time zone: when a nightly run is due. A handful of numbers, so plain Python."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

DAY = 86_400_000


def clock(schedule: str) -> tuple[int, int]:
    """(hour, minute) of HH:MM."""
    if not re.fullmatch(r"(?:[01][0-9]|2[0-3]):[0-5][0-9]", schedule):
        raise ValueError(f"not a time of day: {schedule!r} (HH:MM)")
    hour, minute = schedule.split(":")
    return int(hour), int(minute)


def slot(date: datetime, schedule: str, zone: str) -> int:
    """The instant (epoch milliseconds) of the slot on that date. A time that comes twice means the first; one that is skipped, the first moment after the gap."""
    hour, minute = clock(schedule)
    tz = ZoneInfo(zone)
    local = datetime(date.year, date.month, date.day, hour, minute, tzinfo=tz)
    at = local.astimezone(UTC)
    if at.astimezone(tz).replace(tzinfo=None) != local.replace(tzinfo=None):
        # In a gap both readings of the wall clock miss it by the gap's length; the change lies between them.
        low, high = sorted((at, local.replace(fold=1).astimezone(UTC)))
        while high - low > timedelta(minutes=1):
            middle = low + (high - low) / 2
            before = middle.astimezone(tz).replace(tzinfo=None) < local.replace(tzinfo=None)
            low, high = (middle, high) if before else (low, middle)
        at = high.replace(second=0, microsecond=0)
    return round(at.timestamp() * 1000)


def today(now: int, zone: str) -> datetime:
    return datetime.fromtimestamp(now / 1000, ZoneInfo(zone))


def next_slot(now: int, schedule: str, zone: str) -> int:
    """The first slot after now."""
    date = today(now, zone)
    while (at := slot(date, schedule, zone)) <= now:
        date = datetime(date.year, date.month, date.day) + timedelta(days=1)
    return at


def due(now: int, schedule: str, zone: str, last_run: int | None) -> bool:
    """Whether today's slot has passed and no run was recorded since: each slot fires once, and a long pause is made up for once."""
    at = slot(today(now, zone), schedule, zone)
    return now >= at and (last_run is None or last_run < at)
