"""Business-day windows and the guards of an extract."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakemill.sources.adapters import ZONE_HOURS

LOOKBACK_MINUTES = 60
SETTLE_MINUTES = 5


@dataclass(frozen=True)
class Window:
    """One business day as UTC instants [start, end), read from a little earlier on."""

    day: date
    start: datetime
    end: datetime
    lookback: timedelta = timedelta(minutes=LOOKBACK_MINUTES)

    def predicate(self, cursor: str, mode: str) -> Column:
        """Bounds on the bare cursor column, so that they reach the scan."""
        below = F.col(cursor) < F.lit(self.end)
        if mode == "full":
            return F.lit(True)
        return below if mode == "bootstrap" else (F.col(cursor) >= F.lit(self.start - self.lookback)) & below


def day_window(day: date, lookback_minutes: int = LOOKBACK_MINUTES) -> Window:
    start = datetime(day.year, day.month, day.day) - timedelta(hours=ZONE_HOURS)
    return Window(day, start, start + timedelta(days=1), timedelta(minutes=lookback_minutes))


def business_date(start: datetime, end: datetime) -> date:
    """The day of an interval, which must be exactly one business day."""
    window = day_window((start + timedelta(hours=ZONE_HOURS)).date())
    if (window.start, window.end) != (start, end):
        raise ValueError(f"not one business day: {start} to {end}")
    return window.day


def ensure_closed(window: Window, now: datetime, settle_minutes: int = SETTLE_MINUTES) -> None:
    """Refuse a window that has not ended some minutes before ``now``, which must have a zone."""
    if now.tzinfo is None:
        raise ValueError("now must have a time zone")
    if window.end > now.astimezone(timezone.utc).replace(tzinfo=None) - timedelta(minutes=settle_minutes):
        raise ValueError(f"the window of {window.day} is not closed")


def effective_mode(cursor: str | None, requested: str) -> str:
    """Tables without a cursor are always extracted whole."""
    return requested if cursor else "full"
