"""Column helpers for ratios, keys and business days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakemill.sources.adapters import ZONE_HOURS


def ratio(numerator: Column, denominator: Column, scale: int | None = None) -> Column:
    """Ratio of two sums at the grain of the query; null where the denominator is 0 or null.

    With a scale, halves go up by plain arithmetic on doubles, so that every engine rounds alike.
    """
    out = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return out if scale is None else F.floor(out * 10**scale + 0.5) / 10.0**scale


def local_time(ts: str) -> Column:
    return F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(ZONE_HOURS))


def local_date(ts: str) -> Column:
    return local_time(ts).cast("date")


def version_key(key: str, since: str) -> Column:
    """Surrogate key of a version: the text of the instant is fixed by a format."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.date_format(since, "yyyy-MM-dd HH:mm:ss.SSSSSS")))


def entity_key(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))
