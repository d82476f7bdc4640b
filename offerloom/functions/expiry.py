"""The three readings of an expiry string. Unparseable strings differ between them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?"


def instant(c: Column) -> Column:
    """Timestamp of a date or of an ISO instant, in UTC where it names no offset; null for anything else."""
    day = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(c, F.lit("T00:00:00Z")))
    text = day.when(c.rlike(_INSTANT + r"(Z|[+-]\d{2}:\d{2})$"), c).when(c.rlike(_INSTANT + "$"), F.concat(c, F.lit("Z")))
    return text.try_cast("timestamp")


def expires_at(c: Column) -> Column:
    """The last moment of a date; an instant as it is."""
    return instant(F.when(c.contains("T"), c).otherwise(F.concat(c, F.lit("T23:59:59.999Z"))))


def is_active(c: Column, as_of: Column) -> Column:
    """Not yet expired; without a readable expiry an offer stays active."""
    return F.coalesce(expires_at(c) >= as_of, F.lit(True))


def is_expired(c: Column, as_of: Column) -> Column:
    """Has a readable expiry in the past."""
    return F.coalesce(expires_at(c) < as_of, F.lit(False))


def is_expiring_soon(c: Column, as_of: Column, days: int = 14) -> Column:
    """From 0 to `days` days left, both ends included."""
    at = expires_at(c)
    return F.coalesce((at >= as_of) & (at <= as_of + F.expr(f"interval {days} days")), F.lit(False))
