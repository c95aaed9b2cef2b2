"""Times are microseconds in a long; nothing here pretends they are dates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from presage.config import US_PER_DAY, US_PER_HOUR, US_PER_MIN


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wall_micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)")


def floor_to(t, width_us: int) -> Column:
    """Start of the left-closed window of ``width_us`` that holds ``t``, aligned to 0.

    ``pmod`` keeps negative times in the window below zero, where integer
    division would round towards it.
    """
    return _col(t) - F.pmod(_col(t), F.lit(width_us).cast("long"))


def days(t) -> Column:
    return _col(t) / F.lit(float(US_PER_DAY))


def day_bucket(t) -> Column:
    return F.floor(days(t)).cast("int")


def hour_bucket(t) -> Column:
    return F.floor(_col(t) / F.lit(float(US_PER_HOUR))).cast("int")


def minutes_between(later, earlier) -> Column:
    return (_col(later) - _col(earlier)) / F.lit(float(US_PER_MIN))
