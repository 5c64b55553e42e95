"""Times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return F.unix_millis(F.make_timestamp(year, month, day, hour, minute, second, F.lit("UTC")))


def parsed(value: Column) -> Column:
    """A timestamp from ISO text (UTC without a zone) or from an epoch in seconds down to nanoseconds."""
    number = value.try_cast("double")
    seconds = number
    for _ in range(4):
        seconds = F.when(F.abs(seconds) > 2e10, seconds / 1000).otherwise(seconds)
    return F.when(number.isNotNull(), F.timestamp_micros((seconds * 1_000_000).cast("long"))).otherwise(F.try_to_timestamp(value))


def valid_at(valid_to: Column, moment: Column) -> Column:
    """Whether a record is still open at a moment: not closed, or closed strictly later."""
    return valid_to.isNull() | (valid_to > moment)
