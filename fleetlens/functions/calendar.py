"""Civil-time expressions over epoch seconds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
LOCAL_ZONE = "America/Argentina/Buenos_Aires"
PEAK_HOURS_UTC = [13, 14, 15, 16, 18, 19, 21, 22, 23]


def local_time(epoch_s: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(epoch_s), zone)


def local_hour(epoch_s: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.hour(local_time(epoch_s, zone))


def monday_weekday(epoch_s: Column, zone: str = LOCAL_ZONE) -> Column:
    """0 = Monday … 6 = Sunday."""
    return F.weekday(local_time(epoch_s, zone))


def day_angle(epoch_s: Column, zone: str = LOCAL_ZONE) -> Column:
    t = local_time(epoch_s, zone)
    hours = F.hour(t) + F.minute(t) / 60.0 + F.second(t) / 3600.0
    return hours * (2 * math.pi) / 24.0


def decode_hour(hour_sin: Column, hour_cos: Column) -> Column:
    """Hour 0..23 from its circle position; halves round away from zero."""
    h = F.atan2(hour_sin, hour_cos) * 24 / (2 * 3.14159265)
    return F.pmod(F.round(F.when(h < 0, h + 24).otherwise(h)).cast("int"), F.lit(24))


def utc_hour(epoch_s: Column) -> Column:
    return F.hour(F.timestamp_seconds(epoch_s))


def day_of(epoch_s: Column, offset_s: int = 0) -> Column:
    """Calendar date at a fixed offset from UTC."""
    return F.to_date(F.timestamp_seconds(epoch_s + F.lit(offset_s)))
