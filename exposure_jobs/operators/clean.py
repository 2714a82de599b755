"""Raw alert rows to canonical events: one projection, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def _blank(column: str) -> Column:
    return F.when(F.trim(F.col(column)) == "", None).otherwise(F.col(column))


def iso_utc(ts: Column) -> Column:
    """ISO 8601 with ``+00:00``; microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def alert_id(oblast, raion, hromada, level, started_at: Column, finished_at: Column) -> Column:
    """The first 16 hex digits of SHA-256 over the identifying fields; an open alert has an empty last field."""
    token = F.concat_ws("|", oblast, raion, hromada, level, iso_utc(started_at), F.coalesce(iso_utc(finished_at), F.lit("")))
    return F.substring(F.sha2(token.cast("binary"), 256), 1, 16)


def granularity_era(started_at: Column, level: Column, cutoff: str) -> Column:
    late = started_at >= F.lit(cutoff).cast("timestamp")
    return F.when(~late & (level == "oblast"), "oblast_dominant").when(late & level.isin("raion", "hromada"), "raion_dominant").otherwise("mixed")


def is_outlier(started_at, finished_at, days: int = 7) -> Column:
    """Longer than ``days``; exactly that long or still open is not."""
    length = F.unix_micros(finished_at) - F.unix_micros(started_at)
    return F.coalesce(length > days * DAY_US, F.lit(False))


def canonical_events(raw: DataFrame, era_cutoff: str = "2025-12-01 00:00:00", outlier_days: int = 7) -> DataFrame:
    """Text rows → typed events. Times without an offset are UTC, others are converted; a blank end is an open alert."""
    start, end = F.to_timestamp(_blank("started_at")), F.to_timestamp(_blank("finished_at"))
    raion, hromada = F.coalesce("raion", F.lit("")), F.coalesce("hromada", F.lit(""))
    level = F.col("level")
    return raw.select(
        alert_id(F.col("oblast"), raion, hromada, level, start, end).alias("alert_id"),
        "oblast",
        raion.alias("raion"),
        hromada.alias("hromada"),
        level.alias("admin_level"),
        start.alias("started_at"),
        end.alias("finished_at"),
        granularity_era(start, level, era_cutoff).alias("granularity_era"),
        is_outlier(start, end, outlier_days).alias("is_outlier_duration"),
        "source",
    )
