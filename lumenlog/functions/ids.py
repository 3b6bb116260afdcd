"""Deterministic ids, timestamps, JSON and small numeric helpers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def deterministic_id(prefix: str | None, *parts: Column) -> Column:
    digest = F.sha1(F.concat_ws("|", *parts))
    return F.concat(F.lit(f"{prefix}_"), digest) if prefix else digest


def signal_id(minute: Column, *dims: Column) -> Column:
    return deterministic_id("sig", iso_utc(minute), *dims)


def anomaly_id(anomaly_type: Column, minute: Column, *dims: Column) -> Column:
    return deterministic_id("anom", anomaly_type, iso_utc(minute), *dims)


def parse_timestamp(text: Column) -> Column:
    """ISO text with ``T`` or a space, with or without an offset; bad text gives null."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def ref_column(ref_time: Column | datetime | str | None) -> Column:
    """The moment a time-relative operator counts back from."""
    if ref_time is None:
        return F.current_timestamp()
    return ref_time if isinstance(ref_time, Column) else F.lit(ref_time).cast("timestamp")


def minutes_before(ts: Column, minutes: int) -> Column:
    return ts - F.expr(f"INTERVAL {int(minutes)} MINUTES")


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def json_map(text: Column) -> Column:
    """JSON object as a string map; anything else gives an empty map."""
    parsed = F.from_json(text, "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def fixed_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
