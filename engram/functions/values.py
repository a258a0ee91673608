"""Costs, preference maps, time ranges and timestamp text."""

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_cost(input_tokens: Column, output_tokens: Column, price_in: Column, price_out: Column) -> Column:
    return input_tokens / 1000 * price_in + output_tokens / 1000 * price_out


def set_key(mapping: Column, key: Column, value: Column) -> Column:
    """Map with one key set; an existing entry of that key is replaced."""
    kept = F.map_filter(F.coalesce(mapping, F.map_from_arrays(F.array(), F.array())), lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(key, value))


def set_keys(mapping: Column, changes: Column) -> Column:
    """Map with the entries of another set; existing entries of those keys are replaced."""
    kept = F.map_filter(F.coalesce(mapping, F.map_from_arrays(F.array(), F.array())), lambda k, _: ~F.map_contains_key(changes, k))
    return F.map_concat(kept, changes)


def counters_json(names: Column, counts: Column) -> Column:
    """JSON object of named counters, keys in ascending order."""
    pairs = F.array_sort(F.arrays_zip(names.alias("name"), counts.alias("n")))
    return F.to_json(F.map_from_entries(pairs))


def range_start(time_range: str, as_of: datetime) -> datetime:
    """Start of a named range; anything but day, week or month means all time."""
    days = {"day": 1, "week": 7, "month": 30}.get(time_range)
    return datetime(2000, 1, 1) if days is None else as_of - timedelta(days=days)


def iso_timestamp(ts: Column) -> Column:
    """ISO text to the microsecond, without a fraction where it is zero."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(text, r"\.000000$", "")


def ntz(moment: datetime) -> Column:
    """A literal time without zone."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
