"""Canonical codes and local times of fare observations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Kolkata"
#: Cabin words by cabin: fixed values.
CABINS = {
    "ECONOMY": ("y", "e", "eco", "econ", "economy", "coach", "economy class", "main cabin", "standard", "saver", "flexi"),
    "PREMIUM_ECONOMY": ("w", "pe", "premium", "premium economy", "comfort", "comfort plus"),
    "BUSINESS": ("c", "j", "biz", "business", "business class"),
    "FIRST": ("f", "first", "first class"),
}


def carrier(raw: Column) -> Column:
    """The designator before any slash or dash: upper case, letters and digits, two or three; else null."""
    code = F.left(F.regexp_replace(F.split_part(F.split_part(F.upper(F.trim(raw)), F.lit("/"), F.lit(1)), F.lit("-"), F.lit(1)), "[^A-Z0-9]", ""), F.lit(3))
    return F.when(F.length(code) >= 2, code)


def flight_number(raw: Column, carrier_code: Column) -> Column:
    """The first run of digits after the carrier's own code, without leading zeros; else the text itself."""
    text = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    text = F.when(F.startswith(text, carrier_code), F.trim(F.substr(text, F.length(carrier_code) + 1))).otherwise(text)
    digits = F.regexp_extract(text, "([0-9]+)", 1)
    return F.when(digits != "", F.regexp_replace(digits, "^0+(?=[0-9])", "")).otherwise(text)


def cabin(raw: Column) -> Column:
    """The cabin that a word means; unknown words are economy."""
    word = F.lower(F.trim(F.coalesce(F.nullif(raw, F.lit("")), F.lit("economy"))))
    out = None
    for name, words in CABINS.items():
        out = F.when(word.isin(*words), name) if out is None else out.when(word.isin(*words), name)
    return out.otherwise("ECONOMY")


def local_day(utc: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(utc, ZONE))


#: Known layouts, each with what any text of it has: a layout that doesn't fit costs an exception.
_LAYOUTS = {
    "yyyy-MM-dd HH:mm:ss": r"-[0-9]{2} [0-9]{2}:[0-9]{2}:", "yyyy-MM-dd HH:mm": r"-[0-9]{2} [0-9]{2}:[0-9]{2}$", "dd-MM-yyyy HH:mm": r"^[0-9]{2}-[0-9]{2}-", "dd/MM/yyyy HH:mm": r"^[0-9]{2}/[0-9]{2}/",
    "yyyy-MM-dd'T'HH:mm:ss": r"-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:", "yyyy-MM-dd'T'HH:mm": r"-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}$",
}


def local_timestamp(raw: Column) -> Column:
    """Text in one of the known layouts, or ISO with or without an offset, to UTC; without an offset it is local time."""
    naive = F.coalesce(*[F.when(F.regexp_like(raw, F.lit(has)), F.try_to_timestamp(raw, F.lit(f))) for f, has in _LAYOUTS.items()])
    offset = F.regexp_like(raw, F.lit(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$")) & F.contains(raw, F.lit(":"))
    return F.when(offset, raw.try_cast("timestamp")).otherwise(F.to_utc_timestamp(naive, ZONE))


def agency_timestamp(raw: Column) -> Column:
    """Like Mon-03Jun2024 10:35: the weekday is skipped."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.substring(raw, 5, 40), F.lit("ddMMMyyyy HH:mm")), ZONE)


def departure(parsed: Column, observed_day: Column, lead_days: Column) -> Column:
    """The departure, or the local midnight lead_days after the observation."""
    return F.coalesce(parsed, F.to_utc_timestamp(F.date_add(observed_day, lead_days).cast("timestamp"), ZONE))


def lead_drift(departure_utc: Column, observed_day: Column, lead_days: Column) -> Column:
    return F.datediff(local_day(departure_utc), observed_day) - lead_days


def month_start(period: Column) -> Column:
    return F.to_date(F.concat(period, F.lit("-01")))


def month_bounds(period: Column) -> Column:
    """The first day of a month like 2024-02, and that of the month after it, as a struct of start and end."""
    return F.struct(month_start(period).alias("start"), F.add_months(month_start(period), 1).alias("end"))


def days_ahead(departure_day: Column, observed_day: Column) -> Column:
    """Days to departure, never below none."""
    return F.greatest(F.datediff(departure_day, observed_day), F.lit(0))


def window_floor(ts: Column, minutes: int = 60) -> Column:
    seconds = F.unix_timestamp(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(60 * minutes)))


def minute_bucket(hhmm: Column, minutes: int = 15) -> Column:
    """HH:MM floored to the bucket; other text unchanged."""
    total = F.try_add(F.regexp_extract(hhmm, "^([0-9]{1,2}):", 1).try_cast("int") * 60, F.regexp_extract(hhmm, ":([0-9]{2})", 1).try_cast("int"))

    def bucket(low: Column) -> Column:
        return F.concat(F.lpad((low / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((low % 60).cast("string"), 2, "0"))

    # a lambda's variable is bound: the patterns are read once, and not wherever the total is used
    return F.coalesce(F.element_at(F.transform(F.array(total), lambda t: bucket(t - t % minutes)), 1), hhmm)


def clock_time(raw: Column) -> Column:
    """HH:MM of a day of 24 hours, from texts with a colon, a point or nothing between, and AM or PM or neither; else null.

    PM adds to hours below 12 only, and AM takes from 12 only, so 13:00 AM is 13:00.
    """
    pattern = r"^([0-9]{1,2})[:.]?([0-9]{2})\s*(AM|PM)?$"
    text = F.upper(F.trim(F.regexp_replace(raw, r"\s+", " ")))
    hour, minute, half = (F.regexp_extract(text, pattern, g) for g in (1, 2, 3))
    hour, minute = hour.try_cast("int"), minute.try_cast("int")
    hour = F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    return F.when((hour < 24) & (minute < 60), F.format_string("%02d:%02d", hour, minute))


def url_origin(url: Column) -> Column:
    """scheme://host[:port] in lower case; null without a host."""
    found = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return F.nullif(F.lower(found), F.lit(""))
