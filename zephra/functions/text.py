"""Text, number and time parsing that never raises: what cannot be read becomes NULL."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

from zephra.fixed_values import NULL_TOKENS

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_ZONED = r"[0-9]:[0-9]{2}.*(Z|[+-][0-9]{2}:?[0-9]{2})$"

# Accepted besides the ISO forms.
TIME_FORMATS = ["dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd-MM-yyyy", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm",
                "MM/dd/yyyy"]


def quoted(name: str) -> Column:
    """Column by literal name; names such as ``PM2.5`` hold a dot."""
    return F.col(f"`{name}`")


def round_stable(c: Column, places: int) -> Column:
    """Half-up rounding after removing the last-digit noise of a distributed sum, so that ties do not depend on order."""
    return F.round(F.round(c, 9), places)


def round_half_even(c: Column, places: int) -> Column:
    """Rounding of the scaled value, ties to even: what published importance tables use."""
    scale = 10.0**places
    return F.rint(c * scale) / scale


def null_tokens(c: Column, tokens: list[str] = NULL_TOKENS) -> Column:
    return F.when(c.isin(tokens), None).otherwise(c)


def to_number(c: Column, tokens: list[str] = NULL_TOKENS) -> Column:
    bare = F.btrim(F.trim(c), F.lit("\"'"))
    digits = F.replace(null_tokens(bare, tokens), F.lit(","), F.lit(""))
    return F.when(digits.rlike(_NUMBER), digits.try_cast("double"))


def to_time(c: Column, fmt: str = "dd-MM-yyyy HH:mm:ss") -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def to_utc_naive(c: Column, formats: list[str] = TIME_FORMATS) -> Column:
    """Zoned texts are moved to UTC, others taken as they stand; the zone is then dropped."""
    text = F.trim(c)
    moved = F.convert_timezone(F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz"))
    plain = F.coalesce(text.try_cast("timestamp_ntz"), *[to_time(text, f) for f in formats])
    return F.when(text.rlike(_ZONED), moved).otherwise(plain)


def norm_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def clean_stem(stem: Column) -> Column:
    """Station name from a file name that matches no known station."""
    text = F.regexp_replace(stem, r"\b20(1[7-9]|2[0-6])\b", "")
    text = F.regexp_replace(text, "(?i)hourly aqi data", "")
    text = F.regexp_replace(text, "(?i)cpcb|kspcb|bengaluru|bangalore|blr", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, "[-_]+", " "), r"\s+", " "))
    return F.when(text == "", stem).otherwise(text)


def split_list(c: Column, sep: str = ";") -> Column:
    return F.transform(F.split(c, sep), lambda x: F.trim(x))


def month_no(name: Column) -> Column:
    pairs = []
    for names in (calendar.month_name, calendar.month_abbr):
        for i in range(1, 13):
            if names[i].lower() not in pairs:
                pairs += [names[i].lower(), i]
    table = F.create_map(*[F.lit(p) for p in pairs])
    return F.try_element_at(table, F.lower(F.trim(name)))


def hour_of(label: Column, position: Column) -> Column:
    """Leading one or two digits when they are an hour, else the column position."""
    lead = F.regexp_extract(F.trim(label), "^([0-9]{1,2})", 1)
    hour = lead.try_cast("int")
    return F.when(hour.between(0, 23), hour).otherwise(position.cast("int"))


def percent_value(c: Column) -> Column:
    """``94.2%`` to 94.2"""
    return F.regexp_extract(c, r"^\s*([0-9.]+)\s*%", 1).try_cast("double")


def score_value(c: Column) -> Column:
    """``82 / 100`` to 82"""
    return F.regexp_extract(c, r"^\s*([0-9]+)\s*/", 1).try_cast("int")


def latlon(c: Column) -> tuple[Column, Column]:
    """``12.97, 77.59`` to two doubles."""
    parts = F.split(c, ",")
    return (F.trim(F.get(parts, F.lit(0))).try_cast("double"), F.trim(F.get(parts, F.lit(1))).try_cast("double"))
