"""Dates, times and numbers as text by templates, and back; intervals by calendar fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Template words of dates and times, longest first where one begins like another.
_TIME = re.compile(r'"([^"]*)"|(FM)?(YYYY|IYYY|YY|MONTH|Month|month|MON|Mon|mon|MM|MI|MS|DAY|Day|day|DDD|DD|DY|Dy|dy|D|HH24|HH12|HH|SSSS|SS|US|AM|PM|am|pm|Q|WW|IW|CC|J)')
#: The same for reading, as Java's pattern letters.
_READ = {"YYYY": "yyyy", "YY": "yy", "MONTH": "MMMM", "MON": "MMM", "MM": "MM", "DDD": "DDD", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a"}


def _cased(name: Column, word: str, width: int, tight: bool) -> Column:
    out = F.upper(name) if word.isupper() else F.lower(name) if word.islower() else name
    return out if tight or not width else F.rpad(out, width, " ")


def _field(t: Column, word: str, tight: bool) -> Column:
    number = {
        "YYYY": (F.year(t), 4), "IYYY": (F.extract(F.lit("YEAROFWEEK"), t), 4), "YY": (F.year(t) % 100, 2), "MM": (F.month(t), 2), "DD": (F.dayofmonth(t), 2),
        "DDD": (F.dayofyear(t), 3), "D": (F.dayofweek(t), 1), "HH24": (F.hour(t), 2), "HH12": ((F.hour(t) + 11) % 12 + 1, 2), "HH": ((F.hour(t) + 11) % 12 + 1, 2),
        "MI": (F.minute(t), 2), "SS": (F.second(t), 2), "SSSS": (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t), 1), "Q": (F.quarter(t), 1), "WW": (F.floor((F.dayofyear(t) - 1) / 7) + 1, 2),
        "IW": (F.weekofyear(t), 2), "CC": (F.floor((F.year(t) + 99) / 100), 2), "J": (F.datediff(t, F.lit("1970-01-01").cast("date")) + 2440588, 1),
        "MS": (F.floor(F.unix_micros(t.cast("timestamp")) / 1000) % 1000, 3), "US": (F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(1_000_000)), 6),
    }
    if word in number:
        value, width = number[word]
        text = value.cast("long").cast("string")
        return text if tight or width == 1 else F.lpad(text, width, "0")
    low = word.lower()
    if low in ("am", "pm"):
        return _cased(F.when(F.hour(t) < 12, "Am").otherwise("Pm"), word, 0, True)
    pattern, width = {"month": ("MMMM", 9), "mon": ("MMM", 0), "day": ("EEEE", 9), "dy": ("EEE", 0)}[low]
    return _cased(F.date_format(t, pattern), word, width, tight)


def to_char_time(t: Column, template: str) -> Column:
    """A timestamp or date by a template; FM before a word drops its padding, text in double quotes stays."""
    parts, at = [], 0
    for m in _TIME.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        parts.append(F.lit(m[1]) if m[1] is not None else _field(t, m[3], bool(m[2])))
        at = m.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def _java(template: str) -> str:
    out, at = [], 0
    plain = lambda s: "".join(f"'{c}'" if c.isalpha() else c for c in s)
    for m in _TIME.finditer(template):
        out.append(plain(template[at : m.start()]))
        word = (m[3] or "").upper()
        if m[1] is None and word not in _READ:
            raise ValueError(f"{m[3]} can't be read")
        out.append(f"'{m[1]}'" if m[1] is not None else _READ[word])
        at = m.end()
    return "".join(out) + plain(template[at:])


def to_timestamp(s: Column, template: str) -> Column:
    return F.to_timestamp(s, _java(template))


def to_date(s: Column, template: str) -> Column:
    return F.to_date(F.to_timestamp(s, _java(template)))


def to_char_number(x: Column, template: str) -> Column:
    """A number by a template of 9 0 . D , G, with FM, and S, MI, PL or PR for signs; # where it doesn't fit."""
    body, tight = template.replace("FM", ""), "FM" in template
    sign = next((s for s in ("MI", "PL", "PR") if body.endswith(s)), "S" if "S" in body else "")
    body = body.removesuffix("MI").removesuffix("PL").removesuffix("PR")
    front = body.startswith("S")
    whole, _, tail = body.replace("S", "").replace("D", ".").replace("G", ",").partition(".")
    if not re.fullmatch(r"[90,]*", whole) or not re.fullmatch(r"[90]*", tail):
        raise ValueError(f"template {template} isn't known")
    places, digits = len(tail), re.sub(",", "", whole)
    size = x.cast(f"decimal({min(38, 18 + places)},{places})")
    told = F.split(F.abs(size).cast("string"), r"\.")
    left = told[0]
    if places and "0" not in whole:
        left = F.when(left == "0", "").otherwise(left)
    padded = F.lpad(left, len(digits), " ")
    first_zero = digits.find("0")
    chars, k = [], 0
    before: Column = F.lit(" ")
    for c in whole:
        if c == ",":
            chars.append(F.when(before == " ", F.lit(" ")).otherwise(F.lit(",")))
            continue
        d = F.substring(padded, k + 1, 1)
        before = F.when(d == " ", F.lit("0")).otherwise(d) if 0 <= first_zero <= k else d
        chars.append(before)
        k += 1
    fits = F.length(left) <= len(digits)
    number = F.concat(*chars) if chars else F.lit("")
    number = F.when(fits, number).otherwise(F.lit(re.sub(r"[90]", "#", whole)))
    if "." in body.replace("D", "."):
        fraction = F.when(fits, F.rpad(F.coalesce(F.try_element_at(told, F.lit(2)), F.lit("")), places, "0") if places else F.lit("")).otherwise(F.lit("#" * places))
        if tight:
            keep = tail.rfind("0") + 1
            fraction = F.concat(F.substring(fraction, 1, keep), F.regexp_replace(F.substring(fraction, keep + 1, places), "0+$", "")) if places else fraction
        number = F.concat(number, F.lit("."), fraction)
    low, bare = x < 0, F.ltrim(number)  # a number that rounds to zero keeps its sign
    width = len(whole) + (1 + places if "." in body.replace("D", ".") else 0)
    if sign == "MI":
        out = F.concat(F.lpad(bare, width, " "), F.when(low, "-").otherwise("" if tight else " "))
    elif sign == "PL":
        out = F.concat(F.lpad(F.concat(F.when(low, "-").otherwise(" "), bare), width + 1, " "), F.when(low, " ").otherwise("+"))
    elif sign == "PR":
        out = F.lpad(F.concat(F.when(low, "<").otherwise(" "), bare, F.when(low, ">").otherwise(" ")), width + 2, " ")
    elif sign == "S":
        mark = F.when(low, "-").otherwise("+")
        out = F.lpad(F.concat(mark, bare), width + 1, " ") if front else F.concat(F.lpad(bare, width, " "), mark)
    else:
        out = F.lpad(F.concat(F.when(low, "-").otherwise(" "), bare), width + 1, " ")
    return F.trim(out) if tight else out


def to_number(s: Column, template: str) -> Column:
    """Reads what to_char_number writes."""
    places = len(re.sub(r"[^90]", "", template.replace("D", ".").partition(".")[2]))
    digits = F.regexp_replace(s, r"[^0-9.]", "")
    low = s.contains("-") | s.contains("<")
    return (F.when(low, -1).otherwise(1) * digits.cast(f"decimal({min(38, 18 + places)},{places})")).cast(f"decimal({min(38, 19 + places)},{places})")


def age(a: Column, b: Column) -> Column:
    """struct<years, months, days, seconds> from b to a, field by field; a month that must be borrowed is that of the
    earlier moment. All fields are negative or zero if a is before b."""
    back = a < b
    late, early = F.when(back, b).otherwise(a), F.when(back, a).otherwise(b)
    micros = lambda t: F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(86_400_000_000))
    rest = micros(late) - micros(early)
    days = F.dayofmonth(late) - F.dayofmonth(early) - F.when(rest < 0, 1).otherwise(0)
    months = F.month(late) - F.month(early) - F.when(days < 0, 1).otherwise(0)
    years = F.year(late) - F.year(early) - F.when(months < 0, 1).otherwise(0)
    sign = F.when(back, -1).otherwise(1)
    return F.struct(
        (sign * years).alias("years"),
        (sign * F.pmod(months, F.lit(12))).alias("months"),
        (sign * F.when(days < 0, days + F.dayofmonth(F.last_day(early))).otherwise(days)).alias("days"),
        (sign * F.when(rest < 0, rest + 86_400_000_000).otherwise(rest) / 1e6).alias("seconds"),
    )


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the periods from a to b and from c to d, ends in any order, share a moment; a period begins at its
    start and ends before its end, one of no length is its moment."""
    s1, e1, s2, e2 = F.least(a, b), F.greatest(a, b), F.least(c, d), F.greatest(c, d)
    return F.when(s1 == s2, F.lit(True)).when(s1 < s2, s2 < e1).otherwise(s1 < e2)


def add_interval(t: Column, months: int = 0, days: int = 0, seconds: float = 0) -> Column:
    """An interval of several units: months first, then days, then time."""
    time = F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(86_400_000_000))
    moved = F.timestamp_micros(F.unix_micros(F.add_months(t, months).cast("timestamp")) + time) if months else t.cast("timestamp")
    return F.timestamp_micros(F.unix_micros(moved) + int(days * 86_400_000_000 + seconds * 1_000_000))


def at_time_zone(t: Column, zone: str) -> Column:
    """The wall clock of a zone at a moment that is given in UTC."""
    return F.from_utc_timestamp(t, zone)
