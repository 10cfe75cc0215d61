"""Column functions for strings, service times, dates and numbers. All are
built-in expressions, so they stay inside code generation; ANSI mode is assumed,
so conversions use the try_ forms."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- strings -----------------------------------------------------------------


def clean(c: Column) -> Column:
    """Trimmed; '', 'nan' and 'None' are null (STR-01)."""
    t = F.trim(c)
    return F.when(~t.isin("", "nan", "None"), t)


#: How stop ids name a unit's number, and how texts name the ends of a segment.
UNIT_NUMBER = r"(?i)(?:ESC|ELE|ELV)(\d+)"
SEGMENT = r"between\s+(.+?)(?:\s+to\s+|\s*,|\s*$)"


def seq_in_stop(stop_id: Column) -> Column:
    """Number after ESC, ELE or ELV in a stop id, else null (STR-07)."""
    return F.regexp_extract(F.coalesce(stop_id, F.lit("")), UNIT_NUMBER, 1).try_cast("int")


def seq_in_unit(unit: Column) -> Column:
    """Characters 5 and 6 of a unit name as a number; 00 and others null (STR-06)."""
    n = F.substring(unit, 5, 2).try_cast("int")
    return F.when((F.length(unit) >= 6) & (n != 0), n)


def segment_key(text: Column) -> Column:
    """'... between X and Y [to|,] ...' -> 'x_y' with the two parts in order,
    spaces as underscores; null without 'between' (STR-08)."""
    norm = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    phrase = F.trim(F.regexp_extract(norm, SEGMENT, 1))
    parts = F.split(phrase, r"\s+and\s+", 2)
    return F.when(phrase != "", F.array_join(F.array_sort(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"\s+", "_"))), "_"))


#: What operators say and what the schedule feed calls it, replaced in this order.
SYNONYMS = (
    ("middle landing", "intermediate passage"),
    ("middle  landing", "intermediate passage"),
    ("amtrak station", "street"),
    ("main entrance", "street"),
    ("platform level", "platform"),
    ("mezzanine level", "mezzanine"),
    ("main concourse", "mezzanine"),
    ("intermediate level", "intermediate passage"),
    ("silver line platform", "platform"),
    ("blue/orange lines platform", "platform"),
    ("red line platform", "platform"),
    ("green line platform", "platform"),
    ("yellow line platform", "platform"),
)


def with_synonyms(text: Column) -> Column:
    """Lower case, SYNONYMS replaced, a trailing ' level' dropped (STR-09)."""
    out = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SYNONYMS, F.lower(text))
    return F.regexp_replace(out, r"\s+level\b", "")


def amount_in_id(product_id: Column) -> Column:
    """A trailing _<digits> is an amount in cents; else null (STR-11)."""
    return F.regexp_extract(clean(product_id), r"_(\d+)$", 1).try_cast("int") / 100


def by_prefix(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """The value of the first pair whose prefix `c` has (STR-12)."""
    return F.coalesce(*(F.when(c.startswith(prefix), F.lit(value)) for prefix, value in pairs))


def content_hash(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts joined by '|' (STR-13)."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


def property_text(**columns: Column) -> Column:
    """'name: value, ...' of the properties that are not null (STR-16)."""
    return F.concat_ws(", ", *(F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in columns.items()))


def escape_search(text: Column) -> Column:
    """Search operators become literal by a backslash (STR-14)."""
    return F.regexp_replace(text, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def unfence(text: Column) -> Column:
    """JSON without a Markdown code fence around it (STR-15)."""
    return F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")


# --- service times and dates ---------------------------------------------------


def service_seconds(c: Column) -> Column:
    """'HH:MM:SS', hours beyond 24 too, exactly eight characters -> seconds of
    the service day; else null (DT-01)."""
    part = lambda at: F.substring(c, at, 2).try_cast("int")
    return F.when(F.length(c) == 8, part(1) * 3600 + part(4) * 60 + part(7))


def service_seconds_loose(c: Column) -> Column:
    """As service_seconds(), for parts of any width (DT-02)."""
    parts = F.split(F.trim(c), ":")
    at = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("int")
    return F.when(F.size(parts) == 3, at(1) * 3600 + at(2) * 60 + at(3))


def clock(seconds: Column) -> Column:
    """Seconds -> 'H:MM' (DT-03)."""
    return F.concat((F.floor(seconds / 3600)).cast("string"), F.lit(":"), F.lpad(F.floor((seconds % 3600) / 60).cast("string"), 2, "0"))


def date_of(c: Column) -> Column:
    """'YYYYMMDD' -> date; another length or a wrong date null (DT-04)."""
    t = F.trim(c.cast("string"))
    return F.when(F.length(t) == 8, F.try_to_timestamp(t, F.lit("yyyyMMdd")).cast("date"))


def date_key(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd")


def day_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def epoch_millis(c: Column) -> Column:
    """ISO time, without a zone as UTC, -> milliseconds; 'UNKNOWN' null (DT-10)."""
    return F.unix_millis(F.try_to_timestamp(F.when(c != "UNKNOWN", c)))


def iso_of_millis(c: Column) -> Column:
    return F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def whole_days(later: Column, earlier: Column) -> Column:
    """Days between two millisecond stamps, rounded down (DT-11)."""
    return F.floor((later - earlier) / 86_400_000)


def local_date_key(epoch_seconds: Column, zone: str = "America/New_York") -> Column:
    """Epoch seconds -> 'YYYYMMDD' in an explicit zone (DT-12)."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(epoch_seconds), zone), "yyyyMMdd")


def federal_holidays(first_year: int, last_year: int) -> list[tuple[str, str]]:
    """(YYYYMMDD, name) of US federal holidays; one on a Saturday is kept on the
    Friday before too, one on a Sunday on the Monday after (DT-08)."""
    nth = {  # month, weekday from Monday, which (negative: from the end)
        "MLK Day": (1, 0, 3),
        "Presidents' Day": (2, 0, 3),
        "Memorial Day": (5, 0, -1),
        "Labor Day": (9, 0, 1),
        "Columbus Day": (10, 0, 2),
        "Thanksgiving": (11, 3, 4),
    }
    fixed = {"New Year's Day": (1, 1), "Juneteenth": (6, 19), "Independence Day": (7, 4), "Veterans Day": (11, 11), "Christmas Day": (12, 25)}
    out: dict[str, str] = {}
    for year in range(first_year, last_year + 1):
        days = [(dt.date(year, m, d), name) for name, (m, d) in fixed.items()]
        for name, (month, weekday, which) in nth.items():
            start = dt.date(year, month, 1)
            all_of = [d for d in (start + dt.timedelta(k) for k in range(31)) if d.month == month and d.weekday() == weekday]
            days.append((all_of[which - 1 if which > 0 else which], name))
        for day, name in days:
            out[day.strftime("%Y%m%d")] = name
            observed = {5: -1, 6: 1}.get(day.weekday())
            if observed:
                out.setdefault((day + dt.timedelta(observed)).strftime("%Y%m%d"), name)
    return sorted(out.items())


def resolve_date(text: str, today: dt.date) -> str | None:
    """'YYYYMMDD', ISO, today, yesterday or 'last <weekday>' -> 'YYYYMMDD'; the
    same weekday is a week back (DT-14)."""
    t = text.strip().lower()
    if len(t) == 8 and t.isdigit():
        return t
    if t in ("today", "yesterday"):
        return (today - dt.timedelta(t == "yesterday")).strftime("%Y%m%d")
    names = [dt.date(2024, 1, 1 + k).strftime("%A").lower() for k in range(7)]
    if t.startswith("last ") and t[5:].strip() in names:
        back = (today.weekday() - names.index(t[5:].strip())) % 7 or 7
        return (today - dt.timedelta(back)).strftime("%Y%m%d")
    try:
        return dt.date.fromisoformat(t).strftime("%Y%m%d")
    except ValueError:
        return None


def service_class(service_id: Column, days: list[Column]) -> Column:
    """Maintenance, Holiday, Weekday, Saturday or Sunday of a calendar row;
    `days` are the seven flags from Monday (DT-09)."""
    flag = [F.coalesce(d.try_cast("int"), F.lit(0)) for d in days]
    week, sat, sun = reduce(lambda a, b: a + b, flag[:5]), flag[5] != 0, flag[6] != 0
    return (
        F.when(service_id.endswith("_R"), "Maintenance")
        .when((week == 0) & ~sat & ~sun, "Holiday")
        .when((week == 0) & sat & ~sun, "Saturday")
        .when((week == 0) & sun & ~sat, "Sunday")
        .otherwise("Weekday")
    )


# --- numbers, maps, arrays -----------------------------------------------------


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (haversine, mean radius 6371008.8 m) (MA-06)."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * 6371008.8) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 part / whole, null where whole is 0 (MA-03)."""
    return F.round(F.try_divide(F.lit(100.0) * part, whole), digits)


def decode(c: Column, mapping: dict, default: object = None) -> Column:
    """The value that a literal map gives, else `default` (SRC-11, PRJ-08)."""
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))


def has_label(labels: Column, *names: str) -> Column:
    """Whether any of the names is among the labels (PRJ-06, FLT-08)."""
    return F.arrays_overlap(labels, F.array(*(F.lit(n) for n in names)))


def ordered_list(value: Column, *order: Column) -> Column:
    """Aggregate: non-null values in a fixed order (AG-06, AG-15)."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*order, value.alias("__value"))))), lambda s: s["__value"])


def joined(value: Column, separator: str = ",", *order: Column) -> Column:
    """Aggregate: ordered values as one string."""
    return F.array_join(ordered_list(value.cast("string"), *order), separator)


def translation(texts: Column) -> Column:
    """Of (language, text) structs the first in English or without a language,
    else the first (SRC-10)."""
    wanted = F.filter(texts, lambda t: F.coalesce(t["language"], F.lit("")).isin("en", ""))
    return F.coalesce(F.try_element_at(wanted, F.lit(1))["text"], F.try_element_at(texts, F.lit(1))["text"])


def largest_delay(own: Column, stop_delays: Column) -> Column:
    """A trip's own delay, else the largest non-zero delay of its stops (SRC-08)."""
    return F.coalesce(own, F.array_max(F.filter(stop_delays, lambda d: d.isNotNull() & (d != 0))))
