"""Days, weeks, editions and the placing of material in time. Local days are eight hours ahead of UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_HOURS = 8
TRUST_SECONDS = 3600  # a claimed time may be this far ahead of discovery
STALE_SECONDS = 48 * 3600


def local(moment: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(moment) + OFFSET_HOURS * 3_600_000_000)


def local_date(moment: Column) -> Column:
    return F.to_date(local(moment))


def is_day(text: Column) -> Column:
    """A real calendar day, written yyyy-MM-dd."""
    return F.coalesce(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd") == text, F.lit(False))


def iso_week_label(moment: Column) -> Column:
    thursday = F.date_add(F.date_trunc("week", moment).cast("date"), 3)
    return F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(thursday).cast("string"), 2, "0"))


def edition_day(moment: Column) -> Column:
    return F.date_add(F.to_date(moment), 1)


def daily_window(day: Column) -> Column:
    """The instants [day before 8:00, day 8:00), local time."""
    end = F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")))
    return F.struct(F.timestamp_seconds(F.unix_seconds(end) - 86400).alias("start"), end.alias("stop"))


def timeline(claimed: Column, discovered: Column, explicit: Column | None = None) -> Column:
    """struct(published, backfill, timeline_at): claims from the future are not believed; what is old or undated is placed as
    backfill, at its own time if that is known, and all else when it was discovered."""
    ahead = F.unix_micros(claimed) - F.unix_micros(discovered)
    published = F.when(ahead <= TRUST_SECONDS * 1_000_000, claimed)
    reason = F.when(explicit if explicit is not None else F.lit(False), "explicit")
    reason = reason.when(published.isNull(), "undated").when(F.unix_micros(discovered) - F.unix_micros(published) > STALE_SECONDS * 1_000_000, "stale")
    return F.struct(published.alias("published"), reason.alias("backfill"), F.when(reason.isNotNull() & published.isNotNull(), published).otherwise(discovered).alias("timeline_at"))


def story_status(last: Column, now: Column) -> Column:
    age = F.unix_seconds(now) - F.unix_seconds(last)
    return F.when(age < 24 * 3600, "active").when(age < 72 * 3600, "watching").otherwise("settled")


def rfc822(moment: Column) -> Column:
    return F.concat(F.date_format(local(moment), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0800"))


#: Shapes of publication times that are tried in turn; ambiguous day and month orders are left out.
SHAPES = (
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyy.MM.dd",
    "EEE, d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss Z", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyyMMdd",
)


def parse_published(text: Column) -> Column:
    """The first shape that fits, as an instant; null if none does. Shapes without a zone are local. Week days are not checked."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(text), "^[A-Za-z]{3,9}, *", ""), " (?:GMT|UTC)$", " +0000")
    tries = []
    for shape in SHAPES:
        shape = shape.removeprefix("EEE, ")
        zoned = "X" in shape or "Z" in shape
        found = F.try_to_timestamp(clean, F.lit(shape))
        tries.append(found if zoned else F.timestamp_micros(F.unix_micros(found) - OFFSET_HOURS * 3_600_000_000))
    return F.coalesce(*tries)


# Months and zones by name, hours to the east.
MONTHS = {m: k + 1 for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
ZONES = {"z": 0, "gmt": 0, "utc": 0, "ut": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
#: End of fixed values.

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?"
_ZONE = r"(?i)(?<=[\d\s])(Z|GMT|UTC|UT|EST|EDT|CST|CDT|MST|MDT|PST|PDT|[+-]\d{2}:?\d{2})$"
_YEAR_LAST = r"(?:^|[^\d])(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?!\d)(?:(?:[T ]|\s+-\s+)" + _TIME + ")?"
_YEAR_FIRST = r"(?<!\d)(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})(?!\d)日?(?:(?:T|\s*)" + _TIME + ")?"
_NAMES = "|".join(MONTHS)
_MONTH_FIRST = rf"(?i)\b({_NAMES})[a-z]*\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?!\d)(?:,?\s+(?:at\s+)?{_TIME})?"
_DAY_FIRST = rf"(?i)(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+({_NAMES})[a-z]*\.?,?[\s-]+(\d{{4}})(?!\d)(?:,?\s+{_TIME})?"


def _number(text: Column) -> Column:
    return text.try_cast("int")


def _moment(text: Column, pattern: str, year: int, month: int, day: int, east: Column, named: bool = False) -> Column:
    """The instant of the first match, whose groups have year, month and day at these places and a time after them; null without a match or for no day."""
    part = lambda k: F.regexp_extract(text, pattern, k)
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    m = F.try_element_at(table, F.lower(part(month))) if named else _number(part(month))
    clock = lambda k: F.coalesce(_number(part(k)), F.lit(0))
    found = F.try_make_timestamp(_number(part(year)), m, _number(part(day)), clock(4), clock(5), clock(6).cast("decimal(8,6)"), F.lit("UTC"))
    return F.when(part(year) != "", F.timestamp_micros(F.unix_micros(found) - east.cast("bigint") * 60_000_000))


def published_at(text: Column, unit: str = "", date_order: str | None = None, offset_hours: float = OFFSET_HOURS) -> Column:
    """The instant that a feed, an API or a page prints. unit: epoch_ms, epoch_s, yyyymmdd or date_parts (a JSON list) for numbers.

    A zone that the value has counts, by number or name; an ISO day alone is midnight in UTC; other values without a zone are in the source's offset. Dates with the year
    last are read only where the source says the order of day and month (dmy or mdy). Two years in a value, days that no calendar has, and all else give null.
    """
    plain = F.trim(text)
    if unit in ("epoch_ms", "epoch_s"):
        n = F.when(plain.rlike(r"^-?\d{1,15}(?:\.\d+)?$"), plain.try_cast("double") * (1000 if unit == "epoch_ms" else 1_000_000))
        return F.timestamp_micros(n.cast("bigint"))
    if unit == "yyyymmdd":
        part = lambda k: _number(F.regexp_extract(plain, r"^(\d{4})(\d{2})(\d{2})$", k))
        return F.try_make_timestamp(part(1), part(2), part(3), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"), F.lit("UTC"))
    if unit == "date_parts":
        p = F.from_json(plain, "array<int>")
        at = lambda k: F.coalesce(F.get(p, F.lit(k)), F.when(F.size(p) <= k, F.lit(1)))
        day = F.try_make_timestamp(at(0), at(1), at(2), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"), F.lit("UTC"))
        return F.when(F.size(p).between(1, 3) & at(0).between(1800, 2200), day)
    v = F.trim(F.regexp_replace(F.regexp_replace(text, "星期[一二三四五六日天]", ""), r"[\s\x{a0}\x{3000}]+", " "))
    zone = F.lower(F.regexp_extract(v, _ZONE, 1))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    by_number = F.when(zone.rlike(r"^[+-]"), sign * (_number(F.substring(digits, 1, 2)) * 60 + _number(F.substring(digits, 3, 2))))
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair]), zone) * 60
    day_alone = v.rlike(r"^\d{4}-\d{2}-\d{2}$")
    # a sign and four digits after a day alone are no zone but a part of the date
    has_time = v.rlike(r"\d{1,2}:\d{2}")
    east = F.coalesce(F.when(has_time, F.coalesce(by_number, named)), F.when(day_alone, F.lit(0)), F.lit(int(offset_hours * 60)))
    years = F.size(F.regexp_extract_all(v, F.lit(r"(?<!\d)(?:1[89]|2[01])\d{2}(?!\d)"), F.lit(0))) - F.when(zone.rlike(r"^[+-](?:1[89]|2[01])\d{2}$"), 1).otherwise(0)
    last = _moment(v, _YEAR_LAST, 3, 2, 1, east) if date_order == "dmy" else _moment(v, _YEAR_LAST, 3, 1, 2, east) if date_order == "mdy" else F.lit(None).cast("timestamp")
    other = F.coalesce(_moment(v, _YEAR_FIRST, 1, 2, 3, east), _moment(v, _MONTH_FIRST, 3, 1, 2, east, True), _moment(v, _DAY_FIRST, 3, 2, 1, east, True))
    return F.when(years <= 1, F.when(v.rlike(_YEAR_LAST), last).otherwise(other))
