"""Scalar functions on columns: keys, local dates, units, numbers and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dedupe_key(*parts: str | Column) -> Column:
    """First 16 bytes, in hex, of SHA-256 over the escaped parts joined by a bar; a null part counts as empty."""
    escaped = []
    for p in parts:
        c = F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit(""))
        escaped.append(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")))
    return F.substring(F.sha2(F.concat_ws("|", *escaped), 256), 1, 32)


def local_date(at: Column, offset_minutes: Column, zone: Column, owner_zone: Column) -> Column:
    """Local date by the record's own offset, else by its zone, else by the owner's."""
    shifted = F.timestamp_micros(F.unix_micros(at) + offset_minutes * 60_000_000)
    return F.when(offset_minutes.isNotNull(), F.to_date(shifted)).otherwise(F.to_date(F.from_utc_timestamp(at, F.coalesce(zone, owner_zone))))


def paired_offset(utc_seconds: Column, local_seconds: Column) -> Column:
    """Offset in minutes of paired stamps: whole quarter hours from -12 to +14 hours, else none."""
    d = local_seconds - utc_seconds
    return F.when((d % 900 == 0) & d.between(-12 * 3600, 14 * 3600), (d / 60).cast("int"))


def night_of(local: Column, anchor_minutes: int = 18 * 60) -> Column:
    """The date that a night is counted to: the date of its local end, or the next one from the anchor on."""
    minute = F.hour(local) * 60 + F.minute(local)
    return F.when(minute >= anchor_minutes, F.date_add(F.to_date(local), 1)).otherwise(F.to_date(local))


def window_key(start: Column) -> Column:
    return F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def convert(value: Column, factor_from: Column, offset_from: Column, factor_to: Column, offset_to: Column) -> Column:
    """Affine conversion by way of the base unit of a family."""
    return (value * factor_from + offset_from - offset_to) / factor_to


def like_pattern(text: Column) -> Column:
    """A text as a LIKE pattern that matches itself alone."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def unit_key(unit: Column) -> Column:
    """Spelling of a unit without case, blanks and the two micro signs, powers as digits."""
    out = F.lower(F.regexp_replace(unit, r"\s+", ""))
    out = F.regexp_replace(F.translate(out, "µμ", "uu"), "[\\^*]", "")
    return F.translate(out, "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")


def numbers_of(text: Column) -> Column:
    """Readings of a number as an array: both, where a single mark before three digits may group or divide."""
    t = F.regexp_replace(F.trim(text), r"^[<>≤≥=~\s]+", "")
    plain = F.when(t.rlike(r"^-?\d+$"), F.array(t.cast("double")))
    both = F.when(t.rlike(r"^-?\d{1,3}[.,]\d{3}$"), F.array(F.regexp_replace(t, ",", ".").cast("double"), F.regexp_replace(t, "[.,]", "").cast("double")))
    decimal = F.when(t.rlike(r"^-?\d+[.,]\d+$"), F.array(F.regexp_replace(t, ",", ".").cast("double")))
    english = F.when(t.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"), F.array(F.regexp_replace(t, ",", "").cast("double")))
    german = F.when(t.rlike(r"^-?\d{1,3}(\.\d{3})+(,\d+)?$"), F.array(F.regexp_replace(F.regexp_replace(t, "\\.", ""), ",", ".").cast("double")))
    return F.coalesce(plain, both, decimal, english, german, F.array().cast("array<double>"))


def comparator(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(text), r"^(<=|>=|[<>≤≥=~])", 1), F.lit(""))


def raw_status(failed: Column, stored: Column) -> Column:
    """Status of a batch from counts of its payloads: failed beats pending beats done."""
    return F.when(failed > 0, "failed").when(stored > 0, "pending").otherwise("done")


def label_key(text: Column) -> Column:
    """Spelling of a label without case, marks and doubled blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+", " "))


def match_key(text: Column) -> Column:
    """Text without case, blanks and commas for points: what a printed value is looked for by."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), ",", "."), r"\s+", "")


def range_of(text: Column) -> tuple[Column, Column]:
    """Bounds of a printed range: ``a - b``, ``< b``, ``> a``; null where there is none."""
    t = F.regexp_replace(F.translate(F.trim(text), ",–", ".-"), r"\s+", "")
    low = F.coalesce(F.nullif(F.regexp_extract(t, r"^([0-9.]+)-[0-9.]+$", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^[>≥]=?([0-9.]+)$", 1), F.lit("")))
    high = F.coalesce(F.nullif(F.regexp_extract(t, r"^[0-9.]+-([0-9.]+)$", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^[<≤]=?([0-9.]+)$", 1), F.lit("")))
    return low.try_cast("double"), high.try_cast("double")


def ambiguous_date(text: Column) -> Column:
    """Whether a printed date reads both day before month and month before day."""
    a = F.regexp_extract(text, r"^\s*(\d{1,2})[./-](\d{1,2})[./-]\d{2,4}\s*$", 1).try_cast("int")
    b = F.regexp_extract(text, r"^\s*(\d{1,2})[./-](\d{1,2})[./-]\d{2,4}\s*$", 2).try_cast("int")
    return F.coalesce(a.between(1, 12) & b.between(1, 12) & (a != b), F.lit(False))


def rounded(value: Column, places: int = 6) -> Column:
    """Half away from zero, as results are shown."""
    return F.round(value, places)


def settled(value: Column, digits: int = 12) -> Column:
    """A sum or mean of doubles at so many significant digits: the same in whatever order its parts were added, so that a bound that it meets exactly is met.

    Beyond the sizes whose scale is an exact power of ten, it stays as it is.
    """
    size = F.abs(value)
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(size)))
    return F.when(size.between(1e-10, 1e11), F.rint(value * scale) / scale).otherwise(value)


def key_of(kind: Column, start: Column, date: Column, as_of: Column, reading: Column) -> Column:
    """Key of a window within its kind: the date, the UTC start, the instant it is as of, or the reading."""
    return F.when(kind.isin("local_day", "local_night"), F.date_format(date, "yyyy-MM-dd")).when(kind == "latest", window_key(as_of)).when(kind == "reading", reading).otherwise(window_key(start))
