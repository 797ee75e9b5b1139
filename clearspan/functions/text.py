"""Text and time formatting, labels and request checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import finite

NOT_RECORDED = "not recorded"
LOCAL_ZONE_HOURS = 8


def lane_text(lane: Column, direction: Column, side: Column) -> Column:
    """'up left lane' and the like; the side wins over the lane if it is left or right."""
    s = F.when(side.isin("left", "right"), side).otherwise(lane)
    known = F.concat_ws(" ", F.when(direction.isin("up", "down"), direction), s, F.lit("lane"))
    return F.when(s.isin("left", "right"), known).otherwise(NOT_RECORDED)


def format_endpoint(lat: Column, lon: Column, alt: Column, valid: Column) -> Column:
    place = F.format_string("N%.7f E%.7f", lat, lon)
    return F.when(valid, F.concat(place, F.when(alt.isNull(), "").otherwise(F.format_string(" H%.3fm", alt)))).otherwise(NOT_RECORDED)


def ns_to_iso_utc(ns: Column) -> Column:
    """ISO text with nine fractional digits."""
    whole = F.date_format(F.timestamp_seconds((ns - F.pmod(ns, F.lit(1_000_000_000))) / 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.lit("."), F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("Z"))


def iso_to_micros(text: Column) -> Column:
    """Microseconds of ISO text; digits past six are cut, and text without a zone is UTC."""
    cut = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    zoned = F.when(cut.rlike(r"(Z|[+-]\d{2}:\d{2})$"), cut).otherwise(F.concat(cut, F.lit("Z")))
    return F.unix_micros(F.to_timestamp(zoned))


def ms_to_local(ms: Column, hours: int = LOCAL_ZONE_HOURS) -> Column:
    """ISO text in the local zone with milliseconds, in sessions whose zone is UTC."""
    local = F.timestamp_millis(ms + hours * 3_600_000)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(f"+{hours:02d}:00"))


def safe_component(text: Column) -> Column:
    """A file-name part: other characters as one underscore, no dots or underscores at its ends, 80 characters at most."""
    clean = F.btrim(F.regexp_replace(F.trim(text), "[^0-9A-Za-z._-]+", "_"), F.lit("._"))
    short = F.substring(clean, 1, 80)
    return F.when(short == "", "tunnel").otherwise(short)


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def escape_markup(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def fixed(value: Column, digits: int, missing: str = "0") -> Column:
    """A number with fixed digits; the text export shows missing ones as 0."""
    return F.when(value.isNull(), missing).otherwise(F.format_string(f"%.{digits}f", value))


def optional_flag(value: Column) -> Column:
    return F.when(value.isNull(), "").when(value, "1").otherwise("0")


def fix_type(state: Column) -> Column:
    return F.when(state == 4, "RTK_FIXED").when(state == 5, "RTK_FLOAT").when(state == 2, "DGPS").when(state == 1, "SINGLE").otherwise("UNKNOWN")


def request_hash(*columns: str) -> Column:
    """sha256 of the canonical JSON of the columns: keys in order, no blanks."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def usable_key(key: Column) -> Column:
    """1 to 128 visible ASCII characters."""
    return key.rlike("^[\\x21-\\x7E]{1,128}$")


def text_violation(text: Column, most: int) -> Column:
    """Why a name is refused, or null."""
    t = F.trim(text)
    return F.when(t.isNull() | (t == ""), "empty").when(F.length(t) > most, "too_long").when(t.rlike("[\\x00-\\x1F\\x7F]"), "control_character")


def display_base(us: Column, hours: int = LOCAL_ZONE_HOURS) -> Column:
    return F.date_format(F.timestamp_micros(us + hours * 3_600_000_000), "yyyyMMdd_HHmmss")


def local_date(us: Column, hours: int = LOCAL_ZONE_HOURS) -> Column:
    return F.date_format(F.timestamp_micros(us + hours * 3_600_000_000), "yyyy-MM-dd")


def diagnostic_level(level: Column) -> Column:
    return F.when(level == 0, "ok").when(level == 1, "warning").when(level == 2, "error").when(level == 3, "stale").otherwise("unknown")


def typed_diagnostics(pairs: Column, integers: list[str], reals: list[str]) -> list[Column]:
    """Columns of a list of (key, value) structs: typed ones as numbers, null where the text is none; and the rest as a map."""
    m = F.map_from_entries(pairs)
    known = [F.try_element_at(m, F.lit(k)).try_cast("bigint").alias(k) for k in integers] + [F.try_element_at(m, F.lit(k)).try_cast("double").alias(k) for k in reals]
    return [*known, F.map_filter(m, lambda k, v: ~k.isin(*integers, *reals)).alias("other")]


def quality(ratio: Column) -> Column:
    return F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))


def rtk_sigma(sigma: Column, floor: float) -> Column:
    return F.when(finite(sigma) & (sigma > 0), F.greatest(sigma, F.lit(floor))).otherwise(F.lit(floor))


def fusion_mode(local: Column, raw_rtk: Column, aligned: Column, rtk: Column, lidar: Column) -> Column:
    return (F.when(~local, "INVALID").when(raw_rtk & ~aligned, "GLOBAL_ALIGNING").when(rtk & lidar, "GLOBAL_RTK_LIO").when(rtk, "GLOBAL_RTK_INS").when(lidar, "LOCAL_LIO").otherwise("LOCAL_INS"))


def localization_mode(global_valid: Column, raw_rtk: Column, rtk: Column) -> Column:
    return F.when(~global_valid, "INVALID").when(raw_rtk | rtk, "RTK").otherwise("DEAD_RECKONING")


def gnss_reliable(status: Column, lat: Column, lon: Column, alt: Column, fix_age: Column, status_age: Column, state: Column, rmc: Column, satellites: Column, hdop: Column, *, max_age: float = 1.0, min_satellites: int = 4, max_hdop: float = 5.0) -> Column:
    return (status >= 0) & finite(lat, lon, alt) & (fix_age <= max_age) & (status_age <= max_age) & (state > 0) & rmc.isin("A", "D") & (satellites >= min_satellites) & (~finite(hdop) | (hdop <= max_hdop))
