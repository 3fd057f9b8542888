"""String cleaning, pattern tests, time parts and message texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and characters that must match for equal results.
SEMVER = r"^\d+\.\d+\.\d+$"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
HTML_TAG = r"<[^>]+>"
SPECIAL = r"[^\w\s-]"
DANGEROUS = "<>&\"'/\\"


def sanitize_string(
    text: Column, max_length: int | None = None, allow_html: bool = False, allow_special_chars: bool = True
) -> Column:
    """Drop NULs, cut to ``max_length`` if given, strip tags, drop special characters, trim: in that order."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\x00"), F.lit(""))
    out = out if max_length is None else F.substring(out, 1, max_length)
    if not allow_html:
        out = F.regexp_replace(out, HTML_TAG, "")
    if not allow_special_chars:
        out = F.regexp_replace(out, "(?U)" + SPECIAL, "")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def sanitize_input(text: Column, max_length: int | None = None) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), DANGEROUS, "")
    return out if max_length is None else F.substring(out, 1, max_length)


def is_semver(text: Column) -> Column:
    return text.rlike(SEMVER)


def is_email(text: Column) -> Column:
    return text.rlike(EMAIL)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact difference in seconds of two timestamps."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)


def time_features(ts: Column) -> dict[str, Column]:
    """hour, day_of_week (Monday is 0), month, is_weekend."""
    weekday = F.weekday(ts)
    return {
        "hour": F.hour(ts),
        "day_of_week": weekday,
        "month": F.month(ts),
        "is_weekend": weekday >= 5,
    }


def alert_message(name: Column, metric: Column, value: Column, operator: Column, threshold: Column, model: Column) -> Column:
    """'<name>: <metric> = <value, 4 digits> <operator> <threshold>[ for model <model>]'."""
    tail = F.coalesce(F.concat(F.lit(" for model "), model.cast("string")), F.lit(""))
    return F.concat(
        name, F.lit(": "), metric, F.lit(" = "), F.format_string("%.4f", value), F.lit(" "), operator, F.lit(" "),
        threshold.cast("string"), tail,
    )
