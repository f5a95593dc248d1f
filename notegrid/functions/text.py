"""Text transforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4e00}-\x{9fff}]"


def token_estimate(text: Column) -> Column:
    """1.5 a CJK character, 1.3 a latin word, 0.05 a character; truncated."""
    return (F.regexp_count(text, F.lit(CJK)) * 1.5 + F.regexp_count(text, F.lit("[a-zA-Z]+")) * 1.3 + F.length(text) * 0.05).cast("long")


def sanitized(text: Column) -> Column:
    """Without control and bidirectional characters; line feed, return and tab stay."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{202A}-\x{202E}\x{2066}-\x{2069}]", "")


def wikilinks(text: Column) -> Column:
    """Distinct targets of [[target|alias]] and [[target#section]], in order."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def without_wikilinks(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]", "$1")


def slug(name: Column) -> Column:
    kept = F.substring(F.trim(F.regexp_replace(name, r"(?U)[^\w\s\x{4e00}-\x{9fff}-]", "")), 1, 80)
    return F.when(F.coalesce(kept, F.lit("")) == "", "unnamed").otherwise(kept)


def normalized_list(values: Column, most: int, chars: int) -> Column:
    """Trimmed, without blanks, distinct in order, at most so many of so many characters."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda x: F.substring(F.trim(x), 1, chars)), lambda x: x != "")), 1, most)


def state_key(value: Column) -> Column:
    """Lower case, single spaces; null where it is empty, too long or has control characters."""
    key = F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))
    return F.when((key != "") & (F.length(key) <= 120) & ~F.rlike(value, F.lit(r"[\x00-\x08\x0E-\x1F\x7F]")), key)


def logical_day(moment: Column, cutoff_hours: int = 4, zone: str = "UTC") -> Column:
    """Date in the zone, a day lasting until the cutoff hour."""
    return F.to_date(F.from_utc_timestamp(moment.cast("timestamp"), zone) - F.expr(f"INTERVAL {cutoff_hours} HOURS"))


def excerpt(text: Column, imperatives: list[str], limit: int = 280) -> Column:
    """Single spaces, imperative phrases redacted, cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.substring(F.regexp_replace(flat, "(?i)" + "|".join(imperatives), "[redacted]"), 1, limit)


def affect(valence: Column, arousal: Column) -> Column:
    """Label of the quadrant, with a middle band from 0.35 to 0.65."""
    v = F.when(valence < 0.35, "negative").when(valence > 0.65, "positive").otherwise("neutral")
    a = F.when(arousal < 0.35, "calm").when(arousal > 0.65, "intense").otherwise("moderate")
    return F.concat(v, F.lit("/"), a)
