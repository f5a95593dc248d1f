"""Scores of memories as column expressions; the moment asked at is an argument, never a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the scoring model
PINNED_SCORE, FEEL_SCORE = 999.0, 50.0
EMOTION_BASE, AROUSAL_BOOST, DECAY = 1.0, 0.8, 0.05
FRESH_HOURS, SHORT_DAYS, URGENT_AROUSAL, URGENCY = 36.0, 3.0, 0.7, 1.5
ARCHIVE_BELOW = 0.3


def days_since(moment: Column, at: Column, fallback: float = 30.0) -> Column:
    """Days from a timestamp_ntz to the moment asked at, 0 at least; the fallback for null."""
    micros = F.timestamp_diff("MICROSECOND", moment, at)
    return F.coalesce(F.greatest(F.lit(0.0), micros / F.lit(86400e6)), F.lit(fallback))


def freshness(days: Column) -> Column:
    return 1.0 + F.exp(-days * 24.0 / FRESH_HOURS)


def decay_score(at: Column, resolved: Column | None = None) -> Column:
    """Forgetting-curve score of a memory row, rounded to 4 digits."""
    resolved = F.col("resolved") if resolved is None else resolved
    days = days_since(F.coalesce("last_active", "created"), at)
    arousal = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("arousal", F.lit(0.3))))
    emotion, fresh = EMOTION_BASE + arousal * AROUSAL_BOOST, freshness(days)
    blend = F.when(days <= SHORT_DAYS, fresh * 0.7 + emotion * (1.0 - 0.7)).otherwise(emotion * 0.7 + fresh * (1.0 - 0.7))
    importance = F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce("importance", F.lit(5))))
    used = F.greatest(F.lit(1.0), F.coalesce("activation_count", F.lit(1.0)))
    base = importance * F.pow(used, F.lit(0.3)) * F.exp(-DECAY * days) * blend
    settled = F.when(resolved & F.col("digested"), 0.02).when(resolved, 0.05).otherwise(1.0)
    urgent = F.when((arousal > URGENT_AROUSAL) & ~resolved, URGENCY).otherwise(1.0)
    return F.when(F.col("pinned") | (F.col("type") == "permanent"), PINNED_SCORE).when(F.col("type").isin("feel", "plan", "letter"), FEEL_SCORE).otherwise(F.round(base * settled * urgent, 4))


def emotion_score(valence: Column, arousal: Column) -> Column:
    """Closeness in the valence-arousal plane; 0.5 where the query has no coordinates."""
    distance = F.sqrt(F.pow(valence - F.col("valence"), 2) + F.pow(arousal - F.col("arousal"), 2))
    return F.when(distance.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - distance / F.lit(2.0**0.5)))  # greatest() would skip the null


def time_score(at: Column) -> Column:
    return F.exp(-0.02 * days_since(F.coalesce("last_active", "created"), at))


def touch_score() -> Column:
    return F.least(F.coalesce("activation_count", F.lit(0.0)) / 10.0, F.lit(1.0))


def importance_score() -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce("importance", F.lit(5)))) / 10.0


#: The decay score for DuckDB, over the columns of memories.
DECAY_SQL = """CASE WHEN pinned OR type = 'permanent' THEN 999.0::DOUBLE WHEN type IN ('feel', 'plan', 'letter') THEN 50.0::DOUBLE ELSE round(
  importance * pow(greatest(1.0, activation_count), 0.3::DOUBLE) * exp(-0.05::DOUBLE * {days}) *
  CASE WHEN {days} <= 3.0 THEN (1.0 + exp(-{days} * 24.0::DOUBLE / 36.0::DOUBLE)) * 0.7::DOUBLE + (1.0 + arousal * 0.8::DOUBLE) * (1.0::DOUBLE - 0.7::DOUBLE)
       ELSE (1.0 + arousal * 0.8::DOUBLE) * 0.7::DOUBLE + (1.0 + exp(-{days} * 24.0::DOUBLE / 36.0::DOUBLE)) * (1.0::DOUBLE - 0.7::DOUBLE) END *
  CASE WHEN {resolved} AND digested THEN 0.02::DOUBLE WHEN {resolved} THEN 0.05::DOUBLE ELSE 1.0::DOUBLE END *
  CASE WHEN arousal > 0.7 AND NOT {resolved} THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, 4) END"""
DAYS_SQL = "greatest(0.0::DOUBLE, date_diff('microsecond', last_active, TIMESTAMP '2024-01-31 00:00:00') / 86400000000.0::DOUBLE)"
SCORE_SQL = DECAY_SQL.format(days=DAYS_SQL, resolved="resolved")
