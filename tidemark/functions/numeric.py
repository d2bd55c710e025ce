"""Number, ratio, level and time Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000


def _offset() -> Column:
    return F.expr("INTERVAL 8 HOURS")


def to_number(col: Column, default: float = 0.0) -> Column:
    """Double value; null, unparsable, NaN and infinities become ``default``."""
    value = col.try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, value).otherwise(F.lit(float(default)))


def to_whole(col: Column, default: int = 0) -> Column:
    """Long value truncated toward zero, with the same guards as ``to_number``."""
    value = col.try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(9.0e18))
    whole = col.cast("string").try_cast("bigint")
    return F.coalesce(whole, F.when(finite, value.cast("bigint")), F.lit(default).cast("bigint"))


def round_to(col: Column, digits: int = 4) -> Column:
    """Round half up in plain double arithmetic (no BigDecimal per row); null stays null."""
    scale = float(10 ** digits)
    return F.floor(col.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(part: Column, total: Column) -> Column:
    """part / total, 0 when the total is 0 or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(0.0))


def clip_norm(value: Column, cap: Column) -> Column:
    """min(max(value, 0) / max(cap, 1e-9), 1)."""
    return F.least(
        F.greatest(value.cast("double"), F.lit(0.0)) / F.greatest(cap.cast("double"), F.lit(1e-9)),
        F.lit(1.0),
    )


def log_norm(value: Column, cap: Column) -> Column:
    """log1p(value) / log1p(cap) within 0..1; 0 when either is not positive."""
    safe = (value > 0) & (cap > 0)
    return F.when(
        safe, F.least(F.log1p(value.cast("double")) / F.log1p(cap.cast("double")), F.lit(1.0))
    ).otherwise(F.lit(0.0))


def micros(col: Column) -> Column:
    """Six-digit fixed point, so that sums do not depend on the order of the rows."""
    return F.floor(col.cast("double") * F.lit(float(MICRO)) + F.lit(0.5))


def mean_micros(total: Column, n: Column) -> Column:
    """Mean of ``micros`` values: total / (1e6 * n), 0 when there are no rows."""
    return ratio(total, n * F.lit(float(MICRO)))


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= 80, "high").when(score >= 60, "medium_high")
        .when(score >= 40, "medium").otherwise("low")
    )


def followers_bucket(followers: Column, tier: Column) -> Column:
    return (
        F.when((tier < 1) | (followers <= 0) | tier.isNull() | followers.isNull(), "未覆盖")
        .when(followers < 10_000, "<1w").when(followers < 100_000, "1w-10w")
        .when(followers < 1_000_000, "10w-100w").otherwise("100w+")
    )


def growth_label(value: Column) -> Column:
    """'+12%' / '-3%', ties to even like printf."""
    sign = F.when(value >= 0, "+").otherwise("-")
    whole = F.bround(F.abs(value) * F.lit(100.0), 0).cast("bigint").cast("string")
    return F.concat(sign, whole, F.lit("%"))


def compact_count(col: Column) -> Column:
    """Counts as 1234 / 1.2万 / 3.4亿 for display."""
    def scaled(unit: float, suffix: str) -> Column:
        return F.concat(
            F.format_string("%.1f", round_to(col.cast("double") / F.lit(unit), 1)), F.lit(suffix)
        )
    return (
        F.when(F.abs(col) >= 100_000_000, scaled(1e8, "亿"))
        .when(F.abs(col) >= 10_000, scaled(1e4, "万"))
        .otherwise(col.cast("bigint").cast("string"))
    )


def local_day(ts: Column) -> Column:
    """Calendar day in the display zone (+08:00) of a UTC time."""
    return F.to_date(ts + _offset())


def local_iso(ts: Column) -> Column:
    """UTC time as an ISO string in the display zone."""
    return F.concat(
        F.date_format(ts + _offset(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00")
    )


def clamp_argument(raw, default: int, maximum: int) -> int:
    """Request limit: whole number in 1..maximum, ``default`` when unreadable."""
    try:
        value = int(raw)
    except (TypeError, ValueError):
        return default
    return max(1, min(value, maximum))


def topic_argument(raw) -> int | None:
    """Topic id of a request; None means all topics."""
    try:
        value = int(raw)
    except (TypeError, ValueError):
        return None
    return value if value > 0 else None
