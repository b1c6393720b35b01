"""Scalar column expressions. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """True for a present, non-NaN, non-infinite value (never null); NaN sorts above infinity."""
    return F.coalesce(F.abs(c) < F.lit(INF), F.lit(False))


def finite_only(c: Column) -> Column:
    """The value, or null where it is missing, NaN or infinite."""
    return F.when(finite(c), c)


def coalesce_metric(c: Column, default: float) -> Column:
    """Null and NaN both read as *default*; infinities pass through."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(float(default)))


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, or 0.0 where the denominator is zero."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def label_from_class(c: Column, classes: Sequence[str]) -> Column:
    """Index of the class in its ordered list; null when unknown."""
    at = F.array_position(F.array(*[F.lit(x) for x in classes]), c)
    return F.when(at > 0, (at - 1).cast("int"))


def predicted_label(p: Column, threshold: Column) -> Column:
    return F.when(p >= threshold, F.lit(1)).otherwise(F.lit(0))


def predicted_class(label: Column, classes: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in classes]), label + 1)


def confidence(p: Column, label: Column) -> Column:
    """Probability of the *predicted* class."""
    return F.when(label == 1, p).otherwise(1.0 - p)


def max_confidence(p: Column) -> Column:
    """``max(p, 1 - p)``: what monitoring averages."""
    return F.greatest(p, 1.0 - p)


def route_decision(p: Column, threshold: Column, low: float, high: float) -> Column:
    """The review band wins, closed at both ends; otherwise the threshold decides."""
    return (
        F.when(p.between(low, high), F.lit("human_review"))
        .when(p >= threshold, F.lit("auto_reject"))
        .otherwise(F.lit("auto_accept"))
    )


def severity(psi: Column, warn: float, alert: float) -> Column:
    return (
        F.when(~finite(psi), F.lit("unknown"))
        .when(psi >= alert, F.lit("significant"))
        .when(psi >= warn, F.lit("moderate"))
        .otherwise(F.lit("none"))
    )


def fixed_text(c: Column, places: int) -> Column:
    """Fixed-point text, half-even on the binary value (like C ``%.nf``)."""
    return F.regexp_replace(F.format_number(c, places), ",", "")


def utc_iso(ts: Column) -> Column:
    """Second-resolution ISO-8601 text in UTC, whatever the session time zone."""
    utc = F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def format_ci(point: Column, lo: Column, hi: Column) -> Column:
    """``point [lo, hi]`` with four decimals, or ``-`` when the bound is absent."""
    text = F.concat(
        fixed_text(point, 4), F.lit(" ["), fixed_text(lo, 4), F.lit(", "), fixed_text(hi, 4), F.lit("]")
    )
    return F.when(lo.isNull() | F.isnan(lo), F.lit("-")).otherwise(text)


def present(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.array_compact(F.array(*items))


def hash_draw(seed: int | str, key: Column) -> Column:
    """A reproducible draw in ``[0, 2**32)`` per key: the leading md5 word."""
    digest = F.md5(F.concat(F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_order(seed: int | str, key: Column) -> Column:
    """The full md5 text, a reproducible shuffle order."""
    return F.md5(F.concat(F.lit(str(seed)), key.cast("string")))
