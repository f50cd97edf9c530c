"""Null-safe scalar functions. A missing value is NULL; NaN and infinities count as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts read as a missing number (fixed values).
MISSING_TEXTS = ("", "NA", "NaN", "nan", "None")
#: Texts read as true (fixed values).
TRUE_TEXTS = ("true", "1", "yes")

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_true(x: ColumnLike) -> Column:
    """Trimmed, case-blind truth of a text; NULL counts as false."""
    return F.coalesce(F.lower(F.trim(_c(x))).isin(*TRUE_TEXTS), F.lit(False))


def finite(x: ColumnLike) -> Column:
    """The number as DOUBLE, with NaN and infinities turned into NULL."""
    v = _c(x).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def try_number(x: ColumnLike, missing: tuple[str, ...] = MISSING_TEXTS) -> Column:
    """A finite DOUBLE from text; missing markers and malformed text give NULL."""
    text = F.trim(_c(x))
    return finite(F.when(~text.isin(*missing), text.try_cast("double")))


def strict_number(x: ColumnLike, low: float | None = None, high: float | None = None) -> Column:
    """A finite DOUBLE from text inside [low, high]; anything else raises."""
    v = try_number(x)
    ok = v.isNotNull()
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    return F.when(ok, v).otherwise(
        F.raise_error(F.concat(F.lit("not a number in range: "), F.coalesce(_c(x).cast("string"), F.lit("NULL")))).cast("double")
    )


def nonnegative(x: ColumnLike, positive: bool = False) -> Column:
    """The number itself; a negative (or, with ``positive``, zero) or missing one raises."""
    v = finite(x)
    ok = (v > 0) if positive else (v >= 0)
    return F.when(ok, v).otherwise(F.raise_error(F.lit("count outside its domain")).cast("double"))


def safe_ratio(n: ColumnLike, d: ColumnLike) -> Column:
    """n / d; NULL if the denominator is zero or either side is missing."""
    return F.try_divide(_c(n).cast("double"), _c(d).cast("double"))


def enrichment(observed: ColumnLike, expected: ColumnLike, total: ColumnLike) -> Column:
    """observed / expected without pseudocount; NULL for an empty total or a zero or missing expectation."""
    return F.when(_c(total) > 0, safe_ratio(observed, expected))


def safe_log2_ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """log2(a / b) when both are positive, else NULL."""
    return F.when((_c(a) > 0) & (_c(b) > 0), F.log2(_c(a) / _c(b)))


def accumulation(abundance: ColumnLike, unique: ColumnLike) -> dict[str, Column]:
    """Abundance against unique enrichment: ratio, difference and log2 of the ratio."""
    ratio = F.when(_c(unique) > 0, safe_ratio(abundance, unique))
    return {"ratio": ratio, "delta": _c(abundance) - _c(unique), "log2_ratio": F.when(ratio > 0, F.log2(ratio))}


def sum_all(*xs: ColumnLike) -> Column:
    """Sum that is NULL if any member is NULL."""
    out = _c(xs[0])
    for x in xs[1:]:
        out = out + _c(x)
    return out


def mixed_expectation(sense_share: ColumnLike, sense_expected: ColumnLike, anti_share: ColumnLike, anti_expected: ColumnLike) -> Column:
    """Expectation of both strands together, mixed by the observed strand shares."""
    return _c(sense_share) * _c(sense_expected) + _c(anti_share) * _c(anti_expected)


def directionality(down: ColumnLike, up: ColumnLike) -> Column:
    """(down - up) / (down + up); NULL if their sum is zero."""
    return safe_ratio(_c(down) - _c(up), _c(down) + _c(up))


def regional_deltas(unique: ColumnLike, abundance: ColumnLike, expected: ColumnLike) -> dict[str, Column]:
    """Unique and abundance shares against the expectation, and abundance against unique; NULL if a side is missing."""
    u, a, e = _c(unique), _c(abundance), _c(expected)
    return {"unique_delta": u - e, "abundance_delta": a - e, "accumulation_delta": a - u}


def representation_endpoint(mode: ColumnLike) -> Column:
    """The endpoint a weighting stands for."""
    return F.when(_c(mode) == "unique_sequence", "unique_representation").otherwise("abundance_representation")


def six_digits(x: ColumnLike) -> Column:
    """A number as text with six significant digits, no trailing zeros, and an exponent below 0.0001 or from a million on.

    A number whose shortest decimal form ends in a half rounds up, also where its binary value lies below the half.
    """
    v = F.abs(_c(x))
    # the exponent after rounding to six digits
    e = F.floor(F.log10(v))
    e = F.when(F.round(v / F.pow(F.lit(10.0), e), 5) >= 10, e + 1).otherwise(e)
    mantissa = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", F.round(v / F.pow(F.lit(10.0), e), 5)), "0+$", ""), r"\.$", "")
    sci = F.concat(mantissa, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    plain = F.concat(*[F.when((F.lit(5) - e) == d, F.format_string(f"%.{d}f", v)).otherwise("") for d in range(10)])
    plain = F.when(e >= 5, F.format_string("%.0f", v)).otherwise(F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", ""))
    body = F.when(v == 0, "0").when((e < -4) | (e >= 6), sci).otherwise(plain)
    return F.concat(F.when(_c(x) < 0, "-").otherwise(""), body)


def support_text(effect: ColumnLike, delta: ColumnLike, p: ColumnLike) -> Column:
    """The three findings as text, "not estimable" if one is missing."""
    text = F.concat(F.lit("effect="), six_digits(effect), F.lit("; delta="), six_digits(delta), F.lit("; corrected_p="), six_digits(p))
    return F.when(_c(effect).isNull() | _c(delta).isNull() | _c(p).isNull(), "not estimable").otherwise(text)


def clamp_window(window: ColumnLike, span: ColumnLike, length: ColumnLike) -> tuple[Column, Column]:
    """Folding window no longer than the sequence, and a span shorter than the window."""
    w = F.least(_c(window), _c(length))
    return w, F.least(_c(span), w - 1)


def or_default(x: ColumnLike, kind: str, default, allowed: list | None = None) -> Column:
    """A setting from untrusted text: cast, else the default; outside ``allowed`` also the default."""
    v = _c(x).try_cast(kind)
    if allowed is not None:
        v = F.when(v.isin(*allowed), v)
    return F.coalesce(v, F.lit(default).cast(kind))
