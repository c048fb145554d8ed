"""Small column functions shared by every operator."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean "nothing here" and tokens that mean "yes".
EMPTY_TOKENS = ("", "nan")
TRUE_TOKENS = ("true", "1", "yes")


def ratio(num: Column, den: Column) -> Column:
    """Quotient that is 0 when the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def clipped_logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1.0 - eps)
    return F.log(q / (1.0 - q))


def sigmoid(z: Column, limit: float = 50.0) -> Column:
    return 1.0 / (1.0 + F.exp(-clamp(z, -limit, limit)))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def harmonic(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def is_blank(text: Column) -> Column:
    """NULL, blanks or the token ``nan``."""
    return text.isNull() | F.lower(F.trim(text)).isin(*EMPTY_TOKENS)


def is_true(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*TRUE_TOKENS), F.lit(False))


def is_absent(text: Column) -> Column:
    return F.coalesce(F.lower(text) == "absent", F.lit(False))


def present(text: Column) -> Column:
    return text.isNotNull() & (F.trim(text) != "")


def safe_id(value: Column, trim: bool = True) -> Column:
    """True for ids that are usable as a folder name."""
    v = F.trim(value) if trim else value
    return (
        v.isNotNull()
        & (F.trim(v) != "")
        & ~v.isin(".", "..")
        & ~v.contains("/")
        & ~v.contains("\\")
        & ~v.contains("\x00")
    )


def reasons(*rules: tuple[Column, str]) -> Column:
    """Array of the messages of every rule that holds, in the given order."""
    return F.filter(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in rules]), lambda m: m.isNotNull())


def first_reason(default: str, *rules: tuple[Column, str]) -> Column:
    """Message of the first rule that holds."""
    (cond, msg), *rest = rules
    chain = F.when(cond, F.lit(msg))
    for cond, msg in rest:
        chain = chain.when(cond, F.lit(msg))
    return chain.otherwise(F.lit(default))


def short_fingerprint(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def hash_unit(*parts: Column) -> Column:
    """Deterministic number in [0, 1) from the first 8 hex digits of md5."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


