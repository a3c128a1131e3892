"""Column functions that score, band and compare."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def recency(created: Column, newest: Column, half_life: float = 90.0, missing: float = 0.5) -> Column:
    """Exponential decay by days from the newest record."""
    return F.coalesce(F.exp(F.lit(-math.log(2)) * F.datediff(newest, created) / half_life), F.lit(missing))


def access_recency(last_access: Column, today: Column, per_hour: float = 0.995) -> Column:
    return F.coalesce(F.pow(F.lit(per_hour), 24 * F.greatest(F.lit(0), F.datediff(today, last_access))), F.lit(0.0))


def utility(freq: Column, importance: Column, age_days: Column) -> Column:
    """The weights of importance and age are decimals, so whole days and a decimal importance are weighed exactly and rounded once."""
    return 0.6 * F.least(freq / 10, F.lit(1.0)) + F.lit(Decimal("0.4")) * importance - F.lit(Decimal("0.01")) * age_days


def note_action(stub: Column, utility_: Column, importance: Column) -> Column:
    return F.when(stub, "STUB").when(utility_ >= 0.35, "KEEP").when(importance < 0.30, "DELETE").otherwise("DISTIL")


def freshness(days: Column) -> Column:
    return F.when(days.isNull(), "Unknown").when(days <= 90, "Fresh").when(days <= 180, "Aging").when(days <= 365, "Stale").otherwise("Abandoned")


def adoption(uses: Column, favourites: Column) -> Column:
    return F.log10(uses + 1) / math.log10(600) * 6 + F.least(favourites, F.lit(40)) / 40 * 4


def depth(documents: Column, prompt_length: Column) -> Column:
    base = F.when(documents >= 5, 2).when(documents >= 1, 1).otherwise(0)
    return F.least(F.lit(2), base + F.when(prompt_length > 8000, 1).otherwise(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def sign_bits(v: Column) -> Column:
    """Bits of x >= 0 of up to 64 components in one long."""
    return F.aggregate(F.transform(v, lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def age_days(stamp: Column, now: Column) -> Column:
    """Whole days from a time stamp to now, 0 at least; null if it is none.  Without a zone it counts as UTC."""
    text = F.trim(stamp)
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).otherwise(F.concat(text, F.lit("Z")))
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(zoned))) / 86400)).cast("long")


def within(x: Column, y: Column, box: Column, pad: float = 3.0) -> Column:
    """Whether a point lies in a box (x0, top, x1, bottom) or at most pad beside it."""
    return (x >= box["x0"] - pad) & (x <= box["x1"] + pad) & (y >= box["top"] - pad) & (y <= box["bottom"] + pad)


def invocation_hash(payload: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(payload.cast("binary"), 256))
