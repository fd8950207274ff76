"""Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """A floating value with NaN and infinities as null."""
    c = c.cast("double")
    return F.when(F.abs(c) < float("inf"), c)


def to_number(c: Column) -> Column:
    """Text as a number, null where it is none."""
    return c.cast("string").try_cast("double")


def hour_of(c: Column) -> Column:
    """Hour of an ``HH:MM`` text."""
    return F.split(c, ":")[0].try_cast("int")


def sentinel_to_null(c: Column, sentinel: float = -1.0) -> Column:
    return F.nullif(c, F.lit(sentinel))


def round_clip(c: Column) -> Column:
    """Rounded half to even and clipped to 0 and 1."""
    return F.least(F.greatest(F.bround(c.cast("double")), F.lit(0.0)), F.lit(1.0)).cast("int")


def normalise_text(c: Column, unknown: str = "Unknown") -> Column:
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(unknown))


def bin_by_edges(c: Column, edges: Sequence[float] = (2.0, 7.0)) -> Column:
    """Number of edges that a value has reached; null stays null."""
    return F.when(c.isNull(), F.lit(None)).otherwise(sum((F.when(c >= e, 1).otherwise(0) for e in edges), F.lit(0))).cast("int")


def min_max(c: Column, low: Column, high: Column, fill: Column) -> Column:
    """Scaled by a range that is 1 wide where it would be empty; null takes ``fill`` first."""
    return (F.coalesce(c.cast("double"), fill) - low) / F.when(high > low, high - low).otherwise(F.lit(1.0))


def standardise(c: Column, mean: Column, std: Column) -> Column:
    """Centred and divided by the population deviation (1 where that is 0)."""
    return (c.cast("double") - mean) / F.when(std > 0, std).otherwise(F.lit(1.0))


def one_hot(c: Column, levels: Sequence[str], prefix: str, drop_first: bool = False) -> list[Column]:
    """A 0/1 column a level, in sorted order, without the first if asked."""
    return [F.when(c == v, 1).otherwise(0).alias(f"{prefix}_{v}") for v in sorted(levels)[1 if drop_first else 0 :]]


def hash_rank(seed: int, *ids: Column) -> Column:
    """A whole number that only the seed and the ids decide, on any engine with MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in ids])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def hash_unit(seed: int, *ids: Column) -> Column:
    """The same as a number in [0, 1)."""
    return hash_rank(seed, *ids) / float(1 << 52)


def hash_normal(seed: int, *ids: Column) -> Column:
    """A standard normal draw from two such numbers (Box-Muller)."""
    u, v = hash_unit(seed, *ids, F.lit("u")), hash_unit(seed, *ids, F.lit("v"))
    return F.sqrt(-2.0 * F.ln(1.0 - u)) * F.cos(2.0 * F.pi() * v)


def signature(parts: Sequence[Column]) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]), 256)


def round_if_finite(c: Column, digits: int) -> Column:
    return F.bround(clean(c), digits)


def log_fit(y: Column, x: Column) -> tuple[Column, Column]:
    """Aggregates: slope and intercept of y over ln x."""
    return F.regr_slope(y, F.ln(x)), F.regr_intercept(y, F.ln(x))


def padded(values: Column, size: int) -> Column:
    """An array cut or filled up with zeros to a length."""
    kept = F.slice(values, 1, size)
    return F.concat(kept, F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(kept), F.lit(0))))


def presence(values: Column, size: int) -> Column:
    """1 for each place of ``padded`` that holds a value, else 0."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.when(i <= F.size(values), 1.0).otherwise(0.0))


def duration_text(seconds: Column) -> Column:
    """Seconds as seconds, minutes or hours."""
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds < 3600, F.format_string("%.1fm", seconds / 60)).otherwise(F.format_string("%.1fh", seconds / 3600))


def guarded_corr(x: Column, y: Column, least_std: float = 1e-12) -> Column:
    """Aggregate: Pearson's r over the pairs where both are finite; null under two pairs or without variance."""
    x, y = clean(x), clean(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((F.count(a) >= 2) & (sa >= least_std) & (sb >= least_std), F.covar_pop(a, b) / (sa * sb))
