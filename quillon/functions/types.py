"""Ordered labels, domains and ranges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def enum_rank(value: Column, labels: list[str]) -> Column:
    """Place of a label in its type's order; null for anything else."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in labels]), value), F.lit(0))


def in_domain(value: Column, *checks: Column) -> Column:
    """Whether a value meets its domain's checks; an unknown check passes."""
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(c, F.lit(True))
    return out


def make_range(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    """A range; a null bound is open without end."""
    return F.struct(lower.alias("lower"), upper.alias("upper"), F.lit(bounds[0] == "[").alias("lower_inc"), F.lit(bounds[1] == "]").alias("upper_inc"))


def range_empty(r: Column) -> Column:
    return F.coalesce((r["lower"] > r["upper"]) | ((r["lower"] == r["upper"]) & ~(r["lower_inc"] & r["upper_inc"])), F.lit(False))


def range_contains(r: Column, x: Column) -> Column:
    low = r["lower"].isNull() | (x > r["lower"]) | (r["lower_inc"] & (x == r["lower"]))
    high = r["upper"].isNull() | (x < r["upper"]) | (r["upper_inc"] & (x == r["upper"]))
    return low & high


def range_intersection(a: Column, b: Column) -> Column:
    """The common part; it may be empty."""
    lower, upper = F.greatest(a["lower"], b["lower"]), F.least(a["upper"], b["upper"])
    inc = lambda r, end, at: r[end].isNull() | (r[end] != at) | r[f"{end}_inc"]
    return F.struct(
        lower.alias("lower"),
        upper.alias("upper"),
        (F.coalesce(inc(a, "lower", lower), F.lit(True)) & F.coalesce(inc(b, "lower", lower), F.lit(True))).alias("lower_inc"),
        (F.coalesce(inc(a, "upper", upper), F.lit(True)) & F.coalesce(inc(b, "upper", upper), F.lit(True))).alias("upper_inc"),
    )


def range_overlaps(a: Column, b: Column) -> Column:
    return ~range_empty(a) & ~range_empty(b) & ~range_empty(range_intersection(a, b))


def range_adjacent(a: Column, b: Column) -> Column:
    """Whether two ranges touch without a common value."""
    meet = lambda p, q: (p["upper"] == q["lower"]) & (p["upper_inc"] != q["lower_inc"])
    return F.coalesce(meet(a, b), F.lit(False)) | F.coalesce(meet(b, a), F.lit(False))
