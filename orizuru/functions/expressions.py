"""Scalar expressions shared by the operators. Each has a SQL twin with the same arithmetic in `plans.oracles`."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pseudo-counts of the Bayesian ratings, by role; the main roles in record order, genga last.
PSEUDO_COUNT = {"director": 2.0, "series_comp": 2.0, "char_design": 2.0, "unit_director": 4.0, "sakkan": 4.0, "music": 2.0, "art_dir": 4.0, "genga": 6.0, "all": 6.0}
MAIN_ROLES = ("director", "series_comp", "char_design", "unit_director", "sakkan", "music", "art_dir")
STAFF_ROLES = (*MAIN_ROLES, "genga")

#: Score tiers (lowest score of each), percentile tiers of persons, percentile tiers of the dashboard.
SCORE_TIERS = ((70.0, "S+"), (65.0, "S"), (60.0, "A+"), (55.0, "A"), (50.0, "B+"), (45.0, "B"), (40.0, "C"))
STAFF_TIERS = ((2.3, "S+"), (6.7, "S"), (15.9, "A+"), (30.9, "A"), (50.0, "B+"), (70.0, "B"), (85.0, "C"))
RANK_TIERS = ((1.0, "S+"), (5.0, "S"), (15.0, "A+"), (30.0, "A"), (50.0, "B"), (75.0, "C"))


def rnd(x: Column, digits: int) -> Column:
    """Round half up on the double itself, so that every engine gives the same digits. Sums that may lie on a tie are
    taken exactly, see `exact_sum`."""
    p = float(10**digits)
    return F.floor(x * p + 0.5) / p


def exact_sum(c: str | Column) -> Column:
    """A sum that doesn't hang on the order of the rows: over nine decimal digits of each value."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(20,9)")).cast("double")


def pseudo_counts(override: dict[str, float] | None = None) -> dict[str, float]:
    """The pseudo-counts with some of them replaced."""
    return PSEUDO_COUNT | (override or {})


def pseudo_count(role: Column, counts: dict[str, float] = PSEUDO_COUNT) -> Column:
    """Pseudo-count of a role; unknown roles and null have that of all roles."""
    out = F.when(F.lit(False), 0.0)
    for r, m in counts.items():
        out = out.when(role == r, m)
    return out.otherwise(counts["all"])


def role_order(role: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for k, r in enumerate(STAFF_ROLES):
        out = out.when(role == r, k)
    return out


def _ladder(value: Column, steps, below: bool) -> Column:
    out = F.when(F.lit(False), "")
    for limit, tier in steps:
        out = out.when(value <= limit if below else value >= limit, tier)
    return out.otherwise("D")


def score_tier(deviation: Column) -> Column:
    return _ladder(deviation, SCORE_TIERS, below=False)


def percentile(rank: Column, total: Column) -> Column:
    return F.when(total > 0, rank / total * 100.0).otherwise(100.0)


def staff_tier(rank: Column, total: Column) -> Column:
    return F.when((total <= 0) | (rank <= 0), "-").otherwise(_ladder(rank / total * 100.0, STAFF_TIERS, below=True))


def rank_tier(rank: Column, total: Column) -> Column:
    return F.when(F.coalesce(rank, F.lit(0)).cast("int") * F.coalesce(total, F.lit(0)) <= 0, "-").otherwise(_ladder(rank / total * 100.0, RANK_TIERS, below=True))


def top_percent(z: Column) -> Column:
    """Share of the normal distribution above z in percent, by Winitzki's error function, within 0.01 and 99.99."""
    x2 = (F.abs(z) / math.sqrt(2.0)) * (F.abs(z) / math.sqrt(2.0))
    erf = F.when(z < 0, -1.0).otherwise(1.0) * F.sqrt(1 - F.exp(-x2 * (4 / math.pi + 0.147 * x2) / (1 + 0.147 * x2)))
    return F.greatest(F.lit(0.01), F.least(F.lit(99.99), (1 - 0.5 * (1 + erf)) * 100))


def z_tier(z: Column) -> Column:
    return _ladder(top_percent(z), RANK_TIERS, below=True)


def deviation(z: Column) -> Column:
    return rnd(50.0 + 10.0 * z, 1)


def z_of_deviation(score: Column) -> Column:
    return (score - 50.0) / 10.0


def top_text(percent: Column) -> Column:
    """How a share at the top is written: two digits under one percent, one above, and a floor."""
    return F.when(percent < 0.1, "< 0.1%").otherwise(F.concat(F.format_string("%.1f", percent), F.lit("%")))


def verdict(residual: Column) -> Column:
    return F.when(residual > 0.4, "surprise").when(residual < -0.4, "disappointing").otherwise("as expected")
