"""Column functions on labels and votes. Labels have three values; thresholds and memberships have two."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes of a four-class annotation, and the bounds of kappa's interpretation.
HATE = ("Hatespeech (enough context)", "Hatespeech (not enough context)")
UNCLEAR = ("Not Hatespeech (not enough context)", "Hatespeech (not enough context)")
KAPPA_BOUNDS = ((0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial"))
KAPPA_NAMES = ("poor", "slight", "fair", "moderate", "substantial", "almost perfect")


def majority(mean: Column, threshold: float = 0.5) -> Column:
    """1.0 if the mean reaches the threshold; a missing mean is 0.0."""
    return reaches(mean, threshold).cast("double")


def reaches(mean: Column, threshold: float = 0.5) -> Column:
    return F.coalesce(mean >= threshold, F.lit(False))


def either_majority(*means: Column) -> Column:
    out = reaches(means[0])
    for m in means[1:]:
        out = out | reaches(m)
    return out.cast("double")


def flag(c: Column) -> Column:
    """Any value but zero is true, a missing one too."""
    return F.coalesce(c != 0, F.lit(True))


def either_flag(*cols: Column) -> Column:
    out = flag(cols[0])
    for c in cols[1:]:
        out = out | flag(c)
    return out.cast("double")


def member(c: Column, values: Iterable[str]) -> Column:
    values = sorted(values)
    return F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(False)


def mapped(c: Column, table: dict) -> Column:
    """Values by ``table``; others and missing ones are null."""
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def hate_or_not(c: Column) -> Column:
    return F.when(member(c, HATE), "Hatespeech").otherwise("Not Hatespeech")


def context(c: Column) -> Column:
    return F.when(member(c, UNCLEAR), "Not Enough Context").otherwise("Enough Context")


def three_classes(c: Column) -> Column:
    return F.when(member(c, UNCLEAR), "Not Enough Context").otherwise(c)


def kappa_bucket(c: Column) -> Column:
    """Bounds are open below and closed above; exactly 0 has no name."""
    out = F.when(c < 0, "poor").when(c == 0, F.lit(None).cast("string"))
    for top, name in KAPPA_BOUNDS:
        out = out.when(c <= top, name)
    return out.when(c > KAPPA_BOUNDS[-1][0], "almost perfect")


def correlation(a: Column, b: Column) -> Column:
    """Pearson over rows where both stand; null where one does not vary."""
    a, b = a.cast("double"), b.cast("double")
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.when(spread > 0, spread))
