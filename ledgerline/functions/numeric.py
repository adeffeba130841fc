"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColOrName = Column | str


def _c(c: ColOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio_pct(num: ColOrName, den: ColOrName) -> Column:
    """``num / den * 100`` with a zero or NULL divisor giving NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double")) * F.lit(100.0)


def money(c: ColOrName) -> Column:
    """Exact money type so sums do not depend on row order."""
    return _c(c).cast("decimal(18,2)")


def as_double_money(c: ColOrName) -> Column:
    return _c(c).cast("double")


def sigmoid(z: ColOrName) -> Column:
    """Logistic function ``1 / (1 + exp(-z))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))
