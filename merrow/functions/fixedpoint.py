"""Fixed-point scores: whole millionths, rounded half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merrow.config import SCALE


def quantize(value: Column) -> Column:
    """Units of a double in [0, 1]; values outside are clamped first."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return F.round(clamped.cast("decimal(20,18)") * F.lit(SCALE).cast("decimal(7,0)")).cast("long")


def contribution(raw: Column, weight: Column | int) -> Column:
    weight = F.lit(weight) if isinstance(weight, int) else weight
    total = raw.cast("long") * weight.cast("long") + SCALE // 2
    return ((total - total % SCALE) / SCALE).cast("long")


def score(units: Column) -> Column:
    return units / F.lit(float(SCALE))


def half_step_rating(rating: Column) -> Column:
    """Whether a rating is a multiple of a half from 0 to 10; true for a missing one."""
    return F.coalesce((rating * 2 == F.floor(rating * 2)) & rating.between(0, 10), F.lit(True))
