"""The distance formula over exact integer moments, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(38,0)"


def jaccard(inter: Column, uni: Column) -> Column:
    return F.when((inter > 0) & (uni > 0), inter / uni).otherwise(F.lit(0.0))


def naive_distance(j: Column, k: Column) -> Column:
    """1 - (2j / (1 + j))^(1/k)."""
    return 1 - F.pow(2 * j / (1 + j), 1 / k)


def homoplasy(inter: Column, uni: Column, su: Column, su2: Column, si: Column, si2: Column, k: Column) -> Column:
    """The share of chance matches, from simplicities' means and variances over the union and the intersection.

    The positive root of Vu x^2 + B x - Dmu^2 = 0; 0 unless the intersection is simpler than the union, which
    is decided in exact integers.
    """
    k2 = (k * k).cast("double")
    mean_u, mean_i = su / k2 / uni, si / k2 / inter
    var_u = F.greatest(su2 / (k2 * k2) / uni - mean_u * mean_u, F.lit(0.0))
    var_i = F.greatest(si2 / (k2 * k2) / inter - mean_i * mean_i, F.lit(0.0))
    gap2 = (mean_i - mean_u) * (mean_i - mean_u)
    b = var_i - var_u + gap2
    root = F.sqrt(F.greatest(b * b + 4 * var_u * gap2, F.lit(0.0)))
    x = F.when(b > 0, 2 * gap2 / (b + root)).otherwise((root - b) / (2 * var_u))
    simpler = si.cast(_WIDE) * uni.cast(_WIDE) > su.cast(_WIDE) * inter.cast(_WIDE)
    return F.when(simpler & (var_u > 1e-12), F.least(F.greatest(x, F.lit(0.0)), F.lit(0.999999))).otherwise(F.lit(0.0))


def calibrated(d: Column, x: Column, k: Column, jukes_cantor: bool = False) -> Column:
    """d - ln(1 - x) / k, optionally by Jukes-Cantor (1 from 0.75 on), held between 0 and 1."""
    d = d - F.log(1 - x) / k
    if jukes_cantor:
        d = F.when(d >= 0.75, F.lit(1.0)).otherwise(-0.75 * F.log(1 - 4 * d / 3))
    return F.least(F.greatest(d, F.lit(0.0)), F.lit(1.0))
