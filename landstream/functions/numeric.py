"""Numeric columns: sentinels, clipping, tapers, polynomials, perturbations and elementwise record arithmetic."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_if_nodata(x: Column, nodata: float = -9999.0, share: float = 1e-4) -> Column:
    return F.when(F.abs(x - nodata) >= abs(nodata * share), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0: one such row must not end a job."""
    return F.try_divide(a, b)


def clip_abs(x: Column, most: float | Column) -> Column:
    return F.signum(x) * F.least(F.abs(x), most if isinstance(most, Column) else F.lit(most))


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(F.least(x, as_col(high)), as_col(low))


def gaspari_cohn(dx: Column, dy: Column, xc: float, yc: float) -> Column:
    """Fifth-order taper of compact support: 1 at the centre, 0 from twice the half length on."""
    d = 2 * F.sqrt((dx / xc) * (dx / xc) + (dy / yc) * (dy / yc))
    near = F.lit(1.0) - F.lit(5 / 3) * d**2 + 0.625 * d**3 + 0.5 * d**4 - 0.25 * d**5
    far = F.lit(4.0) - 5 * d + F.lit(5 / 3) * d**2 + 0.625 * d**3 - 0.5 * d**4 + d**5 / 12 - F.lit(2 / 3) / d
    inside = (F.abs(dx) <= xc) & (F.abs(dy) <= yc) & (d < 2)
    return F.when(~inside, 0.0).when(d <= 1e-3, 1.0).when(d <= 1, near).otherwise(far)


def polyval(coefficients: Column, x: Column) -> Column:
    """Horner's rule over an array, highest order first."""
    return F.aggregate(coefficients, F.lit(0.0), lambda acc, c: acc * x + c)


def apply_pert(x: Column, p: Column, kind: Column, dt: float = 1.0) -> Column:
    """Additive (kind 0) or multiplicative (kind 1) perturbation over a time step."""
    return F.when(kind == 0, x + p * dt).when(kind == 1, x * F.pow(p, F.lit(dt)))


def adapt_pert(p: Column, kind: Column, factor: Column, mu: Column, sigma: Column) -> Column:
    """Perturbations whose variance follows an adaptive factor; log-normal ones (kind 1) get new parameters of mean 1."""
    normal = F.sqrt(factor) * (p - mu) + mu
    spread = F.log1p(factor * (F.exp(-2 * mu) - 1))
    log_normal = F.exp(-0.5 * spread + F.sqrt(spread) * (F.log(p) - mu) / sigma)
    return F.when(kind == 0, normal).when(kind == 1, log_normal)


def ens_id_string(member: Column, width: int = 4) -> Column:
    return F.concat(F.lit("ens"), F.lpad(member.cast("string"), width, "0"))


def elementwise(df: DataFrame, columns: list[str], how: Callable[[Column], Column]) -> DataFrame:
    """The same expression over every field of a record."""
    return df.withColumns({c: how(F.col(c)) for c in columns})


def all_valid(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def combine(df: DataFrame, columns: list[str], other: str, how: Callable[[Column, Column], Column]) -> DataFrame:
    """The same expression over the fields of two records; the second's have a prefix."""
    return df.withColumns({c: how(F.col(c), F.col(f"{other}{c}")) for c in columns})


def closest(x: Column, options: list[float]) -> Column:
    """The listed value that is nearest; of equals the first in order of size."""
    return F.array_min(F.array(*(F.struct(F.abs(x - o).alias("d"), F.lit(float(o)).alias("v")) for o in options)))["v"]


def round_half_up(x: Column, digits: int) -> Column:
    """F.round(x, digits) of doubles, bit by bit, without a decimal for each: a whole number over a power of ten is the double nearest
    to it. Close to a half, where the product's own rounding could decide, and beyond the whole numbers of doubles, F.round itself."""
    scaled = F.abs(x) * 10.0**digits
    whole = F.floor(scaled + 0.5)
    plain = (scaled < 2.0**40) & (F.abs(scaled - F.floor(scaled) - 0.5) > 2.0**-10)
    return F.when(plain, F.signum(x) * (whole / 10.0**digits)).otherwise(F.round(x, digits))
