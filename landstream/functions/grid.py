"""Cells of regular grids and of the equal-area EASE-2 grids, and distances in degrees."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius that turns kilometres into degrees.
EARTH_KM = 6371.0


def km_to_deg(km: Column | float, lat: Column) -> tuple[Column, Column]:
    """Degrees of longitude and of latitude that a distance spans at a latitude."""
    km = km if isinstance(km, Column) else F.lit(float(km))
    dy = km * F.lit(180.0 / (math.pi * EARTH_KM))
    return dy / F.cos(F.radians(lat)), dy


@dataclass(frozen=True)
class LatLonGrid:
    """A regular grid; cells are numbered from 1, upwards or downwards along each axis."""

    ll_lon: float = -180.0
    ll_lat: float = -90.0
    dlon: float = 10.0
    dlat: float = 10.0
    n_lon: int = 36
    n_lat: int = 18
    i_dir: int = 1
    j_dir: int = 1

    #: Whether each cell is a tile; then one with several is an error.
    one_tile = False

    def cell(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Indices by ceiling: a point on an edge belongs to the cell below it."""
        i, j = F.ceil((lon - self.ll_lon) / self.dlon), F.ceil((lat - self.ll_lat) / self.dlat)
        i = i if self.i_dir > 0 else self.n_lon + 1 - i
        j = j if self.j_dir > 0 else self.n_lat + 1 - j
        return i.cast("int"), j.cast("int")

    def clamped(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        i, j = self.cell(lon, lat)
        return F.greatest(F.lit(1), F.least(i, F.lit(self.n_lon))), F.greatest(F.lit(1), F.least(j, F.lit(self.n_lat)))

    def inside(self, lon: Column, lat: Column) -> Column:
        return (lon > self.ll_lon) & (lon < self.ll_lon + self.n_lon * self.dlon) & (lat > self.ll_lat) & (lat < self.ll_lat + self.n_lat * self.dlat)


#: Fixed values of the EASE-2 grids: map scale in metres, columns, rows.
EASE2 = {
    "M36": (36032.220840584, 964, 406), "M09": (9008.055210146, 3856, 1624), "M03": (3002.6850700487, 11568, 4872), "M01": (1000.89502334956, 34704, 14616),
    "N36": (36000.0, 500, 500), "N09": (9000.0, 2000, 2000), "N03": (3000.0, 6000, 6000), "N01": (1000.0, 18000, 18000),
    "S36": (36000.0, 500, 500), "S09": (9000.0, 2000, 2000), "S03": (3000.0, 6000, 6000), "S01": (1000.0, 18000, 18000),
}
#: Fixed values of the WGS 84 ellipsoid: equatorial radius and eccentricity.
RADIUS, ECCENTRICITY = 6378137.0, 0.081819190843
_E2 = ECCENTRICITY**2
_POLE = 1 - (1 - _E2) / (2 * ECCENTRICITY) * math.log((1 - ECCENTRICITY) / (1 + ECCENTRICITY))
_KZ = math.cos(math.radians(30)) / math.sqrt(1 - _E2 * math.sin(math.radians(30)) ** 2)


def _authalic(lat: Column) -> Column:
    """q of Snyder's equal-area formulas."""
    s = F.sin(F.radians(lat))
    e = ECCENTRICITY
    return (1 - _E2) * (s / (1 - _E2 * s * s) - F.lit(1 / (2 * e)) * F.log((1 - e * s) / (1 + e * s)))


def ease2_cell(lat: Column, lon: Column, grid: str) -> tuple[Column, Column]:
    """Row and column, from 0, of a point; null in the hemisphere that a polar grid leaves out."""
    scale, cols, rows = EASE2[grid]
    q, lam = _authalic(lat), F.radians(lon)
    if grid[0] == "M":
        x, y = RADIUS * _KZ * lam, RADIUS * q / (2 * _KZ)
    else:
        sign = 1 if grid[0] == "N" else -1
        rho = RADIUS * F.sqrt(F.greatest(F.lit(_POLE) - sign * q, F.lit(0.0)))
        x, y = rho * F.sin(lam), -sign * rho * F.cos(lam)
    row = F.round(F.lit((rows - 1) / 2) - y / scale).cast("int")
    col = F.round(F.lit((cols - 1) / 2) + x / scale).cast("int")
    if grid[0] == "M":
        return row, F.least(F.greatest(col, F.lit(0)), F.lit(cols - 1))
    here = lat >= 0 if grid[0] == "N" else lat <= 0
    return F.when(here, row), F.when(here, col)


def ease2_latlon(row: Column, col: Column, grid: str) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's centre (or of fractional indices)."""
    scale, cols, rows = EASE2[grid]
    x, y = (col - (cols - 1) / 2) * scale, (F.lit((rows - 1) / 2) - row) * scale
    if grid[0] == "M":
        beta, lam = F.asin(y * (2 * _KZ / (RADIUS * _POLE))), x / (RADIUS * _KZ)
    else:
        sign = 1 if grid[0] == "N" else -1
        beta, lam = sign * F.asin(1 - (x * x + y * y) / (_POLE * RADIUS**2)), F.atan2(x, -sign * y)
    e4, e6 = _E2**2, _E2**3
    terms = ((2, _E2 / 3 + 31 / 180 * e4 + 517 / 5040 * e6), (4, 23 / 360 * e4 + 251 / 3780 * e6), (6, 761 / 45360 * e6))
    lat = F.degrees(beta + sum(c * F.sin(k * beta) for k, c in terms))
    lon = F.degrees(lam)
    lon = F.when(lon < -180, lon + 360).when(lon > 180, lon - 360).otherwise(lon)
    if grid[0] == "M":
        return lat, lon
    here = lat >= 0 if grid[0] == "N" else lat <= 0
    return F.when(here, lat), F.when(here, lon)


@dataclass(frozen=True)
class EaseGrid:
    """An equal-area grid by name (M36, M09, N09, ...); columns and rows are numbered from 0, rows from the north."""

    name: str

    one_tile = True

    def cell(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(column, row) of a point; of those beyond the grid, rows are beyond its rows, or null where a polar grid has none."""
        row, col = ease2_cell(lat, lon, self.name)
        return col, row

    def clamped(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        _, cols, rows = EASE2[self.name]
        bound = lambda x, n: F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(x, F.lit(n - 1))))
        col, row = self.cell(lon, lat)
        return bound(col, cols), bound(row, rows)

    def inside(self, lon: Column, lat: Column) -> Column:
        _, cols, rows = EASE2[self.name]
        col, row = self.cell(lon, lat)
        return F.coalesce((lon > -180) & (lon < 180) & col.between(0, cols - 1) & row.between(0, rows - 1), F.lit(False))

    def centre(self, col: Column, row: Column) -> tuple[Column, Column]:
        lat, lon = ease2_latlon(row, col, self.name)
        return lon, lat


Grid = LatLonGrid | EaseGrid


def neighbours(grid: Grid, i: Column, j: Column, reach: int = 1) -> Column:
    """Cells within reach of one, itself included, as an array of (i, j); columns of a grid around the globe go on over its edge."""
    if isinstance(grid, EaseGrid):
        (_, cols, rows), first, around = EASE2[grid.name], 0, grid.name[0] == "M"
    else:
        cols, rows, first, around = grid.n_lon, grid.n_lat, 1, abs(grid.n_lon * grid.dlon - 360) < 1e-9
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    turned = lambda x: F.pmod(x - first, F.lit(cols)) + first if around else x
    pairs = F.flatten(F.transform(steps, lambda a: F.transform(steps, lambda b: F.struct(turned(i + a).alias("i"), (j + b).alias("j")))))
    within = lambda c: c["i"].between(first, first + cols - 1) & c["j"].between(first, first + rows - 1)
    return F.array_distinct(F.filter(pairs, within))


def curve(lon: Column, lat: Column, bits: int = 20) -> Column:
    """A place's number along a curve that keeps neighbours together: the bits of its cell's column and row in turn."""

    def apart(x: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    cell = lambda x, whole: F.greatest(F.least(F.floor(x / whole * (1 << bits)), F.lit((1 << bits) - 1)), F.lit(0)).cast("long")
    return apart(cell(lon + 180, 360.0)).bitwiseOR(F.shiftleft(apart(cell(lat + 90, 180.0)), 1))
