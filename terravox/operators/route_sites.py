"""What fields say about sites: seed caps, site costs, start cells, corridors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.functions import geo
from terravox.operators import routing as R
from terravox.operators.routing import Grid
from terravox.operators.scaling import broadcast_if_small, shuffled_join
from terravox.session import keep

# Corridor tolerances, share of shells a width needs.
TAUS = (0.01, 0.02, 0.05)
MIN_COVERAGE = 0.5
SKIP_TOL = 1e-6


def caps(places: DataFrame, grid: Grid, radius_deg: float) -> DataFrame:
    """Adds the seed cap of each place: first and last row, centre column and half width.

    On a uniform grid these are index arithmetic; a half-way point goes to the lower index. Many
    places share one cap, so ``cap`` (its first row, last row, centre, half width) is the unit of
    work for anything that depends on the cap alone.
    """
    dlat, dlon = grid.lat[1] - grid.lat[0], grid.lon[1] - grid.lon[0]
    nlat, nlon = len(grid.lat), len(grid.lon)
    reach = max(1, round(radius_deg / abs(dlat)))
    j = F.least(F.lit(nlat - 1), F.greatest(F.lit(0), F.ceil(F.round((F.col("lat") - grid.lat[0]) / dlat, 9) - 0.5)))
    i = F.pmod(F.ceil(F.round((geo.wrap180(F.col("lon")) - grid.lon[0]) / dlon, 9) - 0.5), F.lit(nlon))
    squeeze = F.greatest(F.cos(F.radians("lat")), F.lit(geo.SEED_COS_FLOOR))
    wide = F.greatest(F.lit(1.0), F.rint(F.lit(radius_deg / abs(dlon)) / squeeze)).cast("int")
    return places.select(
        "*",
        F.greatest(F.lit(0), j - reach).cast("int").alias("cj0"),
        F.least(F.lit(nlat - 1), j + reach).cast("int").alias("cj1"),
        i.cast("int").alias("ci"),
        wide.alias("cw"),
    )


CAP = ["cj0", "cj1", "ci", "cw"]


def cap_number():
    """One number per cap from its four parts, each below 2^15: grids of up to 32,767 rows and columns."""
    part = lambda c: F.when(F.col(c).between(0, 32767), F.col(c).cast("bigint")).otherwise(F.raise_error(F.lit("the grid has too many rows or columns for a cap number")).cast("bigint"))
    number = part(CAP[0])
    for c in CAP[1:]:
        number = F.shiftleft(number, 15).bitwiseOR(part(c))
    return number


def cap_cells(capped: DataFrame, nlon: int) -> DataFrame:
    """Cells of each cap in reading order ``o``."""
    w = F.col("cw")
    c = capped.select("*", F.explode(F.sequence("cj0", "cj1")).alias("j"))
    c = c.select("*", F.posexplode(F.sequence(F.col("ci") - w, F.col("ci") + w)).alias("p", "x"))
    return c.withColumn("i", F.pmod("x", F.lit(nlon))).withColumn("o", (F.col("j") - F.col("cj0")) * (2 * w + 1) + F.col("p")).drop("p", "x")


def cap_minimum(fields: DataFrame, capped: DataFrame, keys: list[str], grid: Grid, unreached: bool = False) -> DataFrame:
    """Cheapest finite value in each cap at the seed shell and the cell it is found in.

    A cap without a finite value has no row, or, with ``unreached``, one with nulls.

    The field is filtered to one shell before it is unfolded. Caps are few (the grid bounds the
    number of distinct ones) and are broadcast after a check.
    """
    f = fields.filter(F.col("k") == grid.seed_shell()).select(*keys, "case", "j", F.posexplode("row").alias("i", "c"))
    side, _ = broadcast_if_small(cap_cells(capped.select(*CAP).distinct(), len(grid.lon)))
    found = F.col("c") != float("inf")
    m = (f if unreached else f.filter(found)).join(side, ["j", "i"])
    g = m.groupBy(*keys, "case", *CAP).agg(F.min(F.when(found, F.struct("c", "o", "j", "i"))).alias("b"))
    return g.select(*keys, "case", *CAP, F.col("b.c").alias("cost"), "b.j", "b.i")


SHELLS = "k int, c_best double, n bigint, total double, least double, cells array<bigint>, area array<double>"


def _shells(grid: Grid, ks: range, taus: tuple[float, ...]):
    """Arrivals and the cost field of a model as one row per case and shell, for ``routing.Fold``."""
    area = (grid.row_km * grid.col_km(slice(None)))[None, None, :]

    def make(cases, arrival, cost):
        with np.errstate(invalid="ignore"):
            j = next(iter(cost.values())).shape[0]
            t = np.stack([arrival[k] + cost[k] for k in ks])
            best = t.min(axis=(0, 2, 3))
            on = np.flatnonzero(np.isfinite(best))
            best, e = best[on], t[:, on] - best[on][:, None, None]
        finite = np.isfinite(e)
        inside = [(e <= (tau * best)[:, None, None]).sum(axis=3) for tau in taus]
        flat = lambda x: np.asarray(x).T.reshape(-1)  # noqa: E731  a case's shells one after the other
        cells = np.stack([flat(x.sum(axis=2)) for x in inside], axis=1)
        areas = np.stack([flat((x * area[..., :j]).sum(axis=2)) for x in inside], axis=1)
        ends = pa.array(np.arange(len(cells) + 1) * len(taus), pa.int32())
        return {
            "case": pa.array(np.repeat(np.array(cases)[on], len(ks)), pa.int32()),
            "k": pa.array(np.tile(np.array(ks), len(on)), pa.int32()),
            "c_best": pa.array(np.repeat(best, len(ks)), pa.float64()),
            "n": pa.array(flat(finite.sum(axis=(2, 3))), pa.int64()),
            "total": pa.array(flat(np.where(finite, e, 0.0).sum(axis=(2, 3))), pa.float64()),
            "least": pa.array(flat(e.min(axis=(2, 3))), pa.float64()),
            "cells": pa.ListArray.from_arrays(ends, pa.array(cells.reshape(-1), pa.int64())),
            "area": pa.ListArray.from_arrays(ends, pa.array(areas.reshape(-1), pa.float64())),
        }

    return make


def excess(spark, rows: DataFrame, keys: list[str], grid: Grid, units: list[R.Case], seeds: dict, cost: DataFrame, unit: str, spread: int, layout: R.Layout | None = None, taus=TAUS) -> DataFrame:
    """Excess cost of the best route through each cell over the best of its unit, per shell: ``keys, unit, k``, the
    best cost, cells that a route passes with the sum and the least of their excess, and cells and area
    inside each tolerance.

    An arrival field per unit is many times the input, so where a task holds a model's grid none leaves it:
    arrivals meet the cost field there. On larger grids they are written, and met by an equi join on the grid row.
    """
    case = units[0]
    ks = range(grid.seed_shell(), grid.target_shell(case.z_target) + 1)
    lay = layout or R.Layout.plan(grid, units)
    if lay.shells >= len(grid.depth) and lay.rows >= len(grid.lat):
        field = cost.filter(F.col("k").between(ks[0], ks[-1]))
        return R.solve(spark, rows, keys, grid, units, "arrival", seeds=seeds, layout=lay, spread=spread, fold=R.Fold(field, _shells(grid, ks, taus), SHELLS)).withColumnRenamed("case", unit)
    arrival = keep(R.solve(spark, rows, keys, grid, units, "arrival", seeds=seeds, layout=lay, spread=spread).filter(F.col("k").between(ks[0], ks[-1])), "arrivals")
    a = arrival.select(*keys, F.col("case").alias(unit), "k", "j", F.col("row").alias("d"))
    c = cost.select(*keys, "k", "j", F.col("row").alias("c"))
    t = shuffled_join(a, c, [*keys, "k", "j"]).select(*keys, unit, "k", "j", F.zip_with("d", "c", lambda x, y: x + y).alias("t"))
    best = t.groupBy(*keys, unit).agg(F.min(F.array_min("t")).alias("c_best"))
    best = best.filter(F.col("c_best") != float("inf"))
    e = t.join(best, [*keys, unit]).withColumn("row", F.transform("t", lambda x: x - F.col("c_best")))
    finite = F.filter("row", lambda x: x != float("inf"))
    wide = F.element_at(F.array(*[F.lit(float(grid.row_km * w)) for w in grid.col_km(slice(None))]), F.col("j") + 1)
    below = lambda tau: F.size(F.filter("row", lambda x: x <= tau * F.col("c_best")))
    within = [below(tau) for tau in taus]
    return e.groupBy(*keys, unit, "k", "c_best").agg(
        F.sum(F.size(finite)).alias("n"), F.sum(F.aggregate(finite, F.lit(0.0), lambda s, x: s + x)).alias("total"), F.min(F.array_min("row")).alias("least"),
        F.array(*[F.sum(x) for x in within]).alias("cells"), F.array(*[F.sum(x * wide) for x in within]).alias("area"))


def corridor_rows(exc: DataFrame, keys: list[str], unit: str, taus=TAUS) -> DataFrame:
    """Cells and area inside each tolerance, per shell."""
    per = F.explode(F.arrays_zip(F.array(*[F.lit(t) for t in taus]).alias("tau"), "cells", "area")).alias("p")
    return exc.select(*keys, unit, "k", "c_best", per).select(*keys, unit, "k", "c_best", "p.*")


def corridor_summary(rows: DataFrame, keys: list[str], unit: str, grid: Grid, k_seed: int, k0: int) -> DataFrame:
    """Size and width of each corridor. A shell it does not reach has no width; a corridor on less
    than half of the shells has none at all."""
    dz = float(grid.depth[1] - grid.depth[0])
    width = geo.equivalent_diameter(F.col("area"))
    g = rows.filter(F.col("k").between(k_seed, k0)).groupBy(*keys, unit, "tau").agg(
        F.first("c_best").alias("c_best"), F.sum("cells").alias("cells"), (F.sum("area") * dz / 1e9).alias("volume"),
        F.count(width).alias("shells"), F.median(width).alias("wm"), F.max(width).alias("wx"))
    cov = F.col("shells") / F.lit(k0 - k_seed + 1)
    ok = cov >= MIN_COVERAGE
    return g.select(*keys, unit, "tau", "c_best", "cells", "volume", "shells", cov.alias("coverage"), ok.alias("width_defined"),
                    F.when(ok, F.col("wm")).alias("width_med"), F.when(ok, F.col("wx")).alias("width_max"))
