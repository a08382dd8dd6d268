"""Tubes below sites: a local minimum followed down through depth bins.

All sites of a model walk together, one depth bin a step. A step reaches as far sideways as the largest
tilt allows; a bin counts where the minimum stands out from the ring around it and is narrower than
a stated width; a walk that drifts too far from its site stays where it was.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.functions import geo
from terravox.operators.routing import Grid

#: Distances held at once by a walk: sites times cells.
HELD = 4_000_000


@dataclass(frozen=True)
class Tube:
    """Depth range and bin in km, largest tilt, rings from the centre, and what counts as a tube."""

    top: float = 0.0
    base: float = 2880.0
    bin_km: float = 360.0
    max_tilt: float = 73.0
    r_in: float = 1200.0
    r_out: float = 3000.0
    rings: int = 6
    prominence: float = 0.8
    width: float = 1800.0
    max_drift: float = 2500.0

    @property
    def step_km(self) -> float:
        return self.bin_km * float(np.tan(np.radians(self.max_tilt)))


def _arc(lat, lon, lats, lons) -> np.ndarray:
    """Kilometres from points (in radians, as a column) to cells (as a row)."""
    lat, lon = lat[:, None], lon[:, None]
    c = np.sin(lat) * np.sin(lats) + np.cos(lat) * np.cos(lats) * np.cos(lon - lons)
    return geo.EARTH_KM * np.arccos(np.clip(c, -1.0, 1.0))


def depth_bins(a: np.ndarray, depth: Sequence[float], t: Tube) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the shells of each bin (missing values left out) and the middle depths; empty bins are left out."""
    z = np.asarray(depth)
    n = np.floor((z - t.top) / t.bin_km).astype(int)
    bins = [b for b in np.unique(n) if b >= 0 and t.top + b * t.bin_km < t.base]
    out = []
    for b in bins:
        x = a[n == b]
        seen = np.isfinite(x)
        out.append(np.divide(np.where(seen, x, 0.0).sum(0), seen.sum(0), out=np.full(x.shape[1:], np.nan), where=seen.any(0)))
    return np.array(out), np.array([t.top + (b + 0.5) * t.bin_km for b in bins])


def walk(binned: np.ndarray, grid: Grid, lat: np.ndarray, lon: np.ndarray, t: Tube) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prominence, half width, drift) of every site and bin; NaN where there is nothing."""
    n, size = len(lat), binned[0].size
    lats = np.radians(np.repeat(grid.lat, len(grid.lon)))
    lons = np.radians(np.tile(grid.lon, len(grid.lat)))
    prom, half, drift = (np.full((n, len(binned)), np.nan) for _ in range(3))
    width = t.r_out / t.rings
    outer = (np.arange(t.rings) + 1) * width > t.r_in
    middle = (np.arange(t.rings) + 0.5) * width
    chunk = max(1, HELD // size)
    between = _arc(lats, lons, lats, lons) if size * size <= HELD else None
    for at in range(0, n, chunk):
        la, lo = np.radians(lat[at : at + chunk]), np.radians(lon[at : at + chunk])
        start = _arc(la, lo, lats, lons)
        here = start.copy()
        m = np.arange(len(la))
        for b, shell in enumerate(binned):
            v = shell.ravel()
            seen = np.isfinite(v)
            value = np.where(seen & (here <= t.step_km), v, np.inf)
            low = value.argmin(1)
            found = np.isfinite(value[m, low])
            # What is around a cell depends on the cell alone: sites that meet in one share it.
            cells, of = np.unique(low, return_inverse=True)
            around = between[cells] if between is not None else _arc(lats[cells], lons[cells], lats, lons)
            ring = np.floor(around / width).astype(np.int64)
            inside = (ring < t.rings) & seen
            slot = np.where(inside, np.arange(len(cells))[:, None] * t.rings + ring, 0)
            sums = np.bincount(slot[inside], np.broadcast_to(v, slot.shape)[inside], len(cells) * t.rings).reshape(-1, t.rings)
            many = np.bincount(slot[inside], minlength=len(cells) * t.rings).reshape(-1, t.rings)
            profile = np.divide(sums, many, out=np.full(sums.shape, np.nan), where=many > 0)
            far = np.isfinite(profile) & outer
            ring_mean = np.divide(np.where(far, profile, 0.0).sum(1), far.sum(1), out=np.full(len(cells), np.nan), where=far.any(1))
            centre = v[cells]
            tall, wide = ring_mean - centre, np.full(len(cells), np.nan)
            for q in np.flatnonzero(tall > 0):
                wide[q] = _half_width(middle, profile[q], centre[q] + 0.5 * tall[q])
            p = np.where(found, tall[of], np.nan)
            prom[at + m, b] = p
            away = start[m, low]
            drift[at + m, b] = np.where(found, away, np.nan)
            half[at + m, b] = np.where(p > 0, wide[of], np.nan)
            moved = found & (away <= t.max_drift)
            here[moved] = around[of[moved]]
    return prom, half, drift


def _half_width(middle: np.ndarray, profile: np.ndarray, level: float) -> float:
    """Where a ring profile first reaches a level, between the middles of two rings."""
    f = np.isfinite(profile)
    r, y = middle[f], profile[f]
    reached = np.flatnonzero(y >= level)
    if len(r) < 3 or not len(reached):
        return float("nan")
    k = int(reached[0])
    if k == 0:
        return float(r[0])
    return float(r[k - 1] + (level - y[k - 1]) * (r[k] - r[k - 1]) / max(y[k] - y[k - 1], 1e-9))


def best_run(ok: np.ndarray) -> tuple[int, int]:
    """First of the longest runs of true: (start, length)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
    if not len(edge):
        return 0, 0
    starts, ends = edge[::2], edge[1::2]
    n = int((ends - starts).argmax())
    return int(starts[n]), int(ends[n] - starts[n])


RESULT = "tube_km double, mean_prominence double, half_width_km double, z_top double, z_bot double, drift_km double"


def tubes(rows: DataFrame, keys: Sequence[str], grid: Grid, points: DataFrame, tube: Tube = Tube(), spread: int = 4) -> DataFrame:
    """The longest tube below each point in each model: ``keys``, columns of ``points``, and its score.

    A model's grid rows meet a share of the points; only positions travel with the points.
    """
    names = [c for c in points.columns if c not in ("lat", "lon")]
    share = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("share")
    cubes = rows.select(*keys, F.col("k").cast("int"), F.col("j").cast("int"), F.col("row").cast("array<double>"), share)
    models = rows.select(*[F.col(k).alias(k) for k in keys]).distinct()
    asked = models.crossJoin(points).withColumn("share", F.pmod(F.xxhash64(*names), F.lit(spread)).cast("int"))

    def kernel(key, left, right):
        a = np.full((len(grid.depth), len(grid.lat), len(grid.lon)), np.nan)
        if left.num_rows:
            flat = left.column("row").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            a[left.column("k").to_numpy(), left.column("j").to_numpy()] = flat.reshape(-1, len(grid.lon))
        binned, z = depth_bins(a, grid.depth, tube)
        lat, lon = (right.column(c).to_numpy().astype(float) for c in ("lat", "lon"))
        prom, half, drift = walk(binned, grid, lat, lon, tube)
        cols: dict[str, list] = {c.split()[0]: [] for c in RESULT.split(", ")}
        for p, h, d in zip(prom, half, drift):
            s, n = best_run((p >= tube.prominence) & (h <= tube.width))
            last = d[np.isfinite(d)]
            values = (n * tube.bin_km, p[s : s + n].mean() if n else None, float(np.median(h[s : s + n])) if n else None, z[s] if n else None, z[s + n - 1] if n else None, last[-1] if len(last) else None)
            for c, x in zip(cols, values):
                cols[c].append(x)
        out = {c: right.column(c) for c in (*keys, *names)}
        return pa.table({**out, **{c: pa.array(v, pa.float64()) for c, v in cols.items()}})

    schema = ", ".join([f"{c} {asked.schema[c].dataType.simpleString()}" for c in (*keys, *names)] + [RESULT])
    group = [*keys, "share"]
    return cubes.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(kernel, schema)
