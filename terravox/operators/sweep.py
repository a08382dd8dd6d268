"""A whole sweep of search configurations over each model, with and without injected conduits.

A configuration is a contrast exponent, a target depth, a channel, a reach along a shell and a seed
radius. Radii share a field; so do reaches that are the same number of steps on the grid. The fields of
one channel go up the model together, one shell at a time: the mean anomaly that a move crosses is
computed once for all exponents, the price of a move once for all targets, and all targets pond in
one step. Only the shells that a slanted move can span are held.

An injected conduit is patched into the cube in place and taken out again from the saved shells, so a task
holds one cube whatever the number of injections. The contrast channel follows by the same linear filter.
Work is spread over models and shares of the exponents or injections.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.operators import routing as R
from terravox.operators import shapes
from terravox.operators.injection import axis
from terravox.operators.topology import Smoother

# Fixed values of the sweep: exponents, target depths, channels, reaches in km, seed radii in degrees,
# width of the background in km.
S_VALUES = (0.3, 0.4, 0.5, 0.65, 0.8, 1.2)
TARGETS = (2300.0, 2500.0, 2700.0, 2800.0)
CHANNELS = ("min", "anom", "contrast")
REACHES = (300.0, 900.0)
RADII = (2.0, 3.0)
BACKGROUND_KM = 800.0
#: Values of all fields that one step of a task may hold.
STEP_VALUES = 8_000_000


@dataclass(frozen=True)
class Config:
    """One field of the sweep; with each seed radius it is a configuration."""

    case: int
    s: float
    z_target: float
    channel: str
    h_max: float


def configurations(grid: R.Grid, s=S_VALUES, targets=TARGETS, channels=CHANNELS, reaches=REACHES) -> list[Config]:
    """The fields of the full grid of settings; targets below the deepest shell are left out."""
    deepest = max(grid.depth)
    chosen = product(s, [z for z in targets if z <= deepest], channels, reaches)
    return [Config(n, *c) for n, c in enumerate(chosen)]


class Frame:
    """Fields (way, row, column, exponent) with a margin: walls beyond the rows, the ring of columns carried on. The
    value of a cell some steps away is then a view with long runs, and nothing is copied per move."""

    def __init__(self, shape: tuple[int, int, int, int], reach: int):
        ways, self.nlat, self.nlon, exponents = shape
        self.reach = reach
        self.a = np.full((ways, self.nlat + 2 * reach, self.nlon + 2 * reach, exponents), np.inf)
        self.left, self.right = np.arange(-reach, 0) % self.nlon, np.arange(reach) % self.nlon

    def put(self, field: np.ndarray) -> Frame:
        r = self.reach
        rows = self.a[:, r : r + self.nlat]
        rows[:, :, r : r + self.nlon] = field
        rows[:, :, :r], rows[:, :, r + self.nlon :] = field[:, :, self.left], field[:, :, self.right]
        return self

    def away(self, axis: int, step: int) -> np.ndarray:
        j, i = self.reach + (step if axis == 0 else 0), self.reach + (step if axis == 1 else 0)
        return self.a[:, j : j + self.nlat, i : i + self.nlon]


class Cube:
    """One model with its channels; conduits are patched in and taken out in place."""

    def __init__(self, grid: R.Grid, a: np.ndarray, sigma_km: float):
        self.grid = grid
        self.seen, self.holes = np.isfinite(a), np.isposinf(a)
        self.anom = np.where(self.seen, a, 0.0)
        self.smoother = Smoother(grid.lat, abs(grid.lon[1] - grid.lon[0]), a.shape[2], sigma_km)
        # A value that is missing has no weight; where the model has no cell, nothing is added.
        self.weight = self.smoother((self.seen | self.holes).astype(float))
        self.contrast = self._less_background(self.anom, slice(None))

    def _less_background(self, a: np.ndarray, k) -> np.ndarray:
        w = self.weight[k]
        around = np.divide(self.smoother(a), w, out=np.zeros_like(a), where=w > 1e-3)
        return np.where(self.seen[k] & (w > 1e-3), a - around, 0.0)

    def patch(self, case: dict, radius_km: float, duty: float = 1.0) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Add a conduit; what it covered is returned and undoes it.

        ``case`` is a leaning conduit, or names a ``shape`` with a place and an amplitude.
        """
        if "shape" in case:
            return self.add(shapes.added(case["shape"], self.grid, case["ilat"], case["ilon"], case["amp"], radius_km, case.get("tilt", 10.0)))
        spec = axis(case, self.grid.depth, duty)
        lat, lon = np.radians(np.array(self.grid.lat))[:, None], np.radians(np.array(self.grid.lon))[None]
        added = {}
        for k, strength in enumerate(spec["amp"]):
            if strength == 0.0:
                continue
            la, lo = np.radians(spec["lat"][k]), np.radians(spec["lon"][k])
            cosine = np.sin(la) * np.sin(lat) + np.cos(la) * np.cos(lat) * np.cos(lon - lo)
            far = R.geo.EARTH_KM * np.arccos(np.clip(cosine, -1.0, 1.0))
            added[k] = strength * np.exp(-0.5 * (far / (radius_km / 2.0)) ** 2)
        return self.add(added)

    def add(self, added: dict[int, np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        saved = []
        for k, what in added.items():
            what = np.where(self.seen[k], what, 0.0)
            saved.append((k, self.anom[k].copy(), self.contrast[k].copy()))
            self.anom[k] += what
            self.contrast[k] += self._less_background(what, k)
        return saved

    def undo(self, saved: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        for k, anom, contrast in saved:
            self.anom[k], self.contrast[k] = anom, contrast

    def channel(self, name: str) -> np.ndarray:
        if name == "anom":
            return self.with_holes(self.anom)
        return self.with_holes(self.contrast if name == "contrast" else np.minimum(self.anom, self.contrast))

    def with_holes(self, a: np.ndarray) -> np.ndarray:
        return np.where(self.holes, np.inf, a) if self.holes.any() else a


def seed_fields(cube: Cube, fields: Sequence[Config], lateral: float, ncell: int) -> Iterator[tuple[Config, np.ndarray]]:
    """The cost to go from every cell of the seed shell, for every field."""
    grid = cube.grid
    by_channel: dict[tuple[str, tuple[int, ...]], list[Config]] = {}
    for c in fields:
        by_channel.setdefault((c.channel, grid.spans(grid.target_shell(c.z_target))), []).append(c)
    for (name, spans), group in by_channel.items():
        tile = R.Tile(grid, R.Case(0, 1.0, max(c.z_target for c in group), None, lateral, ncell), cube.channel(name), 0, 0, None)
        ways = sorted({(grid.target_shell(c.z_target), grid.sidesteps(c.h_max)) for c in group})
        exponents = sorted({c.s for c in group})
        room = max(1, STEP_VALUES // (len(ways) * tile.a[0].size * (max(spans, default=1) + 6)))
        for at in range(0, len(exponents), room):
            some = exponents[at : at + room]
            top = _upwards(tile, np.array(some), ways, spans)
            for c in group:
                if c.s in some:
                    yield c, top[some.index(c.s), ways.index((grid.target_shell(c.z_target), grid.sidesteps(c.h_max)))]


def _upwards(tile: R.Tile, s: np.ndarray, ways: list[tuple[int, int]], spans: Sequence[int]) -> np.ndarray:
    """Seed-shell costs (exponent, way, row, column); a way is a target shell and a number of sidesteps."""
    grid, case = tile.grid, tile.case
    shape = (len(ways), *tile.a.shape[1:], len(s))
    target, steps = (np.array(x) for x in zip(*ways))
    deepest, reach = int(target.max()), max(1, case.ncell)
    held = max(spans, default=1)
    field: dict[int, Frame] = {}
    now, tried = Frame(shape, 1), np.empty(shape)
    across = (tile.row_km, tile.col_km)
    ground, ones, lengths = shape[1:], s[None], {}

    def powers(a: np.ndarray) -> np.ndarray:
        """exp(s a) for every exponent, along a last axis; the product as a matrix has no short inner loops."""
        return np.exp(a.reshape(-1, 1) @ ones).reshape(ground)

    for k in range(deepest, grid.seed_shell() - 1, -1):
        cur = np.full(shape, np.inf)
        if k < deepest:
            z = grid.depth
            straight = (z[k + 1] - z[k]) * powers(0.5 * (tile.shell(k) + tile.shell(k + 1)))
            np.add(field[k + 1].away(0, 0), straight, out=cur)
            for dk, direction, step, total in tile.crossings(k, spans, np.mean, np.add):
                move = (z[k + dk] - z[k], direction, abs(step))
                if move not in lengths:
                    length = np.hypot(move[0], case.lateral * move[2] * across[direction])
                    lengths[move] = np.broadcast_to(np.asarray(length)[..., None], ground).copy()
                with np.errstate(invalid="ignore", over="ignore"):
                    price = lengths[move] * powers(total / (move[2] + 1))
                np.add(price, field[k + dk].away(direction, step), out=tried)
                np.minimum(cur, tried, out=cur)
            w = case.lateral * powers(tile.shell(k))
            prices = (w * across[0], w * across[1][..., None])
            for n in range(int(steps.max())):
                now.put(cur)
                on = steps > n
                for direction in (0, 1):
                    for step in (1, -1):
                        np.add(now.away(direction, step), prices[direction], out=tried)
                        np.minimum(cur, tried, out=cur, where=True if on.all() else on[:, None, None, None])
        cur[target == k] = tile.banned(k, np.zeros(shape[1:3]))[..., None]
        cur[target < k] = np.inf
        old = field.pop(k + held, None)
        field[k] = (old or Frame(shape, reach)).put(cur)
    return np.moveaxis(field[grid.seed_shell()].away(0, 0), 3, 0)


def _rows_of(t: pa.Table, names: Sequence[str], key: tuple, out: list[tuple[int, int, int, np.ndarray]], nlon: int) -> pa.Table:
    n = len(out)
    flat = np.concatenate([o[3] for o in out]) if n else np.empty(0)
    cols = {m: pa.array([v.as_py()] * n, t.schema.field(m).type) for m, v in zip(names, key)}
    for p, c in enumerate(("variant", "case", "j")):
        cols[c] = pa.array([o[p] for o in out], pa.int32())
    cols["row"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * nlon, pa.int32()), pa.array(flat, pa.float64()))
    return pa.table(cols)


def _cube(t: pa.Table, grid: R.Grid, sigma_km: float) -> Cube:
    a = np.full((len(grid.depth), len(grid.lat), len(grid.lon)), np.inf)
    rows = t.column("row").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(grid.lon))
    a[t.column("k").to_numpy(), t.column("j").to_numpy()] = rows
    return Cube(grid, a, sigma_km)


def observed(rows: DataFrame, keys: Sequence[str], grid: R.Grid, fields: Sequence[Config], lateral: float, ncell: int, sigma_km: float = BACKGROUND_KM, spread: int = 8) -> DataFrame:
    """Seed shells of all fields: ``keys, case, k, j, row``, from grid rows ``keys, k, j, row``."""
    kinds = sorted({(c.channel, c.s) for c in fields})
    spread = min(spread, len(kinds))

    def kernel(key, t):
        mine = {kind for n, kind in enumerate(kinds) if n % spread == key[-1].as_py()}
        cube = _cube(t, grid, sigma_km)
        out = [(-1, c.case, j, top[j]) for c, top in seed_fields(cube, [c for c in fields if (c.channel, c.s) in mine], lateral, ncell) for j in range(len(grid.lat))]
        return _rows_of(t, keys, key, out, len(grid.lon))

    return _shared(rows, keys, kernel, spread).select(*keys, "case", F.lit(grid.seed_shell()).alias("k"), "j", "row")


def injected(
    rows: DataFrame,
    keys: Sequence[str],
    grid: R.Grid,
    fields: Sequence[Config],
    cases: Sequence[dict],
    rows_of: dict[int, range],
    lateral: float,
    ncell: int,
    radius_km: float,
    sigma_km: float = BACKGROUND_KM,
    duty: float = 1.0,
    spread: int = 8,
) -> DataFrame:
    """Seed shells after each injection: ``keys, variant, case, k, j, row``, the rows ``rows_of[variant]`` only."""
    spread = min(spread, len(cases))

    def kernel(key, t):
        cube, out = _cube(t, grid, sigma_km), []
        for n, case in enumerate(cases):
            if n % spread == key[-1].as_py():
                saved = cube.patch(case, radius_km, duty)
                out += [(case["variant"], c.case, j, top[j]) for c, top in seed_fields(cube, fields, lateral, ncell) for j in rows_of[case["variant"]]]
                cube.undo(saved)
        return _rows_of(t, keys, key, out, len(grid.lon))

    return _shared(rows, keys, kernel, spread).select(*keys, "variant", "case", F.lit(grid.seed_shell()).alias("k"), "j", "row")


def _shared(rows: DataFrame, keys: Sequence[str], kernel, spread: int) -> DataFrame:
    schema = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in keys] + ["variant int", "case int", "j int", "row array<double>"])
    a = rows.select(*keys, F.col("k").cast("int"), F.col("j").cast("int"), R.marked().alias("row"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("share"))
    return R.tiles(a, [*keys, "share"]).groupBy(*keys, "share").applyInArrow(kernel, schema)


def patched_shells(rows: DataFrame, keys: Sequence[str], grid: R.Grid, cases: Sequence[dict], radius_km: float, duty: float = 1.0, sigma_km: float = BACKGROUND_KM, spread: int = 8) -> DataFrame:
    """Each shell of each injected cube: ``keys, variant, k, anom_min, anom_sum, contrast_min, added_sum``.

    One cube per task; every injection is measured in place and taken out again.
    """
    spread = min(spread, len(cases))

    def kernel(key, t):
        cube = _cube(t, grid, sigma_km)
        before = cube.anom.sum(axis=(1, 2))
        cols: dict[str, list] = {c: [] for c in ("variant", "k", "anom_min", "anom_sum", "contrast_min", "added_sum")}
        for n, case in enumerate(cases):
            if n % spread == key[-1].as_py():
                saved = cube.patch(case, radius_km, duty)
                total = cube.anom.sum(axis=(1, 2))
                stats = (cube.with_holes(cube.anom).min(axis=(1, 2)), total, cube.with_holes(cube.contrast).min(axis=(1, 2)), total - before)
                cols["variant"] += [case["variant"]] * len(grid.depth)
                cols["k"] += range(len(grid.depth))
                for c, v in zip(("anom_min", "anom_sum", "contrast_min", "added_sum"), stats):
                    cols[c] += v.tolist()
                cube.undo(saved)
        made = {m: pa.array([v.as_py()] * len(cols["k"]), t.schema.field(m).type) for m, v in zip(keys, key)}
        made |= {c: pa.array(v, pa.int32() if c in ("variant", "k") else pa.float64()) for c, v in cols.items()}
        return pa.table(made)

    schema = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in keys] + ["variant int", "k int", "anom_min double", "anom_sum double", "contrast_min double", "added_sum double"])
    a = rows.select(*keys, F.col("k").cast("int"), F.col("j").cast("int"), R.marked().alias("row"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("share"))
    return R.tiles(a, [*keys, "share"]).groupBy(*keys, "share").applyInArrow(kernel, schema)
