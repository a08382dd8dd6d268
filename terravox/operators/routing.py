"""Least-cost, bottleneck and arrival fields through a layered grid, and paths through them.

A field is computed shell after shell, so the work is spread over models, cases and bands of grid
rows. A band carries a halo wide enough for the shells of one round; neighbouring bands meet again
at the next round, through a table in the shared folder. A grid small enough for one task needs
one round and one band; the same code serves both.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravox.functions import geo
from terravox.session import scratch_path

KM_PER_DEG = geo.EARTH_KM * math.pi / 180.0
# Fixed values of the search: vertical reach of slanted moves in km, bounds on the anomaly,
# sideways steps without a stated reach, seed depth, gain a later move must bring, longest path.
SLANT_KM = (20.0, 60.0, 160.0)
CLIP = 6.0
DEFAULT_STEPS = 4
SEED_KM = 200.0
GAIN = 1e-9
LONGEST = 20000

TASK_VALUES = 20_000_000  # grid values one task may hold
BATCH_VALUES = 4_000_000  # values of the fields that one task searches at once


def whole(km: float, unit: float) -> int:
    """A distance as a whole number of units, one at least."""
    return max(1, math.floor(km / unit + 0.5))


@dataclass(frozen=True)
class Grid:
    lat: tuple[float, ...]
    lon: tuple[float, ...]
    depth: tuple[float, ...]

    @property
    def row_km(self) -> float:
        return abs(self.lat[1] - self.lat[0]) * KM_PER_DEG

    def col_km(self, j) -> np.ndarray:
        cosine = np.maximum(np.cos(np.radians(np.asarray(self.lat)[j])), geo.CELL_COS_FLOOR)
        return abs(self.lon[1] - self.lon[0]) * KM_PER_DEG * cosine

    def target_shell(self, z_target: float) -> int:
        deep = [k for k, z in enumerate(self.depth) if z >= z_target]
        return deep[0] if deep else len(self.depth) - 1

    def seed_shell(self, z: float = SEED_KM) -> int:
        return int(np.argmin(np.abs(np.asarray(self.depth) - z)))

    def spans(self, k0: int) -> tuple[int, ...]:
        """Shells that a slanted move may cross: the stated reaches as whole numbers of shells."""
        if k0 < 1:
            return ()
        spacing = (self.depth[k0] - self.depth[0]) / k0
        return tuple(n for n in dict.fromkeys(whole(km, spacing) for km in SLANT_KM) if n <= k0)

    def sidesteps(self, h_max: float | None) -> int:
        """Steps within a shell: the stated distance in whole rows."""
        return whole(h_max, self.row_km) if h_max is not None else DEFAULT_STEPS


@dataclass(frozen=True)
class Case:
    case: int
    s: float = 0.5
    z_target: float = 2400.0
    h_max: float | None = None
    lateral: float = 1.0
    ncell: int = 1


# ---- kernel: one tile of rows, numpy ------------------------------------------------------------


def _from(a: np.ndarray, axis: int, step: int, fill: float) -> np.ndarray:
    """Value of the cell ``step`` away: rows (axis 0) end at walls, columns (axis 1) are a ring.

    Rows and columns are the last two axes; several fields may lie side by side before them."""
    out = np.empty_like(a)
    if axis == 1:
        step %= a.shape[-1]
        cut = a.shape[-1] - step
        out[..., :cut] = a[..., step:]
        out[..., cut:] = a[..., :step]
    elif abs(step) >= a.shape[-2]:
        out[...] = fill
    elif step > 0:
        out[..., :-step, :] = a[..., step:, :]
        out[..., -step:, :] = fill
    elif step < 0:
        out[..., -step:, :] = a[..., :step, :]
        out[..., :-step, :] = fill
    else:
        out[...] = a
    return out


def _sideways(cur, price, wall, arriving):
    """One in-shell step in the four directions. ``price`` is (row price, column price) per cell;
    it belongs to the cell that is left, which is the neighbour when the field is one of arrivals."""
    out = cur
    for axis, w in enumerate(price):
        base = cur + w if arriving else cur
        for step in (1, -1):
            cand = _from(base, axis, step, wall)
            out = np.minimum(out, cand if arriving else cand + w)
    return out


class Tile:
    """Rows [j0, j0 + n) of the shells k_first.. of one model, with the halo."""

    def __init__(self, grid: Grid, case: Case, a: np.ndarray, k_first: int, j0: int, ban: np.ndarray | None):
        self.grid, self.case, self.k_first = grid, case, k_first
        self.a = np.clip(np.where(np.isfinite(a), a, 0.0), -CLIP, CLIP)
        self.holes = np.isposinf(a)  # no cell there: infinitely dear to enter, to leave and to cross
        self.a[self.holes] = np.inf
        self.ban = ban
        self.k0 = grid.target_shell(case.z_target)
        self.row_km, self.col_km = grid.row_km, grid.col_km(np.arange(j0, j0 + a.shape[1]))[:, None]
        self.steps = grid.sidesteps(case.h_max)
        self.prices: dict | None = None  # where walks of many masks share a tile: the moves of a shell

    def shell(self, k: int) -> np.ndarray:
        return self.a[k - self.k_first]

    def banned(self, k: int, c: np.ndarray) -> np.ndarray:
        if self.ban is not None:
            c = np.where(self.ban[k - self.k_first], np.inf, c)
        return np.where(self.holes[k - self.k_first], np.inf, c)

    def lateral_price(self, k: int):
        e = np.exp(self.case.s * self.shell(k)) * self.case.lateral
        return e * self.row_km, e * self.col_km

    def crossings(self, k: int, spans: Sequence[int], pool, fold) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(span, axis, step, value) of each slanted move that leaves shell k.

        The value pools the shells of a column and folds the columns crossed, one after the other:
        mean and sum give prices, maximum and maximum the highest point on the way.
        """
        for dk in spans:
            if k + dk > self.k0:
                continue
            top = k - self.k_first
            column = pool(self.a[top : top + dk + 1], axis=0)
            swept = {(axis, sign): column for axis in (0, 1) for sign in (1, -1)}
            for cells in range(1, self.case.ncell + 1):
                for (axis, sign), so_far in swept.items():
                    swept[axis, sign] = fold(so_far, _from(column, axis, sign * cells, np.inf))
                    yield dk, axis, sign * cells, swept[axis, sign]

    def moves(self, k: int, spans: Sequence[int]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(span, axis, step, price) of each slanted move that leaves shell k, priced by the mean
        anomaly over the shells and cells it crosses and by its true length."""
        if self.prices is None:
            return self.priced_moves(k, spans)
        key = (k, tuple(spans), self.k0)
        if key not in self.prices:
            self.prices[key] = list(self.priced_moves(k, spans))
        return iter(self.prices[key])

    def priced_moves(self, k: int, spans: Sequence[int]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        across = (self.row_km, self.col_km)
        for dk, axis, step, total in self.crossings(k, spans, np.mean, np.add):
            cells = abs(step)
            length = np.hypot(self.grid.depth[k + dk] - self.grid.depth[k], self.case.lateral * cells * across[axis])
            with np.errstate(invalid="ignore", over="ignore"):
                yield dk, axis, step, length * np.exp(self.case.s * total / (cells + 1))

    def straight_price(self, k: int) -> np.ndarray:
        z = self.grid.depth
        return (z[k + 1] - z[k]) * np.exp(self.case.s * 0.5 * (self.shell(k) + self.shell(k + 1)))

    def descend(self, k: int, field: dict[int, np.ndarray], spans) -> np.ndarray:
        """Cost to go from shell k when the next move goes down."""
        cur = field[k + 1] + self.straight_price(k)
        for dk, axis, step, price in self.moves(k, spans):
            cur = np.minimum(cur, price + _from(field[k + dk], axis, step, np.inf))
        return cur

    def stages(self, k: int, field, spans) -> list[np.ndarray]:
        """Cost to go with 0, 1, .. sideways steps left."""
        out = [self.banned(k, self.descend(k, field, spans))]
        w = self.lateral_price(k)
        for _ in range(self.steps):
            out.append(self.banned(k, _sideways(out[-1], w, np.inf, False)))
        return out

    def worst_point(self, k: int, field, spans) -> np.ndarray:
        """Bottleneck version of a shell: the lowest achievable maximum on the way down."""
        ways = [np.maximum.reduce([self.shell(k), self.shell(k + 1), field[k + 1]])]
        for dk, axis, step, peak in self.crossings(k, spans, np.max, np.maximum):
            ways.append(np.maximum(peak, _from(field[k + dk], axis, step, np.inf)))
        return self.level_out(k, np.minimum.reduce(ways))

    def level_out(self, k: int, cur: np.ndarray) -> np.ndarray:
        a = self.shell(k)
        for _ in range(self.steps):
            best = cur
            for axis in (0, 1):
                for step in (1, -1):
                    best = np.minimum(best, np.maximum(_from(cur, axis, step, np.inf), a))
            cur = best
        return cur


def _backward(t: Tile, known: dict[int, np.ndarray], lo: int, hi: int, kind: str) -> dict[int, np.ndarray]:
    """Shells hi-1 .. lo of a cost or bottleneck field, from the shells below them."""
    shape = t.a.shape[1:]
    spans = t.grid.spans(t.k0 if kind == "cost" else len(t.grid.depth) - 1)
    field = dict(known)
    for k in range(hi - 1, lo - 1, -1):
        if k > t.k0:
            field[k] = np.full(shape, np.inf)
        elif k == t.k0:
            field[k] = t.banned(k, np.zeros(shape)) if kind == "cost" else t.level_out(k, t.shell(k))
        elif kind == "cost":
            field[k] = t.stages(k, field, spans)[-1]
        else:
            field[k] = t.worst_point(k, field, spans)
    return {k: field[k] for k in range(lo, hi)}


def _arrivals(t: Tile, known: dict[int, np.ndarray], seed: np.ndarray, lo: int, hi: int) -> dict[int, np.ndarray]:
    """Shells lo .. hi-1 of an arrival field, from the shells above them. ``seed`` holds the seeds of
    several fields side by side, which share the prices of all moves.

    The value is the cost to come down into a cell; sideways steps at its own shell belong to the
    departure and are added when the next shell is reached.
    """
    shape = seed.shape
    top = t.grid.seed_shell()
    spans = t.grid.spans(t.k0)
    field, left = dict(known), {}

    def departing(k):
        if k not in left:
            cur, w = field[k], t.lateral_price(k)
            for _ in range(t.steps):
                cur = _sideways(cur, w, np.inf, True)
            left[k] = cur
        return left[k]

    for k in range(lo, hi):
        if k < top or k > t.k0:
            field[k] = np.full(shape, np.inf)
            continue
        if k == top:
            field[k] = seed
            continue
        cur = departing(k - 1) + t.straight_price(k - 1)
        for dk in spans:
            if k - dk < top:
                continue
            for _, axis, step, price in t.moves(k - dk, (dk,)):
                cur = np.minimum(cur, _from(price + departing(k - dk), axis, -step, np.inf))
        field[k] = cur
    return {k: field[k] for k in range(lo, hi)}


# ---- distribution: rounds of shells, bands of rows ----------------------------------------------


@dataclass(frozen=True)
class Layout:
    """How the grid is cut: shells per round, rows per band, rows of halo on each side."""

    shells: int
    rows: int
    halo: int
    reach: int  # shells a slanted move may span

    @staticmethod
    def plan(grid: Grid, cases: Sequence[Case], limit: int = TASK_VALUES, shells: int = 4) -> Layout:
        nz, nlat, nlon = len(grid.depth), len(grid.lat), len(grid.lon)
        reach = max(grid.spans(nz - 1) or (1,))
        if nz * nlat * nlon <= limit:
            return Layout(nz, nlat, 0, reach)
        side = max(grid.sidesteps(c.h_max) + c.ncell for c in cases)
        halo = side * (shells + 1)
        rows = max(halo, limit // ((shells + 2 * reach + 1) * nlon) - 2 * halo)
        return Layout(shells, min(rows, nlat), halo, reach)


def _banded(recs: DataFrame, lay: Layout, nlat: int) -> DataFrame:
    """Send every grid row to its own band and to the bands whose halo it lies in."""
    last = (nlat - 1) // lay.rows
    lo = F.greatest(F.lit(0), F.floor((F.col("j") - lay.halo) / lay.rows)).cast("int")
    hi = F.least(F.lit(last), F.floor((F.col("j") + lay.halo) / lay.rows)).cast("int")
    return recs.withColumn("band", F.explode(F.sequence(lo, hi)))


def _by_place(nlon: int):
    """The cells collected in ``r`` at their columns: null where the grid row has no cell."""
    at = F.map_from_entries("r")
    return F.transform(F.sequence(F.lit(0), F.lit(nlon - 1)), lambda i: at[i])


def tiles(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tiles dealt over the cores by their keys: few bytes can be long work, so a shuffle that is merged
    by its bytes would leave most cores idle."""
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def grid_rows(columns: DataFrame, keys: Sequence[str], nlon: int, value: str = "v") -> DataFrame:
    """One row per (model, grid row, shell) holding the values along longitude.

    The depth columns of one grid row meet as they are and are turned over inside the row: the
    shuffle carries one record per column, not one per value. A group is one grid row, whose size is
    the number of grid columns. Every row is ``nlon`` long: null stands where a model has no cell, a
    value that is null itself is NaN.
    """
    g = columns.groupBy(*keys, "j").agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col(value).alias("x"))).alias("r"))
    g = g.select(*keys, "j", F.size(F.col("r")[0]["x"]).alias("nz"), _by_place(nlon).alias("r"))
    shells = F.sequence(F.lit(0), F.col("nz") - 1)
    nan = F.lit(float("nan"))
    turned = F.transform(shells, lambda k: F.transform("r", lambda x: F.when(x.isNotNull(), F.coalesce(x[k], nan))))
    return g.select(*keys, "j", F.posexplode(turned).alias("k", "row")).select(*keys, "j", "k", "row")


def grid_rows_of_cells(cells: DataFrame, keys: Sequence[str], nlon: int, value: str) -> DataFrame:
    c = cells.select(*keys, "j", F.col("i").cast("int").alias("i"), "k", F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("x"))
    g = c.groupBy(*keys, "j", "k").agg(F.collect_list(F.struct("i", "x")).alias("r"))
    return g.select(*keys, "j", "k", _by_place(nlon).alias("row"))


def marked(row: str = "row"):
    """Grid rows for the kernels that tell a missing cell (infinity) from a value that is no finite number (NaN)."""
    inf = F.lit(float("inf"))
    return F.transform(F.col(row).cast("array<double>"), lambda x: F.when(x.isNull(), inf).when(x == inf, F.lit(float("nan"))).otherwise(x))


def _decode(t: pa.Table, nlon: int):
    """Grid rows of one tile as {(kind, case): (ks, j0, array)}."""
    k, j = t.column("k").to_numpy(), t.column("j").to_numpy()
    case = t.column("case").to_numpy()
    rows = t.column("row").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, nlon)
    j0, nj = int(j.min()), int(j.max() - j.min()) + 1
    out = {}
    for c in np.unique(case):
        m = case == c
        k0, nk = int(k[m].min()), int(k[m].max() - k[m].min()) + 1
        cube = np.full((nk, nj, nlon), np.inf)
        cube[k[m] - k0, j[m] - j0] = rows[m]
        out[int(c)] = (k0, cube)
    return j0, out


def _encode(like: pa.Schema, keys: dict, names: Sequence[str], out: list[tuple[int, int, int, np.ndarray]], nlon: int) -> pa.Table:
    n = len(out)
    flat = np.concatenate([o[3] for o in out]) if n else np.empty(0)
    cols = {name: pa.array([keys[name]] * n, like.field(name).type) for name in names}
    cols["case"] = pa.array([o[0] for o in out], pa.int32())
    cols["k"] = pa.array([o[1] for o in out], pa.int32())
    cols["j"] = pa.array([o[2] for o in out], pa.int32())
    cols["row"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * nlon, pa.int32()), pa.array(flat, pa.float64()))
    return pa.table(cols)


ANOMALY, MASK, OTHER = -1, -2, -4  # record numbers below zero are inputs, the rest are cases


@dataclass(frozen=True)
class Fold:
    """What becomes of fields that are searched together and a field of grid rows ``other`` beside them:
    ``make(case numbers, {shell: fields}, {shell: other})`` gives columns ``case`` and those of ``schema``."""

    other: DataFrame
    make: Callable[[list[int], dict[int, np.ndarray], dict[int, np.ndarray]], dict[str, pa.Array]]
    schema: str


def solve(
    spark: SparkSession,
    rows: DataFrame,
    keys: Sequence[str],
    grid: Grid,
    cases: Sequence[Case],
    kind: str = "cost",
    bans: DataFrame | None = None,
    seeds: dict[int, tuple[list[int], list[int]]] | None = None,
    layout: Layout | None = None,
    spread: int = 8,
    fold: Fold | None = None,
) -> DataFrame:
    """Fields for every (model, case): columns ``keys, case, k, j, row``.

    kind ``cost`` or ``bottleneck`` sweeps upwards from the target, ``arrival`` downwards from the
    seeds (one cap per case number). ``bans`` are grid rows with 1 on forbidden cells. With ``fold``, for grids
    that a task holds whole, fields stay in the task and what is made of them is returned.
    """
    lay = layout or Layout.plan(grid, cases)
    nlat, nlon, nz = len(grid.lat), len(grid.lon), len(grid.depth)
    spread = min(spread, len(cases))
    names, nowhere = list(keys), np.full(nlon, np.inf)
    by_group = {g: [c for c in cases if c.case % spread == g] for g in range(spread)}
    down, make = kind == "arrival", fold and fold.make
    starts = range(0, nz, lay.shells)
    rounds = [(lo, min(nz, lo + lay.shells)) for lo in starts]
    if fold and (len(rounds) > 1 or lay.rows < nlat):
        raise ValueError("fields are folded only where a task holds the whole grid")
    if not down:
        rounds = [(max(0, nz - lo - lay.shells), nz - lo) for lo in starts]

    def batches(cs: list[Case], nj: int) -> Iterator[list[Case]]:
        """Cases that are searched at once: arrivals that differ in their seeds only, in bounded numbers."""
        alike: dict[Case, list[Case]] = {}
        for c in cs:
            alike.setdefault(replace(c, case=0) if down else c, []).append(c)
        most = max(1, BATCH_VALUES // (min(nz, lay.shells + lay.reach) * nj * nlon))
        for same in alike.values():
            yield from (same[i : i + most] for i in range(0, len(same), most))

    def kernel_for(lo: int, hi: int):
        def kernel(key, t):
            ident = {n: v.as_py() for n, v in zip([*names, "group", "band"], key)}
            j0, got = _decode(t, nlon)
            k_first, a = got[ANOMALY]
            ban = got[MASK][1] > 0.5 if MASK in got else None
            own = range(ident["band"] * lay.rows, min(nlat, (ident["band"] + 1) * lay.rows))
            out, folded = [], []
            nj = a.shape[1]
            beside = {}
            if make:
                beside = {k: got[OTHER][1][k - got[OTHER][0]] for k in range(got[OTHER][0], got[OTHER][0] + len(got[OTHER][1]))}
            for c, *others in batches(by_group[ident["group"]], nj):
                tile = Tile(grid, c, a, k_first, j0, ban)
                if down:
                    same = [c, *others]
                    known = {}
                    if c.case in got:
                        known = {got[c.case][0] + n: np.stack([got[x.case][1][n] for x in same]) for n in range(got[c.case][1].shape[0])}
                    seed = np.full((len(same), *a.shape[1:]), np.inf)
                    for n, x in enumerate(same):
                        jj, ii = seeds[x.case]
                        for j in jj:
                            if 0 <= j - j0 < nj:
                                seed[n, j - j0, ii] = 0.0
                    with np.errstate(invalid="ignore", over="ignore"):
                        res = _arrivals(tile, known, seed, lo, hi)
                    if make:
                        folded.append(make([x.case for x in same], res, beside))
                        continue
                    found = [(x.case, k, arr[n]) for n, x in enumerate(same) for k, arr in res.items()]
                else:
                    known = {}
                    if c.case in got:
                        kc, cube = got[c.case]
                        known = {kc + n: cube[n] for n in range(cube.shape[0])}
                    with np.errstate(invalid="ignore", over="ignore"):
                        res = _backward(tile, known, lo, hi, kind)
                    found = [(c.case, k, arr) for k, arr in res.items()]
                # Grid rows that the model does not have cannot be reached; they are handed on like others.
                out += [(case, k, j, arr[j - j0] if 0 <= j - j0 < nj else nowhere) for case, k, arr in found for j in own]
            if make:
                tables = [pa.table({n: pa.array([ident[n]] * len(m["case"]), t.schema.field(n).type) for n in names} | m) for m in folded]
                return pa.concat_tables(tables)
            return _encode(t.schema, ident, names, out, nlon)

        return kernel

    schema = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + ["case int", "k int", "j int", "row array<double>"])
    a = rows.select(*names, F.lit(ANOMALY).alias("case"), F.col("k").cast("int"), F.col("j").cast("int"), marked().alias("row"))
    if bans is not None:
        a = a.unionByName(bans.select(*names, F.lit(MASK).alias("case"), F.col("k").cast("int"), F.col("j").cast("int"), F.col("row").cast("array<double>")))
    if fold:
        a = a.unionByName(fold.other.select(*names, F.lit(OTHER).alias("case"), F.col("k").cast("int"), F.col("j").cast("int"), "row"))
    a = a.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    one_round = len(rounds) == 1
    path = None if one_round else scratch_path(spark, f"field-{kind}")
    for n, (lo, hi) in enumerate(rounds):
        recs = a if one_round else a.filter(F.col("k").between(lo - lay.reach, hi - 1 + lay.reach))
        if n:
            before = (lo - lay.reach, lo - 1) if down else (hi, hi - 1 + lay.reach)
            c = spark.read.schema(schema).parquet(path).filter(F.col("k").between(*before))
            recs = recs.unionByName(c.withColumn("group", F.pmod(F.col("case"), F.lit(spread))))
        unit = [*names, "group", "band"]
        made = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + ["case int", fold.schema]) if fold else schema
        res = tiles(_banded(recs, lay, nlat), unit).groupBy(*unit).applyInArrow(kernel_for(lo, hi), made)
        if one_round:
            return res
        res.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def paths(
    spark: SparkSession,
    rows: DataFrame,
    fields: DataFrame,
    starts: DataFrame,
    keys: Sequence[str],
    grid: Grid,
    cases: Sequence[Case],
    staged: bool = True,
    layout: Layout | None = None,
) -> DataFrame:
    """Cheapest paths from given start cells: ``keys, case, site, n, k, j, i``.

    ``starts`` has ``keys, case, site, j, i`` at the seed shell. Each node takes the cheapest of
    straight, slanted and sideways moves; a later one must be better by more than a rounding error.
    ``staged`` values a sideways step by the steps that remain; without it the full value is read
    and the steps are only counted. Rounds of shells as in ``solve``: the heads of the paths are
    handed from band to band.
    """
    lay = layout or Layout.plan(grid, cases)
    nlat, nlon, nz = len(grid.lat), len(grid.lon), len(grid.depth)
    names, by_case = list(keys), {c.case: c for c in cases}
    top = grid.seed_shell()
    rounds = [(lo, min(nz, lo + lay.shells)) for lo in range(0, nz, lay.shells) if lo + lay.shells > top]

    def kernel_for(lo: int, hi: int):
        def kernel(key, t):
            ident = {n: v.as_py() for n, v in zip([*names, "case", "band"], key)}
            is_head = t.column("case").to_numpy() < -2
            heads = t.filter(pa.array(is_head)).to_pylist()
            own = range(ident["band"] * lay.rows, (ident["band"] + 1) * lay.rows)
            heads = [h for h in heads if h["j"] in own]
            found = []
            if heads:
                j0, got = _decode(t.filter(pa.array(~is_head)), nlon)
                k_first, a = got[ANOMALY]
                kc, cube = got[ident["case"]]
                tile = Tile(grid, by_case[ident["case"]], a, k_first, j0, None)
                found = _follow(tile, {kc + n: cube[n] for n in range(cube.shape[0])}, heads, staged, j0, hi)
            cols = {n: pa.array([ident[n]] * len(found), t.schema.field(n).type) for n in names}
            cols["case"] = pa.array([ident["case"]] * len(found), pa.int32())
            for p, (c, ty) in enumerate((("site", pa.int64()), ("n", pa.int32()), ("k", pa.int32()), ("j", pa.int32()), ("i", pa.int32()), ("left", pa.int32()), ("open", pa.bool_()))):
                cols[c] = pa.array([f[p] for f in found], ty)
            return pa.table(cols)

        return kernel

    types = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names]
    schema = ", ".join([*types, "case int", "site bigint", "n int", "k int", "j int", "i int", "left int", "open boolean"])
    case_ids = F.array(*[F.lit(c.case) for c in cases])
    a = rows.select(*names, F.col("k").cast("int"), F.col("j").cast("int"), marked().alias("row"), F.lit(ANOMALY).alias("rec"))
    a = a.withColumn("case", F.explode(case_ids))
    c = fields.select(*names, "k", "j", "row", F.col("case").alias("rec"), "case")
    steps = F.create_map(*[F.lit(x) for cs in cases for x in (cs.case, grid.sidesteps(cs.h_max))])
    heads = starts.select(*names, F.col("case").cast("int"), F.col("site").cast("bigint"), F.lit(0).alias("n"), F.lit(top).alias("k"), F.col("j").cast("int"), F.col("i").cast("int"), steps[F.col("case")].alias("left"), F.lit(True).alias("open"))
    path, one_round = None, len(rounds) == 1
    if not one_round:
        path = scratch_path(spark, "paths")
    for n, (lo, hi) in enumerate(rounds):
        head_rows = heads.select(*names, "k", "j", F.array(F.col("site"), F.col("i"), F.col("left"), F.col("n")).cast("array<double>").alias("row"), F.lit(-3).alias("rec"), "case")
        recs = a.unionByName(c) if one_round else a.unionByName(c).filter(F.col("k").between(lo, hi - 1 + lay.reach))
        recs = recs.unionByName(head_rows).withColumnRenamed("case", "unit").withColumnRenamed("rec", "case")
        unit = [*names, "unit", "band"]
        res = tiles(_banded(recs, lay, nlat), unit).groupBy(*unit).applyInArrow(kernel_for(lo, hi), schema)
        if one_round:
            first = starts.select(*names, F.col("case").cast("int"), F.col("site").cast("bigint"), F.lit(0).alias("n"), F.lit(top).alias("k"), F.col("j").cast("int"), F.col("i").cast("int"))
            return res.select(first.columns).unionByName(first)
        res.write.mode("overwrite").parquet(f"{path}/round={n}")
        done = spark.read.schema(schema).parquet(f"{path}/round={n}")
        newest = done.groupBy(*names, "case", "site").agg(F.max_by(F.struct("n", "k", "j", "i", "left", "open"), F.col("n")).alias("h"))
        moved = newest.select(*names, "case", "site", "h.*")
        still = heads.join(moved.select(*names, "case", "site"), [*names, "case", "site"], "left_anti")
        heads = moved.unionByName(still.select(moved.columns)).filter("open")
        heads.write.parquet(f"{path}-heads/round={n}")
        heads = spark.read.schema(schema).parquet(f"{path}-heads/round={n}")
    nodes = spark.read.schema(schema).parquet(*[f"{path}/round={n}" for n in range(len(rounds))])
    first = starts.select(*names, F.col("case").cast("int"), F.col("site").cast("bigint"), F.lit(0).alias("n"), F.lit(top).alias("k"), F.col("j").cast("int"), F.col("i").cast("int"))
    return nodes.select(first.columns).unionByName(first)


def _cheapest(options: Iterator[tuple[np.ndarray, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(price, move) per head over options (price per head, move); a later option has to gain ``GAIN``."""
    price, move = np.full(n, np.inf), np.full(n, -1)
    for cost, number in options:
        take = cost < np.where(move < 0, price, price - GAIN)
        price, move = np.where(take, cost, price), np.where(take, number, move)
    return price, move


def _follow(tile: Tile, field: dict[int, np.ndarray], heads: list[dict], staged: bool, j0: int, hi: int) -> list[tuple]:
    """Nodes after the heads, down to shell ``hi``.

    Paths never rise, so all heads of a shell are moved together, as columns (site, node, row, column,
    sideways steps left). Those that go down wait at the shell they reach; the rest moves on sideways.
    """
    nlon, last, full = len(tile.grid.lon), len(tile.grid.depth) - 1, tile.steps
    tile.k0 = last
    spans = tile.grid.spans(last)
    waiting: dict[int, list[np.ndarray]] = {}
    for h in heads:
        site, i, left, n = (int(x) for x in h["row"])
        waiting.setdefault(h["k"], []).append(np.array([[site, n, h["j"], i, left]], np.int64))
    aside = [(axis, step) for axis in (0, 1) for step in (1, -1)]
    found: list[np.ndarray] = []
    for k in range(min(waiting, default=hi), min(hi, last)):
        if k not in waiting:
            continue
        now = np.concatenate(waiting.pop(k))
        with np.errstate(invalid="ignore", over="ignore"):
            ways = [(1, 0, 0)]
            prices = [tile.straight_price(k) + field[k + 1]]
            for dk, axis, step, price in tile.moves(k, spans):
                ways.append((dk, axis, step))
                prices.append(price + _from(field[k + dk], axis, step, np.inf))
            ahead = np.stack(tile.stages(k, field, spans)) if staged and (now[:, 4] > 0).any() else field[k][None]
        ways += [(0, axis, step) for axis, step in aside]
        table, lateral = np.array(ways), tile.lateral_price(k)
        n_rows = field[k].shape[0]
        while len(now):
            r, c = now[:, 2] - j0, now[:, 3]
            here = field[k][r, c]
            open_ = np.isfinite(here) & (here > 0.0)
            now, r, c = now[open_], r[open_], c[open_]
            if (now[:, 1] >= LONGEST).any():
                raise RuntimeError(f"a path has more than {LONGEST} nodes")
            left = now[:, 4]
            stage = np.maximum(left - 1, 0) if staged and len(ahead) > 1 else np.zeros(len(now), np.int64)

            def options(r=r, c=c, left=left, stage=stage):
                for number, price in enumerate(prices):
                    yield price[r, c], number
                for number, (axis, step) in enumerate(aside, len(prices)):
                    r2, c2 = (r + step, c) if axis == 0 else (r, (c + step) % nlon)
                    inside = (left > 0) & (r2 >= 0) & (r2 < n_rows)
                    value = ahead[stage, np.clip(r2, 0, n_rows - 1), c2] + lateral[axis][r, c]
                    yield np.where(inside, value, np.inf), number

            _, move = _cheapest(options(), len(now))
            now, move = now[move >= 0], move[move >= 0]
            dk, axis, step = table[move].T
            j = now[:, 2] + np.where(axis == 0, step, 0)
            i = (now[:, 3] + np.where(axis == 1, step, 0)) % nlon
            left = np.where(dk > 0, full, now[:, 4] - 1)
            now = np.stack([now[:, 0], now[:, 1] + 1, j, i, left], axis=1)
            found.append(np.column_stack([now[:, :2], k + dk, now[:, 2:]]))
            for d in np.unique(dk[dk > 0]).tolist():
                waiting.setdefault(k + d, []).append(now[dk == d])
            now = now[dk == 0]
    return [(*row, True) for part in found for row in part.tolist()]
