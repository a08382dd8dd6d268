"""Structures: regions of neighbouring shells joined into bodies, their branching, and the way down them.

One model is handled at a time, from labelled shells. Regions below an area floor are dropped, what is
left is joined through shells that overlap in map view (union-find over regions, not over cells), and each
body is described shell by shell: the pieces it has there, merged where they lie closer than a floor
distance, with a common centre that moves as pieces join it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.functions import geo
from terravox.operators.routing import KM_PER_DEG, Grid
from terravox.operators.topology import label_cells


@dataclass(frozen=True)
class Rules:
    """What counts as a region, a structure, a piece and a sustained branch (km, km2, cells, shells)."""

    below: float = -1.5
    min_area: float = 2.5e6
    min_extent: float = 90.0
    floor_km: float = 2500.0
    min_cells: int = 2
    run_shells: int = 2
    catchment: float = 1500.0
    search_shells: int = 5
    near_km: float = 800.0
    bend_deg: float = 10.0
    bend_km: float = 50.0


@dataclass
class Region:
    k: int
    label: int
    cells: int
    area: float
    lat: float
    lon: float
    down: list[int] = field(default_factory=list)  # labels one shell deeper that share a map cell


def arc(a_lat, a_lon, b_lat, b_lon):
    p, q = np.radians(a_lat), np.radians(b_lat)
    c = np.sin(p) * np.sin(q) + np.cos(p) * np.cos(q) * np.cos(np.radians(np.asarray(a_lon) - b_lon))
    return geo.EARTH_KM * np.arccos(np.clip(c, -1.0, 1.0))


def wrap(lon):
    return (lon + 180.0) % 360.0 - 180.0


class Body:
    """The labelled shells of one model and its regions."""

    def __init__(self, grid: Grid, a: np.ndarray, rules: Rules):
        self.grid, self.rules = grid, rules
        lat, lon = np.meshgrid(grid.lat, grid.lon, indexing="ij")
        cosine = np.cos(np.radians(lat))
        cell_km2 = grid.row_km * abs(grid.lon[1] - grid.lon[0]) * KM_PER_DEG * cosine
        x, y, z = cosine * np.cos(np.radians(lon)), cosine * np.sin(np.radians(lon)), np.sin(np.radians(lat))
        self.labels = np.full(a.shape, -1, np.int64)
        self.regions: list[dict[int, Region]] = []
        size = lat.size
        for k, shell in enumerate(a):
            lab = label_cells(np.nan_to_num(shell, nan=np.inf) < rules.below)
            on = lab >= 0
            total = lambda v, on=on, lab=lab: np.bincount(lab[on], v[on], size)
            area, n = total(cell_km2), np.bincount(lab[on], minlength=size)
            sx, sy, sz = total(cosine * x), total(cosine * y), total(cosine * z)
            large = (area >= rules.min_area) & (n > 0)
            self.labels[k] = np.where(on & large[np.maximum(lab, 0)], lab, -1)
            self.regions.append({
                int(r): Region(k, int(r), int(n[r]), float(area[r]), math.degrees(math.asin(sz[r] / math.sqrt(sx[r] ** 2 + sy[r] ** 2 + sz[r] ** 2))), math.degrees(math.atan2(sy[r], sx[r])))
                for r in np.flatnonzero(large)
            })
        for k in range(len(a) - 1):
            up, down = self.labels[k], self.labels[k + 1]
            shared = (up >= 0) & (down >= 0)
            for p, q in sorted(set(zip(up[shared].tolist(), down[shared].tolist()))):
                self.regions[k][p].down.append(q)

    def structures(self) -> dict[int, list[Region]]:
        """Regions of each connected body, under the smallest region number (shell by shell) in it."""
        size = self.labels[0].size
        parent: dict[int, int] = {k * size + r: k * size + r for k, shell in enumerate(self.regions) for r in shell}

        def root(n: int) -> int:
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        for k, shell in enumerate(self.regions):
            for r in shell.values():
                for d in r.down:
                    a, b = root(k * size + r.label), root((k + 1) * size + d)
                    parent[max(a, b)] = min(a, b)
        out: dict[int, list[Region]] = {}
        for k, shell in enumerate(self.regions):
            for r in shell.values():
                out.setdefault(root(k * size + r.label), []).append(r)
        depth = self.grid.depth
        return {s: rs for s, rs in out.items() if depth[rs[-1].k] - depth[rs[0].k] >= self.rules.min_extent}

    def pieces(self, regions: Sequence[Region]) -> list[list[float]]:
        """[lat, lon, cells] of the pieces of one shell, largest first; a piece joins the first one nearer
        than the floor distance and moves its centre by its share of the cells."""
        kept: list[list[float]] = []
        for r in sorted((r for r in regions if r.cells >= self.rules.min_cells), key=lambda r: (-r.cells, r.label)):
            for g in kept:
                if arc(g[0], g[1], r.lat, r.lon) < self.rules.floor_km:
                    share = r.cells / (g[2] + r.cells)
                    g[0] += (r.lat - g[0]) * share
                    g[1] = wrap(g[1] + wrap(r.lon - g[1]) * share)
                    g[2] += r.cells
                    break
            else:
                kept.append([r.lat, r.lon, r.cells])
        return kept

    def describe(self, regions: Sequence[Region]) -> dict:
        """Extent, sustained branching, spread and lean of a structure."""
        depth, rules = np.array(self.grid.depth), self.rules
        top, base = regions[0].k, regions[-1].k
        by_shell: dict[int, list[Region]] = {}
        for r in regions:
            by_shell.setdefault(r.k, []).append(r)
        found = {k: self.pieces(rs) for k, rs in by_shell.items()}
        counts = np.array([len(found.get(k, ())) for k in range(len(depth))])
        upwards = counts[::-1]
        most, levels, branch = 1, 0, None
        for m in range(2, int(counts.max(initial=0)) + 1):
            run = 0
            for at, v in enumerate(upwards >= m):
                run = run + 1 if v else 0
                if run >= rules.run_shells:
                    most, levels = m, levels + 1
                    if m == 2:
                        branch = float(depth[::-1][at - run + 1])
                    break
        spread = []
        for ps in found.values():
            if len(ps) >= 2:
                lat = sum(p[0] for p in ps) / len(ps)
                lon = wrap(ps[0][1] + sum(wrap(p[1] - ps[0][1]) for p in ps) / len(ps))
                spread.append(sum(float(arc(lat, lon, p[0], p[1])) for p in ps) / len(ps))
        (la0, lo0), (la1, lo1) = (self._centre(by_shell[k]) for k in (top, base))
        off = float(arc(la1, lo1, la0, lo0))
        p, q, d = math.radians(la1), math.radians(la0), math.radians(lo0 - lo1)
        azimuth = math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))) % 360.0 % 360.0
        return dict(
            k_top=top, k_base=base, extent_km=float(depth[base] - depth[top]), cells=sum(r.cells for r in regions), pieces=most, levels=levels, branch_km=branch,
            spread_km=float(np.median(spread)) if spread else None, offset_km=off, tilt_deg=math.degrees(math.atan2(off, float(depth[base] - depth[top]))), azimuth_deg=azimuth if off > 1e-6 else None,
        )

    @staticmethod
    def _centre(regions: Sequence[Region]) -> tuple[float, float]:
        total = sum(r.area for r in regions)
        lat = sum(r.lat * r.area for r in regions) / total
        x = sum(math.cos(math.radians(r.lon)) * r.area for r in regions)
        y = sum(math.sin(math.radians(r.lon)) * r.area for r in regions)
        return lat, math.degrees(math.atan2(y, x))

    def region_at(self, k: int, lat: float, lon: float) -> int | None:
        """The region of a shell that holds a point, or the one whose centre is nearest to it."""
        shell = self.regions[k]
        if not shell:
            return None
        j = int(np.argmin(np.abs(np.array(self.grid.lat) - lat)))
        i = int(np.argmin(np.abs(wrap(np.array(self.grid.lon) - lon))))
        if self.labels[k, j, i] >= 0:
            return int(self.labels[k, j, i])
        far, label = min((float(arc(lat, lon, r.lat, r.lon)), r.label) for r in shell.values())
        return label if far <= self.rules.near_km else None

    def descend(self, k0: int, seed: int) -> dict | None:
        """Follow a region down through everything it overlaps: strands, joins, splits and the lean."""
        depth, front, way, joins, splits, last = self.grid.depth, {seed}, [], 0, 0, k0
        for k in range(k0, len(depth) - 1):
            here = [self.regions[k][r] for r in sorted(front)]
            lat, lon = self._centre(here)
            way.append((depth[k], lat, lon, len(here)))
            last = k
            met: dict[int, int] = {}
            for r in here:
                splits += len(r.down) > 1
                for d in r.down:
                    met[d] = met.get(d, 0) + 1
            joins += sum(n > 1 for n in met.values())
            front = set(met)
            if not front:
                break
        if len(way) < 3:
            return None
        out = dict(root_km=float(depth[last]), n_depths=len(way), n_branch=joins, n_split=splits, max_strands=max(w[3] for w in way), last=last)
        return {**out, **self._bends(way)}

    def _bends(self, way: list[tuple]) -> dict:
        z, la, lo = (np.array([w[n] for w in way]) for n in range(3))
        if len(z) < 5:
            return dict(tilt_deg=None, offset_km=None, n_bends=None)
        e, n = KM_PER_DEG * wrap(lo - lo[0]) * math.cos(math.radians(la[0])), KM_PER_DEG * (la - la[0])
        off = float(np.hypot(e[-1], n[-1]))
        w, found = max(3, len(z) // 10), []
        for k in range(w, len(z) - w):
            a, b = (e[k] - e[k - w], n[k] - n[k - w]), (e[k + w] - e[k], n[k + w] - n[k])
            la_, lb = math.hypot(*a), math.hypot(*b)
            if la_ >= self.rules.bend_km and lb >= self.rules.bend_km:
                turn = math.degrees(math.acos(max(-1.0, min(1.0, (a[0] * b[0] + a[1] * b[1]) / (la_ * lb)))))
                if turn >= self.rules.bend_deg:
                    found.append(z[k])
        # One bend is one event: neighbouring depths count once.
        events = sum(1 for n_, x in enumerate(found) if n_ == 0 or x - found[n_ - 1] > 1.5 * (z[1] - z[0]))
        return dict(tilt_deg=math.degrees(math.atan2(off, float(z[-1] - z[0]))), offset_km=off, n_bends=events)

    def slow_below(self, lat: float, lon: float, last: int) -> float:
        """Share of the shells below where the way ended that have a region near the point."""
        end = len(self.grid.depth) - 1
        hit = sum(any(arc(lat, lon, r.lat, r.lon) <= self.rules.near_km for r in self.regions[k].values()) for k in range(last + 1, end + 1))
        return hit / max(end - last, 1)


TABLE = "structure bigint, k_top int, k_base int, extent_km double, cells int, pieces int, levels int, branch_km double, spread_km double, offset_km double, tilt_deg double, azimuth_deg double"
WAY = "found boolean, root_km double, n_depths int, n_branch int, n_split int, max_strands int, slow_below double, tilt_deg double, offset_km double, n_bends int"
FOOT = "structure bigint, j int, i int"


def _cube(t: pa.Table, grid: Grid) -> np.ndarray:
    a = np.full((len(grid.depth), len(grid.lat), len(grid.lon)), np.nan)
    if t.num_rows:
        flat = t.column("row").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        a[t.column("k").to_numpy(), t.column("j").to_numpy()] = flat.reshape(-1, len(grid.lon))
    return a


def _grid_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select(*keys, F.col("k").cast("int"), F.col("j").cast("int"), F.col("row").cast("array<double>"))


def _typed(ddl: str) -> list[tuple[str, pa.DataType]]:
    kind = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    return [(c.split()[0], kind[c.split()[1]]) for c in ddl.split(", ")]


def _per_model(rows: DataFrame, keys: Sequence[str], grid: Grid, rules: Rules, ddl: str, make) -> DataFrame:
    def kernel(key, t):
        out = make(Body(grid, _cube(t, grid), rules))
        cols = {n: pa.array([v.as_py()] * len(out), t.schema.field(n).type) for n, v in zip(keys, key)}
        return pa.table({**cols, **{c: pa.array([r[c] for r in out], ty) for c, ty in _typed(ddl)}})

    schema = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in keys] + [ddl])
    return _grid_rows(rows, keys).groupBy(*keys).applyInArrow(kernel, schema)


def table(rows: DataFrame, keys: Sequence[str], grid: Grid, rules: Rules = Rules()) -> DataFrame:
    """One row per structure of each model."""
    return _per_model(rows, keys, grid, rules, TABLE, lambda b: [{"structure": s, **b.describe(rs)} for s, rs in sorted(b.structures().items())])


def footprints(rows: DataFrame, keys: Sequence[str], grid: Grid, rules: Rules = Rules()) -> DataFrame:
    """Map cells above each structure, each once."""

    def cells(b: Body) -> list[dict]:
        out = []
        for s, rs in sorted(b.structures().items()):
            on = np.zeros(b.labels.shape[1:], bool)
            for r in rs:
                on |= b.labels[r.k] == r.label
            out += [{"structure": s, "j": int(j), "i": int(i)} for j, i in zip(*np.nonzero(on))]
        return out

    return _per_model(rows, keys, grid, rules, FOOT, cells)


def descents(rows: DataFrame, keys: Sequence[str], grid: Grid, points: DataFrame, top_km: float = 300.0, rules: Rules = Rules(), spread: int = 4) -> DataFrame:
    """The way down from each point in each model: ``keys``, columns of ``points`` without its position, and ``WAY``.

    Points that start in one region share its way.
    """
    names = [c for c in points.columns if c not in ("lat", "lon")]
    k_top = next(k for k, z in enumerate(grid.depth) if z >= top_km)
    share = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("share")
    models = rows.select(*[F.col(k).alias(k) for k in keys]).distinct()
    asked = models.crossJoin(points).withColumn("share", F.pmod(F.xxhash64(*names), F.lit(spread)).cast("int"))
    cubes = _grid_rows(rows, keys).select("*", share)

    def kernel(key, left, right):
        body, ways, out = Body(grid, _cube(left, grid), rules), {}, []
        for lat, lon in zip(right.column("lat").to_pylist(), right.column("lon").to_pylist()):
            start = next(((k, r) for k in range(k_top, min(k_top + rules.search_shells, len(grid.depth))) if (r := body.region_at(k, lat, lon)) is not None), None)
            if start is not None and start not in ways:
                ways[start] = body.descend(*start)
            way = ways.get(start) if start is not None else None
            out.append({**way, "found": True, "slow_below": body.slow_below(lat, lon, way["last"])} if way else {"found": False})
        cols = {c: right.column(c) for c in (*keys, *names)}
        return pa.table({**cols, **{c: pa.array([r.get(c) for r in out], ty) for c, ty in _typed(WAY)}})

    schema = ", ".join([f"{c} {asked.schema[c].dataType.simpleString()}" for c in (*keys, *names)] + [WAY])
    group = [*keys, "share"]
    return cubes.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(kernel, schema)
