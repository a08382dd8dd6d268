"""The tube detector against a plain walk, one site at a time."""

import math

import numpy as np

from terravox.operators import routing as R
from terravox.operators import tubes as U

GRID = R.Grid(tuple(-75.0 + 10.0 * x for x in range(16)), tuple(-180.0 + 15.0 * x for x in range(24)), tuple(50.0 * x for x in range(30)))
TUBE = U.Tube(base=1500.0, bin_km=300.0, max_tilt=78.0, r_in=1500.0, r_out=3600.0, rings=6, prominence=0.5, width=1900.0, max_drift=2000.0)


def km(a, b):
    p, q, d = math.radians(a[0]), math.radians(b[0]), math.radians(a[1] - b[1])
    return 6371.0 * math.acos(max(-1.0, min(1.0, math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(d))))


def plain(a, site, t):
    """(tube km, prominence, half width, top, base, drift) of one site."""
    cells = [(j, i) for j in range(len(GRID.lat)) for i in range(len(GRID.lon))]
    spot = lambda c: (GRID.lat[c[0]], GRID.lon[c[1]])
    here, found, drift = site, [], None
    n_bins = math.ceil((min(t.base, GRID.depth[-1] + 1) - t.top) / t.bin_km)
    for b in range(n_bins):
        lo = t.top + b * t.bin_km
        shells = [k for k, z in enumerate(GRID.depth) if lo <= z < lo + t.bin_km]
        mean = {}
        for j, i in cells:
            x = [a[k, j, i] for k in shells if np.isfinite(a[k, j, i])]
            if x:
                mean[j, i] = sum(x) / len(x)
        near = [c for c in cells if c in mean and km(here, spot(c)) <= t.bin_km * math.tan(math.radians(t.max_tilt))]
        row = dict(z=lo + t.bin_km / 2, ok=False, p=None, h=None)
        found.append(row)
        if not near:
            continue
        low = min(near, key=lambda c: (round(mean[c], 12), c))
        rings = [[] for _ in range(t.rings)]
        for c in mean:
            n = int(km(spot(low), spot(c)) // (t.r_out / t.rings))
            if n < t.rings:
                rings[n].append(mean[c])
        prof = [(n, sum(x) / len(x)) for n, x in enumerate(rings) if x]
        outer = [y for n, y in prof if (n + 1) * t.r_out / t.rings > t.r_in]
        if outer:
            row["p"] = sum(outer) / len(outer) - mean[low]
            level = mean[low] + row["p"] / 2
            r = [((n + 0.5) * t.r_out / t.rings, y) for n, y in prof]
            up = [n for n, (_, y) in enumerate(r) if y >= level]
            if row["p"] > 0 and len(r) >= 3 and up:
                n = up[0]
                row["h"] = r[0][0] if n == 0 else r[n - 1][0] + (level - r[n - 1][1]) * (r[n][0] - r[n - 1][0]) / max(r[n][1] - r[n - 1][1], 1e-9)
            row["ok"] = row["p"] >= t.prominence and row["h"] is not None and row["h"] <= t.width
        drift = km(site, spot(low))
        if drift <= t.max_drift:
            here = spot(low)
    best = []
    run = []
    for row in found:
        run = [*run, row] if row["ok"] else []
        if len(run) > len(best):
            best = run
    if not best:
        return 0.0, None, None, None, None, drift
    return len(best) * t.bin_km, sum(r["p"] for r in best) / len(best), float(np.median([r["h"] for r in best])), best[0]["z"], best[-1]["z"], drift


def test_tubes_equal_a_plain_walk(spark):
    rng = np.random.default_rng(12)
    cubes = {}
    for m in (0, 1):
        a = rng.normal(0, 0.6, (30, 16, 24))
        for la, lo in ((-20, 30), (35, 170)):  # two leaning conduits
            for k in range(30):
                for j in range(16):
                    for i in range(24):
                        a[k, j, i] -= 3 * math.exp(-((km((la + 0.4 * k, lo + 0.5 * k), (GRID.lat[j], GRID.lon[i])) / 900) ** 2))
        a.ravel()[rng.integers(0, a.size, 60)] = np.nan
        cubes[m] = a
    cubes[1][12:18, :, :] = np.nan  # a bin without values
    rows = spark.createDataFrame([(m, j, k, a[k, j].tolist()) for m, a in cubes.items() for k in range(30) for j in range(16)], "model bigint, j int, k int, row array<double>")
    sites = [(-21.0, 31.0), (36.0, 171.0), (34.0, -179.0), (0.0, 0.0), (80.0, 10.0), (-75.0, -100.0), (5.0, 100.0), (-50.0, 60.0)]
    points = spark.createDataFrame([("p", n, la, lo) for n, (la, lo) in enumerate(sites)], "kind string, site bigint, lat double, lon double")
    got = {(r.model, r.site): tuple(r)[3:] for r in U.tubes(rows, ["model"], GRID, points, TUBE).collect()}
    assert len(got) == 16
    lengths = set()
    for (m, s), r in got.items():
        want = plain(cubes[m], sites[s], TUBE)
        lengths.add(want[0])
        for x, y in zip(r, want):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-6), (m, s, r, want)
    assert len(lengths) > 2


def test_small_chunks_change_nothing(monkeypatch):
    rng = np.random.default_rng(13)
    binned = rng.normal(0, 1, (4, 16, 24))
    lat, lon = rng.uniform(-80, 80, 30), rng.uniform(-180, 180, 30)
    want = U.walk(binned, GRID, lat, lon, TUBE)
    monkeypatch.setattr(U, "HELD", 1000)
    for x, y in zip(U.walk(binned, GRID, lat, lon, TUBE), want):
        assert np.array_equal(x, y, equal_nan=True)


def test_sites_that_meet_in_a_cell_share_what_is_around_it(monkeypatch):
    """Before: rings and widths were made for every site and bin."""
    rng, asked, plain_width = np.random.default_rng(4), [], U._half_width
    a = rng.normal(0, 1.5, (len(GRID.depth), len(GRID.lat), len(GRID.lon)))
    binned, _ = U.depth_bins(a, GRID.depth, TUBE)
    lat, lon = rng.uniform(-40, 40, 900), rng.uniform(-180, 180, 900)
    want = [np.concatenate(x) for x in zip(*(U.walk(binned, GRID, lat[n : n + 1], lon[n : n + 1], TUBE) for n in range(900)))]
    monkeypatch.setattr(U, "_half_width", lambda *x: asked.append(1) or plain_width(*x))
    for x, y in zip(U.walk(binned, GRID, lat, lon, TUBE), want):
        np.testing.assert_array_equal(x, y)
    assert 0 < len(asked) <= len(binned) * a[0].size
