"""The sweep over configurations against one search per configuration, and injections against copies."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from terravox.operators import routing as R
from terravox.operators import sweep as W
from terravox.operators.injection import axis

GRID = R.Grid(tuple(-70.0 + 20.0 * x for x in range(8)), tuple(-180.0 + 30.0 * x for x in range(12)), tuple(100.0 * x for x in range(29)))
CASE = dict(variant=3, ilat=10.0, ilon=-60.0, amp=-2.0, tilt=10.0, profile="uniform")


def cube(seed, holes=0):
    a = np.random.default_rng(seed).normal(0, 1.5, (29, 8, 12))
    a.ravel()[np.random.default_rng(seed + 1).integers(0, a.size, holes)] = np.nan
    return a


def plain_background(shell, sigma):
    """Smoothing by its definition: sums over offsets, cut at four widths, missing values without weight."""
    nlat, nlon = shell.shape
    km = math.pi * 6371.0 / 180

    def bell(s):
        r = int(4 * s + 0.5)
        w = [math.exp(-0.5 * (o / s) ** 2) for o in range(-r, r + 1)]
        return [(o, x / sum(w)) for o, x in zip(range(-r, r + 1), w)]

    def down(a):
        return [[sum(w * a[min(nlat - 1, max(0, j + o))][i] for o, w in bell(sigma / (20.0 * km))) for i in range(nlon)] for j in range(nlat)]

    def around(a):
        out = []
        for j in range(nlat):
            s = min(sigma / (30.0 * km * max(math.cos(math.radians(GRID.lat[j])), 0.02)), nlon / 6)
            out.append([sum(w * a[j][(i + o) % nlon] for o, w in bell(s)) for i in range(nlon)])
        return np.array(out)

    seen = np.isfinite(shell)
    return around(down(np.where(seen, shell, 0.0))) / around(down(seen.astype(float)))


def plain_channel(a, name, sigma):
    contrast = np.stack([x - plain_background(x, sigma) for x in a])
    return {"anom": a, "contrast": contrast, "min": np.minimum(a, contrast)}[name]


def plain_seed(a, c, lateral=0.6, ncell=2):
    """One whole field of one configuration by the ordinary search."""
    case = R.Case(0, c.s, c.z_target, c.h_max, lateral, ncell)
    tile = R.Tile(GRID, case, np.where(np.isfinite(a), a, 0.0), 0, 0, None)
    return R._backward(tile, {}, 0, len(GRID.depth), "cost")[GRID.seed_shell()]


FIELDS = W.configurations(GRID, s=(0.3, 0.8), reaches=(300.0, 4500.0))


def test_configurations():
    assert len(W.configurations(GRID)) * len(W.RADII) == 288
    shallow = R.Grid(GRID.lat, GRID.lon, tuple(100.0 * x for x in range(27)))
    assert {c.z_target for c in W.configurations(shallow)} == {2300.0, 2500.0}


@pytest.mark.parametrize("holes", [0, 150])
def test_sweep_equals_one_search_per_configuration(holes):
    a = cube(1, holes)
    got = {c.case: top for c, top in W.seed_fields(W.Cube(GRID, a, 800.0), FIELDS, 0.6, 2)}
    assert len(got) == len(FIELDS) == 48
    for c in FIELDS:
        assert np.allclose(got[c.case], plain_seed(plain_channel(a, c.channel, 800.0), c), rtol=1e-12), c


def test_small_steps_change_nothing(monkeypatch):
    a = W.Cube(GRID, cube(2), 800.0)
    want = {c.case: top for c, top in W.seed_fields(a, FIELDS, 0.6, 1)}
    monkeypatch.setattr(W, "STEP_VALUES", 1)
    for c, top in W.seed_fields(a, FIELDS, 0.6, 1):
        assert np.array_equal(top, want[c.case])


def injected_copy(a, case, radius):
    spec, out = axis(case, GRID.depth), a.copy()
    for k in range(a.shape[0]):
        for j, la in enumerate(GRID.lat):
            for i, lo in enumerate(GRID.lon):
                p, q = math.radians(spec["lat"][k]), math.radians(la)
                cos = math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(math.radians(lo - spec["lon"][k]))
                out[k, j, i] += spec["amp"][k] * math.exp(-0.5 * (6371.0 * math.acos(max(-1.0, min(1.0, cos))) / (radius / 2)) ** 2)
    return out


def test_patch_equals_a_copy_and_is_undone_exactly():
    a = cube(3, 40)
    c = W.Cube(GRID, a, 800.0)
    before = c.anom.copy(), c.contrast.copy()
    saved = c.patch(CASE, 1500.0)
    want = injected_copy(a, CASE, 1500.0)
    for name in W.CHANNELS:
        x = plain_channel(want, name, 800.0)
        assert np.allclose(c.channel(name), np.where(np.isfinite(x), x, 0.0), atol=1e-12)
    assert not np.array_equal(c.anom, before[0])
    c.undo(saved)
    assert np.array_equal(c.anom, before[0]) and np.array_equal(c.contrast, before[1])


def test_sweep_on_spark(spark):
    cubes = {m: cube(m, 20) for m in (0, 1, 2)}
    rows = spark.createDataFrame([(m, j, k, a[k, j].tolist()) for m, a in cubes.items() for k in range(29) for j in range(8)], "model bigint, j int, k int, row array<double>")
    seen = {(r.model, r.case, r.j): r.row for r in W.observed(rows, ["model"], GRID, FIELDS, 0.6, 2).collect()}
    assert len(seen) == 3 * 48 * 8
    cases = [dict(CASE, variant=v, amp=-0.5 * v) for v in range(1, 11)]
    after = W.injected(rows, ["model"], GRID, FIELDS[:6], cases, {v: range(2, 5) for v in range(1, 11)}, 0.6, 2, 1500.0)
    after = {(r.model, r.variant, r.case, r.j): r.row for r in after.collect()}
    assert len(after) == 3 * 10 * 6 * 3
    for m, a in cubes.items():
        for c in FIELDS[::7]:
            top = plain_seed(plain_channel(a, c.channel, 800.0), c)
            assert all(np.allclose(seen[m, c.case, j], top[j], rtol=1e-12) for j in range(8))
    for c in FIELDS[:6:2]:
        top = plain_seed(plain_channel(injected_copy(cubes[1], cases[4], 1500.0), c.channel, 800.0), c)
        assert all(np.allclose(after[1, 5, c.case, j], top[j], rtol=1e-12) for j in (2, 3, 4))


def test_costs_are_held_once_per_seat(spark):
    """Before: a row for every place and configuration; places with the same caps have the same costs."""
    from terravox.plans import search_queries as Q

    sf, radii, few = "/root/testdata/sf0.001", (2.0, 12.0), Q.FIELDS[:4]
    f = Q.keep(W.observed(Q.rows(spark, sf), ["model"], Q.GRID, few, Q.LATERAL, Q.NCELL), "few-fields")
    places, by_site = Q.seated(spark, sf, radii), Q.site_costs(spark, sf, few, radii, fields=f)
    costs = Q.seat_costs(spark, f, places, radii)
    th, want = Q.seat_threshold(costs), Q.null_threshold(by_site)
    order = lambda d, c: [tuple(r) for r in d.select(*c).orderBy(*c[:3]).collect()]
    cols = ["model", "case", "radius", "threshold"]
    assert order(th, cols) == order(want, cols)
    per_place = by_site.filter("kind = 'hotspot'").join(want, cols[:3]).groupBy("model", "site").agg(F.avg((F.col("cost") < F.col("threshold")).cast("double")).alias("share"), F.median("cost").alias("mid"), F.count("*").alias("n"))
    got = Q.ensemble(costs, th, places).select("model", "site", "root_fraction", "cost_median", "n_ensemble")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, per_place.collect()))
    assert costs.count() < by_site.count()
