"""Named shapes against their definitions written out, shell by shell."""

import math

import numpy as np
import pytest

from terravox.operators import routing as R
from terravox.operators import shapes as X
from terravox.operators import sweep as W

GRID = R.Grid(tuple(-81.0 + 9.0 * x for x in range(19)), tuple(-180.0 + 15.0 * x for x in range(24)), tuple(45.0 * k for k in range(64)))
SITE, RADIUS = (20.0, -156.0), 900.0


def share(z):
    return (z - 100.0) / 2700.0


def step(spot, d, bearing):
    la = spot[0] + d * math.cos(math.radians(bearing))
    return la, spot[1] + d * math.sin(math.radians(bearing)) / max(math.cos(math.radians(la)), 0.2)


def limbs(name, z):
    """(lat, lon, radius, strength) of each limb at one depth."""
    lean = lambda s: step(SITE, 10.0 * s, 45.0)
    f, here = share(z), (*SITE, RADIUS, 1.0)
    if name == "vertical":
        return [here]
    if name == "transition":
        g = 0.15 * (z - 100) / 310 if z <= 410 else 0.15 + 0.5 * (z - 410) / 250 if z <= 660 else 0.65 + 0.35 * (z - 660) / 2140
        return [(*lean(g), RADIUS, 1.0)]
    if name == "s_shaped":
        return [(*lean(0.5 * math.sin(2 * math.pi * f) + 0.25 * f), RADIUS, 1.0)]
    if name == "reversing":
        return [(*step(SITE, 10.0 * f, 45.0 + 90.0 * f), RADIUS, 1.0)]
    if name == "bifurcating":
        s = min(1.0, max(0.0, (1500.0 - z) / 900.0))
        return [(*step(lean(f), 5.0 * s * h, 135.0), 0.8 * RADIUS, 0.5 + 0.5 * (1 - s)) for h in (1, -1)]
    if name == "sheet":
        return [(*step(lean(f), RADIUS / 2 / 111.19 * n, 135.0), RADIUS, 1.0) for n in range(-4, 5)]
    if name == "twin_branch":
        m = min(1.0, max(0.0, (z - 2000.0) / 600.0))
        out = []
        for h in (1, -1):
            d, q = 4.0 * h * (1 - m), math.sqrt(0.5)
            la = SITE[0] - d * q + 10.0 * f * q
            out.append((la, SITE[1] + (d * q + 10.0 * f * q) / max(math.cos(math.radians(la)), 0.2), 0.8 * RADIUS, 1.0))
        return out
    main = (*lean(f), RADIUS, 1.0)
    if name == "uniform":
        return [main]
    if name == "tapered":
        return [(*main[:3], 0.33 + 0.67 * f)]
    if name == "gapped":
        return [] if 1400 < z < 1800 else [main]
    if name == "narrow_in_broad":
        return [main, (*main[:2], 5 * RADIUS, 0.25)]
    broken = any(a < z < b for a, b in ((900, 1100), (1500, 1700), (2100, 2300)))
    return [main] if broken else [here, main]


@pytest.mark.parametrize("name", list(X.shapes(RADIUS)))
@pytest.mark.parametrize("amp", [-1.5, 0.75])
def test_shape(name, amp):
    got = X.added(name, GRID, *SITE, amp, RADIUS)
    for k, z in enumerate(GRID.depth):
        want = np.zeros((19, 24))
        ends = 0.0 if not 100 <= z <= 2800 else min(1.0, (2800 - z) / 200)
        for j, la in enumerate(GRID.lat):
            for i, lo in enumerate(GRID.lon):
                each = [0.0]
                for a, b, r, s in limbs(name, z) if ends else []:
                    p, q = math.radians(a), math.radians(la)
                    c = math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(math.radians(lo - b))
                    each.append(amp * s * math.exp(-0.5 * (6371.0 * math.acos(max(-1.0, min(1.0, c))) / (r / 2)) ** 2))
                want[j, i] = ends * (min(each) if amp < 0 else max(each))
        assert np.allclose(got.get(k, np.zeros((19, 24))), want, atol=1e-9), (name, z)


def test_there_are_twelve_and_each_is_undone():
    assert len(X.shapes(RADIUS)) == 12
    a = np.random.default_rng(1).normal(0, 1, (64, 19, 24))
    c = W.Cube(GRID, a, 800.0)
    for n, name in enumerate(X.shapes(RADIUS)):
        saved = c.patch(dict(variant=n, shape=name, ilat=20.0, ilon=-156.0, amp=-1.0), RADIUS)
        assert not np.array_equal(c.anom, a)
        c.undo(saved)
        assert np.array_equal(c.anom, a)
