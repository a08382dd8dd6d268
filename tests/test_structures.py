"""Structures against flood fill over cells, and ways down against a walk over cells."""

import math

import numpy as np
import pytest

from terravox.operators import routing as R
from terravox.operators import structures as S

GRID = R.Grid(tuple(-75.0 + 15.0 * x for x in range(11)), tuple(-180.0 + 20.0 * x for x in range(18)), tuple(100.0 * x for x in range(14)))
RULES = S.Rules(below=-0.8, min_area=3.0e6, min_extent=200.0, floor_km=3000.0, min_cells=2, run_shells=2)


def cube(seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 1, (14, 11, 18))
    a = (a + np.roll(a, 1, 2) + np.roll(a, 1, 1) + np.roll(a, 1, 0)) / 1.6  # clumps
    a[5, 3, 4] = np.nan
    return a


def neighbours(j, i):
    return [(j + dj, (i + di) % 18) for dj, di in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= j + dj < 11]


def fill(on, start, step):
    seen, todo = {start}, [start]
    while todo:
        for n in step(todo.pop()):
            if n in on and n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def km(a, b):
    p, q, d = math.radians(a[0]), math.radians(b[0]), math.radians(a[1] - b[1])
    return 6371.0 * math.acos(max(-1.0, min(1.0, math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(d))))


def area(j):
    deg = math.pi * 6371.0 / 180
    return 15 * deg * 20 * deg * math.cos(math.radians(GRID.lat[j]))


def plain_cells(a):
    """Cells that belong to a large enough region, as (k, j, i) -> the cells of the region."""
    out = {}
    for k in range(14):
        on = {(j, i) for j in range(11) for i in range(18) if a[k, j, i] < RULES.below}
        while on:
            part = fill(on, next(iter(on)), lambda c: neighbours(*c))
            on -= part
            if sum(area(j) for j, _ in part) >= RULES.min_area:
                for j, i in part:
                    out[k, j, i] = frozenset(part)
    return out


def centre(part):
    v = np.zeros(3)
    for j, i in part:
        la, lo = math.radians(GRID.lat[j]), math.radians(GRID.lon[i])
        v += math.cos(la) * np.array([math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)])
    v /= np.linalg.norm(v)
    return math.degrees(math.asin(v[2])), math.degrees(math.atan2(v[1], v[0]))


def plain_structures(a):
    on, out = plain_cells(a), {}
    left = set(on)

    def step(c):
        k, j, i = c
        return [(k, *n) for n in neighbours(j, i)] + [(k + 1, j, i), (k - 1, j, i)]

    while left:
        body = fill(left, next(iter(left)), step)
        left -= body
        ks = [c[0] for c in body]
        if 100.0 * (max(ks) - min(ks)) < RULES.min_extent:
            continue
        number = min(k * 198 + min(j * 18 + i for j, i in on[k, j0, i0]) for k, j0, i0 in body for _ in (0,))
        counts, spread = [], []
        for k in range(14):
            parts = sorted({on[c] for c in body if c[0] == k and len(on[c]) >= RULES.min_cells}, key=lambda p: (-len(p), min(j * 18 + i for j, i in p)))
            groups = []
            for p in parts:
                (la, lo), n = centre(p), len(p)
                for g in groups:
                    if km((g[0], g[1]), (la, lo)) < RULES.floor_km:
                        d = (lo - g[1] + 180) % 360 - 180
                        g[:] = [(g[0] * g[2] + la * n) / (g[2] + n), (g[1] + d * n / (g[2] + n) + 180) % 360 - 180, g[2] + n]
                        break
                else:
                    groups.append([la, lo, n])
            counts.append(len(groups))
            if len(groups) > 1:
                mla = np.mean([g[0] for g in groups])
                mlo = groups[0][1] + np.mean([(g[1] - groups[0][1] + 180) % 360 - 180 for g in groups])
                spread.append(np.mean([km((mla, mlo), (g[0], g[1])) for g in groups]))
        levels = [m for m in range(2, max(counts) + 1) if any(all(c >= m for c in counts[k : k + 2]) for k in range(13))]
        branch = max((100.0 * (k + 1) for k in range(13) if counts[k] >= 2 and counts[k + 1] >= 2), default=None)
        out[number] = (min(ks), max(ks), len(body), max(levels, default=1), len(levels), branch, float(np.median(spread)) if spread else None)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_structures_equal_flood_fill(seed):
    a = cube(seed)
    b = S.Body(GRID, a, RULES)
    got = {s: b.describe(rs) for s, rs in b.structures().items()}
    want = plain_structures(a)
    assert set(got) == set(want) and want
    for s, w in want.items():
        g = got[s]
        assert (g["k_top"], g["k_base"], g["cells"], g["pieces"], g["levels"], g["branch_km"]) == w[:6]
        assert (g["spread_km"] is None) == (w[6] is None) and (w[6] is None or abs(g["spread_km"] - w[6]) < 1e-6)
        assert 0 <= g["tilt_deg"] <= 90 and (g["azimuth_deg"] is None or 0 <= g["azimuth_deg"] < 360)


def test_lean_of_a_known_body():
    a = np.zeros((14, 11, 18))
    for k in range(10):
        a[k, 5, (3 + k // 2) % 18] = a[k, 5, (4 + k // 2) % 18] = -2.0  # deeper is further east
    b = S.Body(GRID, a, RULES)
    (s, rs), = b.structures().items()
    d = b.describe(rs)
    assert s == 5 * 18 + 3 and (d["k_top"], d["k_base"], d["pieces"]) == (0, 9, 1)
    assert abs(d["azimuth_deg"] - 270.0) < 1e-6 and abs(d["offset_km"] - 4 * 20 * math.pi * 6371 / 180) < 1e-6
    way = b.descend(0, s)
    assert (way["root_km"], way["n_depths"], way["n_branch"], way["n_split"], way["max_strands"]) == (900.0, 10, 0, 0, 1)


def plain_way(a, site):
    """Descent from a site over sets of cells."""
    on = plain_cells(a)
    j0 = min(range(11), key=lambda j: abs(GRID.lat[j] - site[0]))
    i0 = min(range(18), key=lambda i: abs((GRID.lon[i] - site[1] + 180) % 360 - 180))
    for k0 in range(3, 8):
        parts = {p for (k, _, _), p in on.items() if k == k0}
        seed = on.get((k0, j0, i0)) or min((p for p in parts if km(site, centre(p)) <= RULES.near_km), key=lambda p: km(site, centre(p)), default=None)
        if seed:
            break
    else:
        return None
    front, strands, joins, splits, last = {seed}, [], 0, 0, k0
    for k in range(k0, 13):
        strands.append(len(front))
        last = k
        below = {p: {on[k + 1, j, i] for j, i in p if (k + 1, j, i) in on} for p in front}
        splits += sum(len(x) > 1 for x in below.values())
        nxt = set().union(*below.values())
        joins += sum(sum(n in x for x in below.values()) > 1 for n in nxt)
        front = nxt
        if not front:
            break
    if len(strands) < 3:
        return None
    slow = sum(any(km(site, centre(p)) <= RULES.near_km for (q, _, _), p in on.items() if q == k) for k in range(last + 1, 14)) / max(13 - last, 1)
    return 100.0 * last, len(strands), joins, splits, max(strands), slow


def test_structures_and_ways_on_spark(spark):
    cubes = {m: cube(10 + m) for m in (0, 1)}
    rows = spark.createDataFrame([(m, j, k, a[k, j].tolist()) for m, a in cubes.items() for k in range(14) for j in range(11)], "model bigint, j int, k int, row array<double>")
    got = {(r.model, r.structure): r for r in S.table(rows, ["model"], GRID, RULES).collect()}
    assert {k for m, k in got if m == 1} == set(plain_structures(cubes[1]))
    foot = S.footprints(rows, ["model"], GRID, RULES).collect()
    assert len({(r.model, r.structure, r.j, r.i) for r in foot}) == len(foot) and {(r.model, r.structure) for r in foot} == set(got)
    rng = np.random.default_rng(14)
    sites = list(zip(rng.uniform(-80, 80, 40), rng.uniform(-180, 180, 40)))
    points = spark.createDataFrame([("p", n, float(la), float(lo)) for n, (la, lo) in enumerate(sites)], "kind string, site bigint, lat double, lon double")
    ways = {(r.model, r.site): r for r in S.descents(rows, ["model"], GRID, points, 300.0, RULES).collect()}
    assert len(ways) == 80 and any(r.found for r in ways.values()) and not all(r.found for r in ways.values())
    for (m, s), r in ways.items():
        want = plain_way(cubes[m], sites[s])
        assert r.found == (want is not None), (m, s)
        if want:
            assert (r.root_km, r.n_depths, r.n_branch, r.n_split, r.max_strands) == want[:5] and abs(r.slow_below - want[5]) < 1e-9
