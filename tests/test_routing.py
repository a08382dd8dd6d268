"""Fields and paths against exhaustive search on small grids."""

import heapq
import math

import numpy as np
import pytest

from terravox.operators import routing as R

LAT = tuple(-35.0 + 10.0 * x for x in range(8))
LON = tuple(-180.0 + 60.0 * x for x in range(6))
DEPTH = tuple(50.0 * x for x in range(9))
GRID = R.Grid(LAT, LON, DEPTH)


def cube(seed, grid=GRID):
    return np.random.default_rng(seed).normal(0, 1.5, (len(grid.depth), len(grid.lat), len(grid.lon)))


def frame(spark, a):
    return spark.createDataFrame(
        [(0, j, k, [float(x) for x in a[k, j]]) for k in range(a.shape[0]) for j in range(a.shape[1])], "model int, j int, k int, row array<double>"
    )


def to_cube(df, case, shape):
    out = np.full(shape, np.nan)
    for r in df.filter(f"case = {case}").collect():
        out[r.k, r.j] = r.row
    return out


def exhaustive(a, case, grid, ban=None):
    """Dijkstra over (shell, row, column, steps left), run backwards from the target shell."""
    nz, nlat, nlon = a.shape
    k0, steps, spans = grid.target_shell(case.z_target), grid.sidesteps(case.h_max), grid.spans(grid.target_shell(case.z_target))
    a = np.clip(a, -6, 6)
    dlat, z = grid.row_km, grid.depth

    def out_edges(k, j, i, b):
        if k < k0:
            yield (k + 1, j, i, steps), (z[k + 1] - z[k]) * math.exp(case.s * 0.5 * (a[k, j, i] + a[k + 1, j, i]))
            for dk in spans:
                if k + dk > k0:
                    continue
                for c in range(1, case.ncell + 1):
                    for dj, di in ((c, 0), (-c, 0), (0, c), (0, -c)):
                        if not 0 <= j + dj < nlat:
                            continue
                        side = dlat * c if dj else grid.col_km(np.array([j]))[0] * c
                        seg = np.mean([a[k : k + dk + 1, j + np.sign(dj) * t, (i + np.sign(di) * t) % nlon].mean() for t in range(c + 1)])
                        yield (k + dk, j + dj, (i + di) % nlon, steps), math.hypot(z[k + dk] - z[k], case.lateral * side) * math.exp(case.s * seg)
            if b > 0:
                for dj, di in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                    if 0 <= j + dj < nlat:
                        w = dlat if dj else grid.col_km(np.array([j]))[0]
                        yield (k, j + dj, (i + di) % nlon, b - 1), case.lateral * w * math.exp(case.s * a[k, j, i])

    back = {}
    for k in range(k0 + 1):
        for j in range(nlat):
            for i in range(nlon):
                for b in range(steps + 1):
                    if ban is not None and ban[k, j, i]:
                        continue
                    for node, w in out_edges(k, j, i, b):
                        if ban is None or not ban[node[:3]]:
                            back.setdefault(node, []).append(((k, j, i, b), w))
    dist, heap = {}, []
    for j in range(nlat):
        for i in range(nlon):
            if ban is None or not ban[k0, j, i]:
                for b in range(steps + 1):
                    heap.append((0.0, (k0, j, i, b)))
    heapq.heapify(heap)
    while heap:
        d, n = heapq.heappop(heap)
        if n in dist:
            continue
        dist[n] = d
        for m, w in back.get(n, ()):
            if m not in dist:
                heapq.heappush(heap, (d + w, m))
    c = np.full(a.shape, np.inf)
    for (k, j, i, b), d in dist.items():
        if b == steps:
            c[k, j, i] = d
    return c


CASES = [R.Case(0, 0.5, 400.0, 2300.0, 0.6, 2), R.Case(1, 0.8, 350.0, None, 1.0, 1), R.Case(2, 0.3, 9999.0, 1200.0, 0.4, 1)]


def test_cost_field_equals_exhaustive_search(spark):
    a = cube(1)
    f = R.solve(spark, frame(spark, a), ["model"], GRID, CASES).cache()
    for c in CASES:
        np.testing.assert_allclose(to_cube(f, c.case, a.shape), exhaustive(a, c, GRID), rtol=1e-12)


def test_forbidden_cells_never_lower_the_cost(spark):
    a = cube(2)
    ban = a > 1.0
    bans = frame(spark, ban.astype(float))
    f = R.solve(spark, frame(spark, a), ["model"], GRID, CASES[:1], bans=bans)
    got = to_cube(f, 0, a.shape)
    np.testing.assert_allclose(got, exhaustive(a, CASES[0], GRID, ban), rtol=1e-12)
    assert (got >= exhaustive(a, CASES[0], GRID) - 1e-9).all()


def seed_cap(spark, grid, lat, lon, radius):
    from terravox.operators.route_sites import caps

    c = caps(spark.createDataFrame([(lat, lon)], "lat double, lon double"), grid, radius).first()
    return list(range(c.cj0, c.cj1 + 1)), [x % len(grid.lon) for x in range(c.ci - c.cw, c.ci + c.cw + 1)]


TALL = R.Grid(tuple(-78.0 + 4.0 * x for x in range(40)), LON, DEPTH)


@pytest.mark.parametrize("kind", ["cost", "bottleneck", "arrival"])
def test_bands_and_rounds_change_nothing(spark, kind):
    a = cube(3, TALL)
    case = [R.Case(4, 0.5, 400.0, 500.0, 0.6, 1)]
    seeds = {4: seed_cap(spark, TALL, 10.0, 20.0, 5.0)}
    rows = frame(spark, a)
    whole = R.solve(spark, rows, ["model"], TALL, case, kind, seeds=seeds)
    cut = R.solve(spark, rows, ["model"], TALL, case, kind, seeds=seeds, layout=R.Layout(2, 9, 2 * 3, 3))
    np.testing.assert_allclose(to_cube(cut, 4, a.shape), to_cube(whole, 4, a.shape), rtol=1e-12)


def test_arrival_and_cost_are_halves_of_one_search(spark):
    a = cube(5)
    for c in (R.Case(0, 0.5, 400.0, 2300.0, 0.6, 2), R.Case(0, 0.5, 400.0, None, 1.0, 1)):
        cost = to_cube(R.solve(spark, frame(spark, a), ["model"], GRID, [c]), 0, a.shape)
        jj, ii = seed_cap(spark, GRID, 5.0, 60.0, 2.0)
        d = to_cube(R.solve(spark, frame(spark, a), ["model"], GRID, [c], "arrival", seeds={0: (jj, ii)}), 0, a.shape)
        best = cost[GRID.seed_shell()][np.ix_(jj, ii)].min()
        assert abs((d + cost).min() - best) <= 1e-9 * best


def test_path_costs_what_the_field_says(spark):
    a = cube(6, TALL)
    case = R.Case(1, 0.5, 400.0, 500.0, 0.6, 1)
    rows = frame(spark, a)
    f = R.solve(spark, rows, ["model"], TALL, [case]).cache()
    c = to_cube(f, 1, a.shape)
    starts = spark.createDataFrame([(0, 1, s, 3 * s + 1, s % 6) for s in range(12)], "model int, case int, site int, j int, i int")
    whole = {(r.site, r.n): (r.k, r.j, r.i) for r in R.paths(spark, rows, f, starts, ["model"], TALL, [case]).collect()}
    cut = {(r.site, r.n): (r.k, r.j, r.i) for r in R.paths(spark, rows, f, starts, ["model"], TALL, [case], layout=R.Layout(2, 9, 9, 3)).collect()}
    assert whole == cut
    a, z = np.clip(a, -6, 6), TALL.depth
    for s in range(12):
        nodes = [whole[s, n] for n in range(len(z) * 20) if (s, n) in whole]
        assert nodes[-1][0] == TALL.target_shell(400.0)
        total = 0.0
        for (k, j, i), (k2, j2, i2) in zip(nodes, nodes[1:]):
            side = TALL.row_km if j != j2 else (TALL.col_km(np.array([j]))[0] if i != i2 else 0.0)
            if k == k2:
                total += case.lateral * side * math.exp(case.s * a[k, j, i])
            else:
                seg = (a[k : k2 + 1, j, i].mean() + a[k : k2 + 1, j2, i2].mean()) / 2
                total += math.hypot(z[k2] - z[k], case.lateral * side) * math.exp(case.s * seg)
        assert abs(total - c[nodes[0]]) < 1e-6


def test_longitude_roll_rolls_the_field(spark):
    a = cube(7)
    f = to_cube(R.solve(spark, frame(spark, a), ["model"], GRID, CASES[:1]), 0, a.shape)
    g = to_cube(R.solve(spark, frame(spark, np.roll(a, 2, axis=2)), ["model"], GRID, CASES[:1]), 0, a.shape)
    np.testing.assert_allclose(g, np.roll(f, 2, axis=2), rtol=1e-12)


def test_a_path_that_is_too_long_is_refused(spark, monkeypatch):
    a = cube(8)
    case = R.Case(1, 0.5, 400.0, 500.0, 0.6, 1)
    rows = frame(spark, a)
    f = R.solve(spark, rows, ["model"], GRID, [case])
    head = {"k": GRID.seed_shell(), "j": 2, "row": [0, 2, 0, 0]}
    field = {k: to_cube(f, 1, a.shape)[k] for k in range(a.shape[0])}
    monkeypatch.setattr(R, "LONGEST", 2)
    with pytest.raises(RuntimeError):
        R._follow(R.Tile(GRID, case, a, 0, 0, None), field, [head], True, 0, a.shape[0])


def test_arrivals_side_by_side_equal_one_by_one():
    grid = R.Grid(tuple(-63.0 + 14.0 * x for x in range(10)), tuple(-180.0 + 24.0 * x for x in range(15)), tuple(100.0 * x for x in range(12)))
    a = np.random.default_rng(17).normal(0, 1.5, (12, 10, 15))
    a[:, 9, 12:] = np.inf
    tile = R.Tile(grid, R.Case(0, 0.6, 1000.0, 300.0, 0.6, 1), a, 0, 0, None)
    seeds = np.full((3, 10, 15), np.inf)
    seeds[0, 2, 3] = seeds[1, 7, 11] = seeds[2, 0, 0] = 0.0
    with np.errstate(invalid="ignore", over="ignore"):
        together = R._arrivals(tile, {}, seeds, 0, 12)
        for n in range(3):
            alone = R._arrivals(tile, {}, seeds[n], 0, 12)
            assert all(np.array_equal(together[k][n], alone[k]) for k in range(12))


def test_excess_is_folded_in_the_task(spark):
    """Before: an arrival field per cap was written. Both ways, and a plain sum of two fields, agree."""
    from terravox.operators import route_sites as S

    a = cube(5)
    case, caps = R.Case(0, 0.5, 350.0, 1200.0, 0.6, 1), {0: ([1, 2], [3, 4]), 1: ([4], [0]), 2: ([5, 6], [5, 0])}
    units = [R.Case(n, case.s, case.z_target, case.h_max, case.lateral, case.ncell) for n in caps]
    cost = R.solve(spark, frame(spark, a), ["model"], GRID, [case])
    tight = R.Layout(2, 4, (GRID.sidesteps(case.h_max) + case.ncell) * 3, max(GRID.spans(len(GRID.depth) - 1)))
    got = [S.excess(spark, frame(spark, a), ["model"], GRID, units, caps, cost, "cap", 2, lay) for lay in (None, tight)]
    assert "Join" not in got[0]._jdf.queryExecution().optimizedPlan().toString()
    one, two = ({(r.cap, r.k): r for r in g.collect()} for g in got)
    assert one.keys() == two.keys() and {c for c, _ in one} == set(caps)
    ks, c0 = range(GRID.seed_shell(), GRID.target_shell(case.z_target) + 1), to_cube(cost, 0, a.shape)
    for cap, seeds in caps.items():
        d = to_cube(R.solve(spark, frame(spark, a), ["model"], GRID, [units[cap]], "arrival", seeds=caps), cap, a.shape)
        t = (d + c0)[ks.start : ks.stop]
        for k in ks:
            e, r, q = t[k - ks.start] - t.min(), one[cap, k], two[cap, k]
            fin = np.isfinite(e)
            want = (fin.sum(), e[fin].sum(), e.min(), t.min())
            for x in (r, q):
                np.testing.assert_allclose((x.n, x.total, x.least, x.c_best), want, rtol=1e-9, atol=1e-9)
                assert list(x.cells) == [int((e <= tau * t.min()).sum()) for tau in S.TAUS]
            np.testing.assert_allclose(r.area, q.area, rtol=1e-9)
