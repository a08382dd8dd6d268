"""Second routes against a whole search with the closed cells as a mask."""

import numpy as np
from pyspark.sql import functions as F

from terravox.operators import routing as R
from terravox.operators import second_roots as Z
from test_structures import km

GRID = R.Grid(tuple(-63.0 + 14.0 * x for x in range(10)), tuple(-180.0 + 24.0 * x for x in range(15)), tuple(100.0 * x for x in range(25)))
CASE = R.Case(0, 0.6, 2300.0, 300.0, 0.6, 1)


def test_second_roots_equal_a_masked_search(spark):
    rng = np.random.default_rng(15)
    cubes = {m: rng.normal(0, 1.5, (25, 10, 15)) for m in (0, 1)}
    rows = spark.createDataFrame([(m, j, k, a[k, j].tolist()) for m, a in cubes.items() for k in range(25) for j in range(10)], "model bigint, j int, k int, row array<double>").cache()
    roots, caps = [(2, 3), (7, 11), (4, 0)], [(1, 3, 3, 1), (6, 8, 11, 2), (4, 5, 14, 1), (0, 1, 7, 1)]
    sites = spark.createDataFrame([(m, 10 * r + c, *caps[c], *roots[r]) for m in (0, 1) for r in range(3) for c in range(4)], "model bigint, site bigint, cj0 int, cj1 int, ci int, cw int, root_j int, root_i int")
    got = {(x.model, x.site): x for x in Z.second_roots(rows, ["model"], GRID, CASE, sites, 3500.0, 1500.0, spread=3).collect()}
    assert len(got) == 24 and all(x.reached for x in got.values())
    for r, root in enumerate(roots):
        spot = lambda j, i: (GRID.lat[j], GRID.lon[i])
        ban = [(m, j, k, [float(k * 100.0 >= 1500.0 and km(spot(*root), spot(j, i)) <= 3500.0) for i in range(15)]) for m in (0, 1) for j in range(10) for k in range(25)]
        bans = spark.createDataFrame(ban, "model bigint, j int, k int, row array<double>")
        f = R.solve(spark, rows, ["model"], GRID, [CASE], bans=bans).cache()
        top = {(x.model, x.j): x.row for x in f.filter(F.col("k") == GRID.seed_shell()).collect()}
        for (m, site), x in got.items():
            if site // 10 == r:
                j0, j1, ci, cw = caps[site % 10]
                cells = [(top[m, j][i % 15], j, i % 15) for j in range(j0, j1 + 1) for i in range(ci - cw, ci + cw + 1)]
                assert abs(x.cost - min(cells)[0]) < 1e-9
                assert x.end_k == GRID.target_shell(2300.0)
                assert km(spot(*root), spot(x.end_j, x.end_i)) > 3500.0
                assert abs(x.separation_km - km(spot(*root), spot(x.end_j, x.end_i))) < 1e-6
    nothing = Z.second_roots(rows, ["model"], GRID, CASE, sites.limit(3), 30_000.0, 1500.0).collect()
    assert len(nothing) == 3 and not any(x.reached for x in nothing) and all(x.cost is None for x in nothing)


def test_second_routes_end_where_second_roots_do(spark):
    a = np.random.default_rng(16).normal(0, 1.5, (25, 10, 15))
    rows = spark.createDataFrame([(0, j, k, a[k, j].tolist()) for k in range(25) for j in range(10)], "model bigint, j int, k int, row array<double>")
    sites = spark.createDataFrame([(0, 1, 1, 3, 3, 1, 2, 3), (0, 2, 6, 8, 11, 2, 7, 11), (0, 3, 4, 5, 14, 1, 4, 0)], "model bigint, site bigint, cj0 int, cj1 int, ci int, cw int, root_j int, root_i int")
    ends = {x.site: (x.end_k, x.end_j, x.end_i) for x in Z.second_roots(rows, ["model"], GRID, CASE, sites, 3500.0, 1500.0).collect()}
    routes: dict[int, list] = {}
    for x in Z.second_routes(rows, ["model"], GRID, CASE, sites, 3500.0, 1500.0).collect():
        routes.setdefault(x.site, []).append((x.n, x.k, x.j, x.i))
    for site, nodes in routes.items():
        nodes.sort()
        assert [n[0] for n in nodes] == list(range(len(nodes))) and nodes[0][1] == GRID.seed_shell()
        assert nodes[-1][1:] == ends[site]
    assert routes.keys() == ends.keys() == {1, 2, 3}


def test_small_tiles_are_not_merged(spark):
    """Few bytes are long work here: before, one shuffle of 40 models came as one task."""
    rows = spark.range(40).withColumnRenamed("id", "model")
    assert R.tiles(rows, ["model"]).select(F.spark_partition_id()).distinct().count() > 8
