"""Cut groups must give what one window gives, also when one key holds most rows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from terravox.operators import scaling, setops, spatial
from terravox.operators.scaling import Ordered, exact_percentiles


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(1)
    rows = [(int(0 if rng.random() < 0.5 else rng.integers(1, 40)), n, float(np.round(rng.normal(), 2))) for n in range(6000)]
    return spark.createDataFrame(rows, "g int, n long, x double").repartition(7).cache()


def test_pieces_do_cut(spark, hot):
    assert len(scaling.piece_bounds(hot, "n", rows_per_piece=300)) >= 15


@pytest.mark.parametrize("rows_per_piece", [300, 2_000_000])
def test_running_and_shift(spark, hot, rows_per_piece):
    o = Ordered(hot, ["g"], "n", rows_per_piece).running(
        {"s": ("sum", F.col("x")), "c": ("count", F.lit(1)), "lo": ("min", F.col("x")), "hi": ("max", F.col("x"))}
    ).lag(["x"]).lead(["x"])
    got = {r.n: r for r in o.result().collect()}
    w = Window.partitionBy("g").orderBy("n")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = hot.select("n", F.sum("x").over(up).alias("s"), F.count("*").over(up).alias("c"), F.min("x").over(up).alias("lo"), F.max("x").over(up).alias("hi"),
                      F.lag("x").over(w).alias("p"), F.lead("x").over(w).alias("q")).collect()
    for r in want:
        g = got[r.n]
        assert abs(g.s - r.s) < 1e-9 and (g.c, g.lo, g.hi, g.prev_x, g.next_x) == (r.c, r.lo, r.hi, r.p, r.q)


@pytest.mark.parametrize("rows_per_piece", [200, 2_000_000])
def test_exact_percentiles(spark, hot, rows_per_piece):
    got = {r.g: r for r in exact_percentiles(hot, ["g"], "x", {"a": 0.05, "b": 0.5, "c": 0.9}, rows_per_piece).collect()}
    pdf = hot.toPandas()
    for g, x in pdf.groupby("g")["x"]:
        np.testing.assert_allclose([got[g].a, got[g].b, got[g].c], np.percentile(x, [5, 50, 90]), atol=1e-12)


def test_salted_join_keeps_rows(spark, hot):
    dim = spark.createDataFrame([(g, g * 10) for g in range(0, 40, 2)], "g int, v int")
    for how in ("inner", "left"):
        a = scaling.salted_join(hot, dim, ["g"], how, 8).groupBy().agg(F.count("*").alias("n"), F.sum("v").alias("s")).first()
        b = hot.join(dim, "g", how).groupBy().agg(F.count("*").alias("n"), F.sum("v").alias("s")).first()
        assert a == b


def test_linked_pairs_and_components(spark):
    rng = np.random.default_rng(2)
    sets = {o: set(rng.choice(60, size=rng.integers(3, 25), replace=False).tolist()) | {0} for o in range(30)}
    m = spark.createDataFrame([(o, int(x)) for o, s in sets.items() for x in s], "o int, m int")
    for rows, rare in ((40, 5), (2_000_000, 5), (2_000_000, 1000)):
        got = {(r.a, r.b): r.shared for r in setops.linked_pairs(m, "o", "m", 0.5, rows, rare).collect()}
        want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * min(len(sets[a]), len(sets[b]))}
        assert got == want
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 13 != 12] + [(50, 44)], "a long, b long")
    lab = {r.node: r.label for r in setops.components(spark, spark.range(60).withColumnRenamed("id", "node"), edges).collect()}
    assert [lab[x] for x in (0, 12, 13, 25, 26, 38, 39, 40, 44, 50, 59)] == [0, 0, 13, 13, 26, 26, 39, 39, 44, 44, 59]


@pytest.mark.parametrize("limit", [200_000, 1])
def test_radius_join_is_whole(spark, monkeypatch, limit):
    """Also when the point side is too large to broadcast and the join is salted."""
    rng = np.random.default_rng(3)
    pts = [(i, float(la), float(lo)) for i, (la, lo) in enumerate(zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60)))] + [(60, 90.0, 0.0), (61, -89.9, 179.9)]
    cel = [(i, float(la), float(lo)) for i, (la, lo) in enumerate(zip(rng.uniform(-90, 90, 400), rng.uniform(-180, 180, 400)))]
    p = spark.createDataFrame(pts, "id int, lat double, lon double")
    c = spark.createDataFrame(cel, "cell int, lat double, lon double")
    monkeypatch.setattr(spatial, "broadcast_if_small", lambda df, max_rows=limit: scaling.broadcast_if_small(df, limit))
    for km in (300.0, 2500.0, 12000.0):
        got = {(r.p_id, r.cell) for r in spatial.radius_join(c, p, km).collect()}
        la1, lo1 = np.radians([x[1] for x in pts]), np.radians([x[2] for x in pts])
        la2, lo2 = np.radians([x[1] for x in cel]), np.radians([x[2] for x in cel])
        d = 6371.0 * np.arccos(np.clip(np.sin(la1)[:, None] * np.sin(la2) + np.cos(la1)[:, None] * np.cos(la2) * np.cos(lo1[:, None] - lo2), -1, 1))
        assert got == set(zip(*[a.tolist() for a in np.nonzero(d <= km)]))
    n = {r.id: r.dist_km for r in spatial.nearest_join(p, c, ["id"], ["cell"], 300.0).collect()}
    np.testing.assert_allclose([n[i] for i in range(62)], d.min(axis=1), rtol=1e-9)


@pytest.mark.parametrize("rows_per_piece", [300, 2_000_000])
def test_several_order_columns_break_ties_with_keys_of_any_size(spark, rows_per_piece):
    rng = np.random.default_rng(4)
    rows = [(int(rng.random() < 0.9), float(rng.integers(0, 40)), int(n) * 50_000_003 + 12_000_000_000) for n in rng.permutation(4000)]
    df = spark.createDataFrame(rows, "g int, x double, n long")
    got = {r.n: (r.rn, r.prev_n, r.next_n) for r in Ordered(df, ["g"], ["x", "n"], rows_per_piece).number("rn").lag(["n"]).lead(["n"]).result().collect()}
    w = Window.partitionBy("g").orderBy("x", "n")
    for r in df.select("n", F.row_number().over(w).alias("rn"), F.lag("n").over(w).alias("p"), F.lead("n").over(w).alias("q")).collect():
        assert got[r.n] == (r.rn, r.p, r.q)


def test_broadcast_is_refused_for_wide_rows(spark):
    wide = spark.range(2000).select("id", F.array_repeat(F.col("id"), 50).alias("v"))
    assert scaling.broadcast_if_small(wide)[1]
    assert not scaling.broadcast_if_small(wide, max_bytes=10_000)[1] and not scaling.broadcast_if_small(wide, max_rows=100)[1]
