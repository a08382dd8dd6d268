"""Cost, bottleneck and arrival fields, site costs, paths, corridors, frontiers and ladders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terravox.functions import geo
from terravox.operators import fields, profiles
from terravox.operators import route_sites as S
from terravox.operators import routing as R
from terravox.operators.scaling import broadcast_if_small
from terravox.plans import routing_sql as Q
from terravox.plans.registry import query
from terravox.plans.spatial_queries import all_places
from terravox.session import keep
from terravox.sources import tables as T

GRID = R.Grid(
    tuple(-90.0 + (j + 0.5) * T.DLAT for j in range(T.NLAT)),
    tuple(-180.0 + i * T.DLON for i in range(T.NLON)),
    tuple(k * T.DZ_KM for k in range(T.NZ)),
)
# Two configurations: the calibrated move set, and a wider reach with full lateral price.
CASES = [R.Case(0, 0.5, 2700.0, 300.0, 0.6, 2), R.Case(1, 0.8, 2300.0, 2100.0, 1.0, 1)]
K0 = [GRID.target_shell(c.z_target) for c in CASES]
SEED = GRID.seed_shell()
RADIUS = 2.0


def rows(spark, sf):
    return R.grid_rows(T.columns(spark, sf), ["model"], T.NLON)


def cost_fields(spark, sf, cases=CASES, **kw):
    return R.solve(spark, rows(spark, sf), ["model"], GRID, cases, **kw)


def unfolded(f):
    return f.select("model", "case", "k", "j", F.posexplode("row").alias("i", "c")).filter(F.col("c") != float("inf"))


def chain(case: R.Case, tag: str, kind="cost", ban=None) -> str:
    return Q.price_sql(tag, case.s, case.lateral) + ",\n" + Q.field_sql(tag, GRID.target_shell(case.z_target), case.s, case.lateral, GRID.sidesteps(case.h_max), kind, ban)


for _n, _c in enumerate(CASES):
    def _make(n, c):
        @query(f"g6_cost_field_{'calibrated' if n == 0 else 'wide_reach'}", "model:b,case:b,k:b,j:b,i:b,c:d", "G1,G2,G3,G4,G5,G6,G7,D5", f"""
WITH RECURSIVE {Q.base_sql(c.ncell)}, {chain(c, str(n))}
SELECT model, {n} AS "case", k, j, i, c FROM f{n} AS u""")
        def _(spark, sf):
            return unfolded(cost_fields(spark, sf, [c]))

    _make(_n, _c)


def small_layout(case: R.Case) -> R.Layout:
    """Rounds of four shells and bands of eight rows, as on a grid that no task could hold whole."""
    return R.Layout(4, 8, (GRID.sidesteps(case.h_max) + case.ncell) * 5, max(GRID.spans(T.NZ - 1)))


@query("g6_cost_field_in_bands", "model:b,case:b,k:b,j:b,i:b,c:d", "G6,D5", f"""
WITH RECURSIVE {Q.base_sql(CASES[1].ncell)}, {chain(CASES[1], '1')}
SELECT model, 1 AS "case", k, j, i, c FROM f1 AS u""")
def _(spark, sf):
    return unfolded(R.solve(spark, rows(spark, sf), ["model"], GRID, [CASES[1]], layout=small_layout(CASES[1])))


@query("g9_site_cost", "model:b,kind:s,site:b,cost:d,j:b,i:b", "G8,G9", f"""
WITH RECURSIVE {Q.base_sql(2)}, {T.SITES_SQL}, {chain(CASES[0], '0')}, {Q.caps_sql(RADIUS)},
best AS (SELECT m.model, cj0, cj1, ci, cw, min(c) AS cost, arg_min(f.j, c) AS j, arg_min(f.i, c) AS i FROM (SELECT DISTINCT model FROM cols) AS m CROSS JOIN capcells AS p LEFT JOIN f0 AS f ON f.model = m.model AND p.j = f.j AND p.i = f.i AND f.k = {SEED} GROUP BY m.model, cj0, cj1, ci, cw)
SELECT b.model, kind, site, b.cost, b.j, b.i FROM capped JOIN best AS b USING (cj0, cj1, ci, cw)""", every="kind")
def _(spark, sf):
    capped = S.caps(all_places(spark, sf), GRID, RADIUS)
    m = S.cap_minimum(cost_fields(spark, sf, CASES[:1]), capped, ["model"], GRID, unreached=True)
    side, _ = broadcast_if_small(capped.select("kind", "site", *S.CAP))
    return m.join(side, S.CAP)


@query("g17_bottleneck_field", "model:b,case:b,k:b,j:b,i:b,c:d", "G17", f"""
WITH RECURSIVE {Q.base_sql(2)}, {chain(CASES[0], '0', 'bottleneck')}
SELECT model, 0 AS "case", k, j, i, c FROM f0 AS u""")
def _(spark, sf):
    return unfolded(cost_fields(spark, sf, CASES[:1], kind="bottleneck"))


# ---- corridors ------------------------------------------------------------------------------------


def distinct_caps(spark, sf):
    """Distinct seed caps of the hotspots, numbered. The grid bounds how many there are
    (rows x columns x possible widths), so the list fits the driver whatever the number of sites."""
    capped = S.caps(T.places(T.hotspots(spark, sf)), GRID, RADIUS)
    caps = sorted(tuple(r) for r in capped.select(*S.CAP).distinct().collect())
    table = spark.createDataFrame([(n, *c) for n, c in enumerate(caps)], "cap int, cj0 int, cj1 int, ci int, cw int")
    cells = {n: (list(range(c[0], c[1] + 1)), [x % T.NLON for x in range(c[2] - c[3], c[2] + c[3] + 1)]) for n, c in enumerate(caps)}
    return capped, table, cells


def corridor_parts(spark, sf, case=CASES[0]):
    capped, table, cells = distinct_caps(spark, sf)
    cost = keep(cost_fields(spark, sf, [case]), "cost")
    units = [R.Case(n, case.s, case.z_target, case.h_max, case.lateral, case.ncell) for n in cells]
    # A model is copied only as far as models alone leave cores idle: once on large data.
    models = T.columns(spark, sf).select("model").distinct().count()
    spread = max(1, min(64, 2 * spark.sparkContext.defaultParallelism // max(1, models)))
    exc = S.excess(spark, rows(spark, sf), ["model"], GRID, units, cells, cost, "cap", spread)
    return table, cost, exc


CORR_CASE = R.Case(0, 0.5, 2400.0, 300.0, 0.6, 1)
CORR_K0 = GRID.target_shell(CORR_CASE.z_target)
CORR_SQL = f"""{Q.base_sql(1)}, {T.SITES_SQL}, {chain(CORR_CASE, '0')}, {Q.caps_sql(RADIUS)},
hot AS (SELECT DISTINCT cj0, cj1, ci, cw FROM capped WHERE kind = 'hotspot'),
num AS (SELECT *, row_number() OVER (ORDER BY cj0, cj1, ci, cw) - 1 AS cap FROM hot),
seeds AS (SELECT DISTINCT m.model, n.cap, c.j, c.i FROM num AS n JOIN capcells AS c USING (cj0, cj1, ci, cw), (SELECT DISTINCT model FROM cols) AS m),
{Q.arrival_sql('0', 'seeds', SEED, CORR_K0, CORR_CASE.s, CORR_CASE.lateral, GRID.sidesteps(CORR_CASE.h_max))},
tot AS MATERIALIZED (SELECT a.model, a.cap, a.k, a.j, a.i, a.c + f.c AS t FROM a0 AS a
  JOIN f0 AS f ON f.model = a.model AND f.k = a.k AND f.j = a.j AND f.i = a.i),
best AS (SELECT model, cap, min(t) AS c_best FROM tot GROUP BY model, cap)"""


@query("g12_excess_cost", "model:b,cap:b,k:b,shell_min:d,mean_excess:d,skipped:t,self_check:t", "G11,G12,G13,G14", f"""
WITH RECURSIVE {CORR_SQL}, site AS (SELECT f.model, n.cap, min(f.c) AS cost FROM f0 AS f JOIN capcells AS p ON p.j = f.j AND p.i = f.i AND f.k = {SEED} JOIN num AS n USING (cj0, cj1, ci, cw) GROUP BY f.model, n.cap)
SELECT t.model, t.cap, t.k, min(t - c_best) AS shell_min, avg(t - c_best) AS mean_excess, min(t) > min(c_best) + 1e-6 AS skipped,
  abs(min(c_best) - min(s.cost)) <= 1e-9 * min(s.cost) AS self_check
FROM tot AS t JOIN best USING (model, cap) JOIN site AS s ON s.model = t.model AND s.cap = t.cap GROUP BY t.model, t.cap, t.k""")
def _(spark, sf):
    table, cost, exc = corridor_parts(spark, sf, CORR_CASE)
    g = exc.select("model", "cap", "k", F.col("least").alias("shell_min"), (F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("mean_excess"), "c_best")
    site = S.cap_minimum(cost, table, ["model"], GRID).join(F.broadcast(table), S.CAP).select("model", "cap", "cost")
    j = g.filter(F.col("shell_min") != float("inf")).join(site, ["model", "cap"])
    ok = F.abs(F.col("c_best") - F.col("cost")) <= 1e-9 * F.col("cost")
    fail = F.raise_error(F.lit("forward and backward fields disagree")).cast("boolean")
    return j.withColumn("skipped", F.col("shell_min") > S.SKIP_TOL).withColumn("self_check", F.when(ok, ok).otherwise(fail))


@query("g16_corridor_widths", "model:b,cap:b,tau:d,c_best:d,cells:b,volume:d,shells:b,coverage:d,width_defined:t,width_med:d,width_max:d", "G16,F10,D10,J5", f"""
WITH RECURSIVE {CORR_SQL}, ar AS (SELECT j, 14.4 * pi() / 180 * 6371.0 * greatest(cos(radians(-85.5 + 9 * j)), 0.02::DOUBLE) * {Q.ROW_KM!r} AS area FROM (SELECT unnest(range({T.NLAT})) AS j)),
sh AS (SELECT t.model, t.cap, tau, t.k, count(*) AS cells, sum(area) AS area FROM tot AS t JOIN best USING (model, cap) JOIN ar USING (j), (VALUES (0.01), (0.02), (0.05)) AS v(tau)
  WHERE t - c_best <= tau::DOUBLE * c_best GROUP BY ALL),
g AS (SELECT model, cap, tau, sum(cells) AS cells, sum(area) * 45.0 / 1e9 AS volume, count(*) AS shells, count(*) / {CORR_K0 - SEED + 1}.0::DOUBLE AS coverage,
  median(2 * sqrt(area / pi())) AS wm, max(2 * sqrt(area / pi())) AS wx FROM sh GROUP BY ALL)
SELECT g.model, g.cap, tau, c_best, cells, volume, shells, coverage, coverage >= 0.5 AS width_defined, CASE WHEN coverage >= 0.5 THEN wm END AS width_med,
  CASE WHEN coverage >= 0.5 THEN wx END AS width_max FROM g JOIN best USING (model, cap)""")
def _(spark, sf):
    _, _, exc = corridor_parts(spark, sf, CORR_CASE)
    return S.corridor_summary(S.corridor_rows(exc, ["model"], "cap"), ["model"], "cap", GRID, SEED, CORR_K0)
