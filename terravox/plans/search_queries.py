"""Paths, frontiers, ladders, second routes and calibrated classification on searched fields."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from terravox.functions import geo
from terravox.operators import calibration as C
from terravox.operators import injection as I
from terravox.operators import profiles
from terravox.operators import route_sites as S
from terravox.operators import routing as R
from terravox.operators import second_roots as Z
from terravox.operators import shapes
from terravox.operators import sweep as W
from terravox.operators.scaling import broadcast_if_small, shuffled_join
from terravox.plans import routing_sql as Q
from terravox.plans.registry import query
from terravox.plans.routing_queries import CASES, GRID, RADIUS, SEED, chain, cost_fields, rows
from terravox.plans.spatial_queries import all_places
from terravox.session import keep
from terravox.plans.topology_queries import weights_sql
from terravox.sources import tables as T

BASE = f"{Q.base_sql(2)}, {T.SITES_SQL}"


def traced(spark, sf, cases=CASES[:1], staged=True, fields=None, radius=RADIUS):
    """Paths from the seed cap of every place: nodes per (model, case, cap number)."""
    capped = S.caps(all_places(spark, sf), GRID, radius)
    f = keep(cost_fields(spark, sf, cases), "cost") if fields is None else fields
    starts = S.cap_minimum(f, capped, ["model"], GRID)
    # A cap is numbered by arithmetic on its parts, so equal caps share one path.
    starts = starts.withColumn("site", S.cap_number())
    starts = keep(starts, "starts")
    return starts, keep(R.paths(spark, rows(spark, sf), f, starts, ["model"], GRID, cases, staged=staged), "paths")


def priced(spark, sf, nodes, case: R.Case):
    """Each step of a path with its length, mean anomaly and price, from the field itself.

    The cells a step crosses meet the map columns by an equi join; a column brings its whole depth
    array, so a step asks at most three of them.
    """
    from terravox.operators.scaling import Ordered

    from pyspark.sql import Window

    # A path has at most as many nodes as shells times sidesteps, so its window is bounded.
    w = Window.partitionBy("model", "case", "site").orderBy("n")
    s = nodes.select("*", *[F.lead(c).over(w).alias(c + "2") for c in ("k", "j", "i")]).filter("k2 IS NOT NULL")
    di = F.pmod(F.col("i2") - F.col("i") + T.NLON // 2, F.lit(T.NLON)) - T.NLON // 2
    s = s.withColumn("dj", F.col("j2") - F.col("j")).withColumn("di", di)
    s = s.withColumn("cells", F.greatest(F.abs("dj"), F.abs("di")))
    s = s.withColumn("t", F.explode(F.sequence(F.lit(0), F.when(F.col("k2") > F.col("k"), F.col("cells")).otherwise(0))))
    s = s.withColumn("cj", F.col("j") + F.signum("dj").cast("int") * F.col("t")).withColumn("cx", F.pmod(F.col("i") + F.signum("di").cast("int") * F.col("t"), F.lit(T.NLON)))
    cols = T.columns(spark, sf).select("model", F.col("j").alias("cj"), F.col("i").alias("cx"), F.transform("v", lambda x: F.greatest(F.lit(-R.CLIP), F.least(F.lit(R.CLIP), x))).alias("v"))
    m = shuffled_join(s, cols, ["model", "cj", "cx"])
    part = F.slice("v", F.col("k") + 1, F.col("k2") - F.col("k") + 1)
    m = m.withColumn("a", F.aggregate(part, F.lit(0.0), lambda x, y: x + y) / F.size(part))
    g = m.groupBy("model", "case", "site", "n", "k", "j", "i", "k2", "j2", "i2", "dj", "cells").agg(F.avg("a").alias("a"))
    width = F.element_at(F.array(*[F.lit(float(x)) for x in GRID.col_km(slice(None))]), F.col("j") + 1)
    side = case.lateral * F.col("cells") * F.when(F.col("dj") != 0, F.lit(GRID.row_km)).otherwise(width)
    length = F.sqrt(F.pow((F.col("k2") - F.col("k")) * T.DZ_KM, F.lit(2.0)) + side * side)
    return g.withColumn("length", length).withColumn("price", geo.step_price(F.col("length"), F.col("a"), case.s))


BEST_SQL = f"best AS (SELECT f.model, cj0, cj1, ci, cw, min(c) AS cost, arg_min(f.j, c) AS j, arg_min(f.i, c) AS i FROM f0 AS f JOIN capcells AS p ON p.j = f.j AND p.i = f.i AND f.k = {SEED} GROUP BY ALL)"


@query("g10_path_price", "model:b,site:b,price:d,start_j:b,start_i:b,reached:t", "G10,F14,S7", f"""
WITH RECURSIVE {BASE}, {chain(CASES[0], '0')}, {Q.caps_sql(RADIUS)}, {BEST_SQL}
SELECT model, ((cj0::BIGINT * 32768 + cj1) * 32768 + ci) * 32768 + cw AS site, cost AS price, j AS start_j, i AS start_i, true AS reached FROM best""")
def _(spark, sf):
    starts, nodes = traced(spark, sf)
    p = priced(spark, sf, nodes, CASES[0])
    k0 = GRID.target_shell(CASES[0].z_target)
    g = p.groupBy("model", "site").agg(F.sum("price").alias("price"), (F.max("k2") == k0).alias("reached"),
                                       F.min(F.struct("n", F.col("j").alias("start_j"), F.col("i").alias("start_i"))).alias("s"))
    return g.select("model", "site", "price", "reached", "s.start_j", "s.start_i")


@query("g10_trace_nodes", "model:b,site:b,n:b,depth_km:d,lat:d,lon:d", "G10,D9")
def _(spark, sf):
    _, nodes = traced(spark, sf)
    return nodes.select("model", "site", "n", (F.col("k") * T.DZ_KM).alias("depth_km"), (F.lit(-90.0) + (F.col("j") + 0.5) * T.DLAT).alias("lat"), (F.lit(-180.0) + F.col("i") * T.DLON).alias("lon"))


@query("g15_step_counting_trace", "model:b,site:b,nodes:b,end_k:b,price:d", "G15")
def _(spark, sf):
    wide = [R.Case(0, 0.5, 2700.0, 2100.0, 0.6, 1)]
    _, nodes = traced(spark, sf, wide, staged=False)
    p = priced(spark, sf, nodes, wide[0])
    return p.groupBy("model", "site").agg((F.count("*") + 1).alias("nodes"), F.max("k2").alias("end_k"), F.sum("price").alias("price"))


@query("g18_accepted_worst_point", "model:b,site:b,accepted:d,achievable:d,penalty:d,n:b,n_gap:b,mean:d", "G18,G17")
def _(spark, sf):
    # The worst material on the cheapest route against the best worst point any route can have.
    starts, nodes = traced(spark, sf)
    capped = S.caps(all_places(spark, sf), GRID, RADIUS)
    ach = S.cap_minimum(cost_fields(spark, sf, CASES[:1], kind="bottleneck"), capped, ["model"], GRID)
    ach = ach.select("model", S.cap_number().alias("site"), F.col("cost").alias("achievable"))
    cols = T.columns(spark, sf).select("model", "j", "i", "v")
    v = nodes.join(cols, ["model", "j", "i"]).select("model", "site", F.greatest(F.lit(-R.CLIP), F.least(F.lit(R.CLIP), F.col("v")[F.col("k")])).alias("a"))
    g = v.groupBy("model", "site").agg(F.max("a").alias("accepted"), F.count("*").alias("n"), F.count_if(F.col("a") > -0.10).alias("n_gap"), F.avg("a").alias("mean"))
    return g.join(ach, ["model", "site"]).withColumn("penalty", F.col("accepted") - F.col("achievable"))


@query("g20_competing_route", "model:b,site:b,cost:d,alt_reached:t,alt_cost:d,margin_pct:d,charged_km:d,alt_charged_km:d,needs_slower_pct:d,is_slower_pct:d,separation_km:d,split_depth_km:d", "G20,P12,F14,F15,J15")
def _(spark, sf):
    """Forbid a disc around the root of each cheapest path and search again.

    Paths that end in the same cell share the forbidden disc, so there is one second search per
    distinct root, not per site; a root is a cell, so the grid bounds how many there are.
    """
    case = CASES[0]
    starts, nodes = traced(spark, sf)
    p = priced(spark, sf, nodes, case)
    tot = lambda q: q.groupBy("model", "site").agg(F.sum("price").alias("cost"), F.sum("length").alias("charged_km"), (F.sum(F.col("a") * F.col("length")) / F.sum("length")).alias("mean_a"),
                                                   F.max(F.struct("k2", "n", "j2", "i2")).alias("e"))
    first = tot(p).select("model", "site", "cost", "charged_km", "mean_a", F.col("e.j2").alias("ej"), F.col("e.i2").alias("ei"))
    first = keep(first, "first-routes")
    lat = lambda j: F.lit(-90.0) + (j + 0.5) * T.DLAT
    lon = lambda i: F.lit(-180.0) + i * T.DLON
    begin = shuffled_join(first, starts.select("model", "site", *S.CAP), ["model", "site"]).select("model", "site", *S.CAP, F.col("ej").alias("root_j"), F.col("ei").alias("root_i"))
    n2 = keep(Z.second_routes(rows(spark, sf), ["model"], GRID, case, begin, 500.0, 1500.0), "second-paths")
    second = tot(priced(spark, sf, n2, case)).select("model", "site", F.col("cost").alias("alt_cost"), F.col("charged_km").alias("alt_charged_km"), F.col("mean_a").alias("alt_mean_a"), F.col("e.j2").alias("ej2"), F.col("e.i2").alias("ei2"))
    # Where the two part company: both at every shell (last node at or above), first gap over 300 km.
    def at_shells(x):
        from pyspark.sql import Window
        w = Window.partitionBy("model", "site").orderBy("n")
        x = x.withColumn("kn", F.coalesce(F.lead("k").over(w), F.col("k") + 1)).filter("kn > k")
        return x.select("model", "site", "j", "i", F.explode(F.sequence(F.col("k"), F.col("kn") - 1)).alias("k"))
    a, b = at_shells(nodes), at_shells(n2).select("model", "site", "k", F.col("j").alias("j2"), F.col("i").alias("i2"))
    sep = shuffled_join(a, b, ["model", "site", "k"]).withColumn("sep", geo.arc_km(lat(F.col("j")), lon(F.col("i")), lat(F.col("j2")), lon(F.col("i2"))))
    split = sep.groupBy("model", "site").agg(F.min(F.when(F.col("sep") > 300, F.col("k") * T.DZ_KM)).alias("split_depth_km"))
    # A site that the ban cuts off keeps its row, without figures of a second route.
    j = shuffled_join(shuffled_join(first, second.withColumn("_alt", F.lit(True)), ["model", "site"], "left"), split, ["model", "site"], "left")
    return j.select("model", "site", "cost", F.coalesce("_alt", F.lit(False)).alias("alt_reached"), "alt_cost", (100 * (F.col("alt_cost") / F.col("cost") - 1)).alias("margin_pct"), "charged_km", "alt_charged_km",
                    (F.ln(F.col("alt_charged_km") / F.col("charged_km")) / case.s).alias("needs_slower_pct"), (F.col("mean_a") - F.col("alt_mean_a")).alias("is_slower_pct"),
                    geo.arc_km(lat(F.col("ej")), lon(F.col("ei")), lat(F.col("ej2")), lon(F.col("ei2"))).alias("separation_km"), "split_depth_km")


LEVELS = [35, 75, 100]
LEVEL_SQL = ", ".join(
    f"z{p} AS MATERIALIZED (SELECT a.model, a.k, a.j, a.i FROM ac AS a JOIN (SELECT model, k, quantile_cont(a, {p / 100}) AS cut FROM ac GROUP BY model, k) AS q ON q.model = a.model AND q.k = a.k WHERE a.a > cut)" for p in LEVELS)


@query("g19_frontier", "model:b,level:b,site:b,cost:d", "G19,P10", f"""
WITH RECURSIVE {BASE}, {Q.price_sql('0', CASES[0].s, CASES[0].lateral)}, {LEVEL_SQL},
{', '.join(f"p{p} AS (SELECT * FROM p0), " + Q.field_sql(str(p), GRID.target_shell(CASES[0].z_target), CASES[0].s, CASES[0].lateral, 1, 'cost', f'z{p}') for p in LEVELS)},
{Q.caps_sql(RADIUS)}, f AS ({' UNION ALL '.join(f'SELECT *, {p} AS level FROM f{p} WHERE k = {SEED}' for p in LEVELS)})
SELECT m.model, l.level, ((cj0::BIGINT * 32768 + cj1) * 32768 + ci) * 32768 + cw AS site, min(c) AS cost FROM (SELECT DISTINCT model FROM cols) AS m CROSS JOIN (SELECT unnest([35, 75, 100]) AS level) AS l CROSS JOIN capcells AS p LEFT JOIN f ON f.model = m.model AND f.level = l.level AND p.j = f.j AND p.i = f.i GROUP BY m.model, l.level, cj0, cj1, ci, cw""")
def _(spark, sf):
    base = rows(spark, sf)
    clipped = T.columns(spark, sf).withColumn("v", F.transform("v", lambda x: F.greatest(F.lit(-R.CLIP), F.least(F.lit(R.CLIP), x))))
    cut = clipped.groupBy("model").agg(*[F.percentile(F.col("v")[k], F.array(*[F.lit(p / 100) for p in LEVELS])).alias(f"q{k}") for k in range(T.NZ)])
    cut = cut.select("model", F.array(*[f"q{k}" for k in range(T.NZ)]).alias("cut"))
    # The level is part of the field key: one search over all levels.
    lv = F.explode(F.array(*[F.struct(F.lit(p).alias("level"), F.lit(n).alias("at")) for n, p in enumerate(LEVELS)]))
    keyed = base.join(cut, "model").select("model", lv.alias("l"), "j", "k", "row", "cut")
    keyed = keyed.select("model", "l.level", "j", "k", "row", F.col("cut")[F.col("k")][F.col("l.at")].alias("q"))
    ban = F.transform("row", lambda x: (F.greatest(F.lit(-R.CLIP), F.least(F.lit(R.CLIP), x)) > F.col("q")).cast("double"))
    f = R.solve(spark, keyed, ["model", "level"], GRID, CASES[:1], bans=keyed.withColumn("row", ban))
    m = S.cap_minimum(f, S.caps(all_places(spark, sf), GRID, RADIUS), ["model", "level"], GRID, unreached=True)
    return m.select("model", "level", S.cap_number().alias("site"), "cost")


# ---- site costs against the null, over configurations ----------------------------------------------


def site_costs(spark, sf, cases, radii, fields=None):
    """Cost of every place per configuration; the field is searched once and shared by the radii."""
    f = keep(cost_fields(spark, sf, cases), "cost") if fields is None else fields
    out = None
    for r in radii:
        capped = S.caps(all_places(spark, sf), GRID, r)
        side, _ = broadcast_if_small(capped.select("kind", "site", "n_sites", *S.CAP))
        m = S.cap_minimum(f, capped, ["model"], GRID).join(side, S.CAP).withColumn("radius", F.lit(r))
        m = m.select("model", "case", "radius", "kind", "site", "n_sites", "cost")
        out = m if out is None else out.unionByName(m)
    return keep(out, "site-costs")


def null_threshold(costs):
    """Low percentile of the null costs, each place counted once per site on it. A group holds one
    row per null place, at most 3,600."""
    return costs.filter("kind = 'null'").groupBy("model", "case", "radius").agg(F.percentile("cost", F.lit(C.NULL_PCT / 100), F.col("n_sites")).alias("threshold"))


TARGETS = [400.0, 800.0, 1200.0, 1600.0, 2000.0, 2400.0, 2800.0]
LADDER_CASES = [R.Case(n, 0.5, z, 300.0, 0.6, 2) for n, z in enumerate(TARGETS)]


def costs_sql(cases, radii) -> str:
    """sc (model, case, radius, kind, site, n_sites, cost) and th (model, case, radius, threshold)."""
    prices, fields = {}, []
    for c in cases:
        prices.setdefault((c.s, c.lateral), f"{c.case}")
    text = [Q.price_sql(t, s, lat) for (s, lat), t in prices.items()]
    for c in cases:
        t = prices[(c.s, c.lateral)]
        if t != str(c.case):
            text.append(f"p{c.case} AS (SELECT * FROM p{t})")
        text.append(Q.field_sql(str(c.case), GRID.target_shell(c.z_target), c.s, c.lateral, GRID.sidesteps(c.h_max)))
    f = " UNION ALL ".join(f'SELECT *, {c.case} AS "case" FROM f{c.case} WHERE k = {SEED}' for c in cases)
    caps = []
    for n, r in enumerate(radii):
        caps.append(Q.caps_sql(r).replace("capped AS", f"capped{n} AS").replace("FROM capped,", f"FROM capped{n},").replace("capcells AS", f"capcells{n} AS"))
    sc = " UNION ALL ".join(
        f"""SELECT f.model, f."case", {r} AS radius, q.kind, q.site, q.n_sites, min(c) AS cost FROM fa AS f JOIN capcells{n} AS p ON p.j = f.j AND p.i = f.i
    JOIN capped{n} AS q USING (cj0, cj1, ci, cw) GROUP BY ALL""" for n, r in enumerate(radii))
    return f"""{', '.join(text)}, fa AS MATERIALIZED ({f}), {', '.join(caps)}, sc AS MATERIALIZED ({sc}),
th AS (SELECT model, "case", radius, quantile_cont(cost, {C.NULL_PCT / 100}) AS threshold FROM sc, LATERAL (SELECT unnest(range(n_sites)) AS rep) AS z WHERE kind = 'null' GROUP BY ALL)"""


@query("g21_depth_ladder_search", "model:b,site:b,base_connected_from_km:d,deepest_km:d,n_levels:b,pattern:s,percentile_2800:d", "G21,W8,W9,A6,C2", f"""
WITH RECURSIVE {BASE}, {costs_sql(LADDER_CASES, [RADIUS])},
h AS (SELECT s.model, s.site, s."case" AS c, 400.0 * (s."case" + 1) AS z, cost < threshold AS ok, cost FROM sc AS s JOIN th USING (model, "case", radius) WHERE kind = 'hotspot'),
t AS (SELECT *, min(ok::INT) OVER (PARTITION BY model, site ORDER BY c DESC ROWS UNBOUNDED PRECEDING) AS tail FROM h),
pc AS (SELECT a.model, a.site, 100.0 * coalesce(sum(b.n_sites) FILTER (WHERE b.cost < a.cost), 0) / sum(b.n_sites) AS p FROM sc AS a JOIN sc AS b ON b.model = a.model AND b."case" = 6 AND b.kind = 'null' WHERE a."case" = 6 AND a.kind = 'hotspot' GROUP BY a.model, a.site)
SELECT t.model, t.site, min(CASE WHEN tail = 1 THEN z END) AS base_connected_from_km, coalesce(max(CASE WHEN ok THEN z END), 0) AS deepest_km, sum(ok::INT) AS n_levels,
  string_agg(CASE WHEN ok THEN '1' ELSE '0' END, '' ORDER BY c) AS pattern, max(pc.p) AS percentile_2800 FROM t JOIN pc USING (model, site) GROUP BY t.model, t.site""", every="hotspot")
def _(spark, sf):
    from pyspark.sql import Window

    costs = site_costs(spark, sf, LADDER_CASES, [RADIUS])
    th = null_threshold(costs)
    n = len(TARGETS)
    h = costs.join(th, ["model", "case", "radius"])
    # Ranking inside a model and configuration: at most 3,600 places per kind.
    w = Window.partitionBy("model", "case")
    weight = F.when(F.col("kind") == "null", F.col("n_sites")).otherwise(0)
    below = F.sum(weight).over(w.orderBy("cost").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum(weight).over(Window.partitionBy("model", "case", "cost"))
    h = h.withColumn("pct", 100.0 * below / F.sum(weight).over(w)).filter("kind = 'hotspot'").withColumn("ok", F.col("cost") < F.col("threshold"))
    g = h.groupBy("model", "site").agg(*[F.bool_or(F.when(F.col("case") == c, F.col("ok"))).alias(f"o{c}") for c in range(n)], F.max(F.when(F.col("case") == n - 1, F.col("pct"))).alias("percentile_2800"))
    g = g.withColumn("on", F.array(*[F.coalesce(F.col(f"o{c}"), F.lit(False)) for c in range(n)]))
    z = F.array(*[F.lit(t) for t in TARGETS])
    tail = profiles.leading_run(F.reverse("on"))
    return g.select("model", "site", F.when(tail > 0, F.element_at(z, n + 1 - F.greatest(tail, F.lit(1)))).alias("base_connected_from_km"),
                    F.coalesce(F.array_max(F.zip_with("on", z, lambda o, d: F.when(o, d))), F.lit(0.0)).alias("deepest_km"), F.size(F.filter("on", lambda x: x)).alias("n_levels"),
                    F.array_join(F.transform("on", lambda x: x.cast("int").cast("string")), "").alias("pattern"), "percentile_2800")


FIELDS = W.configurations(GRID)
# The calibrated move set.
LATERAL, NCELL = 0.6, 2


def sweep_sql() -> str:
    """sc and th over all configurations, the fields of one target at a time.

    A channel and an exponent s make a model of their own, whose anomaly is s times the channel: prices
    are exponentials of s times a mean, so every field of a target is one recursion with s = 1.
    """
    sj = W.BACKGROUND_KM / (T.DLAT * math.pi / 180 * 6371.0)
    si = f"least({W.BACKGROUND_KM} / ({T.DLON}::DOUBLE * pi() / 180 * 6371.0 * greatest(cos(radians(-85.5 + 9 * j)), 0.02::DOUBLE)), {T.NLON} / 6.0::DOUBLE)"
    kinds = [(c, x) for c in W.CHANNELS for x in W.S_VALUES]
    value = {"anom": "anom", "contrast": "anom - background", "min": "least(anom, anom - background)"}
    number = {kind: n for n, kind in enumerate(kinds)}
    scaled = " UNION ALL ".join(f"SELECT model * {len(kinds)} + {number[c, x]} AS model, k, j, i, {x}::DOUBLE * greatest(-6.0::DOUBLE, least(6.0::DOUBLE, {value[c]})) AS a, colkm FROM chan" for c, x in kinds)
    base = Q.base_sql(NCELL)
    start, end = base.index("ac AS MATERIALIZED"), base.index("step4(dj, di)")
    base = base[:start] + f"""{weights_sql('wj', 'j', f'{sj!r}::DOUBLE')}, {weights_sql('wi', 'j', si)},
down AS MATERIALIZED (SELECT model, wj.j, i, k, sum(w * anom) AS a FROM wj JOIN cells AS c ON c.j = least({T.NLAT - 1}, greatest(0, wj.j + o)) GROUP BY ALL),
bg AS MATERIALIZED (SELECT p.model, p.k, p.j, (p.i - wi.o + 50) % {T.NLON} AS i, sum(w * a) AS background FROM down AS p JOIN wi ON wi.j = p.j GROUP BY ALL),
chan AS MATERIALIZED (SELECT c.model, c.k, c.j, c.i, anom, background, {T.DLON} * pi() / 180 * 6371.0 * greatest(cos(radians(lat)), 0.02::DOUBLE) AS colkm FROM cells AS c JOIN bg USING (model, k, j, i)),
ac AS MATERIALIZED ({scaled}),
""" + base[end:]
    depths = sorted({(GRID.target_shell(c.z_target), GRID.sidesteps(c.h_max)) for c in FIELDS})
    text = [base, T.SITES_SQL, Q.price_sql("0", 1.0, LATERAL)]
    for n, (k0, steps) in enumerate(depths):
        text.append((f"p{n} AS (SELECT * FROM p0), " if n else "") + Q.field_sql(str(n), k0, 1.0, LATERAL, steps))
    of = {(c.case): (depths.index((GRID.target_shell(c.z_target), GRID.sidesteps(c.h_max))), number[c.channel, c.s]) for c in FIELDS}
    listed = ", ".join(f"({c}, {d}, {n})" for c, (d, n) in of.items())
    top = " UNION ALL ".join(f"SELECT model, {n} AS depth, j, i, c FROM f{n} WHERE k = {SEED}" for n in range(len(depths)))
    caps = [Q.caps_sql(r).replace("capped AS", f"capped{n} AS").replace("FROM capped,", f"FROM capped{n},").replace("capcells AS", f"capcells{n} AS") for n, r in enumerate(W.RADII)]
    best = " UNION ALL ".join(f"SELECT model, depth, {r} AS radius, cj0, cj1, ci, cw, min(c) AS cost FROM tops AS f JOIN capcells{n} AS p ON p.j = f.j AND p.i = f.i GROUP BY ALL" for n, r in enumerate(W.RADII))
    placed = " UNION ALL ".join(f"SELECT {r} AS radius, kind, site, n_sites, cj0, cj1, ci, cw FROM capped{n}" for n, r in enumerate(W.RADII))
    return f"""{', '.join(text)}, tops AS MATERIALIZED ({top}), {', '.join(caps)}, best AS MATERIALIZED ({best}), placed AS MATERIALIZED ({placed}),
listed("case", depth, number) AS (VALUES {listed}),
sc AS MATERIALIZED (SELECT b.model // {len(kinds)} AS model, l."case", p.radius, p.kind, p.site, p.n_sites, b.cost FROM best AS b JOIN listed AS l ON l.depth = b.depth AND l.number = b.model % {len(kinds)} JOIN placed AS p USING (radius, cj0, cj1, ci, cw)),
th AS (SELECT model, "case", radius, quantile_cont(cost, {C.NULL_PCT / 100}) AS threshold FROM sc, LATERAL (SELECT unnest(range(n_sites)) AS rep) AS z WHERE kind = 'null' GROUP BY ALL)"""


CLASS_SQL = """SELECT *, CASE WHEN root_fraction >= 0.8 THEN 'deeper than null' WHEN root_fraction <= 0.2 THEN 'not deeper than null' ELSE 'ambiguous' END AS ensemble_class FROM e"""


def seated(spark, sf, radii):
    """Every place with its seed cap at each radius, in a column of its own each. Places that have all of these
    in common have all costs in common: such a seat is the unit of the sweep."""
    places = all_places(spark, sf)
    for n, r in enumerate(radii):
        capped = S.caps(places, GRID, r)
        places = capped.withColumn(f"seat{n}", F.struct(*S.CAP)).drop(*S.CAP)
    return keep(places, "seated")


def seat_costs(spark, f, places, radii):
    """Cost of every seat per configuration, with the null sites on it and whether a hotspot is there."""
    seat = [f"seat{n}" for n in range(len(radii))]
    null = F.sum(F.when(F.col("kind") == "null", F.col("n_sites")).otherwise(0)).alias("nulls")
    seats = places.groupBy(*seat).agg(null, F.bool_or(F.col("kind") == "hotspot").alias("hot"))
    side, _ = broadcast_if_small(seats)
    out = None
    for n, r in enumerate(radii):
        m = S.cap_minimum(f, places.select(f"{seat[n]}.*").distinct(), ["model"], GRID)
        m = m.select("model", "case", F.lit(r).alias("radius"), "cost", F.struct(*S.CAP).alias(seat[n])).join(side, seat[n])
        m = m.select("model", "case", "radius", *seat, "nulls", "hot", "cost")
        out = m if out is None else out.unionByName(m)
    return keep(out, "seat-costs")


def seat_threshold(costs):
    """``null_threshold`` over seats: each counts once per null site on it."""
    w = costs.filter("nulls > 0").groupBy("model", "case", "radius")
    return keep(w.agg(F.percentile("cost", F.lit(C.NULL_PCT / 100), F.col("nulls")).alias("threshold")), "thresholds")


def ensemble(costs, th, places):
    """Share of configurations in which a site is rooted, its middle cost and its class."""
    seat = [c for c in costs.columns if c.startswith("seat")]
    h = costs.filter("hot").join(th, ["model", "case", "radius"])
    g = h.groupBy("model", *seat).agg(F.avg((F.col("cost") < F.col("threshold")).cast("double")).alias("root_fraction"), F.median("cost").alias("cost_median"), F.count("*").alias("n_ensemble"))
    side, _ = broadcast_if_small(places.filter("kind = 'hotspot'").select("site", *seat))
    return g.withColumn("ensemble_class", C.ensemble_class(F.col("root_fraction"))).join(side, seat).drop(*seat)


def observed_sweep(spark, sf):
    """Seed shells of all fields, the places with their seats, the seat costs of all configurations, and their thresholds."""
    f = keep(W.observed(rows(spark, sf), ["model"], GRID, FIELDS, LATERAL, NCELL), "sweep")
    places = seated(spark, sf, W.RADII)
    costs = seat_costs(spark, f, places, W.RADII)
    return f, places, costs, seat_threshold(costs)


@query("c5_ensemble_class", "model:b,site:b,root_fraction:d,cost_median:d,ensemble_class:s,n_ensemble:b", "C1,C2,C5,A4,P15,J21", f"""
WITH RECURSIVE {sweep_sql()},
e AS (SELECT s.model, s.site, avg((cost < threshold)::INT) AS root_fraction, median(cost) AS cost_median, count(*) AS n_ensemble FROM sc AS s JOIN th USING (model, "case", radius) WHERE kind = 'hotspot' GROUP BY s.model, s.site)
{CLASS_SQL}""", every="hotspot")
def _(spark, sf):
    _, places, costs, th = observed_sweep(spark, sf)
    return ensemble(costs, th, places)


# Fixed values of the injection sweep: sites (lat, lon), amplitudes, and (tilt, profile) pairs.
INJECT_SITES = [(20.0, -156.0), (-25.0, -165.0), (-21.0, 56.0), (35.0, -40.0)]
AMPS = [-0.5, -0.75, -1.0, -1.5]
GEOMETRY = [(0.0, "vertical"), (10.0, "transition"), (10.0, "uniform")]
# The fixture grid is coarse (1,000 km rows), so the injected radius spans two cells there.
FIXTURE_RADIUS = 1500.0
INJECTIONS = [dict(variant=n, ilat=la, ilon=lo, amp=a, tilt=t, profile=p, at=s) for n, (s, (la, lo), a, (t, p)) in enumerate((s, site, a, g) for s, site in enumerate(INJECT_SITES) for a in AMPS for g in GEOMETRY)]


def _row_share() -> dict[int, range]:
    """Grid rows of the seed caps of each injection's site, for the widest radius."""
    reach = max(max(1, round(r / abs(T.DLAT))) for r in W.RADII)
    at = {n: int(np.argmin(np.abs(np.array(GRID.lat) - la))) for n, (la, _) in enumerate(INJECT_SITES)}
    return {r["variant"]: range(max(0, at[r["at"]] - reach - 1), min(T.NLAT, at[r["at"]] + reach + 2)) for r in INJECTIONS}


@query("g39_injection", "model:b,variant:b,k:b,anom_min:d,anom_sum:d,added_sum:d", "G39,F13,G41", f"""
WITH {T.CELLS_SQL}, s(at_, ilat, ilon) AS (VALUES {', '.join(f'({n}, {a}::DOUBLE, {b}::DOUBLE)' for n, (a, b) in enumerate(INJECT_SITES))}),
q(variant, at_, amp, tilt, profile) AS (VALUES {', '.join(f"({r['variant']}, {r['at']}, {r['amp']}::DOUBLE, {r['tilt']}::DOUBLE, '{r['profile']}')" for r in INJECTIONS)}),
z AS (SELECT k, k * 45.0::DOUBLE AS z FROM (SELECT unnest(range(64)) AS k)),
l AS (SELECT q.*, s.ilat, s.ilon, k, z, tilt * CASE WHEN profile = 'uniform' THEN (z - 100) / 2700 WHEN z <= 410 THEN 0.15 * (z - 100) / 310 WHEN z <= 660 THEN 0.15 + 0.5 * (z - 410) / 250 ELSE 0.65 + 0.35 * (z - 660) / 2140 END AS off
      FROM q JOIN s USING (at_), z WHERE z >= 100 AND z <= 2800),
c AS (SELECT *, ilat + off * cos(radians(45)) AS clat FROM l),
c2 AS (SELECT *, ilon + off * sin(radians(45)) / greatest(cos(radians(clat)), 0.2::DOUBLE) AS clon, CASE WHEN z < 2600 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, (2800 - z) / 200) END AS taper FROM c),
d AS (SELECT model, variant, k, j, i, amp * taper * exp(-pow({T.arc_sql('clat', 'clon', 'lat', 'lon')} / 750.0, 2) / 2) AS v FROM cols, c2)
SELECT m.model, q.variant, m.k, min(m.anom + coalesce(v, 0)) AS anom_min, sum(m.anom + coalesce(v, 0)) AS anom_sum, coalesce(sum(v), 0) AS added_sum
FROM cells AS m CROSS JOIN q LEFT JOIN d ON d.model = m.model AND d.variant = q.variant AND d.k = m.k AND d.j = m.j AND d.i = m.i GROUP BY m.model, q.variant, m.k""")
def _(spark, sf):
    return W.patched_shells(rows(spark, sf), ["model"], GRID, INJECTIONS, FIXTURE_RADIUS)


# The named shapes at one site, each as strong as the calibration asks.
NAMED = [dict(variant=n, shape=name, ilat=INJECT_SITES[0][0], ilon=INJECT_SITES[0][1], amp=C.CAL_AMP) for n, name in enumerate(shapes.shapes(FIXTURE_RADIUS))]
SHAPE_AXES = ", ".join(f"({r['variant']}, {limb}, {k}, {la!r}::DOUBLE, {lo!r}::DOUBLE, {rad!r}::DOUBLE, {C.CAL_AMP * st!r}::DOUBLE)" for r in NAMED for limb, k, la, lo, rad, st in shapes.axes(r["shape"], GRID.depth, r["ilat"], r["ilon"], FIXTURE_RADIUS))


@query("g40_named_shapes", "model:b,shape:s,k:b,anom_min:d,anom_sum:d,added_sum:d", "G40,G41", f"""
WITH {T.CELLS_SQL}, x(variant, limb, k, la, lo, r, amp) AS (VALUES {SHAPE_AXES}), n(variant, shape) AS (VALUES {', '.join(f"({r['variant']}, '{r['shape']}')" for r in NAMED)}),
l AS (SELECT model, variant, k, j, i, min(amp * exp(-pow({T.arc_sql('la', 'lo', 'lat', 'lon')} / (r / 2), 2) / 2)) AS v FROM cols, x GROUP BY ALL)
SELECT m.model, n.shape, m.k, min(anom + coalesce(v, 0)) AS anom_min, sum(anom + coalesce(v, 0)) AS anom_sum, coalesce(sum(v), 0) AS added_sum
FROM cells AS m CROSS JOIN n LEFT JOIN l ON l.model = m.model AND l.variant = n.variant AND l.k = m.k AND l.j = m.j AND l.i = m.i GROUP BY m.model, n.shape, m.k""")
def _(spark, sf):
    d = W.patched_shells(rows(spark, sf), ["model"], GRID, NAMED, FIXTURE_RADIUS)
    return d.withColumn("shape", F.create_map(*[F.lit(x) for r in NAMED for x in (r["variant"], r["shape"])])[F.col("variant")])


def trials(spark, sf, observed, th):
    """Hit, miss or uninformative for every (model, configuration, injection)."""
    f = keep(W.injected(rows(spark, sf), ["model"], GRID, FIELDS, INJECTIONS, _row_share(), LATERAL, NCELL, FIXTURE_RADIUS), "injected-sweep")
    at = [(n, la, lo) for n, (la, lo) in enumerate(INJECT_SITES)]
    site_of = F.create_map(*[F.lit(x) for r in INJECTIONS for x in (r["variant"], r["at"])])
    out = None
    for r in W.RADII:
        capped = S.caps(spark.createDataFrame(at, "at int, lat double, lon double"), GRID, r)
        # Four literal sites: the columns of each cap, per grid row.
        cells = F.broadcast(S.cap_cells(capped.select("at", *S.CAP), T.NLON).groupBy("at", "j").agg(F.collect_set(F.col("i").cast("int")).alias("ii")))

        def seed_cost(fields, keys, asked=F.lit(True)):
            # The least of a cap's cells is taken inside the grid row: cells are not unfolded.
            s = fields.join(cells, "j").filter(asked).select(*keys, "case", "at", F.array_min(F.transform("ii", lambda i: F.col("row")[i])).alias("c"))
            return s.groupBy(*keys, "case", "at").agg(F.min("c").alias("cost"))

        pre = seed_cost(observed, ["model"]).withColumnRenamed("cost", "pre")
        post = seed_cost(f, ["model", "variant"], F.col("at") == site_of[F.col("variant")])
        t = post.join(pre, ["model", "case", "at"]).join(th.filter(F.col("radius") == r), ["model", "case"])
        t = t.withColumn("hit", I.verdict(F.col("pre"), F.col("threshold"), F.col("cost")))
        out = t if out is None else out.unionByName(t)
    amp = F.create_map(*[F.lit(x) for r in INJECTIONS for x in (r["variant"], r["amp"])])
    prof = F.create_map(*[F.lit(x) for r in INJECTIONS for x in (r["variant"], r["profile"])])
    return out.select("model", "case", "radius", "variant", amp[F.col("variant")].alias("amp"), prof[F.col("variant")].alias("profile"), "hit")


def detection(t):
    """Rates of every configuration by amplitude and shape, and whether it is retained."""
    rate = lambda c: F.avg(F.when(c, F.col("hit").cast("double")))
    cal = F.col("amp") <= C.CAL_AMP
    amps = [rate(F.col("amp") == a).alias(f"detect_{abs(a):g}".replace(".", "_")) for a in AMPS]
    shapes = [rate(cal & (F.col("profile") == p)).alias(f"detect_{p}") for _, p in GEOMETRY]
    d = t.groupBy("model", "case", "radius").agg(F.count(F.when(cal, F.col("hit"))).alias("n_cal"), rate(cal).alias("detect_cal"), *amps, *shapes)
    return d.withColumn("retained", (F.col("n_cal") >= C.MIN_CASES) & (F.coalesce("detect_cal", F.lit(0.0)) >= C.FLOOR))


def settings(spark):
    return spark.createDataFrame([(c.case, c.s, c.z_target, c.channel, c.h_max) for c in FIELDS], "case int, s double, z_target double, channel string, h_max double")


@query("c3_injection_recovery", "model:b,s:d,z_target:d,channel:s,h_max:d,radius:d,n_cal:b,detect_cal:d,detect_0_5:d,detect_0_75:d,detect_1:d,detect_1_5:d,detect_vertical:d,detect_transition:d,detect_uniform:d,retained:t", "C3,C4,A5,G39")
def _(spark, sf):
    # One row per setting: at most a few hundred rows of literals.
    observed, _, _, th = observed_sweep(spark, sf)
    return detection(trials(spark, sf, observed, th)).join(F.broadcast(settings(spark)), "case")


@query("c5_retained_class", "model:b,site:b,root_fraction:d,cost_median:d,ensemble_class:s,n_ensemble:b", "C3,C4,C5", every="hotspot")
def _(spark, sf):
    """Classes over the retained configurations of each model; a model that retains none has no rows."""
    observed, places, costs, th = observed_sweep(spark, sf)
    kept = detection(trials(spark, sf, observed, th)).filter("retained").select("model", "case", "radius")
    return ensemble(costs, th.join(kept, ["model", "case", "radius"]), places)


@query("g22_path_occupancy", "model:b,k:b,j:b,i:b,visits:b,share:d", "G22,A14,D11")
def _(spark, sf):
    # Several configurations, each path counting a cell once.
    cases = [R.Case(n, s, 2700.0, h, 0.6, 1) for n, (s, h) in enumerate([(0.3, 300.0), (0.5, 300.0), (0.8, 300.0), (0.5, 2100.0)])]
    _, nodes = traced(spark, sf, cases)
    once = nodes.select("model", "case", "site", "k", "j", "i").distinct()
    per = once.groupBy("model", "k", "j", "i").agg(F.count("*").alias("visits"))
    # Every path starts at the seed shell, so that shell holds the number of paths.
    paths = nodes.filter("n = 0").groupBy("model").agg(F.count("*").alias("paths"))
    return per.join(paths, "model").withColumn("share", F.col("visits") / F.col("paths"))
