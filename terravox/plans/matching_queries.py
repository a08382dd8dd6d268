"""Matched and rotated null sites, and one run of paths against another."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from terravox.functions import geo
from terravox.operators import matching as M
from terravox.operators import paths as P
from terravox.operators import separation
from terravox.operators import spatial
from terravox.operators.scaling import exact_percentiles
from terravox.plans.path_queries import PATHS_SQL, nodes
from terravox.plans.registry import query
from terravox.plans.spatial_queries import BOUNDARY_SQL, CAPS_SQL, boundary_cells, caps
from terravox.session import keep
from terravox.sources import tables as T


@query("j17_range_matching", "segment:s,n:b,kept:b,lo:d,hi:d", "J17,A6", """
WITH q AS (SELECT quantile_cont(s_acctbal, 0.05) AS lo, quantile_cont(s_acctbal, 0.95) AS hi FROM supplier)
SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (WHERE c_acctbal >= lo AND c_acctbal <= hi) AS kept, lo, hi FROM customer, q GROUP BY c_mktsegment, lo, hi""")
def _(spark, sf):
    w = exact_percentiles(T.table(spark, sf, "supplier"), [], "s_acctbal", {"lo": 0.05, "hi": 0.95})  # one row
    c = T.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal").join(F.broadcast(w))
    return c.groupBy("segment", "lo", "hi").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal").between(F.col("lo"), F.col("hi"))).alias("kept"))


@query("c31_sites_far_from_hotspots", "site:b,lat:d,lon:d,n_sites:b", "C31,J6,J9", f"""
WITH {T.SITES_SQL} SELECT site, lat, lon, n_sites FROM places AS n WHERE kind = 'null' AND NOT EXISTS (SELECT 1 FROM places AS h WHERE h.kind = 'hotspot' AND {T.arc_sql('n.lat', 'n.lon', 'h.lat', 'h.lon')} <= 500)""", every="null")
def _(spark, sf):
    n, h = T.places(T.nulls(spark, sf)), T.places(T.hotspots(spark, sf))
    near = spatial.radius_join(n.select("site", "lat", "lon"), h.select("site", "lat", "lon"), 500.0).select("site").distinct()
    return n.join(near, "site", "left_anti")


# Ambient sites keep this far from every hotspot; targets of the signed margin, their width, how
# far apart replicates stand.
AWAY_KM = 1500.0
MARGINS, MARGIN_WIDTH_KM, APART_KM = (-1500.0, 0.0, 1500.0), 500.0, 2500.0


@query("c31_ambient_sites", "nation:b,site:b,lat:d,lon:d,n_sites:b", "C31,J6,J9", f"""
WITH {T.SITES_SQL}, h AS (SELECT DISTINCT s_nationkey AS nation, x.lat, x.lon FROM supplier AS s JOIN hotspots AS x ON x.site = s.s_suppkey)
SELECT n_nationkey AS nation, site, lat, lon, n_sites FROM nation, places AS n WHERE kind = 'null'
  AND NOT EXISTS (SELECT 1 FROM h WHERE h.nation = n_nationkey AND {T.arc_sql('n.lat', 'n.lon', 'h.lat', 'h.lon')} <= {AWAY_KM})""", every="null")
def _(spark, sf):
    # Every nation is a catalogue of hotspots of its own, with its own ambient sites.
    n = T.places(T.nulls(spark, sf)).drop("kind")
    of = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").alias("nation"))
    h = T.hotspots(spark, sf).join(of, "site").select("nation", "lat", "lon").distinct()
    near = spatial.radius_join(n.select("site", "lat", "lon"), h, AWAY_KM).select("site", F.col("p_nation").alias("nation")).distinct()
    # ``nation`` is a table of fixed size.
    every = n.crossJoin(F.broadcast(T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"))))
    return every.join(near, ["site", "nation"], "left_anti")


@query("c31_margin_replicates", "model:b,target:d,j:b,i:b,margin_km:d", "C31,F12", f"""
WITH RECURSIVE {T.CELLS_SQL}, {BOUNDARY_SQL}, col AS (SELECT DISTINCT model, j, i, lat, lon FROM cols),
m AS (SELECT c.model, c.j, c.i, c.lat, c.lon, min({T.arc_sql('c.lat', 'c.lon', 'e.lat', 'e.lon')}) AS d FROM col AS c JOIN edge AS e ON e.model = c.model GROUP BY ALL),
s AS (SELECT m.*, CASE WHEN q.j IS NULL THEN d ELSE -d END AS margin_km FROM m LEFT JOIN (SELECT DISTINCT model, j, i FROM inside) AS q USING (model, j, i)),
c AS (SELECT s.*, target, row_number() OVER (PARTITION BY model, target ORDER BY (j * 7919 + i * 613) % 1009, j, i) AS turn
  FROM s, (SELECT unnest({list(MARGINS)}::DOUBLE[]) AS target) AS t WHERE abs(margin_km - target) <= {MARGIN_WIDTH_KM}),
g AS (SELECT model, target, 1 AS turn, [{{'j': j, 'i': i, 'lat': lat, 'lon': lon, 'm': margin_km}}] AS taken FROM c WHERE turn = 1 UNION ALL
  SELECT g.model, g.target, c.turn, CASE WHEN len(list_filter(taken, lambda x: {T.arc_sql('c.lat', 'c.lon', 'x.lat', 'x.lon')} <= {APART_KM})) = 0
    THEN list_append(taken, {{'j': c.j, 'i': c.i, 'lat': c.lat, 'lon': c.lon, 'm': c.margin_km}}) ELSE taken END FROM g JOIN c ON c.model = g.model AND c.target = g.target AND c.turn = g.turn + 1),
l AS (SELECT model, target, unnest(max_by(taken, turn)) AS x FROM g GROUP BY model, target)
SELECT model, target, x.j, x.i, x.m AS margin_km FROM l""")
def _(spark, sf):
    """Cells of every model near each target of the signed margin, replicates far apart; the order of choice
    is a digest of the cell, so it prefers no region."""
    cells = T.columns(spark, sf).select("model", "j", "i", "lat", "lon", "label").distinct()
    grid = cells.select("j", "i", "lat", "lon").distinct()
    d = spatial.nearest_join_by(grid, boundary_cells(spark, sf).select("model", F.col("j").alias("ej"), F.col("i").alias("ei"), "lat", "lon"), ["j", "i"], ["ej", "ei"], ["model"], 1500.0)
    inside = cells.filter("label <= 2").select("model", "j", "i", F.lit(True).alias("inn")).distinct()
    s = cells.select("model", "j", "i", "lat", "lon").distinct().join(d.select("model", "j", "i", "dist_km"), ["model", "j", "i"]).join(inside, ["model", "j", "i"], "left")
    s = s.withColumn("margin_km", F.when(F.col("inn"), -F.col("dist_km")).otherwise(F.col("dist_km")))
    c = s.withColumn("target", F.explode(F.array(*[F.lit(t) for t in MARGINS]))).filter(F.abs(F.col("margin_km") - F.col("target")) <= MARGIN_WIDTH_KM)
    c = c.withColumn("turn", (F.col("j") * 7919 + F.col("i") * 613) % 1009)
    return separation.keep_apart(c.select("model", "target", "turn", "j", "i", "lat", "lon", "margin_km"), ["model", "target"], ["turn", "j", "i"], APART_KM)


def rotations(count: int, seed: int = 97) -> list[list[list[float]]]:
    """Uniform random rotations of the sphere, from unit quaternions."""
    out = []
    for q in np.random.default_rng(seed).normal(size=(count, 4)):
        w, x, y, z = q / np.linalg.norm(q)
        m = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
        out.append([[float(v) for v in r] for r in m])
    return out


ROT = rotations(3)
ROT_SQL = ", ".join("(" + ", ".join([str(n)] + [f"{v!r}::DOUBLE" for row in m for v in row]) + ")" for n, m in enumerate(ROT))


@query("g42_rotated_sites", "draw:b,site:b,lat:d,lon:d", "G42,F8", f"""
WITH {T.SITES_SQL}, r(draw, a, b, c, d, e, f, g, h, k) AS (VALUES {ROT_SQL}),
p AS (SELECT site, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM places WHERE kind = 'hotspot')
SELECT draw, site, degrees(asin(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, g * x + h * y + k * z)))) AS lat, degrees(atan2(d * x + e * y + f * z, a * x + b * y + c * z)) AS lon FROM p, r""", every="hotspot")
def _(spark, sf):
    # All sites of a draw turn rigidly together; the matrices ride along as a literal.
    p = T.places(T.hotspots(spark, sf))
    x, y, z = geo.unit_xyz(F.col("lat"), F.col("lon"))
    lit = F.array(*[F.struct(F.lit(n).alias("draw"), F.array(*[F.lit(v) for row in m for v in row]).alias("m")) for n, m in enumerate(ROT)])
    p = p.select("site", x.alias("x"), y.alias("y"), z.alias("z"), F.explode(lit).alias("r"))
    m = F.col("r.m")
    dot = lambda r: m[3 * r] * F.col("x") + m[3 * r + 1] * F.col("y") + m[3 * r + 2] * F.col("z")
    return p.select("r.draw", "site", F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(2))))).alias("lat"), F.degrees(F.atan2(dot(1), dot(0))).alias("lon"))


@query("c33_run_against_reference", "level:d,n:b,improved:b,unchanged:b,degraded:b", "C33,J13,J15", f"""
WITH {PATHS_SQL}, g(level) AS (VALUES (670.0::DOUBLE), (1010.0::DOUBLE), (2000.0::DOUBLE)),
x AS (SELECT *, lead(depth) OVER w AS d1, lead(lat) OVER w AS la1, lead(lon) OVER w AS lo1, first_value(lat) OVER w AS fla, first_value(lon) OVER w AS flo FROM nodes WINDOW w AS (PARTITION BY path ORDER BY n)),
p AS (SELECT path, level, fla, flo, lat AS alat, lon AS alon, CASE WHEN d1 IS NULL OR level = depth THEN lat ELSE lat + (la1 - lat) * (level - depth) / (d1 - depth) END AS blat,
  CASE WHEN d1 IS NULL OR level = depth THEN lon ELSE lon + (lo1 - lon) * (level - depth) / (d1 - depth) END AS blon FROM x, g WHERE level >= depth AND (d1 IS NULL OR level < d1)),
o AS (SELECT level, round(({T.haversine_sql('fla', 'flo', 'blat', 'blon')} - {T.haversine_sql('fla', 'flo', 'alat', 'alon')}) / 111.0, 6) AS d FROM p)
SELECT level, count(*) AS n, count(*) FILTER (WHERE d < -0.05) AS improved, count(*) FILTER (WHERE abs(d) <= 0.05) AS unchanged, count(*) FILTER (WHERE d > 0.05) AS degraded FROM o GROUP BY level""")
def _(spark, sf):
    """The reference run reads the last node above a depth, the other interpolates."""
    p = nodes(spark, sf)
    levels = [670.0, 1010.0, 2000.0]
    first = p.groupBy("path").agg(F.min_by(F.struct("lat", "lon"), "n").alias("f"))
    a = P.at_levels(p, levels, ["lat", "lon"], "asof").select("path", "level", F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    j = P.at_levels(p, levels, ["lat", "lon"], "linear").join(a, ["path", "level"]).join(first, "path")
    off = lambda la, lo: geo.haversine_km(F.col("f.lat"), F.col("f.lon"), F.col(la), F.col(lo))
    d = F.round((off("lat", "lon") - off("alat", "alon")) / 111.0, 6)
    return j.withColumn("d", d).groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("d") < -0.05).alias("improved"), F.count_if(F.abs("d") <= 0.05).alias("unchanged"), F.count_if(F.col("d") > 0.05).alias("degraded"))


# ---- matching without replacement ------------------------------------------------------------------

def match_sides(spark, sf):
    take = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), F.round(F.col("s_acctbal") / 10, 1).alias("x"))
    pool = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("site"), F.round(F.col("c_acctbal") / 10, 1).alias("x"))
    return take, pool


@query("j16_nearest_matches", "taker:b,member:b,gap:d", "J16")
def _(spark, sf):
    """Three customers of the nearest balance for each supplier, no customer twice."""
    return M.nearest_matches(*match_sides(spark, sf), 3)


@query("j16_matched_balance", "n:b,mean_gap:d,mean_gap_shared:d", "J16")
def _(spark, sf):
    """What not sharing costs: the mean gap of the matches beside that of the nearest members."""
    take, pool = match_sides(spark, sf)
    own = M.nearest_matches(take, pool, 3).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"))
    shared = M.nearest_members(take, pool, 3).agg(F.avg("gap").alias("mean_gap_shared"))
    return own.crossJoin(F.broadcast(shared))


# ---- every metric against matched nulls ------------------------------------------------------------

MATCHED = 50
METRICS = ["n_cells", "cap_mean", "relief"]


@query("t24_matched_percentiles", "model:b,site:b,n_matched:b,mismatch:d,pct_n_cells:d,pct_cap_mean:d,pct_relief:d", "T24", f"""
WITH {CAPS_SQL}, c AS (SELECT model, kind, site, n_cells::DOUBLE AS n_cells, cap_mean, round(cap_mean - cap_min, 6) AS relief, round(cap_min, 6) AS deep FROM caps),
r AS (SELECT h.model, h.site, abs(n.deep - h.deep) AS gap, row_number() OVER (PARTITION BY h.model, h.site ORDER BY abs(n.deep - h.deep), n.site) AS rn,
  {', '.join(f'(n.{m} <= h.{m})::INT AS {m}' for m in METRICS)} FROM c AS h JOIN c AS n ON n.model = h.model AND h.kind = 'hotspot' AND n.kind = 'null')
SELECT model, site, count(*) AS n_matched, max(gap) AS mismatch, {', '.join(f'100 * avg({m}) AS pct_{m}' for m in METRICS)} FROM r WHERE rn <= {MATCHED} GROUP BY model, site""", every="hotspot")
def _(spark, sf):
    """Percentile of all metrics of a hotspot among the nulls whose deepest value is most like its own."""
    c = caps(spark, sf).select("model", "kind", "site", F.col("n_cells").cast("double").alias("n_cells"), "cap_mean", F.round(F.col("cap_mean") - F.col("cap_min"), 6).alias("relief"), F.round("cap_min", 6).alias("deep"))
    c = keep(c, "metrics")
    h, n = c.filter("kind = 'hotspot'"), c.filter("kind = 'null'")
    pairs = M.nearest_members(h, n, MATCHED, value="deep", by=["model"])
    # The metrics travel as one struct per side, so all are ranked in one aggregate.
    row = F.struct(*METRICS)
    a = h.select("model", F.col("site").alias("taker"), row.alias("own"))
    b = n.select("model", F.col("site").alias("member"), row.alias("other"))
    j = pairs.join(a, ["model", "taker"]).join(b, ["model", "member"])
    pct = [(100 * F.avg((F.col("other")[m] <= F.col("own")[m]).cast("double"))).alias(f"pct_{m}") for m in METRICS]
    return j.groupBy("model", F.col("taker").alias("site")).agg(F.count(F.lit(1)).alias("n_matched"), F.max("gap").alias("mismatch"), *pct)
