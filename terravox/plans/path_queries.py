"""Ordered paths: events of one user are the nodes of one path; orders of one customer a dated chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravox.functions import geo
from terravox.operators import paths as P
from terravox.operators.scaling import Ordered
from terravox.plans.registry import query
from terravox.sources import tables as T

PATHS_SQL = """ev AS (
  SELECT user_id AS path, event_id, value, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 WHEN 'signup' THEN 1 ELSE 0 END AS sy,
         CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN -1 WHEN 'signup' THEN 1 ELSE 0 END AS sx FROM events),
nodes AS (
  SELECT path, row_number() OVER w AS n, 45.0::DOUBLE * (row_number() OVER w - 1) AS depth,
         -60.0 + ((path * 37) % 1200) / 10.0::DOUBLE + round(sum(value * sy) OVER w / 111.0, 9) AS lat,
         -180.0 + ((path * 73) % 3600) / 10.0::DOUBLE + round(sum(value * sx) OVER w / 111.0, 9) AS lon, value
  FROM ev WINDOW w AS (PARTITION BY path ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
segs AS (
  SELECT *, lag(depth) OVER p AS pd, lag(lat) OVER p AS plat, lag(lon) OVER p AS plon, first_value(lat) OVER p AS flat,
         first_value(lon) OVER p AS flon FROM nodes WINDOW p AS (PARTITION BY path ORDER BY n)),
lens AS (SELECT *, """ + T.arc_sql("plat", "plon", "lat", "lon") + """ AS lat_km, abs(depth - pd) AS dropkm,
         round(""" + T.arc_sql("flat", "flon", "lat", "lon") + """, 6) AS off, (pd + depth) / 2 AS mid FROM segs)"""


def nodes(spark, sf, rows_per_piece=None):
    e = T.table(spark, sf, "events")
    kind = F.col("event_type")
    sy = F.when(kind.isin("click", "signup"), 1).when(kind == "purchase", -1).otherwise(0)
    sx = F.when(kind.isin("view", "signup"), 1).when(kind == "error", -1).otherwise(0)
    e = e.select(F.col("user_id").alias("path"), "event_id", "value", (F.col("value") * sy).alias("dy"), (F.col("value") * sx).alias("dx"))
    o = Ordered(e, ["path"], "event_id", **({"rows_per_piece": rows_per_piece} if rows_per_piece else {}))
    r = o.running({"n": ("count", F.lit(1)), "cy": ("sum", F.col("dy")), "cx": ("sum", F.col("dx"))}).result()
    return r.select(
        "path", "n", ((F.col("n") - 1) * 45.0).alias("depth"), (T.site_lat(F.col("path")) + F.round(F.col("cy") / 111.0, 9)).alias("lat"),
        (T.site_lon(F.col("path")) + F.round(F.col("cx") / 111.0, 9)).alias("lon"), "value")


@query("w2_path_differences", "path:b,n:b,dlat:d,dlon:d,lat_km:d", "W2,D9,F11", f"""
WITH {PATHS_SQL} SELECT path, n, lat - plat AS dlat, ((lon - plon + 180) % 360 + 360) % 360 - 180 AS dlon, lat_km FROM lens""")
def _(spark, sf):
    s = P.segments(nodes(spark, sf))
    return s.select("path", "n", (F.col("lat") - F.col("prev_lat")).alias("dlat"), geo.wrap180(F.col("lon") - F.col("prev_lon")).alias("dlon"), "lat_km")


@query("w3_path_shape", "path:b,tortuosity:d,lateral_total_km:d,max_offset_km:d,max_offset_depth_km:d,mean_tilt_deg:d,f0_410:d,f410_660:d,f660_3000:d", "W3,C33", f"""
WITH {PATHS_SQL}, g AS (SELECT path, sum(sqrt(lat_km * lat_km + dropkm * dropkm)) AS len, sum(lat_km) AS lt, max(depth) - min(depth) AS span, max(off) AS mo,
  coalesce(sum(lat_km) FILTER (WHERE mid >= 0 AND mid < 410), 0) AS a, coalesce(sum(lat_km) FILTER (WHERE mid >= 410 AND mid < 660), 0) AS b,
  coalesce(sum(lat_km) FILTER (WHERE mid >= 660 AND mid < 3000), 0) AS c FROM lens GROUP BY path),
m AS (SELECT l.path, min(depth) AS md FROM lens AS l JOIN g ON g.path = l.path AND l.off = g.mo GROUP BY l.path)
SELECT g.path, CASE WHEN span > 0 THEN len / span END AS tortuosity, round(lt, 3) AS lateral_total_km, round(mo, 3) AS max_offset_km, md AS max_offset_depth_km,
  degrees(atan2(lt, span)) AS mean_tilt_deg, CASE WHEN lt >= 1 THEN a / lt END AS f0_410, CASE WHEN lt >= 1 THEN b / lt END AS f410_660, CASE WHEN lt >= 1 THEN c / lt END AS f660_3000
FROM g JOIN m USING (path)""")
def _(spark, sf):
    g = P.shape(nodes(spark, sf), [(0, 410), (410, 660), (660, 3000)])
    # Metres are enough for sums of arccos distances.
    return g.withColumn("lateral_total_km", F.round("lateral_total_km", 3)).withColumn("max_offset_km", F.round("max_offset_km", 3))


DEFL_SQL = PATHS_SQL + """, st AS (SELECT path, count(*) AS nodes, greatest(2, round(300.0 / greatest(median(depth - pd), 1.0)))::BIGINT AS w FROM segs GROUP BY path HAVING count(*) >= 12),
loc AS (SELECT s.path, n, depth, w, pi() / 180 * 6371 * (((lon - flon + 180) % 360 + 360) % 360 - 180) * cos(radians(flat)) AS e,
  pi() / 180 * 6371 * (lat - flat) AS nn FROM segs AS s JOIN st USING (path)),
tri AS (SELECT a.path, a.n, a.depth, a.e - b.e AS x1, a.nn - b.nn AS y1, c.e - a.e AS x2, c.nn - a.nn AS y2
  FROM loc AS a JOIN loc AS b ON b.path = a.path AND b.n = a.n - a.w JOIN loc AS c ON c.path = a.path AND c.n = a.n + a.w),
leg AS (SELECT *, sqrt(x1 * x1 + y1 * y1) AS l1, sqrt(x2 * x2 + y2 * y2) AS l2 FROM tri),
defl AS (SELECT path, n, depth, round(degrees(acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, (x1 * x2 + y1 * y2) / (l1 * l2))))), 6) AS angle
  FROM leg WHERE l1 >= 30 AND l2 >= 30),
hits AS (SELECT * FROM defl WHERE angle >= 10)"""


@query("w4_deflections", "path:b,n:b,depth:d,angle:d", "W4", f"WITH {DEFL_SQL} SELECT * FROM hits")
def _(spark, sf):
    return P.deflections(nodes(spark, sf))


@query("a21_deflection_histogram", "bin_km:d,share:d", "A21", f"""
WITH {DEFL_SQL}, h AS (SELECT path, floor(depth / 200) * 200 AS bin_km, count(*) AS c FROM hits GROUP BY ALL),
s AS (SELECT bin_km, c / sum(c) OVER (PARTITION BY path) AS sh FROM h), t AS (SELECT bin_km, sum(sh) AS v FROM s GROUP BY bin_km)
SELECT bin_km, v / (SELECT sum(v) FROM t) AS share FROM t""")
def _(spark, sf):
    h = P.deflections(nodes(spark, sf)).groupBy("path", (F.floor(F.col("depth") / 200) * 200).alias("bin_km")).agg(F.count("*").alias("c"))
    tot = h.groupBy("path").agg(F.sum("c").alias("t"))
    # Every path weighs 1, so the grand total is the number of paths that deflect at all.
    per_bin = h.join(tot, "path").groupBy("bin_km").agg(F.sum(F.col("c") / F.col("t")).alias("v"))
    n = tot.agg(F.count("*").alias("n"))
    return per_bin.join(F.broadcast(n)).select("bin_km", (F.col("v") / F.col("n")).alias("share"))


@query("a22_band_shares_horizon", "upper:d,mid:d,lower:d,n_paths:b,horizon_ratio:d", "A22,C18", f"""
WITH {DEFL_SQL}, p AS (SELECT path, count(*)::DOUBLE AS c, count(*) FILTER (WHERE depth < 660) / c AS u, count(*) FILTER (WHERE depth >= 660 AND depth < 1500) / c AS m,
  count(*) FILTER (WHERE depth >= 1500) / c AS l, count(*) FILTER (WHERE depth >= 800 AND depth < 1200) / c AS num,
  count(*) FILTER (WHERE depth >= 660 AND depth < 2200) / c AS den FROM hits GROUP BY path)
SELECT sum(u) / count(*) AS upper, sum(m) / count(*) AS mid, sum(l) / count(*) AS lower, count(*) AS n_paths,
       sum(num) FILTER (WHERE den > 0) / sum(den) / ((1200 - 800) / (2200.0 - 660)) AS horizon_ratio FROM p""")
def _(spark, sf):
    d = F.col("depth")
    share = lambda c: F.count_if(c) / F.count("*")
    p = P.deflections(nodes(spark, sf)).groupBy("path").agg(
        share(d < 660).alias("u"), share((d >= 660) & (d < 1500)).alias("m"), share(d >= 1500).alias("l"),
        share((d >= 800) & (d < 1200)).alias("num"), share((d >= 660) & (d < 2200)).alias("den"))
    return p.agg(F.avg("u").alias("upper"), F.avg("m").alias("mid"), F.avg("l").alias("lower"), F.count("*").alias("n_paths"),
                 (F.sum(F.when(F.col("den") > 0, F.col("num"))) / F.sum("den") / ((1200 - 800) / (2200 - 660))).alias("horizon_ratio"))


@query("w10_strongest_per_run", "path:b,island:b,n:b,depth:d,angle:d,run_nodes:b", "W10,W6", f"""
WITH {DEFL_SQL}, i AS (SELECT *, n - row_number() OVER (PARTITION BY path ORDER BY n) AS g FROM hits),
r AS (SELECT path, g, max_by(n, angle * 1e6 - n * 1e-6) AS n, max(angle) AS angle, count(*) AS run_nodes, min(n) AS n0 FROM i GROUP BY path, g)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY n0) AS island, n, 45.0 * (n - 1) AS depth, angle, run_nodes FROM r""")
def _(spark, sf):
    base = nodes(spark, sf).select("path", "n")
    hits = P.deflections(nodes(spark, sf))
    j = base.join(hits, ["path", "n"], "left")
    isl = P.islands(j, F.col("angle").isNotNull())
    return isl.groupBy("path", "island").agg(F.max_by(F.struct("n", "depth", "angle"), F.struct(F.col("angle"), -F.col("n"))).alias("b"), F.count("*").alias("run_nodes")).select(
        "path", "island", "b.*", "run_nodes")


@query("w12_azimuth_turning", "path:b,n_used:b,total_deg:d,net_deg:d", "W12,F11", f"""
WITH {PATHS_SQL}, a AS (SELECT path, n, depth, ((degrees(atan2(sin(radians(lon - flon)) * cos(radians(lat)), cos(radians(flat)) * sin(radians(lat)) - sin(radians(flat)) * cos(radians(lat)) * cos(radians(lon - flon)))) % 360) + 360) % 360 AS az
  FROM lens WHERE off >= 200 AND depth >= 400 AND depth <= 2700),
d AS (SELECT *, lag(az) OVER (PARTITION BY path ORDER BY n) AS paz FROM a),
g AS (SELECT path, count(*) AS n_used, sum(abs(((az - paz + 180) % 360 + 360) % 360 - 180)) AS total_deg, min_by(az, n) AS a0, max_by(az, n) AS a1 FROM d GROUP BY path)
SELECT path, n_used, total_deg, ((a1 - a0 + 180) % 360 + 360) % 360 - 180 AS net_deg FROM g WHERE n_used >= 3""")
def _(spark, sf):
    s = P.with_start(nodes(spark, sf))
    q = [F.col(c) for c in ("first_lat", "first_lon", "lat", "lon")]
    s = s.withColumn("off", F.round(geo.arc_km(*q), 6)).filter("off >= 200 AND depth >= 400 AND depth <= 2700")
    s = s.withColumn("az", geo.bearing_deg(*q))
    s = Ordered(s, ["path"], "n").lag(["az"]).result()
    g = s.groupBy("path").agg(F.count("*").alias("n_used"), F.sum(F.abs(geo.wrap180(F.col("az") - F.col("prev_az")))).alias("total_deg"),
                              F.min_by("az", "n").alias("a0"), F.max_by("az", "n").alias("a1"))
    return g.filter("n_used >= 3").withColumn("net_deg", geo.wrap180(F.col("a1") - F.col("a0")))


@query("f5_best_azimuth", "path:b,azimuth:b,misfit:d", "F4,F5", f"""
WITH {PATHS_SQL}, p AS (SELECT path, least(depth, 2700.0::DOUBLE) AS w, {T.arc_sql('flat', 'flon', 'lat', 'lon')} / 6371.0 AS d13,
  atan2(sin(radians(lon - flon)) * cos(radians(lat)), cos(radians(flat)) * sin(radians(lat)) - sin(radians(flat)) * cos(radians(lat)) * cos(radians(lon - flon))) AS th FROM segs),
v AS (SELECT path, az, round(sum(w * abs(asin(sin(d13) * sin(th - radians(az))))) * 6.371, 6) AS misfit FROM p, (SELECT unnest(range(180)) AS az) AS z GROUP BY path, az)
SELECT path, min(az) AS azimuth, min(misfit) AS misfit FROM (SELECT *, min(misfit) OVER (PARTITION BY path) AS best FROM v) AS q WHERE misfit = best GROUP BY path""")
def _(spark, sf):
    s = P.with_start(nodes(spark, sf))
    q = [F.col(c) for c in ("first_lat", "first_lon", "lat", "lon")]
    s = s.select("path", F.least("depth", F.lit(2700.0)).alias("w"), (geo.arc_km(*q) / geo.EARTH_KM).alias("d"), F.radians(geo.bearing_deg(*q)).alias("th"))
    s = s.withColumn("az", F.explode(F.sequence(F.lit(0), F.lit(179))))
    cross = F.asin(F.sin("d") * F.sin(F.col("th") - F.radians("az")))
    v = s.groupBy("path", "az").agg(F.round(F.sum(F.col("w") * F.abs(cross)) * (geo.EARTH_KM / 1000), 6).alias("misfit"))
    return v.groupBy("path").agg(F.min(F.struct("misfit", "az")).alias("b")).select("path", F.col("b.az").alias("azimuth"), "b.misfit")


@query("f14_path_price", "path:b,length_km:d,price_km:d,mean_a:d,slower_pct:d", "F14,F15", f"""
WITH {PATHS_SQL}, s AS (SELECT path, sqrt(lat_km * lat_km + dropkm * dropkm) AS l, ((value - 25) / 100 + lag((value - 25) / 100) OVER (PARTITION BY path ORDER BY n)) / 2 AS a FROM lens),
g AS (SELECT path, sum(l) AS len, sum(l * exp(0.5 * a)) AS price, sum(l * a) / sum(l) AS ma FROM s WHERE l IS NOT NULL GROUP BY path)
SELECT path, len AS length_km, price AS price_km, ma AS mean_a, ln(price / len) / 0.5 AS slower_pct FROM g""")
def _(spark, sf):
    n = nodes(spark, sf).withColumn("a", (F.col("value") - 25) / 100)
    s = P.segments(n)
    s = s.join(Ordered(n.select("path", "n", "a"), ["path"], "n").lag(["a"]).result().select("path", "n", "prev_a"), ["path", "n"]).filter("seg IS NOT NULL")
    a = (F.col("a") + F.col("prev_a")) / 2
    g = s.groupBy("path").agg(F.sum("seg").alias("length_km"), F.sum(geo.step_price(F.col("seg"), a, 0.5)).alias("price_km"), (F.sum(F.col("seg") * a) / F.sum("seg")).alias("mean_a"))
    return g.withColumn("slower_pct", F.ln(F.col("price_km") / F.col("length_km")) / 0.5)


@query("j13_asof_depth", "path:b,level:d,lat:d,lon:d", "J13", f"""
WITH {PATHS_SQL}, g AS (SELECT unnest(range(20)) * 140.0::DOUBLE AS level), r AS (SELECT path, max(depth) AS dmax FROM nodes GROUP BY path)
SELECT r.path, level, n.lat, n.lon FROM r CROSS JOIN g ASOF JOIN nodes AS n ON n.path = r.path AND n.depth <= g.level""")
def _(spark, sf):
    return P.at_levels(nodes(spark, sf), [140.0 * x for x in range(20)], ["lat", "lon"], "asof")


@query("j15_interpolated_depth", "path:b,level:d,lat:d,lon:d", "J15,C33", f"""
WITH {PATHS_SQL}, g(level) AS (VALUES (400.0::DOUBLE), (660.0::DOUBLE), (1000.0::DOUBLE), (1500.0::DOUBLE), (2800.0::DOUBLE)),
x AS (SELECT *, lead(depth) OVER w AS d1, lead(lat) OVER w AS la1, lead(lon) OVER w AS lo1 FROM nodes WINDOW w AS (PARTITION BY path ORDER BY n)),
m AS (SELECT path, max(depth) AS dmax FROM nodes GROUP BY path)
SELECT x.path, level, CASE WHEN d1 IS NULL OR level = depth THEN lat ELSE lat + (la1 - lat) * (level - depth) / (d1 - depth) END AS lat,
       CASE WHEN d1 IS NULL OR level = depth THEN lon ELSE lon + (lo1 - lon) * (level - depth) / (d1 - depth) END AS lon
FROM x, g WHERE level >= depth AND (d1 IS NULL OR level < d1)""")
def _(spark, sf):
    return P.at_levels(nodes(spark, sf), [400.0, 660.0, 1000.0, 1500.0, 2800.0], ["lat", "lon"], "linear")


@query("c19_path_reliability", "path:b,pond_share:d,max_sep_km:d,stable:t", "C19", f"""
WITH {PATHS_SQL}, f AS (SELECT path, depth, lat, lon, avg(lat) OVER w AS slat, avg(lon) OVER w AS slon FROM nodes WINDOW w AS (PARTITION BY path ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
s AS (SELECT path, max(2 * 6371.0 * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians(slat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2))))) AS sep FROM f GROUP BY path),
p AS (SELECT path, sum(lat_km) FILTER (WHERE lat_km > dropkm) / sum(lat_km) AS share FROM lens GROUP BY path)
SELECT path, coalesce(share, 0) AS pond_share, sep AS max_sep_km, sep < 100 AS stable FROM s JOIN p USING (path)""")
def _(spark, sf):
    # The second reading of a path is the same path at half the sampling: mid-points of steps.
    s = P.segments(nodes(spark, sf))
    slat, slon = [F.when(F.col("prev_" + c).isNull(), F.col(c)).otherwise((F.col("prev_" + c) + F.col(c)) / 2) for c in ("lat", "lon")]
    sep = geo.haversine_km(F.col("lat"), F.col("lon"), slat, slon)
    g = s.groupBy("path").agg((F.sum(F.when(F.col("lat_km") > F.col("drop"), F.col("lat_km"))) / F.sum("lat_km")).alias("share"), F.max(sep).alias("max_sep_km"))
    return g.select("path", F.coalesce("share", F.lit(0.0)).alias("pond_share"), "max_sep_km", (F.col("max_sep_km") < 100).alias("stable"))


CHAIN_SQL = """chain AS (SELECT o_custkey AS chain, o_orderkey AS n, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) / 365.25::DOUBLE AS age, o_totalprice / 997.0 AS dist FROM orders)"""


def chain(spark, sf):
    o = T.table(spark, sf, "orders")
    age = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")) / 365.25
    return o.select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("n"), age.alias("age"), (F.col("o_totalprice") / 997.0).alias("dist"))


@query("a28_chain_gaps", "chain:b,n_dated:b,max_age_gap:d,median_age_gap:d,max_step:d,span:d,track_class:s", "A28,C16", f"""
WITH {CHAIN_SQL}, g AS (SELECT *, round(age - lag(age) OVER w, 9) AS gap, abs(dist - lag(dist) OVER w) AS step FROM chain WINDOW w AS (PARTITION BY chain ORDER BY age, n)),
a AS (SELECT chain, count(*) AS n_dated, max(gap) AS max_age_gap, median(gap) AS median_age_gap, max(step) AS max_step, max(age) - min(age) AS span FROM g GROUP BY chain)
SELECT *, CASE WHEN n_dated >= 8 AND max_age_gap <= 2 THEN 'P1' WHEN n_dated >= 4 THEN 'P2' ELSE 'P3' END AS track_class FROM a""")
def _(spark, sf):
    from terravox.operators.scaling import exact_percentiles

    s = Ordered(chain(spark, sf), ["chain"], ["age", "n"]).lag(["age", "dist"]).result()
    s = s.withColumn("gap", F.round(F.col("age") - F.col("prev_age"), 9)).withColumn("step", F.abs(F.col("dist") - F.col("prev_dist")))
    a = s.groupBy("chain").agg(F.count("*").alias("n_dated"), F.max("gap").alias("max_age_gap"), F.max("step").alias("max_step"), (F.max("age") - F.min("age")).alias("span"))
    med = exact_percentiles(s, ["chain"], "gap", {"median_age_gap": 0.5})
    cls = F.when((F.col("n_dated") >= 8) & (F.col("max_age_gap") <= 2), "P1").when(F.col("n_dated") >= 4, "P2").otherwise("P3")
    return a.join(med, "chain", "left").withColumn("track_class", cls)


@query("a7_multi_percentiles", "chain_band:b,n:b,p10:d,p25:d,p50:d,p75:d,p90:d", "A7,A1,A6", f"""
WITH {CHAIN_SQL} SELECT floor(age)::BIGINT AS chain_band, count(*) AS n, quantile_cont(dist, 0.1) AS p10, quantile_cont(dist, 0.25) AS p25,
  quantile_cont(dist, 0.5) AS p50, quantile_cont(dist, 0.75) AS p75, quantile_cont(dist, 0.9) AS p90 FROM chain GROUP BY chain_band""")
def _(spark, sf):
    from terravox.operators.scaling import exact_percentiles

    c = chain(spark, sf).withColumn("chain_band", F.floor("age"))
    p = exact_percentiles(c, ["chain_band"], "dist", {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    return p.join(c.groupBy("chain_band").agg(F.count("*").alias("n")), "chain_band")
