"""Joins between point sites and cells or between two point sets, and scalar geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terravox.functions import geo
from terravox.operators import spatial
from terravox.operators.scaling import shuffled_join
from terravox.plans.registry import query
from terravox.sources import tables as T

CELLS, SITES = T.CELLS_SQL, T.SITES_SQL
DEEP_SQL = "deep AS (SELECT model, j, i, lat, lon, label, avg(anom) AS a FROM cells WHERE depth_km BETWEEN 2000 AND 2800 GROUP BY ALL)"


def deep_mean(spark, sf):
    c = T.columns(spark, sf)
    w = F.filter(F.transform("v", lambda x, k: F.when(T.depth_of(k).between(2000, 2800), x)), lambda x: x.isNotNull())
    return c.withColumn("w", w).select(
        "model", "j", "i", "lat", "lon", "label", (F.aggregate("w", F.lit(0.0), lambda s, x: s + x) / F.size("w")).alias("a")
    )


def all_places(spark, sf):
    return T.places(T.hotspots(spark, sf).unionByName(T.nulls(spark, sf)))


CAP_KM = 1600.0
CAPS_SQL = f"""{CELLS}, {SITES}, {DEEP_SQL}, caps AS (
  SELECT p.kind, p.site, p.n_sites, d.model, count(*) AS n_cells, round(avg(d.a), 9) AS cap_mean, min(d.a) AS cap_min
  FROM places AS p JOIN deep AS d ON {T.arc_sql('p.lat', 'p.lon', 'd.lat', 'd.lon')} <= {CAP_KM} GROUP BY ALL)"""


def caps(spark, sf):
    m = spatial.radius_join(deep_mean(spark, sf), all_places(spark, sf), CAP_KM)
    return m.groupBy(F.col("p_kind").alias("kind"), F.col("p_site").alias("site"), F.col("p_n_sites").alias("n_sites"), "model").agg(
        F.count("*").alias("n_cells"), F.round(F.avg("a"), 9).alias("cap_mean"), F.min("a").alias("cap_min")
    )


@query("cap_percentile_vs_null", "model:b,site:b,n_cells:b,cap_mean:d,percentile:d", "A16,J9,T22,T24 (flagship)", f"""
WITH {CAPS_SQL}
SELECT h.model, h.site, h.n_cells, h.cap_mean,
       100.0::DOUBLE * coalesce(sum(n.n_sites) FILTER (WHERE n.cap_mean < h.cap_mean), 0) / sum(n.n_sites) AS percentile
FROM caps AS h JOIN caps AS n ON n.model = h.model AND n.kind = 'null' AND h.kind = 'hotspot'
GROUP BY h.model, h.site, h.n_cells, h.cap_mean""", every="hotspot")
def cap_percentile(spark, sf):
    c = caps(spark, sf)
    # A model has at most 3,600 positions per kind, so ranking inside a model is a bounded window;
    # no hotspot is paired with a null. Strictly smaller: running weight minus the peers'.
    w = Window.partitionBy("model")
    weight = F.when(F.col("kind") == "null", F.col("n_sites")).otherwise(0)
    below = F.sum(weight).over(w.orderBy("cap_mean").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    peers = F.sum(weight).over(Window.partitionBy("model", "cap_mean"))
    r = c.withColumn("below", below - peers).withColumn("total", F.sum(weight).over(w))
    hit = 100.0 * F.col("below") / F.col("total")
    return r.filter("kind = 'hotspot'").withColumn("percentile", hit)


@query("j9_radius_cap", "kind:s,site:b,model:b,n_cells:b,cap_mean:d,cap_min:d", "J9,G32", f"WITH {CAPS_SQL} SELECT * FROM caps", every="kind")
def _(spark, sf):
    return caps(spark, sf)


@query("j11_annulus_mean", "site:b,model:b,n_ring:b,ring_mean:d", "J11", f"""
WITH {CELLS}, {SITES}, {DEEP_SQL}, pairs AS (
  SELECT p.site, d.model, d.a, {T.arc_sql('p.lat', 'p.lon', 'd.lat', 'd.lon')} AS dist
  FROM places AS p, deep AS d WHERE p.kind = 'hotspot')
SELECT site, model, count(*) AS n_ring, avg(a) AS ring_mean FROM pairs WHERE dist BETWEEN 1500 AND 3000 GROUP BY site, model""", every="hotspot")
def _(spark, sf):
    m = spatial.radius_join(deep_mean(spark, sf), T.places(T.hotspots(spark, sf)), 3000.0, 1500.0)
    return m.groupBy(F.col("p_site").alias("site"), "model").agg(F.count("*").alias("n_ring"), F.avg("a").alias("ring_mean"))


@query("j10_inverse_square_bearing", "model:b,site:b,n:b,bearing:d,mean_km:d", "J10,A10,F3", f"""
WITH {CELLS}, {SITES}, tgt AS (SELECT DISTINCT model, lat, lon FROM cols WHERE label <= 2),
b AS (SELECT t.model, site, {T.arc_sql('p.lat', 'p.lon', 't.lat', 't.lon')} AS d,
  atan2(sin(radians(t.lon - p.lon)) * cos(radians(t.lat)), cos(radians(p.lat)) * sin(radians(t.lat))
        - sin(radians(p.lat)) * cos(radians(t.lat)) * cos(radians(t.lon - p.lon))) AS br
  FROM places AS p, tgt AS t WHERE p.kind = 'hotspot'),
w AS (SELECT model, site, d, br, 1 / pow(greatest(d, 50.0::DOUBLE), 2) AS w FROM b WHERE d <= 6000)
SELECT model, site, count(*) AS n, ((degrees(atan2(sum(w * sin(br)), sum(w * cos(br)))) % 360) + 360) % 360 AS bearing,
       sum(w * d) / sum(w) AS mean_km FROM w GROUP BY model, site HAVING count(*) >= 20""", every="hotspot")
def _(spark, sf):
    tgt = T.columns(spark, sf).filter("label <= 2").select("model", "lat", "lon").distinct()
    m = spatial.radius_join(tgt, T.places(T.hotspots(spark, sf)), 6000.0)
    br = F.radians(geo.bearing_deg(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")))
    m = m.withColumn("w", 1 / F.pow(F.greatest(F.col("dist_km"), F.lit(50.0)), F.lit(2.0))).withColumn("br", br)
    w = F.col("w")
    g = m.groupBy("model", F.col("p_site").alias("site")).agg(
        F.count("*").alias("n"), F.sum(w * F.sin("br")).alias("s"), F.sum(w * F.cos("br")).alias("c"),
        (F.sum(w * F.col("dist_km")) / F.sum("w")).alias("mean_km"))
    return g.filter("n >= 20").withColumn("bearing", geo.wrap360(F.degrees(F.atan2("s", "c"))))


BOUNDARY_SQL = """inside AS (SELECT DISTINCT model, j, i, lat, lon FROM cols WHERE label <= 2),
edge AS (SELECT a.model, a.j, a.i, a.lat, a.lon FROM inside AS a LEFT JOIN inside AS b ON a.model = b.model
   AND ((b.j = a.j AND b.i = (a.i + 1) % 25) OR (b.j = a.j AND b.i = (a.i + 24) % 25) OR (b.j = a.j + 1 AND b.i = a.i) OR (b.j = a.j - 1 AND b.i = a.i))
   GROUP BY ALL HAVING count(b.j) < (CASE WHEN a.j IN (0, 19) THEN 3 ELSE 4 END))"""


def boundary_cells(spark, sf):
    """Province cells with at least one 4-neighbour outside; longitude wraps, poles are walls.

    Each member sends one row to every neighbour it has; a cell that receives fewer than its
    neighbour count lies on the boundary.
    """
    m = T.columns(spark, sf).filter("label <= 2").select("model", "j", "i", "lat", "lon")
    step = F.array(*[F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di"), F.lit(c).alias("own")) for a, b, c in
                     ((0, 0, 1), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0))])
    e = m.select("*", F.explode(step).alias("s"))
    e = e.select("model", (F.col("j") + F.col("s.dj")).alias("j"), F.pmod(F.col("i") + F.col("s.di"), F.lit(T.NLON)).alias("i"), F.col("s.own").alias("own"))
    g = e.groupBy("model", "j", "i").agg(F.max("own").alias("own"), (F.count("*") - F.sum("own")).alias("got"))
    need = F.when(F.col("j").isin(0, T.NLAT - 1), 3).otherwise(4)
    return g.filter((F.col("own") == 1) & (F.col("got") < need)).select(
        "model", "j", "i", (F.lit(-90.0) + (F.col("j") + 0.5) * T.DLAT).alias("lat"), (F.lit(-180.0) + F.col("i") * T.DLON).alias("lon"))


@query("g30_province_boundary", "model:b,j:b,i:b,lat:d,lon:d", "G30,D14", f"WITH {CELLS}, {BOUNDARY_SQL} SELECT * FROM edge")
def _(spark, sf):
    return boundary_cells(spark, sf)


@query("j12_nearest_boundary", "model:b,site:b,dist_km:d,j:b,i:b,margin_km:d", "J12,F12", f"""
WITH {CELLS}, {SITES}, {BOUNDARY_SQL}, e AS (SELECT DISTINCT model, j, i, lat, lon FROM edge),
r AS (SELECT p.site, p.lat AS plat, p.lon AS plon, e.model, e.j, e.i, {T.arc_sql('p.lat', 'p.lon', 'e.lat', 'e.lon')} AS d
      FROM places AS p, e WHERE p.kind = 'hotspot'),
n AS (SELECT *, row_number() OVER (PARTITION BY model, site ORDER BY round(d, 6), j, i) AS rn FROM r),
s AS (SELECT *, least(19, greatest(0, ceil((plat + 90 - 4.5) / 9 - 0.5)))::BIGINT AS hj,
             ((ceil(round((plon + 180) / 14.4, 9) - 0.5)::BIGINT % 25) + 25) % 25 AS hi FROM n WHERE rn = 1)
SELECT s.model, s.site, s.d AS dist_km, s.j, s.i, CASE WHEN q.j IS NULL THEN s.d ELSE -s.d END AS margin_km
FROM s LEFT JOIN (SELECT DISTINCT model, j, i FROM inside) AS q ON q.model = s.model AND q.j = s.hj AND q.i = s.hi""", every="hotspot")
def _(spark, sf):
    p = T.places(T.hotspots(spark, sf))
    n = spatial.nearest_join_by(p, boundary_cells(spark, sf), ["site"], ["j", "i"], ["model"], 1500.0)
    member = T.columns(spark, sf).filter("label <= 2").select("model", F.col("j").alias("hj"), F.col("i").alias("hi"), F.lit(True).alias("inn")).distinct()
    hj = F.least(F.lit(T.NLAT - 1), F.greatest(F.lit(0), F.ceil((F.col("lat") + 90 - T.DLAT / 2) / T.DLAT - 0.5))).cast("int")
    hi = F.pmod(F.ceil(F.round((F.col("lon") + 180) / T.DLON, 9) - 0.5), F.lit(T.NLON)).cast("int")
    at = shuffled_join(n.join(p.select("site", hj.alias("hj"), hi.alias("hi")), "site"), member, ["model", "hj", "hi"], "left")
    return at.withColumn("margin_km", F.when(F.col("inn"), -F.col("dist_km")).otherwise(F.col("dist_km")))


@query("g44_boundary_distance", "model:b,n:b,median_km:d,p90_km:d", "G44,J12", f"""
WITH {CELLS}, {BOUNDARY_SQL}, other AS (SELECT DISTINCT model, j, i, lat, lon FROM cols WHERE label >= 8),
r AS (SELECT e.model, e.j, e.i, min({T.arc_sql('e.lat', 'e.lon', 'o.lat', 'o.lon')}) AS d
      FROM edge AS e JOIN other AS o ON e.model = o.model GROUP BY e.model, e.j, e.i)
SELECT model, count(*) AS n, median(d) AS median_km, quantile_cont(d, 0.9) AS p90_km FROM r GROUP BY model""")
def _(spark, sf):
    # Both sides belong to the same model: the model joins the bucket in the equi key.
    e = boundary_cells(spark, sf)
    o = T.columns(spark, sf).filter("label >= 8").select("model", "lat", "lon")
    r, todo, done = 2500.0, e, None
    size = spatial._bands(r)
    while True:
        spread = spatial.spread_buckets(todo, r, size).select("model", "_band", "_sector", "j", "i", F.col("lat").alias("elat"), F.col("lon").alias("elon"))
        m = spatial.with_bucket(o, size).join(spread, ["model", "_band", "_sector"])
        m = m.withColumn("d", geo.arc_km(F.col("elat"), F.col("elon"), F.col("lat"), F.col("lon"))).filter(F.col("d") <= r)
        best = m.groupBy("model", "j", "i").agg(F.min("d").alias("d"))
        done = best if done is None else done.unionByName(best)
        todo = todo.join(best, ["model", "j", "i"], "left_anti")
        if r > 20016 or todo.isEmpty():
            break
        r, size = r * 4, spatial._bands(min(r * 4, 20016.0))
    # A model has at most NLAT * NLON boundary cells, so the percentile group is bounded.
    return done.groupBy("model").agg(F.count("*").alias("n"), F.median("d").alias("median_km"), F.percentile("d", F.lit(0.9)).alias("p90_km"))


PTS_SQL = """pts AS (SELECT c_custkey AS id, -60.0 + ((c_custkey * 37) % 1200) / 10.0::DOUBLE AS lat1, -180.0 + ((c_custkey * 73) % 3600) / 10.0::DOUBLE AS lon1,
  -60.0 + ((c_nationkey * 37) % 1200) / 10.0::DOUBLE AS lat2, -180.0 + ((c_nationkey * 173) % 3600) / 10.0::DOUBLE AS lon2 FROM customer)"""


def point_pairs(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return T.table(spark, sf, "customer").select(
        k.alias("id"), T.site_lat(k).alias("lat1"), T.site_lon(k).alias("lon1"), T.site_lat(n).alias("lat2"),
        (F.lit(-180.0) + F.pmod(n * 173, F.lit(3600)) / 10.0).alias("lon2"))


@query("f1_great_circle", "id:b,arc_km:d,haversine_km:d,bearing:d", "F1,F2,F3", f"""
WITH {PTS_SQL}
SELECT id, {T.arc_sql('lat1', 'lon1', 'lat2', 'lon2')} AS arc_km,
  2 * 6371.0 * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))) AS haversine_km,
  ((degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) % 360) + 360) % 360 AS bearing
FROM pts WHERE NOT (lat1 = lat2 AND lon1 = lon2)""")
def _(spark, sf):
    p = point_pairs(spark, sf).filter(~((F.col("lat1") == F.col("lat2")) & (F.col("lon1") == F.col("lon2"))))
    q = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    return p.select("id", geo.arc_km(*q).alias("arc_km"), geo.haversine_km(*q).alias("haversine_km"), geo.bearing_deg(*q).alias("bearing"))


@query("f6_local_frames", "id:b,east:d,north:d,along_deg:d,cross_deg:d,x:d,y:d,z:d,cell_w:d,cell_area:d", "F4,F6,F7,F8,F9", f"""
WITH {PTS_SQL}, t AS (SELECT *, pi() / 180 * 6371 * ((((lon2 - lon1 + 180) % 360) + 360) % 360 - 180) * cos(radians(lat1)) AS east,
   pi() / 180 * 6371 * (lat2 - lat1) AS north FROM pts)
SELECT id, east, north, (lat2 - lat1) * cos(radians(40)) + ((((lon2 - lon1 + 180) % 360) + 360) % 360 - 180) * sin(radians(40)) AS along_deg,
  ((((lon2 - lon1 + 180) % 360) + 360) % 360 - 180) * cos(radians(40)) - (lat2 - lat1) * sin(radians(40)) AS cross_deg,
  (6371.0 - 660) * cos(radians(lat1)) * cos(radians(lon1)) AS x, (6371.0 - 660) * cos(radians(lat1)) * sin(radians(lon1)) AS y, (6371.0 - 660) * sin(radians(lat1)) AS z,
  14.4 * 6371 * pi() / 180 * greatest(cos(radians(lat1)), 0.02::DOUBLE) AS cell_w,
  14.4 * 6371 * pi() / 180 * greatest(cos(radians(lat1)), 0.02::DOUBLE) * 9.0 * 6371 * pi() / 180 / 1e6 AS cell_area FROM t""")
def _(spark, sf):
    p = point_pairs(spark, sf)
    lat1, lon1, lat2, lon2 = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    east, north = geo.tangent_offsets(lat1, lon1, lat2, lon2)
    along, cross = geo.along_cross_deg(F.lit(40.0), lat2 - lat1, geo.wrap180(lon2 - lon1))
    x, y, z = geo.earth_xyz(F.lit(660.0), lat1, lon1)
    h, w = geo.cell_km(lat1, T.DLAT, T.DLON)
    return p.select("id", east.alias("east"), north.alias("north"), along.alias("along_deg"), cross.alias("cross_deg"),
                    x.alias("x"), y.alias("y"), z.alias("z"), w.alias("cell_w"), (w * h / 1e6).alias("cell_area"))


@query("f7_azimuthal_offsets", "id:b,east:d,north:d", "F7", f"""
WITH {PTS_SQL}, t AS (SELECT id, {T.arc_sql('lat1', 'lon1', 'lat2', 'lon2')} AS d,
  atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1))) AS b
 FROM pts WHERE NOT (lat1 = lat2 AND lon1 = lon2)) SELECT id, d * sin(b) AS east, d * cos(b) AS north FROM t""")
def _(spark, sf):
    p = point_pairs(spark, sf).filter(~((F.col("lat1") == F.col("lat2")) & (F.col("lon1") == F.col("lon2"))))
    e, n = geo.azimuthal_offsets(*[F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")])
    return p.select("id", e.alias("east"), n.alias("north"))


@query("a11_spherical_centroid", "model:b,k:b,label:b,lat:d,lon:d,strength:d", "A11", f"""
WITH {CELLS}, w AS (SELECT model, k, label, radians(lat) AS a, radians(lon) AS o, cos(radians(lat)) * abs(anom) AS w FROM cells),
s AS (SELECT model, k, label, sum(w * cos(a) * cos(o)) / sum(w) AS x, sum(w * cos(a) * sin(o)) / sum(w) AS y, sum(w * sin(a)) / sum(w) AS z FROM w GROUP BY model, k, label)
SELECT model, k, label, degrees(asin(z / sqrt(x * x + y * y + z * z))) AS lat, degrees(atan2(y, x)) AS lon, sqrt(x * x + y * y + z * z) AS strength FROM s""")
def _(spark, sf):
    c = T.cells(spark, sf).withColumn("w", F.cos(F.radians("lat")) * F.abs("anom"))
    x, y, z = geo.unit_xyz(F.col("lat"), F.col("lon"))
    g = c.groupBy("model", "k", "label").agg(*[(F.sum(F.col("w") * u) / F.sum("w")).alias(n) for n, u in (("x", x), ("y", y), ("z", z))])
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return g.select("model", "k", "label", F.degrees(F.asin(F.col("z") / r)).alias("lat"),
                    F.degrees(F.atan2("y", "x")).alias("lon"), r.alias("strength"))


@query("g31_densify_polyline", "line:b,seg:b,step:b,lat:d,lon:d", "G31,S9", """
WITH v AS (SELECT l_orderkey AS line, l_linenumber AS seg, -60.0 + ((l_partkey * 37) % 1200) / 10.0::DOUBLE AS lat,
           -180.0 + ((l_partkey * 73) % 3600) / 10.0::DOUBLE AS lon, l_suppkey, l_quantity, l_extendedprice FROM lineitem),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line, seg ORDER BY lat, lon) AS q FROM v) WHERE q = 1),
n AS (SELECT line, seg, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM d WINDOW w AS (PARTITION BY line ORDER BY seg)),
c AS (SELECT *, greatest(1, ceil(round(6371.0 * pi() / 180 * sqrt(pow(lat2 - lat, 2) + pow((lon2 - lon) * cos(radians(lat)), 2)) / 2000.0, 9)))::BIGINT AS m FROM n WHERE lat2 IS NOT NULL)
SELECT line, seg, s.step, lat + (lat2 - lat) * s.step / m AS lat, lon + (lon2 - lon) * s.step / m AS lon FROM c, LATERAL (SELECT unnest(range(m)) AS step) AS s""")
def _(spark, sf):
    from terravox.operators.scaling import Ordered

    k = F.col("l_partkey")
    v = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("seg"), T.site_lat(k).alias("lat"), T.site_lon(k).alias("lon"))
    v = v.groupBy("line", "seg").agg(F.min(F.struct("lat", "lon")).alias("p")).select("line", "seg", "p.lat", "p.lon")
    n = Ordered(v, ["line"], "seg").lead(["lat", "lon"]).result().filter("next_lat IS NOT NULL")
    dlat, dlon = F.col("next_lat") - F.col("lat"), F.col("next_lon") - F.col("lon")
    km = spatial.KM_PER_DEG * F.sqrt(dlat * dlat + F.pow(dlon * F.cos(F.radians("lat")), F.lit(2.0)))
    m = F.greatest(F.lit(1), F.ceil(F.round(km / 2000.0, 9)))
    n = n.withColumn("m", m).withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    return n.select("line", "seg", "step", (F.col("lat") + dlat * F.col("step") / F.col("m")).alias("lat"), (F.col("lon") + dlon * F.col("step") / F.col("m")).alias("lon"))
