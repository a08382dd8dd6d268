"""Gridded-field algebra: normalise, validate, crop, thin, mask, rank and summarise shells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terravox.functions import geo
from terravox.operators import fields
from terravox.plans.registry import query
from terravox.sources import tables as T

CELLS = T.CELLS_SQL
# Array positions k and k + 1 play the two shear velocities; the last shell pairs with itself.
VS_SQL = """vs AS (
  SELECT model, j, i, lat, k, depth_km,
         sqrt((2 * pow(4 + anom / 10, 2) + pow(4 + coalesce(nxt, anom) / 10, 2)) / 3) AS v
  FROM (SELECT *, lead(anom) OVER (PARTITION BY model, j, i ORDER BY k) AS nxt FROM cells) AS x)"""


def velocity_columns(spark, sf):
    c = T.columns(spark, sf)
    pair = F.concat(F.slice("v", 2, T.NZ - 1), F.slice("v", T.NZ, 1))
    return c.withColumn("v", F.zip_with("v", pair, lambda a, b: fields.voigt(4 + a / 10, 4 + b / 10)))


@query("p1_voigt_average", "model:b,k:b,v_mean:d,v_min:d,v_max:d", "P1,S1", f"""
WITH {CELLS}, {VS_SQL}
SELECT model, k, avg(v) AS v_mean, min(v) AS v_min, max(v) AS v_max FROM vs GROUP BY model, k""")
def _(spark, sf):
    c = velocity_columns(spark, sf).select("model", F.posexplode("v").alias("k", "v"))
    return c.groupBy("model", "k").agg(F.avg("v").alias("v_mean"), F.min("v").alias("v_min"), F.max("v").alias("v_max"))


@query("p2_percent_anomaly", "model:b,k:b,j:b,i:b,pct:d", "P2", f"""
WITH {CELLS}, {VS_SQL}
SELECT model, k, j, i,
       greatest(-100.0::DOUBLE, least(100.0::DOUBLE, (v - avg(v) OVER s) * 100.0::DOUBLE / avg(v) OVER s)) AS pct
FROM vs WINDOW s AS (PARTITION BY model, k)""")
def _(spark, sf):
    c = fields.percent_anomaly(velocity_columns(spark, sf), T.NZ)
    return c.select("model", F.posexplode("v").alias("k", "pct"), "j", "i")


@query("p3_metres_to_km", "model:b,k:b,unit:s,depth_km:d", "P3", f"""
WITH {CELLS}, raw AS (
  SELECT model, k, CASE WHEN model % 2 = 0 THEN depth_km * 1000 ELSE depth_km END AS z FROM cells WHERE j = 0 AND i = 0),
top AS (SELECT model, max(abs(z)) AS zmax FROM raw GROUP BY model)
SELECT model, k, CASE WHEN zmax > 20000 THEN 'm' ELSE 'km' END AS unit,
       CASE WHEN zmax > 20000 THEN z / 1000 ELSE z END AS depth_km
FROM raw JOIN top USING (model)""")
def _(spark, sf):
    axis = T.columns(spark, sf).filter((F.col("j") == 0) & (F.col("i") == 0)).select("model", F.posexplode("v").alias("k", "x"))
    raw = axis.withColumn("z", F.when(F.col("model") % 2 == 0, T.depth_of(F.col("k")) * 1000).otherwise(T.depth_of(F.col("k"))))
    zmax = F.max(F.abs("z")).over(Window.partitionBy("model"))
    return raw.withColumn("metres", zmax > 2e4).select(
        "model", "k", F.when(F.col("metres"), "m").otherwise("km").alias("unit"),
        F.when(F.col("metres"), F.col("z") / 1000).otherwise(F.col("z")).alias("depth_km"),
    )


@query("p4_depth_crop_thin", "model:b,k:b,depth_km:d,n:b,mean_anom:d", "P4", f"""
WITH {CELLS}, ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY model ORDER BY depth_km) - 1 AS r FROM cells WHERE depth_km <= 2000)
SELECT model, k, depth_km, count(*) AS n, avg(anom) AS mean_anom FROM ranked WHERE r % 3 = 0 GROUP BY model, k, depth_km""")
def _(spark, sf):
    # The depth axis is ascending, so the rank of a kept shell is its array position: crop and
    # thin are a filter on the position, before the rows are multiplied.
    kept = F.filter(
        F.transform("v", lambda x, k: F.struct(k.alias("k"), x.alias("a"))),
        lambda s: (T.depth_of(s["k"]) <= 2000) & (s["k"] % 3 == 0),
    )
    c = T.columns(spark, sf).select("model", F.explode(kept).alias("s")).select("model", "s.k", "s.a")
    return c.groupBy("model", "k").agg(F.count("*").alias("n"), F.avg("a").alias("mean_anom")).withColumn(
        "depth_km", T.depth_of(F.col("k"))
    )


@query("p5_longitude_roll", "model:b,lon_180:d,new_i:b,old_i:b,n:b", "P5,F11", f"""
WITH {CELLS}, raw AS (SELECT DISTINCT model, i, lon + 180 AS lon360 FROM cols
                      UNION ALL SELECT DISTINCT model, {T.NLON}, 360.0::DOUBLE FROM cols),
kept AS (SELECT model, i, ((lon360 + 180) % 360 + 360) % 360 - 180 AS lon_180 FROM raw WHERE lon360 <> 360),
ord AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY lon_180) - 1 AS new_i FROM kept)
SELECT o.model, lon_180, new_i, o.i AS old_i, count(*) AS n
FROM ord AS o JOIN cols AS c ON c.model = o.model AND c.i = o.i GROUP BY o.model, lon_180, new_i, o.i""")
def _(spark, sf):
    c = T.columns(spark, sf).select("model", "i", (F.col("lon") + 180).alias("lon360"))
    axis = c.groupBy("model", "i", "lon360").agg(F.count("*").alias("n"))
    seam = axis.filter("i = 0").select("model", F.lit(T.NLON).alias("i"), F.lit(360.0).alias("lon360"), F.lit(0).alias("n"))
    kept = axis.unionByName(seam).filter("lon360 <> 360").withColumn("lon_180", geo.wrap180(F.col("lon360")))
    w = Window.partitionBy("model").orderBy("lon_180")
    return kept.select("model", "lon_180", (F.row_number().over(w) - 1).alias("new_i"), F.col("i").alias("old_i"), "n")


@query("p6_wrap_meridian_check", "model:b,n_lon:b,dropped:b,spacing:d,uniform:t", "P6", f"""
WITH {CELLS}, raw AS (SELECT DISTINCT model, i, lon FROM cols UNION ALL SELECT DISTINCT model, {T.NLON}, 180.0::DOUBLE FROM cols),
b AS (SELECT model, lon, lon - min(lon) OVER (PARTITION BY model) >= 360 - 1e-9 AS twice FROM raw),
g AS (SELECT model, lon, twice, lon - lag(lon) OVER (PARTITION BY model ORDER BY lon) AS gap FROM b)
SELECT model, count(*) FILTER (WHERE NOT twice) AS n_lon, count(*) FILTER (WHERE twice) AS dropped,
       median(gap) FILTER (WHERE NOT twice) AS spacing,
       max(gap) FILTER (WHERE NOT twice) - min(gap) FILTER (WHERE NOT twice) <= 1e-3 * median(gap) FILTER (WHERE NOT twice) AS uniform
FROM g GROUP BY model""")
def _(spark, sf):
    c = T.columns(spark, sf).groupBy("model", "i", "lon").agg(F.count("*").alias("n"))
    seam = c.filter("i = 0").select("model", F.lit(T.NLON).alias("i"), F.lit(180.0).alias("lon"), "n")
    c = c.unionByName(seam)
    w = Window.partitionBy("model")
    c = c.withColumn("twice", F.col("lon") - F.min("lon").over(w) >= 360 - 1e-9)
    c = c.withColumn("gap", F.col("lon") - F.lag("lon").over(w.orderBy("lon")))
    gap = F.when(~F.col("twice"), F.col("gap"))
    out = c.groupBy("model").agg(
        F.count_if(~F.col("twice")).alias("n_lon"), F.count_if("twice").alias("dropped"),
        F.median(gap).alias("spacing"), (F.max(gap) - F.min(gap)).alias("spread"),
    )
    ok = F.col("spread") <= 1e-3 * F.col("spacing")
    refuse = F.raise_error(F.lit("longitude spacing is not uniform")).cast("boolean")
    return out.withColumn("uniform", F.when(ok, ok).otherwise(refuse))


@query("p7_channel_selection", "model:b,channel:s,k:b,mean_a:d,min_a:d", "P7,P8,J21", f"""
WITH {CELLS}, m AS (SELECT *, avg(anom) OVER (PARTITION BY model, j, i) AS bg FROM cells),
x AS (SELECT model, k, ch, CASE ch WHEN 'anom' THEN anom WHEN 'contrast' THEN anom - bg ELSE least(anom, anom - bg) END AS a
      FROM m, (VALUES ('anom'), ('contrast'), ('min')) AS t(ch))
SELECT model, ch AS channel, k, avg(greatest(-6.0::DOUBLE, least(6.0::DOUBLE, a))) AS mean_a,
       min(greatest(-6.0::DOUBLE, least(6.0::DOUBLE, a))) AS min_a FROM x GROUP BY model, ch, k""")
def _(spark, sf):
    c = T.columns(spark, sf).withColumn("bg", F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / T.NZ)
    c = c.select("model", "bg", F.posexplode("v").alias("k", "anom"))
    c = c.withColumn("channel", F.explode(F.array(F.lit("anom"), F.lit("contrast"), F.lit("min"))))
    a = fields.clip(fields.channel(F.col("anom"), F.col("anom") - F.col("bg"), F.col("channel")), fields.CHANNEL_CLIP)
    return c.groupBy("model", "channel", "k").agg(F.avg(a).alias("mean_a"), F.min(a).alias("min_a"))


@query("p9_percentile_mask", "model:b,k:b,j:b,i:b,anom:d", "P9,A6", f"""
WITH {CELLS}, t AS (SELECT model, k, quantile_cont(anom, 0.1) AS cut FROM cells GROUP BY model, k)
SELECT model, k, j, i, anom FROM cells JOIN t USING (model, k) WHERE anom <= cut""")
def _(spark, sf):
    c = T.cells(spark, sf)
    return c.join(fields.shell_percentiles(c, {"cut": 0.1}), ["model", "k"]).filter("anom <= cut")


@query("p10_continuity_ban", "model:b,k:b,level:b,cut:d,banned:b,allowed:b", "P10,G19", f"""
WITH {CELLS}, t AS (SELECT model, k, level, quantile_cont(anom, [0.35, 0.5, 0.75, 1.0])[idx] AS cut
  FROM cells, (VALUES (35, 1), (50, 2), (75, 3), (100, 4)) AS l(level, idx) GROUP BY model, k, level, idx)
SELECT model, k, level, max(cut) AS cut, count(*) FILTER (WHERE anom > cut) AS banned,
       count(*) FILTER (WHERE NOT anom > cut) AS allowed
FROM cells JOIN t USING (model, k) GROUP BY model, k, level""")
def _(spark, sf):
    c = T.cells(spark, sf)
    cuts = fields.shell_percentiles(c, {"p35": 0.35, "p50": 0.5, "p75": 0.75, "p100": 1.0})
    j = c.join(cuts, ["model", "k"])
    levels = {35: "p35", 50: "p50", 75: "p75", 100: "p100"}
    g = j.groupBy("model", "k").agg(
        F.count("*").alias("n"),
        *[F.max(n).alias(n) for n in levels.values()],
        *[F.count_if(F.col("anom") > F.col(n)).alias("b" + n) for n in levels.values()],
    )
    rows = F.array(*[F.struct(F.lit(p).alias("level"), F.col(n).alias("cut"), F.col("b" + n).alias("banned")) for p, n in levels.items()])
    return g.select("model", "k", "n", F.explode(rows).alias("r")).select("model", "k", "r.*", (F.col("n") - F.col("r.banned")).alias("allowed"))


@query("p11_depth_band_filter", "model:b,band:s,n:b,mean_anom:d", "P11,A1", f"""
WITH {CELLS}, b(band, lo, hi, closed) AS (VALUES ('upper', 0, 660, false), ('mid', 660, 1500, false), ('lower', 1500, 2835, true))
SELECT model, band, count(*) AS n, avg(anom) AS mean_anom FROM cells JOIN b
  ON depth_km >= lo AND (depth_km < hi OR (closed AND depth_km = hi)) GROUP BY model, band""")
def _(spark, sf):
    d = F.col("depth_km")
    band = F.when((d >= 0) & (d < 660), "upper").when((d >= 660) & (d < 1500), "mid").when((d >= 1500) & (d <= 2835), "lower")
    c = T.cells(spark, sf).withColumn("band", band).filter("band IS NOT NULL")
    return c.groupBy("model", "band").agg(F.count("*").alias("n"), F.avg("anom").alias("mean_anom"))


@query("p12_disc_exclusion", "model:b,k:b,excluded:b,kept:b", "P12,F1", f"""
WITH {CELLS}
SELECT model, k, count(*) FILTER (WHERE {T.arc_sql('0.0', '0.0', 'lat', 'lon')} <= 2500 AND depth_km >= 1500) AS excluded,
       count(*) FILTER (WHERE NOT ({T.arc_sql('0.0', '0.0', 'lat', 'lon')} <= 2500 AND depth_km >= 1500)) AS kept
FROM cells GROUP BY model, k""")
def _(spark, sf):
    c = T.cells(spark, sf)
    out = (geo.arc_km(F.lit(0.0), F.lit(0.0), F.col("lat"), F.col("lon")) <= 2500) & (F.col("depth_km") >= 1500)
    return c.groupBy("model", "k").agg(F.count_if(out).alias("excluded"), F.count_if(~out).alias("kept"))


@query("p16_nearest_cell_gather", "kind:s,site:b,model:b,j:b,i:b,anom_400:d,anom_2000:d", "P16,J14", f"""
WITH {CELLS}, {T.SITES_SQL}, ix AS (
  SELECT kind, site, least(19, greatest(0, ceil((lat + 90 - 4.5) / 9 - 0.5)))::BIGINT AS j,
         ((ceil(round((lon + 180) / 14.4, 9) - 0.5)::BIGINT % 25) + 25) % 25 AS i FROM places)
SELECT kind, site, c.model, ix.j, ix.i, embedding[10]::DOUBLE * 10 AS anom_400, embedding[45]::DOUBLE * 10 AS anom_2000
FROM ix JOIN cols AS c ON c.j = ix.j AND c.i = ix.i""", every="kind")
def _(spark, sf):
    # On a regular grid the nearest cell is index arithmetic (a half-way point goes to the lower
    # index); the places are at most 3,600 per kind and are broadcast after a check.
    from terravox.operators.scaling import broadcast_if_small

    s = T.places(T.hotspots(spark, sf).unionByName(T.nulls(spark, sf)))
    j = F.ceil((F.col("lat") + 90 - T.DLAT / 2) / T.DLAT - 0.5)
    i = F.ceil(F.round((F.col("lon") + 180) / T.DLON, 9) - 0.5)
    s = s.select("kind", "site", F.least(F.lit(T.NLAT - 1), F.greatest(F.lit(0), j)).cast("int").alias("j"),
                 F.pmod(i, F.lit(T.NLON)).cast("int").alias("i"))
    at = lambda z: F.element_at("v", int(z / T.DZ_KM + 0.5) + 1)
    side, _ = broadcast_if_small(s)
    c = T.columns(spark, sf).select("model", "j", "i", at(400).alias("anom_400"), at(2000).alias("anom_2000"))
    return c.join(side, ["j", "i"])


@query("p17_site_window", "site:b,model:b,k:b,n_cells:b,min_anom:d", "P17", f"""
WITH {CELLS}, {T.SITES_SQL}, h AS (SELECT site, lat AS slat, lon AS slon FROM places WHERE kind = 'hotspot')
SELECT site, model, k, count(*) AS n_cells, min(anom) AS min_anom FROM h JOIN cells
  ON abs(lat - slat) <= 20 AND abs(((lon - slon + 180) % 360 + 360) % 360 - 180) <= 20 / greatest(cos(radians(slat)), 0.25::DOUBLE)
GROUP BY site, model, k""", every="hotspot")
def _(spark, sf):
    from terravox.operators.scaling import broadcast_if_small

    h = T.places(T.hotspots(spark, sf)).select("site", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    # Equi key: the grid rows the window covers.
    row = lambda x: F.least(F.lit(T.NLAT - 1), F.greatest(F.lit(0), x)).cast("int")
    lo, hi = F.ceil((F.col("slat") - 20 + 90) / T.DLAT - 0.5), F.floor((F.col("slat") + 20 + 90) / T.DLAT - 0.5)
    h = h.withColumn("j", F.explode(F.sequence(row(lo), row(hi))))
    side, _ = broadcast_if_small(h)
    c = T.columns(spark, sf).select("model", "j", "lat", "lon", "v")
    wide = 20 / F.greatest(F.cos(F.radians("slat")), F.lit(0.25))
    m = c.join(side, "j").filter((F.abs(F.col("lat") - F.col("slat")) <= 20) & (F.abs(geo.wrap180(F.col("lon") - F.col("slon"))) <= wide))
    # The smallest value of every shell in one aggregate over whole columns; shells unfold at the end.
    g = m.groupBy("site", "model").agg(F.count("*").alias("n_cells"), F.array(*[F.min(F.col("v")[k]) for k in range(T.NZ)]).alias("least"))
    return g.select("site", "model", "n_cells", F.posexplode("least").alias("k", "min_anom"))


@query("a8_area_weighted_quantile", "model:b,k:b,q10:d,q50:d", "A8,W5", f"""
WITH {CELLS}, p AS (
  SELECT model, k, anom, j, i, (sum(w) OVER (PARTITION BY model, k ORDER BY anom, j, i ROWS UNBOUNDED PRECEDING) - w / 2)
         / sum(w) OVER (PARTITION BY model, k) AS pos FROM (SELECT *, cos(radians(lat)) AS w FROM cells) AS x),
n AS (SELECT *, lead(anom) OVER s AS a1, lead(pos) OVER s AS p1, lag(pos) OVER s AS p0 FROM p WINDOW s AS (PARTITION BY model, k ORDER BY anom, j, i))
SELECT model, k,
  max(CASE WHEN p0 IS NULL AND 0.1 <= pos THEN anom WHEN p1 IS NULL AND 0.1 >= pos THEN anom
           WHEN 0.1 >= pos AND 0.1 < p1 THEN anom + (a1 - anom) * (0.1 - pos) / (p1 - pos) END) AS q10,
  max(CASE WHEN p0 IS NULL AND 0.5 <= pos THEN anom WHEN p1 IS NULL AND 0.5 >= pos THEN anom
           WHEN 0.5 >= pos AND 0.5 < p1 THEN anom + (a1 - anom) * (0.5 - pos) / (p1 - pos) END) AS q50
FROM n GROUP BY model, k""")
def _(spark, sf):
    c = T.cells(spark, sf).withColumn("w", fields.area_weight(F.col("lat")))
    return fields.weighted_quantile(c, ["model", "k"], "anom", "w", {"q10": 0.1, "q50": 0.5})


@query("a9_weighted_shell_comparison", "k:b,n:b,mean_w:d,rms:d,corr_w:d,rms_north:d,rms_south:d", "A9,C23,A15", f"""
WITH {CELLS}, x AS (SELECT k, lat, anom AS a, lead(anom) OVER (PARTITION BY model, j, i ORDER BY k) AS b, cos(radians(lat)) AS w FROM cells),
m AS (SELECT *, CASE WHEN b IS NULL THEN 0 ELSE w END AS u FROM x WHERE b IS NOT NULL),
s AS (SELECT k, count(*) AS n, sum(u) AS su, sum(u * a) AS sa, sum(u * b) AS sb, sum(u * a * b) AS sab, sum(u * a * a) AS saa,
      sum(u * b * b) AS sbb, sum(u * (a - b) * (a - b)) AS sd,
      sum(u * (a - b) * (a - b)) FILTER (WHERE lat > 0) / sum(u) FILTER (WHERE lat > 0) AS dn,
      sum(u * (a - b) * (a - b)) FILTER (WHERE lat <= 0) / sum(u) FILTER (WHERE lat <= 0) AS ds FROM m GROUP BY k)
SELECT k, n, sa / su AS mean_w, sqrt(sd / su) AS rms, (sab / su - sa / su * sb / su)
  / sqrt((saa / su - pow(sa / su, 2)) * (sbb / su - pow(sb / su, 2))) AS corr_w, sqrt(dn) AS rms_north, sqrt(ds) AS rms_south FROM s""")
def _(spark, sf):
    # Each shell against the next one down: the pairing is an array zip, the statistics one
    # aggregate with map-side partial sums.
    c = T.columns(spark, sf)
    pairs = F.arrays_zip(F.slice("v", 1, T.NZ - 1).alias("a"), F.slice("v", 2, T.NZ - 1).alias("b"))
    m = c.select("lat", fields.area_weight(F.col("lat")).alias("u"), F.posexplode(pairs).alias("k", "p"))
    m = m.select("k", "lat", "u", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    u, a, b = F.col("u"), F.col("a"), F.col("b")
    d2 = u * (a - b) * (a - b)
    north = F.col("lat") > 0
    g = m.groupBy("k").agg(
        F.count("*").alias("n"), F.sum("u").alias("su"), F.sum(u * a).alias("sa"), F.sum(u * b).alias("sb"),
        F.sum(u * a * b).alias("sab"), F.sum(u * a * a).alias("saa"), F.sum(u * b * b).alias("sbb"), F.sum(d2).alias("sd"),
        (F.sum(F.when(north, d2)) / F.sum(F.when(north, u))).alias("dn"),
        (F.sum(F.when(~north, d2)) / F.sum(F.when(~north, u))).alias("ds"),
    )
    ma, mb = F.col("sa") / F.col("su"), F.col("sb") / F.col("su")
    cov = F.col("sab") / F.col("su") - ma * mb
    var = lambda s, mean: F.col(s) / F.col("su") - mean * mean
    return g.select("k", "n", ma.alias("mean_w"), F.sqrt(F.col("sd") / F.col("su")).alias("rms"),
                    (cov / F.sqrt(var("saa", ma) * var("sbb", mb))).alias("corr_w"),
                    F.sqrt("dn").alias("rms_north"), F.sqrt("ds").alias("rms_south"))


@query("a15_shell_rms", "model:b,k:b,rms:d", "A15", f"""
WITH {CELLS} SELECT model, k, sqrt(avg(anom * anom)) AS rms FROM cells GROUP BY model, k""")
def _(spark, sf):
    return T.cells(spark, sf).groupBy("model", "k").agg(F.sqrt(F.avg(F.col("anom") * F.col("anom"))).alias("rms"))


@query("a16_depth_window_mean", "model:b,j:b,i:b,mean_deep:d,min_deep:d", "A16,A2", f"""
WITH {CELLS} SELECT model, j, i, avg(anom) AS mean_deep, min(anom) AS min_deep FROM cells
WHERE depth_km BETWEEN 2000 AND 2800 GROUP BY model, j, i""")
def _(spark, sf):
    deep = F.filter(F.transform("v", lambda x, k: F.when(T.depth_of(k).between(2000, 2800), x)), lambda x: x.isNotNull())
    c = T.columns(spark, sf).withColumn("w", deep)
    return c.select("model", "j", "i", (F.aggregate("w", F.lit(0.0), lambda s, x: s + x) / F.size("w")).alias("mean_deep"),
                    F.array_min("w").alias("min_deep"))


@query("a17_min_over_depth_bin", "model:b,bin:b,j:b,i:b,amin:d", "A17", f"""
WITH {CELLS} SELECT model, floor(depth_km / 200)::BIGINT AS bin, j, i, min(anom) AS amin FROM cells GROUP BY model, bin, j, i""")
def _(spark, sf):
    per = F.transform(F.sequence(F.lit(0), F.lit(int((T.NZ - 1) * T.DZ_KM // 200))), lambda b: F.struct(
        b.alias("bin"), F.array_min(F.filter("v", lambda x, k: F.floor(T.depth_of(k) / 200) == b)).alias("amin")))
    return T.columns(spark, sf).select("model", "j", "i", F.explode(per).alias("r")).select("model", "r.bin", "j", "i", "r.amin")


@query("a18_block_coarsen", "model:b,bk:b,bj:b,bi:b,amean:d,any_slow:t", "A18,A25", f"""
WITH {CELLS} SELECT model, floor(depth_km / 400)::BIGINT AS bk, floor((lat + 90) / 30)::BIGINT AS bj,
  floor((lon + 180) / 45)::BIGINT AS bi, avg(anom) AS amean, bool_or(anom < -2) AS any_slow FROM cells GROUP BY ALL""")
def _(spark, sf):
    c = T.cells(spark, sf)
    return c.groupBy("model", F.floor(F.col("depth_km") / 400).alias("bk"), F.floor((F.col("lat") + 90) / 30).alias("bj"),
                     F.floor((F.col("lon") + 180) / 45).alias("bi")).agg(
        F.avg("anom").alias("amean"), F.bool_or(F.col("anom") < -2).alias("any_slow"))


@query("c24_shell_consistency", "model:b,n_shells:b,median_p999:d,worst_ratio:d,consistent:t", "C24,A6", f"""
WITH {CELLS}, s AS (SELECT model, k, quantile_cont(abs(anom), 0.999) AS p FROM cells WHERE depth_km >= 300 GROUP BY model, k),
m AS (SELECT model, median(p) AS med, count(*) AS n, max(p) AS worst FROM s GROUP BY model)
SELECT model, n AS n_shells, med AS median_p999, worst / med AS worst_ratio, NOT (n >= 5 AND worst > 4 * med) AS consistent FROM m""")
def _(spark, sf):
    c = T.cells(spark, sf).filter("depth_km >= 300").withColumn("m", F.abs("anom"))
    s = fields.shell_percentiles(c, {"p": 0.999}, "m")
    g = s.groupBy("model").agg(F.median("p").alias("median_p999"), F.count("*").alias("n_shells"), F.max("p").alias("w"))
    odd = (F.col("n_shells") >= 5) & (F.col("w") > 4 * F.col("median_p999"))
    refuse = F.raise_error(F.concat(F.lit("inconsistent shells in model "), F.col("model").cast("string"))).cast("boolean")
    return g.withColumn("consistent", F.when(odd, refuse).otherwise(F.lit(True))).withColumn("worst_ratio", F.col("w") / F.col("median_p999"))


@query("g38_contrast_prominence", "model:b,k:b,mean_contrast:d,min_contrast:d,max_prominence:d", "G38,D4", f"""
WITH {CELLS}, bg AS (SELECT *, avg(anom) OVER (PARTITION BY model, k, j) AS smooth FROM cells)
SELECT model, k, avg(anom - smooth) AS mean_contrast, min(anom - smooth) AS min_contrast, max(smooth - anom) AS max_prominence
FROM bg GROUP BY model, k""")
def _(spark, sf):
    # Background here is the zonal mean; the spherical Gaussian background has its own query.
    c = T.columns(spark, sf)
    bg = c.groupBy("model", "j").agg(*[F.avg(F.col("v")[k]).alias(f"m{k}") for k in range(T.NZ)])
    bg = bg.select("model", "j", F.array(*[f"m{k}" for k in range(T.NZ)]).alias("bg"))
    d = c.join(bg, ["model", "j"]).select("model", F.posexplode(F.zip_with("v", "bg", lambda a, m: a - m)).alias("k", "c"))
    return d.groupBy("model", "k").agg(F.avg("c").alias("mean_contrast"), F.min("c").alias("min_contrast"), F.max(-F.col("c")).alias("max_prominence"))
