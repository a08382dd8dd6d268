"""Runs, ladders and walks along depth, one profile per map cell or per site."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravox.functions import geo
from terravox.operators import fields, profiles, spatial
from terravox.plans.registry import query
from terravox.plans.spatial_queries import CAP_KM, all_places
from terravox.sources import tables as T

CELLS, SITES = T.CELLS_SQL, T.SITES_SQL
SLOW = -0.5  # per cent; the threshold of the fixture profiles
FLAG_SQL = f"f AS (SELECT model, j, i, k, depth_km, anom, anom < {SLOW} AS on_ FROM cells)"


def flagged(spark, sf):
    return T.columns(spark, sf).withColumn("on", F.transform("v", lambda x: x < SLOW))


@query("w6_longest_run", "model:b,j:b,i:b,tube_km:d,z_top:d,z_bot:d,mean_in_run:d", "W6", f"""
WITH {CELLS}, {FLAG_SQL}, g AS (SELECT *, k - row_number() OVER (PARTITION BY model, j, i, on_ ORDER BY k) AS grp FROM f),
r AS (SELECT model, j, i, min(k) AS k0, count(*) AS n, avg(anom) AS m FROM g WHERE on_ GROUP BY model, j, i, grp),
b AS (SELECT *, row_number() OVER (PARTITION BY model, j, i ORDER BY n DESC, k0) AS rn FROM r)
SELECT c.model, c.j, c.i, coalesce(n, 0) * 45.0 AS tube_km, k0 * 45.0 AS z_top, (k0 + n - 1) * 45.0 AS z_bot, m AS mean_in_run
FROM cols AS c LEFT JOIN (SELECT * FROM b WHERE rn = 1) AS b ON b.model = c.model AND b.j = c.j AND b.i = c.i""")
def _(spark, sf):
    c = flagged(spark, sf).withColumn("r", profiles.longest_run(F.col("on")))
    some = F.col("r.length") > 0
    seg = F.slice("v", F.greatest(F.col("r.start"), F.lit(0)) + 1, F.greatest(F.col("r.length"), F.lit(1)))
    return c.select("model", "j", "i", (F.col("r.length") * T.DZ_KM).alias("tube_km"),
                    F.when(some, F.col("r.start") * T.DZ_KM).alias("z_top"),
                    F.when(some, (F.col("r.start") + F.col("r.length") - 1) * T.DZ_KM).alias("z_bot"),
                    F.when(some, F.aggregate(seg, F.lit(0.0), lambda s, x: s + x) / F.col("r.length")).alias("mean_in_run"))


@query("w7_gap_tolerant_walk", "model:b,j:b,i:b,frac_below:d,longest_gap_km:d,reach_km:d", "W7,G32,G33", f"""
WITH {CELLS}, {FLAG_SQL}, up AS (SELECT *, 63 - k AS p FROM f),
l AS (SELECT *, max(CASE WHEN on_ THEN p ELSE -1 END) OVER (PARTITION BY model, j, i ORDER BY p ROWS UNBOUNDED PRECEDING) AS last_on FROM up),
s AS (SELECT model, j, i, min(CASE WHEN p - last_on > 2 THEN p END) AS stop FROM l GROUP BY model, j, i),
w AS (SELECT l.model, l.j, l.i, max(CASE WHEN on_ AND (stop IS NULL OR p < stop) THEN p END) AS last_p, bool_or(p = 0 AND on_) AS rooted,
      avg(on_::INT) AS frac, max(p - last_on) AS gap FROM l JOIN s ON l.model = s.model AND l.j = s.j AND l.i = s.i GROUP BY l.model, l.j, l.i)
SELECT model, j, i, frac AS frac_below, gap * 45.0 AS longest_gap_km, CASE WHEN rooted THEN (63 - last_p) * 45.0 END AS reach_km FROM w""")
def _(spark, sf):
    c = flagged(spark, sf).withColumn("up", F.reverse("on"))
    reach = profiles.gap_tolerant_reach(F.col("up"), 2)
    gap = profiles.longest_run(F.transform("on", lambda x: ~x))["length"]
    return c.select("model", "j", "i", (F.size(F.filter("on", lambda x: x)) / F.size("on")).alias("frac_below"),
                    (gap * T.DZ_KM).alias("longest_gap_km"), ((T.NZ - 1 - reach) * T.DZ_KM).alias("reach_km"))


LADDER = [9, 18, 27, 36, 45, 54, 62]
LADDER_SQL = "lad AS (SELECT * FROM f WHERE k IN (9, 18, 27, 36, 45, 54, 62))"


@query("w8_depth_ladder", "model:b,j:b,i:b,base_connected_from_km:d,lost_below_km:d,deepest_km:d,n_levels:b,pattern:s", "W8,W9,G21", f"""
WITH {CELLS}, {FLAG_SQL}, {LADDER_SQL},
s AS (SELECT *, min(on_::INT) OVER (PARTITION BY model, j, i ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS tail FROM lad)
SELECT model, j, i, min(CASE WHEN tail = 1 THEN depth_km END) AS base_connected_from_km,
  CASE WHEN NOT bool_or(k = 62 AND on_) AND bool_or(on_) THEN max(CASE WHEN on_ THEN depth_km END) END AS lost_below_km,
  coalesce(max(CASE WHEN on_ THEN depth_km END), 0) AS deepest_km, sum(on_::INT) AS n_levels,
  string_agg(CASE WHEN on_ THEN '1' ELSE '0' END, '' ORDER BY k) AS pattern FROM s GROUP BY model, j, i""")
def _(spark, sf):
    c = T.columns(spark, sf).withColumn("on", F.array(*[F.col("v")[k] < SLOW for k in LADDER]))
    z = F.array(*[F.lit(k * T.DZ_KM) for k in LADDER])
    n, tail = len(LADDER), profiles.leading_run(F.reverse("on"))
    c = c.withColumn("tail", tail).withColumn("deep", F.array_max(F.zip_with("on", z, lambda o, d: F.when(o, d))))
    based = F.col("on")[n - 1]
    return c.select(
        "model", "j", "i", F.when(F.col("tail") > 0, F.element_at(z, n + 1 - F.greatest(F.col("tail"), F.lit(1)))).alias("base_connected_from_km"),
        F.when(~based, F.col("deep")).alias("lost_below_km"), F.coalesce("deep", F.lit(0.0)).alias("deepest_km"),
        F.size(F.filter("on", lambda x: x)).alias("n_levels"), F.array_join(F.transform("on", lambda x: x.cast("int").cast("string")), "").alias("pattern"))


@query("w11_branching_counts", "model:b,splits:b,merges:b,sustained_from_km:d", "W11,W13", f"""
WITH {CELLS}, n AS (SELECT model, k, count(*) FILTER (WHERE anom < -2) AS c FROM cells GROUP BY model, k),
d AS (SELECT *, c - lag(c) OVER (PARTITION BY model ORDER BY k DESC) AS dc FROM n),
h AS (SELECT *, k + row_number() OVER (PARTITION BY model, c >= 45 ORDER BY k DESC) AS grp FROM n),
r AS (SELECT model, max(k) AS ktop, count(*) AS len FROM h WHERE c >= 45 GROUP BY model, grp HAVING count(*) >= 3)
SELECT d.model, coalesce(sum(dc) FILTER (WHERE dc > 0), 0) AS splits, coalesce(-sum(dc) FILTER (WHERE dc < 0), 0) AS merges,
       (SELECT max(ktop) * 45.0 FROM r WHERE r.model = d.model) AS sustained_from_km FROM d GROUP BY d.model""")
def _(spark, sf):
    c = T.columns(spark, sf)
    n = c.groupBy("model").agg(*[F.count_if(F.col("v")[k] < -2).alias(f"c{k}") for k in range(T.NZ)])
    n = n.select("model", F.array(*[f"c{k}" for k in reversed(range(T.NZ))]).alias("up"))
    splits, merges = profiles.rises_and_falls(F.col("up"))
    at = profiles.first_sustained(F.transform("up", lambda x: x >= 45), 3)
    return n.select("model", splits.alias("splits"), merges.alias("merges"), ((T.NZ - 1 - at) * T.DZ_KM).alias("sustained_from_km"))


@query("w14_pile_thickness", "model:b,j:b,i:b,pile_km:d", "W14,G30", f"""
WITH {CELLS}, f AS (SELECT *, min((anom <= 0)::INT) OVER (PARTITION BY model, j, i ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS alive FROM cells)
SELECT model, j, i, sum(alive) * 45.0 AS pile_km FROM f GROUP BY model, j, i""")
def _(spark, sf):
    run = profiles.leading_run(F.reverse(F.transform("v", lambda x: x <= 0)))
    return T.columns(spark, sf).select("model", "j", "i", (run * T.DZ_KM).alias("pile_km"))


@query("w18_window_mean", "model:b,j:b,i:b,k:b,m4:d", "W18,G5", f"""
WITH {CELLS}, w AS (SELECT *, avg(anom) OVER (PARTITION BY model, j, i ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS m4 FROM cells)
SELECT model, j, i, k, m4 FROM w WHERE k <= 59""")
def _(spark, sf):
    mean = F.transform(F.sequence(F.lit(1), F.lit(T.NZ - 4)), lambda p: F.aggregate(F.slice("v", p, F.lit(5)), F.lit(0.0), lambda s, x: s + x) / 5)
    return T.columns(spark, sf).select("model", "j", "i", F.posexplode(mean).alias("k", "m4"))


@query("g32_column_continuity", "kind:s,site:b,model:b,frac_below:d,longest_gap_km:d,reach_km:d,base_anom:d", "G32,J9,W7", f"""
WITH {CELLS}, {SITES}, near AS (SELECT p.kind, p.site, c.model, c.j, c.i FROM places AS p JOIN cols AS c ON {T.arc_sql('p.lat', 'p.lon', 'c.lat', 'c.lon')} <= {CAP_KM}),
prof AS (SELECT kind, site, n.model, k, min(anom) AS a FROM near AS n JOIN cells AS c ON c.model = n.model AND c.j = n.j AND c.i = n.i GROUP BY ALL),
up AS (SELECT *, 63 - k AS p, a < -2.4 AS on_ FROM prof),
l AS (SELECT *, max(CASE WHEN on_ THEN p ELSE -1 END) OVER (PARTITION BY kind, site, model ORDER BY p ROWS UNBOUNDED PRECEDING) AS last_on FROM up),
s AS (SELECT *, min(CASE WHEN p - last_on > 1 THEN p END) OVER (PARTITION BY kind, site, model) AS stop FROM l)
SELECT kind, site, model, avg(on_::INT) AS frac_below, max(p - last_on) * 45.0 AS longest_gap_km,
  CASE WHEN bool_or(p = 0 AND on_) THEN (63 - max(CASE WHEN on_ AND (stop IS NULL OR p < stop) THEN p END)) * 45.0 END AS reach_km,
  max(CASE WHEN p = 0 THEN a END) AS base_anom FROM s GROUP BY kind, site, model""", every="kind")
def _(spark, sf):
    m = spatial.radius_join(T.columns(spark, sf), all_places(spark, sf), CAP_KM)
    # The profile is aggregated as one array slot per shell: cells of a cap are never collected.
    g = m.groupBy(F.col("p_kind").alias("kind"), F.col("p_site").alias("site"), "model").agg(*[F.min(F.col("v")[k]).alias(f"m{k}") for k in range(T.NZ)])
    g = g.select("kind", "site", "model", F.array(*[f"m{k}" for k in range(T.NZ)]).alias("p"))
    g = g.withColumn("on", F.transform("p", lambda x: x < -2.4))
    gap = profiles.longest_run(F.transform("on", lambda x: ~x))["length"]
    reach = profiles.gap_tolerant_reach(F.reverse("on"), 1)
    return g.select("kind", "site", "model", (F.size(F.filter("on", lambda x: x)) / T.NZ).alias("frac_below"), (gap * T.DZ_KM).alias("longest_gap_km"),
                    ((T.NZ - 1 - reach) * T.DZ_KM).alias("reach_km"), F.col("p")[T.NZ - 1].alias("base_anom"))


@query("g33_root_depth_walk", "model:b,j:b,i:b,root_km:d,root_km_fixed:d,deep_frac:d", "G33,A6,W7", f"""
WITH {CELLS}, q AS (SELECT model, k, quantile_cont(anom, 0.4) AS cut FROM cells GROUP BY model, k),
f AS (SELECT model, j, i, k, anom <= cut AS a, anom <= -0.3 AS b FROM cells JOIN q USING (model, k)),
l AS (SELECT *, max(CASE WHEN a THEN k ELSE -1 END) OVER w AS la, max(CASE WHEN b THEN k ELSE -1 END) OVER w AS lb FROM f WINDOW w AS (PARTITION BY model, j, i ORDER BY k ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, min(CASE WHEN k - la > 2 THEN k END) OVER (PARTITION BY model, j, i) AS sa, min(CASE WHEN k - lb > 2 THEN k END) OVER (PARTITION BY model, j, i) AS sb FROM l)
SELECT model, j, i, CASE WHEN bool_or(k = 0 AND a) THEN max(CASE WHEN a AND (sa IS NULL OR k < sa) THEN k END) * 45.0 END AS root_km,
  CASE WHEN bool_or(k = 0 AND b) THEN max(CASE WHEN b AND (sb IS NULL OR k < sb) THEN k END) * 45.0 END AS root_km_fixed,
  avg(a::INT) FILTER (WHERE k >= 45) AS deep_frac FROM s GROUP BY model, j, i""")
def _(spark, sf):
    c = T.columns(spark, sf)
    # Shell percentiles as one array per model: the map cells stay whole rows.
    cut = c.groupBy("model").agg(*[F.percentile(F.col("v")[k], F.lit(0.4)).alias(f"q{k}") for k in range(T.NZ)])
    cut = cut.select("model", F.array(*[f"q{k}" for k in range(T.NZ)]).alias("cut"))
    c = c.join(cut, "model").withColumn("a", F.zip_with("v", "cut", lambda x, y: x <= y)).withColumn("b", F.transform("v", lambda x: x <= -0.3))
    deep = F.slice("a", 46, T.NZ - 45)
    return c.select("model", "j", "i", (profiles.gap_tolerant_reach(F.col("a"), 2) * T.DZ_KM).alias("root_km"),
                    (profiles.gap_tolerant_reach(F.col("b"), 2) * T.DZ_KM).alias("root_km_fixed"),
                    (F.size(F.filter(deep, lambda x: x)) / F.size(deep)).alias("deep_frac"))


@query("a12_shape_anisotropy", "model:b,k:b,area:d,elongation:d,width:d", "A12,F10", f"""
WITH {CELLS}, c AS (SELECT model, k, cos(radians(lat)) * -anom AS w, lat AS y, lon * cos(radians(lat)) AS x FROM cells WHERE anom < -1),
m AS (SELECT *, sum(w * x) OVER g / sum(w) OVER g AS mx, sum(w * y) OVER g / sum(w) OVER g AS my FROM c WINDOW g AS (PARTITION BY model, k)),
s AS (SELECT model, k, sum(w) AS area, sum(w * (x - mx) * (x - mx)) / sum(w) AS xx, sum(w * (y - my) * (y - my)) / sum(w) AS yy, sum(w * (x - mx) * (y - my)) / sum(w) AS xy FROM m GROUP BY model, k),
e AS (SELECT *, sqrt(greatest(pow(xx + yy, 2) - 4 * (xx * yy - xy * xy), 0)) AS r, pow(9.0 / 2, 2) AS floor_ FROM s)
SELECT model, k, area, sqrt(greatest((xx + yy + r) / 2, floor_) / greatest((xx + yy - r) / 2, floor_)) AS elongation, 2 * sqrt(area / pi()) AS width FROM e""")
def _(spark, sf):
    c = T.cells(spark, sf).filter("anom < -1").withColumn("w", fields.area_weight(F.col("lat")) * -F.col("anom"))
    c = c.withColumn("x", F.col("lon") * F.cos(F.radians("lat"))).withColumn("y", F.col("lat"))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    # Raw second moments in one aggregate; the centred ones follow algebraically.
    g = c.groupBy("model", "k").agg(F.sum("w").alias("area"), (F.sum(w * x) / F.sum("w")).alias("mx"), (F.sum(w * y) / F.sum("w")).alias("my"),
                                    (F.sum(w * x * x) / F.sum("w")).alias("sxx"), (F.sum(w * y * y) / F.sum("w")).alias("syy"), (F.sum(w * x * y) / F.sum("w")).alias("sxy"))
    xx, yy, xy = F.col("sxx") - F.col("mx") ** 2, F.col("syy") - F.col("my") ** 2, F.col("sxy") - F.col("mx") * F.col("my")
    t, det = xx + yy, xx * yy - xy * xy
    r = F.sqrt(F.greatest(t * t - 4 * det, F.lit(0.0)))
    least = F.lit((T.DLAT / 2) ** 2)
    return g.select("model", "k", "area", F.sqrt(F.greatest((t + r) / 2, least) / F.greatest((t - r) / 2, least)).alias("elongation"),
                    geo.equivalent_diameter(F.col("area")).alias("width"))


@query("a13_weighted_radius", "model:b,k:b,r50:d,r90:d", "A13,W5", f"""
WITH {CELLS}, c AS (SELECT model, k, j, i, cos(radians(lat)) * -anom AS w, round({T.arc_sql('0.0', '0.0', 'lat', 'lon')}, 9) AS r FROM cells WHERE anom < -1),
p AS (SELECT *, (sum(w) OVER (PARTITION BY model, k ORDER BY r, j, i ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY model, k) AS pos FROM c),
n AS (SELECT *, lead(r) OVER s AS r1, lead(pos) OVER s AS p1, lag(pos) OVER s AS p0 FROM p WINDOW s AS (PARTITION BY model, k ORDER BY r, j, i))
SELECT model, k, max(CASE WHEN p0 IS NULL AND 0.5 <= pos THEN r WHEN p1 IS NULL AND 0.5 >= pos THEN r WHEN 0.5 >= pos AND 0.5 < p1 THEN r + (r1 - r) * (0.5 - pos) / (p1 - pos) END) AS r50,
  max(CASE WHEN p0 IS NULL AND 0.9 <= pos THEN r WHEN p1 IS NULL AND 0.9 >= pos THEN r WHEN 0.9 >= pos AND 0.9 < p1 THEN r + (r1 - r) * (0.9 - pos) / (p1 - pos) END) AS r90
FROM n GROUP BY model, k""")
def _(spark, sf):
    c = T.cells(spark, sf).filter("anom < -1").withColumn("w", fields.area_weight(F.col("lat")) * -F.col("anom"))
    c = c.withColumn("r", F.round(geo.arc_km(F.lit(0.0), F.lit(0.0), F.col("lat"), F.col("lon")), 9))
    return fields.weighted_quantile(c, ["model", "k"], "r", "w", {"r50": 0.5, "r90": 0.9})


@query("a19_family_votes", "model:b,j:b,i:b,votes:b,majority:t", "A19,D14", f"""
WITH {CELLS}, f AS (SELECT model, j, i, k // 16 AS family, k % 16 // 8 AS run_, avg(anom) AS a FROM cells GROUP BY ALL),
v AS (SELECT model, j, i, family, max((a < -0.2)::INT) AS vote FROM f GROUP BY ALL)
SELECT model, j, i, sum(vote) AS votes, sum(vote) >= 2 AS majority FROM v GROUP BY model, j, i""")
def _(spark, sf):
    # Four families of two runs each; a family votes once however many of its runs agree.
    mean = lambda a: F.aggregate(F.slice("v", a + 1, 8), F.lit(0.0), lambda s, x: s + x) / 8
    vote = [F.greatest(*[(mean(16 * f + 8 * r) < -0.2).cast("int") for r in range(2)]) for f in range(4)]
    c = T.columns(spark, sf).select("model", "j", "i", sum(vote[1:], vote[0]).alias("votes"))
    return c.withColumn("majority", F.col("votes") >= 2)


@query("o3_largest_labels", "model:b,label:b,n:b,rank:b", "O3,A29", f"""
WITH {CELLS}, n AS (SELECT model, label, count(*) AS n FROM cols GROUP BY model, label),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, label) AS rank FROM n) SELECT * FROM r WHERE rank <= 3""")
def _(spark, sf):
    from pyspark.sql import Window

    n = T.columns(spark, sf).groupBy("model", "label").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("n"), "label"))).filter("rank <= 3")


@query("a29_mode_label", "model:b,j:b,label:b,n:b", "A29", f"""
WITH {CELLS}, n AS (SELECT model, j, label, count(*) AS n FROM cols GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY model, j ORDER BY n DESC, label) AS rn FROM n) SELECT model, j, label, n FROM r WHERE rn = 1""")
def _(spark, sf):
    n = T.columns(spark, sf).groupBy("model", "j", "label").agg(F.count("*").alias("n"))
    return n.groupBy("model", "j").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b")).select("model", "j", "b.label", (-F.col("b.m")).alias("n"))
