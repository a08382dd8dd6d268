"""Choices between settings under rules that were fixed before, and tests against area and chance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terravox.operators import statistics as St
from terravox.operators.scaling import exact_percentiles
from terravox.plans.registry import query
from terravox.plans.spatial_queries import all_places
from terravox.sources import tables as T

# Fixed values of the rules: drift veto in km, the control level, the share of the control's error
# that a change of level has to reach, fewest traces of a group, normal deviate of a one-sided 5 %.
DRIFT_KM, CONTROL, MARGIN, FEWEST, DEVIATE = 200.0, 100, 0.9, 5, -1.6448536269514722


@query("c9_continuity_level_choice", "level:b,drift:d,error:d,stranded:b,admitted:t,chosen:t", "C9", f"""
WITH r AS (SELECT 105 - 5 * l_linenumber AS level, l_returnflag = 'A' AS zero_tilt,
    CASE WHEN l_linenumber = 7 AND l_discount > 0.095 THEN NULL ELSE l_extendedprice / (180 + 6 * l_linenumber) END AS rec, l_quantity * 3 AS truth FROM lineitem),
g AS (SELECT level, median(rec) FILTER (WHERE zero_tilt) AS drift, median(abs(rec - truth)) FILTER (WHERE NOT zero_tilt) AS error, count(*) FILTER (WHERE rec IS NULL) AS stranded FROM r GROUP BY level),
a AS (SELECT *, drift <= {DRIFT_KM} AND stranded = 0 AS admitted FROM g),
b AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN admitted THEN 0 ELSE 1 END, error, level) AS rn, max(error) FILTER (WHERE level = {CONTROL}) OVER () AS control FROM a),
c AS (SELECT coalesce(max(level) FILTER (WHERE rn = 1 AND admitted AND error <= {MARGIN} * control), {CONTROL}) AS pick FROM b)
SELECT level, drift, error, stranded, admitted, level = pick AS chosen FROM b, c""")
def _(spark, sf):
    n = F.col("l_linenumber")
    rec = F.when(~((n == 7) & (F.col("l_discount") > 0.095)), F.col("l_extendedprice") / (180 + 6 * n))
    l = T.table(spark, sf, "lineitem").select((105 - 5 * n).alias("level"), (F.col("l_returnflag") == "A").alias("zero"), rec.alias("rec"), F.abs(rec - F.col("l_quantity") * 3).alias("err"))
    g = l.groupBy("level").agg(F.count_if(F.col("rec").isNull()).alias("stranded"))
    g = g.join(exact_percentiles(l.filter("zero"), ["level"], "rec", {"drift": 0.5}), "level", "left")
    g = g.join(exact_percentiles(l.filter("NOT zero"), ["level"], "err", {"error": 0.5}), "level", "left")
    g = g.withColumn("admitted", (F.col("drift") <= DRIFT_KM) & (F.col("stranded") == 0))
    w = Window.partitionBy()  # one row per level tried
    control = F.max(F.when(F.col("level") == CONTROL, F.col("error"))).over(w)
    best = F.min(F.when(F.col("admitted"), F.struct("error", "level"))).over(w)
    pick = F.when(best["error"] <= MARGIN * control, best["level"]).otherwise(CONTROL)
    return g.withColumn("chosen", F.col("level") == pick)


@query("c10_move_set_choice", "lateral_:d,ncell:b,n_hot:b,n_amb:b,gain:d,z:d,admitted:t,chosen:t", "C10", f"""
WITH r AS (SELECT l_linenumber / 10.0::DOUBLE AS lateral_, 1 + l_suppkey % 2 AS ncell, l_returnflag = 'A' AS hot,
    CASE WHEN l_tax < 0.075 THEN round(l_extendedprice / 20000 - CASE WHEN l_returnflag = 'A' THEN 0.02 * l_linenumber ELSE 0 END, 3) END AS v FROM lineitem WHERE l_returnflag IN ('A', 'N')),
f AS (SELECT * FROM r WHERE v IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY lateral_, ncell ORDER BY v) + (count(*) OVER (PARTITION BY lateral_, ncell, v) - 1) / 2.0::DOUBLE AS rk FROM f),
t AS (SELECT lateral_, ncell, sum(c * c * c - c) AS ties FROM (SELECT lateral_, ncell, count(*)::DOUBLE AS c FROM f GROUP BY lateral_, ncell, v) AS q GROUP BY lateral_, ncell),
g AS (SELECT lateral_, ncell, count(*) FILTER (WHERE hot) AS n_hot, count(*) FILTER (WHERE NOT hot) AS n_amb, median(v) FILTER (WHERE hot) - median(v) FILTER (WHERE NOT hot) AS gain,
    sum(rk) FILTER (WHERE hot) - count(*) FILTER (WHERE hot) * (count(*) FILTER (WHERE hot) + 1) / 2.0::DOUBLE AS u FROM k GROUP BY lateral_, ncell),
s AS (SELECT g.*, n_hot::DOUBLE * n_amb AS m, n_hot + n_amb AS n, ties FROM g JOIN t USING (lateral_, ncell) WHERE n_hot >= {FEWEST} AND n_amb >= {FEWEST}),
z AS (SELECT *, (u - m / 2) / sqrt(m / 12 * ((n + 1) - ties / (n::DOUBLE * (n - 1)))) AS z FROM s),
a AS (SELECT *, z <= {DEVIATE} AS admitted FROM z)
SELECT lateral_, ncell, n_hot, n_amb, gain, z, admitted, admitted AND row_number() OVER (ORDER BY CASE WHEN admitted THEN 0 ELSE 1 END, round(gain, 9), lateral_, ncell) = 1 AS chosen FROM a""")
def _(spark, sf):
    hot = F.col("l_returnflag") == "A"
    v = F.when(F.col("l_tax") < 0.075, F.round(F.col("l_extendedprice") / 20000 - F.when(hot, 0.02 * F.col("l_linenumber")).otherwise(0.0), 3))
    l = T.table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("A", "N"))
    keys = ["lateral_", "ncell"]
    r = l.select((F.col("l_linenumber") / 10.0).alias("lateral_"), (1 + F.pmod("l_suppkey", F.lit(2))).alias("ncell"), F.when(hot, "hot").otherwise("amb").alias("kind"), v.alias("v")).filter("v IS NOT NULL")
    m = St.mann_whitney(r, keys, "kind", "hot", "v").filter((F.col("n1") >= FEWEST) & (F.col("n2") >= FEWEST))
    mid = exact_percentiles(r, [*keys, "kind"], "v", {"m": 0.5})
    gain = mid.groupBy(*keys).agg((F.max(F.when(F.col("kind") == "hot", F.col("m"))) - F.max(F.when(F.col("kind") == "amb", F.col("m")))).alias("gain"))
    g = m.join(gain, keys).withColumn("admitted", F.col("z") <= DEVIATE)
    best = F.min(F.when(F.col("admitted"), F.struct(F.round("gain", 9), "lateral_", "ncell"))).over(Window.partitionBy())  # one row per move set
    chosen = F.coalesce((F.col("lateral_") == best["lateral_"]) & (F.col("ncell") == best["ncell"]), F.lit(False))
    return g.select(*keys, F.col("n1").alias("n_hot"), F.col("n2").alias("n_amb"), "gain", "z", "admitted", chosen.alias("chosen"))


INSIDE_SQL = f"""WITH {T.CELLS_SQL}, {T.SITES_SQL},
spot AS (SELECT kind, n_sites, least(19, greatest(0, ceil((lat + 90 - 4.5) / 9 - 0.5)))::BIGINT AS j, ((ceil(round((lon + 180) / 14.4, 9) - 0.5)::BIGINT % 25) + 25) % 25 AS i FROM places)"""


@query("t26_area_null_observed", "model:b,area_share:d,null_in:b,null_n:b,hot_in:b,hot_n:b,p_attraction:d,p_signal:d", "T26", INSIDE_SQL + """,
a AS (SELECT model, sum(cos(radians(lat))) FILTER (WHERE label <= 2) / sum(cos(radians(lat))) AS area_share FROM cols GROUP BY model),
n AS (SELECT model, sum(n_sites) FILTER (WHERE kind = 'null' AND label <= 2) AS null_in, sum(n_sites) FILTER (WHERE kind = 'null') AS null_n,
    sum(n_sites) FILTER (WHERE kind = 'hotspot' AND label <= 2) AS hot_in, sum(n_sites) FILTER (WHERE kind = 'hotspot') AS hot_n FROM spot JOIN cols USING (j, i) GROUP BY model),
x AS (SELECT model, area_share, coalesce(null_in, 0)::BIGINT AS null_in, null_n::BIGINT AS null_n, coalesce(hot_in, 0)::BIGINT AS hot_in, hot_n::BIGINT AS hot_n, round_even(area_share * null_n, 0)::BIGINT AS expect FROM a JOIN n USING (model)),
f AS (SELECT model, 'attraction' AS test, null_in AS a, null_n AS r, null_in + expect AS k, 2 * null_n AS n FROM x UNION ALL SELECT model, 'signal', hot_in, hot_n, hot_in + null_in, hot_n + null_n FROM x),
p AS (SELECT model, test, sum(exp(lgamma(r + 1) - lgamma(v.x + 1) - lgamma(r - v.x + 1) + lgamma(n - r + 1) - lgamma(k - v.x + 1) - lgamma(n - r - k + v.x + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1))) AS p
  FROM f, LATERAL (SELECT unnest(range(a, least(r, k) + 1)) AS x) AS v GROUP BY model, test)
SELECT x.*, least(1.0::DOUBLE, s.p) AS p_attraction, least(1.0::DOUBLE, t.p) AS p_signal FROM x JOIN p AS s ON s.model = x.model AND s.test = 'attraction' JOIN p AS t ON t.model = x.model AND t.test = 'signal'""")
def _(spark, sf):
    """Share of a province by area, of null sites and of hotspots inside it, and the two exact tests
    between them: do searches drift into it, and do hotspots more than nulls."""
    c = T.columns(spark, sf).select("model", "j", "i", "label", F.cos(F.radians("lat")).alias("w"))
    inside = F.col("label") <= 2
    area = c.groupBy("model").agg((F.sum(F.when(inside, F.col("w"))) / F.sum("w")).alias("area_share"))
    j = F.least(F.lit(T.NLAT - 1), F.greatest(F.lit(0), F.ceil((F.col("lat") + 90 - T.DLAT / 2) / T.DLAT - 0.5))).cast("int")
    i = F.pmod(F.ceil(F.round((F.col("lon") + 180) / T.DLON, 9) - 0.5), F.lit(T.NLON)).cast("int")
    # Sites are counted per grid cell first: at most one row per cell and kind meets the models.
    at = all_places(spark, sf).select(j.alias("j"), i.alias("i"), "kind", "n_sites").groupBy("j", "i").agg(
        F.sum(F.when(F.col("kind") == "null", F.col("n_sites")).otherwise(0)).alias("nl"), F.sum(F.when(F.col("kind") == "hotspot", F.col("n_sites")).otherwise(0)).alias("hs"))
    of = lambda x, cond=F.lit(True): F.sum(F.when(cond, F.col(x)).otherwise(0))
    n = c.join(F.broadcast(at), ["j", "i"]).groupBy("model").agg(of("nl", inside).alias("null_in"), of("nl").alias("null_n"), of("hs", inside).alias("hot_in"), of("hs").alias("hot_n"))
    x = area.join(n, "model").withColumn("e", F.rint(F.col("area_share") * F.col("null_n")).cast("bigint"))
    a, b, h, m = F.col("null_in"), F.col("null_n") - F.col("null_in"), F.col("hot_in"), F.col("hot_n") - F.col("hot_in")
    return x.withColumn("p_attraction", St.p_of_fisher(a, b, F.col("e"), F.col("null_n") - F.col("e"))).withColumn("p_signal", St.p_of_fisher(h, m, a, b))


@query("t19_weighted_area_sample", "model:b,pick:b,j:b,i:b", "T19", f"""
WITH {T.CELLS_SQL}, u AS (SELECT model, j, i, lat, (('0x' || substr(md5(model || '/' || j || '/' || i), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE AS u FROM cols),
r AS (SELECT model, j, i, row_number() OVER (PARTITION BY model ORDER BY round(-ln(u) / cos(radians(lat)), 12), j, i) AS pick FROM u) SELECT * FROM r WHERE pick <= 40""")
def _(spark, sf):
    """Forty cells of a model drawn without replacement, each with a chance in proportion to its area.

    Every cell has an exponential clock with its area as rate; the first to ring are the sample. The
    seed is a digest of the cell, so a lost task draws the same again.
    """
    digest = F.md5(F.concat_ws("/", *[F.col(x).cast("string") for x in ("model", "j", "i")]))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / 281474976710656.0
    c = T.columns(spark, sf).select("model", "j", "i", F.round(-F.log(u) / F.cos(F.radians("lat")), 12).alias("clock"))
    w = Window.partitionBy("model").orderBy("clock", "j", "i")  # a model is a grid of fixed size
    return c.withColumn("pick", F.row_number().over(w)).filter("pick <= 40").drop("clock")


@query("t15_subsample_power", "m:b,draws:b,hits:b,power:d", "T15", """
WITH u AS (SELECT n_nationkey AS unit, n_regionkey <= 1 AS g, round(avg(c_acctbal) / 100, 9) AS v FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
d AS (SELECT m, q AS draw, g, v, row_number() OVER (PARTITION BY m, q, g ORDER BY md5(m || '/' || q || '/' || unit), unit) AS rn FROM u, (SELECT unnest([3, 5, 8]) AS m) AS a, (SELECT unnest(range(400)) AS q) AS b),
s AS (SELECT m, draw, round(abs(avg(v) FILTER (WHERE g) - avg(v) FILTER (WHERE NOT g)), 6) AS diff FROM d WHERE rn <= m GROUP BY m, draw)
SELECT m, count(*) AS draws, count(*) FILTER (WHERE diff >= 2) AS hits, avg((diff >= 2)::INT) AS power FROM s GROUP BY m""")
def _(spark, sf):
    """How often a subsample of m units a group, drawn without replacement, still shows the difference.

    Units are nations, summarised first; the draws are spread over the cluster and each is a digest
    order of the units.
    """
    c = T.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal") / 100, 9).alias("v"))
    n = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("unit"), (F.col("n_regionkey") <= 1).alias("g"))
    u = c.join(n, F.col("c_nationkey") == F.col("unit")).select("unit", "g", "v")
    d = u.withColumn("m", F.explode(F.array(*map(F.lit, (3, 5, 8))))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(399))))
    order = F.md5(F.concat_ws("/", F.col("m").cast("string"), F.col("draw").cast("string"), F.col("unit").cast("string")))
    rn = F.row_number().over(Window.partitionBy("m", "draw", "g").orderBy(order, "unit"))
    s = d.withColumn("rn", rn).filter(F.col("rn") <= F.col("m")).groupBy("m", "draw").agg(
        F.round(F.abs(F.avg(F.when(F.col("g"), F.col("v"))) - F.avg(F.when(~F.col("g"), F.col("v")))), 6).alias("diff"))
    return s.groupBy("m").agg(F.count("*").alias("draws"), F.count_if(F.col("diff") >= 2).alias("hits"), F.avg((F.col("diff") >= 2).cast("double")).alias("power"))
