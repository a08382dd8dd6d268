"""Rank, permutation, circular and exact statistics on tables of any length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravox.functions import geo
from terravox.operators import resampling as P
from terravox.operators import statistics as St
from terravox.operators.scaling import broadcast_if_small, exact_percentiles
from terravox.plans.registry import query
from terravox.session import keep
from terravox.sources import tables as T

ORD_SQL = """o AS (SELECT substr(o_orderpriority, 1, 1) AS grp, o_totalprice AS x, (o_custkey * 7919) % 1000 + o_totalprice / 5000 AS y, o_custkey % 97 AS z,
  o_orderstatus AS st, date_part('doy', o_orderdate) AS doy FROM orders)"""
RANK_SQL = "r AS (SELECT grp, {} FROM o)".format(", ".join(
    f"rank() OVER (PARTITION BY grp ORDER BY {c}) + (count(*) OVER (PARTITION BY grp, {c}) - 1) / 2.0::DOUBLE AS r{c}" for c in "xyz"))


def orders(spark, sf):
    c = F.col("o_custkey")
    return T.table(spark, sf, "orders").select(
        F.substring("o_orderpriority", 1, 1).alias("grp"), F.col("o_totalprice").alias("x"), (F.pmod(c * 7919, F.lit(1000)) + F.col("o_totalprice") / 5000).alias("y"),
        F.pmod(c, F.lit(97)).alias("z"), F.col("o_orderstatus").alias("st"), F.dayofyear("o_orderdate").alias("doy"))


def rhos(spark, sf):
    r = St.average_ranks(orders(spark, sf).select("grp", "x", "y", "z"), ["grp"], ["x", "y", "z"])
    return r.groupBy("grp").agg(F.count("*").alias("n"), F.corr("r_x", "r_y").alias("xy"), F.corr("r_x", "r_z").alias("xz"), F.corr("r_y", "r_z").alias("yz"))


@query("t1_spearman", "grp:s,n:b,rho:d", "T1,W1", f"WITH {ORD_SQL}, {RANK_SQL} SELECT grp, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY grp")
def _(spark, sf):
    return rhos(spark, sf).select("grp", "n", F.col("xy").alias("rho"))


@query("t2_partial_rank", "grp:s,n:b,rho:d", "T2", f"""
WITH {ORD_SQL}, {RANK_SQL}, c AS (SELECT grp, count(*) AS n, corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM r GROUP BY grp)
SELECT grp, n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS rho FROM c""")
def _(spark, sf):
    return rhos(spark, sf).select("grp", "n", St.partial_rho(F.col("xy"), F.col("xz"), F.col("yz")).alias("rho"))


@query("t1_spearman_p", "grp:s,n:b,rho:d,p:d,partial_p:d", "T1,T2")
def _(spark, sf):
    r = rhos(spark, sf)
    part = St.partial_rho(F.col("xy"), F.col("xz"), F.col("yz"))
    return r.select("grp", "n", F.col("xy").alias("rho"), St.p_of_rho(F.col("xy"), F.col("n")).alias("p"), St.p_of_rho(part, F.col("n"), 3).alias("partial_p"))


MWU_SQL = f"""{ORD_SQL}, k AS (SELECT grp, st = 'F' AS f, z AS v, rank() OVER (PARTITION BY grp ORDER BY z) + (count(*) OVER (PARTITION BY grp, z) - 1) / 2.0::DOUBLE AS rk FROM o),
t AS (SELECT grp, sum(c * c * c - c) AS ties FROM (SELECT grp, v, count(*)::DOUBLE AS c FROM k GROUP BY grp, v) AS q GROUP BY grp),
s AS (SELECT grp, count(*) FILTER (WHERE f)::DOUBLE AS n1, count(*) FILTER (WHERE NOT f)::DOUBLE AS n2, sum(rk) FILTER (WHERE f) AS r1, count(*)::DOUBLE AS n FROM k GROUP BY grp),
u AS (SELECT s.*, ties, r1 - n1 * (n1 + 1) / 2 AS u FROM s JOIN t USING (grp))"""


@query("t3_mann_whitney", "grp:s,n1:b,n2:b,u_thousands:d,auc:d,z:d", "T3,T4", f"""
WITH {MWU_SQL} SELECT grp, n1, n2, u / 1000 AS u_thousands, 1 - u / (n1 * n2) AS auc, (u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u""")
def _(spark, sf):
    return St.mann_whitney(orders(spark, sf), ["grp"], "st", "F", "z").withColumn("u_thousands", F.col("u") / 1000)


@query("t3_mann_whitney_p", "grp:s,auc:d,p_less:d,p_two_sided:d", "T3,C12")
def _(spark, sf):
    m = St.mann_whitney(orders(spark, sf), ["grp"], "st", "F", "z")
    shift = 0.5 / F.col("sd")
    return m.select("grp", "auc", St.normal_upper(-(F.col("z") + shift)).alias("p_less"), F.least(F.lit(1.0), 2 * St.normal_upper(F.abs("z") - shift)).alias("p_two_sided"))


@query("t5_kruskal_wallis", "n:b,groups:b,h:d", "T5", f"""
WITH {ORD_SQL}, k AS (SELECT grp, z AS v, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0::DOUBLE AS rk FROM o),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM k GROUP BY v) AS q),
g AS (SELECT grp, count(*)::DOUBLE AS n, sum(rk) AS r FROM k GROUP BY grp), a AS (SELECT sum(n) AS n, count(*) AS groups, sum(r * r / n) AS s FROM g)
SELECT n, groups, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM a, t""")
def _(spark, sf):
    return St.kruskal(orders(spark, sf), [], "grp", "z").select(F.col("total").alias("n"), "groups", "h")


@query("t5_kruskal_p", "n:b,h:d,p:d", "T5")
def _(spark, sf):
    k = St.kruskal(orders(spark, sf), [], "grp", "z")
    return k.select(F.col("total").alias("n"), "h", St.p_of_chi2(F.col("h"), F.col("groups") - 1).alias("p"))


DOC_SQL = "d AS (SELECT lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


def judged(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(T.table(spark, sf, "labels"), "doc_id", "left")


@query("t6_fisher_exact", "lang:s,a11:b,a12:b,a21:b,a22:b,odds_ratio:d,p_one_sided:d,p_two_sided:d", "T6,T7,A3", f"""
WITH {DOC_SQL}, c AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND n_chars > 800) AS a, count(*) FILTER (WHERE quality = 0 AND n_chars > 800) AS b,
  count(*) FILTER (WHERE quality = 1 AND n_chars <= 800) AS c, count(*) FILTER (WHERE quality = 0 AND n_chars <= 800) AS d FROM d GROUP BY lang),
x AS (SELECT *, a + b + c + d AS n, a + b AS r, a + c AS k FROM c),
t AS (SELECT lang, a, v.x, exp(lgamma(r + 1) - lgamma(v.x + 1) - lgamma(r - v.x + 1) + lgamma(n - r + 1) - lgamma(k - v.x + 1) - lgamma(n - r - k + v.x + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)) AS q
  FROM x, LATERAL (SELECT unnest(range(greatest(0, r + k - n), least(r, k) + 1)) AS x) AS v),
p AS (SELECT lang, sum(q) FILTER (WHERE x >= a) AS p, sum(q) FILTER (WHERE q <= o * (1 + 1e-7::DOUBLE)) AS p2 FROM t JOIN (SELECT lang, q AS o FROM t WHERE x = a) AS s USING (lang) GROUP BY lang)
SELECT lang, a AS a11, b AS a12, c AS a21, d AS a22, CASE WHEN b * c > 0 THEN a * d / (b * c)::DOUBLE END AS odds_ratio, least(1.0::DOUBLE, p.p) AS p_one_sided, least(1.0::DOUBLE, p.p2) AS p_two_sided FROM c JOIN p USING (lang)""")
def _(spark, sf):
    long = F.col("n_chars") > 800
    g = judged(spark, sf).groupBy("lang").agg(F.count_if((F.col("quality") == 1) & long).alias("a11"), F.count_if((F.col("quality") == 0) & long).alias("a12"),
                                              F.count_if((F.col("quality") == 1) & ~long).alias("a21"), F.count_if((F.col("quality") == 0) & ~long).alias("a22"))
    bc = (F.col("a12") * F.col("a21")).cast("double")
    return g.select("*", F.when(bc > 0, F.col("a11") * F.col("a22") / bc).alias("odds_ratio"), St.p_of_fisher(F.col("a11"), F.col("a12"), F.col("a21"), F.col("a22")).alias("p_one_sided"),
                    St.p_of_fisher(F.col("a11"), F.col("a12"), F.col("a21"), F.col("a22"), two_sided=True).alias("p_two_sided"))


# Units of the resampling tests are nations: 25 rows of the dimension table however long the facts.
NATION_SQL = "u AS (SELECT n_nationkey AS unit, n_regionkey AS region, avg(c_acctbal) / 100 AS v, n_regionkey <= 1 AS first_ FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)"


def nation_units(spark, sf):
    n = T.table(spark, sf, "nation")
    c = T.table(spark, sf, "customer").groupBy("c_nationkey").agg((F.avg("c_acctbal") / 100).alias("v"))
    u = c.join(broadcast_if_small(n)[0], F.col("c_nationkey") == F.col("n_nationkey"))
    return u.select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("region"), "v", (F.col("n_regionkey") <= 1).alias("first_"))


# The same digest order of the units in SQL: every draw's first n1 units stand for the first group.
def drawn_sql(mid: str) -> str:
    return f"""obs AS (SELECT round(abs({mid}(v) FILTER (WHERE first_) - {mid}(v) FILTER (WHERE NOT first_)), 9) AS observed, count(*) FILTER (WHERE first_) AS n1 FROM u),
r AS (SELECT draw, v, row_number() OVER (PARTITION BY draw ORDER BY md5('11/' || draw || '/' || unit), unit) AS rn FROM u, (SELECT unnest(range({P.DRAWS})) AS draw) AS d),
x AS (SELECT draw, round(abs({mid}(v) FILTER (WHERE rn <= n1) - {mid}(v) FILTER (WHERE rn > n1)), 9) AS x FROM r, obs GROUP BY draw),
h AS (SELECT count(*) FILTER (WHERE x >= observed) AS c, count(*) AS draws, max(observed) AS observed FROM x, obs)"""


@query("t8_permutation_means", "observed:d,p:d,draws:b,how:s", "T8", f"""
WITH {NATION_SQL}, {drawn_sql('avg')} SELECT observed, (c + 1) / (draws + 1)::DOUBLE AS p, draws, 'drawn' AS how FROM h""")
def _(spark, sf):
    return P.permutation_test(nation_units(spark, sf), "mean", True)


@query("t8_exact_means", "region:b,observed:d,p:d,draws:b,how:s", "T8", f"""
WITH {NATION_SQL}, w AS (SELECT q.region, unit, v, u.region = q.region AS first_, row_number() OVER (PARTITION BY q.region ORDER BY unit) AS n FROM u, (SELECT DISTINCT region FROM u) AS q),
obs AS (SELECT region, round(abs(avg(v) FILTER (WHERE first_) - avg(v) FILTER (WHERE NOT first_)), 9) AS observed, sum(v) AS s, count(*) AS m FROM w GROUP BY region),
x AS (SELECT o.region, observed, round(abs((a.v + b.v + c.v + d.v + e.v) / 5 - (s - a.v - b.v - c.v - d.v - e.v) / (m - 5)), 9) AS x
  FROM w AS a JOIN w AS b ON b.region = a.region AND b.n > a.n JOIN w AS c ON c.region = a.region AND c.n > b.n JOIN w AS d ON d.region = a.region AND d.n > c.n JOIN w AS e ON e.region = a.region AND e.n > d.n JOIN obs AS o ON o.region = a.region)
SELECT region, max(observed) AS observed, avg((x >= observed)::INT) AS p, count(*) AS draws, 'exact' AS how FROM x GROUP BY region""")
def _(spark, sf):
    """Each region against the rest, all 53,130 splits of 25 nations counted out."""
    u = keep(nation_units(spark, sf), "units")
    regions = [r.region for r in u.select("region").distinct().orderBy("region").collect()]  # the rows of a dimension
    tests = [P.permutation_test(u.withColumn("first_", F.col("region") == r), "mean", True).withColumn("region", F.lit(r)) for r in regions]
    return reduce(DataFrame.unionByName, tests)


@query("t9_permutation_medians", "convention:s,observed:d,p:d,draws:b,how:s", "T9", f"""
WITH {NATION_SQL}, {drawn_sql('median')} SELECT 'plus one' AS convention, observed, (c + 1) / (draws + 1)::DOUBLE AS p, draws, 'drawn' AS how FROM h
UNION ALL SELECT 'plain', observed, c / draws::DOUBLE, draws, 'drawn' FROM h""")
def _(spark, sf):
    u = keep(nation_units(spark, sf), "units")
    a = P.permutation_test(u, "median", True).withColumn("convention", F.lit("plus one"))
    return a.unionByName(P.permutation_test(u, "median", False).withColumn("convention", F.lit("plain")))


@query("t13_leave_one_out", "region:b,lo:d,hi:d", "T13", f"""
WITH {NATION_SQL}, r AS (SELECT region, count(*) AS n, sum(v) AS s FROM u GROUP BY region)
SELECT region, min((s - v) / (n - 1)) AS lo, max((s - v) / (n - 1)) AS hi FROM u JOIN r USING (region) WHERE n > 1 GROUP BY region""")
def _(spark, sf):
    # Dropping one member is arithmetic on the group's sum: no group is repeated.
    u = nation_units(spark, sf)
    r = u.groupBy("region").agg(F.count("*").alias("n"), F.sum("v").alias("s")).filter("n > 1")
    left = (F.col("s") - F.col("v")) / (F.col("n") - 1)
    return u.join(r, "region").groupBy("region").agg(F.min(left).alias("lo"), F.max(left).alias("hi"))


@query("t14_circular_v_test", "grp:s,n:b,r:d,v:d,u:d,mean_deg:d", "T14,A10", f"""
WITH {ORD_SQL}, a AS (SELECT grp, radians(doy * 360.0 / 366 - 90) AS a FROM o), s AS (SELECT grp, count(*) AS n, avg(cos(a)) AS c, avg(sin(a)) AS s FROM a GROUP BY grp)
SELECT grp, n, sqrt(c * c + s * s) AS r, c AS v, c * sqrt(2.0 * n) AS u, ((degrees(atan2(s, c)) % 360) + 360) % 360 AS mean_deg FROM s""")
def _(spark, sf):
    return circular(spark, sf)


def circular(spark, sf):
    a = F.radians(F.col("doy") * 360.0 / 366 - 90)
    g = orders(spark, sf).groupBy("grp").agg(F.count("*").alias("n"), F.avg(F.cos(a)).alias("c"), F.avg(F.sin(a)).alias("s"))
    return g.select("grp", "n", F.sqrt(F.col("c") ** 2 + F.col("s") ** 2).alias("r"), F.col("c").alias("v"), (F.col("c") * F.sqrt(2.0 * F.col("n"))).alias("u"), geo.wrap360(F.degrees(F.atan2("s", "c"))).alias("mean_deg"))


@query("t14_circular_p", "grp:s,u:d,p:d,power:d", "T14")
def _(spark, sf):
    # Power against a true resultant of 0.05 at the one-sided 5 per cent limit.
    return circular(spark, sf).select("grp", "u", St.normal_upper(F.col("u")).alias("p"), St.normal_upper(F.lit(1.6449) - 0.05 * F.sqrt(2.0 * F.col("n"))).alias("power"))


@query("t16_signed_rank", "grp:s,n:b,w_plus_m:d,w_minus_m:d", "T16", f"""
WITH {ORD_SQL}, d AS (SELECT grp, round(x / 500 - y, 6) AS d FROM o), k AS (SELECT grp, d, rank() OVER (PARTITION BY grp ORDER BY abs(d)) + (count(*) OVER (PARTITION BY grp, abs(d)) - 1) / 2.0::DOUBLE AS r FROM d WHERE d <> 0)
SELECT grp, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) / 1e6 AS w_plus_m, coalesce(sum(r) FILTER (WHERE d < 0), 0) / 1e6 AS w_minus_m FROM k GROUP BY grp""")
def _(spark, sf):
    # The sums follow from the counted values: no rank goes back to a row.
    d = orders(spark, sf).select("grp", F.round(F.col("x") / 500 - F.col("y"), 6).alias("d"))
    return St.signed_rank(d, ["grp"], "d").select("grp", "n", (F.col("w_plus") / 1e6).alias("w_plus_m"), (F.col("w_minus") / 1e6).alias("w_minus_m"))


@query("t16_signed_rank_p", "grp:s,n:b,w_m:d,z:d,p:d", "T16")
def _(spark, sf):
    d = orders(spark, sf).withColumn("d", F.round(F.col("x") / 500 - F.col("y"), 6))
    g = St.p_of_signed_rank(St.signed_rank(d, ["grp"], "d"))
    return g.withColumn("w_m", F.least("w_plus", "w_minus") / 1e6)


@query("t16_exact_signed_rank", "chain:b,n:b,w:d,z:d,exact_p:d", "T16", """
WITH RECURSIVE ways AS (SELECT 0 AS n, [1.0::DOUBLE] AS c UNION ALL
  SELECT n + 1, list_transform(range(1, (n + 1) * (n + 2) // 2 + 2), lambda w: (coalesce(c[w], 0) + CASE WHEN w > n + 1 THEN coalesce(c[w - n - 1], 0) ELSE 0 END) / 2) FROM ways WHERE n < 50),
d AS (SELECT o_custkey AS chain, round(o_totalprice / 997 - 150, 6) AS d FROM orders),
k AS (SELECT chain, d, rank() OVER (PARTITION BY chain ORDER BY abs(d)) + (count(*) OVER (PARTITION BY chain, abs(d)) - 1) / 2.0::DOUBLE AS r,
  count(*) OVER (PARTITION BY chain, abs(d)) AS t FROM d WHERE d <> 0),
g AS (SELECT chain, count(*) AS n, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS w, sum(t * t - 1)::DOUBLE AS ties FROM k GROUP BY chain)
SELECT chain, g.n, w, (w - g.n * (g.n + 1) / 4.0::DOUBLE) / sqrt(g.n * (g.n + 1) * (2 * g.n + 1) / 24.0::DOUBLE - ties / 48) AS z,
  CASE WHEN ties = 0 THEN least(1.0::DOUBLE, 2 * list_sum(c[1:w::BIGINT + 1])) END AS exact_p
FROM g LEFT JOIN ways ON ways.n = g.n""")
def _(spark, sf):
    # The totals of each chain of orders against a middle of 150; none has more orders than are counted out, or p is null.
    d = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("chain"), F.round(F.col("o_totalprice") / 997 - 150, 6).alias("d"))
    g = St.p_of_signed_rank(St.signed_rank(d, ["chain"], "d"))
    exact = (F.col("ties") == 0) & (F.col("n") <= St.SIGNED_RANK_EXACT)
    return g.withColumn("w", F.least("w_plus", "w_minus")).withColumn("exact_p", F.when(exact, F.col("p")))


@query("t17_theil_sen", "model:b,j:b,i:b,slope:d,intercept:d", "T17", f"""
WITH {T.CELLS_SQL}, p AS (SELECT a.model, a.j, a.i, (b.anom - a.anom) / (b.depth_km - a.depth_km) * 1000 AS s FROM cells AS a JOIN cells AS b ON b.model = a.model AND b.j = a.j AND b.i = a.i AND b.k > a.k),
m AS (SELECT model, j, i, median(s) AS slope FROM p GROUP BY ALL)
SELECT m.model, m.j, m.i, slope, median(anom - slope * depth_km / 1000) AS intercept FROM m JOIN cells AS c ON c.model = m.model AND c.j = m.j AND c.i = m.i GROUP BY ALL""")
def _(spark, sf):
    # The 64 shells of one column, whose pairs are formed inside the row.
    pts = F.transform(F.sequence(F.lit(0), F.lit(T.NZ - 1)), lambda k: F.struct((k * T.DZ_KM / 1000).alias("z"), F.col("v")[k].alias("a")))
    med = lambda arr: (F.array_sort(arr)[F.floor((F.size(arr) - 1) / 2).cast("int")] + F.array_sort(arr)[F.floor(F.size(arr) / 2).cast("int")]) / 2
    c = T.columns(spark, sf).select("model", "j", "i", pts.alias("p"))
    pairs = F.flatten(F.transform("p", lambda x: F.transform(F.filter("p", lambda y: y["z"] > x["z"]), lambda y: (y["a"] - x["a"]) / (y["z"] - x["z"]))))
    c = c.withColumn("s", pairs).withColumn("slope", med(F.col("s")))
    c = c.withColumn("res", F.transform("p", lambda x: x["a"] - F.col("slope") * x["z"]))
    return c.select("model", "j", "i", "slope", med(F.col("res")).alias("intercept"))


@query("t18_half_recovery", "lang:s,amplitude:d", "T18,W2", f"""
WITH {DOC_SQL}, b AS (SELECT lang, (least(3, floor(n_chars / 400)) + 1) / 2 AS amp, avg(quality) AS f FROM d WHERE quality IS NOT NULL GROUP BY ALL),
n AS (SELECT *, lead(amp) OVER w AS a1, lead(f) OVER w AS f1, row_number() OVER w AS rn FROM b WINDOW w AS (PARTITION BY lang ORDER BY amp)),
h AS (SELECT lang, CASE WHEN rn = 1 AND f >= 0.5 THEN amp WHEN f < 0.5 AND 0.5 <= f1 THEN amp + (0.5 - f) / (f1 - f) * (a1 - amp) END AS x FROM n)
SELECT lang, min(x) AS amplitude FROM h GROUP BY lang""")
def _(spark, sf):
    amp = (F.least(F.lit(3), F.floor(F.col("n_chars") / 400)) + 1) / 2
    b = judged(spark, sf).filter("quality IS NOT NULL").groupBy("lang", amp.alias("amp")).agg(F.avg("quality").alias("f"))
    w = Window.partitionBy("lang").orderBy("amp")  # four amplitudes per language
    n = b.select("*", F.lead("amp").over(w).alias("a1"), F.lead("f").over(w).alias("f1"), F.row_number().over(w).alias("rn"))
    x = F.when((F.col("rn") == 1) & (F.col("f") >= 0.5), F.col("amp")).when((F.col("f") < 0.5) & (F.col("f1") >= 0.5), F.col("amp") + (0.5 - F.col("f")) / (F.col("f1") - F.col("f")) * (F.col("a1") - F.col("amp")))
    return n.groupBy("lang").agg(F.min(x).alias("amplitude"))


@query("t25_least_squares", "grp:s,n:b,slope:d,intercept:d,r:d", "T25", f"""
WITH {ORD_SQL} SELECT grp, count(*) AS n, regr_slope(y, x / 1000) AS slope, regr_intercept(y, x / 1000) AS intercept, corr(y, x) AS r FROM o GROUP BY grp""")
def _(spark, sf):
    k = F.col("x") / 1000
    return orders(spark, sf).groupBy("grp").agg(F.count("*").alias("n"), F.regr_slope("y", k).alias("slope"), F.regr_intercept("y", k).alias("intercept"), F.corr("y", "x").alias("r"))


@query("w15_benjamini_hochberg", "test:s,p:d,q:d,survives:t", "W15,T21", """
WITH p AS (SELECT l_returnflag || '-' || l_linestatus || '-' || l_linenumber AS test, abs(avg(l_discount) - 0.05) * 400 % 1 AS p FROM lineitem GROUP BY ALL),
r AS (SELECT *, rank() OVER (ORDER BY p, test) AS rk, count(*) OVER () AS m FROM p)
SELECT test, p, least(1, min(p * m / rk) OVER (ORDER BY p DESC, test DESC ROWS UNBOUNDED PRECEDING)) AS q, least(1, min(p * m / rk) OVER (ORDER BY p DESC, test DESC ROWS UNBOUNDED PRECEDING)) < 0.1 AS survives FROM r""")
def _(spark, sf):
    p = T.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.avg("l_discount").alias("d"))
    p = p.select(F.concat_ws("-", "l_returnflag", "l_linestatus", "l_linenumber").alias("test"), (F.abs(F.col("d") - 0.05) * 400 % 1).alias("p"))
    # One row per test: flags x statuses x line numbers, a few dozen however long the table.
    w = Window.orderBy("p", "test")
    r = p.select("*", F.row_number().over(w).alias("rk"), F.count("*").over(Window.partitionBy()).alias("m"))
    q = F.least(F.lit(1.0), F.min(F.col("p") * F.col("m") / F.col("rk")).over(Window.orderBy(F.desc("p"), F.desc("test")).rowsBetween(Window.unboundedPreceding, 0)))
    return r.withColumn("q", q).withColumn("survives", F.col("q") < 0.1)


@query("t21_correlation_grid", "x:s,y:s,n:b,rho:d", "T21,T1", """
WITH l AS (SELECT l_linestatus AS g, l_quantity AS a, l_discount AS b, l_tax AS c, l_extendedprice AS d FROM lineitem),
k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS b,
 rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0::DOUBLE AS c, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0::DOUBLE AS d FROM l)
SELECT 'quantity' AS x, 'tax' AS y, count(*) AS n, corr(a, c) AS rho FROM k UNION ALL SELECT 'quantity', 'price', count(*), corr(a, d) FROM k
UNION ALL SELECT 'discount', 'tax', count(*), corr(b, c) FROM k UNION ALL SELECT 'discount', 'price', count(*), corr(b, d) FROM k""")
def _(spark, sf):
    l = T.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("price"))
    r = St.average_ranks(l, [], ["quantity", "discount", "tax", "price"])
    grid = [(x, y) for x in ("quantity", "discount") for y in ("tax", "price")]
    g = r.agg(F.count("*").alias("n"), *[F.corr(f"r_{x}", f"r_{y}").alias(f"{x}_{y}") for x, y in grid])
    return g.select("n", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"{x}_{y}").alias("rho")) for x, y in grid])).alias("c")).select("c.*", "n")


@query("t22_population_percentile", "grp:s,site:b,value:d,percentile:d,verdict:s", "T22,T24", """
WITH v AS (SELECT c_mktsegment AS grp, c_custkey AS site, c_acctbal AS value FROM customer), a AS (SELECT s_suppkey AS site, s_acctbal AS value FROM supplier),
p AS (SELECT a.site, a.value, 100.0 * count(*) FILTER (WHERE v.value < a.value) / count(*) AS percentile FROM a, v GROUP BY a.site, a.value)
SELECT 'all' AS grp, site, value, percentile, CASE WHEN percentile < 10 THEN 'low' WHEN percentile >= 95 THEN 'high' ELSE 'middle' END AS verdict FROM p""")
def _(spark, sf):
    # Both populations are ranked together by distinct value; nobody is paired with anybody.
    from terravox.operators.scaling import Ordered

    a = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_acctbal").alias("value"))
    v = T.table(spark, sf, "customer").select(F.col("c_acctbal").alias("value"))
    vals = v.withColumn("w", F.lit(1)).unionByName(a.select("value").withColumn("w", F.lit(0))).groupBy("value").agg(F.sum("w").alias("w"))
    up = Ordered(vals, [], "value").running({"upto": ("sum", F.col("w"))}).result()
    n = v.agg(F.count("*").alias("n"))
    j = a.join(up, "value").join(F.broadcast(n))
    j = j.withColumn("percentile", 100.0 * (F.col("upto") - F.col("w")) / F.col("n"))
    verdict = F.when(F.col("percentile") < 10, "low").when(F.col("percentile") >= 95, "high").otherwise("middle")
    return j.select(F.lit("all").alias("grp"), "site", "value", "percentile", verdict.alias("verdict"))
