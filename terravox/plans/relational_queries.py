"""Per-site tables: joins, pivots, votes, set overlap, decisions and their governance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terravox.operators import calibration as C
from terravox.operators import setops
from terravox.operators import statistics as St
from terravox.operators.scaling import exact_percentiles
from terravox.plans.registry import query
from terravox.plans.stat_queries import DOC_SQL, judged
from terravox.session import keep
from terravox.sources import tables as T

# ---- model comparison: regions are inversion families, nations are runs, segments are sites -------

RUNS_SQL = """runs AS (SELECT c_mktsegment AS site, n_nationkey AS run_, n_regionkey AS family, avg((c_acctbal > 3000)::INT) AS f, median(c_acctbal) / 100 AS w
  FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
cls AS (SELECT *, CASE WHEN f >= 0.8 THEN 'deeper than null' WHEN f <= 0.2 THEN 'not deeper than null' ELSE 'ambiguous' END AS c FROM runs),
ind AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, family ORDER BY run_) AS rn FROM cls) AS q WHERE rn = 1)"""


def runs(spark, sf):
    """One row per (site, run). The nation dimension is small by its key range and is broadcast
    after a check by the optimizer."""
    c = T.table(spark, sf, "customer").select("c_mktsegment", "c_nationkey", "c_acctbal")
    key = ["c_mktsegment", "c_nationkey"]
    g = c.groupBy(*key).agg(F.avg((F.col("c_acctbal") > 3000).cast("double")).alias("f"))
    med = exact_percentiles(c.withColumn("w", F.col("c_acctbal") / 100), key, "w", {"w": 0.5})
    g = g.join(med, key).join(T.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return g.select(F.col("c_mktsegment").alias("site"), F.col("n_nationkey").alias("run_"), F.col("n_regionkey").alias("family"), "f", "w").withColumn("c", C.ensemble_class(F.col("f")))


def independent(r):
    """The first listed run of each family."""
    first = F.min(F.struct("run_", "f", "w", "c")).alias("b")
    return r.groupBy("site", "family").agg(first).select("site", "family", "b.*")


@query("c15_model_comparison", "site:s,f_mean:d,f_min:d,f_max:d,n_deep:b,n_models:b,f_ind_mean:d,consensus:s,tier:s", "C15,J1,A2,A3,O1,O4,D15", f"""
WITH {RUNS_SQL}, a AS (SELECT site, avg(f) AS f_mean, min(f) AS f_min, max(f) AS f_max FROM cls GROUP BY site),
i AS (SELECT site, count(*) FILTER (WHERE f >= 0.65) AS n_deep, count(*) AS n_models, avg(f) AS f_ind_mean FROM ind GROUP BY site)
SELECT a.*, n_deep, n_models, f_ind_mean, CASE WHEN n_deep = n_models THEN 'deep in every model' WHEN n_deep = 0 THEN 'deep in none' WHEN n_deep >= (n_models + 1) // 2 THEN 'deep in a majority' ELSE 'deep in a minority' END AS consensus,
  CASE WHEN n_deep >= (n_models + 1) // 2 THEN 'I' WHEN n_deep >= 1 THEN 'II' WHEN f_ind_mean >= 0.5 THEN 'III' ELSE 'IV' END AS tier FROM a JOIN i USING (site)""")
def _(spark, sf):
    r = runs(spark, sf)
    a = r.groupBy("site").agg(F.avg("f").alias("f_mean"), F.min("f").alias("f_min"), F.max("f").alias("f_max"))
    i = independent(r).groupBy("site").agg(F.count_if(F.col("f") >= 0.65).alias("n_deep"), F.count("*").alias("n_models"), F.avg("f").alias("f_ind_mean"))
    return a.join(i, "site").withColumn("consensus", C.consensus(F.col("n_deep"), F.col("n_models"))).withColumn("tier", C.tier(F.col("n_deep"), F.col("n_models"), F.col("f_ind_mean")))


@query("j1_wide_comparison", "site:s,f_0:d,f_1:d,f_2:d,f_3:d,f_4:d,w_0:d,w_4:d", "J1,D16,A24", f"""
WITH {RUNS_SQL} SELECT site, {', '.join(f'max(f) FILTER (WHERE family = {k}) AS f_{k}' for k in range(5))}, max(w) FILTER (WHERE family = 0) AS w_0, max(w) FILTER (WHERE family = 4) AS w_4 FROM ind GROUP BY site""")
def _(spark, sf):
    p = independent(runs(spark, sf)).groupBy("site").pivot("family", list(range(5))).agg(F.max("f").alias("f"), F.max("w").alias("w"))
    return p.select("site", *[F.col(f"{k}_f").alias(f"f_{k}") for k in range(5)], F.col("0_w").alias("w_0"), F.col("4_w").alias("w_4"))


@query("t12_pairwise_agreement", "a:b,b:b,n:b,agreement:d", "T12,J7", f"""
WITH {RUNS_SQL}, x AS (SELECT site, family, f >= 0.65 AS deep FROM ind)
SELECT p.family AS a, q.family AS b, count(*) AS n, avg((p.deep = q.deep)::INT) AS agreement FROM x AS p JOIN x AS q ON p.site = q.site AND p.family < q.family GROUP BY ALL""")
def _(spark, sf):
    # A site has one row per family and families are few, so its pairs are unfolded from one array;
    # equal patterns of verdicts are counted first, so that the pairs follow the patterns, not the sites.
    site = independent(runs(spark, sf)).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("family", (F.col("f") >= 0.65).alias("deep")))).alias("v"))
    pattern = site.groupBy("v").agg(F.count("*").alias("c"))
    pairs = F.flatten(F.transform("v", lambda x: F.transform(F.filter("v", lambda y: y["family"] > x["family"]), lambda y: F.struct(
        x["family"].alias("a"), y["family"].alias("b"), (x["deep"] == y["deep"]).cast("bigint").alias("same")))))
    p = pattern.select("c", F.explode(pairs).alias("r"))
    n = F.sum("c")
    return p.groupBy("r.a", "r.b").agg(n.alias("n"), (F.sum(F.col("c") * F.col("r.same")) / n).alias("agreement"))


# ---- raters: event types judge users --------------------------------------------------------------

RATE_SQL = """votes AS (SELECT user_id AS site, event_type AS rater, CASE WHEN avg(value) < 18 THEN 'none' WHEN avg(value) < 30 THEN 'mid' ELSE 'deep' END AS c FROM events GROUP BY ALL),
full_ AS (SELECT site FROM votes GROUP BY site HAVING count(*) = (SELECT count(DISTINCT rater) FROM votes)), m AS (SELECT v.* FROM votes AS v JOIN full_ USING (site)),
n AS (SELECT site, c, count(*) AS k FROM m GROUP BY ALL)"""


def votes(spark, sf):
    # Rounded, so that a mean that stands on a class limit does not depend on the order of the sum.
    e = T.table(spark, sf, "events").groupBy(F.col("user_id").alias("site"), F.col("event_type").alias("rater")).agg(F.round(F.avg("value"), 9).alias("a"))
    c = F.when(F.col("a") < 18, "none").when(F.col("a") < 30, "mid").otherwise("deep")
    v = e.select("site", "rater", c.alias("c"))
    raters = v.agg(F.count_distinct("rater").alias("raters"))  # one row
    full = v.groupBy("site").agg(F.count("*").alias("r")).join(F.broadcast(raters)).filter(F.col("r") == F.col("raters"))
    return v.join(full.select("site", "raters"), "site")


@query("a20_consensus_mode", "site:b,class_:s,support:b", "A20,P18,J5", f"""
WITH {RATE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY k DESC, c) AS rn FROM n) SELECT site, CASE WHEN k >= 4 THEN c END AS class_, k AS support FROM r WHERE rn = 1""")
def _(spark, sf):
    n = votes(spark, sf).groupBy("site", "raters", "c").agg(F.count("*").alias("k"))
    b = n.groupBy("site", "raters").agg(F.min(F.struct((-F.col("k")).alias("m"), "c")).alias("b"))
    need = F.ceil(3 * F.col("raters") / 4)
    return b.select("site", F.when(-F.col("b.m") >= need, F.col("b.c")).alias("class_"), (-F.col("b.m")).alias("support"))


@query("t11_fleiss_kappa", "subjects:b,observed:d,expected:d,kappa:d", "T11", f"""
WITH {RATE_SQL}, p AS (SELECT site, (sum(k * k) - 5) / 20.0::DOUBLE AS pi FROM n GROUP BY site), s AS (SELECT count(*) AS subjects, avg(pi) AS observed FROM p),
e AS (SELECT sum(pow(t / tot, 2)) AS expected FROM (SELECT c, sum(k) AS t, sum(sum(k)) OVER () AS tot FROM n GROUP BY c) AS q)
SELECT subjects, observed, expected, (observed - expected) / (1 - expected) AS kappa FROM s, e""")
def _(spark, sf):
    n = votes(spark, sf).groupBy("site", "raters", "c").agg(F.count("*").alias("k"))
    r = F.col("raters")
    p = n.groupBy("site", "raters").agg(F.sum(F.col("k") * F.col("k")).alias("kk")).select(((F.col("kk") - r) / (r * (r - 1))).alias("pi")).agg(F.count("*").alias("subjects"), F.avg("pi").alias("observed"))
    t = n.groupBy("c").agg(F.sum("k").alias("t"))  # one row per class
    e = t.agg((F.sum(F.col("t").cast("double") * F.col("t")) / (F.sum("t").cast("double") * F.sum("t"))).alias("expected"))
    return p.join(F.broadcast(e)).withColumn("kappa", (F.col("observed") - F.col("expected")) / (1 - F.col("expected")))


@query("t10_label_permutation", "agree:b,p:d,draws:b", "T10")
def _(spark, sf):
    """Shuffle the classes inside each rater and count consensus again.

    Only the numbers of subjects per combination of classes matter: 3^5 combinations at most, so
    a draw is a small table of margins whatever the number of subjects.
    """
    import itertools

    import numpy as np
    import pandas as pd

    v = votes(spark, sf)
    w = v.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("rater", "c"))).alias("v")).select(F.transform("v", lambda x: x["c"]).alias("c"))
    combo = [(tuple(r["c"]), r["n"]) for r in w.groupBy("c").agg(F.count("*").alias("n")).collect()]
    n_raters = len(combo[0][0]) if combo else 0
    classes = ["none", "mid", "deep"]
    need = -(-3 * n_raters // 4)
    agreed = lambda c: max(c.count(x) for x in classes) >= need
    obs, total = sum(n for c, n in combo if agreed(c)), sum(n for _, n in combo)
    margin = [[sum(n for c, n in combo if c[r] == x) for x in classes] for r in range(n_raters)]

    def draw(batches):
        for b in batches:
            hits = []
            for i in b["id"]:
                rng = np.random.default_rng([7, int(i)])
                cells = {(): total}
                for r in range(n_raters):  # deal the classes of one rater over the groups formed so far
                    left, nxt = list(margin[r]), {}
                    for key, size in cells.items():
                        got = rng.multivariate_hypergeometric(left, size)
                        left = [a - int(g) for a, g in zip(left, got)]
                        for x, g in zip(classes, got):
                            if g:
                                nxt[key + (x,)] = nxt.get(key + (x,), 0) + int(g)
                    cells = nxt
                hits.append(int(sum(n for c, n in cells.items() if agreed(list(c))) >= obs))
            yield pd.DataFrame({"hit": hits})

    h = spark.range(2000).mapInPandas(draw, "hit int").agg(F.sum("hit").alias("c"), F.count("*").alias("draws"))
    return h.select(F.lit(obs).alias("agree"), ((F.col("c") + 1) / (F.col("draws") + 1)).alias("p"), "draws")


# ---- trials: documents are cases, labels say whether they were recovered --------------------------

DET_SQL = DOC_SQL + """, t AS (SELECT source, lang, least(3, n_chars // 400) AS amp, CASE WHEN quality IS NULL THEN NULL ELSE quality = 1 END AS hit FROM d),
det AS (SELECT source, count(hit) FILTER (WHERE amp >= 1) AS n_cal, avg(hit::INT) FILTER (WHERE amp >= 1) AS detect_cal, avg(hit::INT) AS detect_all, count(hit) AS n FROM t GROUP BY source)"""


def trials(spark, sf):
    return judged(spark, sf).select("source", "lang", F.least(F.lit(3), F.floor(F.col("n_chars") / 400)).alias("amp"), (F.col("quality") == 1).alias("hit"))


def detection(spark, sf):
    t = trials(spark, sf)
    cal = F.when(F.col("amp") >= 1, F.col("hit"))
    return t.groupBy("source").agg(F.count(cal).alias("n_cal"), F.avg(cal.cast("double")).alias("detect_cal"), F.avg(F.col("hit").cast("double")).alias("detect_all"), F.count("hit").alias("n"))


@query("a5_tristate_recovery", "lang:s,amp:b,n:b,detect:d", "A5,C3", f"WITH {DET_SQL} SELECT lang, amp, count(hit) AS n, avg(hit::INT) AS detect FROM t GROUP BY lang, amp")
def _(spark, sf):
    return C.recovery(trials(spark, sf), ["lang", "amp"])


@query("c4_retained_set", "source:s,n_cal:b,detect_cal:d", "C4,O1", f"""
WITH {DET_SQL} SELECT source, n_cal, detect_cal FROM det WHERE n_cal >= 4 AND detect_cal >= 0.6""")
def _(spark, sf):
    k = detection(spark, sf).filter((F.col("n_cal") >= C.MIN_CASES) & (F.col("detect_cal") >= 0.6))
    return k.select("source", "n_cal", "detect_cal").orderBy(F.desc("detect_cal"), F.desc("n_cal"), "source")


@query("c6_frozen_configuration", "lang:s,source:s,detect_cal:d,frozen:s", "C6,W17,J6", f"""
WITH {DET_SQL}, l AS (SELECT lang, source, avg(hit::INT) AS detect_cal, count(hit) AS n FROM t GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY detect_cal DESC, source) AS rn, count(*) OVER (PARTITION BY lang) AS m FROM l WHERE n >= 2),
pick AS (SELECT lang, source, detect_cal FROM k WHERE rn = m // 2 + 1), old AS (SELECT lang, min(source) AS source FROM d WHERE toxic = 1 GROUP BY lang)
SELECT p.lang, coalesce(o.source, p.source) AS source, CASE WHEN o.source IS NULL THEN detect_cal END AS detect_cal, CASE WHEN o.source IS NULL THEN 'new' WHEN o.source = p.source THEN 'same' ELSE 'kept' END AS frozen FROM pick AS p LEFT JOIN old AS o USING (lang)""")
def _(spark, sf):
    l = judged(spark, sf)
    r = l.groupBy("lang", "source").agg(F.avg((F.col("quality") == 1).cast("double")).alias("detect_cal"), F.count("quality").alias("n")).filter("n >= 2")
    w = Window.partitionBy("lang").orderBy(F.desc("detect_cal"), "source")  # one row per source
    pick = r.select("*", F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy("lang")).alias("m")).filter(F.col("rn") == F.floor(F.col("m") / 2) + 1)
    old = l.filter("toxic = 1").groupBy("lang").agg(F.min("source").alias("held"))
    # What is frozen stands; a different choice is reported, never swapped in.
    j = pick.join(old, "lang", "left")
    state = F.when(F.col("held").isNull(), "new").when(F.col("held") == F.col("source"), "same").otherwise("kept")
    return j.select("lang", F.coalesce("held", "source").alias("source"), F.when(F.col("held").isNull(), F.col("detect_cal")).alias("detect_cal"), state.alias("frozen"))


@query("c7_channel_decision", "lang:s,current:s,selected:s,gain:b,why:s", "C7,J22,A26", f"""
WITH {DOC_SQL}, r AS (SELECT lang, CASE WHEN source < 'src13' THEN 'anom' WHEN source < 'src17' THEN 'min' ELSE 'contrast' END AS ch, count(quality) AS n, sum(quality) AS k FROM d GROUP BY ALL),
o AS (SELECT *, n >= 4 AND k / n::DOUBLE >= 0.5 AS ok FROM r), b AS (SELECT lang, arg_max(ch, k / n::DOUBLE) AS ch, max(k / n::DOUBLE) AS rate FROM o WHERE ok GROUP BY lang),
c AS (SELECT * FROM o WHERE ch = 'anom')
SELECT c.lang, 'anom' AS current, CASE WHEN b.ch IS NOT NULL AND b.ch <> 'anom' AND (NOT c.ok OR bk.k - c.k >= 3) THEN b.ch ELSE 'anom' END AS selected,
  CASE WHEN b.ch <> 'anom' THEN bk.k - c.k ELSE 0 END AS gain,
  CASE WHEN b.ch IS NULL OR b.ch = 'anom' THEN 'stands' WHEN NOT c.ok THEN 'below the floor' WHEN bk.k - c.k >= 3 THEN 'past the margin' ELSE 'inside the margin' END AS why
FROM c LEFT JOIN b ON b.lang = c.lang LEFT JOIN o AS bk ON bk.lang = b.lang AND bk.ch = b.ch""")
def _(spark, sf):
    ch = F.when(F.col("source") < "src13", "anom").when(F.col("source") < "src17", "min").otherwise("contrast")
    r = judged(spark, sf).groupBy("lang", ch.alias("ch")).agg(F.count("quality").alias("n"), F.sum("quality").alias("k"))
    r = r.withColumn("rate", F.col("k") / F.nullif(F.col("n"), F.lit(0))).withColumn("ok", (F.col("n") >= C.MIN_CASES) & (F.col("rate") >= 0.5))
    row = F.struct("ch", "k")
    g = r.groupBy("lang").agg(F.max_by(row, F.when(F.col("ok"), F.col("rate"))).alias("b"), F.max(F.col("ok")).alias("any"), F.max(F.when(F.col("ch") == "anom", F.struct("k", "ok"))).alias("c")).filter("c IS NOT NULL")
    other = F.col("any") & (F.col("b.ch") != "anom")
    gain = F.when(other, F.col("b.k") - F.col("c.k")).otherwise(F.lit(0))
    change = other & (~F.col("c.ok") | (gain >= 3))
    why = F.when(~other, "stands").when(~F.col("c.ok"), "below the floor").when(gain >= 3, "past the margin").otherwise("inside the margin")
    return g.select("lang", F.lit("anom").alias("current"), F.when(change, F.col("b.ch")).otherwise("anom").alias("selected"), gain.alias("gain"), why.alias("why"))


TILT_SQL = """r AS (SELECT l_linenumber / 10.0::DOUBLE AS lateral_, l_returnflag = 'A' AS zero_tilt, l_extendedprice / 199.7 AS rec, l_extendedprice / 199.7 - l_quantity * 3 AS err FROM lineitem),
g AS (SELECT lateral_, median(rec) FILTER (WHERE zero_tilt) AS drift, median(abs(err)) FILTER (WHERE NOT zero_tilt) AS error FROM r GROUP BY lateral_),
ok AS (SELECT *, drift <= 200 AS admitted FROM g), m AS (SELECT min(error) FILTER (WHERE admitted) AS best FROM ok)"""


@query("c8_lateral_weight_choice", "lateral_:d,drift:d,error:d,admitted:t,chosen:t", "C8", f"""
WITH {TILT_SQL} SELECT lateral_, drift, error, admitted, coalesce(admitted AND error <= 1.1 * best AND lateral_ = max(CASE WHEN admitted AND error <= 1.1 * best THEN lateral_ END) OVER (), false) AS chosen FROM ok, m""")
def _(spark, sf):
    l = T.table(spark, sf, "lineitem").select((F.col("l_linenumber") / 10.0).alias("lateral_"), (F.col("l_returnflag") == "A").alias("zero"), (F.col("l_extendedprice") / 199.7).alias("rec"), "l_quantity")
    l = l.withColumn("err", F.abs(F.col("rec") - F.col("l_quantity") * 3))
    drift = exact_percentiles(l.filter("zero"), ["lateral_"], "rec", {"drift": 0.5})
    err = exact_percentiles(l.filter("NOT zero"), ["lateral_"], "err", {"error": 0.5})
    g = drift.join(err, "lateral_").withColumn("admitted", F.col("drift") <= 200)
    w = Window.partitionBy()  # one row per lateral weight tried
    near = F.col("admitted") & (F.col("error") <= 1.1 * F.min(F.when(F.col("admitted"), F.col("error"))).over(w))
    g = g.withColumn("near", F.coalesce(near, F.lit(False)))
    return g.withColumn("chosen", F.coalesce(F.col("near") & (F.col("lateral_") == F.max(F.when(F.col("near"), F.col("lateral_"))).over(w)), F.lit(False)))


# ---- sets -----------------------------------------------------------------------------------------

# Cells of a network's map: a fixed number, as on any grid, so that overlaps do not thin out as the
# table of visits grows.
NET_CELLS = 2000
SHARE = 0.3


def visits(spark, sf):
    return T.table(spark, sf, "lineitem").select("l_suppkey", F.pmod(F.col("l_partkey"), F.lit(NET_CELLS)).alias("cell"))


@query("u3_linked_sets", "a:b,b:b,shared:b,frac_small:d,jaccard:d", "U3,D10,J7", f"""
WITH m AS (SELECT DISTINCT l_suppkey AS o, l_partkey % {NET_CELLS} AS m FROM lineitem), n AS (SELECT o, count(*) AS n FROM m GROUP BY o),
p AS (SELECT x.o AS a, y.o AS b, count(*) AS shared FROM m AS x JOIN m AS y ON x.m = y.m AND x.o < y.o GROUP BY ALL)
SELECT a, b, shared, shared / least(na.n, nb.n)::DOUBLE AS frac_small, shared / (na.n + nb.n - shared)::DOUBLE AS jaccard FROM p JOIN n AS na ON na.o = a JOIN n AS nb ON nb.o = b WHERE shared / least(na.n, nb.n)::DOUBLE >= {SHARE}""")
def _(spark, sf):
    return setops.linked_pairs(visits(spark, sf), "l_suppkey", "cell", SHARE)


NET_SQL = f"""m AS (SELECT DISTINCT l_suppkey AS o, l_partkey % {NET_CELLS} AS m FROM lineitem), n AS (SELECT o, count(*) AS n FROM m GROUP BY o),
p AS (SELECT x.o AS a, y.o AS b, count(*) AS shared FROM m AS x JOIN m AS y ON x.m = y.m AND x.o < y.o GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n AS na ON na.o = a JOIN n AS nb ON nb.o = b WHERE shared / least(na.n, nb.n)::DOUBLE >= {SHARE}),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (SELECT o AS src, o AS dst FROM n UNION SELECT r.src, s.b FROM reach AS r JOIN s ON s.a = r.dst),
c AS (SELECT src AS site, min(dst) AS component FROM reach GROUP BY src), d AS (SELECT a, count(*) AS degree FROM s GROUP BY a)"""


def network(spark, sf):
    """Every owner with its component of linked owners."""
    l = visits(spark, sf)
    e = keep(setops.linked_pairs(l, "l_suppkey", "cell", SHARE).select("a", "b"), "links")
    lab = setops.components(spark, l.select("l_suppkey").distinct(), e, "l_suppkey")
    deg = e.select("a").union(e.select("b")).groupBy("a").agg(F.count("*").alias("degree"))
    size = lab.groupBy("label").agg(F.count("*").alias("size"))
    j = lab.join(size, "label").join(deg, F.col("node") == F.col("a"), "left")
    return j.select(F.col("node").alias("site"), F.col("label").alias("component"), "size", F.coalesce("degree", F.lit(0)).alias("degree"), F.col("degree").isNull().alias("isolated"))


@query("g29_site_network", "site:b,component:b,size:b,degree:b,isolated:t", "G29,U3", f"""
WITH RECURSIVE {NET_SQL}
SELECT site, component, count(*) OVER (PARTITION BY component) AS size, coalesce(degree, 0) AS degree, degree IS NULL AS isolated FROM c LEFT JOIN d ON d.a = site""")
def _(spark, sf):
    return network(spark, sf)


@query("t27_cluster_test", "metric:s,n_components:b,n_isolated:b,n_linked:b,median_component:d,median_isolated:d,u:d,z:d,u_sites:d", "T27", f"""
WITH RECURSIVE {NET_SQL}, k AS (SELECT site, component, count(*) OVER (PARTITION BY component) AS size FROM c),
v AS (SELECT k.*, metric, x FROM k JOIN (SELECT s_suppkey AS site, 'balance' AS metric, s_acctbal AS x FROM supplier UNION ALL SELECT l_suppkey, 'quantity', sum(l_quantity) FROM lineitem GROUP BY l_suppkey) AS m USING (site)),
pt AS (SELECT metric, true AS linked, median(x) AS x FROM v WHERE size > 1 GROUP BY metric, component UNION ALL SELECT metric, false, x FROM v WHERE size = 1),
qt AS (SELECT metric, size > 1 AS linked, x FROM v),
rp AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY metric, x)::DOUBLE AS t FROM pt),
rq AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2.0::DOUBLE AS r FROM qt),
ta AS (SELECT metric, count(*) FILTER (WHERE linked)::DOUBLE AS n1, count(*) FILTER (WHERE NOT linked)::DOUBLE AS n2, count(*)::DOUBLE AS n, sum(r) FILTER (WHERE linked) AS s, sum(t * t - 1) AS ties,
  median(x) FILTER (WHERE linked) AS mc, median(x) FILTER (WHERE NOT linked) AS mi FROM rp GROUP BY metric),
tb AS (SELECT metric, count(*) FILTER (WHERE linked)::DOUBLE AS n1, sum(r) FILTER (WHERE linked) AS s FROM rq GROUP BY metric)
SELECT a.metric, a.n1 AS n_components, a.n2 AS n_isolated, b.n1 AS n_linked, mc AS median_component, mi AS median_isolated, a.s - a.n1 * (a.n1 + 1) / 2 AS u,
  (a.s - a.n1 * (a.n1 + 1) / 2 - a.n1 * a.n2 / 2) / sqrt(a.n1 * a.n2 / 12 * ((a.n + 1) - ties / (a.n * (a.n - 1)))) AS z, b.s - b.n1 * (b.n1 + 1) / 2 AS u_sites FROM ta AS a JOIN tb AS b USING (metric)""")
def _(spark, sf):
    """Linked sites of one component are not independent: each component counts once, with its median.

    The rank sum of components against isolated sites stands beside the one of all linked sites.
    """
    n = network(spark, sf).select("site", "component", "size")
    bal = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), F.lit("balance").alias("metric"), F.col("s_acctbal").cast("double").alias("x"))
    qty = T.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("site")).agg(F.sum("l_quantity").cast("double").alias("x")).select("site", F.lit("quantity").alias("metric"), "x")
    v = keep(n.join(bal.unionByName(qty), "site"), "cluster-values")
    linked = v.filter("size > 1")
    # A component can hold most sites: its median comes from counted values, cut in pieces.
    med = exact_percentiles(linked, ["metric", "component"], "x", {"m": 0.5}).select("metric", F.col("m").alias("x"))
    alone = v.filter("size = 1").select("metric", "x")
    both = keep(med.withColumn("grp", F.lit("linked")).unionByName(alone.withColumn("grp", F.lit("alone"))), "cluster-groups")
    mids = both.groupBy("metric").agg(F.median(F.when(F.col("grp") == "linked", F.col("x"))).alias("median_component"), F.median(F.when(F.col("grp") == "alone", F.col("x"))).alias("median_isolated"))
    c = St.mann_whitney(both, ["metric"], "grp", "linked", "x").join(mids, "metric")
    s = St.mann_whitney(v.withColumn("grp", F.when(F.col("size") > 1, "linked").otherwise("alone")), ["metric"], "grp", "linked", "x")
    s = s.select("metric", F.col("n1").alias("n_linked"), F.col("u").alias("u_sites"))
    return c.join(s, "metric").select("metric", F.col("n1").alias("n_components"), F.col("n2").alias("n_isolated"), "n_linked", "median_component", "median_isolated", "u", "z", "u_sites")


@query("u3_nation_jaccard", "a:b,b:b,shared:b,jaccard:d", "U3,T12", """
WITH m AS (SELECT DISTINCT s_nationkey AS o, l_partkey AS m FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), n AS (SELECT o, count(*) AS n FROM m GROUP BY o),
p AS (SELECT x.o AS a, y.o AS b, count(*) AS shared FROM m AS x JOIN m AS y ON x.m = y.m AND x.o < y.o GROUP BY ALL)
SELECT a, b, shared, shared / (na.n + nb.n - shared)::DOUBLE AS jaccard FROM p JOIN n AS na ON na.o = a JOIN n AS nb ON nb.o = b""")
def _(spark, sf):
    # A part carries the set of its nations, equal sets are counted, and only the sets are unfolded.
    # Parts with very many suppliers cost no more than others.
    l = T.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").join(T.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    p = l.groupBy("l_partkey").agg(F.array_sort(F.collect_set("s_nationkey")).alias("s")).groupBy("s").agg(F.count("*").alias("c"))
    size = p.select("c", F.explode("s").alias("o")).groupBy("o").agg(F.sum("c").alias("n"))
    ab = F.explode(F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b"))))))
    sh = p.select("c", ab.alias("r")).groupBy("r.a", "r.b").agg(F.sum("c").alias("shared"))
    j = sh.join(size.select(F.col("o").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("o").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


@query("u4_pooled_jaccard", "flag:s,runs:b,pooled:d", "U4,A14", """
WITH o AS (SELECT l_returnflag AS flag, l_suppkey AS cell, count(DISTINCT l_linenumber) AS c FROM lineitem GROUP BY ALL), n AS (SELECT l_returnflag AS flag, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY ALL)
SELECT flag, n AS runs, sum(c * (c - 1)) / sum(n * (n - 1) - (n - c) * (n - c - 1))::DOUBLE AS pooled FROM o JOIN n USING (flag) GROUP BY flag, n""")
def _(spark, sf):
    o = T.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("cell"), "l_linenumber").distinct()
    c = o.groupBy("flag", "cell").agg(F.count("*").alias("c"))
    n = o.groupBy("flag", "l_linenumber").count().groupBy("flag").agg(F.count("*").alias("n"))
    j = c.join(n, "flag")
    k, m = F.col("c"), F.col("n")
    return j.groupBy("flag", F.col("n").alias("runs")).agg((F.sum(k * (k - 1)) / F.sum(m * (m - 1) - (m - k) * (m - k - 1))).alias("pooled"))


@query("a14_occupancy", "site:b,cell:b,visits:b,share:d", "A14,D11", """
WITH n AS (SELECT count(DISTINCT l_linenumber) AS n FROM lineitem), d AS (SELECT DISTINCT l_suppkey AS site, l_partkey % 50 AS cell, l_linenumber FROM lineitem)
SELECT site, cell, count(*) AS visits, count(*) / n::DOUBLE AS share FROM d, n GROUP BY site, cell, n""")
def _(spark, sf):
    l = T.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("site"), F.pmod("l_partkey", F.lit(50)).alias("cell"), "l_linenumber")
    n = l.select("l_linenumber").distinct().agg(F.count("*").alias("n"))
    c = l.distinct().groupBy("site", "cell").agg(F.count("*").alias("visits"))
    return c.join(F.broadcast(n)).withColumn("share", F.col("visits") / F.col("n"))


@query("u1_replace_and_append", "tag:s,site:b,value:d", "U1,U2,U5,U6", """
WITH old AS (SELECT 'run_' || s_nationkey % 3 AS tag, s_suppkey AS site, s_acctbal AS value FROM supplier), new AS (SELECT 'run_1' AS tag, s_suppkey AS site, -s_acctbal AS value FROM supplier WHERE s_nationkey < 20),
u AS (SELECT * FROM old WHERE tag NOT IN (SELECT tag FROM new) UNION ALL SELECT * FROM new), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY tag) AS rn FROM u) SELECT tag, site, value FROM r WHERE rn = 1""")
def _(spark, sf):
    s = T.table(spark, sf, "supplier")
    old = s.select(F.concat(F.lit("run_"), F.pmod("s_nationkey", F.lit(3)).cast("string")).alias("tag"), F.col("s_suppkey").alias("site"), F.col("s_acctbal").alias("value"))
    new = s.filter("s_nationkey < 20").select(F.lit("run_1").alias("tag"), F.col("s_suppkey").alias("site"), (-F.col("s_acctbal")).alias("value"))
    u = old.join(new.select("tag").distinct(), "tag", "left_anti").unionByName(new, allowMissingColumns=True)
    return u.groupBy("site").agg(F.min_by(F.struct("tag", "value"), "tag").alias("r")).select("r.tag", "site", "r.value")


@query("j2_left_join_chain", "site:b,nation:s,region:s,orders_:b,deepest:d,quality:s", "J2,J3,J4,J5,J6,P14,F16,F18", """
WITH o AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) / 997 AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey AS site, replace(n_name, '_', ' ') AS nation, upper(r_name) AS region, coalesce(n, 0) AS orders_, coalesce(d, 0) AS deepest,
  CASE WHEN TRY_CAST(substr(c_name, 10) AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS quality
FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 495000)""")
def _(spark, sf):
    t = lambda n: T.table(spark, sf, n)
    o = t("orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"), (F.max("o_totalprice") / 997).alias("d"))
    c = t("customer").join(t("orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    c = c.join(t("orders").filter("o_totalprice > 495000").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_anti")
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    even = F.expr("try_cast(substring(c_name, 10) AS int)") % 2 == 0
    return j.select(F.col("c_custkey").alias("site"), F.regexp_replace("n_name", "_", " ").alias("nation"), F.upper("r_name").alias("region"), F.coalesce("n", F.lit(0)).alias("orders_"),
                    F.coalesce("d", F.lit(0.0)).alias("deepest"), F.when(even, "even").otherwise("odd").alias("quality"))


@query("c17_site_parameters", "site:b,w_shallow:d,w_mid:d,w_deep:d,n_mid:b,degree:b,basin:s", "C17,P11,A1,J8", """
WITH w AS (SELECT l_suppkey AS site, l_quantity * 60 - 60 AS depth, l_extendedprice / 997 AS width FROM lineitem),
g AS (SELECT site, median(width) FILTER (WHERE depth >= 200 AND depth < 660) AS w_shallow, median(width) FILTER (WHERE depth >= 660 AND depth < 1500) AS w_mid, median(width) FILTER (WHERE depth >= 1500 AND depth <= 2800) AS w_deep,
  count(*) FILTER (WHERE depth >= 660 AND depth < 1500) AS n_mid FROM w GROUP BY site), d AS (SELECT l_suppkey, count(DISTINCT l_linenumber) AS degree FROM lineitem GROUP BY l_suppkey)
SELECT g.*, degree, r_name AS basin FROM g JOIN d ON l_suppkey = site JOIN supplier ON s_suppkey = site JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def _(spark, sf):
    l = T.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("site"), (F.col("l_quantity") * 60 - 60).alias("depth"), (F.col("l_extendedprice") / 997).alias("width"), "l_linenumber")
    d = F.col("depth")
    band = F.when((d >= 200) & (d < 660), "w_shallow").when((d >= 660) & (d < 1500), "w_mid").when((d >= 1500) & (d <= 2800), "w_deep")
    b = l.withColumn("band", band).filter("band IS NOT NULL")
    med = exact_percentiles(b, ["site", "band"], "width", {"m": 0.5}).groupBy("site").pivot("band", ["w_shallow", "w_mid", "w_deep"]).agg(F.first("m"))
    n = l.groupBy("site").agg(F.count_if((d >= 660) & (d < 1500)).alias("n_mid"), F.count_distinct("l_linenumber").alias("degree"))
    s = T.table(spark, sf, "supplier").join(T.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(T.table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return n.join(med, "site", "left").join(s.select(F.col("s_suppkey").alias("site"), F.col("r_name").alias("basin")), "site")


@query("a23_crosstab", "flag:s,f:b,o:b,total:b", "A23,A24,A27", """
SELECT l_returnflag AS flag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o, count(*) AS total FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    state = lambda x: F.count_if(F.col("l_linestatus") == x)
    return T.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(state("F").alias("f"), state("O").alias("o"), F.count("*").alias("total"))


@query("a26_extreme_rows", "grp:s,deepest_site:b,deepest:d,shallowest_site:b,shallowest:d", "A26,O2", """
SELECT c_mktsegment AS grp, max_by(c_custkey, (c_acctbal, -c_custkey)) AS deepest_site, max(c_acctbal) AS deepest, min_by(c_custkey, (c_acctbal, c_custkey)) AS shallowest_site, min(c_acctbal) AS shallowest FROM customer GROUP BY c_mktsegment""")
def _(spark, sf):
    k, v = F.col("c_custkey"), F.col("c_acctbal")
    return T.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("grp")).agg(F.max_by(k, F.struct(v, -k)).alias("deepest_site"), F.max(v).alias("deepest"), F.min_by(k, F.struct(v, k)).alias("shallowest_site"), F.min(v).alias("shallowest"))


@query("a30_scatter_grid", "gx:b,gy:b,hits:b,weight:d,first_age:d", "A30,A18", """
SELECT floor(l_quantity / 10)::BIGINT AS gx, floor(l_discount * 50 + 1e-9)::BIGINT AS gy, count(*) AS hits, sum(l_tax) AS weight, min(date_diff('day', DATE '1992-01-01', l_shipdate::DATE)) / 365.25::DOUBLE AS first_age FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    age = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")) / 365.25
    return T.table(spark, sf, "lineitem").groupBy(F.floor(F.col("l_quantity") / 10).alias("gx"), F.floor(F.col("l_discount") * 50 + 1e-9).alias("gy")).agg(F.count("*").alias("hits"), F.sum("l_tax").alias("weight"), F.min(age).alias("first_age"))


@query("w16_stratified_subset", "grp:s,site:b,value:d,rn:b", "W16,W1", """
WITH r AS (SELECT c_mktsegment AS grp, c_custkey AS site, c_acctbal AS value, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
s AS (SELECT *, floor((rn - 1) * 9.0 / (n - 1))::INT AS a FROM r) SELECT grp, site, value, rn FROM s, (SELECT unnest(range(10)) AS q) AS z WHERE rn = 1 + round_even(q * (n - 1) / 9.0, 0)""")
def _(spark, sf):
    from terravox.operators.scaling import Ordered

    c = T.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("grp"), F.col("c_custkey").alias("site"), F.col("c_acctbal").alias("value"))
    n = c.groupBy("grp").agg(F.count("*").alias("n"))
    r = Ordered(c, ["grp"], ["value", "site"]).number("rn").result()
    pick = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda q: 1 + F.rint(q * (F.col("n") - 1) / 9.0).cast("bigint"))
    return r.join(n, "grp").filter(F.array_contains(pick, F.col("rn").cast("bigint"))).select("grp", "site", "value", "rn")


@query("t23_spread_between_models", "family:b,within_gap:d,sd_between:d,ratio:d", "T23", f"""
WITH {RUNS_SQL}, s AS (SELECT family, site, max(f) - min(f) AS gap, stddev_samp(f) AS sd FROM cls GROUP BY family, site)
SELECT family, median(gap) AS within_gap, median(sd) AS sd_between, median(sd) / median(gap) AS ratio FROM s GROUP BY family""")
def _(spark, sf):
    s = runs(spark, sf).groupBy("family", "site").agg((F.max("f") - F.min("f")).alias("gap"), F.stddev_samp("f").alias("sd"))
    return s.groupBy("family").agg(F.median("gap").alias("within_gap"), F.median("sd").alias("sd_between"), (F.median("sd") / F.median("gap")).alias("ratio"))
