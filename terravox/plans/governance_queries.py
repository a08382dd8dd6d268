"""Source parsing, reporting and governance on the given tables."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from terravox.operators import governance as G
from terravox.operators import statistics as St
from terravox.operators.scaling import exact_percentiles
from terravox.plans.registry import query
from terravox.session import keep, scratch_path
from terravox.sources import files, sinks
from terravox.sources import tables as T


@query("s6_dated_samples", "key:b,name:s,lat:d,lon:d,age:d", "S4,S5,S6,F18", """
SELECT o_orderkey AS key, o_orderpriority AS name, o_custkey % 180 - 90 AS lat, o_orderkey % 360 - 180 AS lon, o_totalprice / 1000 AS age FROM orders WHERE o_orderkey % 7 <> 0""")
def _(spark, sf):
    # Lines as a text file brings them: every seventh lacks an age or has a broken number.
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    age = F.when(k % 14 == 0, F.lit("n/a")).when(k % 7 == 0, F.lit("")).otherwise(s(F.col("o_totalprice") / 1000))
    line = F.concat_ws("\t", F.concat(F.lit(" "), "o_orderpriority"), s(F.pmod("o_custkey", F.lit(180)) - 90), s(F.pmod(k, F.lit(360)) - 180), age)
    return files.dated_samples(T.table(spark, sf, "orders").select(k.alias("key"), line.alias("value")))


@query("s7_path_documents", "site:s,n:b,depth:d,lat:d,lon:d", "S7,F21,K2,D9", f"""
WITH {T.CELLS_SQL} SELECT 'cell ' || model || '/' || j || '/' || i AS site, k AS n, depth_km AS depth, lat, anom AS lon FROM cells""")
def _(spark, sf):
    c = T.columns(spark, sf)
    site = F.concat(F.lit("cell "), F.concat_ws("/", F.col("model").cast("string"), F.col("j").cast("string"), F.col("i").cast("string")))
    body = F.struct(F.transform("v", lambda x: F.col("lat")).alias("lat"), F.col("v").alias("lon"), F.transform("v", lambda x, k: T.depth_of(k)).alias("depth"), F.lit(1.0).alias("root_fraction"))
    return files.path_nodes(c.select(F.to_json(F.create_map(site, body)).alias("value")))


@query("s8_composite_keys", "kind:s,site:s,n:b,total:d", "S8,P13,F20", """
SELECT l_returnflag AS kind, l_suppkey::VARCHAR AS site, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY l_returnflag, l_suppkey""")
def _(spark, sf):
    l = T.table(spark, sf, "lineitem").select(F.concat_ws("/", "l_returnflag", F.col("l_suppkey").cast("string")).alias("key"), "l_quantity")
    return files.keyed_arrays(l).groupBy("kind", "site").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))


@query("s12_tag_from_file_name", "tag:s,n:b", "S12,F20,S3", "SELECT 'supplier' AS tag, count(*) AS n FROM supplier UNION ALL SELECT 'customer', count(*) FROM customer")
def _(spark, sf):
    tag = F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)\.parquet$", 1)
    # A table may also be a folder of part files; then the folder carries the tag.
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.parquet(/.*)?$", 1)
    read = lambda n: T.table(spark, sf, n).select(F.when(F.col("_metadata.file_name").startswith("part-"), folder).otherwise(tag).alias("tag"))
    return read("supplier").unionByName(read("customer")).groupBy("tag").agg(F.count("*").alias("n"))


@query("f16_site_names", "site:b,base:s,clean:s,kept:s,label:s", "F16,F19,F20,P13,K8", """
SELECT p_partkey AS site, split_part(p_name, ' ', 1) AS base, regexp_replace(p_name, '[ _]+', '-', 'g') AS clean,
  array_to_string(list_filter(string_split(p_name || ';' || p_brand || ';', ';'), lambda x: x <> ''), '; ') AS kept,
  regexp_extract(p_type || '_' || p_brand, '^(ECONOMY|STANDARD|SMALL|[A-Z]+)_', 1) AS label FROM part""")
def _(spark, sf):
    return T.table(spark, sf, "part").select(
        F.col("p_partkey").alias("site"), F.split("p_name", " ")[0].alias("base"), F.regexp_replace("p_name", "[ _]+", "-").alias("clean"),
        F.array_join(F.filter(F.split(F.concat_ws(";", "p_name", "p_brand", F.lit("")), ";"), lambda x: x != ""), "; ").alias("kept"),
        F.regexp_extract(F.concat_ws("_", "p_type", "p_brand"), "^(ECONOMY|STANDARD|SMALL|[A-Z]+)_", 1).alias("label"))


@query("k8_markdown_table", "site:b,line:s", "K8,F17", """
SELECT s_suppkey AS site, '| ' || s_suppkey || ' | ' || printf('%.2f', s_acctbal / 100 + 0.001) || ' | ' || coalesce(CASE WHEN s_nationkey > 12 THEN s_nationkey::VARCHAR END, '-') || ' |' AS line FROM supplier""")
def _(spark, sf):
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), (F.col("s_acctbal") / 100 + 0.001).alias("v"), F.when(F.col("s_nationkey") > 12, F.col("s_nationkey")).alias("n"))
    return sinks.markdown_rows(s, ["site", "v", "n"]).select("site", "line")


# The sum over rows of the first 15 hex digits of a salted digest, twice; then a digest of both sums.
_ROW_TEXT = """'{"cents":' || round(o_totalprice * 100)::BIGINT || ',"day":' || date_diff('day', DATE '1970-01-01', o_orderdate::DATE) || ',"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}'"""


@query("k9_result_checksum", "n:b,sha256:s", "K9", f"""
WITH t AS (SELECT {_ROW_TEXT} AS x FROM orders), h AS (SELECT count(*) AS n, sum(('0x' || substr(sha256('a' || x), 1, 15))::BIGINT::HUGEINT) AS a, sum(('0x' || substr(sha256('b' || x), 1, 15))::BIGINT::HUGEINT) AS b FROM t)
SELECT n, sha256(n || '-' || a || '-' || b) AS sha256 FROM h""")
def _(spark, sf):
    o = T.table(spark, sf, "orders")
    cents, day = F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), F.unix_date(F.to_date("o_orderdate")).alias("day")
    return sinks.fingerprint(o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", cents, day))


@query("d17_statistics_document", "section:s,key:s,value:d", "D17,K2,A1,A3", """
WITH g AS (SELECT o_orderstatus AS section, count(*)::DOUBLE AS n, avg(o_totalprice) / 1000 AS mean, max(o_totalprice) / 1000 AS hi, count(*) FILTER (WHERE o_totalprice > 200000)::DOUBLE AS dear FROM orders GROUP BY o_orderstatus)
SELECT section, 'n' AS key, n AS value FROM g UNION ALL SELECT section, 'mean', mean FROM g UNION ALL SELECT section, 'max', hi FROM g UNION ALL SELECT section, 'n_dear', dear FROM g""")
def _(spark, sf):
    p = F.col("o_totalprice")
    g = T.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("section")).agg(F.count("*").cast("double").alias("n"), (F.avg(p) / 1000).alias("mean"), (F.max(p) / 1000).alias("max"), F.count_if(p > 200000).cast("double").alias("n_dear"))
    return g.unpivot(["section"], ["n", "mean", "max", "n_dear"], "key", "value")


@query("c25_provenance_verdicts", "name:b,verdict:s", "C25,D18", """
WITH i AS (SELECT l_orderkey AS name, max(l_shipdate) AS changed FROM lineitem GROUP BY l_orderkey), o AS (SELECT o_orderkey AS name, o_orderdate + INTERVAL 300 DAY AS written, o_orderstatus AS sha FROM orders),
s AS (SELECT o_orderkey AS name, CASE WHEN o_custkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS stamped FROM orders WHERE o_custkey % 5 <> 0)
SELECT o.name, CASE WHEN stamped IS NULL THEN 'unstamped' WHEN stamped <> sha THEN 'config mismatch' WHEN changed > written + INTERVAL 2 SECOND THEN 'stale' ELSE 'ok' END AS verdict FROM o LEFT JOIN s USING (name) LEFT JOIN i USING (name)""")
def _(spark, sf):
    o = T.table(spark, sf, "orders")
    name = F.col("o_orderkey").alias("name")
    out = o.select(name, (F.col("o_orderdate") + F.expr("INTERVAL 300 DAYS")).alias("written"), F.col("o_orderstatus").alias("settings_sha"))
    st = o.filter(F.col("o_custkey") % 5 != 0).select(name, F.when(F.col("o_custkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")).alias("settings_sha"))
    i = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_shipdate").alias("changed"))
    return G.verdicts(out, i, st)


@query("c26_freshness", "name:s,verdict:s,n:b", "C26", """
SELECT o_orderpriority AS name, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'fresh' WHEN o_orderpriority LIKE '5%' THEN 'excused' ELSE 'old' END AS verdict, count(*) AS n FROM orders GROUP BY ALL""")
def _(spark, sf):
    f = T.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("changed"))
    return G.fresh(f, F.to_timestamp(F.lit("1998-01-01")), ["5"]).groupBy("name", "verdict").agg(F.count("*").alias("n"))


@query("c27_audit", "label:b,quoted:d,value:d,ok:t", "C27", """
WITH c AS (SELECT l_suppkey AS label, avg(l_quantity) AS value FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_suppkey), e AS (SELECT s_suppkey AS label, 25.5 + (s_suppkey % 3) * 0.4 AS quoted FROM supplier WHERE s_nationkey <> 3)
SELECT label, quoted, value, coalesce(abs(value - quoted) <= 0.6, false) AS ok FROM e LEFT JOIN c USING (label)""")
def _(spark, sf):
    s = T.table(spark, sf, "supplier").filter("s_nationkey <> 3").select(F.col("s_suppkey").alias("label"), (25.5 + F.pmod("s_suppkey", F.lit(3)) * 0.4).alias("quoted"), F.lit(0.6).alias("tol"))
    c = T.table(spark, sf, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("label")).agg(F.avg("l_quantity").alias("value"))
    return G.audit(s, c, [])


@query("c28_resume", "case_:b,settings:s", "C28,J6", "SELECT o_orderkey AS case_, 'v1' AS settings FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def _(spark, sf):
    cases = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_"), F.lit("v1").alias("settings"))
    done = T.table(spark, sf, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("case_"), F.lit("v1").alias("settings"))
    return G.remaining(cases, done, ["case_"], "settings")


@query("c12_occupancy_bound", "occupancy:d,runs:b,excluded:b,all_exclude:t,bound:t", "C12,T3,A25", """
WITH l AS (SELECT l_discount AS occ, l_linestatus || l_returnflag AS run_, l_linenumber <= 3 AS obs, l_quantity + CASE WHEN l_linenumber <= 3 THEN 60 * l_discount ELSE 0 END AS v FROM lineitem),
k AS (SELECT *, rank() OVER (PARTITION BY occ, run_ ORDER BY v) + (count(*) OVER (PARTITION BY occ, run_, v) - 1) / 2.0::DOUBLE AS r FROM l),
t AS (SELECT occ, run_, sum(c * c * c - c) AS ties FROM (SELECT occ, run_, v, count(*)::DOUBLE AS c FROM k GROUP BY ALL) AS q GROUP BY ALL),
s AS (SELECT occ, run_, count(*) FILTER (WHERE obs)::DOUBLE AS n1, count(*) FILTER (WHERE NOT obs)::DOUBLE AS n2, sum(r) FILTER (WHERE obs) AS r1, count(*)::DOUBLE AS n FROM k GROUP BY ALL),
z AS (SELECT occ, run_, (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM s JOIN t USING (occ, run_)),
g AS (SELECT occ, count(*) AS runs, count(*) FILTER (WHERE z > 1.6449) AS excluded, bool_and(z > 1.6449) AS all_exclude FROM z GROUP BY occ)
SELECT occ AS occupancy, runs, excluded, all_exclude, coalesce(occ = (SELECT min(occ) FROM g WHERE all_exclude), false) AS bound FROM g""")
def _(spark, sf):
    obs = F.col("l_linenumber") <= 3
    l = T.table(spark, sf, "lineitem").select(F.col("l_discount").alias("occupancy"), F.concat("l_linestatus", "l_returnflag").alias("run_"), F.when(obs, "observed").otherwise("injected").alias("g"),
                                              (F.col("l_quantity") + F.when(obs, 60 * F.col("l_discount")).otherwise(0)).alias("v"))
    z = St.mann_whitney(l, ["occupancy", "run_"], "g", "observed", "v")
    out = F.col("z") > 1.6449  # one-sided 5 per cent
    g = z.groupBy("occupancy").agg(F.count("*").alias("runs"), F.count_if(out).alias("excluded"), F.bool_and(out).alias("all_exclude"))
    low = g.agg(F.min(F.when(F.col("all_exclude"), F.col("occupancy"))).alias("low"))  # one row
    return g.join(F.broadcast(low)).withColumn("bound", F.coalesce(F.col("occupancy") == F.col("low"), F.lit(False)))


@query("c13_axis_search", "radius:b,tol:d,auc:d,best:t,frozen:t", "C13,T4,A26", """
WITH l AS (SELECT l_linenumber AS radius, l_tax AS tol, l_returnflag = 'A' AS inj, l_quantity - CASE WHEN l_returnflag = 'A' THEN l_linenumber * 100 * l_tax ELSE 0 END AS v FROM lineitem),
k AS (SELECT *, rank() OVER (PARTITION BY radius, tol ORDER BY v) + (count(*) OVER (PARTITION BY radius, tol, v) - 1) / 2.0::DOUBLE AS r FROM l),
a AS (SELECT radius, tol, count(*) FILTER (WHERE inj)::DOUBLE AS n1, count(*) FILTER (WHERE NOT inj)::DOUBLE AS n2, sum(r) FILTER (WHERE inj) AS r1 FROM k GROUP BY ALL),
u AS (SELECT radius, tol, round(1 - (r1 - n1 * (n1 + 1) / 2) / (n1 * n2), 9) AS auc FROM a), b AS (SELECT *, row_number() OVER (ORDER BY auc DESC, radius, tol) = 1 AS best FROM u)
SELECT radius, tol, auc, best, best AND auc >= 0.6 AS frozen FROM b""")
def _(spark, sf):
    inj = F.col("l_returnflag") == "A"
    l = T.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("radius"), F.col("l_tax").alias("tol"), F.when(inj, "injected").otherwise("ambient").alias("g"),
                                              (F.col("l_quantity") - F.when(inj, F.col("l_linenumber") * 100 * F.col("l_tax")).otherwise(0)).alias("v"))
    u = St.mann_whitney(l, ["radius", "tol"], "g", "injected", "v").withColumn("auc", F.round("auc", 9))
    top = u.agg(F.min(F.struct((-F.col("auc")).alias("m"), "radius", "tol")).alias("t"))  # one row
    best = (F.col("radius") == F.col("t.radius")) & (F.col("tol") == F.col("t.tol"))
    return u.join(F.broadcast(top)).withColumn("best", best).withColumn("frozen", best & (F.col("auc") >= 0.6))


@query("c11_width_calibration", "flag:s,rho:d,medians:b,monotone:t,passes:t", "C11,T1,W2", """
WITH l AS (SELECT l_returnflag AS flag, l_quantity AS truth, l_extendedprice / 997 AS width, floor(l_quantity / 10) AS b FROM lineitem),
k AS (SELECT flag, rank() OVER (PARTITION BY flag ORDER BY truth) + (count(*) OVER (PARTITION BY flag, truth) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY flag ORDER BY width) + (count(*) OVER (PARTITION BY flag, width) - 1) / 2.0::DOUBLE AS y FROM l),
r AS (SELECT flag, corr(x, y) AS rho FROM k GROUP BY flag), m AS (SELECT flag, b, median(width) AS med FROM l GROUP BY ALL), d AS (SELECT flag, med - lag(med) OVER (PARTITION BY flag ORDER BY b) AS s FROM m),
g AS (SELECT flag, count(*) AS medians, bool_and(s > 0) AS monotone FROM d GROUP BY flag) SELECT flag, rho, medians, monotone, monotone AND rho >= 0.5 AS passes FROM r JOIN g USING (flag)""")
def _(spark, sf):
    from pyspark.sql import Window

    l = T.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("truth"), (F.col("l_extendedprice") / 997).alias("width"))
    # Equal rows are counted once for the ranks and for the medians.
    l = keep(l.groupBy("flag", "truth", "width").agg(F.count("*").alias("m")), "widths")
    rho = St.counted_rho(keep(St.average_ranks(l.filter("truth IS NOT NULL AND width IS NOT NULL"), ["flag"], ["truth", "width"], times="m"), "width-ranks"), ["flag"], "r_truth", "r_width", "m")
    med = exact_percentiles(l.withColumn("b", F.floor(F.col("truth") / 10)), ["flag", "b"], "width", {"med": 0.5}, times="m")
    w = Window.partitionBy("flag").orderBy("b")  # one row per width class
    g = med.withColumn("s", F.col("med") - F.lag("med").over(w)).groupBy("flag").agg(F.count("*").alias("medians"), F.bool_and(F.col("s") > 0).alias("monotone"))
    return rho.join(g, "flag").withColumn("passes", F.col("monotone") & (F.col("rho") >= 0.5))


@query("c14_frozen_configuration", "attempt:s,accepted:t,reason:s,lateral_:d,rows_:b", "C14,K9", """
WITH c AS (SELECT min(l_quantity) AS lateral_, count(*) AS rows_ FROM lineitem)
SELECT a.attempt, a.attempt = 'as frozen' AS accepted, a.reason, CASE WHEN a.attempt = 'as frozen' THEN lateral_ END AS lateral_, CASE WHEN a.attempt = 'as frozen' THEN rows_ END AS rows_
FROM c, (VALUES ('as frozen', ''), ('input changed', 'inputs'), ('other model', 'other model'), ('edited', 'edited'), ('frozen again', 'taken')) AS a(attempt, reason)""")
def _(spark, sf):
    """A configuration measured on a table is frozen and asked for five times; four have to be refused."""
    l = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    seen = l.agg(F.min("l_quantity").cast("double").alias("lateral_"), F.count(F.lit(1)).alias("rows_"), F.min("l_orderkey").alias("k")).first()
    path, settings = scratch_path(spark, "frozen"), {"lateral_": seen.lateral_, "rows_": seen.rows_}
    sealed = G.freeze(spark, path, settings, "model 0", {"lineitem": l})
    changed = l.withColumn("l_quantity", F.when(F.col("l_orderkey") == seen.k, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    forged = scratch_path(spark, "forged")
    sealed["settings"] = {**settings, "lateral_": 0.1}
    spark.createDataFrame([(json.dumps(sealed, sort_keys=True),)], "value string").coalesce(1).write.text(forged)
    tries = {
        "as frozen": lambda: G.thaw(spark, path, "model 0", {"lineitem": l}),
        "input changed": lambda: G.thaw(spark, path, "model 0", {"lineitem": changed}),
        "other model": lambda: G.thaw(spark, path, "model 1", {"lineitem": l}),
        "edited": lambda: G.thaw(spark, forged, "model 0", {"lineitem": l}),
        "frozen again": lambda: G.freeze(spark, path, settings, "model 0", {}),
    }
    rows = []
    for name, attempt in tries.items():
        try:
            got = attempt()
            rows.append((name, True, "", got["lateral_"], got["rows_"]))
        except ValueError as e:
            rows.append((name, False, str(e).split(":")[0], None, None))
        except AnalysisException as e:
            rows.append((name, False, "taken" if "PATH_ALREADY_EXISTS" in str(e) else str(e), None, None))
    return spark.createDataFrame(rows, "attempt string, accepted boolean, reason string, lateral_ double, rows_ bigint")
