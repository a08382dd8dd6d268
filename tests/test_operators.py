"""Tails, kernels, files, sinks, governance and the resumable stream."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.operators import governance, injection, profiles, topology
from terravox.operators import statistics as St
from terravox.sources import files, sinks
from terravox.streaming.cases import resume_stream


def test_tails_against_known_values():
    assert abs(St.t_two_sided(2.0, 10) - 0.0733880) < 1e-6
    assert abs(St.t_two_sided(0.5, 3) - 0.6514479) < 1e-6
    assert abs(St.t_two_sided(12.0, 200) - 0.0) < 1e-20
    assert abs(St.chi2_upper(3.841459, 1) - 0.05) < 1e-6
    assert abs(St.chi2_upper(18.307038, 10) - 0.05) < 1e-6
    for a, b, c, d in itertools.product(range(1, 5), repeat=4):
        n, r, k = a + b + c + d, a + b, a + c
        want = sum(math.comb(r, x) * math.comb(n - r, k - x) for x in range(a, min(r, k) + 1)) / math.comb(n, k)
        assert abs(St.fisher_upper(a, b, c, d) - want) < 1e-12
    assert 0 <= St.fisher_upper(60000, 10, 20, 50000) < 1e-300 or St.fisher_upper(60000, 10, 20, 50000) == 0


def test_labels_wrap_and_match_flood_fill():
    rng = np.random.default_rng(4)
    on = rng.random((12, 17)) < 0.5
    lab = topology.label_cells(on)
    seen = -np.ones(on.shape, int)
    for start in range(on.size):
        j, i = divmod(start, 17)
        if not on[j, i] or seen[j, i] >= 0:
            continue
        stack = [(j, i)]
        seen[j, i] = start
        while stack:
            y, x = stack.pop()
            for q in ((y + 1, x), (y - 1, x), (y, (x + 1) % 17), (y, (x - 1) % 17)):
                if 0 <= q[0] < 12 and on[q] and seen[q] < 0:
                    seen[q] = start
                    stack.append(q)
    assert (lab == seen).all()


def test_profile_runs(spark):
    cases = [[True, True, False, True, True, True, False], [False] * 7, [True] * 7, [True, False, False, True, True, False, True]]
    d = spark.createDataFrame([(n, c) for n, c in enumerate(cases)], "n int, f array<boolean>")
    r = d.select("n", profiles.longest_run(F.col("f")).alias("r"), profiles.leading_run(F.col("f")).alias("lead"), profiles.gap_tolerant_reach(F.col("f"), 1).alias("g1"),
                 profiles.gap_tolerant_reach(F.col("f"), 2).alias("g2"), profiles.first_sustained(F.col("f"), 3).alias("s3")).orderBy("n").collect()
    assert [(x.r.length, x.r.start, x.lead, x.g1, x.g2, x.s3) for x in r] == [(3, 3, 2, 5, 5, 3), (0, -1, 0, None, None, None), (7, 0, 7, 6, 6, 0), (2, 3, 1, 0, 6, None)]


def test_injection_axis_and_duty():
    depth = [25.0 * k for k in range(120)]
    case = dict(variant=0, ilat=10.0, ilon=20.0, amp=-1.0, tilt=10.0, profile="uniform")
    full, half = injection.axis(case, depth), injection.axis(case, depth, duty=0.5)
    inside = [k for k, z in enumerate(depth) if 100 <= z < 2600]
    assert all(full["amp"][k] == -1.0 for k in inside) and full["amp"][0] == 0.0
    share = sum(half["amp"][k] != 0 for k in inside) / len(inside)
    assert abs(share - 0.5) < 0.03
    assert full["lat"][inside[0]] < full["lat"][inside[-1]]


def test_verdict_is_tristate(spark):
    d = spark.createDataFrame([(5.0, 4.0, 3.0), (5.0, 4.0, 6.0), (3.0, 4.0, 1.0), (5.0, 4.0, None)], "pre double, t double, c double")
    assert [r[0] for r in d.select(injection.verdict(F.col("pre"), F.col("t"), F.col("c"))).collect()] == [True, False, None, False]


def test_files(spark, tmp_path):
    (tmp_path / "classification_A_30km.csv").write_text("hotspot,lat,lon_180,count,he_ratio\nX,1.5,2.5,3,high\n")
    (tmp_path / "classification_B.csv").write_text("hotspot,lat,lon_180,count,he_ratio\nY,,2.5,,\n")
    got = {(r.hotspot, r.tag, r.lat) for r in files.tagged(spark, f"{tmp_path}/classification_*.csv", files.SITES, "classification_").collect()}
    assert got == {("X", "A_30km", 1.5), ("Y", "B", None)}
    (tmp_path / "rank.csv").write_text("# note\n# more\nrank,hotspot\n1,\"A, b\"\n")
    assert [tuple(r) for r in files.csv_table(spark, f"{tmp_path}/rank.csv", "rank int, hotspot string", "#").collect()] == [(1, "A, b")]
    (tmp_path / "line.json").write_text('{"features":[{"properties":{},"geometry":{"type":"LineString","coordinates":[[1.0,2.0],[3.0,4.0]]}}]}')
    assert [(r.seg, r.lat, r.lon) for r in files.lines_geojson(spark, f"{tmp_path}/line.json").collect()] == [(0, 2.0, 1.0), (1, 4.0, 3.0)]
    assert files.newest(spark, f"{tmp_path}/*.csv").first().path.endswith(".csv")


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.range(5).withColumn("tag", F.lit("a"))
    sinks.replace_table(df, p)
    sinks.replace_table(df.limit(2), p)
    assert sinks.current_table(spark, p).count() == 2
    with pytest.raises(ValueError):
        sinks.replace_table(df.filter("id > 99"), p)
    assert sinks.current_table(spark, p).count() == 2
    with pytest.raises(FileNotFoundError):
        sinks.current_table(spark, str(tmp_path / "none"))
    sinks.csv_export(df, str(tmp_path / "csv"))
    sinks.json_export(df, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "json")).collect()) == [0, 1, 2, 3, 4]
    q = str(tmp_path / "tags")
    sinks.replace_tag(df.unionByName(df.withColumn("tag", F.lit("b"))), q)
    sinks.replace_tag(df.limit(1), q)
    assert {(r.tag, r["count"]) for r in spark.read.parquet(q).groupBy("tag").count().collect()} == {("a", 1), ("b", 5)}
    with pytest.raises(ValueError):
        sinks.masks(spark.createDataFrame([(0, 9)], "j int, i int"), {"j": 4, "i": 9}, str(tmp_path / "m"))
    a, b = sinks.fingerprint(df.repartition(3)).first(), sinks.fingerprint(df.repartition(1)).first()
    assert a == b != sinks.fingerprint(df.limit(4)).first()


def test_governance(spark):
    out = spark.createDataFrame([(n, 100 + n, "s") for n in range(4)], "name int, w long, settings_sha string").withColumn("written", F.timestamp_seconds("w")).drop("w")
    inp = spark.createDataFrame([(0, 90), (1, 102), (2, 105), (3, 1)], "name int, c long").withColumn("changed", F.timestamp_seconds("c")).drop("c")
    st = spark.createDataFrame([(0, "s"), (1, "s"), (2, "s"), (3, "other")], "name int, settings_sha string")
    v = governance.verdicts(out, inp, st)
    assert {r.name: r.verdict for r in v.collect()} == {0: "ok", 1: "ok", 2: "stale", 3: "config mismatch"}
    with pytest.raises(Exception, match="is stale|is config"):
        governance.require(v).collect()
    cases = spark.createDataFrame([(1, "v"), (2, "v")], "case int, settings_sha string")
    assert [r.case for r in governance.remaining(cases, cases.filter("case = 1"), ["case"]).collect()] == [2]
    with pytest.raises(ValueError):
        governance.remaining(cases, cases.withColumn("settings_sha", F.lit("w")), ["case"])


def test_resumable_stream(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 3.0)], "case int, x double").write.parquet(src)
    run = lambda ck: resume_stream(spark, src, "case int, x double", out, str(tmp_path / ck), ["case"], lambda d: d.withColumn("y", F.col("x") * 2)).awaitTermination()
    run("ck")
    spark.createDataFrame([(2, 3.0), (3, 4.0)], "case int, x double").write.mode("append").parquet(src)
    run("ck")
    run("lost-checkpoint")
    assert sorted((r.case, r.y) for r in spark.read.parquet(out).collect()) == [(1, 4.0), (2, 6.0), (3, 8.0)]
