"""Steps whose cost has to follow the rows: windows over short keys, counted rows, open pairs only."""

import random
import re
from functools import reduce
from operator import add

from pyspark.sql import functions as F

from terravox.operators import setops, spatial
from terravox.operators import statistics as St
from terravox.operators.scaling import Ordered, exact_percentiles
from terravox.plans import relational_queries as Q


def test_short_keys_are_not_cut(spark):
    df = spark.range(400).select((F.col("id") % 40).alias("g"), (F.col("id") * 7 % 400).alias("n"))
    o = Ordered(df, ["g"], "n", 50)
    assert not o.split and Ordered(df, [], "n", 50).split
    assert sorted(r.rn for r in o.number().result().filter("g = 3").collect()) == list(range(1, 11))


def test_counted_rows_stand_for_all(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(9), rng.randrange(40) / 8, rng.randrange(1, 6)) for _ in range(150)]
    few = spark.createDataFrame(rows, "x int, y double, m bigint").withColumn("g", F.lit(1))
    every = few.withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), "m"))).drop("_")
    r = St.average_ranks(every, ["g"], ["x", "y"]).agg(F.corr("r_x", "r_y").alias("rho")).first().rho
    got = St.counted_rho(St.average_ranks(few, ["g"], ["x", "y"], times="m"), ["g"], "r_x", "r_y", "m").first().rho
    assert abs(r - got) < 1e-12
    q = {"a": 0.25, "b": 0.5}
    assert exact_percentiles(few, ["g"], "y", q, times="m").collect() == exact_percentiles(every, ["g"], "y", q).collect()


def test_later_rounds_search_open_pairs_only(spark, monkeypatch):
    asked, plain = [], spatial.radius_join

    def noted(cells, points, radius, inner_km=0.0, by=None):
        asked.append((list(by or []), points.count()))
        return plain(cells, points, radius, inner_km, by)

    monkeypatch.setattr(spatial, "radius_join", noted)
    points = spark.createDataFrame([(n, 0.0, float(n)) for n in range(20)], "id int, lat double, lon double")
    targets = spark.createDataFrame([(1, n, 0.0, float(n)) for n in range(20)] + [(2, 5, 0.0, 5.0), (2, 6, 60.0, 6.0)], "m int, c int, lat double, lon double")
    got = {(r.id, r.m): r.c for r in spatial.nearest_join_by(points, targets, ["id"], ["c"], ["m"], 400.0).collect()}
    assert got == {(n, 1): n for n in range(20)} | {(n, 2): 5 for n in range(20)}
    assert asked[0] == ([], 20) and len(asked) > 1 and all(b == ["m"] and n < 20 for b, n in asked[1:])


def test_class_on_a_limit_does_not_depend_on_the_order(spark, tmp_path):
    rng = random.Random(1)
    while True:  # a mean of exactly 30 that sums to less in one order
        v = [rng.randrange(0, 6000) / 100 for _ in range(12)]
        v.append(round(390 - sum(v), 2))
        if reduce(add, v) / 13 < 30 <= reduce(add, sorted(v)) / 13:  # one by one: sum() would mend it
            break
    rows = [(u * 1000 + k * 100 + n, u, rater, x) for u, order in ((1, v), (2, sorted(v))) for k, rater in enumerate("abcde") for n, x in enumerate(order)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert {(r.site, r.c) for r in Q.votes(spark, str(tmp_path)).select("site", "c").distinct().collect()} == {(1, "deep"), (2, "deep")}


def test_axis_cells_are_not_shuffled_per_shell(spark):
    """Before: one row per place, model, cell and shell under an aggregate that sorts."""
    from terravox.plans import QUERIES

    plan = QUERIES["g35_axis_coherence"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"(?<!array_)min\((named_)?struct", plan) and "explode(q" not in plan


def test_pairs_of_owners_are_not_rows_of_a_join(spark):
    """Before: a row for every pair of owners and every member that they share."""
    rng = random.Random(3)
    common, few = [f"c{n}" for n in range(40)], [f"r{n}" for n in range(300)]
    sets = {o: {*rng.sample(common, rng.randrange(0, 30)), *rng.sample(few, rng.randrange(0, 6))} for o in range(70)}
    rows = [(o, m) for o, s in sets.items() for m in s]
    m = spark.createDataFrame(rows + rows[:50] + [(None, "c1"), (3, None)], "o bigint, m string")
    pairs = setops.linked_pairs(m, "o", "m", 0.4)
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    least = {(a, b): min(len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b}
    want = {(a, b): len(sets[a] & sets[b]) for (a, b), n in least.items() if n and len(sets[a] & sets[b]) / n >= 0.4}
    got = pairs.collect()
    assert want and {(r.a, r.b): r.shared for r in got} == want and len(got) == len(want)
    assert all(abs(r.frac_small - r.shared / least[r.a, r.b]) < 1e-12 and abs(r.jaccard - r.shared / len(sets[r.a] | sets[r.b])) < 1e-12 for r in got)


def test_growing_tables_do_not_pass_through_the_driver(spark):
    """Before: written tables of few bytes and many rows were broadcast."""
    from terravox.plans import QUERIES

    for name, keys in (("g48_structure_association", r"kind#\w+, _place"), ("j12_nearest_boundary", r"model#\w+, hj"), ("g20_competing_route", r"model#\w+, site#\w+")):
        plan = QUERIES[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        assert re.search(rf"SortMergeJoin \[{keys}", plan) and not re.search(rf"BroadcastHashJoin \[{keys}", plan), name
