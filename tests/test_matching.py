"""Matching in rounds against matching one by one."""

import random

import pytest

from terravox.operators import matching


def one_by_one(takers, pool, k):
    left, out = {m: x for m, x in pool if x is not None and x == x}, set()
    for t, v in sorted(takers):
        if v is None or v != v:
            continue
        for m in sorted(left, key=lambda m: (abs(left[m] - v), m))[:k]:
            out.add((t, m))
            del left[m]
    return out


def frames(spark, takers, pool):
    return (spark.createDataFrame(x, "site bigint, x double") for x in (takers, pool))


@pytest.mark.parametrize("seed,n,m,values,piece", [(1, 20, 150, 1000, 2_000_000), (2, 30, 70, 6, 40)])
def test_matches_equal_one_by_one(spark, seed, n, m, values, piece):
    rng = random.Random(seed)
    takers = [(i, float(rng.randrange(values))) for i in range(n)] + [(900, None), (901, float("nan"))]
    pool = [(i, float(rng.randrange(values))) for i in range(m)] + [(5000, None)]
    a, b = frames(spark, takers, pool)
    got = matching.nearest_matches(a, b, 3, rows_per_piece=piece)
    assert {(r.taker, r.member) for r in got.collect()} == one_by_one(takers, pool, 3)


def test_many_takers_of_one_value(spark):
    takers, pool = [(i, 5.0) for i in range(30)], [(i, float(i % 17)) for i in range(70)]
    a, b = frames(spark, takers, pool)
    got = {(r.taker, r.member) for r in matching.nearest_matches(a, b, 2, rows_per_piece=30).collect()}
    assert got == one_by_one(takers, pool, 2) and len(got) == 60


def test_no_pool_and_no_takers(spark):
    a, b = frames(spark, [(1, 2.0)], [(1, 2.0), (2, 2.5)])
    assert matching.nearest_matches(a, b.filter("false"), 3).count() == 0
    assert matching.nearest_matches(a.filter("false"), b, 3).count() == 0
    assert sorted(r.gap for r in matching.nearest_matches(a, b, 3).collect()) == [0.0, 0.5]


def test_nearest_members_may_be_shared(spark):
    takers, pool = [(1, 2.0), (2, 2.1), (3, 9.0)], [(i, i / 2) for i in range(12)]
    a, b = frames(spark, takers, pool)
    want = {(t, m) for t, v in takers for m in sorted(dict(pool), key=lambda m: (abs(m / 2 - v), m))[:4]}
    assert {(r.taker, r.member) for r in matching.nearest_members(a, b, 4).collect()} == want
