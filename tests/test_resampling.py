"""Permutation tests against enumeration and against their own draws."""

import hashlib
import math
from itertools import combinations

import numpy as np
import pytest

from terravox.operators import resampling as P


def test_unrank_gives_all_combinations_in_order():
    for n, k in ((1, 1), (6, 3), (9, 1), (8, 7), (10, 4)):
        assert [tuple(r) for r in P.unrank(np.arange(math.comb(n, k)), n, k).tolist()] == list(combinations(range(n), k))


def units(spark, v, n1):
    return spark.createDataFrame([(i, float(x), i % 2 == 0 if n1 is None else i < n1) for i, x in enumerate(v)] + [(900, None, True)], "unit bigint, v double, first_ boolean")


@pytest.mark.parametrize("statistic", ["mean", "median"])
@pytest.mark.parametrize("n1", [3, 7])
def test_exact_p(spark, statistic, n1):
    v = np.random.default_rng(3).normal(0, 1, 10).round(1)
    v[:n1] += 0.8
    mid = np.median if statistic == "median" else np.mean
    diff = lambda c: round(abs(mid(v[list(c)]) - mid(np.delete(v, list(c)))), 9)
    want = [diff(c) >= diff(range(n1)) for c in combinations(range(10), n1)]
    r = P.permutation_test(units(spark, v, n1), statistic, True).first()
    assert (r.how, r.draws) == ("exact", math.comb(10, n1)) and abs(r.p - np.mean(want)) < 1e-12 and abs(r.observed - diff(range(n1))) < 1e-12


@pytest.mark.parametrize("plus_one", [True, False])
def test_drawn_p_follows_the_digest_order(spark, plus_one):
    v = np.random.default_rng(4).normal(0, 1, 14)
    r = P.permutation_test(units(spark, v, 6), "median", plus_one, seed=5, draws=300, most_splits=10).first()
    obs, hits = round(abs(np.median(v[:6]) - np.median(v[6:])), 9), 0
    for d in range(300):
        order = sorted(range(14), key=lambda u: (hashlib.md5(f"5/{d}/{u}".encode()).hexdigest(), u))
        hits += round(abs(np.median(v[order[:6]]) - np.median(v[order[6:]])), 9) >= obs
    assert (r.how, r.draws) == ("drawn", 300)
    assert abs(r.p - ((hits + 1) / 301 if plus_one else hits / 300)) < 1e-12


def test_one_group_only(spark):
    r = P.permutation_test(units(spark, [1.0, 2.0], 5), "mean", True).first()
    assert r.how == "none" and r.p is None
