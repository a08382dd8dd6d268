"""Sites kept apart against the choice one by one; signed ranks against all choices of signs."""

import itertools
import random

import pytest

from terravox.operators import separation
from terravox.operators import statistics as St
from test_structures import km


def one_by_one(sites, min_km):
    taken = []
    for key, turn, lat, lon in sorted(s for s in sites if s[2] is not None):
        if all(k != key or km((a, b), (lat, lon)) > min_km for k, _, a, b in taken):
            taken.append((key, turn, lat, lon))
    return {(k, t) for k, t, _, _ in taken}


@pytest.mark.parametrize("seed,n,min_km", [(1, 150, 1500.0), (2, 250, 4000.0), (3, 60, 9000.0)])
def test_sites_kept_apart(spark, seed, n, min_km):
    rng = random.Random(seed)
    sites = [(t % 2, t, rng.uniform(-90, 90), rng.uniform(-180, 180)) for t in range(n)]
    # A third stands in one place; poles and the date line; no position.
    sites += [(0, n + t, 12.0, 179.9) for t in range(n // 2)] + [(1, -1, 90.0, 10.0), (1, -2, -90.0, 0.0), (0, -3, None, 1.0)]
    df = spark.createDataFrame(sites, "grp int, turn int, lat double, lon double")
    got = separation.keep_apart(df, ["grp"], ["turn"], min_km)
    assert got.columns == df.columns
    rows = [(r.grp, r.turn) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == one_by_one(sites, min_km)


def test_no_sites(spark):
    df = spark.createDataFrame([], "grp int, turn int, lat double, lon double")
    assert separation.keep_apart(df, ["grp"], ["turn"], 100.0).count() == 0


def ranks(values):
    order = sorted(abs(v) for v in values)
    return [(2 * order.index(abs(v)) + order.count(abs(v)) + 1) / 2 for v in values]


def test_signed_rank_against_all_signs(spark):
    rng = random.Random(4)
    groups = {g: rng.sample([x / 7 for x in range(-40, 61) if x > 0 or -x / 7 not in [y / 7 for y in range(1, 61)]] or [1.0], min(n, 30)) for g, n in ((1, 1), (2, 6), (3, 11))}
    groups = {g: [v if rng.random() < 0.7 else -v for v in vs] for g, vs in groups.items()}
    tied = [1.0, -1.0, 2.0, 2.0, 2.0, -3.0, 0.0]
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [(9, v) for v in tied] + [(9, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r for r in St.p_of_signed_rank(St.signed_rank(df, ["g"], "v")).collect()}
    for g, vs in groups.items():
        r = ranks(vs)
        plus = sum(x for x, v in zip(r, vs) if v > 0)
        w = min(plus, sum(r) - plus)
        sums = [sum(x for x, s in zip(r, signs) if s) for signs in itertools.product((0, 1), repeat=len(r))]
        assert (got[g].n, got[g].w_plus) == (len(vs), plus)
        assert got[g].p == pytest.approx(min(1.0, 2 * sum(x <= w for x in sums) / len(sums)), abs=1e-12)
    # With ties: the normal law, with the variance of the average ranks.
    vs = [v for v in tied if v]
    r = ranks(vs)
    z = (min(sum(x for x, v in zip(r, vs) if v > 0), sum(x for x, v in zip(r, vs) if v < 0)) - sum(r) / 2) / (sum(x * x for x in r) / 4) ** 0.5
    assert got[9].n == 6 and got[9].z == pytest.approx(z) and 0 < got[9].p < 1
