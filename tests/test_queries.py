"""Every registered query against its SQL on the smallest tables, and a choice of them on several models."""

import duckdb
import pytest

from terravox.plans import QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# The smallest tables hold one model; these queries join, window or group over models.
OVER_MODELS = ["p2_percent_anomaly", "p9_percentile_mask", "p17_site_window", "a9_weighted_shell_comparison", "a11_spherical_centroid",
               "j10_inverse_square_bearing", "cap_percentile_vs_null", "g43_regrid_bilinear", "t19_weighted_area_sample", "t26_area_null_observed",
               "c31_margin_replicates", "g38_smoothed_contrast", "j12_nearest_boundary", "g35_axis_coherence", "c30_slab_comparison", "t24_matched_percentiles", "g40_named_shapes"]


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def canon(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    df = q.run(spark, SF)
    cols = sorted(df.columns)
    got = canon([tuple(r) for r in df.select(*cols).collect()])
    if q.sql is None:
        # Values are checked by the tests of the operators; here the rows must be there, each once.
        assert got and len(set(map(str, got))) == len(got)
        return
    names = ", ".join(f'"{c}"' for c in cols)
    want = canon(con.sql(f"select {names} from ({q.sql})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", OVER_MODELS)
def test_query_over_several_models(spark, name):
    q = QUERIES[name]
    df = q.run(spark, LARGER)
    cols = sorted(df.columns)
    names = ", ".join(f'"{c}"' for c in cols)
    want = canon(connect(LARGER).sql(f"select {names} from ({q.sql})").fetchall())
    assert canon([tuple(r) for r in df.select(*cols).collect()]) == want
    assert "model" not in cols or len({r[cols.index("model")] for r in want}) > 1
