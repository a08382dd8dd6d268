"""A last model that the table holds only in part: whole grid rows and a piece of one."""

import os

import duckdb
import pytest

from terravox.plans import QUERIES

SF, TABLES = "/root/testdata/sf0.001", "supplier customer orders lineitem documents labels".split()
AGAINST_SQL = ["g6_cost_field_in_bands", "g9_site_cost", "g10_path_price", "g12_excess_cost", "g16_corridor_widths", "g17_bottleneck_field", "g19_frontier", "g24_components", "g37_spherical_smoothing",
               "g38_smoothed_contrast", "g39_injection", "c30_slab_classes", "c30_slab_comparison"]
ROWS_ONLY = ["g15_step_counting_trace", "g18_accepted_worst_point", "g20_competing_route", "g22_path_occupancy", "c20_root_flips", "c32_endpoint_test", "g34_tube_detector", "g47_structure_table"]


@pytest.fixture(scope="module")
def part(tmp_path_factory):
    """One whole model and 256 cells of the next."""
    d = tmp_path_factory.mktemp("part")
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", d / f"{t}.parquet")
    duckdb.sql(f"copy (select * from '/root/testdata/sf0.1/embeddings.parquet' where vec_id < 756) to '{d}/embeddings.parquet' (format parquet)")
    return str(d)


@pytest.mark.parametrize("name", AGAINST_SQL)
def test_against_sql(spark, part, name):
    con = duckdb.connect()
    for t in [*TABLES, "embeddings"]:
        con.execute(f"create view {t} as select * from '{part}/{t}.parquet'")
    df = QUERIES[name].run(spark, part)
    cols = sorted(df.columns)
    rows = sorted([tuple(r) for r in df.select(*cols).collect()], key=str)
    want = sorted(con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({QUERIES[name].sql})").fetchall(), key=str)
    assert {r[cols.index("model")] for r in want} == {0, 1}
    assert rows == want


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_of_both_models(spark, part, name):
    assert {r.model for r in QUERIES[name].run(spark, part).select("model").distinct().collect()} == {0, 1}
