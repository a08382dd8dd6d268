"""Sites kept apart: in a stated order, a site is taken if no site taken before it is near.

The one-by-one choice is made in rounds. A site that comes before everything left in the buckets its disc
touches is taken, whatever else happens; what lies near the taken ones goes, and the rest asks again. Only
the first site of each bucket asks, and it meets the first ones of the buckets around it, so the pairs of a
round follow from the number of buckets and not from how many sites stand in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.functions import geo
from terravox.operators import spatial
from terravox.operators.scaling import salted_join
from terravox.session import keep


def keep_apart(sites: DataFrame, keys: Sequence[str], order: Sequence[str], min_km: float) -> DataFrame:
    """The rows of ``sites`` that stay, all more than ``min_km`` apart within ``keys``.

    ``sites`` has lat and lon; ``order`` (no nulls) is unique within ``keys`` and smaller goes first. Rows
    without a position take no part.
    """
    names = sites.columns
    size = max(0.5, spatial._bands(min_km) / 2)
    bucket = [*keys, "_band", "_sector"]
    left = sites.filter("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)").withColumn("_o", F.struct(*order))
    left = keep(spatial.with_bucket(left, size), "apart")
    taken = left.limit(0).select(*names)
    while not left.isEmpty():
        first = left.groupBy(*bucket).agg(F.min(F.struct("_o", "lat", "lon")).alias("f"))
        first = first.select(*bucket, F.col("f._o").alias("_o"), F.col("f.lat").alias("lat"), F.col("f.lon").alias("lon"))
        around = spatial.spread_buckets(first.drop("_band", "_sector"), min_km, size)
        earlier = first.select(*bucket, F.col("_o").alias("_e"))
        blocked = around.join(earlier, bucket).filter(F.col("_e") < F.col("_o")).select(*keys, "_o").distinct()
        chosen = keep(first.select(*keys, "_o", "lat", "lon").join(blocked, [*keys, "_o"], "left_anti"), "apart-chosen")
        taken = taken.unionByName(left.join(chosen.select(*keys, "_o"), [*keys, "_o"], "left_semi").select(*names))
        disc = spatial.spread_buckets(chosen.select(*keys, F.col("_o").alias("_c"), "lat", "lon"), min_km, size)
        disc = disc.select(*bucket, "_c", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
        near = (geo.arc_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) <= min_km) | (F.col("_c") == F.col("_o"))
        gone = salted_join(left.select(*bucket, "_o", "lat", "lon"), disc, bucket).filter(near).select(*keys, "_o").distinct()
        left = keep(left.join(gone, [*keys, "_o"], "left_anti"), "apart")
    return taken
