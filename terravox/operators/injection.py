"""Known conduits added to a field, and what a search makes of them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravox.functions import geo

# Depth range and taper of an injected conduit in km, its radius, its azimuth.
TOP_KM, BASE_KM, TAPER_KM = 100.0, 2800.0, 200.0
RADIUS_KM, AZIMUTH_DEG = 300.0, 45.0
LEAN_COS_FLOOR = 0.2


# Share of the full offset that is reached at a depth: a steady lean, or one that is concentrated
# between 410 and 660 km.
LEAN = {"uniform": ((TOP_KM, 0.0), (BASE_KM, 1.0)), "transition": ((TOP_KM, 0.0), (410.0, 0.15), (660.0, 0.65), (BASE_KM, 1.0))}


def axis(case: dict, depth: Sequence[float], duty: float = 1.0, segment_km: float = 400.0) -> dict:
    """Centre and strength of a conduit at every shell, by table lookup over the depths.

    ``duty`` is the share of each depth segment in which the conduit is present; towards the base its
    strength falls to zero along a straight ramp.
    """
    z = np.asarray(depth, float)
    at, share = zip(*LEAN.get(case["profile"], LEAN["transition"]))
    north, east = math.cos(math.radians(AZIMUTH_DEG)), math.sin(math.radians(AZIMUTH_DEG))
    offset = case["tilt"] * np.interp(z, at, share)
    lat = case["ilat"] + north * offset
    lon = case["ilon"] + east * offset / np.maximum(np.cos(np.radians(lat)), LEAN_COS_FLOOR)
    phase = np.mod(z - TOP_KM, segment_km) / segment_km
    strength = np.clip((BASE_KM - z) / TAPER_KM, 0.0, 1.0) * (z >= TOP_KM) * (phase < duty)
    return {"variant": case["variant"], "lat": lat.tolist(), "lon": lon.tolist(), "amp": (case["amp"] * strength).tolist()}


def inject(cells: DataFrame, cases: Sequence[dict], depth: Sequence[float], radius_km: float = RADIUS_KM, duty: float = 1.0) -> DataFrame:
    """One injected copy of every cell (model, j, i, lat, lon, k, anom) per case.

    The cases are a few dozen parameter rows. Their axes ride along as a literal, so the field is
    read once, no join takes place and the added anomaly is one generated expression per cell.
    """
    spec = [axis(c, depth, duty) for c in cases]
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    lit = F.array(*[F.struct(F.lit(s["variant"]).alias("variant"), numbers(s["lat"]).alias("lat"), numbers(s["lon"]).alias("lon"), numbers(s["amp"]).alias("amp")) for s in spec])
    c = cells.withColumn("q", F.explode(lit))
    d = geo.arc_km(F.col("q.lat")[F.col("k")], F.col("q.lon")[F.col("k")], F.col("lat"), F.col("lon"))
    added = F.col("q.amp")[F.col("k")] * geo.gaussian_falloff(d, radius_km)
    return c.withColumn("anom", F.col("anom") + added).withColumn("variant", F.col("q.variant")).drop("q")


def verdict(pre: Column, threshold: Column, cost: Column) -> Column:
    """Hit or miss of an injected conduit; NULL where the site was rooted before the injection."""
    found = F.coalesce(cost, F.lit(float("inf"))) < threshold
    return F.when(pre < threshold, F.lit(None).cast("boolean")).otherwise(found)
