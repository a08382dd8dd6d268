"""Operators on ordered polylines: one row per node, keyed by path and node number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravox.functions import geo
from terravox.operators.scaling import Ordered, exact_percentiles

# Deflection rule (km of window, smallest angle, shortest leg, fewest nodes).
WINDOW_KM = 300.0
MIN_ANGLE_DEG = 10.0
MIN_LEG_KM = 30.0
MIN_NODES = 12


def segments(nodes: DataFrame) -> DataFrame:
    """Adds the previous node and the lateral, vertical and full length of the step into each node."""
    s = Ordered(nodes, ["path"], "n").lag(["depth", "lat", "lon"]).result()
    lateral = geo.arc_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    s = s.withColumn("lat_km", lateral).withColumn("drop", F.abs(F.col("depth") - F.col("prev_depth")))
    return s.withColumn("seg", F.sqrt(F.col("lat_km") * F.col("lat_km") + F.col("drop") * F.col("drop")))


def with_start(nodes: DataFrame, cols: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """Adds the first node of the path to each row as ``first_*``.

    The first nodes are few per path, so they are joined back; a path that holds a large share of
    the rows is split by the skew-join rule of adaptive execution.
    """
    first = nodes.groupBy("path").agg(F.min_by(F.struct(*cols), F.col("n")).alias("_f"))
    j = nodes.join(first, "path")
    return j.select(*nodes.columns, *[F.col(f"_f.{c}").alias(f"first_{c}") for c in cols])


def shape(nodes: DataFrame, bands: list[tuple[float, float]]) -> DataFrame:
    """Tortuosity, tilt, largest offset and where the lateral movement happens, per path."""
    s = with_start(segments(nodes))
    off = F.round(geo.arc_km(F.col("first_lat"), F.col("first_lon"), F.col("lat"), F.col("lon")), 6)
    s = s.withColumn("off", off).withColumn("mid", (F.col("prev_depth") + F.col("depth")) / 2)
    band = {f"lat_{lo:.0f}_{hi:.0f}": F.coalesce(F.sum(F.when((F.col("mid") >= lo) & (F.col("mid") < hi), F.col("lat_km"))), F.lit(0.0)) for lo, hi in bands}
    g = s.groupBy("path").agg(
        F.sum("seg").alias("length"), F.sum("lat_km").alias("lateral_total_km"),
        (F.max("depth") - F.min("depth")).alias("span"), F.max("off").alias("max_offset_km"),
        F.max_by("depth", F.struct("off", -F.col("n"))).alias("max_offset_depth_km"),
        *[c.alias(n) for n, c in band.items()],
    )
    # Below one kilometre of travel the rest is rounding of the arccos, not movement.
    moved = F.col("lateral_total_km") >= 1.0
    return g.select(
        "path", F.when(F.col("span") > 0, F.col("length") / F.col("span")).alias("tortuosity"), "lateral_total_km",
        "max_offset_km", "max_offset_depth_km", F.degrees(F.atan2("lateral_total_km", "span")).alias("mean_tilt_deg"),
        *band, *[F.when(moved, F.col(n) / F.col("lateral_total_km")).alias("f" + n[4:]) for n in band],
    )


def deflections(nodes: DataFrame) -> DataFrame:
    """Depths at which the heading over a window changes by at least the smallest angle.

    The window is two-sided with a width in nodes that depends on the path, so nodes meet by an
    equi join on (path, node number): rows of one path spread over all tasks.
    """
    s = Ordered(nodes, ["path"], "n").lag(["depth"]).result()
    s = s.withColumn("gap", F.col("depth") - F.col("prev_depth"))
    w = exact_percentiles(s, ["path"], "gap", {"dz": 0.5})
    size = nodes.groupBy("path").agg(F.count("*").alias("nodes"), F.min_by(F.struct("lat", "lon"), F.col("n")).alias("f"))
    meta = size.filter(F.col("nodes") >= MIN_NODES).join(w, "path").select(
        "path", "nodes", "f", F.greatest(F.lit(2), F.round(WINDOW_KM / F.greatest(F.col("dz"), F.lit(1.0))).cast("bigint")).alias("w"))
    p = nodes.join(meta, "path")
    e, nth = geo.tangent_offsets(F.col("f.lat"), F.col("f.lon"), F.col("lat"), F.col("lon"))
    p = p.select("path", "n", "depth", "w", "nodes", e.alias("e"), nth.alias("nn"))
    shift = F.array(*[F.struct((F.col("n") + F.col("w") * d).alias("at"), F.lit(d).alias("side")) for d in (-1, 0, 1)])
    m = p.select("*", F.explode(shift).alias("t"))
    # Every node reports itself to the three nodes it serves; grouping by (path, node) has three rows.
    pick = lambda side, c: F.max(F.when(F.col("t.side") == side, F.col(c)))
    g = m.groupBy("path", F.col("t.at").alias("n")).agg(
        pick(0, "depth").alias("depth"), pick(0, "e").alias("e"), pick(0, "nn").alias("nn"),
        pick(1, "e").alias("ea"), pick(1, "nn").alias("na"), pick(-1, "e").alias("eb"), pick(-1, "nn").alias("nb"),
    ).filter("depth IS NOT NULL AND ea IS NOT NULL AND eb IS NOT NULL")
    x1, y1 = F.col("e") - F.col("ea"), F.col("nn") - F.col("na")
    x2, y2 = F.col("eb") - F.col("e"), F.col("nb") - F.col("nn")
    l1, l2 = F.sqrt(x1 * x1 + y1 * y1), F.sqrt(x2 * x2 + y2 * y2)
    # Short legs have no heading. They leave before the clip, because least() skips NULL.
    g = g.filter((l1 >= MIN_LEG_KM) & (l2 >= MIN_LEG_KM))
    cosine = (x1 * x2 + y1 * y2) / (l1 * l2)
    ang = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))
    return g.select("path", "n", "depth", F.round(ang, 6).alias("angle")).filter(F.col("angle") >= MIN_ANGLE_DEG)


def at_levels(nodes: DataFrame, levels: list[float], cols: list[str], how: str) -> DataFrame:
    """Values of a path at given depths.

    ``asof``: the last node at or above the level (the first node where there is none).
    ``linear``: interpolation between the neighbours, ends clamped. Each node emits only the levels
    inside its own segment, so no join takes place. Depth must ascend with node number.
    """
    s = Ordered(nodes, ["path"], "n").lead(["depth", *cols]).lag(["depth"]).result()
    grid = F.array(*[F.lit(float(z)) for z in levels])
    last, first = F.col("next_depth").isNull(), F.col("prev_depth").isNull()
    mine = F.filter(grid, lambda z: ((z >= F.col("depth")) | first) & (last | (z < F.col("next_depth"))))
    s = s.withColumn("level", F.explode(mine))
    if how == "asof":
        return s.select("path", "level", *cols)
    u = (F.col("level") - F.col("depth")) / (F.col("next_depth") - F.col("depth"))
    inside = ~last & (F.col("level") > F.col("depth"))
    value = lambda c: F.when(inside, F.col(c) + (F.col("next_" + c) - F.col(c)) * u).otherwise(F.col(c))
    return s.select("path", "level", *[value(c).alias(c) for c in cols])


def islands(df: DataFrame, flag: Column) -> DataFrame:
    """Adds ``island``: the number of runs of true started so far, on rows where the flag holds."""
    o = Ordered(df.withColumn("_on", F.coalesce(flag, F.lit(False))), ["path"], "n").lag(["_on"])
    o.df = o.df.withColumn("_new", (F.col("_on") & ~F.coalesce(F.col("prev__on"), F.lit(False))).cast("int"))
    d = o.running({"island": ("sum", F.col("_new"))}).result()
    return d.filter("_on").drop("_on", "prev__on", "_new")
