"""Shell-by-shell algebra on gridded fields held as one depth array per map cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds on anomalies in per cent.
ANOMALY_CLIP = 100.0
CHANNEL_CLIP = 6.0


def clip(x: Column, bound: float) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), x))


def voigt(vsv: Column, vsh: Column) -> Column:
    return F.sqrt((2 * F.pow(vsv, F.lit(2.0)) + F.pow(vsh, F.lit(2.0))) / 3)


def shell_means(cols: DataFrame, nz: int, v: str = "v") -> DataFrame:
    """Unweighted mean of each shell, as one array per model.

    One aggregate per shell keeps the arrays unexploded; partial aggregation leaves nz numbers per
    model and task for the shuffle.
    """
    g = cols.groupBy("model").agg(*[F.avg(F.col(v)[k]).alias(f"m{k}") for k in range(nz)])
    return g.select("model", F.array(*[f"m{k}" for k in range(nz)]).alias("shell_mean"))


def percent_anomaly(cols: DataFrame, nz: int, v: str = "v") -> DataFrame:
    """Per cent deviation from the shell mean, clipped."""
    j = cols.join(shell_means(cols, nz, v), "model")
    dev = F.zip_with(v, "shell_mean", lambda x, m: clip((x - m) * 100.0 / m, ANOMALY_CLIP))
    return j.withColumn(v, dev).drop("shell_mean")


def channel(anom: Column, contrast: Column, which: Column) -> Column:
    """The anomaly a cost is built on; a value that is not a finite number counts as 0."""
    both = F.when(F.isnan(anom) | F.isnan(contrast) | anom.isNull() | contrast.isNull(), F.lit(0.0)).otherwise(
        F.least(anom, contrast)
    )
    x = F.when(which == "anom", anom).when(which == "contrast", contrast).otherwise(both)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def shell_percentiles(cells: DataFrame, probs: dict[str, float], value: str = "anom") -> DataFrame:
    """Linear percentiles of each shell. A shell holds one value per map cell, so the group is
    bounded by the grid."""
    return cells.groupBy("model", "k").agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in probs.items()])


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles, all in one pass, on mid-point cumulative weights with linear interpolation and clamped ends.

    Keys must name groups of bounded size (a shell of one model).
    """
    w = Window.partitionBy(*keys).orderBy(value, *[c for c in ("j", "i") if c in df.columns])
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    pos = (F.sum(weight).over(upto) - F.col(weight) / 2) / F.sum(weight).over(whole)
    p = df.select(*keys, F.col(value).alias("_v"), pos.alias("_p"), F.struct(value, *[c for c in ("j", "i") if c in df.columns]).alias("_o"))
    w2 = Window.partitionBy(*keys).orderBy("_o")
    p = p.select("*", F.lead("_v").over(w2).alias("_v1"), F.lead("_p").over(w2).alias("_p1"), F.lag("_p").over(w2).alias("_p0"))

    def hit(prob: float) -> Column:
        q = F.lit(prob)
        between = F.col("_v") + (F.col("_v1") - F.col("_v")) * (q - F.col("_p")) / (F.col("_p1") - F.col("_p"))
        at_end = (F.col("_p0").isNull() & (q <= F.col("_p"))) | (F.col("_p1").isNull() & (q >= F.col("_p")))
        return F.when(at_end, F.col("_v")).when((q >= F.col("_p")) & (q < F.col("_p1")), between)

    return p.groupBy(*keys).agg(*[F.max(hit(prob)).alias(name) for name, prob in probs.items()])


def area_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))
