"""Detection rates, retained configurations and the classes drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Null percentile, detection floor, fewest cases, class limits, calibration amplitude.
NULL_PCT = 5.0
FLOOR = 0.75
MIN_CASES = 4
DECISIVE_HI, DECISIVE_LO = 0.80, 0.20
CAL_AMP = -1.0


def recovery(trials: DataFrame, keys: list[str], hit: str = "hit", rate: str = "detect", n: str = "n") -> DataFrame:
    """Mean of the informative trials (NULL is uninformative) and how many there are."""
    return trials.groupBy(*keys).agg(F.avg(F.col(hit).cast("double")).alias(rate), F.count(hit).alias(n))


def retained(detection: DataFrame) -> DataFrame:
    return detection.filter((F.col("n_cal") >= MIN_CASES) & (F.col("detect_cal") >= FLOOR))


def ensemble_class(fraction: Column) -> Column:
    return F.when(fraction >= DECISIVE_HI, "deeper than null").when(fraction <= DECISIVE_LO, "not deeper than null").otherwise("ambiguous")


def consensus(n_deep: Column, n_models: Column) -> Column:
    half = F.floor((n_models + 1) / 2)
    return (
        F.when(n_deep == n_models, "deep in every model")
        .when(n_deep == 0, "deep in none")
        .when(n_deep >= half, "deep in a majority")
        .otherwise("deep in a minority")
    )


def tier(n_deep: Column, n_models: Column, mean_fraction: Column) -> Column:
    half = F.floor((n_models + 1) / 2)
    return F.when(n_deep >= half, "I").when(n_deep >= 1, "II").when(mean_fraction >= 0.5, "III").otherwise("IV")
