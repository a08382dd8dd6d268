"""Permutation tests: every split where they can be counted out, draws by digest where they cannot."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Splits up to which all of them are enumerated.
MOST_SPLITS = 3_000_000
DRAWS = 20_000
#: Digits to which a split's statistic is compared with the observed one.
DIGITS = 9


def _statistic(v: Column, first: Column, statistic: str) -> Column:
    mid = F.median if statistic == "median" else F.avg
    return F.round(F.abs(mid(F.when(first, v)) - mid(F.when(~first, v))), DIGITS)


def unrank(rank: np.ndarray, n: int, size: int) -> np.ndarray:
    """The combinations with the given numbers in lexical order, a row of ``size`` members of ``range(n)`` each."""
    rank = rank.astype(np.int64).copy()
    out = np.zeros((len(rank), size), np.int64)
    nxt = np.zeros(len(rank), np.int64)
    ways = np.array([[math.comb(a, b) if math.comb(a, b) < 1 << 62 else 1 << 62 for b in range(size + 1)] for a in range(n + 1)], np.int64)
    for place in range(size):
        todo = np.ones(len(rank), bool)
        while todo.any():
            # Combinations whose next member is ``nxt``.
            here = ways[np.maximum(n - 1 - nxt, 0), size - 1 - place]
            skip = todo & (rank >= here)
            take = todo & ~skip
            out[take, place] = nxt[take]
            rank[skip] -= here[skip]
            nxt[todo] += 1
            todo = skip
    return out


def permutation_test(units: DataFrame, statistic: str, plus_one: bool, seed: int = 11, draws: int = DRAWS, most_splits: int = MOST_SPLITS, unit: str = "unit", value: str = "v", first: str = "first_") -> DataFrame:
    """observed, p, draws, how: two-sided test of the difference between the units of two groups.

    The observed value is an aggregate. If the splits of the units are few enough to enumerate, so are the
    units; they travel with the tasks, each of which unranks and judges its range of split numbers.
    Otherwise each draw is a digest order of the units: its first members stand for the first group.
    Neither keeps the units on the driver beyond that bound. Units without a value take no part.
    """
    spark = units.sparkSession
    u = units.select(F.col(unit).alias("unit"), F.col(value).cast("double").alias("v"), F.col(first).alias("first_")).filter("v IS NOT NULL AND NOT isnan(v) AND first_ IS NOT NULL")
    seen = u.agg(_statistic(F.col("v"), F.col("first_"), statistic).alias("observed"), F.count_if("first_").alias("n1"), F.count(F.lit(1)).alias("n"))
    size = seen.first()
    n, n1 = int(size.n), int(size.n1)
    if n1 in (0, n):
        return seen.select(F.lit(None).cast("double").alias("observed"), F.lit(None).cast("double").alias("p"), F.lit(0).cast("bigint").alias("draws"), F.lit("none").alias("how"))
    if min(n1, n - n1) <= 64 and math.comb(n, n1) <= most_splits:
        return _exact(spark, u, n, n1, float(size.observed), statistic)
    d = u.crossJoin(spark.range(draws).withColumnRenamed("id", "draw"))
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("draw").cast("string"), F.col("unit").cast("string")))
    rn = F.row_number().over(Window.partitionBy("draw").orderBy(order, "unit"))
    s = d.withColumn("rn", rn).groupBy("draw").agg(_statistic(F.col("v"), F.col("rn") <= n1, statistic).alias("x"))
    hits = s.agg(F.count_if(F.col("x") >= float(size.observed)).alias("c"), F.count(F.lit(1)).alias("draws"))
    p = (F.col("c") + 1) / (F.col("draws") + 1) if plus_one else F.col("c") / F.col("draws")
    return hits.select(F.lit(float(size.observed)).alias("observed"), p.alias("p"), "draws", F.lit("drawn").alias("how"))


def _exact(spark, u: DataFrame, n: int, n1: int, observed: float, statistic: str) -> DataFrame:
    # There are at least as many splits as units, so the bound on splits bounds what is collected.
    v = np.array([r.v for r in u.orderBy("unit").collect()])
    few = min(n1, n - n1)
    total = math.comb(n, few)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = b["id"].to_numpy()
            hits = 0
            for i in range(0, len(at), max(1, 2_000_000 // n)):
                picked = unrank(at[i : i + max(1, 2_000_000 // n)], n, few)
                on = np.zeros((len(picked), n), bool)
                np.put_along_axis(on, picked, True, axis=1)
                rest = v[np.nonzero(~on)[1]].reshape(len(picked), -1)
                mid = np.median if statistic == "median" else np.mean
                x = np.abs(mid(v[picked], axis=1) - mid(rest, axis=1))
                hits += int((np.round(x, DIGITS) >= observed).sum())
            yield pd.DataFrame({"c": [hits]})

    hits = spark.range(total).mapInPandas(judge, "c bigint").agg(F.sum("c").alias("c"))
    return hits.select(F.lit(observed).alias("observed"), (F.col("c") / total).alias("p"), F.lit(total).cast("bigint").alias("draws"), F.lit("exact").alias("how"))
