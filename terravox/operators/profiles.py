"""Run logic on one depth profile held as an array of flags: no shuffle, one pass per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def longest_run(flags: Column) -> Column:
    """Struct (length, start) of the longest run of true; the first one on ties, start -1 if none."""
    zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("cur"), F.lit(0).alias("best"), F.lit(-1).alias("start"))

    def step(a, x):
        cur = F.when(F.coalesce(x, F.lit(False)), a["cur"] + 1).otherwise(F.lit(0))
        better = cur > a["best"]
        return F.struct(
            (a["pos"] + 1).alias("pos"), cur.alias("cur"), F.when(better, cur).otherwise(a["best"]).alias("best"),
            F.when(better, a["pos"] - cur + 1).otherwise(a["start"]).alias("start"),
        )

    return F.aggregate(flags, zero, step, lambda a: F.struct(a["best"].alias("length"), a["start"].alias("start")))


def leading_run(flags: Column) -> Column:
    """Number of true values before the first false one."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(True).alias("alive"))

    def step(a, x):
        go = a["alive"] & F.coalesce(x, F.lit(False))
        return F.struct((a["n"] + go.cast("int")).alias("n"), go.alias("alive"))

    return F.aggregate(flags, zero, step, lambda a: a["n"])


def gap_tolerant_reach(flags: Column, tolerated: int) -> Column:
    """Position of the last true value reached from position 0, forgiving gaps of up to
    ``tolerated`` false values in a row; NULL where position 0 is false."""
    zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("miss"), F.lit(0).alias("last"), F.lit(True).alias("alive"))

    def step(a, x):
        on = F.coalesce(x, F.lit(False))
        miss = F.when(on, F.lit(0)).otherwise(a["miss"] + 1)
        alive = a["alive"] & (miss <= tolerated)
        return F.struct(
            (a["pos"] + 1).alias("pos"), miss.alias("miss"),
            F.when(alive & on, a["pos"]).otherwise(a["last"]).alias("last"), alive.alias("alive"),
        )

    return F.when(F.coalesce(flags[0], F.lit(False)), F.aggregate(flags, zero, step, lambda a: a["last"]))


def first_sustained(flags: Column, length: int) -> Column:
    """Position of the first value of the first run of at least ``length`` true values, else NULL."""
    zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("cur"), F.lit(-1).alias("at"))

    def step(a, x):
        cur = F.when(F.coalesce(x, F.lit(False)), a["cur"] + 1).otherwise(F.lit(0))
        found = (a["at"] < 0) & (cur >= length)
        return F.struct((a["pos"] + 1).alias("pos"), cur.alias("cur"), F.when(found, a["pos"] - length + 1).otherwise(a["at"]).alias("at"))

    at = F.aggregate(flags, zero, step, lambda a: a["at"])
    return F.when(at >= 0, at)


def rises_and_falls(counts: Column) -> tuple[Column, Column]:
    """Sum of increases and sum of decreases between neighbours of an array."""
    d = F.zip_with(F.slice(counts, F.lit(2), F.size(counts) - 1), F.slice(counts, F.lit(1), F.size(counts) - 1), lambda b, a: b - a)
    up = F.aggregate(d, F.lit(0).cast("bigint"), lambda s, x: s + F.when(x > 0, x).otherwise(F.lit(0).cast("bigint")))
    down = F.aggregate(d, F.lit(0).cast("bigint"), lambda s, x: s + F.when(x < 0, -x).otherwise(F.lit(0).cast("bigint")))
    return up, down
