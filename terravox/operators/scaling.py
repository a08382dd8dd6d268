"""Helpers that keep a plan balanced when one key holds a large share of the rows.

Nothing here drops or samples rows. A long ordered group is cut at quantiles of its order
column, each piece is processed by its own task and small per-piece summaries carry the state
across the cuts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_PIECE = 2_000_000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
SMALL_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Mark a side for broadcast only after its rows and the bytes of their text form were counted.

    The check stops at ``max_rows + 1`` rows. The caller gets the verdict too, so that it can
    spread the join when the side is larger.
    """
    head = df.limit(max_rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b"))
    seen = head.agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    small = seen.n <= max_rows and (seen.b or 0) <= max_bytes
    return (F.broadcast(df) if small else df), small


def shuffled_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join of two tables that both grow with the data.

    Equal values compress to next to nothing, so the bytes of a written or shuffled table say little about
    its rows: left to itself, Spark sends millions of them through the driver as a small table.
    """
    return left.join(right.hint("merge"), on, how)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 16):
    """Equi join in which every key of ``left`` is spread over ``salts`` tasks.

    ``right`` is repeated once per salt, so use it when ``right`` has few rows per key.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("salting repeats the right side, so only left-preserving joins are whole")
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if c not in on] or [F.lit(0)]), F.lit(salts)))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return shuffled_join(a, b, [*on, "_salt"], how).drop("_salt")


def planned_bytes(df: DataFrame) -> int:
    """Size the optimizer expects, from file sizes: no job is run for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Give a short input one task per core before work that multiplies its rows.

    A table of a few files would otherwise be expanded by a few tasks. Inputs with enough data to
    fill the cores by their own splits are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if planned_bytes(df) < cores * SMALL_BYTES else df


def piece_bounds(df: DataFrame, order: str, rows_per_piece: int = ROWS_PER_PIECE):
    """Cut points of ``order`` so that no piece of the whole table is much above the target size.

    The rows are counted; their number alone decides, and there are as many pieces as it takes.
    """
    pieces = math.ceil(df.count() / rows_per_piece)
    if pieces <= 1:
        return []
    probs = [p / pieces for p in range(1, pieces)]
    cuts = df.select(F.col(order).cast("double").alias("_o")).approxQuantile("_o", probs, 0.25 / pieces)
    return sorted(set(cuts))


def piece_of(order: Column, cuts: list[float]) -> Column:
    """Index of the piece a value falls in: a binary decision tree over the cut points."""
    v = order.cast("double")

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v < cuts[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


class Ordered:
    """Ordered rows per key, safe for keys of any size.

    ``order`` is a column or several, unique within a key together. Cuts are made on the first one,
    which has to be a number, so rows that tie on it stay in one piece and the others order them
    there. Where no key has more rows than a piece, the plan is an ordinary window over the key, however
    many keys there are; else each (key, piece) is a window of bounded size.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: str | Sequence[str], rows_per_piece: int = ROWS_PER_PIECE):
        self.keys, self.order = list(keys), [order] if isinstance(order, str) else list(order)
        self.cuts = piece_bounds(df, self.order[0], rows_per_piece) if self._largest(df) > rows_per_piece else []
        self.split = bool(self.cuts)
        self.df = df.withColumn("_piece", piece_of(F.col(self.order[0]), self.cuts)) if self.split else df
        self.group = [*self.keys, "_piece"] if self.split else self.keys

    def _largest(self, df: DataFrame) -> int:
        """Rows of the longest key: the keys are counted where they lie, only counts are shuffled."""
        if not self.keys:
            return df.count()
        return df.groupBy(*self.keys).agg(F.count("*").alias("_n")).agg(F.max("_n").alias("n")).first().n or 0

    def _w(self):
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def _summary(self, aggs: Sequence[Column]) -> DataFrame:
        """One row per (key, piece): a few rows per millions, so windows over it stay small."""
        return self.df.groupBy(*self.group).agg(*aggs)

    def number(self, name: str = "rn") -> Ordered:
        """Row number within the key, from 1."""
        return self.running({name: ("count", F.lit(1))})

    def running(self, exprs: dict[str, tuple[str, Column]]) -> Ordered:
        """Cumulative sum, count, min or max from the first row of the key to the current one."""
        fn = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
        w = self._w().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if not self.split:
            self.df = self.df.select("*", *[fn[k](c).over(w).alias(n) for n, (k, c) in exprs.items()])
            return self
        tot = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
        part = self._summary([fn[k](c).alias(n) for n, (k, c) in exprs.items()])
        before = Window.partitionBy(*self.keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        carry = part.select(
            *self.group, *[tot[k](F.col(n)).over(before).alias(f"_c_{n}") for n, (k, _) in exprs.items()]
        )
        inner = self.df.select("*", *[fn[k](c).over(w).alias(f"_i_{n}") for n, (k, c) in exprs.items()])
        j = inner.join(carry, self.group)
        def merge(n, k):
            a, b = F.col(f"_i_{n}"), F.col(f"_c_{n}")
            if k in ("sum", "count"):
                return F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0)))
            return F.least(a, b) if k == "min" else F.greatest(a, b)
        out = j.select(*self.df.columns, *[merge(n, k).alias(n) for n, (k, _) in exprs.items()])
        self.df = out
        return self

    def lag(self, cols: Sequence[str], prefix: str = "prev_") -> Ordered:
        return self._shift(cols, prefix, F.lag, F.max_by)

    def lead(self, cols: Sequence[str], prefix: str = "next_") -> Ordered:
        return self._shift(cols, prefix, F.lead, F.min_by)

    def _shift(self, cols, prefix, shift, edge) -> Ordered:
        row = F.struct(*cols)
        w = self._w()
        if not self.split:
            self.df = self.df.select("*", *[shift(c).over(w).alias(prefix + c) for c in cols])
            return self
        wk = Window.partitionBy(*self.keys).orderBy("_piece")
        part = self._summary([edge(row, F.struct(*self.order)).alias("_edge")])
        carry = part.select(*self.group, shift("_edge").over(wk).alias("_c_edge"))
        base = self.df.columns
        j = self.df.withColumn("_s", shift(row).over(w)).join(carry, self.group)
        pick = F.coalesce(F.col("_s"), F.col("_c_edge"))
        self.df = j.withColumn("_p", pick).select(*base, *[F.col("_p")[c].alias(prefix + c) for c in cols])
        return self

    def result(self) -> DataFrame:
        return self.df.drop("_piece") if self.split else self.df


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], rows_per_piece: int = ROWS_PER_PIECE, times: str | None = None
) -> DataFrame:
    """Linear-interpolated percentiles per key without holding a key's values in one task.

    Equal values are counted first. The counts are numbered piecewise, and only the rows that hold
    the two order statistics of each probability survive. ``times`` names how often a row counts.
    """
    cnt = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(times) if times else F.count("*")).alias("_n"))
    seq = Ordered(cnt, keys, value, rows_per_piece).running({"_upto": ("sum", F.col("_n"))}).result()
    total = cnt.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    on = list(keys)
    j = seq.join(total, on) if on else seq.crossJoin(F.broadcast(total))
    first = F.col("_upto") - F.col("_n")
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_t") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        hold = lambda x: (first <= x) & (x < F.col("_upto"))
        aggs += [
            F.max(F.when(hold(lo), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(hold(hi), F.col(value))).alias(f"_hi_{name}"),
            F.max(pos - lo).alias(f"_f_{name}"),
        ]
    g = (j.groupBy(*on) if on else j.groupBy()).agg(*aggs)
    return g.select(
        *on,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probs
        ],
    )
