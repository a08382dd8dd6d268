"""Greedy nearest matching without replacement, k partners each, in rounds.

One by one, in the order of their ids, the takers each take the k nearest members of a pool that are left.
That is the one stable outcome when takers propose to the nearest members they have not tried and a member
keeps the taker with the smallest id, so all takers can propose at once: those that lose a member propose
further in the next round, until nobody has to. The number of rounds follows from how far chains of takers
push each other, not from their number.

The pool is numbered twice, upwards and downwards from a value, so a taker's next nearest members are two
look-ups by number: no taker ever sees the pool. Takers with one value share one list; in the first round each
starts behind the shares of those before it, which must end with them or with somebody earlier still.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravox.operators.scaling import ROWS_PER_PIECE, Ordered
from terravox.session import keep


def numbered_pool(pool: DataFrame, key: str, value: str, rows_per_piece: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, side, pos, member, x): side 1 upwards, side -1 downwards; equal values by smaller id."""
    p = pool.select(*by, F.col(key).alias("member"), F.col(value).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    sides = []
    for side in (1, -1):
        q = p.withColumn("at", F.col("x") * side)
        sides.append(Ordered(q, by, ["at", "member"], rows_per_piece).number("pos").result().select(*by, F.lit(side).alias("side"), "pos", "member", "x"))
    return keep(sides[0].unionByName(sides[1]), "match-pool")


def starting_places(takers: DataFrame, pool: DataFrame, key: str, value: str, rows_per_piece: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, taker, x, up, down): the numbers of the first member at or above and of the first below a value."""
    t = takers.select(*by, F.col(key).alias("taker"), F.col(value).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    members = pool.filter("side = 1")
    both = t.select(*by, "x", F.lit(0).alias("kind"), F.col("taker").alias("id")).unionByName(members.select(*by, "x", F.lit(1).alias("kind"), F.col("member").alias("id")))
    ran = Ordered(both, by, ["x", "kind", "id"], rows_per_piece).running({"below": ("sum", F.col("kind"))}).result().filter("kind = 0")
    total = members.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    met = ran.join(total, list(by)) if by else ran.crossJoin(F.broadcast(total))
    return met.select(*by, F.col("id").alias("taker"), "x", (F.col("below") + 1).alias("up"), (F.col("size") - F.col("below") + 1).alias("down"))


def _ahead(asking: DataFrame, pool: DataFrame, n: str, by: Sequence[str] = ()) -> DataFrame:
    """The next ``n`` members on both sides of each row of ``asking`` (x, up, down), with their distance."""
    step = F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("step")
    each = asking.select("*", step)
    sides = [each.withColumn("side", F.lit(s)).withColumn("pos", F.col(c) + F.col("step")) for s, c in ((1, "up"), (-1, "down"))]
    met = sides[0].unionByName(sides[1]).join(pool.withColumnRenamed("x", "y"), [*by, "side", "pos"])
    return met.withColumn("gap", F.abs(F.col("y") - F.col("x")))


def nearest_matches(takers: DataFrame, pool: DataFrame, k: int, key: str = "site", value: str = "x", rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """taker, member, gap: the k members of each taker (fewer where the pool is used up).

    Ids are unique on either side; null and NaN values take no part.
    """
    members = numbered_pool(pool, key, value, rows_per_piece)
    start = starting_places(takers, members, key, value, rows_per_piece)
    # Round one: the takers of one value deal its list out in the order of their ids.
    turn = Ordered(start.withColumn("order_", F.col("taker").cast("double")), ["x"], ["order_", "taker"], rows_per_piece).number("turn").result().drop("order_")
    turn = keep(turn.withColumn("turn", F.col("turn") - 1), "match-takers")
    own = turn.select("x", (F.col("up") + F.col("turn") * k).alias("up"), (F.col("down") + F.col("turn") * k).alias("down"), F.lit(k).alias("n"))
    listed = _ahead(own, members, "n").select("x", "gap", "member", F.when(F.col("side") < 0, 1).otherwise(0).alias("lower"))
    ranked = Ordered(listed, ["x"], ["gap", "member"], rows_per_piece).running({"m": ("count", F.lit(1)), "n_lower": ("sum", F.col("lower"))}).result()
    dealt = ranked.withColumn("turn", F.floor((F.col("m") - 1) / k)).join(turn, ["x", "turn"])
    dealt = keep(dealt.select("taker", "x", "up", "down", "member", "gap", "m", "n_lower"), "match-round")
    used = dealt.groupBy("taker").agg(F.max("m").alias("m"), F.max("n_lower").alias("n_lower"))
    state = turn.join(used, "taker").select("taker", "x", (F.col("up") + F.col("m") - F.col("n_lower")).alias("up"), (F.col("down") + F.col("n_lower")).alias("down"))
    proposed = dealt.select("taker", "member", "gap")
    while True:
        # A member keeps the earliest taker; partial aggregates meet a member that very many ask for.
        held = keep(proposed.groupBy("member").agg(F.min(F.struct("taker", "gap")).alias("b")).select("b.taker", "member", "b.gap"), "match-held")
        have = held.groupBy("taker").agg(F.count(F.lit(1)).alias("have"))
        asking = state.join(have, "taker", "left").withColumn("n", (k - F.coalesce("have", F.lit(0))).cast("int")).filter("n > 0").drop("have")
        near = Window.partitionBy("taker").orderBy("gap", "member")  # 2 k rows at most
        new = _ahead(asking, members, "n").withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= F.col("n"))
        new = keep(new.select("taker", "member", "gap", "side"), "match-new")
        if new.isEmpty():
            return held
        moved = new.groupBy("taker").agg(F.count_if(F.col("side") > 0).alias("u"), F.count_if(F.col("side") < 0).alias("d"))
        state = keep(state.join(moved, "taker", "left").select("taker", "x", (F.col("up") + F.coalesce("u", F.lit(0))).alias("up"), (F.col("down") + F.coalesce("d", F.lit(0))).alias("down")), "match-state")
        proposed = reduce(DataFrame.unionByName, [held, new.drop("side")])


def nearest_members(takers: DataFrame, pool: DataFrame, k: int, key: str = "site", value: str = "x", by: Sequence[str] = (), rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """by, taker, member, gap: the k nearest members of each taker in its group, each as often as it is wanted."""
    members = numbered_pool(pool, key, value, rows_per_piece, by)
    start = starting_places(takers, members, key, value, rows_per_piece, by).withColumn("n", F.lit(k))
    near = Window.partitionBy(*by, "taker").orderBy("gap", "member")  # 2 k rows at most
    return _ahead(start, members, "n", by).withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k).select(*by, "taker", "member", "gap")
