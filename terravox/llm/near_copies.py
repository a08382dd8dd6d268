"""One document of each group of near copies: SimHash candidates, verified on five-word shingles.

Texts have A-Z lower-cased and are cut into words at blanks and ASCII control blanks. Two texts are near
copies if the sets of their runs of ``SHINGLE`` words have a Jaccard similarity of ``SIMILARITY`` or
more (a shorter text is one run); groups are what such links connect.

Candidates: the SimHash of the distinct words moves less under edits than that of shingles, as a changed
word touches one word but five runs. Fingerprints within ``TAU`` bits are found by the generalised
pigeonhole of ``simhash`` and are compared by the exact sizes of their shingle sets. At sf0.1 and on the
larger tables 94 to 99 % of the pairs of similarity 0.8 lie within 7 bits; of short texts whose words
are nearly all different and changed in blocks fewer do (68 of 92 pairs in the test). Links that are
missed can still be made over other members of a group. Runs are told apart by 32 bits of their hash, which can
raise the similarity of two texts of n words by about n / 2**32.

Texts with the same words are one node, so exact copies never multiply. In a large group of near copies
not all pairs are made: in each round a node compares itself with its ``FIRST`` nearest candidates of
other components. A pair that was not compared was cut from both its nodes' lists, so the next round, with
lists sixteen times as long, is held among cut nodes with their new components only. Rounds end when
no list was cut: no candidate pair is left uncompared unless its nodes are already in one group.

Null and empty texts are one group. The smallest key of a group stays, null keys last; where rows
share it, the one with the smallest hash over all columns; of wholly equal rows one. Other columns are
kept as they are, and an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravox.llm.common import fresh, map_texts
from terravox.llm.simhash import SEED, filed_rows
from terravox.operators.setops import components
from terravox.session import keep

TAU = 7
SHINGLE = 5
#: Similarity as a fraction, so that the comparison is exact.
SIMILARITY = (4, 5)
#: Candidates of a node that the first round compares.
FIRST = 16
#: Rows of a bucket up to which its candidates are made by a join.
SMALL = 256
#: Rows of a larger bucket in one block; a task holds two blocks, whose pairs are bounded with it.
BUCKET = 2048
#: A distance beyond all others.
FAR = 99


def _majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed number."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def word_print(raw: bytes) -> tuple[int, int, np.ndarray]:
    """(hash of the words in order, fingerprint of the distinct words, sorted distinct shingles)."""
    words = raw.lower().split()
    text = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    whole = int(np.array(digest(text, SEED), np.uint64).view(np.int64))
    if not words:
        return whole, 0, np.empty(0, np.int32)
    own = set(words)
    fp = _majority(np.fromiter((digest(w, SEED) for w in own), np.uint64, len(own)))
    n = len(words)
    if n <= SHINGLE:
        runs = np.array([digest(text, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[: n - SHINGLE])).tolist()
        stops = (ends[SHINGLE - 1 :] - 1).tolist()
        view = memoryview(text)
        runs = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n - SHINGLE + 1)
    return whole, fp, np.unique((runs >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _prints(raws: list[bytes]) -> list:
    got = [word_print(r) for r in raws]
    sizes = np.fromiter((len(g[2]) for g in got), np.int32, len(got))
    flat = np.concatenate([g[2] for g in got])
    runs = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(flat, pa.int32()))
    return [[g[0] for g in got], [g[1] for g in got], sizes, runs]


def candidates(nodes: DataFrame, longest: int, tau: int = TAU, small: int = SMALL, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b, d) of ``nodes`` (node, fp, n, label) of different labels within tau bits and of fitting sizes.

    A pair is left out only where both its nodes have more than ``longest`` others.
    """
    part, whole = SIMILARITY
    filed = filed_rows(nodes, tau, ("node", "n", "label")).withColumnRenamed("n", "runs")
    size = filed.groupBy("part", "value").agg(F.count("*").alias("rows"), F.count_if(~F.col("probe")).alias("filed"))
    filed = filed.join(size.filter("rows > 1 and filed > 0").drop("filed"), ["part", "value"])
    few = filed.filter(F.col("rows") <= small)
    x = few.filter(~F.col("probe")).select("part", "value", F.col("node").alias("a"), F.col("fp").alias("fa"), F.col("runs").alias("na"), F.col("label").alias("la"))
    y = few.select("part", "value", F.col("node").alias("b"), F.col("fp").alias("fb"), F.col("runs").alias("nb"), F.col("label").alias("lb"), "probe")
    d = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))).cast("int")
    fits = F.least("na", "nb") * whole >= F.greatest("na", "nb") * part
    once = (F.col("probe") & (F.col("a") != F.col("b"))) | (F.col("a") < F.col("b"))
    pairs = x.join(y, ["part", "value"]).filter(once & (d <= tau) & (F.col("la") != F.col("lb")) & fits).select("a", "b", d.alias("d"))

    # Larger buckets: each pair of blocks is a task of its own, in which every row names its nearest.
    many = filed.filter(F.col("rows") > small).withColumn("blocks", F.ceil(F.col("rows") / bucket).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("node", "probe"), F.col("blocks").cast("bigint")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = many.withColumn("other", other).select(
        "part", "value", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "node", "fp", "runs", "label", "probe"
    )

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        node, label, runs = (group[c].to_numpy(np.int64) for c in ("node", "label", "runs"))
        fp, probe, block = group["fp"].to_numpy(np.int64).view(np.uint64), group["probe"].to_numpy(bool), group["block"].to_numpy()
        one = bool(group["b1"].iloc[0] == group["b2"].iloc[0])
        rows, cols = np.flatnonzero(~probe), np.arange(len(node))
        length = longest + 1
        every = len(node) <= length
        heard = np.full((0 if every else len(cols), length), FAR, np.int8)  # the nearest that each column has named
        made = [np.empty((0, 3), np.int64)]
        step = max(1, (1 << 20) // len(cols))
        for i in range(0, len(rows), step):
            r = rows[i : i + step]
            dist = np.bitwise_count(fp[r, None] ^ fp[None, :]).astype(np.int8)
            ok = (dist <= tau) & (label[r, None] != label[None, :]) & (node[r, None] != node[None, :])
            ok &= np.minimum(runs[r, None], runs[None, :]) * whole >= np.maximum(runs[r, None], runs[None, :]) * part
            if not one:
                ok &= block[r, None] != block[None, :]
            take = ok
            if not every:
                dist[~ok] = FAR
                take = np.zeros(ok.shape, bool)
                np.put_along_axis(take, np.argpartition(dist, longest, axis=1)[:, :length], True, axis=1)
                merged = np.concatenate([heard, dist.T], axis=1)
                at = np.argpartition(merged, longest, axis=1)[:, :length]
                heard = np.take_along_axis(merged, at, axis=1)
                c, k = np.nonzero(at >= length)
                take[at[c, k] - length, c] = True
                take &= ok
            p, q = np.nonzero(take)
            a, b = node[r[p]], node[q]
            made.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), dist[p, q].astype(np.int64)], axis=1), axis=0))
        ab = np.unique(np.concatenate(made), axis=0)
        return pd.DataFrame({"a": ab[:, 0], "b": ab[:, 1], "d": ab[:, 2].astype(np.int32)})

    found = spread.groupBy("part", "value", "b1", "b2").applyInPandas(nearest, "a bigint, b bigint, d int")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d")
    return pairs.unionByName(found).distinct()


def groups(nodes: DataFrame, runs: DataFrame, tau: int = TAU, first: int = FIRST, small: int = SMALL) -> DataFrame:
    """(node, label) of all nodes that have a near copy. ``nodes``: node, fp, n; ``runs``: node, runs."""
    spark = nodes.sparkSession
    part, whole = SIMILARITY
    open_, longest = nodes.withColumn("label", F.col("node")), first
    links, label = None, None
    while True:
        pairs = keep(candidates(open_, longest, tau, small), "near-pairs")
        both = pairs.select("a", "b", "d", F.explode(F.array("a", "b")).alias("node"))
        ranked = both.withColumn("turn", F.row_number().over(Window.partitionBy("node").orderBy("d", F.when(F.col("a") == F.col("node"), F.col("b")).otherwise(F.col("a")))))
        ranked = keep(ranked.filter(F.col("turn") <= longest + 1), "near-lists")
        asked = ranked.filter(F.col("turn") <= longest).select("a", "b").distinct()
        asked = asked.join(runs.select(F.col("node").alias("a"), F.col("runs").alias("ra")), "a")
        asked = asked.join(runs.select(F.col("node").alias("b"), F.col("runs").alias("rb")), "b")
        shared = F.size(F.array_intersect("ra", "rb"))
        near = keep(asked.filter(shared * whole >= (F.size("ra") + F.size("rb") - shared) * part).select("a", "b"), "near-links")
        if links is None or not near.isEmpty():
            links = near if links is None else links.unionByName(near)
            ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            label = components(spark, ends, links)
        cut = ranked.filter(F.col("turn") > longest).select("node").distinct()
        open_ = nodes.join(cut, "node", "left_semi").join(label, "node", "left")
        open_ = keep(open_.select("node", "fp", "n", F.coalesce("label", "node").alias("label")), "near-open")
        if open_.isEmpty():
            return label
        longest *= 16


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", tau: int = TAU) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near copies, with their columns."""
    names = docs.columns
    mark = fresh(names, "_row")
    row = docs.select("*", F.xxhash64(*names).alias(mark))
    made = map_texts(row, [key, mark], text, "_whole bigint, _fp bigint, _n int, _runs array<int>", _prints)
    made = made.select(F.col(key).alias("k"), F.col(mark).alias("row"), F.col("_whole").alias("whole"), F.col("_fp").alias("fp"), F.col("_n").alias("n"), F.col("_runs").alias("runs"))
    prints = keep(made.withColumn("node", F.monotonically_increasing_id()), "near-prints")
    rank = F.struct(F.col("k").isNull().alias("last"), "k", "row")
    nodes = keep(prints.groupBy("whole", "fp", "n").agg(F.min(rank).alias("first"), F.min("node").alias("node")), "near-nodes")
    label = groups(nodes.select("node", "fp", "n"), prints.select("node", "runs"), tau)
    best = nodes.join(label, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("f")).select("f.k", "f.row")
    often = prints.groupBy("k", "row").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("k").alias("k2"), F.col("row").alias("row2"), "n")
    best = best.join(often, F.col("k").eqNullSafe(F.col("k2")) & (F.col("row") == F.col("row2")), "left")
    best = keep(best.select(F.col("k").alias("_k"), F.col("row").alias("_r"), F.coalesce("n", F.lit(1)).alias("_n")), "near-best")

    def rows_of(chosen: DataFrame) -> DataFrame:
        a, b = row.alias("a"), chosen.select("_k", "_r").alias("b")
        return a.join(b, F.col(f"a.`{key}`").eqNullSafe(F.col("b._k")) & (F.col(f"a.{mark}") == F.col("b._r"))).select(*[F.col(f"a.`{c}`") for c in names])

    once = rows_of(best.filter("_n = 1"))
    if best.filter("_n > 1").isEmpty():
        return once
    return once.unionByName(rows_of(best.filter("_n > 1")).dropDuplicates())
