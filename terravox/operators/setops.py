"""Overlap of member sets held as long tables (owner, member)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.operators.scaling import Ordered, broadcast_if_small
from terravox.session import keep

# A member is common where more than one in so many owners has it.
COMMON = 32
# Owners, members and bytes of a block; common members multiplied, pairs counted and cells compared at once.
OWNERS, ENTRIES, BLOCK_BYTES = 4096, 4_000_000, 32 << 20
COLUMNS, HELD = 2048, 2_000_000


def _packed(sets: DataFrame, width: int) -> DataFrame:
    """``codes`` (numbers of common members) as one bit each, in a row of ``width`` bits."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = max(1, 4 * HELD // max(1, width))
            for at in range(0, b.num_rows, most):
                t = b.slice(at, most)
                codes = t.column("codes")
                on = np.zeros((t.num_rows, width), bool)
                on[np.repeat(np.arange(t.num_rows), codes.value_lengths().to_numpy()), codes.flatten().to_numpy()] = True
                bits = pa.array([x.tobytes() for x in np.packbits(on, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([t.column("o"), t.column("n"), bits, t.column("few")], names=["o", "n", "bits", "few"])

    kinds = {c: sets.schema[c].dataType.simpleString() for c in ("o", "few")}
    return sets.select("o", "n", "codes", "few").mapInArrow(pack, f"o {kinds['o']}, n bigint, bits binary, few {kinds['few']}")


def _bits(t: pa.Table, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(t.num_rows, -(-width // 8))


def _overlaps(x: pa.Table, y: pa.Table, width: int) -> np.ndarray:
    """Members that each owner of ``x`` shares with each owner of ``y``: common ones as a product of
    bit rows, the others by meeting on the member."""
    most = max(max(t.column("n").to_numpy().max(initial=0) for t in (x, y)), 1)
    shared = np.zeros((x.num_rows, y.num_rows), np.float32 if most < 1 << 24 else np.float64)
    a, b = _bits(x, width), _bits(y, width)
    for at in range(0, a.shape[1], COLUMNS // 8):
        left, right = (np.unpackbits(m[:, at : at + COLUMNS // 8], axis=1).astype(shared.dtype) for m in (a, b))
        shared += left @ right.T
    few = [t.column("few").combine_chunks() for t in (x, y)]
    if not (len(few[0].flatten()) and len(few[1].flatten())):
        return shared
    row_a, row_b = (np.repeat(np.arange(len(m)), m.value_lengths().to_numpy()) for m in few)
    codes = pa.concat_arrays([m.flatten() for m in few]).dictionary_encode().indices.to_numpy()
    code_a, code_b = codes[: len(row_a)], codes[len(row_a) :]
    many = np.bincount(code_b, minlength=int(codes.max()) + 1)
    row_b, first = row_b[np.argsort(code_b, kind="stable")], np.cumsum(many) - many
    meets = many[code_a] > 0
    row_a, times, first = row_a[meets], many[code_a][meets], first[code_a][meets]
    upto, flat, at = np.cumsum(times), shared.reshape(-1), 0
    while at < len(row_a):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + HELD, "right")))
        n = times[at:end]
        place = np.arange(n.sum()) + np.repeat(first[at:end] - (np.cumsum(n) - n), n)
        np.add.at(flat, np.repeat(row_a[at:end], n) * y.num_rows + row_b[place], 1)
        at = end
    return shared


def linked_pairs(members: DataFrame, owner: str, member: str, share: float, rows_per_piece: int = 2_000_000, rare: int | None = None) -> DataFrame:
    """All pairs of owners whose common members are at least ``share`` of the smaller set.

    Owners are dealt into blocks and every pair of blocks is counted in a task of its own, so a pair of owners is
    a cell of a small matrix and no row. Members that more than ``rare`` owners have, one in ``COMMON`` unless
    stated, are bits of a row and are counted by a matrix product; the others meet on the member inside the
    task. Every pair is counted in full. The number of pairs grows with the square of the owners; the work on
    a pair is a few operations for each of ``COMMON`` times the middle set size.
    """
    spark = members.sparkSession
    m = members.select(F.col(owner).alias("o"), F.col(member).alias("m")).filter("o IS NOT NULL AND m IS NOT NULL")
    m = keep(m.distinct(), "members")
    if rare is None:
        rare = m.select("o").distinct().count() // COMMON
    # A member with one owner is shared with nobody; it only counts for the size of the set.
    freq = keep(m.groupBy("m").agg(F.count("*").alias("f")).filter("f > 1"), "member-counts")
    number = Ordered(freq.filter(F.col("f") > rare), [], ["f", "m"], rows_per_piece).number("code").result()
    side, _ = broadcast_if_small(freq.join(number.select("m", (F.col("code") - 1).cast("int").alias("code")), "m", "left"))
    width = freq.filter(F.col("f") > rare).count()
    few = F.when(F.col("f").isNotNull() & F.col("code").isNull(), F.col("m"))
    sets = m.join(side, "m", "left").groupBy("o").agg(F.count("*").alias("n"), F.collect_list("code").alias("codes"), F.collect_list(few).alias("few"))
    sets = keep(_packed(sets, width), "sets")
    seen = sets.agg(F.count("*").alias("owners"), F.sum(F.size("few")).alias("few"), F.sum(F.octet_length("bits")).alias("bits")).first()
    cores = spark.sparkContext.defaultParallelism
    blocks = max(math.ceil(seen.owners / OWNERS), math.ceil((seen.few or 0) / ENTRIES), math.ceil((seen.bits or 0) / BLOCK_BYTES), math.ceil(math.sqrt(8 * cores)))

    def kernel(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        p, q = (k.as_py() for k in key)
        block = t.column("block").to_numpy()
        x, y = (t.filter(pa.array(block == k)) for k in (p, q))
        if not (x.num_rows and y.num_rows):
            return
        shared = _overlaps(x, y, width)
        (nx, ny), (ox, oy) = ([s.column(c).combine_chunks() for s in (x, y)] for c in ("n", "o"))
        needs = [np.maximum(1, np.ceil(n.to_numpy() * share - 1e-9)) for n in (nx, ny)]
        step = max(1, HELD // len(ny))
        for at in range(0, len(nx), step):
            part = shared[at : at + step]
            hit = part >= np.minimum.outer(needs[0][at : at + step], needs[1])
            if p == q:
                hit &= np.arange(at, at + len(part))[:, None] < np.arange(len(ny))
            i, j = np.nonzero(hit)
            if len(i):
                cols = [ox.take(pa.array(i + at)), oy.take(pa.array(j)), nx.take(pa.array(i + at)), ny.take(pa.array(j)), pa.array(part[i, j].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["x", "y", "nx", "ny", "shared"])

    kind = sets.schema["o"].dataType.simpleString()
    met = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    b = sets.withColumn("block", F.pmod(F.xxhash64("o"), F.lit(blocks)).cast("int")).withColumn("other", met)
    b = b.select(F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "o", "n", "bits", "few")
    tasks = max(4 * cores, min(blocks * (blocks + 1), int(spark.conf.get("spark.sql.shuffle.partitions")) * 16))
    s = b.repartition(tasks, "p", "q").groupBy("p", "q").applyInArrow(kernel, f"x {kind}, y {kind}, nx bigint, ny bigint, shared bigint")
    small, large = F.least("nx", "ny"), F.greatest("nx", "ny")
    s = s.withColumn("frac_small", F.col("shared") / small).withColumn("jaccard", F.col("shared") / (small + large - F.col("shared")))
    return s.filter(F.col("frac_small") >= share - 1e-12).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "frac_small", "jaccard")


def components(spark, nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Connected components: every node gets the smallest node number it is linked with.

    Labels are spread along edges and then replaced by the label of the label, so the number of
    rounds grows with the logarithm of the longest chain. Each round is two joins and one
    aggregate; a round's result is written to the shared folder, which cuts the lineage.
    """
    from terravox.session import scratch_path

    base = scratch_path(spark, "components")
    e = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    e.write.parquet(f"{base}/edges")
    e = spark.read.parquet(f"{base}/edges")
    lab = nodes.select(F.col(node).alias("node"), F.col(node).alias("label")).distinct()
    step = 0
    while True:
        seen = e.join(lab.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nxt = lab.join(seen, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("got"))
        jump = lab.select(F.col("node").alias("got"), F.col("label").alias("far"))
        nxt = nxt.join(jump, "got", "left").select("node", F.least("got", F.coalesce("far", "got")).alias("label"), F.col("label").alias("old"))
        nxt.write.parquet(f"{base}/round={step}")
        nxt = spark.read.parquet(f"{base}/round={step}")
        changed = nxt.filter("label <> old").limit(1).count()
        lab = nxt.select("node", "label")
        step += 1
        if not changed:
            return lab
