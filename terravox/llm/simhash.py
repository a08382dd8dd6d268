"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: texts have A-Z lower-cased and are cut into words at blanks and ASCII control blanks; each
run of three words, repeats included, is hashed (XXH64, seed 42), and a bit of the fingerprint is set
where it is set in over half of the hashes. A text of one or two words is one run, one without words
has fingerprint zero.

Linking: two fingerprints that differ in at most ``tau`` bits differ, in at least one of m groups of
bits, in at most t_i bits, whenever the thresholds add up to tau - m + 1 (a threshold of -1 leaves a
group out). Bits that vary together are put into one group; the thresholds, and m itself, are chosen by
dynamic programming on candidate counts estimated from a sample of fingerprints. The choice sets the
cost only, never the result. Each fingerprint is filed under its value in every group, probes are sent
to all values within t_i bits, and what meets there is verified on all 64 bits.

Equal fingerprints are one node, so copies never multiply. What meets in a bucket is verified as arrays
and leaves at most one link per member, a spanning forest of the true links. A bucket of more than
``BUCKET`` rows is cut into blocks, and each pair of blocks is a task of its own: no pair is left out and
no task holds more than two blocks.

Null and empty texts have fingerprint zero and are linked with each other like any others. A null key
takes part and gets the component of its fingerprint, whose id is the smallest non-null key. Repeated
rows give repeated results. Other columns of the input are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.llm.common import map_texts
from terravox.operators.setops import components
from terravox.session import keep

TAU = 3
SHINGLE = 3
SEED = 42
#: Fingerprints from which bit groups and thresholds are chosen.
FIT_ROWS = 4000
#: Rows of a bucket that one task verifies at once.
BUCKET = 8192
#: Rows of a bucket up to which its candidates are verified as rows of a join.
SMALL = 64


def shingle_hashes(raw: bytes) -> np.ndarray:
    words = raw.lower().split()
    text = b" ".join(words)
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return np.array([digest(text, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - SHINGLE])).tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    view = memoryview(text)
    return np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n - SHINGLE + 1)


def fingerprint(raw: bytes) -> int:
    """The fingerprint as a signed 64-bit number."""
    h = shingle_hashes(raw)
    if len(h) == 0:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, passed: list[str], text: str = "text") -> DataFrame:
    """Columns ``passed`` and the fingerprint ``fp`` (bigint) of every row."""
    return map_texts(df, passed, text, "fp bigint", lambda raws: [[fingerprint(r) for r in raws]])


# ---- choice of bit groups and thresholds -------------------------------------------------------


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m groups of like size, each grown from bits that vary most with those it has."""
    if len(sample) < 2:
        return [list(g) for g in np.array_split(np.arange(64), m)]
    b = bits_of(sample).astype(np.float64)
    b -= b.mean(0)
    sd = np.sqrt((b * b).mean(0))
    sd[sd == 0] = 1.0
    c = np.abs((b.T @ b) / len(b) / np.outer(sd, sd))
    np.fill_diagonal(c, 0.0)
    free, groups = list(range(64)), []
    for g in range(m):
        size = len(np.array_split(np.arange(64), m)[g])
        own = [max(free, key=lambda i: (round(float(c[i, free].sum()), 9), -i))]
        while len(own) < size:
            rest = [i for i in free if i not in own]
            own.append(max(rest, key=lambda i: (round(float(c[i, own].sum()), 9), -i)))
        free = [i for i in free if i not in own]
        groups.append(sorted(own))
    return groups


def masked(fp: np.ndarray, group: list[int]) -> np.ndarray:
    mask = np.uint64(sum(1 << i for i in group))
    return fp.astype(np.int64).view(np.uint64) & mask


def plan_thresholds(sample: np.ndarray, total: int, tau: int = TAU) -> tuple[list[list[int]], list[int], float]:
    """(groups, thresholds, cost): the cheapest way to split tau - m + 1 over m groups, over all m.

    Cost of threshold t in a group: the probes that all fingerprints send, and the pairs that meet,
    estimated by the share of sampled pairs within t bits (never below that of uniform bits).
    """
    best = None
    half = sample[: min(len(sample), FIT_ROWS)]
    for m in range(1, tau + 2):
        groups = bit_groups(sample, m)
        budget = tau - m + 1
        table = []
        for g in groups:
            v = masked(half, g)
            near = np.zeros(tau + 2)
            for i in range(0, len(v), 256):
                d = np.bitwise_count(v[i : i + 256, None] ^ v[None, :])
                near += np.bincount(np.minimum(d, tau + 1).ravel(), minlength=tau + 2)
            near[0] -= len(v)
            share = np.cumsum(near) / max(1, len(v) * (len(v) - 1))
            costs = {-1: 0.0}
            for t in range(tau + 1):
                ways = sum(comb(len(g), k) for k in range(t + 1))
                costs[t] = total * (1.0 + ways) + 0.01 * max(share[t], ways / 2.0 ** len(g)) * total * total
            table.append(costs)
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for costs in table:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in reach.items():
                for t, c in costs.items():
                    if used + t not in step or cost + c < step[used + t][0]:
                        step[used + t] = (cost + c, [*chosen, t])
            reach = step
        cost, chosen = reach[budget]
        if best is None or cost < best[2]:
            best = (groups, chosen, cost)
    return best


# ---- probing and verifying ---------------------------------------------------------------------


def _forest(a: np.ndarray, b: np.ndarray, tau: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the pairs (x of a, y of b) that differ in at most tau bits."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ia, ib = at[: len(a)], at[len(a) :]
    ua, ub = a.view(np.uint64), b.view(np.uint64)
    left, right = [], []
    label = np.arange(len(nodes))
    rows = max(1, (1 << 20) // max(1, len(b)))
    for i in range(0, len(a), rows):
        x, y = np.nonzero(np.bitwise_count(ua[i : i + rows, None] ^ ub[None, :]) <= tau)
        x, y = ia[x + i], ib[y]
        open_ = label[x] != label[y]  # pairs that earlier rows have joined are passed over as arrays
        for p, q in zip(x[open_].tolist(), y[open_].tolist()):
            rp, rq = root(p), root(q)
            if rp != rq:
                parent[max(rp, rq)] = min(rp, rq)
                left.append(int(nodes[p]))
                right.append(int(nodes[q]))
        label = np.fromiter((root(k) for k in range(len(nodes))), np.int64, len(nodes)) if open_.any() else label
    return left, right


def filed_rows(nodes: DataFrame, tau: int = TAU, passed: tuple[str, ...] = ()) -> DataFrame:
    """Every fingerprint under its value in each group of bits, and its probes: part, value, fp, ``passed``, probe.

    Two fingerprints within tau bits share a value where at least one of the two is not a probe.
    """
    total = nodes.count()
    rows = nodes.select("fp", F.xxhash64("fp").alias("h")).orderBy("h").limit(FIT_ROWS).collect()
    sample = np.array([r.fp for r in rows], np.int64)
    groups, thresholds, _ = plan_thresholds(sample, max(1, total), tau)  # without rows every choice would cost nothing
    parts = []
    for i, (g, t) in enumerate(zip(groups, thresholds)):
        if t < 0:
            continue
        mask = int(np.array(sum(1 << k for k in g), np.uint64).view(np.int64))
        own = F.col("fp").bitwiseAND(F.lit(mask))
        index = nodes.select(F.lit(i).alias("part"), own.alias("value"), "fp", *passed, F.lit(False).alias("probe"))
        parts.append(index)
        if t > 0:
            flips = [0]
            singles = [int(np.array(1 << k, np.uint64).view(np.int64)) for k in g]
            layer = [0]
            for _ in range(t):
                layer = sorted({x ^ s for x in layer for s in singles} - set(flips))
                flips += layer
            sent = nodes.select("fp", *passed, own.alias("own"), F.explode(F.array(*[F.lit(f) for f in flips[1:]])).alias("flip"))
            parts.append(sent.select(F.lit(i).alias("part"), F.col("own").bitwiseXOR(F.col("flip")).alias("value"), "fp", *passed, F.lit(True).alias("probe")))
    filed = parts[0]
    for p in parts[1:]:
        filed = filed.unionByName(p)
    return filed


def links(nodes: DataFrame, tau: int = TAU, bucket: int = BUCKET, small: int = SMALL) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints ``fp`` exactly as all pairs within tau bits would.

    ``nodes`` is read several times and should be a written table.
    """
    filed = filed_rows(nodes, tau)
    size = filed.groupBy("part", "value").agg(F.count("*").alias("n"), F.count_if(~F.col("probe")).alias("n_index"))
    size = size.filter("n > 1 and n_index > 0")
    filed = filed.join(size, ["part", "value"]).drop("n_index")
    # Small buckets: candidate pairs as rows, at most ``small`` for a member.
    few = filed.filter(F.col("n") <= small)
    a = few.filter(~F.col("probe")).select("part", "value", F.col("fp").alias("a"))
    b = few.select("part", "value", F.col("fp").alias("b"), "probe")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau
    pairs = a.join(b, ["part", "value"]).filter(((F.col("probe") & (F.col("a") != F.col("b"))) | (F.col("a") < F.col("b"))) & near).select("a", "b")
    # Larger ones: a bucket of one block is one group; of more, every pair of blocks, the own pair included.
    many = filed.filter(F.col("n") > small).withColumn("blocks", F.ceil(F.col("n") / bucket).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks").cast("bigint")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = many.withColumn("other", other).select(
        "part", "value", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "fp", "probe"
    )

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        fp, probe, block = group["fp"].to_numpy(np.int64), group["probe"].to_numpy(bool), group["block"].to_numpy()
        pairs = []
        index = ~probe
        if probe.any():
            pairs.append((fp[probe], fp[index]))
        if block.min() == block.max():
            pairs.append((fp[index], fp[index]))
        else:
            low = block == block.min()
            pairs.append((fp[index & low], fp[index & ~low]))
            # Members of one block meet in the group of that block alone.
        a, b = [], []
        for x, y in pairs:
            if len(x) and len(y):
                p, q = _forest(x, y, tau)
                a += p
                b += q
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    found = spread.groupBy("part", "value", "b1", "b2").applyInPandas(verify, "a bigint, b bigint")
    found = found.unionByName(pairs)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", tau: int = TAU) -> DataFrame:
    """One row per row of ``df``: the key, ``fingerprint`` (16 hex digits) and ``component_id``."""
    prints = keep(fingerprints(df, [key], text), "simhash")
    return assign(prints, key, tau).select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def assign(prints: DataFrame, key: str, tau: int = TAU) -> DataFrame:
    """``prints`` (with column ``fp``) and ``component_id``: the smallest key reachable over links."""
    spark = prints.sparkSession
    nodes = keep(prints.groupBy("fp").agg(F.min(key).alias("first")), "simhash-nodes")
    edges = keep(links(nodes, tau), "simhash-links")
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    label = components(spark, ends, edges)
    named = nodes.join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return prints.join(named.select("fp", "label").join(least, "label").select("fp", "component_id"), "fp")
