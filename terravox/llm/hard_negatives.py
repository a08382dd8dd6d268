"""Hard negatives: rows of another label that score a little below an anchor's positives.

The rows are put in the order of a Hilbert curve and cut into blocks of ``BLOCK`` neighbours, each kept as
one Parquet row with its zone map: the smallest and largest value of every dimension, and the labels it
holds if all rows have one. For an anchor, interval arithmetic over a zone map bounds the inner products
of the whole block from both sides. A block is read for an anchor only if its bounds meet what the anchor
still asks for: its positives, which have the anchor's label and reach the best ``positives`` scores known
so far, then its windows, one per positive, between ``LOW`` and ``HIGH`` per cent of the positive's score,
above the worst of the best ``negatives`` known so far. Bounds are exact on whole numbers, so no row is
lost and nothing is sampled.

Anchors go in waves of neighbours on the curve, about ``WAVE`` each, the only thing sent to tasks. A wave
first reads the zone maps alone and names the stretches of the curve it needs, at most ``STRETCHES`` numbers;
these are pushed down to the block scan, whose result is appended to a table. Each task keeps a few best rows
per anchor or window; they are merged by anchor. Anchors start with the scores in their own block, found without any exchange.

Components become floor(256 * x). Rows with a null id, label, vector or component, or a component that is
not finite, take no part; nor do vectors of another length than most. An id found several times counts once
among an anchor's positives and once among a window's negatives, with its best score; as an anchor it
counts once, with its smallest row. Rows that have the anchor's id are never its positives or negatives.
Ties go to the smaller id. Scores are exact; beyond 64 bits they count as the last number of that size. Other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravox.session import keep, scratch_path

BLOCK = 256
WAVE = 4096
STRETCHES = 1024
#: Rows in one written part of the curve.
PART = 200_000
#: Dimensions and bits of each that the curve runs through: those with the largest variance.
CURVE_DIMS, CURVE_BITS = 8, 8
#: A negative's score lies between these per cent of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hilbert(coords: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row on the Hilbert curve through a cube of ``2**bits`` steps a side, as 64-bit numbers.

    The curve visits the corners of a cube in Gray-code order and turns the frame at each of them: going
    down by one bit a round, the bits of a point are put into the frame, read as a Gray code, and the
    frame is turned for the next round. A frame is an exchange of axes and a mirror, kept per row.
    """
    n, dims = coords.shape
    key = np.zeros(n, np.uint64)
    axis = np.zeros(n, np.int64)  # how far the axes are turned
    flip = np.zeros(n, np.int64)  # which axes are mirrored
    full = (1 << dims) - 1

    def turned_right(v: np.ndarray, by: np.ndarray) -> np.ndarray:
        return ((v >> by) | (v << (dims - by))) & full

    for bit in range(bits - 1, -1, -1):
        corner = np.zeros(n, np.int64)
        for d in range(dims):
            corner |= ((coords[:, d].astype(np.int64) >> bit) & 1) << d
        seen = turned_right(corner ^ flip, (axis + 1) % dims)
        place = seen.copy()
        shift = 1
        while shift < dims:
            place ^= place >> shift
            shift <<= 1
        key = (key << np.uint64(dims)) | place.astype(np.uint64)
        # Where the curve enters this corner's cube, and along which axis it leaves.
        even = np.where(place == 0, 0, ((place - 1) >> 1) << 1)
        enter = even ^ (even >> 1)
        odd = np.where(place % 2 == 0, place - 1, place)  # trailing ones of this number give the axis
        trailing = np.zeros(n, np.int64)
        rest = np.where(place == 0, 0, odd)
        for _ in range(dims):
            more = (rest & 1) == 1
            trailing += more
            rest = np.where(more, rest >> 1, 0)
        leave = trailing % dims
        flip ^= turned_right(enter, (dims - (axis + 1) % dims) % dims)
        axis = (axis + leave + 1) % dims
    return key


def usable_rows(df: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, int, int]:
    """(id, label, v) of the rows that take part, their dimension and the largest magnitude in them."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # floor() of a double gives a long; larger numbers are whole already.
    held = lambda x: F.greatest(F.lit(-1e300), F.least(F.lit(1e300), x * SCALE))
    whole = F.transform(v, lambda x: F.when(F.abs(x * SCALE) < 2.0**53, F.floor(x * SCALE).cast("double")).otherwise(held(x)))
    rows = df.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), whole.alias("v"))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("m")).orderBy(F.desc("n"), "d").first()
    if most is None or most.d == 0:
        return rows.filter("false"), 0, 0
    return rows.filter(F.size("v") == most.d), int(most.d), int(most.m)


class Numbers:
    """How components are stored and multiplied so that every inner product is exact."""

    def __init__(self, dim: int, largest: int):
        self.dim = dim
        self.stored = np.dtype("<i2") if largest < 1 << 15 else np.dtype("<i4") if largest < 1 << 31 else np.dtype("<f8")
        self.exact_doubles = dim * largest * largest < 1 << 53

    def read(self, packed: bytes) -> np.ndarray:
        return self.work(np.frombuffer(packed, self.stored).reshape(-1, self.dim))

    def work(self, v: np.ndarray) -> np.ndarray:
        """Doubles where they are exact, Python's whole numbers otherwise."""
        v = v.astype(np.float64)
        return v if self.exact_doubles else np.array([[int(x) for x in r] for r in v.tolist()], object).reshape(v.shape)

    def products(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = x @ y
        return out if self.exact_doubles else np.clip(out, -(1 << 63), (1 << 63) - 1)

    def bounds(self, asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest inner product that each asked vector can have with any row of a zone."""
        zero = asked * 0
        up, down = np.maximum(asked, zero), np.minimum(asked, zero)
        least, most = up @ low + down @ high, up @ high + down @ low
        return (least, most) if self.exact_doubles else (np.clip(least, -(1 << 63), (1 << 63) - 1), np.clip(most, -(1 << 63), (1 << 63) - 1))


def blocks(rows: DataFrame, numbers: Numbers, every: int, positives: int) -> tuple[DataFrame, DataFrame]:
    """The written blocks (stretch, zone map, ids, labels, vectors) and the anchors, with a first floor each."""
    dim = numbers.dim
    spread = rows.agg(*[F.struct(F.var_pop(F.col("v")[i]), F.min(F.col("v")[i]), F.max(F.col("v")[i])).alias(f"d{i}") for i in range(dim)], F.count(F.lit(1)).alias("n")).first()
    chosen = sorted(range(dim), key=lambda i: -(spread[i][0] or 0.0))[:CURVE_DIMS]
    low = np.array([spread[i][1] for i in chosen])
    width = np.array([max(spread[i][2] - spread[i][1], 1e-300) for i in chosen])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.asarray(b.column(2).flatten()).reshape(-1, dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    steps = np.nan_to_num((v[:, chosen] - low) / width * (1 << CURVE_BITS))
                steps = np.clip(steps, 0, (1 << CURVE_BITS) - 1).astype(np.int64)
                packed = v.astype(numbers.stored)
                # Signed, so that Spark orders places as numbers.
                key = (hilbert(steps, CURVE_BITS) ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key), pa.array([r.tobytes() for r in packed], pa.binary())], names=["id", "label", "place", "v"])

    placed = keep(rows.mapInArrow(place, "id bigint, label bigint, place bigint, v binary"), "negatives-places")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-spread.n // PART))
    # Ids break ties, so equal vectors do not pile up in one part.
    ordered = placed.repartitionByRange(parts, "label", "place", "id").sortWithinPartitions("label", "place", "id", "v")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "id", "label", "v")
    stretch = max(1, -(-max(parts, 1) // STRETCHES))
    zone = pa.list_(pa.float64())
    fields = [("stretch", pa.int32()), ("one_label", pa.int64()), ("low", zone), ("high", zone), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("v", pa.binary())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part: pa.Table) -> pa.RecordBatch:
            raw = b"".join(part.column("v").to_pylist())
            v = np.frombuffer(raw, numbers.stored).reshape(-1, dim).astype(np.float64)
            labels = part.column("labels").to_numpy()
            one = labels[0] if (labels == labels[0]).all() else None
            made = [part.column("stretch")[0].as_py() // stretch, one, v.min(0), v.max(0), part.column("ids").to_numpy(), labels, raw]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(made, fields)], names=[n for n, _ in fields])

        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            held.append(b.rename_columns(["stretch", "ids", "labels", "v"]))
            count += b.num_rows
            if count >= BLOCK:
                t = pa.Table.from_batches(held)
                while count >= BLOCK:
                    yield block(t.slice(0, BLOCK))
                    t, count = t.slice(BLOCK), count - BLOCK
                held = t.to_batches()
        if count:
            yield block(pa.Table.from_batches(held))

    made = keep(ordered.mapInArrow(cut, "stretch int, one_label bigint, low array<double>, high array<double>, ids array<bigint>, labels array<bigint>, v binary"), "negatives-blocks")

    def first_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, labels, x = np.array(r["ids"]), np.array(r["labels"]), numbers.read(r["v"])
                at = np.flatnonzero(ids % every == 0)
                floor = []
                for i in at:
                    other = (labels == labels[i]) & (ids != ids[i])
                    score = np.sort(numbers.products(x[other], x[i]))[::-1]
                    # Repeated ids count once: only a block of different ids gives a floor.
                    sure = numbers.exact_doubles and len(np.unique(ids[other])) == len(score) >= positives
                    floor.append(float(score[positives - 1]) if sure else None)
                raw = [np.frombuffer(r["v"], numbers.stored).reshape(-1, dim)[i].tobytes() for i in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(labels[at]), pa.array([r["stretch"]] * len(at), pa.int32()), pa.array(raw, pa.binary()), pa.array(floor, pa.float64())],
                    names=["id", "label", "stretch", "v", "floor"],
                )

    anchors = made.select("stretch", "ids", "labels", "v").mapInArrow(first_floors, "id bigint, label bigint, stretch int, v binary, floor double")
    return made, keep(anchors.groupBy("id").agg(F.min(F.struct("label", "v", "stretch", "floor")).alias("a")).select("id", "a.*"), "negatives-anchors")


class Asked:
    """What a wave asks for: per entry a vector, a label to have or to avoid, and an interval of scores."""

    def __init__(self, numbers: Numbers, same: bool, ids: np.ndarray, labels: np.ndarray, v: list[bytes], tags: np.ndarray, low: np.ndarray, high: np.ndarray, best: int):
        self.numbers, self.same, self.best = numbers, same, best
        self.ids, self.labels, self.tags = ids, labels, tags
        # Entries of one anchor share its vector.
        _, self.first, self.owner = np.unique(ids, return_index=True, return_inverse=True)
        self.v = numbers.read(b"".join(v[i] for i in self.first))
        self.low, self.high = low, high

    def start(self) -> None:
        self.found: list[list[tuple]] = [[] for _ in self.ids]
        self.floor = self.low.copy()
        self.read = self.met = 0

    def needs(self, one_label: int | None, low: list, high: list, floor: np.ndarray) -> np.ndarray:
        """Entries whose interval the bounds of a zone meet."""
        low, high = self.numbers.work(np.array([low, high], np.float64))
        least, most = self.numbers.bounds(self.v, low, high)
        ok = (most[self.owner] >= floor) & (least[self.owner] <= self.high)
        if one_label is not None:
            ok &= (self.labels == one_label) == self.same
        return np.flatnonzero(ok)

    def add(self, r: dict) -> None:
        """Take from a block what the entries need whose interval its zone map meets."""
        at = self.needs(r["one_label"], r["low"], r["high"], self.floor)
        self.met += len(self.ids)
        self.read += len(at)
        if not len(at):
            return
        ids, labels = np.array(r["ids"]), np.array(r["labels"])
        owners, column = np.unique(self.owner[at], return_inverse=True)
        scores = self.numbers.products(self.numbers.read(r["v"]), self.v[owners].T)[:, column]
        ok = (scores >= self.floor[at]) & (scores <= self.high[at]) & (ids[:, None] != self.ids[at]) & ((labels[:, None] == self.labels[at]) == self.same)
        for n in np.flatnonzero(ok.any(axis=0)):
            e, hit = at[n], np.flatnonzero(ok[:, n])
            seen: set[int] = set()
            merged = sorted([*self.found[e], *zip((-scores[hit, n]).tolist(), ids[hit].tolist())])
            self.found[e] = [p for p in merged if not (p[1] in seen or seen.add(p[1]))][: self.best]
            if len(self.found[e]) == self.best:
                self.floor[e] = -self.found[e][-1][0]

    def result(self) -> pa.RecordBatch:
        rows = [(i, t, d, -s) for i, t, f in zip(self.ids.tolist(), self.tags.tolist(), self.found) for s, d in f]
        cols = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array([int(x) for x in c], pa.int64()) for c in cols], names=["anchor_id", "tag", "id", "score"])


FOUND = "anchor_id bigint, tag bigint, id bigint, score bigint"


def search(made: DataFrame, asked: Asked) -> DataFrame:
    """Up to ``asked.best`` rows of each task for each entry of a wave."""
    spark = made.sparkSession
    sent = spark.sparkContext.broadcast(asked)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, out = sent.value, set()
        for b in batches:
            for r in b.to_pylist():
                if r["stretch"] not in out and len(a.needs(r["one_label"], r["low"], r["high"], a.low)):
                    out.add(r["stretch"])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.int32())], names=["stretch"])

    zones = made.select("stretch", "one_label", "low", "high")
    needed = [r.stretch for r in zones.mapInArrow(stretches, "stretch int").distinct().collect()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        a.start()
        for b in batches:
            for i in range(b.num_rows):
                a.add(b.slice(i, 1).to_pylist()[0])
        yield a.result()

    return made.filter(F.col("stretch").isin(needed) if needed else F.lit(False)).mapInArrow(scan, FOUND)


def _best(found: DataFrame, n: int) -> DataFrame:
    each = found.groupBy("anchor_id", "tag", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= n)


def _waves(asked: DataFrame, wave: int) -> Iterator[list]:
    """Entries in bounded waves, of neighbours on the curve, as they need the same stretches.

    Whole stretches are put together; one with more entries than a wave is dealt by the entries' digest.
    """
    shares, number, room = [], -1, 0
    for r in asked.groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).orderBy("stretch").collect():
        deals = -(-r.n // wave)
        if deals > 1 or r.n > room:
            number, room = number + 1, wave
        shares.append((r.stretch, number, deals))
        number, room = number + deals - 1, room - r.n if deals == 1 else 0
    if not shares:
        return
    spark = asked.sparkSession
    path = scratch_path(spark, "negatives-waves")
    dealt = spark.createDataFrame(shares, "stretch int, _wave int, _deals int")  # one row per stretch
    at = F.col("_wave") + F.pmod(F.xxhash64(*[c for c in asked.columns if c != "v"]), F.col("_deals"))
    asked.join(F.broadcast(dealt), "stretch").withColumn("wave", at.cast("int")).drop("_wave", "_deals").repartition("wave").write.partitionBy("wave").parquet(path)
    for w in range(number + 1):
        yield spark.read.parquet(path).filter(F.col("wave") == w).collect()


def _searched(made: DataFrame, waves: Iterator[Asked]) -> DataFrame:
    """What all waves find, in one table of the shared folder."""
    spark = made.sparkSession
    path = scratch_path(spark, "negatives-found")
    spark.createDataFrame([], FOUND).write.parquet(path)
    for asked in waves:
        search(made, asked).write.mode("append").parquet(path)
    return spark.read.schema(FOUND).parquet(path)


def mine(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    wave: int = WAVE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``.
    """
    rows, dim, largest = usable_rows(df, key, vector, label)
    if not dim:
        return df.sparkSession.createDataFrame([], RESULT)
    numbers = Numbers(dim, largest)
    made, anchors = blocks(rows, numbers, every, positives)

    def asked(rows: list, same: bool, tags: list, low: list, high: list, best: int) -> Asked:
        kind = np.float64 if numbers.exact_doubles or same else object
        ids, labels = np.array([r.id for r in rows]), np.array([r.label for r in rows])
        return Asked(numbers, same, ids, labels, [bytes(r.v) for r in rows], np.array(tags), np.array(low, kind), np.array(high, kind), best)

    def for_positives() -> Iterator[Asked]:
        for part in _waves(anchors, wave):
            yield asked(part, True, [0] * len(part), [-np.inf if r.floor is None else r.floor for r in part], [np.inf] * len(part), positives)

    liked = keep(_best(_searched(made, for_positives()), positives), "negatives-positives")
    windows = liked.select(F.col("anchor_id").alias("id"), F.col("id").alias("tag"), "score").join(anchors, "id")

    def for_negatives() -> Iterator[Asked]:
        for part in _waves(windows, wave):
            # In whole numbers: LOW * p <= 100 * s <= HIGH * p.
            yield asked(part, False, [r.tag for r in part], [-(-LOW * r.score // 100) for r in part], [HIGH * r.score // 100 for r in part], negatives)

    worse = _best(_searched(made, for_negatives()), negatives)
    scores = liked.select("anchor_id", F.col("id").alias("tag"), F.col("score").alias("positive_score"))
    return worse.join(scores, ["anchor_id", "tag"]).select(
        "anchor_id", F.col("tag").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


#: The same rows in SQL, every anchor held against every row.
SQL = f"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable AS a JOIN usable AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id, score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM scores WHERE same) AS r WHERE n <= 5),
negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM positives AS p JOIN scores AS s
    ON p.anchor_id = s.anchor_id AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
