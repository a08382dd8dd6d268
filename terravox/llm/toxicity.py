"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its hashed features: words, pairs of neighbours, and pairs with one word
between them (A-Z lower-cased; words as runs of ASCII letters, digits and non-ASCII characters). The
learner keeps a rate per coordinate and an L1 penalty that holds weak coordinates at exactly zero, so
that the model is a short list of (bucket, weight), sent to every task.

Training reads at most ``FIT_ROWS`` labelled rows outside the held-out fold, picked by a hash; their
feature sets are made in parallel, ``SHARDS`` tasks each run FTRL over their share, and the states are
averaged after each of ``EPOCHS`` rounds. Shares are dealt by a min-hash of the features, so that copies
and near copies mostly share one: what only they have must pass the L1 bound with the average of one
share. Equal feature sets are learnt once. Scoring reads every whole text.

Rows without a label, or whose label is null, are not trained on; several labels of one key count as
the largest. Without any labelled row all scores are the prior, 1 in 20. Null and empty texts have no
features: their score is the model's bias alone. A null key is never held out. Repeated rows give
repeated results. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravox.llm.common import fresh, map_texts
from terravox.llm.license_scan import words_of
from terravox.session import keep

BITS = 18
#: Labelled rows that the model is fitted on at most.
FIT_ROWS = 16_000
SHARDS = 8
EPOCHS = 12
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.5
THRESHOLD = 0.3
#: Words whose hash a task remembers; then it starts afresh.
REMEMBERED = 100_000
#: Text handled at once; its words and pairs take some forty times as much.
CHUNK = 1 << 19
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Hash of a word, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


@dataclass(frozen=True)
class Model:
    bias: float
    buckets: np.ndarray  # int32, ascending
    weights: np.ndarray  # float32


def features(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram occurrence, words, pairs and skip-pairs one after the other."""
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
    del words
    row = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    shift = np.uint64(64 - BITS)
    rows, buckets = [row], [(h * _A) >> shift]
    for gap in (1, 2):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            mixed = (h[:-gap] * _B + h[gap:] * np.uint64(2 * gap + 1)) * _A
            rows.append(row[:-gap][same])
            buckets.append((mixed >> shift)[same])
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


def feature_sets(texts: list[bytes], hashes: WordHashes) -> list[bytes]:
    """The distinct buckets of each text as packed int32."""
    row, bucket = features(texts, hashes)
    u = np.unique((row << BITS) | bucket)
    cuts = np.searchsorted(u >> BITS, np.arange(len(texts) + 1))
    low = (u & ((1 << BITS) - 1)).astype(np.int32)
    return [low[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


class Ftrl:
    """State of the learner: per-coordinate z and squared-gradient sum, and an unpenalised bias."""

    def __init__(self, z: np.ndarray, n: np.ndarray, bias: float, bias_n: float):
        self.z, self.n, self.bias, self.bias_n = z, n, bias, bias_n

    def weights(self, ids: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0.0
        return w

    def learn(self, ids: np.ndarray, y: float) -> None:
        w = self.weights(ids)
        g = 1.0 / (1.0 + np.exp(-np.clip(self.bias + w.sum(), -30, 30))) - y
        n = self.n[ids]
        self.z[ids] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[ids] = n + g * g
        self.bias_n += g * g
        self.bias -= ALPHA / (BETA + np.sqrt(self.bias_n)) * g


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(fit_rows)
    # At most fit_rows pairs of numbers: a bound of its own.
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key)
    made = map_texts(rows, [key, "y"], "text", "ids binary, shard int", feature_sets_of, setup=WordHashes, chunk_bytes=CHUNK)
    # One row per share, so that a round reads the written table as it lies, without a shuffle.
    table = keep(made.groupBy("shard").applyInPandas(packed_of(key), PACKED), "toxicity-fit")
    seen = table.agg(F.sum("rows").alias("n"), F.sum("pos").alias("pos")).first()
    n_rows = seen.n or 0
    prior = ((seen.pos or 0) + 0.5) / (n_rows + 10.0)
    size = 1 << BITS
    z, n, bias, bias_n = np.zeros(size, np.float32), np.zeros(size, np.float32), float(np.log(prior / (1 - prior))), 0.0
    for epoch in range(EPOCHS if n_rows else 0):
        state = spark.sparkContext.broadcast((z, n, bias, bias_n, epoch))
        parts = table.mapInArrow(learner_of(state), STATE).collect()
        dz, dn = np.zeros(size, np.float32), np.zeros(size, np.float32)
        for p in parts:
            at = np.frombuffer(p.at, np.int32)
            dz[at] += np.frombuffer(p.z, np.float32) - z[at]
            dn[at] += np.frombuffer(p.n, np.float32) - n[at]
        z, n = z + dz / len(parts), n + dn / len(parts)
        bias, bias_n = float(np.mean([p.bias for p in parts])), float(np.mean([p.bias_n for p in parts]))
        state.destroy()
    w = Ftrl(z.astype(np.float64), n.astype(np.float64), bias, bias_n).weights(slice(None))
    at = np.flatnonzero(w).astype(np.int32)
    return Model(bias, at, w[at].astype(np.float32))


def min_hash(ids: bytes) -> int:
    mixed = (np.frombuffer(ids, np.int32).astype(np.uint64) * _A) >> np.uint64(20)
    return int(mixed.min()) if len(mixed) else 0


PACKED = "ids binary, sizes binary, ys binary, order binary, rows bigint, pos bigint"
STATE = "at binary, z binary, n binary, bias double, bias_n double"


def packed_of(key: str):
    """A share as one row: feature sets end to end, their sizes, labels, and a hash to order rounds by."""

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values([key, "y"]).drop_duplicates("ids")
        y = (shard["y"].to_numpy() > 0).astype(np.int8)
        sizes = np.array([len(x) // 4 for x in shard["ids"]], np.int32)
        order = np.array([xxhash.xxh64_intdigest(str(k)) for k in shard[key]], np.uint64)
        return pd.DataFrame({"ids": [b"".join(shard["ids"])], "sizes": [sizes.tobytes()], "ys": [y.tobytes()], "order": [order.tobytes()], "rows": [len(y)], "pos": [int(y.sum())]})

    return pack


def learner_of(state):
    """One round of a share from the common state; returns what it has touched."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                z0, n0, bias, bias_n, epoch = state.value
                ids, sizes, ys, order = (np.frombuffer(b.column(i)[row].as_py(), t) for i, t in enumerate((np.int32, np.int32, np.int8, np.uint64)))
                m = Ftrl(z0.astype(np.float64), n0.astype(np.float64), bias, bias_n)
                ends = np.cumsum(sizes)
                for i in np.argsort(order * (np.uint64(2 * epoch + 1) * _A), kind="stable").tolist():
                    m.learn(ids[ends[i] - sizes[i] : ends[i]], float(ys[i]))
                at = np.flatnonzero(m.n != n0).astype(np.int32)
                cols = [[at.tobytes()], [m.z[at].astype(np.float32).tobytes()], [m.n[at].astype(np.float32).tobytes()]]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.binary()) for c in cols], pa.array([m.bias]), pa.array([m.bias_n])], names=["at", "z", "n", "bias", "bias_n"])

    return learn


def feature_sets_of(raws: list[bytes], hashes: WordHashes) -> list[list]:
    sets = feature_sets(raws, hashes)
    return [sets, [min_hash(s) % SHARDS for s in sets]]


def scores(raws: list[bytes], hashes: WordHashes, model: Model, dense: np.ndarray) -> np.ndarray:
    row, bucket = features(raws, hashes)
    hit = np.flatnonzero(dense[bucket])
    u = np.unique((row[hit] << BITS) | bucket[hit])
    total = np.bincount(u >> BITS, weights=dense[u & ((1 << BITS) - 1)], minlength=len(raws)) + model.bias
    return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def score(docs: DataFrame, model: Model, passed: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """Columns ``passed`` and ``name`` (0 to 1, higher: more likely toxic) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        dense = np.zeros(1 << BITS, np.float64)
        dense[sent.value.buckets] = sent.value.weights
        return WordHashes(), dense

    return map_texts(docs, passed, text, f"{name} double", lambda raws, s: [scores(raws, s[0], sent.value, s[1])], setup=setup, chunk_bytes=CHUNK)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: key, ``held_out``, ``score`` and ``predicted``."""
    model = fit(docs, labels, key, text)
    return score(docs, model, [key], text).select(
        key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, with their columns."""
    model = fit(docs, labels, key, text)
    name = fresh(docs.columns, "_score")
    return score(docs, model, docs.columns, text, name).filter(F.col(name) < threshold).drop(name)
