"""Benchmark decontamination by latent semantic retrieval.

Items and documents are words (lower-cased runs of ASCII letters, digits and non-ASCII characters).
Passages of ``2 * STRIDE`` words, half overlapping, cover every document whole. Words of the items are
the terms; their weights come from the number of documents that hold them, counted over all documents.
A latent space is fitted by a randomised SVD of the TF-IDF rows of all items of a block, with ``POWER``
power steps. No document is picked for it: the documents enter by the weights, and all of them do.

Search: each passage is folded into the space and held against all items; its cosine is taken with the
length of its whole TF-IDF vector, other words included. A passage is compared with an item from
``COSINE`` on, and whatever its cosine where enough of the item's rarest words lie together: of an item
of n words of which at most b may miss, the b + m rarest are filed, and m of them must stand within one
and a quarter item lengths (m as large as needed up to ``TOGETHER``). No stretch of that length that
covers ``SHARE`` of an item lacks them, so the space, its size and the other words decide no result.
The comparison is by the longest common subsequence of words with the stretch of the document around the
passage. A document holds an item if this covers ``SHARE`` of the item's words, and at least half of the
answer, which is the item's last sentence, or its rarest five words where there is only one sentence.

Items are handled in blocks of about ``BLOCK`` items, each with its own terms and space: what is sent to
a task is bounded by a block, however large the benchmark. Items without words or id are not searched;
null and empty texts hold nothing. Repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.llm.common import fresh, map_texts
from terravox.llm.license_scan import words_of

STRIDE = 20
DIMS, EXTRA, POWER = 128, 16, 1
COSINE = 0.25
SHARE = 0.7
#: Rare words of an item that have to stand together; more of them file more words and let fewer passages in.
TOGETHER = 4
#: Meetings of words and items that are sorted at once.
MEETINGS = 4_000_000
BLOCK = 4000
SEED = 99
_SENTENCE = re.compile(rb"[.!?]+(?:\s+|$)")


@dataclass
class Items:
    """A block of items: ids, words as term numbers from 1, and the term numbers of each answer."""

    ids: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    terms: dict[bytes, int]


@dataclass
class Space:
    weight: np.ndarray  # idf of term 0 (any other word) and of each term
    basis: np.ndarray  # terms x dims, idf included, float32; row 0 is zero
    items: np.ndarray  # items x dims, unit length, float32


def folded_words(raw: bytes) -> list[bytes]:
    """Words with letters of every script in lower case."""
    return words_of(raw if raw.isascii() else raw.decode("utf-8", "replace").lower().encode())


def read_items(rows: list[tuple[int, str]]) -> Items:
    terms: dict[bytes, int] = {}
    ids, words, last = [], [], []
    for item_id, text in sorted(rows):
        raw = (text or "").encode("utf-8", "replace")
        w = folded_words(raw)
        if not w:
            continue
        ids.append(item_id)
        words.append([terms.setdefault(x, len(terms) + 1) for x in w])
        parts = [folded_words(p) for p in _SENTENCE.split(raw)]
        parts = [p for p in parts if p]
        last.append([terms[x] for x in parts[-1] if x in terms] if len(parts) > 1 else [])
    return Items(ids, words, last, terms)


def term_numbers(raws: list[bytes], terms: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(term number of each word, 0 for others, texts end to end; number of words of each text)."""
    get = terms.get
    words = [folded_words(r) for r in raws]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.array([get(w, 0) for ws in words for w in ws], np.int32), sizes


def document_counts(docs: DataFrame, text: str, items: Items) -> tuple[np.ndarray, int]:
    """In how many documents each term is, over all documents, and the number of documents."""
    sent = docs.sparkSession.sparkContext.broadcast(items.terms)
    n_terms = len(items.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 1, np.int64)
        get = sent.value.get
        for b in batches:
            for i in range(0, b.num_rows, 256):
                raws = b.column(0).slice(i, 256).to_pylist()
                own = [{get(w, 0) for w in set(folded_words(r))} for r in raws]
                total += np.bincount(np.fromiter((t for o in own for t in o if t), np.int64), minlength=n_terms + 1)
                total[0] += len(raws)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["term", "n"])

    found = docs.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t")).mapInArrow(run, "term int, n bigint")
    # One row per term of a block at most.
    out = np.zeros(n_terms + 1, np.int64)
    for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out, int(out[0])


def blocks_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block of each word, text of each block, first word of each block); a text has ceil(n / STRIDE) blocks."""
    per = -(-sizes // STRIDE)
    first = np.cumsum(per) - per
    text = np.repeat(np.arange(len(sizes)), per)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    block = np.repeat(first, sizes) + place // STRIDE
    return block, text, (np.arange(len(text)) - first[text]) * STRIDE


def block_sums(t: np.ndarray, block: np.ndarray, n_blocks: int, rows: np.ndarray) -> np.ndarray:
    """Sum of ``rows[t]`` over the words of each block."""
    own = np.flatnonzero(t)
    terms, block = t[own], block[own]
    out = np.zeros((n_blocks, rows.shape[1]), rows.dtype)
    heads = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(own) else own
    sizes = np.diff(np.append(heads, len(own)))
    for i in range(0, len(heads), 1024):  # so that the sums stay in the cache
        at, n = heads[i : i + 1024], sizes[i : i + 1024]
        total = rows[terms[at]]
        for turn in range(1, int(n.max())):
            more = np.flatnonzero(n > turn)
            total[more] += rows[terms[at[more] + turn]]
        out[block[at]] = total
    return out


def paired(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each block plus the next block of its text: a passage begins at every block."""
    out = x.copy()
    same = np.flatnonzero(text[:-1] == text[1:])
    out[same] += x[same + 1]
    return out


def fit_space(items: Items, counts: np.ndarray, n_docs: int, dims: int = DIMS) -> Space:
    """The leading directions of the items' own TF-IDF rows: the whole block, no sample of documents."""
    weight = np.log((1.0 + n_docs) / (1.0 + counts)) + 0.05
    weight[0] = np.log(1.0 + n_docs) + 0.05
    n_terms = len(items.terms)
    wide = min(dims + EXTRA, n_terms)
    own = np.zeros((len(items.ids), n_terms))
    for i, w in enumerate(items.words):
        np.add.at(own[i], np.array(w) - 1, weight[w])
    own /= np.sqrt((own * own).sum(1))[:, None]
    q = np.random.default_rng(SEED).standard_normal((n_terms, wide))
    for _ in range(1 + POWER):
        q, _ = np.linalg.qr(own.T @ (own @ q))
    y = own @ q
    values, turn = np.linalg.eigh(y.T @ y)
    basis = q @ turn[:, np.argsort(-values)[: min(dims, wide)]]
    folded = own @ basis
    norm = np.sqrt((folded * folded).sum(1))[:, None]
    rows = np.vstack([np.zeros((1, basis.shape[1])), basis * weight[1:, None]])
    return Space(weight, rows.astype(np.float32), (folded / np.where(norm > 0, norm, 1.0)).astype(np.float32))


def lcs(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item (as bit masks by term) and ``words``."""
    full = (1 << length) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


class Matcher:
    def __init__(self, items: Items, space: Space, cosine: float, share: float):
        self.items, self.space, self.cosine, self.share = items, space, cosine, share
        self.masks = []
        self.answers = []
        self.times = [Counter(w) for w in items.words]
        for w, last in zip(items.words, items.answers):
            masks: dict[int, int] = {}
            for i, t in enumerate(w):
                masks[t] = masks.get(t, 0) | (1 << i)
            self.masks.append(masks)
            self.answers.append(set(last) or set(sorted(set(w), key=lambda t: (-space.weight[t], t))[:5]))
        self.square = (space.weight**2).astype(np.float64)
        self.file_rare_words()

    def file_rare_words(self) -> None:
        """``posted[post_at[t] : post_at[t + 1]]``: the items that file term t; ``together`` and ``within`` by item."""
        terms, owners, together, within = [], [], [], []
        for i, times in enumerate(self.times):
            n = len(self.items.words[i])
            least = next(k for k in range(n + 1) if k / n >= self.share)  # as check() counts
            m = max(1, min(TOGETHER, least))
            filed = 0
            for t in sorted(times, key=lambda t: (-self.space.weight[t], t)):
                if filed >= n - least + m:
                    break
                filed += times[t]
                terms.append(t)
                owners.append(i)
            together.append(max(1, filed - (n - least)))
            within.append(n + n // 4)
        terms = np.array(terms, np.int64)
        self.posted = np.array(owners, np.int64)[np.argsort(terms, kind="stable")]
        self.post_at = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=len(self.space.weight)))))
        self.together, self.within = np.array(together, np.int64), np.array(within, np.int64)

    def rare_meetings(self, t: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item): words from which on enough rare words of an item stand together in one text."""
        gap = int(self.within.max()) + 1
        place = np.arange(len(t)) + text * gap  # no stretch reaches from one text into the next
        often = np.diff(self.post_at)[t]
        upto = np.cumsum(often)
        far = int(place[-1]) + gap
        places, items = [], []
        a = 0
        while a < len(t):
            done = int(upto[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(upto, done + MEETINGS, "right")))
            n = often[a : b + gap]  # the words after b end stretches that begin before it
            at = np.repeat(np.arange(a, a + len(n)), n)
            turn = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            key = np.sort(self.posted[self.post_at[t[at]] + turn] * far + place[at])
            item = key // far
            last = np.arange(len(key)) + self.together[item] - 1
            ok = np.flatnonzero(last < len(key))
            ok = ok[key[last[ok]] - key[ok] < self.within[item[ok]]]
            p, i = np.searchsorted(place, key[ok] % far), item[ok]
            places.append(p[p < b])
            items.append(i[p < b])
            a = b
        return np.concatenate(places), np.concatenate(items)

    def candidates(self, t: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, item, cosine) of passages near an item, in the space or by its rarest words."""
        block, text, first = blocks_of(sizes)
        n = len(text)
        e = paired(block_sums(t, block, n, self.space.basis), text)
        norm = np.sqrt(paired(np.bincount(block, self.square[t], minlength=n), text))
        near = e @ self.space.items.T
        near /= np.maximum(norm, 1e-9)[:, None].astype(np.float32)
        width = len(self.items.ids)
        word, item = self.rare_meetings(t, np.repeat(np.arange(len(sizes)), sizes))
        p, i = np.divmod(np.union1d(np.flatnonzero(near >= self.cosine), block[word] * width + item), width)
        return text[p], first[p], i, near[p, i]

    def check(self, words: list[int], first: int, item: int) -> tuple[float, float, int]:
        """Best (share of the item, share of its answer, first word) around a passage.

        The stretch is walked in windows of one and a half item lengths, so that far words do not add up.
        """
        n = len(self.items.words[item])
        span = n + n // 2 + 2
        step = max(1, n // 4)
        # Rare words may stand at either end of a stretch of one and a quarter item lengths.
        lo, hi = max(0, first - n - 2 * step), min(len(words), first + 2 * STRIDE + n + 2 * step)
        best = (0.0, 0.0, lo)
        times = self.times[item]
        if sum(map(times.__getitem__, times.keys() & set(words[lo:hi]))) < self.share * n:
            return best  # not enough of the item's words are there in any order
        for a in range(lo, max(lo + 1, hi - n // 2), step):
            part = words[a : min(a + span, hi)]
            got = lcs(self.masks[item], n, part) / n
            if got > best[0]:
                answer = self.answers[item]
                best = (got, len(answer.intersection(part)) / len(answer), a)
        return best

    def __call__(self, raws: list[bytes]) -> list[list[dict]]:
        t, sizes = term_numbers(raws, self.items.terms)
        out: list[list[dict]] = [[] for _ in raws]
        if not len(t):
            return out
        text, first, item, near = self.candidates(t, sizes)
        starts = np.cumsum(sizes) - sizes
        order = np.lexsort((first, -near, item, text))
        done: set[tuple[int, int]] = set()
        opened, whole = -1, None
        for k in order.tolist():
            d, i = int(text[k]), int(item[k])
            if (d, i) in done:
                continue
            if d != opened:  # candidates come text by text
                opened, whole = d, t[starts[d] : starts[d] + sizes[d]].tolist() if sizes[d] < 4096 else None
            words = whole
            lo = 0
            if words is None:  # of a long text only the stretch is unpacked
                n = len(self.items.words[i])
                lo = max(0, int(first[k]) - 2 * n - 2)
                words = t[starts[d] + lo : starts[d] + min(int(sizes[d]), int(first[k]) + 2 * STRIDE + 2 * n + 2)].tolist()
            share, answer, a = self.check(words, int(first[k]) - lo, i)
            if share >= self.share and answer >= 0.5:
                done.add((d, i))
                out[d].append({"item_id": self.items.ids[i], "cosine": float(near[k]), "lcs_share": share, "answer_share": answer, "first_word": a + lo})
        return [sorted(h, key=lambda x: x["item_id"]) for h in out]


def item_blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[Items]:
    known = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    n = max(1, -(-known.count() // block))
    for b in range(n):
        # About ``block`` rows whatever their number.
        rows = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        items = read_items(sorted({(r.item_id, r.text) for r in rows}))
        if items.ids:
            yield items


HITS = "array<struct<item_id:bigint,cosine:double,lcs_share:double,answer_share:double,first_word:bigint>>"


def with_hits(docs: DataFrame, benchmark: DataFrame, passed: list[str], name: str, text: str = "text", cosine: float = COSINE, share: float = SHARE) -> DataFrame:
    """Columns ``passed`` and ``name``: the items that a row's text holds, with their figures."""
    spark = docs.sparkSession
    out, carried = docs, [*passed, *([] if text in passed else [text])]
    names: list[str] = []
    for items in item_blocks(benchmark):
        counts, n_docs = document_counts(docs, text, items)
        sent = spark.sparkContext.broadcast((items, fit_space(items, counts, n_docs)))
        own = fresh([*carried, *names], f"{name}{len(names)}")
        out = map_texts(
            out, [*carried, *names], text, f"{own} {HITS}", lambda raws, m: [m(raws)],
            setup=lambda sent=sent: Matcher(*sent.value, cosine, share), chunk_bytes=1 << 20,
        )
        names.append(own)
    return out.select(*passed, (F.concat(*names) if names else F.array().cast(HITS)).alias(name))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and item that it holds."""
    found = with_hits(docs, benchmark, [key], "_hits", text)
    return found.select(key, F.explode("_hits").alias("_h")).select(key, "_h.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns."""
    name = fresh(docs.columns, "_hits")
    return with_hits(docs, benchmark, docs.columns, name, text).filter(F.size(name) == 0).drop(name)
