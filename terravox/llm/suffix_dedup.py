"""Repeated passages by a distributed merge sort of suffixes that never compares a known prefix twice.

A byte of a text is removed if it lies in a string of ``length`` bytes that also starts anywhere else, in
another text or the same one, overlapping or not. Texts are their UTF-8 bytes; nothing crosses texts.

Not every suffix is sorted. Each string of ``length`` bytes has one anchor, the place of its smallest
hash of ``GRAM`` bytes, which depends on its bytes alone: equal strings have theirs at the same offset.
So two equal strings meet if the suffixes at their anchors are compared, and only about one suffix in
seventy is an anchor.

1. Tasks find the anchors; hashes of the ``GRAM`` bytes at anchors are counted, each once per task.
   Anchors whose hash is not repeated can have no equal string and are left out. This is a filter only.
2. Texts and their repeated anchors meet, copies of a text once. Each task sorts the suffixes at its
   anchors (as far as a string can reach) into runs per hash bucket and sends them front-coded: length of
   the prefix shared with the suffix before, and the rest.
3. Each task merges its runs with a loser tree. A node knows the prefix that its loser shares with the
   last suffix that was put out: more shared means smaller, and only ties are compared, from the known
   prefix on. The merge gives the shared prefix of neighbours, and so, for each number of bytes, which
   suffixes agree; the bytes before the anchors are ranked alike from right to left. A string of an
   anchor is repeated if another anchor agrees on both sides.
4. Repeated strings come back to their texts, whose results are joined to the rows.

A hash that occurs in more than ``hot`` anchors is dealt over several tasks; what each has not
found repeated, and one of each that it has, are compared between these by a 128-bit digest. Copies are
folded in each task before anything is sent. Texts are known by 128 bits of hash. What tasks are sent
whole is the list of hot hashes, at most one per ``hot`` anchors and cut to ``HOT_LISTED`` by raising
``hot`` when there are more.

A run that repeats itself after at most ``PERIODS`` bytes (blanks, rules, a short line again and again) would
have an anchor in every period. Its strings are equal to each other: they are removed as a whole, and only
those of the first period keep anchors, by which other texts find them.

Null and empty texts have no bytes, no spans, and the digest of nothing. Repeated rows give repeated
results; a text that occurs twice loses all its bytes if it has ``length`` of them. A null key stays
null. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.session import keep

LENGTH = 200
GRAM = 64
#: Longest period of a run whose strings are settled without anchors of their own.
PERIODS = 32
#: Places of the grid looked at together.
PROBES = 20_000
#: Bytes of text whose anchors are found at once; longer texts are cut with an overlap.
CHUNK = 1 << 21
#: Bytes of text that a task folds copies in before it sends them on.
FOLD = 24 << 20
HOT = 100_000
HOT_LISTED = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_U = np.uint64

ASK = np.dtype([("fp", "<i8"), ("ref", "<i8"), ("pos", "<i4"), ("lo", "u1"), ("hi", "u1"), ("n", "<u2")])
SPAN = np.dtype([("ref", "<i8"), ("a", "<i8"), ("b", "<i8")])
HEAD = np.dtype([("fp", "<i8"), ("ref", "<i8"), ("pos", "<i8"), ("lcp", "<i4"), ("size", "<i4"), ("left", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("salts", "<i4")])

_state: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, and a random number per byte value."""
    if not _state:
        n = CHUNK + LENGTH + 8
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            p = np.full(n, b)
            p[0] = 1
            _state[name] = np.multiply.accumulate(p)
        _state["byte"] = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
    return _state["up"], _state["down"], _state["byte"]


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at each place."""
    up, down, byte = _powers()
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte[buf] * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n + 1 - gram]
    h ^= h >> _U(31)
    h *= _MIX
    h ^= h >> _U(29)
    return h


def sliding_first_min(key: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive keys."""
    n = len(key)
    pad = -n % width
    k = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(k, axis=1).ravel()
    behind = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def periodic_runs(buf: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(period, first byte, byte behind the last) of each run that repeats itself after at most ``PERIODS``
    bytes and is at least ``length`` bytes and one period long.

    Such a run holds a place on any grid of half a ``length``, with as many bytes behind it that agree with
    those one period on. Eight of them are compared for all periods at once, the rest where these agree.
    """
    n, step, most = len(buf), length // 2, min(PERIODS, length // 4)
    found: list[tuple[int, int, int]] = []
    there: set[int] = set()

    def look(x: int, p: int) -> None:
        if p not in there and (buf[x : x + step] == buf[x + p : x + p + step]).all():
            there.add(p)

    for at in range(0, n - step - most, step * PROBES):
        x = np.arange(at, min(at + step * PROBES, n - step - most), step)
        near = buf[x[:, None] + np.arange(most + 8)]
        hit = (near[:, 1:-7] == near[:, :1]) & (near[:, 4:-4] == near[:, 3:4]) & (near[:, 8:] == near[:, 7:8])
        hit[:, [p - 1 for p in there]] = False
        for r, q in zip(*(v.tolist() for v in np.nonzero(hit))):
            look(int(x[r]), q + 1)
    # The last places of the grid, where the longest periods no longer fit.
    for x in range(max(0, -(-(n - step - most) // step)) * step, n - step, step):
        for p in range(1, min(most, n - step - x) + 1):
            look(x, p)
    for p in sorted(there):
        same = buf[p:] == buf[:-p]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        found += [(p, a, b + p) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= length]
    return found


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, smallest and largest distance from a string's start to it, hash) of all anchors.

    Of a periodic run only the strings of its first period have anchors of their own: the others are
    equal to these, so what equals them is found there, and they themselves are known to be repeated.
    """
    out = []
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        buf = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        h = gram_hashes(buf, gram)
        key = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        first = (sliding_first_min(key, length - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
        sizes = np.array([len(p) for _, _, p in group])
        begin = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(len(group)), sizes)[: len(first)]
        open_ = np.arange(len(first)) + length <= (begin + sizes)[part]
        for o, (_, _, t) in zip(begin.tolist(), group):
            for period, x, y in periodic_runs(np.frombuffer(t, np.uint8), length):
                open_[o + x + period : o + y - length + 1] = False
        p = np.flatnonzero(open_)
        a, part = first[p], part[p]
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])]))
        last = np.append(head[1:], len(p)) - 1
        where, part = a[head], part[head]
        text = np.array([t for t, _, _ in group])[part]
        shift = np.array([o for _, o, _ in group])[part] - begin[part]
        out.append((text, where + shift, where - p[last], where - p[head], h[where].view(np.int64)))

    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - length + 1), CHUNK):
            piece = t[o : o + CHUNK + length - 1]
            if len(piece) < length:
                continue
            if group and size + len(piece) > CHUNK + length:
                flush()
                group, size = [], 0
            group.append((i, o, piece))
            size += len(piece)
    if group:
        flush()
    if not out:
        z = np.empty(0, np.int64)
        return z, z, z, z, z
    return tuple(np.concatenate(c) for c in zip(*out))


# ---- packed rows between stages ------------------------------------------------------------------


def _pack_texts(texts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(texts))


def _unpack_texts(data: bytes, sizes: np.ndarray) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=int(sizes.sum()) or 1) if len(sizes) else b""
    ends = np.cumsum(sizes).tolist()
    return [raw[e - s : e] for e, s in zip(ends, sizes.tolist())]


def _groups(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


ROW = "bucket int, kind int, meta binary, data binary"


def _row(bucket: int, kind: int, meta: bytes, data: bytes = b"") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([meta], pa.binary()), pa.array([data], pa.binary())],
        names=["bucket", "kind", "meta", "data"],
    )


TEXT = np.dtype([("ref", "<i8"), ("check", "<i8"), ("n", "<i8"), ("size", "<i8")])


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Distinct texts of about ``FOLD`` bytes at a time, with how often each came."""
    held: dict[tuple[int, int], list] = {}
    size = 0
    for b in batches:
        refs, checks, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
        for i, key in enumerate(zip(refs, checks)):
            if key in held:
                held[key][0] += 1
                continue
            t = texts[i].as_py()
            held[key] = [1, t]
            size += len(t)
            if size >= FOLD:
                yield _meta(held), [t for _, t in held.values()]
                held, size = {}, 0
    if held:
        yield _meta(held), [t for _, t in held.values()]


def _meta(held: dict) -> np.ndarray:
    return np.array([(r, c, n, len(t)) for (r, c), (n, t) in held.items()], TEXT)


def _bucket_of(x: np.ndarray, n: int) -> np.ndarray:
    return ((x.view(np.uint64) * _MIX) >> _U(33)).astype(np.int64) % n


# ---- stage 1: anchors and their counts -----------------------------------------------------------


def asks(batches: Iterator[pa.RecordBatch], n_buckets: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Kind 0, by hash: one anchor of each hash with its count here. Kind 1, by text: known to be repeated."""
    for meta, texts in folded(batches):
        text, pos, lo, hi, fp = anchors(texts, length, gram)
        rec = np.empty(len(text), ASK)
        rec["fp"], rec["ref"], rec["pos"], rec["lo"], rec["hi"] = fp, meta["ref"][text], pos, lo, hi
        _, first, at, count = np.unique(fp, return_index=True, return_inverse=True, return_counts=True)
        rec["n"] = np.minimum(count[at] if len(at) else at, 60_000)
        one = rec[first]
        for b, rows in _groups(_bucket_of(one["fp"], n_buckets), n_buckets):
            yield _row(b, 0, one[rows].tobytes())
        rest = np.ones(len(rec), bool)
        rest[first] = False
        rest = rec[rest]
        for b, rows in _groups(_bucket_of(rest["ref"], n_buckets), n_buckets):
            yield _row(b, 1, rest[rows].tobytes())


def repeated(batches: Iterator[pa.RecordBatch], n_buckets: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Kind 0, by text: anchors whose hash is repeated. Kind 2: a hash of more than ``hot`` anchors."""
    asked = []
    for b in batches:
        for kind, bucket, data in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(2).to_pylist()):
            if kind == 1:
                yield _row(bucket, 0, data)
            else:
                asked.append(np.frombuffer(data, ASK))
    if not asked:
        return
    rec = np.concatenate(asked)
    _, at = np.unique(rec["fp"], return_inverse=True)
    total = np.bincount(at, weights=rec["n"])[at]
    found = rec[total >= 2]
    for b, rows in _groups(_bucket_of(found["ref"], n_buckets), n_buckets):
        yield _row(b, 0, found[rows].tobytes())
    heavy = np.unique(np.stack([rec["fp"][total > hot], total[total > hot].astype(np.int64)], axis=1), axis=0)
    if len(heavy):
        yield _row(0, 2, np.ascontiguousarray(heavy).tobytes())


def send_texts(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Kind 1: folded texts by text bucket."""
    for meta, texts in folded(batches):
        for b, rows in _groups(_bucket_of(meta["ref"], n_buckets), n_buckets):
            own = [texts[i] for i in rows.tolist()]
            yield _row(b, 1, meta[rows].tobytes(), _pack_texts(own))


def gather(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Records of kind 0 sorted by text, then distinct texts with summed counts."""
    records, held = [], {}
    for b in batches:
        for kind, meta, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            if kind == 0:
                records.append(np.frombuffer(meta, dtype))
            else:
                m = np.frombuffer(meta, TEXT)
                for (ref, check, n, _), t in zip(m.tolist(), _unpack_texts(data, m["size"])):
                    if (ref, check) in held:
                        held[ref, check][0] += n
                    else:
                        held[ref, check] = [n, t]
    rec = np.concatenate(records) if records else np.empty(0, dtype)
    return rec[np.argsort(rec["ref"], kind="stable")], _meta(held) if held else np.empty(0, TEXT), [t for _, t in held.values()]


# ---- stage 2: front-coded runs of sorted suffixes ------------------------------------------------


def shared_prefix(rows: list[bytes]) -> np.ndarray:
    """Length of the prefix that each row shares with the row before it."""
    n = len(rows)
    out = np.zeros(n, np.int32)
    size = np.fromiter(map(len, rows), np.int64, n)
    width = int(size.max()) if n else 0
    if width == 0:
        return out
    for i in range(0, n - 1, 16384):
        part = rows[i : i + 16385]
        m = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in part), np.uint8).reshape(len(part), width)
        same = m[1:] == m[:-1]
        stop = np.where(same.all(1), width, same.argmin(1))
        out[i + 1 : i + len(part)] = np.minimum(stop, np.minimum(size[i : i + len(part) - 1], size[i + 1 : i + len(part)]))
    return out


def runs(batches: Iterator[pa.RecordBatch], n_buckets: int, length: int, heavy: dict[int, int], hot: int) -> Iterator[pa.RecordBatch]:
    """Kind 3: a run of sorted suffixes by hash bucket. Kind 0: strings of texts that have copies."""
    rec, meta, texts = gather(batches, ASK)
    begin = np.searchsorted(rec["ref"], meta["ref"], "left").tolist()
    end = np.searchsorted(rec["ref"], meta["ref"], "right").tolist()
    heads, rights, lefts, spans = [], [], [], []
    for (ref, _, n, size), a, b, t in zip(meta.tolist(), begin, end, texts):
        if n > 1 and size >= length:
            spans.append((ref, 0, size - length + 1))
        elif size > length:
            spans += [(ref, x, y - length + 1) for _, x, y in periodic_runs(np.frombuffer(t, np.uint8), length)]
        for fp, _, pos, lo, hi, _ in rec[a:b].tolist():
            if pos - hi < 0 or pos - lo + length > size:
                continue
            salts = -(-heavy[fp] // hot) if fp in heavy else 1
            heads.append((fp, ref, pos, 0, length - lo, hi, lo, hi, salts))
            rights.append(t[pos : pos + length - lo])
            lefts.append(t[pos - hi : pos])
    for b, rows in _groups(_bucket_of(np.array([s[0] for s in spans], np.int64), n_buckets), n_buckets) if spans else ():
        yield _row(b, 0, np.array([spans[i] for i in rows.tolist()], SPAN).tobytes())
    if not heads:
        return
    head = np.array(heads, HEAD)
    # A hot hash is dealt out by text; the salt moves it to another bucket.
    salt = np.where(head["salts"] > 1, _bucket_of(head["ref"] ^ 0x5DEECE66D, 1 << 30) % head["salts"], 0)
    bucket = _bucket_of(head["fp"] + salt * 0x632BE59BD9B4E019, n_buckets)
    for b, rows in _groups(bucket, n_buckets):
        rows = sorted(rows.tolist(), key=rights.__getitem__)
        own = [rights[i] for i in rows]
        h = head[rows]
        h["lcp"] = shared_prefix(own)
        rest = b"".join(r[k:] for r, k in zip(own, h["lcp"].tolist()))
        data = zstandard.ZstdCompressor(level=1).compress(rest + b"".join(lefts[i] for i in rows))
        yield _row(b, 3, h.tobytes(), data)


# ---- stage 3: merging ----------------------------------------------------------------------------


class Run:
    """A front-coded run, read from its start."""

    __slots__ = ("head", "lcp", "size", "cut", "data", "at", "text", "i")

    def __init__(self, meta: bytes, data: bytes):
        self.head = np.frombuffer(meta, HEAD)
        self.lcp, self.size = self.head["lcp"].tolist(), self.head["size"].tolist()
        total = int((self.head["size"] - self.head["lcp"]).sum() + self.head["left"].sum())
        self.data = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, total))
        self.at, self.text, self.i = 0, b"", -1

    def lefts(self) -> list[bytes]:
        at = int((self.head["size"] - self.head["lcp"]).sum())
        out = []
        for n in self.head["left"].tolist():
            out.append(self.data[at : at + n])
            at += n
        return out

    def step(self) -> bool:
        self.i += 1
        if self.i >= len(self.lcp):
            return False
        k, n = self.lcp[self.i], self.size[self.i]
        self.text = self.text[:k] + self.data[self.at : self.at + n - k]
        self.at += n - k
        return True


def mismatch(a: bytes, b: bytes, k: int) -> int:
    """Length of the common prefix of two strings that are known to share ``k`` bytes."""
    n = min(len(a), len(b))
    step = 8
    while k < n:
        if a[k : k + step] == b[k : k + step]:
            k = min(n, k + step)
            step *= 2
        elif step == 1:
            return k
        else:
            step = max(1, step // 4) if step > 8 else step // 2
    return n


def merge(sources: list[Run]) -> tuple[list[tuple[int, int]], list[int], list[bytes]]:
    """Loser tree over runs: ((run, row), prefix shared with the suffix before, suffix) in order.

    ``known[r]`` is the prefix that the front of run r shares with the suffix put out last.
    """
    n = 1
    while n < len(sources):
        n *= 2
    known = [0] * n
    alive = [False] * n
    for r, s in enumerate(sources):
        alive[r] = s.step()

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one it shares with the winner."""
        if not alive[b]:
            return a, b
        if not alive[a]:
            return b, a
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        x, y = sources[a].text, sources[b].text
        k = mismatch(x, y, ka)
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    losers = [0] * n
    level = list(range(n))
    width = n
    while width > 1:
        width //= 2
        nxt = []
        for i in range(width):
            w, l = play(level[2 * i], level[2 * i + 1])
            losers[width + i] = l
            nxt.append(w)
        level = nxt
    top = level[0]
    order, shared, out = [], [], []
    while alive[top]:
        s = sources[top]
        order.append((top, s.i))
        shared.append(known[top])
        out.append(s.text)
        alive[top] = s.step()
        known[top] = s.lcp[s.i] if alive[top] else 0
        node = (top + n) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2
    return order, shared, out


def decide(head: np.ndarray, shared: np.ndarray, lefts: list[bytes], length: int, gram: int) -> np.ndarray:
    """For each anchor and distance d, whether the string that starts d bytes before it is repeated.

    ``shared``: prefix shared with the row before, in order of the suffixes.
    """
    n = len(head)
    width = length - gram + 1
    flags = np.zeros((n, width), bool)
    back = [t[::-1] for t in lefts]
    group = np.cumsum(np.asarray(shared) < gram)
    group_list = group.tolist()
    by_left = sorted(range(n), key=lambda i: (group_list[i], back[i]))
    left_shared = shared_prefix([back[i] for i in by_left])
    by_left = np.array(by_left)
    left_shared[np.append(True, group[by_left][1:] != group[by_left][:-1])] = -1
    left_class = np.empty(n, np.int64)
    for d in range(width):
        active = (head["lo"] <= d) & (d <= head["hi"])
        if active.sum() < 2:
            continue
        left_class[by_left] = np.cumsum(left_shared < d)
        right_class = np.cumsum(shared < length - d)
        key = (right_class * np.int64(n + 1) + left_class)[active]
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        flags[active, d] = count[at] > 1
    return flags


def spans_of(head: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Runs of repeated string starts: (text, first start, end)."""
    padded = np.zeros((len(head), flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    change = np.diff(padded, axis=1)
    row, up = np.nonzero(change == 1)
    _, down = np.nonzero(change == -1)
    out = np.empty(len(row), SPAN)
    out["ref"] = head["ref"][row]
    # Distance d in [up, down) is the start pos - d.
    out["a"], out["b"] = head["pos"][row] - down + 1, head["pos"][row] - up + 1
    return out


def merged(batches: Iterator[pa.RecordBatch], n_buckets: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: spans by text. Kind 4: strings of hot hashes to be compared between tasks."""
    held: dict[int, list[Run]] = {}
    for b in batches:
        for bucket, kind, meta, data in zip(*(b.column(i).to_pylist() for i in range(4))):
            if kind == 0:
                yield _row(bucket, 0, meta)
            else:
                held.setdefault(bucket, []).append(Run(meta, data))
    for bucket, sources in sorted(held.items()):
        order, shared, texts = merge(sources)
        head = np.concatenate([s.head for s in sources])
        first = np.cumsum([0, *(len(s.head) for s in sources)])
        left_of = [s.lefts() for s in sources]
        head = head[[int(first[r]) + i for r, i in order]]
        lefts = [left_of[r][i] for r, i in order]
        flags = decide(head, np.array(shared), lefts, length, gram)
        spans = spans_of(head, flags)
        for b, rows in _groups(_bucket_of(spans["ref"], n_buckets), n_buckets):
            yield _row(b, 0, spans[rows].tobytes())
        yield from open_strings(bucket, head, flags, lefts, texts, n_buckets, length)


OPEN = np.dtype([("d1", "<i8"), ("d2", "<i8"), ("ref", "<i8"), ("p", "<i8"), ("done", "<i8")])


def open_strings(bucket: int, head: np.ndarray, flags: np.ndarray, lefts: list[bytes], texts: list[bytes], n_buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    out, seen = [], set()
    for i in np.flatnonzero(head["salts"] > 1).tolist():
        lo, hi, pos, ref = (int(head[c][i]) for c in ("lo", "hi", "pos", "ref"))
        whole = lefts[i] + texts[i]
        for d in range(lo, hi + 1):
            digest = hashlib.blake2b(whole[hi - d : hi - d + length], digest_size=16).digest()
            done = bool(flags[i, d])
            if done and digest in seen:
                continue
            if done:
                seen.add(digest)
            out.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), ref, pos - d, int(done)))
    if out:
        rec = np.array(out, OPEN)
        for b, rows in _groups(_bucket_of(rec["d1"], n_buckets), n_buckets):
            yield _row(b, 4, rec[rows].tobytes())


def closed(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Strings of hot hashes that several tasks have: spans by text."""
    parts = [np.frombuffer(m, OPEN) for b in batches for m in b.column(2).to_pylist()]
    if not parts:
        return
    rec = np.concatenate(parts)
    _, at, count = np.unique(np.stack([rec["d1"], rec["d2"]], axis=1), axis=0, return_inverse=True, return_counts=True)
    rec = rec[(count[at.ravel()] > 1) & (rec["done"] == 0)]
    spans = np.empty(len(rec), SPAN)
    spans["ref"], spans["a"], spans["b"] = rec["ref"], rec["p"], rec["p"] + 1
    for b, rows in _groups(_bucket_of(spans["ref"], n_buckets), n_buckets):
        yield _row(b, 0, spans[rows].tobytes())


# ---- stage 4: results ----------------------------------------------------------------------------


def removed_spans(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by strings that start in the half-open ranges."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        b += length - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def results(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    rec, meta, texts = gather(batches, SPAN)
    begin = np.searchsorted(rec["ref"], meta["ref"], "left").tolist()
    end = np.searchsorted(rec["ref"], meta["ref"], "right").tolist()
    cols: list[list] = [[], [], [], [], [], [], []]
    for (ref, check, _, size), a, b, t in zip(meta.tolist(), begin, end, texts):
        spans = removed_spans(list(zip(rec["a"][a:b].tolist(), rec["b"][a:b].tolist())), length) if b > a else []
        spans = [(x, min(y, size)) for x, y in spans if x < size]
        digest, at = hashlib.sha256(), 0
        for x, y in spans:
            digest.update(t[at:x])
            at = y
        digest.update(t[at:])
        for c, v in zip(cols, (ref, check, size, sum(y - x for x, y in spans), len(spans), digest.hexdigest(), [{"start": x, "stop": y} for x, y in spans])):
            c.append(v)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    types = [pa.int64()] * 5 + [pa.string(), span]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["ref", "check", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_passages(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per row of ``df``: key, n_bytes, n_removed, n_spans, kept_sha256 and the removed ``spans``."""
    if not 0 < gram < length <= 255:
        raise ValueError("a string is longer than a gram and shorter than 256 bytes")
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    ref, check = F.xxhash64(raw).alias("ref"), F.xxhash64(F.lit(1), raw).alias("check")
    docs = df.select(ref, check, raw.alias("t"))

    def by_bucket(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "bucket").sortWithinPartitions("kind")

    asked = docs.mapInArrow(lambda b: asks(b, n, length, gram), ROW)
    while True:
        found = keep(by_bucket(asked).mapInArrow(lambda b, hot=hot: repeated(b, n, hot), ROW), "suffix-anchors")
        listed = found.filter("kind = 2")
        n_heavy = listed.select(F.sum(F.octet_length("meta") / 16)).first()[0] or 0
        if n_heavy <= HOT_LISTED:
            break
        hot *= 4  # fewer hashes are hot, and their parts are larger; the list stays small
    heavy: dict[int, int] = {}
    for r in listed.select("meta").collect():
        heavy.update({a: b for a, b in np.frombuffer(r.meta, np.int64).reshape(-1, 2).tolist()})
    sent = spark.sparkContext.broadcast(heavy)
    texts = docs.mapInArrow(lambda b: send_texts(b, n), ROW)
    met = by_bucket(found.filter("kind = 0").unionByName(texts))
    sorted_runs = met.mapInArrow(lambda b: runs(b, n, length, sent.value, hot), ROW)
    spans = keep(by_bucket(sorted_runs).mapInArrow(lambda b: merged(b, n, length, gram), ROW), "suffix-spans")
    every = spans.filter("kind = 0")
    if heavy:
        every = every.unionByName(by_bucket(spans.filter("kind = 4")).mapInArrow(lambda b: closed(b, n), ROW))
    out = by_bucket(every.unionByName(texts)).mapInArrow(
        lambda b: results(b, length),
        "ref bigint, check bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>",
    )
    rows = df.select(F.col(key).alias("_key"), ref, check)
    return rows.join(out, ["ref", "check"]).select(F.col("_key").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
