"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A vocabulary file gives pieces with log scores. The text gets one blank in front, blanks stand for the
piece marker U+2581, and the cut with the largest sum of scores is taken; of equal sums the one whose
last piece starts first. A character that no piece covers costs the smallest score less ten and is
written as its UTF-8 bytes. A marker that is itself in the text is written as bytes, so that decoding
gives every text back exactly. Decoding joins the pieces, turns markers into blanks and bytes into
characters, and drops the blank in front.

As no piece holds a blank behind another character, a text is cut before each blank that follows a
non-blank, and each such segment has its own best cut. A task remembers the segments that it has seen;
new ones are encoded together as arrays, one position of all segments at a time.

Null and empty texts have no pieces and decode to an empty text. Repeated rows give repeated results.
Other columns of the input are not read. Texts are handled whole; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terravox.llm.common import map_texts

#: Default vocabulary; every function takes another path.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: Segments a task remembers before it starts afresh.
REMEMBERED = 100_000
#: Segments encoded at once, which bounds the arrays of their lattices.
TOGETHER = 12_000
#: Segments longer than this are cut by a plain loop, shorter ones together as arrays.
LONG = 192
#: Places that the builder of the double array tries together.
WINDOW = 512
_SEGMENT = re.compile(rb" +[^ ]*")
MARKER = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Double array (``base``, ``check``, ``piece`` at a node), scores, and the bytes of each piece."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    text: np.ndarray  # bytes of all pieces end to end
    start: np.ndarray  # where the bytes of a piece start; one more for the end
    byte_ids: np.ndarray  # piece of each of the 256 bytes, -1 if there is none
    unknown: int
    unknown_score: float
    longest: int
    apart: bool  # no piece holds a blank behind another character


def double_array(words: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trie of (bytes, number) with distinct bytes: child of node s by byte c is t = base[s] + c + 1, check[t] = s."""
    words = sorted(words)
    size = 1 << 12
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    free_from = 1
    todo = [(0, 0, len(words), 0)]
    while todo:
        node, lo, hi, depth = todo.pop()
        if lo < hi and len(words[lo][0]) == depth:
            piece[node] = words[lo][1]
            lo += 1
        if lo >= hi:
            continue
        kids, at = [], lo
        while at < hi:
            c = words[at][0][depth]
            end = at
            while end < hi and words[end][0][depth] == c:
                end += 1
            kids.append((c, at, end))
            at = end
        codes = np.array([k[0] + 1 for k in kids])
        b = -1
        look = free_from
        while b < 0:
            while look + WINDOW + 258 >= len(check):
                grow = len(check)
                base = np.concatenate([base, np.zeros(grow, np.int32)])
                check = np.concatenate([check, np.full(grow, -1, np.int32)])
                piece = np.concatenate([piece, np.full(grow, -1, np.int32)])
            # Places where the first child would be free, tried together.
            tries = np.flatnonzero(check[look : look + WINDOW] < 0) + look - codes[0]
            tries = tries[tries >= 0]
            fits = (check[tries[:, None] + codes[None, :]] < 0).all(1)
            if fits.any():
                b = int(tries[fits.argmax()])
            look += WINDOW
        base[node] = b
        check[b + codes] = node
        while check[free_from] >= 0:
            free_from += 1
        # Ground where several children no longer find room is left behind.
        if len(kids) > 1 and b - free_from > 8 * WINDOW:
            free_from = b - 8 * WINDOW
        todo += [(b + c + 1, x, y, depth + 1) for c, x, y in reversed(kids)]
    return base, check, piece


def build(pieces: list[tuple[bytes, float, str]], unknown: int) -> Vocabulary:
    """``pieces``: (UTF-8 with the marker, score, kind: normal, byte or other)."""
    marker = MARKER.encode()
    words, raw = {}, []
    byte_ids = np.full(256, -1, np.int32)
    for i, (p, _, kind) in enumerate(pieces):
        if kind == "byte":
            value = int(p[1:-1], 16)
            byte_ids[value] = i
            raw.append(bytes([value]))
        elif kind == "normal":
            text = p.replace(marker, b" ")
            words.setdefault(text, i)
            raw.append(text)
        else:
            raw.append(b"")
    base, check, piece = double_array(list(words.items()))
    normal = [s for _, s, kind in pieces if kind == "normal"]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return Vocabulary(
        base, check, piece, np.array([s for _, s, _ in pieces]), np.frombuffer(b"".join(raw), np.uint8), starts, byte_ids, unknown,
        min(normal, default=0.0) - UNKNOWN_PENALTY, max(map(len, words), default=0), not any(b" " in w.lstrip(b" ") for w in words),
    )


def load(path: str = VOCABULARY) -> Vocabulary:
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    kinds = ["byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal" for i in range(len(sp))]
    return build([(sp.id_to_piece(i).encode(), sp.get_score(i), kinds[i]) for i in range(len(sp))], sp.unk_id())


# ---- Viterbi over segments ---------------------------------------------------------------------


def edges(v: Vocabulary, buf: np.ndarray, seg_end: np.ndarray, seg_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pieces in the segments: (start, end, piece, score), unknown characters as piece -1.

    ``seg_start`` and ``seg_end`` give, for each byte, the bounds of its segment.
    """
    n = len(buf)
    first = ((buf & 0xC0) != 0x80) | (seg_start == np.arange(n))
    at = np.flatnonzero(first)
    next_char = np.append(at[1:], n)
    next_char = np.minimum(next_char, seg_end[at])
    single = np.zeros(n, bool)
    char_end = np.zeros(n, np.int64)
    char_end[at] = next_char
    found_s, found_e, found_p = [], [], []
    here, node = at, np.zeros(len(at), np.int64)
    for depth in range(v.longest):
        ok = here + depth < seg_end[here]
        here, node = here[ok], node[ok]
        if not len(here):
            break
        child = v.base[node] + buf[here + depth].astype(np.int64) + 1
        ok = child < len(v.check)
        here, node, child = here[ok], node[ok], child[ok]
        ok = v.check[child] == node
        here, node = here[ok], child[ok]
        p = v.piece[node]
        hit = p >= 0
        s = here[hit]
        found_s.append(s)
        found_e.append(s + depth + 1)
        found_p.append(p[hit])
        single[s[s + depth + 1 == char_end[s]]] = True
    bare = at[~single[at]]
    s = np.concatenate([*found_s, bare]) if found_s else bare
    e = np.concatenate([*found_e, char_end[bare]]) if found_e else char_end[bare]
    p = np.concatenate([*found_p, np.full(len(bare), -1, np.int32)]) if found_p else np.full(len(bare), -1, np.int32)
    score = np.where(p >= 0, v.score[p], v.unknown_score)
    return s, e, p, score


def best_cuts(v: Vocabulary, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece numbers of all segments end to end, how many each has, how many of them are bytes)."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    stop = np.cumsum(sizes)
    begin = stop - sizes
    buf = np.frombuffer(b"".join(segments), np.uint8)
    seg_of = np.repeat(np.arange(len(segments)), sizes)
    s, e, p, score = edges(v, buf, stop[seg_of], begin[seg_of])
    # Node i of the lattice is the gap before byte i of its segment; segments are set one apart.
    gap = seg_of[s] if len(s) else np.empty(0, np.int64)
    s, e = s + gap, e + gap
    n = len(buf) + len(segments)
    total = np.full(n, -np.inf)
    total[begin + np.arange(len(segments))] = 0.0
    from_, by = np.zeros(n, np.int64), np.full(n, -2, np.int32)
    is_long = sizes[gap] > LONG if len(gap) else np.empty(0, bool)
    step = e - (begin + np.arange(len(segments)))[gap] if len(gap) else np.empty(0, np.int64)
    short = np.flatnonzero(~is_long)
    short = short[np.lexsort((s[short], e[short], step[short]))]
    cuts = np.searchsorted(step[short], np.arange(LONG + 2))
    for k in range(1, LONG + 1):
        own = short[cuts[k] : cuts[k + 1]]
        if not len(own):
            continue
        ends = e[own]
        heads = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
        gain = total[s[own]] + score[own]
        top = np.maximum.reduceat(gain, heads)
        count = np.diff(np.append(heads, len(own)))
        pick = np.minimum.reduceat(np.where(gain == np.repeat(top, count), np.arange(len(own)), len(own)), heads)
        node = ends[heads]
        total[node], from_[node], by[node] = top, s[own][pick], p[own][pick]
    long = np.flatnonzero(is_long)
    if len(long):
        long = long[np.lexsort((s[long], e[long]))]
        for a, b, q, w in zip(s[long].tolist(), e[long].tolist(), p[long].tolist(), score[long].tolist()):
            g = total[a] + w
            if g > total[b]:
                total[b], from_[b], by[b] = g, a, q
    # Back from the ends, all segments at once.
    home = begin + np.arange(len(segments))
    at = stop + np.arange(len(segments))
    seg = np.flatnonzero(at > home)
    rows, steps, pieces, spans = [], [], [], []
    k = 0
    while len(seg):
        node = at[seg]
        rows.append(seg)
        steps.append(np.full(len(seg), k))
        pieces.append(by[node])
        spans.append(np.stack([from_[node] - seg, node - seg]))
        at[seg] = from_[node]
        seg = seg[at[seg] > home[seg]]
        k += 1
    if not rows:
        return np.empty(0, np.int32), np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
    row, back, piece, span = np.concatenate(rows), np.concatenate(steps), np.concatenate(pieces), np.concatenate(spans, axis=1)
    order = np.lexsort((-back, row))
    row, piece, span = row[order], piece[order], span[:, order]
    # Unknown characters become their bytes, or the unknown piece where the vocabulary has no bytes.
    width = np.where((piece < 0) & (v.byte_ids.min() >= 0), span[1] - span[0], 1)
    out = np.repeat(np.where(piece >= 0, piece, v.unknown), width)
    bare = np.repeat(piece < 0, width)
    if v.byte_ids.min() >= 0 and bare.any():
        place = np.repeat(span[0], width) + np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width)
        out[bare] = v.byte_ids[buf[place[bare]]]
    n_row = np.bincount(row, weights=width, minlength=len(segments)).astype(np.int64)
    n_bare = np.bincount(np.repeat(row, width)[bare], minlength=len(segments))
    return out.astype(np.int32), n_row, n_bare


class Encoder:
    """Segments met so far, each with its pieces; grows to ``REMEMBERED`` and starts afresh."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.used = 0
        self.at = np.empty(1 << 12, np.int64)
        self.count = np.empty(1 << 12, np.int64)
        self.bare = np.empty(1 << 12, np.int64)

    def _segments(self, raw: bytes) -> list[bytes]:
        """Segments of a text without the blank in front of each."""
        if not raw:
            return []
        if not self.v.apart:
            return [raw]
        if b"  " in raw or raw[:1] == b" " or raw[-1:] == b" ":
            return [m[1:] for m in _SEGMENT.findall(b" " + raw)]
        return raw.split(b" ")

    def _learn(self, fresh: list[bytes]) -> None:
        flat, count, bare = best_cuts(self.v, [b" " + f for f in fresh])
        n, m = len(self.seen), len(fresh)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat), np.int32)])
        while n + m > len(self.at):
            self.at, self.count, self.bare = (np.concatenate([x, np.empty(len(x), np.int64)]) for x in (self.at, self.count, self.bare))
        self.flat[self.used : self.used + len(flat)] = flat
        self.at[n : n + m] = self.used + np.cumsum(count) - count
        self.count[n : n + m], self.bare[n : n + m] = count, bare
        self.seen.update(zip(fresh, range(n, n + m)))
        self.used += len(flat)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces of all texts end to end, how many each text has, how many of them are bytes)."""
        if len(self.seen) > REMEMBERED or self.used > 16 * REMEMBERED:
            self._clear()
        parts = [self._segments(t) for t in texts]
        fresh = list(dict.fromkeys(w for ws in parts for w in ws if w not in self.seen))
        for i in range(0, len(fresh), TOGETHER):
            self._learn(fresh[i : i + TOGETHER])
        look = self.seen
        number = np.array([look[w] for ws in parts for w in ws], np.int64)
        text_of = np.repeat(np.arange(len(texts)), [len(ws) for ws in parts])
        count = self.count[number]
        ends = np.cumsum(count)
        flat = self.flat[np.repeat(self.at[number] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        per_text = np.bincount(text_of, weights=count, minlength=len(texts)).astype(np.int64)
        bare = np.bincount(text_of, weights=self.bare[number], minlength=len(texts)).astype(np.int64)
        return flat, per_text, bare


def decode(v: Vocabulary, flat: np.ndarray, per_text: np.ndarray) -> list[bytes]:
    """UTF-8 of each text from its pieces."""
    size = v.start[flat + 1] - v.start[flat]
    ends = np.cumsum(size)
    out = v.text[np.repeat(v.start[flat] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
    stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
    return [out[a + 1 : b] if b > a else b"" for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]


_ENCODERS: dict[str, Encoder] = {}


def _digest(v: Vocabulary) -> str:
    return hashlib.sha256(b"".join(x.tobytes() for x in (v.base, v.check, v.piece, v.score, v.text, v.byte_ids))).hexdigest()


def encode_texts(spark: SparkSession, df: DataFrame, passed: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``passed``, ``ids`` (array of piece numbers), ``n_pieces``, ``n_bytes`` (byte pieces), ``round_trip``.

    ``round_trip`` says whether decoding the pieces gives the text back byte for byte.
    """
    sent = spark.sparkContext.broadcast(load(path))
    digest = _digest(sent.value)

    def setup() -> Encoder:
        # A worker process that runs several tasks keeps what it has learnt.
        if digest not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[digest] = Encoder(sent.value)
        return _ENCODERS[digest]

    def run(raws: list[bytes], enc: Encoder):
        flat, per_text, bare = enc.encode(raws)
        back = decode(enc.v, flat, per_text)
        offsets = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)
        return [
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            pa.array(per_text),
            pa.array(bare),
            pa.array([a == b for a, b in zip(raws, back)]),
        ]

    return map_texts(df, passed, text, "ids array<int>, n_pieces bigint, n_bytes bigint, round_trip boolean", run, setup=setup, chunk_bytes=2 << 20)


def decode_ids(spark: SparkSession, df: DataFrame, passed: list[str], ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``passed`` and ``text`` decoded from the array column ``ids``; a null array gives an empty text."""
    from collections.abc import Iterator

    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    sent = spark.sparkContext.broadcast(load(path))
    kept = df.select(*passed)
    schema = StructType([*kept.schema.fields, StructField("text", StringType())])
    arrow, n = to_arrow_schema(schema), len(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(n)
            flat = np.asarray(lists.flatten(), np.int64)
            sizes = np.diff(np.asarray(lists.offsets, np.int64))
            texts = [t.decode("utf-8", "replace") for t in decode(sent.value, flat, sizes)]
            yield pa.RecordBatch.from_arrays([*[b.column(i).cast(arrow.field(i).type) for i in range(n)], pa.array(texts, pa.string())], schema=arrow)

    whole = F.coalesce(F.col(ids), F.array().cast("array<int>"))
    return df.select(*passed, whole.alias("_ids")).mapInArrow(run, schema)
