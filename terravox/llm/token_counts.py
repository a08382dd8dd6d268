"""Exact token counts of every prefix of a text, under byte-level pair merging.

A cut into tokens is what the merges leave exactly if no merge crosses a border: then both sides grow
alone, and whether one crosses shows on the two neighbours. So the last token of each prefix is the
one token that ends there and stands after the last token of the prefix before it, and the count is that
prefix's count plus one. This programme runs over the bytes of each piece of the splitting pattern;
pieces are remembered, as most of them occur again.

Prefixes of a text are cut by the pattern as texts of their own. Three places differ from the cut of the
whole text, and the table holds what the prefix has: white space that a later word would take as its
start, an elision cut in its middle, and a special token cut in its middle.

With the counts of all prefixes at hand, questions about truncation and budgets are look-ups:
``tokens_at`` and ``longest_within`` answer them from the written table. Null and empty texts have no
tokens and an empty table. Texts are cut by code points; rows are neither joined nor grouped while
counting, so repeated rows, ties and null keys keep their rows. Other columns are carried along.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravox.llm.common import fresh, map_texts

#: Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Elisions of the pattern whose prefixes are cut otherwise.
ELISIONS = ("'re", "'ve", "'ll")
LIMIT = 1024
#: Pieces remembered by a worker, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64
NEVER = float("inf")
#: Prefixes in one row of a written table.
SLICE = 1 << 16
#: Text handed to the counter at once; its table takes four bytes a character.
CHUNK = 1 << 20


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str | None = None) -> str:
    """The vocabulary file, read on the driver and sent to the tasks."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return f.read()


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file, and its byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + n): b for n, b in enumerate(hidden)}


class Counter:
    """Counts at every prefix of a piece, and of a text."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = not (spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
            raise ValueError("only plain byte-level pair merging is counted here")
        name = byte_names()
        spelt = {t: bytes(name[c] for c in t) for t in model["vocab"] if all(c in name for c in t)}
        self.id = {b: model["vocab"][t] for t, b in spelt.items()}
        self.bytes_of = {n: b for b, n in self.id.items()}
        # What two tokens merge into and when; for each token, when and of what it was made.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (self.id[spelt[x]] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            made = self.id[self.bytes_of[a] + self.bytes_of[b]]
            self.merge[a, b] = (rank, made)
            if made in self.parts or any(rank < self.parts[x][0] for x in (a, b) if x in self.parts):
                raise ValueError("each token has to be made by one merge, after the merges of its parts")
            self.parts[made] = (rank, a, b)
        self.right_edge = {t: self.spine(t, 1) for t in self.bytes_of}
        self.left_edge = {t: self.spine(t, 0) for t in self.bytes_of}
        self.trie: dict = {}
        for b, n in self.id.items():
            node = self.trie
            for byte in b:
                node = node.setdefault(byte, {})
            node[-1] = n
        self.stands: dict[int, dict[int, bool]] = {}
        self.known: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN)
        self.blank_run = regex.compile(r"(?<!\s)\s{2,}+(?=\S)")
        added = [t for t in spec.get("added_tokens", []) if t["content"]]
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError("added tokens that take their surroundings are not counted here")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.assigned: set[str] = set()

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that were at one edge of ``token`` as it grew, each with the rank that ended it."""
        out, rank = [(token, NEVER)], NEVER
        while token in self.parts:
            rank, *halves = self.parts[token]
            token = halves[side]
            out.append((token, rank))
        return out

    def crossed(self, left: int, right: int, but: int = -1) -> bool:
        """Whether a merge crosses the border of two tokens before both are whole.

        Merges go by rank and equal ones from the left: one that takes the border's left piece
        inwards comes before an equal one across, one that takes the right piece inwards after it.
        """
        for x, ends_x in self.right_edge[left]:
            for y, ends_y in self.left_edge[right]:
                found = self.merge.get((x, y))
                if found and found[1] != but and found[0] < ends_x and found[0] <= ends_y:
                    return True
        return False

    def whole(self, token: int) -> bool:
        """Whether the bytes of a token, merged on their own, give that token."""
        if token not in self.parts:
            return True
        _, a, b = self.parts[token]
        return self.stand(-1, a) and self.stand(-1, b) and not self.crossed(a, b, token)

    def stand(self, before: int, token: int) -> bool:
        """Whether the token stays whole after ``before`` (-1: at the start of a piece)."""
        return self.whole(token) if before < 0 else not self.crossed(before, token)

    def bytewise(self, raw: bytes) -> list[int]:
        """Tokens of every byte prefix of a piece, from the empty one on."""
        n = len(raw)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        if len(self.stands) > REMEMBERED:
            self.stands.clear()
        for start in range(n):
            before, many = last[start], count[start] + 1
            stands = self.stands.setdefault(before, {})
            node = self.trie
            for end in range(start, n):
                node = node.get(raw[end])
                if node is None:
                    break
                # One token only ends each prefix: an end that has one is not asked again.
                if not count[end + 1] and (token := node.get(-1)) is not None:
                    fits = stands.get(token)
                    if fits is None:
                        fits = stands[token] = self.stand(before, token)
                    if fits:
                        last[end + 1], count[end + 1] = token, many
        return count

    def piece(self, word: str) -> bytes:
        """Tokens of every prefix of a piece in code points, as packed 32-bit numbers."""
        raw = word.encode("utf-8", "surrogatepass")
        if word in ELISIONS:
            counts = [1, 2, self.bytewise(raw)[-1]]
        else:
            counts = self.bytewise(raw)[1:]
            if len(raw) > len(word):
                b = np.frombuffer(raw, np.uint8)
                counts = np.asarray(counts)[np.flatnonzero(np.append((b[1:] & 0xC0) != 0x80, True))]
        return array("i", counts).tobytes()

    def of(self, word: str) -> bytes:
        out = self.known.get(word)
        if out is None:
            out = self.piece(word)
            if len(word) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = out
        return out

    def words(self, text: str) -> list[str]:
        """The pieces of the pattern. Characters newer than this interpreter's tables are left to the
        tokenizer's own splitter, whose tables decide."""
        if not text.isascii():
            new = set(text) - self.assigned
            if any(unicodedata.category(c) == "Cn" for c in new):
                from tokenizers.pre_tokenizers import ByteLevel

                return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]
            self.assigned |= new
        return self.split.findall(text)

    def ordinary(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text without special tokens."""
        if not text:
            return np.empty(0, np.int32)
        packed = [self.of(w) for w in self.words(text)]
        table = np.frombuffer(b"".join(packed), np.int32)
        sizes = np.array([len(p) for p in packed]) >> 2
        ends = np.cumsum(sizes)
        before = np.cumsum(table[ends - 1], dtype=np.int32)
        table = table + np.repeat(np.concatenate([np.zeros(1, np.int32), before[:-1]]), sizes)
        for m in self.blank_run.finditer(text):
            # Read to here, the whole run is one piece; the next word has not taken its last blank yet.
            a, b = m.span()
            run = np.frombuffer(self.of(m[0]), np.int32)[-1]
            table[b - 1] = run + (table[a - 1] if a else 0)
        return table

    def table(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text, from one code point to all of them."""
        if self.special is None:
            return self.ordinary(text)
        parts, at, base = [], 0, 0
        for m in self.special.finditer(text):
            part = self.ordinary(text[at : m.end() - 1]) + base
            base = (int(part[m.start() - at - 1]) if m.start() > at else base) + 1
            parts += [part, np.array([base], np.int32)]
            at = m.end()
        return np.concatenate([*parts, self.ordinary(text[at:]) + base]).astype(np.int32)


_COUNTERS: dict[int, Counter] = {}


def _counter(source: str) -> Counter:
    # A worker process that runs several tasks keeps what it has learnt.
    key = hash(source)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(source)
    return _COUNTERS[key]


def count_tokens(spark: SparkSession, df: DataFrame, passed: Sequence[str] = ("doc_id",), text: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """Columns ``passed``, n_bytes, n_tokens, over_limit, fit_chars.

    ``fit_chars`` is the length in code points of the longest prefix of at most ``limit`` tokens.
    """
    sent = spark.sparkContext.broadcast(load(path))

    def run(texts: list[bytes], counter: Counter) -> list[pa.Array]:
        n_bytes, n_tokens, fit = [], [], []
        for raw in texts:
            table = counter.table(raw.decode("utf-8", "replace"))
            n_bytes.append(len(raw))
            n_tokens.append(int(table[-1]) if len(table) else 0)
            # A longer prefix may have fewer tokens, so the last one that fits is looked for.
            within = len(table) if n_tokens[-1] <= limit else int(np.flatnonzero(np.append(0, table) <= limit)[-1])
            fit.append(within)
        return [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens]), pa.array(fit, pa.int64())]

    return map_texts(df, list(passed), text, "n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint", run, lambda: _counter(sent.value), chunk_bytes=CHUNK)


def prefix_tables(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The counts of all prefixes, one row per ``SLICE`` of them: ``key``, slice, counts.

    ``counts[i]`` belongs to the prefix of slice * SLICE + i + 1 code points. Texts without
    characters have no row.
    """
    sent = spark.sparkContext.broadcast(load(path))
    name = fresh([key], "tables")

    def run(texts: list[bytes], counter: Counter) -> list[list]:
        out = []
        for raw in texts:
            table = counter.table(raw.decode("utf-8", "replace"))
            out.append([{"slice": k, "counts": table[a : a + SLICE]} for k, a in enumerate(range(0, len(table), SLICE))])
        return [out]

    made = map_texts(df, [key], text, f"{name} array<struct<slice: bigint, counts: array<int>>>", run, lambda: _counter(sent.value), chunk_bytes=CHUNK)
    return made.select(key, F.explode(name).alias("t")).select(key, "t.slice", "t.counts")


def tokens_at(tables: DataFrame, asked: DataFrame, key: str = "doc_id", chars: str = "chars") -> DataFrame:
    """``asked`` with ``tokens``: those of the first ``chars`` code points of the text ``key``.

    Zero characters have no tokens. Null where the text is not there, shorter, or the question null.
    Keys of ``tables`` are expected once; a repeated text gives a row for each of its tables.
    """
    part, held = fresh(asked.columns, "slice"), fresh(asked.columns, "counts")
    tables = tables.select(key, F.col("slice").alias(part), F.col("counts").alias(held))
    at = (F.col(chars) - 1).cast("bigint")
    found = asked.withColumn(part, F.floor(at / SLICE)).join(tables, [key, part], "left")
    inside = F.element_at(held, (F.pmod(at, F.lit(SLICE)) + 1).cast("int"))
    n = F.when(F.col(chars) == 0, 0).when((F.col(chars) > 0) & (F.pmod(at, F.lit(SLICE)) < F.size(held)), inside)
    return found.select(*[F.col(c) for c in asked.columns], n.cast("bigint").alias("tokens"))


def longest_within(tables: DataFrame, asked: DataFrame, key: str = "doc_id", budget: str = "budget") -> DataFrame:
    """key, budget, chars: the longest prefix of the text ``key`` with at most ``budget`` tokens.

    One row per different question; 0 where no prefix fits or the text has no characters.
    """
    wanted = asked.select(key, budget).distinct()
    where = F.transform("counts", lambda c, i: F.when(c <= F.col(budget), i + 1))
    fits = F.array_max(where).cast("bigint") + F.col("slice") * SLICE
    found = wanted.join(tables, key, "left").groupBy(key, budget).agg(F.max(fits).alias("chars"))
    return found.select(key, budget, F.coalesce("chars", F.lit(0)).cast("bigint").alias("chars"))
