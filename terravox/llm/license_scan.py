"""Licence scan: ordered signature rules behind a keyword filter, overlaps settled by priority.

Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. The base phrases
are counted at every place. The rules of ``license_rules`` add labels: a rule is tried only on a text
that holds its keyword; detections are taken in order of priority, then length, then place, and one
that lies inside a kept detection, or overlaps one of higher priority, is suppressed.

Nulls and empty texts have no words, no labels and score 0. Repeated rows give repeated results;
other columns of the input are not read, whatever their names. Each text is handled whole and by
itself: there is no shuffle.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import lru_cache

from pyspark.sql import DataFrame

from terravox.llm.common import map_texts
from terravox.llm.license_rules import build_rules

# Phrase and label of the base.
BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
OUT = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<label:string,priority:int,first_word:bigint,n_words:bigint>>"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


@lru_cache(maxsize=1)
def _rules():
    """The rules, their numbers by keyword, and the keywords by their longest word: the gate of a text."""
    rules = build_rules()
    by_keyword: dict[bytes, list[int]] = {}
    for i, r in enumerate(rules):
        by_keyword.setdefault(r.keyword, []).append(i)
    by_word: dict[bytes, list[bytes]] = {}
    for k in by_keyword:
        by_word.setdefault(max(k.split(), key=len), []).append(k)
    return rules, by_keyword, by_word, frozenset(by_word)


def base_places(text: bytes) -> list[tuple[int, str]]:
    """(offset, label) of each base phrase in normalised text with a blank at either end."""
    found = []
    for phrase, label in BASE.items():
        needle = b" " + phrase + b" "
        at = text.find(needle)
        while at >= 0:
            found.append((at, label))
            at = text.find(needle, at + 1)
    return found


def settle(spans: list[tuple[int, int, int]]) -> list[int]:
    """Which (priority, start, end) stay: higher priority, longer, earlier first; none overlaps a kept one."""
    kept: list[tuple[int, int]] = []
    out = []
    for i in sorted(range(len(spans)), key=lambda i: (-spans[i][0], spans[i][1] - spans[i][2], spans[i][1], i)):
        _, a, b = spans[i]
        k = bisect_left(kept, (b,))
        if k == 0 or kept[k - 1][1] <= a:
            insort(kept, (a, b))
            out.append(i)
    return out


def detect(words: list[bytes], text: bytes) -> list[tuple[str, int, int, int, float]]:
    """Surviving (label, priority, start, end, weight) in normalised text, by place."""
    rules, by_keyword, by_word, gate = _rules()
    hits, spans = [], []
    for w in sorted(gate.intersection(words)):
        for keyword in by_word[w]:
            if keyword in text:
                for i in by_keyword[keyword]:
                    r = rules[i]
                    for m in r.pattern.finditer(text):
                        hits.append((i, m.start(), m.end()))
                        spans.append((r.priority, m.start(), m.end()))
    if not hits:
        return []
    kept = sorted((hits[k] for k in settle(spans)), key=lambda h: h[1])
    return [(rules[i].label, rules[i].priority, a, b, rules[i].weight) for i, a, b in kept]


def word_numbers(text: bytes, offsets: list[int]) -> list[int]:
    """Number of the word that follows the blank at each of the ascending offsets."""
    out, at, n = [], 0, 0
    for o in offsets:
        n += text.count(b" ", at, o)
        at = o
        out.append(n)
    return out


def scan(raw: bytes):
    words = words_of(raw)
    text = b" " + b" ".join(words) + b" "
    base = sorted(base_places(text))
    first, last = word_numbers(text, [base[0][0], base[-1][0]]) if base else (None, None)
    base_labels = sorted({label for _, label in base})
    found = detect(words, text)
    at = word_numbers(text, [a - 1 for _, _, a, _, _ in found])
    miss = 1.0
    for w in {**{f[0]: f[4] for f in found}, **{b: 0.9 for b in base_labels}}.values():
        miss *= 1.0 - w
    labels = sorted({*base_labels, *(f[0] for f in found)})
    detections = [
        {"label": label, "priority": p, "first_word": k, "n_words": text.count(b" ", a, b) + 1}
        for (label, p, a, b, _), k in zip(found, at)
    ]
    return len(words), len(base), first, last, ",".join(base_labels), ",".join(labels), 1.0 - miss, detections


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: the key, the word and base counts, labels, score and detections."""
    return map_texts(df, [key], text, OUT, lambda raws: list(zip(*map(scan, raws))))
