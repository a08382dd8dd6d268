"""Guess cost of a password: the cheapest way to read it as words, dates, repeats, walks and brute force.

A value is cut into segments; each segment has a number of guesses by its kind. The cost of a cut is
the sum of the logarithms of its segments' guesses plus the logarithm of the number of ways to order
that many segments; a dynamic programme over (end, number of segments) finds the smallest, over the whole
value at any length.

The programme goes forward under a limit: a state that costs the limit already is given up. Brute force
pays for every character, so a strong value has no state left after a few of them, however long it is, and
the number of segments is bounded by the limit as well (k segments cost at least log k!).

Repeats, sequences and walks are maximal runs, or what is left of one when up to ``TRIM`` characters at
either end belong to its neighbours. Words and dates are shorter than that; of a run of up to twice ``TRIM``
characters every part is a reading.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from math import lgamma, log

LN10 = log(10.0)
#: Guesses per character that no cheaper reading covers.
BRUTE = 10.0
#: Characters that a run can leave to its neighbours at either end.
TRIM = 16
#: Longest unit of a repeat.
UNIT = 8

# Common words of passwords and placeholders, most common first.
WORDS = """
password 123456 qwerty admin welcome letmein monkey dragon master login abc iloveyou sunshine princess
football baseball shadow superman michael secret test example changeme default root user guest pass
passwd token key api apikey placeholder dummy sample your yours here insert replace redacted hidden
masked none null undefined value string secretkey accesskey private public server client database
mysql postgres redis mongo oracle system service account access auth bearer basic demo foo bar baz
qux hello world love money freedom summer winter spring autumn monday friday january february march
april june july august september october november december alpha beta gamma delta omega star tiger
lion eagle hunter ranger batman jordan harley robert thomas daniel george charlie andrew jennifer
jessica michelle pepper ginger cookie cheese coffee orange banana apple cherry purple silver golden
diamond computer internet google github amazon windows linux ubuntu debian docker kubernetes cluster
local localhost internal external production staging development prod stage dev backup manager super
power magic trust mustang corvette ferrari porsche yankees lakers steelers cowboys killer soccer
hockey tennis golf the and for you not with this that from have one two three four five six seven
eight nine zero yes no on off true false enabled disabled
"""
# Rows of a common keyboard, with and without shift.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "~!@#$%^&*()_+")
SUBSTITUTES = str.maketrans("@4301!5$7+8", "aaeoiissttb")
_Y, _M, _D, _S = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", "[-/._]?"
DATES = [re.compile(p, re.A) for p in (_Y + _S + _M + _S + _D, _D + _S + _M + _S + _Y, _D + _S + _M + _S + r"\d\d", _Y)]


@lru_cache(maxsize=1)
def _ranks() -> dict[str, int]:
    return {w: i + 1 for i, w in reversed(list(enumerate(WORDS.split())))}


@lru_cache(maxsize=1)
def _longest() -> int:
    return max(map(len, _ranks()))


@lru_cache(maxsize=1)
def _places() -> dict[str, tuple[int, int]]:
    return {c: (r, i) for r, row in enumerate(ROWS[:4]) for i, c in enumerate(row)}


def _log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def _case_cost(word: str) -> float:
    upper = sum(c.isupper() for c in word)
    if upper == 0:
        return 0.0
    if upper == len(word) or (upper == 1 and (word[0].isupper() or word[-1].isupper())):
        return log(2.0)
    return log(2.0) + _log_choose(len(word), min(upper, len(word) - upper))


class Runs:
    """Maximal runs of one kind in a value, found as they are asked for; what was scanned is not scanned again."""

    def __init__(self, value: str):
        self.value = value
        self.known: dict[object, tuple[int, int]] = {}

    def repeat(self, i: int, unit: int) -> tuple[int, int]:
        """The run with this period that holds the pair (i, i + unit), or an empty one."""
        v = self.value
        a, b = self.known.get(unit, (0, 0))
        if a <= i and i + unit < b:
            return a, b
        if v[i : i + 1] != v[i + unit : i + unit + 1] or i + unit >= len(v):
            return i, i
        a = i
        while a > 0 and v[a - 1] == v[a - 1 + unit]:
            a -= 1
        b, step = i, 1
        while step:  # longer and longer blocks while they agree, shorter ones at the end
            x = v[b : b + step]
            if len(x) == step and x == v[b + unit : b + unit + step]:
                b, step = b + step, step * 2
            else:
                step //= 2
        self.known[unit] = (a, b + unit)
        return a, b + unit

    def steps(self, i: int, kind: str, step) -> tuple[int, int]:
        """The run of characters that follow each other around (i, i + 1)."""
        v = self.value
        a, b = self.known.get(kind, (0, 0))
        if a <= i and i + 1 < b:
            return a, b
        s = step(v, i)
        if s is None:
            return i, i
        same = (lambda t: t == s) if kind == "sequence" else (lambda t: t is not None)
        a, b = i, i + 2
        while a > 0 and same(step(v, a - 1)):
            a -= 1
        while b < len(v) and same(step(v, b - 1)):
            b += 1
        self.known[kind] = (a, b)
        return a, b


def _next_letter(v: str, i: int) -> int | None:
    if i + 1 >= len(v) or not (v[i].isalnum() and v[i + 1].isalnum()):
        return None
    d = ord(v[i + 1]) - ord(v[i])
    return d if d in (1, -1) else None


def _next_key(v: str, i: int) -> tuple[int, int] | None:
    """Direction to a key beside: the same and the next places of the own row and of the rows next to it."""
    places = _places()
    if i + 1 >= len(v) or v[i] not in places or v[i + 1] not in places:
        return None
    (r, c), (s, d) = places[v[i]], places[v[i + 1]]
    return (s - r, d - c) if v[i] != v[i + 1] and abs(s - r) <= 1 and abs(d - c) <= 1 else None


def _ends(i: int, run: tuple[int, int], least: int, step: int = 1) -> list[int]:
    """Ends of the parts of a run that start at i: within TRIM of either end of the run, on both sides."""
    a, b = run
    if i < a or not (i - a <= TRIM or b - i <= TRIM):
        return []
    last = i + (b - i) // step * step
    head = range(i + least, min(last, a + TRIM) + 1)
    tail = range(max(i + least, b - TRIM), last + 1)
    return sorted({j for part in (head, tail) for j in part if (j - i) % step == 0})


class Readings:
    """The readings of a value other than brute force, by their start."""

    def __init__(self, value: str):
        self.value = value
        self.low = value.lower() if len(value.lower()) == len(value) else value
        self.plain = self.low.translate(SUBSTITUTES)
        self.exact, self.lower = Runs(value), Runs(self.low)
        self.turns: dict[int, tuple[int, list[int]]] = {}

    def _walk_turns(self, run: tuple[int, int]) -> list[int]:
        """Changes of direction before each step of the walk at ``run``."""
        a, b = run
        if self.turns.get(a, (0, []))[0] != b:
            out, before, n = [], None, 0
            for i in range(a, b - 1):
                d = _next_key(self.low, i)
                n += before is not None and d != before
                out.append(n)
                before = d
            self.turns[a] = (b, out)
        return self.turns[a][1]

    def at(self, i: int) -> Iterator[tuple[int, str, float]]:
        """(end, kind, natural log of guesses) of every reading that starts at i."""
        value, low, plain, ranks = self.value, self.low, self.plain, _ranks()
        for j in range(i + 2, min(len(value), i + _longest()) + 1):
            w, p = low[i:j], plain[i:j]
            found = [(ranks[w], 0.0)] if w in ranks else []
            if p != w and p in ranks:
                found.append((ranks[p], log(2.0) + sum(a != b for a, b in zip(w, p)) * log(2.0)))
            if w[::-1] in ranks:
                found.append((ranks[w[::-1]], log(2.0)))
            if found:
                yield j, "word", min(log(r + 1.0) + extra for r, extra in found) + _case_cost(value[i:j])
        for pattern in DATES:
            m = pattern.match(value, i)
            if m:
                digits = sum(c.isdigit() for c in m.group())
                yield m.end(), "date", log(119.0 if pattern is DATES[3] else 365.0 * 119.0) + (log(4.0) if digits < m.end() - i else 0.0)
        for unit in range(1, UNIT + 1):
            for j in _ends(i, self.exact.repeat(i, unit), max(3, 2 * unit), unit):
                yield j, "repeat", unit * log(BRUTE) + log((j - i) / unit)
        for j in _ends(i, self.lower.steps(i, "sequence", _next_letter), 3):
            yield j, "sequence", log(26.0) + log(j - i)
        run = self.lower.steps(i, "walk", _next_key)
        for j in _ends(i, run, 3):
            before = self._walk_turns(run)
            t = 1 + before[j - 2 - run[0]] - before[i - run[0]]
            yield j, "walk", log(47.0) + t * log(4.6) + _log_choose(j - i - 1, t - 1)


def _search(value: str, limit: float) -> tuple[float, list[tuple[int, int, str]]] | None:
    """Natural log of the guesses of the cheapest reading and its segments; None where it is not below ``limit``."""
    n = len(value)
    if n == 0:
        return (0.0, []) if limit > 0 else None
    readings = Readings(value)
    # states[j][k]: smallest sum over value[:j] in k segments, and the segment it ends with.
    states: dict[int, dict[int, tuple[float, int, str]]] = {0: {0: (0.0, 0, "")}}
    heap = [0]

    def reach(k: int, a: int, b: int, kind: str, cost: float) -> bool:
        if cost + lgamma(k + 1) >= limit:
            return False
        if b not in states:
            states[b] = {}
            heappush(heap, b)
        if k not in states[b] or cost < states[b][k][0]:
            states[b][k] = (cost, a, kind)
        return True

    while heap and heap[0] < n:
        a = heappop(heap)
        # More segments for no smaller sum lead nowhere better.
        live, least = [], float("inf")
        for k in sorted(states[a]):
            if states[a][k][0] < least:
                least = states[a][k][0]
                live.append((k, least))
        found = list(readings.at(a))
        for k, sum_ in live:
            for b, kind, cost in found:
                reach(k + 1, a, b, kind, sum_ + cost)
            for b in range(a + 1, n + 1):
                if not reach(k + 1, a, b, "brute", sum_ + (b - a) * log(BRUTE)):
                    break
    if n not in states:
        return None
    total, k = min((c[0] + lgamma(k + 1), k) for k, c in states[n].items())
    cut, j = [], n
    while j > 0:
        _, a, kind = states[j][k]
        cut.append((a, j, kind))
        j, k = a, k - 1
    return total, cut[::-1]


@lru_cache(maxsize=10_000)
def _cheapest(value: str) -> tuple[float, list[tuple[int, int, str]]]:
    limit = 8 * LN10
    while True:
        found = _search(value, limit)
        if found:
            return found
        limit *= 2


def guess_cost(value: str) -> float:
    """Decimal logarithm of the guesses that the cheapest reading of ``value`` needs; 0 when empty.

    The limit is doubled until a reading is below it, so a long value that nothing reads cheaply takes long;
    ``costs_at_least`` gives such a value up after a few characters and is what the scan uses.
    """
    return _cheapest(value)[0] / LN10


@lru_cache(maxsize=100_000)
def costs_at_least(value: str, cost: float) -> bool:
    """Whether ``guess_cost(value) >= cost``; no state is followed that costs as much already."""
    return _search(value, cost * LN10) is None


def cheapest_cut(value: str) -> list[tuple[int, int, str]]:
    """The segments (start, end, kind) of the cheapest reading."""
    return _cheapest(value)[1]
