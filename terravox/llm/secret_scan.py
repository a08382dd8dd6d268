"""Secret scan: patterns of keys, and values in credential context that are hard to guess.

Kinds, in the order in which spans of one start are listed: ``assign`` (a key word, a sign and a value
of 12 or more characters), ``access`` (an access key id), ``hex`` (16 or more hex digits), and the
method's own ``guess``: a value in a wider credential context, of any length, or a password in an
address, whose guess cost is at least
``MIN_COST``. Words, dates, keyboard walks and repeats are cheap, so that placeholders and weak
examples stay. Matches are leftmost and do not overlap within a kind; offsets are code points, ends
exclusive.

Null and empty texts have no spans. Repeated rows give repeated results; other columns of the input
are not read. Texts are handled whole, each by itself: there is no shuffle. ``redact`` puts a mark in
the place of every span; overlapping spans become one mark, texts without spans are kept as they are.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.llm.common import fresh, map_texts
from terravox.llm.guess_cost import costs_at_least

#: Decimal logarithm of guesses from which a value in credential context counts as a secret.
MIN_COST = 8.0
MARK = "<SECRET>"

# The base patterns; letter case is spelled out where it is free.
_KEY = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = re.compile(_KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Wider context: more key words, values in quotes with any sign; values of any length.
CONTEXT = re.compile(
    r"""(?:passphrase|password|passwd|pwd|pass|secret[_-]?key|secret|token|auth|bearer|credentials?|private[_-]?key|access[_-]?key|api[_-]?key)["']?\x20*(?:[:=]\x20*|\x20is\x20|\x20)(?:"([^"\n]{8,})"|'([^'\n]{8,})'|([^\s"'<>,;]{8,}))""",
    re.I | re.A,
)
#: Credentials in an address, scheme://user:password@host; only what ends at the sign @ is a password.
ADDRESS = re.compile(r"""(?<=[A-Za-z0-9+.-])://[^\s:/?#@"'<>]*:([^\s/?#@"'<>]+)@""", re.A)
HINTS = ("pass", "pwd", "secret", "token", "auth", "bearer", "credential", "private", "access", "api")
KINDS = ("assign", "access", "hex", "guess")
OUT = "n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guessed_spans(text: str, min_cost: float = MIN_COST) -> list[tuple[int, int, int]]:
    """Spans of values in credential context whose cheapest reading takes many guesses."""
    low = text.lower()
    out = []
    if "://" in text:
        out += [(m.start(1), m.end(1)) for m in ADDRESS.finditer(text) if costs_at_least(m.group(1), min_cost)]
    for m in CONTEXT.finditer(text) if any(h in low for h in HINTS) else ():
        g = m.lastindex
        value = m.group(g)
        # A bare value after a blank is a sentence more often than a secret: it has to mix characters.
        if g == 3 and not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
            continue
        if costs_at_least(value, min_cost):
            out.append((m.start(g), m.end(g)))
    merged: list[tuple[int, int, int]] = []
    for a, b in sorted(out):  # a value and a password in an address may share characters
        if merged and a < merged[-1][2]:
            merged[-1] = (merged[-1][0], 3, max(b, merged[-1][2]))
        else:
            merged.append((a, 3, b))
    return merged


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str, min_cost: float = MIN_COST):
    base = base_spans(text)
    every = sorted(base + guessed_spans(text, min_cost))
    n = [sum(k == i for _, k, _ in every) for i in range(4)]
    return (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every))


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", min_cost: float = MIN_COST) -> DataFrame:
    """One row per row of ``df``: the key, counts by kind, a digest of the base spans, all spans."""
    return map_texts(df, [key], text, OUT, lambda texts: list(zip(*(scan(t, min_cost) for t in texts))), as_str=True)


def redacted(text: str, min_cost: float = MIN_COST) -> tuple[str, int]:
    spans = sorted((a, b) for a, _, b in base_spans(text) + guessed_spans(text, min_cost))
    if not spans:
        return text, 0
    parts, at, marks = [], 0, 0
    open_ = None
    for a, b in spans:
        if open_ is not None and a < open_:
            open_ = max(open_, b)
            continue
        if open_ is not None:
            at = open_
        parts += [text[at:a], MARK]
        marks += 1
        open_ = b
    return "".join(parts) + text[open_:], marks


def redact(df: DataFrame, text: str = "text", min_cost: float = MIN_COST) -> DataFrame:
    """The rows of ``df`` with secrets in ``text`` replaced by ``MARK``; a null text stays null.

    A column ``n_chars``, if there is one, is set to the new length where the text changed.
    """
    names = df.columns
    new, marks = fresh(names, "_text"), fresh(names, "_marks")
    made = map_texts(df, names, text, f"{new} string, {marks} bigint", lambda texts: list(zip(*(redacted(t, min_cost) for t in texts))), as_str=True)
    changed = F.col(marks) > 0
    swap = {text: F.when(changed, F.col(new)).otherwise(F.col(text))}
    if "n_chars" in names:
        swap["n_chars"] = F.when(changed, F.length(new).cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return made.select(*[swap.get(c, F.col(c)).alias(c) for c in names])
