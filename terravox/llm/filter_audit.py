"""What each filter of a chain removes, in every order the chain could have.

A document fails a set of filters: its mask. Documents are counted per part and mask, with the counts
that matter beside the number of rows (good and toxic ones here); all orders follow from these at most
2^n cells of a part. A Gray-code walk visits every subset of filters by toggling one at a time: it keeps
for each cell how many of its failures are switched on, and the survivors as a running sum that changes
only where that number leaves or reaches zero. The survivors of the 32 subsets are stored; what a filter
removes at a step of an order is the difference between the subset before it and the one with it.

The five filters: A under 100 words; B fewer than 80 different words in 100; C more than 10 capitals in
100 characters; D one of ``#$%&*|``; E the text of a document with a smaller id. E is never decided by
comparing documents: the smallest id of each text is found by its digest, and rows meet it by digest and
id, so a text that a third of all rows share is spread by their ids.

A null text counts as empty, a null part as the empty string. A null id is not smaller than another, nor
has it smaller ones: such rows never fail E. Rows with the id of the smallest are none with a smaller one.
A document counts as good or toxic if any row of ``labels`` says so; null marks say nothing. An empty
table has no parts. Columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravox.session import keep

FILTERS = "ABCDE"
#: Of equal texts only the first stays: this filter looks at the table, the others at one text.
LAST = 1 << FILTERS.index("E")
BLANKS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTED = ("rows", "good", "toxic")


def own_failures(text: Column) -> Column:
    """The failures of A to D as bits, from the whole text."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n = F.size(words)
    chars = F.char_length(text)
    capitals = chars - F.char_length(F.translate(text, CAPITALS, ""))
    fails = (n < 100, F.size(F.array_distinct(words)) * 100 < n * 80, capitals * 100 > chars * 10, text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, rows, good, toxic: one row per part and mask that occurs.

    Only digests, ids and masks are shuffled, and equal rows are counted before they are sent.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    seen = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("digest"), own_failures(whole).alias("own")
    )
    seen = keep(seen.groupBy("digest", "id", "part", "own").agg(F.count(F.lit(1)).alias("n")), "filter-audit")
    first = seen.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    late = F.col("id").isNotNull() & F.col("first").isNull()
    mask = F.col("own") + F.when(late, LAST).otherwise(0)
    # Counted per id before the marks are looked up: an id that many rows share is few rows there.
    counted = seen.join(first, ["digest", "id"], "left").groupBy("id", "part", mask.alias("mask")).agg(F.sum("n").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(m) for c, m in (("quality", "g"), ("toxic", "t"))])
    marked = counted.join(marks, "id", "left")
    sums = [F.sum(F.when(c, F.col("n")).otherwise(0)).cast("bigint").alias(m) for m, c in zip(COUNTED, (F.lit(True), F.col("g") == 1, F.col("t") == 1))]
    return marked.groupBy("part", "mask").agg(*sums)


def survivors(masks: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Row S: what of ``counts`` is left when the filters of the subset S are on, for all 2^n subsets."""
    out = np.zeros((1 << n, counts.shape[1]), counts.dtype)
    active = np.zeros(len(masks), np.int64)
    running = counts.sum(axis=0)
    subset = 0
    out[subset] = running
    for step in range(1, 1 << n):
        toggled = step & -step  # the filter in which two neighbours of the Gray code differ
        hit = (masks & toggled) != 0
        subset ^= toggled
        if subset & toggled:
            running = running - counts[hit & (active == 0)].sum(axis=0)
            active[hit] += 1
        else:
            active[hit] -= 1
            running = running + counts[hit & (active == 0)].sum(axis=0)
        out[subset] = running
    return out


def steps(masks: np.ndarray, counts: np.ndarray, names: str = FILTERS) -> pd.DataFrame:
    """Every order and step of a part, from the stored survivors."""
    n = len(names)
    left = survivors(masks, counts, n)
    everything = (1 << n) - 1
    shapley = []
    for k in range(n):
        bit = 1 << k
        without = [s for s in range(1 << n) if not s & bit]
        weight = [factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in without]
        shapley.append(sum(w * int(left[s, 0] - left[s | bit, 0]) for w, s in zip(weight, without)))
    rows = []
    for order in permutations(range(n)):
        before = 0
        for step, k in enumerate(order, 1):
            bit = 1 << k
            removed, good, toxic = (int(x) for x in left[before] - left[before | bit])
            fails = int(left[0, 0] - left[bit, 0])
            alone = int(left[everything ^ bit, 0] - left[everything, 0])
            rows.append(("".join(names[j] for j in order), step, int(left[before | bit, 0]), removed, fails - removed, alone, good, toxic, shapley[k]))
            before |= bit
    return pd.DataFrame(rows, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


RESULT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order and step: 600 rows a part, from at most 32 cells a part."""
    per_part = cells(docs, labels, key, text, part).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTED)).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, held in zip(b["part"], b["cells"]):
                masks = np.array([c["mask"] for c in held], np.int64)
                out = steps(masks, np.array([[c[m] for m in COUNTED] for c in held], np.int64))
                out.insert(0, "part", name)
                yield out

    return per_part.mapInPandas(run, RESULT)


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
#: The same rows in SQL, by the masks of the filters that were applied.
SQL = f"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS g, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
firsts AS (SELECT t, min(doc_id) AS first_id FROM words GROUP BY t),
masked AS (
  SELECT part, coalesce(g, 0) AS g, coalesce(x, 0) AS x,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(words.t, '[^A-Z]', '', 'g')) > 10 * length(words.t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(words.t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN words.doc_id > first_id THEN 16 ELSE 0 END AS mask
  FROM words JOIN firsts ON words.t = firsts.t LEFT JOIN marks ON words.doc_id = marks.doc_id),
counted AS (SELECT part, mask, count(*) AS n, sum(g) AS g, sum(x) AS x FROM masked GROUP BY part, mask),
orders AS (SELECT * FROM (VALUES {_ORDERS}) AS o(filter_order)),
applied AS (
  SELECT filter_order, step, 1 << (strpos('{FILTERS}', filter_order[step]) - 1) AS bit,
         (SELECT coalesce(sum(1 << (strpos('{FILTERS}', filter_order[k]) - 1)), 0) FROM range(1, step) AS r(k)) AS before
  FROM orders, range(1, 6) AS s(step)),
each AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit)::BIGINT = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before::BIGINT = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before::BIGINT <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before::BIGINT = 0 AND mask & bit <> 0 THEN g ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before::BIGINT = 0 AND mask & bit <> 0 THEN x ELSE 0 END) AS toxic_lost
  FROM counted, applied GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM each
"""
