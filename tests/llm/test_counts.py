"""Token counts of prefixes, filter audit and hard negatives."""

import random
from itertools import permutations

import numpy as np
import pytest

from terravox.llm import filter_audit, hard_negatives, token_counts
from test_scans import DOCS, ODD, docs

# ---- token counts ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.vocabulary_path())


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.load())


def plain_counts(library, text):
    return [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]


PARTS = ["a", "b", " ", "  ", "\n", "\t", "\r\n", "'", "'re", "'s", "'l", "'ll", "'ve", "é", "漢", "😀", "\u3000", "\u00a0", "1", "23", "!", "?", "<|", "<|endoftext|>", "endoftext", "|>", "the", "ing", " word", "\x1c", "\u0558", "\u0301", "aaaa", "--", "=="]


def test_counts_of_every_prefix_against_the_library(counter, library):
    rng = random.Random(4)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert counter.table(text).tolist() == plain_counts(library, text), repr(text)


def test_counts_of_random_bytes_and_letters(counter, library):
    rng = random.Random(5)
    for letters in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz ", "=-_*#", "ÃÂ", "\n \t"):
        for _ in range(60):
            text = "".join(rng.choice(letters) for _ in range(60))
            assert counter.table(text).tolist() == plain_counts(library, text), repr(text)


@pytest.mark.parametrize("text", ["a" * 60_000, "ab" * 30_000, "\n" * 60_000, "x" + " " * 60_000 + "y", "é" * 20_000, "!" * 60_000])
def test_counts_of_long_runs(counter, library, text):
    table = counter.table(text)
    assert table[-1] == len(library.encode(text, add_special_tokens=False).ids)
    cut = len(text) // 2 + 1
    assert table[cut - 1] == len(library.encode(text[:cut], add_special_tokens=False).ids)


def test_counts_as_columns(spark, library):
    texts = [*ODD, "<|endoftext|>", "one <|endoftext|> two", " ".join(["word"] * 3000)]
    got = {r.doc_id: r for r in token_counts.count_tokens(spark, docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        r = got[i]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
        assert len(library.encode(t[: r.fit_chars], add_special_tokens=False).ids) <= 1024
        if len(t) < 10_000 and n > 1024:
            assert all(len(library.encode(t[:k], add_special_tokens=False).ids) > 1024 for k in range(r.fit_chars + 1, min(len(t), r.fit_chars + 40)))
        if n <= 1024:
            assert r.fit_chars == len(t)
    assert token_counts.count_tokens(spark, docs(spark, texts).filter("false")).count() == 0
    twice = token_counts.count_tokens(spark, docs(spark, ["same", "same", None], [None, 7, 7])).collect()
    assert len(twice) == 3


def test_questions_are_answered_from_the_table(spark, library):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PARTS) for _ in range(200)), "", None, "word " * 30_000]
    tables = token_counts.prefix_tables(spark, docs(spark, texts)).cache()
    asks = [(i, n) for i, t in enumerate(texts) for n in (0, 1, 5, 77, 65_536, 65_537, 140_000, 200_000, -1, None)]
    asked = spark.createDataFrame([(i, n, "x") for i, n in asks], "doc_id bigint, chars bigint, counts string")
    for r in token_counts.tokens_at(tables, asked).collect():
        t = texts[r.doc_id] or ""
        there = r.chars is not None and 0 <= r.chars <= len(t)
        assert r.tokens == (len(library.encode(t[: r.chars], add_special_tokens=False).ids) if there else None), r
    budgets = spark.createDataFrame([(i, b) for i in range(4) for b in (0, 3, 20, 50_000, 20)], "doc_id bigint, budget int")
    found = {(r.doc_id, r.budget): r.chars for r in token_counts.longest_within(tables, budgets).collect()}
    assert len(found) == 16
    plain = [0, *plain_counts(library, texts[0])]
    for b in (0, 3, 20, 50_000):
        assert found[0, b] == max(n for n, k in enumerate(plain) if k <= b)
        assert found[1, b] == found[2, b] == 0
    assert found[3, 50_000] == len(texts[3]) and 0 < found[3, 20] <= 105


# ---- filter audit ------------------------------------------------------------------------------


def plain_audit(rows, marks):
    """Filters applied one after the other to lists of rows."""
    good = {d for d, q, t in marks if q == 1 and d is not None}
    toxic = {d for d, q, t in marks if t == 1 and d is not None}

    def failures(d, text):
        w = [x for x in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
        out = set()
        if len(w) < 100:
            out.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            out.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
            out.add("C")
        if any(c in text for c in "#$%&*|"):
            out.add("D")
        if d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in rows):
            out.add("E")
        return out

    judged = [(d, lang or "", failures(d, t or "")) for d, t, lang in rows]
    out = {}
    for part in {j[1] for j in judged}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = [j for j in judged if j[1] == part], []
            for step, f in enumerate(order, 1):
                hit = [j for j in left if f in j[2]]
                earlier = [j for j in gone if f in j[2]]
                left = [j for j in left if f not in j[2]]
                only = [j for j in judged if j[1] == part and j[2] == {f}]
                out[part, "".join(order), step] = [len(left), len(hit), len(earlier), len(only), sum(j[0] in good for j in hit), sum(j[0] in toxic for j in hit)]
                shapley[f] += len(hit)
                gone += hit
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def test_filter_audit_against_lists(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n\x0b\x0c\r ", "AB c", "x # y", " ".join(words[:120]), "É" * 50]
    for _ in range(60):
        n = rng.choice((20, 99, 100, 130))
        t = rng.choice(" \t\n").join(rng.choice(words[: rng.choice((60, 400))]) for _ in range(n))
        texts.append(t.upper() if rng.random() < 0.2 else t + rng.choice(("", "", " #", "|")))
    texts += rng.choices(texts, k=80) + [texts[9]] * 40  # a text that a fifth of the rows share
    ids = [rng.choice((i, i, i, 5, None)) for i in range(len(texts))]
    langs = [rng.choice(("en", "en", "de", None, "")) for _ in texts]
    rows = list(zip(ids, texts, langs))
    marks = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in (*range(0, len(texts), 2), 4, 4, None)]
    docs_ = spark.createDataFrame([(d, t, a, 1, "x") for d, t, a in rows], "doc_id bigint, text string, lang string, mask int, part string")
    labels = spark.createDataFrame([(d, q, t, 9) for d, q, t in marks], "doc_id bigint, quality int, toxic int, n int")
    got = filter_audit.audit(docs_, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {tuple(r[:3]): list(r[3:]) for r in got.collect()}
    want = plain_audit(rows, marks)
    assert len(want) == 600 * 3
    assert found == want
    assert filter_audit.audit(docs_.filter("false"), labels).count() == 0
    assert {r.good_lost for r in filter_audit.audit(docs_, labels.filter("false")).collect()} == {0}


def test_survivors_of_every_subset():
    rng = np.random.default_rng(8)
    for n in (1, 3, 6):
        masks = rng.integers(0, 1 << n, 50)
        counts = rng.integers(0, 9, (50, 2))
        left = filter_audit.survivors(masks, counts, n)
        for s in range(1 << n):
            assert left[s].tolist() == counts[(masks & s) == 0].sum(axis=0).tolist()


# ---- hard negatives ----------------------------------------------------------------------------


def test_neighbours_on_the_curve_are_neighbours_in_space():
    for dims, bits in ((1, 5), (2, 4), (3, 3), (5, 2), (8, 1)):
        side = 1 << bits
        points = np.array(np.meshgrid(*[range(side)] * dims)).reshape(dims, -1).T
        keys = hard_negatives.hilbert(points, bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        walk = points[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all(), (dims, bits)


def plain_negatives(rows, positives=5, negatives=3, every=50):
    whole = [(i, a, [int(np.floor(256 * x)) for x in v]) for i, v, a in rows]
    score = lambda x, y: sum(p * q for p, q in zip(x, y))
    out = []
    for i, a, v in whole:
        if i % every:
            continue
        every_score = sorted((-score(v, w), j, b) for j, b, w in whole if j != i)
        for p, j, _ in [x for x in every_score if x[2] == a][:positives]:
            fits = [x for x in every_score if x[2] != a and 50 * -p <= 100 * -x[0] <= 95 * -p][:negatives]
            out += [(i, j, n, x[1], -p, -x[0]) for n, x in enumerate(fits, 1)]
    return sorted(out)


def embedded(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [x if x is None else float(x) for x in v], a, 1, 2.0) for i, v, a in rows], "vec_id bigint, embedding array<double>, label int, rank int, score double")


def mined(spark, rows, **kw):
    df = hard_negatives.mine(embedded(spark, rows), **kw)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def test_hard_negatives_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((6, 12))
    v = centres[rng.integers(0, 6, 900)] + 0.4 * rng.standard_normal((900, 12))
    v[100:400] = v[99]  # a vector that a third of all rows have: ties
    v[500:520] = 0.0
    v[600:640] *= -1
    rows = [(i, x.tolist(), int(rng.integers(0, 4))) for i, x in enumerate(v)]
    odd = [(1000, None, 1), (1050, [None] + [1.0] * 11, 1), (1100, [float("nan")] * 12, 1), (1150, [float("-inf")] * 12, 1), (1200, v[3].tolist(), None), (None, v[3].tolist(), 1), (1250, [1.0], 1), (1300, [], 1)]
    want = plain_negatives(rows)
    assert len(want) > 100
    assert mined(spark, rows + odd) == want
    assert mined(spark, rows + odd, wave=7) == want


def test_hard_negatives_of_few_rows_and_large_numbers(spark):
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert hard_negatives.mine(embedded(spark, [(0, [1.0], 1)]).filter("false")).count() == 0
    few = [(0, [1.0, 0.5], 1), (1, [1.0, 1.0], 1), (2, [0.9, 0.4], 2), (3, [0.7, 0.7], 3), (50, [-1.0, 0.0], 2)]
    assert mined(spark, few) == plain_negatives(few) != []
    rng = np.random.default_rng(10)
    for size in (200.0, 1e6, 3e6):  # stored in two, four and eight bytes, the last beyond doubles
        big = [(i, (size * rng.standard_normal(4)).tolist(), int(i % 3)) for i in range(120)]
        assert mined(spark, big) == plain_negatives(big) != []
    assert mined(spark, [(i, [1e308, 1.0], i % 2) for i in range(60)]) == []  # equal scores are above every window


def test_bounds_leave_blocks_unread(spark):
    rng = np.random.default_rng(11)
    centres = 3 * rng.standard_normal((20, 6))
    which = rng.integers(0, 20, 8000)
    v = np.floor(256 * (centres[which] + 0.05 * rng.standard_normal((8000, 6))))
    numbers = hard_negatives.Numbers(6, int(np.abs(v).max()))
    order = np.argsort(which, kind="stable")
    a = hard_negatives.Asked(numbers, True, np.array([0]), np.array([1]), [v[0].astype(numbers.stored).tobytes()], np.array([0]), np.array([-np.inf]), np.array([np.inf]), 5)
    a.start()
    for i in range(0, 8000, 256):
        w, ids = v[order[i : i + 256]], order[i : i + 256] + 1
        a.add({"one_label": None, "low": w.min(0).tolist(), "high": w.max(0).tolist(), "ids": ids.tolist(), "labels": [1] * len(ids), "v": w.astype(numbers.stored).tobytes()})
    assert sorted(-s for s, _ in a.found[0]) == sorted((v @ v[0]))[-5:]
    assert a.read < 0.5 * a.met
