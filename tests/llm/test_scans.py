"""Secret and licence scans, guess costs, url rules and toxicity."""

import hashlib
import random
import re
import zlib
from itertools import product

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terravox.llm import guess_cost, license_scan, secret_scan, toxicity, url_filter
from terravox.llm.license_rules import build_rules

DOCS = "doc_id bigint, text string, spans string, score double, _text string, n_chars bigint"


def docs(spark, texts, ids=None):
    """Documents with columns whose names clash with results."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 0.5, "y", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)


ODD = [None, "", " ", "\n\n", "a" * 200_000, "Ünïcode 漢字 😀", "same", "same"]


# ---- secrets -----------------------------------------------------------------------------------


def plain_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (name, rx, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16)), 1):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(rx, text) if m.end() - m.start() >= least]
    return ",".join(x for _, _, x in sorted(out))


def test_secrets_base_spans(spark):
    rng = random.Random(3)
    bits = ["password", "PassWd", "Tok\u212aen", "token", "\u017fecret", "api_key", "APIKEY", '"', "'", " ", "=", ":", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "xY9/+_.=-", "é", "\n", "zzzzzzzzzzzz"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ODD
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain_base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        spans = [s for s in got[i].spans.split(",") if s and not s.startswith("guess")]
        assert ",".join(spans) == want
        assert got[i].n_assign + got[i].n_access + got[i].n_hex == len([s for s in want.split(",") if s])


def reading(text):
    """Natural logs of the guesses of all readings of a whole text but brute force, each kind from its definition."""
    from math import comb, log

    low, n, out = text.lower(), len(text), []
    rank = {w: i + 1 for i, w in reversed(list(enumerate(guess_cost.WORDS.split())))}
    upper = sum(c != d for c, d in zip(text, low))
    case = 0.0 if not upper else log(2) if upper == n or (upper == 1 and (text[0] != low[0] or text[-1] != low[-1])) else log(2 * comb(n, min(upper, n - upper)))
    swapped = "".join(dict(zip("@4301!5$7+8", "aaeoiissttb")).get(c, c) for c in low)
    if n > 1:
        out += [log(rank[low] + 1) + case] if low in rank else []
        out += [log(rank[low[::-1]] + 1) + log(2) + case] if low[::-1] in rank else []
        changed = sum(c != d for c, d in zip(low, swapped))
        out += [log(rank[swapped] + 1) + (1 + changed) * log(2) + case] if changed and swapped in rank else []
    bare = [c for c in text if c.isdigit()]
    year, month, day = r"(19|20)[0-9]{2}", r"(0[1-9]|1[0-2])", r"(0[1-9]|[12][0-9]|3[01])"
    for form in (f"{year}~{month}~{day}", f"{day}~{month}~{year}", f"{day}~{month}~[0-9][0-9]"):
        if re.fullmatch(form.replace("~", "[-/._]?"), text):
            out.append(log(365 * 119) + (log(4) if len(bare) < n else 0.0))
    out += [log(119)] if re.fullmatch(year, text) else []
    for unit in range(1, 9):
        if n % unit == 0 and n >= max(3, 2 * unit) and text == text[:unit] * (n // unit):
            out.append(unit * log(10) + log(n / unit))
    if n >= 3 and text.isalnum() and {ord(y) - ord(x) for x, y in zip(low, low[1:])} in ({1}, {-1}):
        out.append(log(26) + log(n))
    keys = {c: complex(r, i) for r, row in enumerate(guess_cost.ROWS[:4]) for i, c in enumerate(row)}
    if n >= 3 and all(c in keys for c in low):
        moves = [keys[y] - keys[x] for x, y in zip(low, low[1:])]
        if all(m and abs(m.real) <= 1 and abs(m.imag) <= 1 for m in moves):
            t = 1 + sum(x != y for x, y in zip(moves, moves[1:]))
            out.append(log(47) + t * log(4.6) + log(comb(n - 1, t - 1)))
    return out


def smallest(value):
    from math import lgamma, log

    n, best = len(value), 1e9
    seg = {(a, b): min([(b - a) * log(10), *reading(value[a:b])]) for a in range(n) for b in range(a + 1, n + 1)}
    for cut in product((0, 1), repeat=n - 1):
        at = [0, *(i + 1 for i, c in enumerate(cut) if c), n]
        best = min(best, sum(seg[p] for p in zip(at, at[1:])) + lgamma(len(at)))
    return best / log(10)


@pytest.mark.parametrize("seed", range(3))
def test_guess_cost_is_the_smallest_over_all_cuts(seed):
    rng = random.Random(seed)
    fixed = ["password1", "aaab1987", "qwerty", "xk9", "Pa55word", "abc12abc", "20240131!", "passzxcvbnm", "zxcvb", "x1234x", "01.02.1999", "drowssaP", "P@sSword", "aaaaaa", "ababab", "sasasa", "310199abc", "a\u0130b", "7"]
    bits = ["pass", "Word", "qwe", "asdf", "1234", "1987", "aa", "ab", "zx", "0", "!", "x", "LOVE", "e", "654"]
    mixed = ["".join(rng.choice(bits) for _ in range(5))[:12] for _ in range(25)]
    for value in (fixed if seed == 0 else []) + mixed:
        cost = smallest(value)
        assert guess_cost.guess_cost(value) == pytest.approx(cost), value
        cut = guess_cost.cheapest_cut(value)
        assert [a for a, _, _ in cut] + [len(value)] == [0] + [b for _, b, _ in cut]
        for bar in (cost - 1e-6, cost + 1e-6, 3.0, 30.0):
            assert guess_cost.costs_at_least(value, bar) == (cost >= bar), (value, bar)


@pytest.mark.parametrize("value,at_most", [("x" * 200, 3.4), ("x" * 5000, 6), ("ab" * 50_000, 7), ("password" * 4000, 13), ("x" * 1_000_000 + "password", 9)])
def test_long_cheap_values_are_read_whole(value, at_most):
    assert 0 < guess_cost.guess_cost(value) < at_most


@pytest.mark.parametrize("value", ["0123456789" * 10_000, "g7Kq-pX2v_" * 10_000, "asdfghjkl;lkjhgfdsa" * 20_000])
def test_long_strong_values_are_given_up_early(value):
    # Units of more than eight characters are no repeats, so these take very many segments.
    assert guess_cost.costs_at_least(value, 8.0)


def test_weak_values_stay_and_strong_ones_are_found(spark):
    weak, strong = "pwd: password123", "pwd: g7Kq-pX2v_Lz"
    rows = {r.doc_id: r for r in secret_scan.scan_secrets(docs(spark, [weak, strong])).collect()}
    assert rows[0].n_guess == 0 and rows[1].spans == "guess:5:17"
    assert guess_cost.guess_cost("") == 0 and guess_cost.cheapest_cut("") == []


@pytest.mark.parametrize("n", [256, 257, 600, 5000, 1_000_000])
def test_long_values_are_taken_whole(n):
    rng = random.Random(n)
    value = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789!$%&*+-_") for _ in range(n))
    for before, after in (("Authorization: Bearer ", " end"), ('private_key = "', '" end'), ("access-key: '", "' end"), ("auth=", "\n"), ("ftp://me:", "@host/a")):
        text = f"first {before}{value}{after}"
        a = len("first " + before)
        assert secret_scan.guessed_spans(text) == [(a, 3, a + n)], before
        assert secret_scan.redacted(text) == (f"first {before}{secret_scan.MARK}{after}", 1)


def test_credentials_in_an_address():
    found = lambda t: [t[a:b] for a, _, b in secret_scan.guessed_spans(t)]
    assert found("see postgres://app:g7Kq-pX2v_Lz@host:5432/db now") == ["g7Kq-pX2v_Lz"]
    assert found("https://:g7Kq:pX2v,Lz@host and http://h:8080/g7KqpX2vLz@x") == ["g7Kq:pX2v,Lz"]
    # A weak one stays; one inside a value, or reaching over its end, becomes one span with it.
    assert found("postgres://app:pw@host") == []
    assert found("password=ftp://me:g7Kq;pX2v_Lz@host") == ["ftp://me:g7Kq;pX2v_Lz"]


def test_redaction(spark):
    texts = ["a token = 0123456789abcdef0123 b", "clean", *ODD]
    d = docs(spark, texts)
    out = secret_scan.redact(d)
    assert out.columns == d.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == "a <SECRET> b" and got[0].n_chars == 12
    # The long run of one letter is a run of hex digits, so a base span.
    assert [got[i].text for i in range(1, len(texts))] == [secret_scan.MARK if t and len(t) > 1000 else t for t in texts[1:]]
    assert secret_scan.redact(d.filter("false")).count() == 0


# ---- licences ----------------------------------------------------------------------------------


def test_license_words_and_places(spark):
    rng = random.Random(4)
    bits = ["MIT", "license", "Apache", "general", "public", "gpl", "é", "x1", "the", "GNU"]
    seps = [" ", "\n", "-", ", ", "  "]
    texts = ["".join(rng.choice(bits) + rng.choice(seps) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ODD
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for i, t in enumerate(texts):
        low = re.sub(r"[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for label, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_license_priority_and_containment():
    rules = build_rules()
    assert len(rules) > 300 and all(re.search(rb"^[^ ]", r.keyword) for r in rules)
    labels = license_scan.scan(b"Licensed under the Apache License, Version 2.0")[5]
    assert labels == "Apache-2.0,apache"  # the bare name inside is suppressed
    assert license_scan.scan(b"GNU Lesser General Public License v2.1")[5] == "LGPL-2.1,gpl"
    assert license_scan.settle([(50, 0, 10), (90, 2, 8), (90, 2, 9), (10, 20, 30)]) == [2, 3]
    many = license_scan.scan(b"mit license " * 30_000)
    assert many[1] == 30_000 and many[3] == 59_998


# ---- urls --------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [
        "http://WWW.Example.com/en/1?x#y", "https://example.com/en/", "https://a.example.com/en/x", "http://x.net/es/1", "http://net/fr/",
        "http://notnet/es/1", "http://a.net/en/1", None, "", "no url", "http://", "http://com", "a://b://c/en/", "x://Ä.COM/Ä?", "http://h.org/a\n/b#c",
    ]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    labelled = spark.createDataFrame([("a.org", "/good/1", 0.0), ("b.org", "/bad/1", 1.0)] * 5, "host string, path string, label double")
    got = {r.page_id: r for r in url_filter.judge_urls(df, labelled).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.sub("[A-Z]", lambda m: m.group().lower(), re.match(r"[^/?#]*", rest).group())
            path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
        best = None
        for h, p, v in url_filter.RULES:
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
                best = (h + p, v)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[0]), u
        assert got[i].verdict == best[1] if best else got[i].verdict in ("allow", "block")


def test_url_model_on_held_out_urls(spark):
    rng = random.Random(1)
    rows = [(f"{rng.choice(['casino', 'pills', 'bets'])}{rng.randint(1, 99)}.org", f"/win/{rng.randint(1, 999)}", 1.0) for _ in range(200)]
    rows += [(f"{rng.choice(['library', 'school', 'museum'])}{rng.randint(1, 99)}.org", f"/read/{rng.randint(1, 999)}", 0.0) for _ in range(200)]
    rng.shuffle(rows)
    train = spark.createDataFrame(rows[:300], "host string, path string, label double")
    test = spark.createDataFrame([(i, f"http://{h}{p}", y) for i, (h, p, y) in enumerate(rows[300:])], "page_id bigint, url string, y double")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(test, train, rules=()).collect()}
    right = sum((got[i] == "block") == (y == 1.0) for i, (_, _, y) in enumerate(rows[300:]))
    assert right >= 95
    one = train.filter("label = 0")
    assert {r.verdict for r in url_filter.judge_urls(test, one, rules=()).collect()} == {"allow"}
    assert url_filter.judge_urls(test.filter("false"), train).count() == 0


# ---- toxicity ----------------------------------------------------------------------------------


def corpus(n=600):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts, toxic = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(["scoundrel", "vermin", "dolt"]))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity_on_the_held_out_fold(spark):
    texts, toxic = corpus()
    d = docs(spark, texts + ODD)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    rows = {r.doc_id: r for r in toxicity.judge(d, labels).collect()}
    assert len(rows) == len(texts) + len(ODD)
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    right = sum(rows[i].predicted == toxic[i] for i in held)
    assert right / len(held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    same = [i for i, t in enumerate(texts + ODD) if t == "same"]
    assert rows[same[0]].score == rows[same[1]].score


def test_toxicity_ignores_labels_of_the_held_out_fold(spark):
    texts, toxic = corpus(200)
    d = docs(spark, texts)
    fold = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(texts))]
    one = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id bigint, toxic int")
    other = spark.createDataFrame([(i, 1 - t if f else t) for i, (t, f) in enumerate(zip(toxic, fold))], "doc_id bigint, toxic int")
    a = {r.doc_id: r.score for r in toxicity.judge(d, one).collect()}
    b = {r.doc_id: r.score for r in toxicity.judge(d, other).collect()}
    assert a == b


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    d = docs(spark, ["a", None], [None, 1])
    rows = toxicity.judge(d, none).collect()
    assert [r.predicted for r in rows] == [0, 0]
    kept = toxicity.without_toxic(d, none)
    assert kept.columns == d.columns and kept.count() == 2
    assert toxicity.judge(d.filter("false"), none).count() == 0


def test_feature_sets_hold_words_pairs_and_skips():
    import numpy as np

    h = toxicity.WordHashes()
    a = np.frombuffer(toxicity.feature_sets([b"a b c"], h)[0], np.int32)
    assert len(a) == 3 + 2 + 1
    both = toxicity.feature_sets([b"a", b"b c"], h)
    assert [len(x) // 4 for x in both] == [1, 3]  # nothing crosses texts


def test_ids_of_any_kind_pass_untouched(spark):
    big = (1 << 62) + 1
    rows = license_scan.scan_licenses(docs(spark, ["x", "y"], [big, None])).collect()
    assert {r.doc_id for r in rows} == {big, None}
    assert secret_scan.scan_secrets(docs(spark, ["x"]).filter(F.lit(False))).count() == 0


def test_texts_are_sent_once_and_in_bounded_batches(spark):
    from terravox.llm.common import map_texts

    d = spark.createDataFrame([(1, "aé"), (2, None), (3, "")], "k int, text string")
    out = map_texts(d, ["k", "text"], "text", "n int", lambda raws: [[len(r) for r in raws]])
    assert sorted(map(tuple, out.collect())) == [(1, "aé", 3), (2, None, 0), (3, "", 0)]
    assert "_utf8" not in out._jdf.queryExecution().toString()

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    long = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    assert long.mapInArrow(sizes, "n bigint").agg(F.max("n")).first()[0] < 5 << 20  # 40 MB came at once before
