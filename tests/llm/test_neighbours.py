"""Neighbour search, SimHash groups, repeated passages, leaks, chats, pieces and the pipeline."""

import hashlib
import json
import os
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from terravox.llm import ann, chat_format, leak_search, near_copies, simhash, suffix_dedup, unigram
from test_scans import ODD, docs

# ---- nearest neighbours ------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score double")


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((700, 24)).astype(np.float32)
    v[100:160] = v[99]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(1000, None), (1020, [0.0] * 24), (1040, [float("nan")] + [1.0] * 23), (1060, [float("inf")] + [1.0] * 23), (1080, [1.0]), (1100, [None] + [1.0] * 23), (None, [1.0] * 24), (20, v[20].tolist())]
    got = {}
    for r in ann.nearest(vectors(spark, rows + odd)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 20))
    x = v.astype(np.float64)
    hit = 0
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(700), -s))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hit += len(set(want.tolist()) & {f[1] for f in found})
    assert hit / (20 * len(got)) >= 0.95


def test_neighbours_of_few_or_no_rows_and_in_waves(spark):
    few = vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])])
    assert [(r.rank, r.vec_id) for r in ann.nearest(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(few.filter("false")).count() == 0
    rng = np.random.default_rng(3)
    many = vectors(spark, [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((200, 8)).astype(np.float32))])
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(ann.nearest(many, every=2, eps=50.0)) == key(ann.nearest(many, every=2, eps=50.0, wave=7))


# ---- SimHash -----------------------------------------------------------------------------------


def plain_fingerprint(text):
    low = "".join(c.lower() if c.isascii() else c for c in text).encode()
    w = low.split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(prints, tau=3):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= tau and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def near_texts():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(12)]
    texts = list(base)
    for b in base[:6]:
        for _ in range(5):
            w = b.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    return [*texts, *base[:3], "One two\x0bthree\x1cfour", "ÄÖ x", "a b", *ODD]


def test_simhash_groups(spark):
    texts = near_texts()
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    prints = [plain_fingerprint(t or "") for t in texts]
    label = plain_components(prints)
    for i in range(len(texts)):
        assert got[i].fingerprint == f"{prints[i]:016x}"
        assert got[i].component_id == label[i]
    assert simhash.near_duplicates(docs(spark, ["a"]).filter("false")).count() == 0
    none = simhash.near_duplicates(docs(spark, ["a b", "a b", "c"], [None, 4, None])).collect()
    assert Counter((r.doc_id, r.component_id) for r in none) == Counter({(None, 4): 1, (4, 4): 1, (None, None): 1})


@pytest.mark.parametrize("bucket,small,tau", [(8192, 64, 3), (5, 2, 3), (3, 0, 4), (8192, 0, 2)])
def test_links_join_what_all_pairs_join(spark, bucket, small, tau):
    rng = random.Random(bucket + tau)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set()
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    links = [(r.a, r.b) for r in simhash.links(nodes, tau, bucket, small).collect()]
    at = {s: i for i, s in enumerate(signed)}
    assert all((prints[at[a]] ^ prints[at[b]]).bit_count() <= tau for a, b in links)
    label = list(range(len(prints)))
    for _ in prints:
        for a, b in links:
            label[at[a]] = label[at[b]] = min(label[at[a]], label[at[b]])
    assert label == plain_components(prints, tau)


def test_thresholds_follow_the_pigeonhole_rule():
    sample = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 500)
    for total in (10, 10**6, 10**10):
        groups, t, _ = simhash.plan_thresholds(sample, total)
        assert sum(t) == simhash.TAU - len(groups) + 1
        assert sorted(i for g in groups for i in g) == list(range(64))
    assert simhash.plan_thresholds(sample[:0], 0)[1]


def test_one_of_each_keeps_rows_whole(spark):
    d = docs(spark, ["a b c", "a b c", "x", None, "", "x"], [5, 2, None, 9, 8, 7])
    d = d.union(d.filter("doc_id = 2"))
    out = near_copies.one_of_each(d)
    assert out.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(2, "a b c"), (7, "x"), (8, "")]
    assert near_copies.one_of_each(d.filter("false")).count() == 0


def edited_texts(seed, families=25):
    """Families of texts of whose words some are changed, cut off, added or doubled."""
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh".split()) + str(rng.randint(0, 300))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([3, 30, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 50)):
                w[rng.randrange(len(w))] = word()
            w = w[: len(w) - rng.randint(0, len(w) // 8)] + [word() for _ in range(rng.randint(0, len(w) // 12))]
            texts.append(" \t".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    return [*texts, *texts[:3], "", None, "one", "x " * 5000]


def plain_groups(texts, tau):
    """Smallest place linked with each text, over all pairs; the number of pairs of 0.8, and of those within tau."""
    sets, prints = [], []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        h = [xxhash.xxh64_intdigest(x, 42) for x in set(w)]
        prints.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)))
    label, alike, within = list(range(len(texts))), 0, 0
    for i in range(len(texts)):
        for j in range(i):
            same = sets[i] == sets[j]
            if not same and 5 * len(sets[i] & sets[j]) < 4 * len(sets[i] | sets[j]):
                continue
            alike += 1
            if same or (prints[i] ^ prints[j]).bit_count() <= tau:
                within += 1
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label, alike, within


@pytest.mark.parametrize("first, small", [(near_copies.FIRST, near_copies.SMALL), (1, 2)])
def test_edited_copies_against_all_pairs(spark, monkeypatch, first, small):
    monkeypatch.setattr(near_copies.groups, "__defaults__", (near_copies.TAU, first, small))
    texts = edited_texts(4)
    label, alike, within = plain_groups(texts, near_copies.TAU)
    assert (alike, within) == (92, 68)  # short texts with rare words, changed in blocks: not all lie within the radius
    assert len(set(label)) < 0.7 * len(texts)  # there are groups
    got = sorted(r.doc_id for r in near_copies.one_of_each(docs(spark, texts, list(range(len(texts))))).collect())
    assert got == sorted(set(label))


def test_blocks_of_a_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(120)] = f"n{i}"
        texts.append(" ".join(w))
    texts += [" ".join(f"o{i}{k}" for k in range(60)) for i in range(20)]
    nodes = [(i, *near_copies.word_print(t.encode())[1:]) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, f, len(r), i) for i, f, r in nodes], "node bigint, fp bigint, n int, label bigint")
    pairs = {(r.a, r.b) for r in near_copies.candidates(df, 3, small=2, bucket=64).collect()}
    near = {i: {j for j, g, r2 in nodes if j != i and ((f ^ g) & (2**64 - 1)).bit_count() <= near_copies.TAU and 5 * min(len(r), len(r2)) >= 4 * max(len(r), len(r2))} for i, f, r in nodes}
    listed = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i in near}
    for i in near:
        assert listed[i] <= near[i] and len(listed[i]) >= min(4, len(near[i]))
        assert all(len(listed[j]) >= 4 for j in near[i] - listed[i])  # what is left out was cut from both lists


# ---- repeated passages -------------------------------------------------------------------------


def plain_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def passage_texts():
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [noise(n) for n in (30, 45, 60, 90)]
    texts = []
    for _ in range(40):
        texts.append("".join(rng.choice([noise(rng.randint(0, 50)), rng.choice(shared)]) for _ in range(rng.randint(0, 6))))
    return [*texts, "z" * 100, "ab" * 60, *texts[:4], shared[2] + "é", *[t if t is None or len(t) < 1000 else "a" * 3000 for t in ODD]]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_repeated_passages(spark, hot):
    texts = passage_texts()
    got = {r.doc_id: r for r in suffix_dedup.repeated_passages(docs(spark, texts), length=40, gram=12, hot=hot).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, gone in enumerate(plain_removed(raw, 40)):
        kept = bytes(b for b, g in zip(raw[i], gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw[i]), sum(gone), runs, hashlib.sha256(kept).hexdigest()), i
    assert suffix_dedup.repeated_passages(docs(spark, ["a"]).filter("false")).count() == 0


def test_long_texts_are_cut_with_an_overlap(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd") for _ in range(3000))
    want = {(int(a), int(a) - d) for _, a, lo, hi, _ in zip(*suffix_dedup.anchors([text], 40, 12)) for d in range(lo, hi + 1)}
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    suffix_dedup._state.clear()
    cut = {(int(a), int(a) - d) for _, a, lo, hi, _ in zip(*suffix_dedup.anchors([text], 40, 12)) for d in range(lo, hi + 1)}
    suffix_dedup._state.clear()
    # Every string start has exactly one anchor, and it is the same one.
    assert sorted(p for _, p in cut) == list(range(len(text) - 40 + 1)) and cut == want


def test_merge_orders_runs_and_knows_their_prefixes():
    rng = random.Random(6)
    runs = []
    for _ in range(5):
        rows = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30)))
        head = np.zeros(len(rows), suffix_dedup.HEAD)
        head["size"], head["lcp"] = [len(r) for r in rows], suffix_dedup.shared_prefix(rows)
        data = b"".join(r[k:] for r, k in zip(rows, head["lcp"].tolist()))
        import zstandard

        runs.append((rows, suffix_dedup.Run(head.tobytes(), zstandard.compress(data))))
    _, shared, out = suffix_dedup.merge([r for _, r in runs])
    assert out == sorted(x for rows, _ in runs for x in rows)
    assert shared[1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(out, out[1:])]


# ---- leaks -------------------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (12, 25, 40, 90, 30, 30)]
    clean = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 300))) for _ in range(40)]
    texts, want = list(clean), set()
    for k, item in enumerate(items):
        for edits in (0, 1, 2):
            w = item.upper().split() if edits == 1 else item.split()
            for _ in range(edits * len(w) // 15):
                w[rng.randrange(len(w))] = "changed"
            host = clean[k].split()
            at = rng.randint(0, len(host))
            want.add((len(texts), k))
            texts.append(" ".join(host[:at] + w + host[at:]))
    d = docs(spark, texts + ODD)
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (None, "w1 w2")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leak_search.leaks(d, bench).collect()}
    assert len(want & got) >= 0.9 * len(want) and not got - want
    kept = leak_search.without_leaks(d, bench)
    assert kept.columns == d.columns and kept.count() == len(texts) + len(ODD) - len({i for i, _ in got})
    assert leak_search.leaks(d, bench.filter("false")).count() == 0
    assert leak_search.leaks(d.filter("false"), bench).count() == 0


def test_leaks_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(18)
    items = [" ".join(f"v{rng.randrange(900)}" for _ in range(20)) for _ in range(9)]
    d = docs(spark, [f"start {i} end" for i in items] + ["nothing here"])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    blocks = list(leak_search.item_blocks(bench, 3))
    assert len(blocks) > 1 and sorted(i for b in blocks for i in b.ids) == list(range(9))
    monkeypatch.setattr(leak_search, "item_blocks", lambda b: iter(blocks))
    assert {(r.doc_id, r.item_id) for r in leak_search.leaks(d, bench).collect()} == {(i, i) for i in range(9)}


def test_full_block_of_items_is_found_among_many_documents(spark):
    """4,000 items share a space; copies whole or edited, between words that no item has, are all found."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(3000)]
    draw = lambda n: [vocab[int(3000 * rng.random() ** 3)] for _ in range(n)]
    other = lambda n: [f"o{rng.randrange(5000)}" for _ in range(n)]
    items = [(draw(n := rng.randint(12, 48)), draw(n // 4 + 2)) for _ in range(leak_search.BLOCK)]
    bench = spark.createDataFrame([(i, " ".join(a) + ". " + " ".join(b) + ".") for i, (a, b) in enumerate(items)], "item_id bigint, text string")
    texts = []
    for i, (a, b) in enumerate(items[:600]):
        if i % 2:  # every fourth word of the first sentence is replaced or gone
            a = [w if k % 4 else other(1)[0] for k, w in enumerate(a) if k % 8]
        texts.append(" ".join(other(rng.randint(0, 70)) + a + b + other(rng.randint(0, 70))))
    texts += [" ".join(other(80)) for _ in range(2400)]
    got = {(r.doc_id, r.item_id) for r in leak_search.leaks(docs(spark, texts), bench).collect()}
    assert {(i, i) for i in range(600)} <= got
    assert all(d < 600 for d, _ in got)


def test_candidates_do_not_need_the_space(monkeypatch):
    """Without any cosine, and with few meetings sorted at once, what an exhaustive walk finds is found."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(60 * rng.random() ** 2)}" for _ in range(rng.randint(1, 40)))) for i in range(60)]
    items = leak_search.read_items(rows)
    counts = np.bincount([t for w in items.words for t in set(w)], minlength=len(items.terms) + 1)
    space = leak_search.Space(np.log(100 / (1.0 + counts)), np.zeros((len(counts), 2), np.float32), np.zeros((60, 2), np.float32))
    texts = []
    for k in range(80):
        w = rows[k % 60][1].split()
        cut = [x for x in w if rng.random() > 0.1] or w
        texts.append(" ".join(["o"] * rng.randint(0, 90) + cut + [f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 60))]).encode())
    m = leak_search.Matcher(items, space, 9.0, leak_search.SHARE)
    want = set()
    for d, raw in enumerate(texts):
        words = [items.terms.get(w, 0) for w in raw.split()]
        for i, own in enumerate(items.words):
            n = len(own)
            for a in range(len(words)):
                part = words[a : a + n + n // 4]
                if leak_search.lcs(m.masks[i], n, part) / n >= m.share and len(m.answers[i].intersection(part)) / len(m.answers[i]) >= 0.5:
                    want.add((d, i))
                    break
    for meetings in (1, 50, leak_search.MEETINGS):
        monkeypatch.setattr(leak_search, "MEETINGS", meetings)
        place, item = m.rare_meetings(*(lambda t, s: (t, np.repeat(np.arange(len(s)), s)))(*leak_search.term_numbers(texts, items.terms)))
        ends = np.cumsum([len(x.split()) for x in texts])
        assert want <= {(int(np.searchsorted(ends, p, "right")), int(i)) for p, i in zip(place, item)}
    got = {(d, h["item_id"]) for d, found in enumerate(m(texts)) for h in found}
    assert len(want) > 60 and want <= got


def test_lcs_by_bits():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert leak_search.lcs(masks, len(a), b) == t[-1][-1]


# ---- chats -------------------------------------------------------------------------------------


def test_chat_perspectives(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "anna", "hi"), (1, 2, "bob b<", "hello <|im_end|>"), (1, 2, "bob b<", "hello <|im_end|>"), (1, 3, "anna", None),
        (1, None, None, "first"), (2, 0, "system", "alone"), (None, 5000, "x", "null id"), (None, 1, "x", ""), (3, 7, "", "é漢😀"),
    ]
    rows += [(4, i // 3, f"s{i % 3}", f"turn {i}") for i in range(200)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, segment string")
    got = {}
    for r in chat_format.perspectives(df).collect():
        got.setdefault((r.conv_id, r.perspective), []).append(r)
    speakers = {}
    for c, _, s, _ in rows:
        if s != "system":
            speakers.setdefault(c, set()).add(s or "unknown")
        else:
            speakers.setdefault(c, set())
    assert set(got) == {(c, s) for c, ss in speakers.items() for s in (ss or {None})}
    for (c, s), seg in got.items():
        seg.sort(key=lambda r: r.place)
        mine = [(r[1], r[2] or "unknown", r[3] or "") for r in rows if r[0] == c]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}\n{r[2]}".encode()).hexdigest()))
        assert [r.place for r in seg] == list(range(1, len(mine) + 1))
        text = "".join(r.segment for r in seg)
        want = ""
        for r, (_, who, body) in zip(seg, mine):
            body = body.replace("<|", "< |")
            role = "system" if who == "system" else "assistant" if who == s else "user name=" + "".join(x if x.isalnum() or x in "_.-" else "_" for x in who)
            assert r.start == len(want)
            want += f"<|im_start|>{role}\n{body}<|im_end|>\n"
            assert r.stop == len(want)
            if role == "assistant":
                assert text[r.learn_start : r.learn_stop] == body + "<|im_end|>"
            else:
                assert r.learn_start is None
        assert text == want
    assert chat_format.perspectives(df.filter("false")).count() == 0


# ---- pieces ------------------------------------------------------------------------------------

PIECES = [("<unk>", 0.0, "other")] + [(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)]
PIECES += [(p, s, "normal") for p, s in [("▁", -2.0), ("a", -1.0), ("b", -1.5), ("ab", -2.0), ("▁a", -2.5), ("▁▁", -3.0), ("ba", -2.6), ("aba", -3.5), ("é", -4.0), ("aaaa", -3.0)]]


def small():
    return unigram.build([(p.encode(), s, k) for p, s, k in PIECES], 0)


def plain_best(v, raw):
    """Highest sum over all cuts of a segment with the blank in front."""
    words = {bytes(v.text[v.start[i] : v.start[i + 1]]): s for i, (p, s, k) in enumerate(PIECES) if k == "normal"}
    text = raw.decode()
    best = [0.0] + [-1e18] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 4) + 1):
            w = text[i:j].encode()
            s = words.get(w, v.unknown_score if j == i + 1 else None)
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


@pytest.mark.parametrize("long", [unigram.LONG, 3])
def test_cuts_have_the_largest_sum(monkeypatch, long):
    monkeypatch.setattr(unigram, "LONG", long)
    v, rng = small(), random.Random(3)
    texts = ["".join(rng.choice("aabb é") for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["x▁y", "   ", " a", "b ", "漢😀"]
    enc = unigram.Encoder(v)
    flat, per, bare = enc.encode([t.encode() for t in texts])
    assert unigram.decode(v, flat, per) == [t.encode() for t in texts]
    ends = np.cumsum(per)
    for t, e, n, b in zip(texts, ends.tolist(), per.tolist(), bare.tolist()):
        ids = flat[e - n : e]
        unknown = [c for c in t if c not in "ab é"]
        assert b == sum(len(c.encode()) for c in unknown)
        total = sum(PIECES[i][1] for i in ids if i > 256) + len(unknown) * v.unknown_score
        assert not t or total == pytest.approx(plain_best(v, (" " + t).encode()))


def test_double_array_holds_its_words_only():
    rng = random.Random(4)
    words = sorted({bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randint(1, 7))) for _ in range(800)})
    base, check, piece = unigram.double_array([(w, i) for i, w in enumerate(words)])

    def find(w):
        node = 0
        for c in w:
            t = base[node] + c + 1
            if t >= len(check) or check[t] != node:
                return -1
            node = t
        return piece[node]

    assert [find(w) for w in words] == list(range(len(words)))
    assert all(find(w[:-1] + b"\x7f") == -1 for w in words)


@pytest.mark.skipif(not os.path.exists(unigram.VOCABULARY), reason="no vocabulary file")
def test_encoding_gives_texts_back(spark):
    texts = ["Hello, world", "漢字 ▁ 😀\tx", "  two  blanks ", *ODD]
    d = docs(spark, texts)
    out = unigram.encode_texts(spark, d, ["doc_id"])
    rows = {r.doc_id: r for r in out.collect()}
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in rows.values()) and rows[texts.index("")].ids == []
    back = {r.doc_id: r.text for r in unigram.decode_ids(spark, out, ["doc_id"]).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert unigram.encode_texts(spark, d.filter("false"), ["doc_id"]).count() == 0


# ---- pipeline ----------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    if not os.path.exists(unigram.VOCABULARY):
        pytest.skip("no vocabulary file")
    rng = random.Random(12)
    words = [f"p{i}" for i in range(2000)]
    mk = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = mk(30)
    texts = [mk(60) for _ in range(60)]
    for i in range(0, 30):
        texts[i] = texts[i] + " vermin scoundrel dolt"
    plain = list(texts[30:])
    texts += [plain[0], item + " " + mk(10), mk(20) + " token = 0123456789abcdef0123456789", None, "", mk(5000)]
    d = docs(spark, texts)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage, kept = d, []
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, stage, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(path := f"{tmp_path}/stage{len(kept)}")
        stage = spark.read.parquet(path)
        kept.append({r.doc_id: r.text for r in stage.collect()})
    clean = set(range(30, 60))
    held = {i for i in range(30) if __import__("zlib").crc32(str(i).encode()) % 4 != 2}
    assert clean <= set(kept[0]) and not held & set(kept[0])
    left = set(kept[0])
    assert set(kept[1]) == left - {60, 64}  # the copy of 30, and the empty text beside the null one
    assert set(kept[2]) == set(kept[1]) - {61}
    assert set(kept[3]) == set(kept[2]) and kept[3][62].endswith("<SECRET>")
    assert all(kept[3][i] == kept[2][i] for i in kept[2] if i != 62)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(kept[3]) and all(r.round_trip for r in rows)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")].__len__() == 10 and "pipeline" in names
    assert json.dumps(sorted(entry.oracle_sql()))


# ---- periodic runs of repeated passages ---------------------------------------------------------


def removed_bytes(texts, length):
    """Bytes covered by a string that starts at more than one place, by counting all strings."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone.update(range(i, i + length))
        out.append(len(gone))
    return out


def test_periodic_runs_against_counting(spark, monkeypatch):
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    texts = [word(30) + u * k + word(30) for u in ("a", "ab", "abc", "abcde", "abcdefghij", "aab", "abababac") for k in (39, 40, 41, 45, 13)]
    texts += ["a" * 40, "a" * 39, "ba" * 20, "b" + "a" * 40 + "c", "ab" * 25 + "ba" * 25, "a" * 30 + "b" * 30, "aaab" * 30 + "aab" * 30, "a" * 300, "ab" * 150 + "a" * 100, "z" * 41]
    want = removed_bytes([t.encode() for t in texts], 40)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.repeated_passages(docs(spark, texts), length=40, gram=12).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("unit", [b"a", b"ab", b"the same line again\n", b"0" * 31 + b"\n"])
def test_long_runs_have_few_anchors(unit):
    text = unit * (5_000_000 // len(unit))
    assert len(suffix_dedup.anchors([text])[0]) < 400
    (p, a, b), *_ = suffix_dedup.periodic_runs(np.frombuffer(text, np.uint8), 200)
    assert (p, a, b) == (len(unit), 0, len(text))


def test_more_hot_hashes_than_may_be_listed(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_LISTED", 1)
    texts = [f"{i:03d}" + "q" * 20 + "the same words in every text, long enough to count" + f"{i % 4} and some more of the same kind" for i in range(40)]
    want = removed_bytes([t.encode() for t in texts], 40)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.repeated_passages(docs(spark, texts), length=40, gram=12, hot=2).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_space_of_items_takes_no_documents():
    """Only counts over all documents enter: before, the basis came from 2,000 documents picked by a hash."""
    rng = random.Random(19)
    items = leak_search.read_items([(i, " ".join(f"v{rng.randrange(300)}" for _ in range(25))) for i in range(40)])
    counts = np.array([900, *(rng.randrange(1, 50) for _ in items.terms)])
    a, b = (leak_search.fit_space(items, counts, 900) for _ in range(2))
    assert np.array_equal(a.basis, b.basis) and a.items.shape[0] == 40
    t, block = np.array([0, 3, 5, 0, 0, 7, 7, 2], np.int32), np.array([0, 0, 0, 1, 2, 2, 4, 4])
    want = np.stack([a.basis[t[block == n]].sum(0) for n in range(5)])
    assert np.allclose(leak_search.block_sums(t, block, 5, a.basis), want, atol=1e-5)
