import math
import random
import re

import numpy as np
import pytest

from waygraph.llm.leaks import STEP, Windows, item_width, leaks, simhash_widths, simhash_windows

WORD = re.compile(r"[^\W_]+")
DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, suite string, text string"


def brute(docs, items, width=13):
    where = {}
    for i, t in items:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - width + 1):
            where.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - width + 1):
            out |= {(d, i) for i in where.get(tuple(w[k : k + width]), ())}
    return out


def test_simhash_is_the_majority_of_each_bit():
    words = np.random.default_rng(1).integers(0, 2**64, 60, dtype="u8")
    for width in (1, 3, 5, 13, 31):
        got = simhash_windows(words, width)
        for i in range(60 - width + 1):
            bits = [sum(int(w) >> b & 1 for w in words[i : i + width]) > width // 2 for b in range(64)]
            assert int(got[i]) == sum(1 << b for b in range(64) if bits[b])
    assert len(simhash_windows(words[:4], 5)) == 0
    for width, got in zip((49, 13, 61), simhash_widths(words, [49, 13, 61]), strict=True):
        assert got.tolist() == simhash_windows(words, width).tolist()


def test_item_sized_windows_hold_three_quarters_of_the_item():
    for n in range(13, 3000):
        w = item_width(n, 13)
        assert w % 2 and w <= n <= 4 / 3 * w


@pytest.mark.parametrize("radius", [0, 1, 3, 7])
def test_no_fingerprint_within_the_radius_is_missed(radius):
    rng = np.random.default_rng(2)
    items = [(i, i, rng.integers(0, 2**64, 20, dtype="u8")) for i in range(30)]
    index = Windows(items, 13, radius)
    prints = index.prints.copy()
    for k in range(len(prints)):
        for b in rng.choice(64, radius, replace=False):
            prints[k] ^= np.uint64(1) << np.uint64(b)
    i, j = index.candidates(prints)
    assert {(k, k) for k in range(len(prints))} <= set(zip(i.tolist(), j.tolist()))


def test_like_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["Éte", "naïve", "ÄRGER", "9"]
    make = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", ",", ".", "\n", "-", "_"]) for _ in range(n))
    items = [(i, make(rnd.randrange(5, 60))) for i in range(20)] + [(50, None), (51, "")]
    docs = []
    for d in range(200):
        t = make(rnd.randrange(0, 80))
        if rnd.random() < 0.4:
            w = WORD.findall((rnd.choice(items)[1] or "") + " x")
            a = rnd.randrange(len(w))
            t += " " + rnd.choice([" ", "; "]).join(w[a : a + rnd.randrange(10, 20)]).upper() + " " + make(9)
        docs.append((d, t))
    docs += [(900, None), (901, ""), (None, items[0][1]), docs[0]]
    d = spark.createDataFrame([(*x, "clash") for x in docs], DOCS)
    i = spark.createDataFrame([(a, "s", b) for a, b in items], ITEMS)
    want = brute([x for x in docs if x[0] is not None], items)
    assert want
    for block in (10**6, 100):
        got = leaks(d, i, block_words=block).where("exact_windows > 0").collect()
        assert len(got) == len(want) and {(r.doc_id, r.item_id) for r in got} == want
        assert all(r.similarity == 1 for r in got)


def test_empty_and_long(spark):
    d = spark.createDataFrame([(1, "a b " * 200_000 + " ".join(f"z{k}" for k in range(13)), "")], DOCS)
    i = spark.createDataFrame([(1, "s", "start " + " ".join(f"z{k}" for k in range(13)))], ITEMS)
    assert [(r.doc_id, r.item_id) for r in leaks(d, i).where("exact_windows > 0").collect()] == [(1, 1)]
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0


def brute_near(docs, items, width=13, shingle=5, similar=0.8):
    """(doc, item) -> greatest similarity of two windows, where it is at least `similar`; from sets of shingles."""
    cut = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    count, windows, holders = {}, [], {}
    for item, text in items:
        w = WORD.findall(text.lower())
        for s in set(cut(w, shingle)):
            count[s] = count.get(s, 0) + 1
        for x in cut(w, width):
            windows.append((item, set(cut(x, shingle))))
            for s in windows[-1][1]:
                holders.setdefault(s, set()).add(len(windows) - 1)
    n = sum(len(WORD.findall(t)) >= shingle for _, t in items)
    weigh = lambda x: math.fsum(math.log1p(n / count.get(s, 1)) for s in x)
    out = {}
    for doc, text in docs:
        for x in cut(WORD.findall(text.lower()), width):
            x = set(cut(x, shingle))
            for j in set().union(*(holders.get(s, ()) for s in x)):
                item, y = windows[j]
                like = round(weigh(x & y) / weigh(x | y), 12)
                if like >= similar:
                    out[doc, item] = max(like, out.get((doc, item), 0))
    return out


def test_near_like_brute_force(spark):
    rnd = random.Random(11)
    make = lambda n, k=5000: [f"w{rnd.randrange(k)}" for _ in range(n)]
    shared = make(30)
    items = [(i, make(rnd.randrange(20, 60)) + shared[: rnd.choice([0, 0, 14, 30])] + make(9)) for i in range(40)]
    items += [(90, ["a", "b"] * 12), (91, make(4)), (92, make(12)), (93, make(1) * 20)]
    docs = []
    for d in range(250):
        w = rnd.choice(items)[1].copy()
        every = rnd.choice([8, 12, 13, 13, 13, 14])
        for k in range(rnd.randrange(every), len(w), every):
            w[k] = f"new{rnd.randrange(10**6)}"
        docs.append((d, make(20) + w + make(20)))
    docs += [(900, ["a", "b"] * 6 + ["c"]), (901, ["q", *["a", "b"] * 5]), (902, make(300, 3)), (903, shared[:12]), (904, ["y", *shared[:12], "z"])]
    docs, items = ([(i, " ".join(w)) for i, w in x] for x in (docs, items))
    want = brute_near(docs, items)
    exact = brute(docs, items)
    assert len(want.keys() - exact) > 50
    d = spark.createDataFrame([(*x, "") for x in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(a, "s", b) for a, b in items], ITEMS)
    got = {(r.doc_id, r.item_id): r for r in leaks(d, i).collect()}
    assert got.keys() == want.keys() | exact
    assert {k for k, r in got.items() if r.exact_windows} == exact
    assert {k: r.similarity for k, r in got.items()} == pytest.approx(want)


def test_recall_of_edited_items(spark):
    """Items of the usual sizes with 1, 2 or 3 words changed: what SimHash alone finds of all similar item-sized windows."""
    rnd = random.Random(5)
    make = lambda n: [f"w{rnd.randrange(20_000)}" for _ in range(n)]
    items = {i: make(rnd.randrange(51, 136)) for i in range(100)}
    docs, edits = {}, {}
    for d in range(600):
        item, m = rnd.randrange(100), rnd.choice([1, 2, 3])
        w = items[item].copy()
        for k in rnd.sample(range(len(w)), m):
            w[k] = f"new{rnd.randrange(10**6)}"
        docs[d], edits[d] = make(30) + w + make(30), (item, m)
    cut = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    count = {}
    for w in items.values():
        for s in set(cut(w, 5)):
            count[s] = count.get(s, 0) + 1
    weigh = lambda x: math.fsum(math.log1p(len(items) / count.get(s, 1)) for s in x)
    want = {}
    for d, (item, m) in edits.items():
        w, k = items[item], item_width(len(items[item]), 13)
        best = 0
        for a in {*range(0, len(w) - k + 1, STEP), len(w) - k}:
            x = set(cut(w[a : a + k], 5))
            for b in range(max(0, 22 + a), 39 + a):  # windows shifted further have too much else
                y = set(cut(docs[d][b : b + k], 5))
                if len(x & y) * 5 >= len(x) * 3:
                    best = max(best, weigh(x & y) / weigh(x | y))
        if best >= 0.8 - 1e-9:
            want[d, item] = (best, m)
    rows = leaks(
        spark.createDataFrame([(d, " ".join(w), "") for d, w in docs.items()], DOCS).repartition(3),
        spark.createDataFrame([(i, "s", " ".join(w)) for i, w in items.items()], ITEMS),
    ).collect()
    got = {(r.doc_id, r.item_id): r.item_similarity for r in rows if r.item_similarity is not None}
    assert got.keys() <= want.keys() and all(got[k] <= want[k][0] + 1e-9 for k in got)
    for m in (1, 2, 3):
        of = [k for k in want if want[k][1] == m]
        assert len(of) >= 20, m
        recall = sum(k in got for k in of) / len(of)
        print(m, len(of), recall)
        assert recall >= 0.9
