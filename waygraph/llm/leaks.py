"""Passages of evaluation items inside documents.

Documents and items are cut into windows of two kinds: `width` words, the length from which a shared
passage counts, and item-sized windows, the largest of a ladder of widths that an item holds (three
quarters of it at least), at steps of four words. Every window has a 64-bit SimHash of its words, made by bit-sliced counting
over the whole word stream. The same few words (articles, prepositions) come again and again and would
make all windows alike; so a passage counts its words in threes, and in item-sized windows words that
are common among the items count together with the one or two before them. Fingerprints that differ in at most `radius` bits agree in one of four
blocks up to radius // 4 bits; an item window is entered in each block's table under all keys that
near, so one lookup a block finds all item windows within the radius. One to three changed words move
few bits of an item-sized window, so its radius holds them; one word in thirteen moves many, so of
`width` words the radius finds the same words and few others. Pairs of similar passages are found by
their shingles as well: a window pair of similarity s shares a weight of at least s times that of
either window, so it shares one of the item window's heaviest shingles that together weigh more than
1 - s of it, and at most 1 - s of the document window's shingles occur in no item. Candidates are then
compared exactly: similarity of their weighted shingles, and whether all words are the same in the
same order.

Only the item windows (a stated query set) are sent to the tasks; documents are read once and not
shuffled. More items than one block holds are searched in several blocks of items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import written

WIDTH = 13
RADIUS = 3
#: radius of item-sized windows: 1 to 3 changed words among 51 to 139 move 4 bits on average
ITEM_RADIUS = 7
BLOCKS = 4
#: item-sized windows of an item start at every so many words, and the last at its end
STEP = 4
#: words of this share of the items and more count together with the words before them
COMMON = 0.02
SHINGLE = 5
SIMILAR = 0.8
#: item words searched for at a time; the index sent to a worker has some 170 bytes a word
BLOCK_WORDS = 200_000
#: words of documents handled at a time in a task
SLICE_WORDS = 1 << 18
#: pairs of windows that share a shingle, handled at a time
PAIRS = 1 << 20
#: similarities are rounded to so many digits, so that sums in another order don't fall below the limit
DIGITS = 12

_OUT = "doc_id long, item_id long, exact_windows long, similarity double, item_similarity double"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words: longest sequences of letters and digits, in lower case."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two numbers given as bit planes."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], None
    for i, x in enumerate(a):
        y = b[i] if i < len(b) else None
        terms = [t for t in (x, y, carry) if t is not None]
        if len(terms) == 1:
            out.append(terms[0])
            carry = None
        elif len(terms) == 2:
            out.append(terms[0] ^ terms[1])
            carry = terms[0] & terms[1]
        else:
            p = terms[0] ^ terms[1]
            out.append(p ^ terms[2])
            carry = (terms[0] & terms[1]) | (p & terms[2])
    if carry is not None:
        out.append(carry)
    return out


def simhash_windows(words: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every window of `width` (odd) successive words; len(words) - width + 1 values."""
    return next(simhash_widths(words, [width]))


def simhash_widths(words: np.ndarray, widths: list[int]) -> Iterator[np.ndarray]:
    """SimHash of every window, width by width; sums over 1, 2, 4 ... words are shared."""
    powers = [[words]]
    for width in widths:
        n = len(words) - width + 1
        if n <= 0:
            yield np.empty(0, "u8")
            continue
        while 2 ** len(powers) <= width:
            half, planes = 2 ** (len(powers) - 1), powers[-1]
            m = len(planes[0]) - half
            powers.append(_add([p[:m] for p in planes], [p[half : half + m] for p in planes]))
        total: list[np.ndarray] = []
        done = 0
        for k, planes in enumerate(powers):
            if width >> k & 1:
                part = [p[done : done + n] for p in planes]
                total = _add(total, part) if total else part
                done += 2**k
        # bit set where the count is more than width // 2
        need = width // 2 + 1
        above = np.zeros(n, "u8")
        same = np.full(n, np.iinfo("u8").max, "u8")
        for i in reversed(range(len(total))):
            if need >> i & 1:
                same &= total[i]
            else:
                above |= same & total[i]
                same &= ~total[i]
        yield above | same


def triples(words: np.ndarray) -> np.ndarray:
    """Hashes of three successive words."""
    k = np.uint64(0x9E3779B97F4A7C15)
    h = words[:-2].copy()
    for w in (words[1:-1], words[2:]):
        h = (h ^ w) * k
        h ^= h >> np.uint64(32)
    return h * k


def item_width(words: int, least: int) -> int:
    """The largest of the widths 4, 5 or 6 times a power of two, and one, that is at most `words`; never below `least`."""
    k = max(words - 1, 4).bit_length() - 3
    return max(least, (min(max(words - 1, 4) >> k, 6) << k) + 1)


class Windows:
    """Windows of one width with a lookup table for each block of the fingerprint."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]], width: int, radius: int, features: Callable[[np.ndarray], np.ndarray] = np.asarray, span: int = 1, step: int = 1):
        """items: (number, id, words), each of at least `width` words; features: what is counted, each of `span` words."""
        self.width, self.radius = width, radius
        starts = [np.unique(np.append(np.arange(0, len(w) - width + 1, step), len(w) - width)) for *_, w in items]
        rows = [np.lib.stride_tricks.sliding_window_view(w, width)[at] for (*_, w), at in zip(items, starts, strict=True)]
        sizes = [len(r) for r in rows]
        self.numbers = np.repeat(np.array([n for n, *_ in items], "i8"), sizes)
        self.ids = np.repeat(np.array([i for _, i, _ in items], "i8"), sizes)
        self.words = np.concatenate(rows) if rows else np.empty((0, width), "u8")
        self.prints = np.concatenate([simhash_windows(features(w), width - span + 1)[at] for (*_, w), at in zip(items, starts, strict=True)]) if items else np.empty(0, "u8")
        bits = 64 // BLOCKS
        # all keys of a block that differ in at most radius // BLOCKS bits
        flips = [sum(1 << b for b in c) for k in range(radius // BLOCKS + 1) for c in combinations(range(bits), k)]
        self.tables = []
        for b in range(BLOCKS):
            key = (self.prints >> np.uint64(b * bits)) & np.uint64((1 << bits) - 1)
            key = (key[:, None] ^ np.array(flips, "u8")).ravel()
            order = np.argsort(key, kind="stable")
            first = np.searchsorted(key[order], np.arange((1 << bits) + 1, dtype="u8")).astype("i4")
            self.tables.append((np.uint64(b * bits), np.uint64((1 << bits) - 1), (order // len(flips)).astype("i4"), first))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window) pairs within the radius, each once."""
        found = [np.empty(0, "i8")]
        for shift, mask, order, first in self.tables:
            key = ((prints >> shift) & mask).astype("i4")
            lo = first[key]
            n = first[key + 1] - lo
            at = np.flatnonzero(n)
            k = n[at]
            doc = np.repeat(at, k)
            item = order[np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[at], k)]
            ok = np.bitwise_count(prints[doc] ^ self.prints[item]) <= self.radius
            found.append(doc[ok].astype("i8") << 32 | item[ok])
        pairs = np.unique(np.concatenate(found))
        return pairs >> 32, pairs & 0xFFFFFFFF


class ItemIndex:
    """Windows of the items, weights of their shingles, and passages by their heaviest shingles."""

    def __init__(self, items: list[tuple[int, np.ndarray]], width: int, radius: int, shingle: int, similar: float = SIMILAR, item_radius: int = ITEM_RADIUS):
        self.width, self.shingle, self.similar = width, shingle, similar
        long = [(number, item, w) for number, (item, w) in enumerate(items) if len(w) >= width]
        self.passages = Windows(long, width, radius, triples, 3)
        sized: dict[int, list] = {}
        for x in long:
            sized.setdefault(item_width(len(x[2]), width), []).append(x)
        words, count = np.unique(np.concatenate([np.empty(0, "u8"), *[np.unique(w) for _, w in items]]), return_counts=True)
        self.common = words[count >= COMMON * len(items)]
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[self.common >> np.uint64(48)] = True
        self.whole = [Windows(x, w, item_radius, self.features, step=STEP) for w, x in sorted(sized.items())]
        # weight of a shingle: rarer over the items, heavier
        seen = {s for item, w in items if len(w) >= shingle for s in ((item, int(x)) for x in np.unique(self.shingles(w)))}
        key, count = np.unique(np.array([s for _, s in seen], dtype="u8"), return_counts=True)
        self.shingle_key, n = key, max(1, len({i for i, _ in seen}))
        self.shingle_weight = np.log1p(n / count) if len(key) else np.empty(0)
        self.unseen = float(np.log1p(n))
        self._index_shingles()

    def _index_shingles(self) -> None:
        """Item windows by those of their shingles of which a similar window has one at least."""
        self.known = np.zeros(1 << 20, dtype=bool)
        self.known[self.shingle_key >> np.uint64(44)] = True
        slots, windows = [np.empty(0, "i8")], [np.empty(0, "i8")]
        words = self.passages.words
        for a in range(0, len(words), 50_000):
            s = np.sort(self.shingles(words[a : a + 50_000]), axis=1)
            weight = self.weights(s)
            weight[:, 1:][s[:, 1:] == s[:, :-1]] = 0
            order = np.argsort(-weight, axis=1, kind="stable")
            s, weight = np.take_along_axis(s, order, 1), np.take_along_axis(weight, order, 1)
            total = np.cumsum(weight, axis=1)
            window, k = np.nonzero((weight > 0) & (total - weight <= (1 - self.similar) * total[:, -1:] + 1e-9))
            slots.append(np.searchsorted(self.shingle_key, s[window, k]))
            windows.append(window + a)
        slot = np.concatenate(slots)
        order = np.argsort(slot, kind="stable")
        self.shingle_windows = np.concatenate(windows)[order].astype("i4")
        self.shingle_first = np.searchsorted(slot[order], np.arange(len(self.shingle_key) + 1)).astype("i8")

    def features(self, words: np.ndarray) -> np.ndarray:
        """The words, each common one mixed with the word before it, and the one before that if both are common."""
        common = np.flatnonzero(self.maybe[words >> np.uint64(48)])
        common = common[np.isin(words[common], self.common)]
        k, out = np.uint64(0x9E3779B97F4A7C15), words.copy()
        is_common = np.zeros(len(words) + 2, dtype=bool)
        is_common[common + 2] = True
        before = np.concatenate([np.zeros(2, "u8"), words])
        one, two = before[common + 1], np.where(is_common[common + 1], before[common], 0)
        h = (words[common] ^ (one * k) ^ (one >> np.uint64(31)) ^ (two * k * k) ^ (two >> np.uint64(29))) * k
        out[common] = (h ^ (h >> np.uint64(32))) * k
        return out

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """Hashes of the shingles along the last axis."""
        k = self.shingle
        m = words.shape[-1] - k + 1
        h = np.zeros((*words.shape[:-1], m), "u8")
        for i in range(k):
            h = (h ^ words[..., i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def weights(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shingle_key):
            return np.full(s.shape, self.unseen)
        i = np.minimum(np.searchsorted(self.shingle_key, s), len(self.shingle_key) - 1)
        return np.where(self.shingle_key[i] == s, self.shingle_weight[i], self.unseen)

    def similar_candidates(self, words: np.ndarray, prints: np.ndarray, inside: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item window) pairs beyond the radius, each once: all that can be similar, in parts.

        words: the word stream, prints: of all its windows, inside: which windows may be used.
        """
        m = self.width - self.shingle + 1
        h = self.shingles(words)
        at = np.flatnonzero(self.known[h >> np.uint64(44)])
        k = np.searchsorted(self.shingle_key, h[at])
        ok = k < len(self.shingle_key)
        ok[ok] = self.shingle_key[k[ok]] == h[at[ok]]
        if not ok.any():
            return
        slot = np.full(len(h), -1)
        slot[at[ok]] = k[ok]
        # of an unknown shingle that a window has twice, only the first place counts
        unknown = slot < 0
        for d in range(1, m):
            unknown[d:] &= h[d:] != h[:-d]
        missed = np.append(0, np.cumsum(unknown))
        i = np.flatnonzero(inside & (missed[m:] - missed[:-m] <= (1 - self.similar) * m + 1e-9))
        s = np.lib.stride_tricks.sliding_window_view(slot, m)[i]
        lo = np.where(s < 0, 0, self.shingle_first[s])
        n = np.where(s < 0, 0, self.shingle_first[s + 1] - lo)
        part = np.cumsum(n.sum(axis=1)) // PAIRS
        for at in np.split(np.arange(len(i)), np.flatnonzero(np.diff(part)) + 1):
            size, start = n[at].ravel(), lo[at].ravel()
            doc = np.repeat(np.repeat(i[at], m), size)
            item = self.shingle_windows[np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)]
            far = np.bitwise_count(prints[doc] ^ self.passages.prints[item]) > self.passages.radius
            pairs = np.unique(doc[far].astype("i8") << 32 | item[far])
            yield pairs >> 32, pairs & 0xFFFFFFFF

    def compare(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(same words in order, weighted-shingle similarity) of windows a and b, row by row."""
        same = (a == b).all(axis=1)
        similar = np.ones(len(a))
        rest = np.flatnonzero(~same)
        for at in np.array_split(rest, max(1, len(rest) * a.shape[1] // 500_000)):
            sides = []
            for w in (a[at], b[at]):
                s = np.sort(self.shingles(w), axis=1)
                weight = self.weights(s)
                # a shingle that occurs twice in a window counts once
                weight[:, 1:][s[:, 1:] == s[:, :-1]] = 0
                sides.append((s, weight))
            both, weight = (np.concatenate(x, axis=1) for x in zip(*sides, strict=True))
            order = np.argsort(both, axis=1, kind="stable")
            both, weight = np.take_along_axis(both, order, 1), np.take_along_axis(weight, order, 1)
            # of equal shingles the first of either side carries its weight, those of a come first
            start = np.ones(both.shape, dtype=bool)
            start[:, 1:] = both[:, 1:] != both[:, :-1]
            row = np.arange(len(both))[:, None] * both.shape[1]
            group = np.maximum.accumulate(np.where(start, np.arange(both.shape[1]), 0), axis=1) + row
            mass = np.bincount(group.ravel(), weight.ravel(), both.size).reshape(both.shape)
            one = np.zeros(both.size)
            np.maximum.at(one, group.ravel(), weight.ravel())
            shared = mass - one.reshape(both.shape)
            shared, union = shared.sum(axis=1), one.reshape(both.shape).sum(axis=1)
            similar[at] = shared / np.maximum(union, 1e-12)
        return same, similar


def _search(doc_ids: np.ndarray, n: np.ndarray, words: np.ndarray, index: ItemIndex, similar: float) -> pa.RecordBatch | None:
    width = index.width
    doc = np.repeat(np.arange(len(n)), n)
    found = []

    def rows(windows: Windows, i: np.ndarray, j: np.ndarray, same: np.ndarray, like: np.ndarray, sized: bool) -> np.ndarray:
        """(document, item, same words, similarity of passages, of item-sized windows) of the pairs that count."""
        like = np.round(np.round(like, DIGITS) * 10**DIGITS).astype("i8")
        keep = like >= round(similar * 10**DIGITS)
        keep |= same
        none = np.full(int(keep.sum()), -1)
        return np.stack([doc_ids[doc[i[keep]]], windows.ids[j[keep]], same[keep] & (not sized), none if sized else like[keep], like[keep] if sized else none])

    sizes = [w.width for w in index.whole]
    for a in range(0, len(words) - width + 1, SLICE_WORDS):
        w = words[a : a + SLICE_WORDS + max([width, *sizes]) - 1]
        every = chain(simhash_widths(triples(w), [width - 2]), simhash_widths(index.features(w), sizes) if sizes else ())
        for windows, prints in zip([index.passages, *index.whole], every, strict=True):
            prints = prints[:SLICE_WORDS]
            inside = doc[a : a + len(prints)] == doc[a + windows.width - 1 : a + windows.width - 1 + len(prints)]
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            view = np.lib.stride_tricks.sliding_window_view(w, windows.width)
            i, j = windows.candidates(prints[at])
            i = at[i]
            same = np.zeros(len(i), dtype=bool)
            for part in np.array_split(np.arange(len(i)), len(i) * windows.width // (1 << 22) + 1):
                x, y = i[part], j[part]
                same[part], like = index.compare(view[x], windows.words[y])
                found.append(rows(windows, a + x, y, same[part], like, windows is not index.passages))
            if windows is index.passages:
                # a document that has an item's very words is as similar to it as can be
                copied = np.unique(doc[a + i[same]] << 32 | windows.numbers[j[same]])
                for i, j in index.similar_candidates(w[: len(prints) + width - 1], prints, inside):
                    new = ~np.isin(doc[a + i] << 32 | windows.numbers[j], copied)
                    i, j = i[new], j[new]
                    found.append(rows(windows, a + i, j, *index.compare(view[i], windows.words[j]), False))
    if not found:
        return None
    found = np.concatenate(found, axis=1)
    if not found.size:
        return None
    names = ["doc_id", "item_id", "exact_windows", "similarity", "item_similarity"]
    t = pa.table(dict(zip(names, found, strict=True)))
    t = t.group_by(names[:2]).aggregate([("exact_windows", "sum"), ("similarity", "max"), ("item_similarity", "max")])
    like = [pc.if_else(pc.less(c, 0), None, pc.divide(c.cast(pa.float64()), 10.0**DIGITS)) for c in (t.column("similarity_max"), t.column("item_similarity_max"))]
    return pa.table([t.column("doc_id"), t.column("item_id"), t.column("exact_windows_sum"), *like], names=names).combine_chunks().to_batches()[0]


def leaks(documents: DataFrame, items: DataFrame, width: int = WIDTH, radius: int = RADIUS, shingle: int = SHINGLE, similar: float = SIMILAR, block_words: int = BLOCK_WORDS, item_radius: int = ITEM_RADIUS) -> DataFrame:
    """(doc_id, item_id, exact_windows, similarity, item_similarity): documents holding a window like one of an item's.

    exact_windows counts (document window, item window) pairs of the same `width` words in the same
    order; similarity is the greatest weighted-shingle similarity of any pair of passages,
    item_similarity that of item-sized windows, each null if there is no pair with similarity >=
    similar. Of passages all such pairs are found, of item-sized windows those within item_radius bits.
    Null or empty texts, and texts of fewer than `width` words, match nothing; null ids give no row.
    Texts are searched whole. Repeated rows of a doc_id or item_id count once. Items are the stated
    query set: their words are gathered, block by block of block_words.
    """
    if width % 2 == 0 or width < shingle:
        raise ValueError("width must hold a shingle and be odd, so that no bit of a fingerprint is a tie")
    spark = documents.sparkSession
    queries = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", word_hashes(F.col("text")).alias("w"))
    hashed = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", word_hashes(F.col("text")).alias("w"))

    def blocks() -> Iterator[list[tuple[int, np.ndarray]]]:
        block, size = [], 0
        for row in queries.toLocalIterator():
            words = np.array(row.w, dtype="i8").view("u8")
            if size + len(words) > block_words and block:
                yield block
                block, size = [], 0
            block.append((int(row.item_id), words))
            size += len(words)
        yield block

    def search(documents: DataFrame, block: list[tuple[int, np.ndarray]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(ItemIndex(block, width, radius, shingle, similar, item_radius))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                w = b.column("w")
                n = pc.fill_null(w.value_lengths(), 0).to_numpy(zero_copy_only=False).astype("i8")
                out = _search(b.column("doc_id").to_numpy(), n, w.flatten().to_numpy().view("u8"), index, similar)
                if out is not None:
                    yield out

        return documents.mapInArrow(run, _OUT)

    some = blocks()
    result, following = search(hashed, next(some)), next(some, None)
    if following is not None:
        # several passes: words are hashed once
        hashed = written(hashed, "words")
        while following is not None:
            result = result.unionByName(search(hashed, following))
            following = next(some, None)
    return result.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("exact_windows", "similarity", "item_similarity")])
