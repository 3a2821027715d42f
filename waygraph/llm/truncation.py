"""Texts cut off by a limit of their source's field or in transfer.

Lengths of a source in each unit (characters, characters without trailing marks, bytes) are a
log-normal, right-censored where texts pile up at one length: fitted by maximum likelihood, the fit
says how many texts would have that length by chance, and so with what probability a text of that
length was cut. Its ending adds evidence: a finished sentence, a closing line that many texts end with,
a sentence without its end, a few words of one. What an ending says is estimated from the texts
themselves: every text is cut once more, at a place drawn by its number, so that the endings of texts
that were surely cut are known by source; endings of whole texts are those off the limits, less the
share that transfer must have cut. Both are added as log odds. Lines of page numbers and abbreviations
are learnt as well: the former stand inside texts too, the latter have a number after their full stop.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import written

#: marks that a system puts after a break
_MARK = re.compile("(?:[\\s​⁠﻿\x00-\x1f]|\\.\\.\\.|…|�|\\[(?:\\.\\.\\.|…)\\])$")
#: page numbers in the usual forms; other page lines are learnt
_PAGE = re.compile("[-–—] ?\\d+ ?[-–—]|[\\[(]?(?:[Pp]age|Seite|p\\.|S\\.)? ?\\d+(?: ?(?:of|von|sur|de|/) ?\\d+)?[\\])]?")
_DIGITS = re.compile("\\d+")
_LINES = re.compile("[\r\n]+")
_BLOCK = re.compile("(?:\r\n|\r|\n)[^\\S\r\n]*(?:\r\n|\r|\n)\\s*")
_NUMBER = re.compile("(?:\\[\\d+\\]|\\(?\\d+[.)]|[—–-]|•)\\s+")
_END = re.compile("[.!?][”\"»’')\\]]*$")
#: a short word with a full stop, and the next sign
_DOT = re.compile("(?<=[\\s(\\[])([^\\W\\d_]{1,6})\\.(?=\\s+(\\S))")
_LAST = re.compile("(?:^|[\\s(\\[])([^\\W\\d_]{1,6})\\.$")
#: learnt are lines and abbreviations of this share of texts, of so many at least
LEARN_SHARE, LEARN_LEAST = 2e-4, 3
#: share of an abbreviation's full stops that go on with a number or a small letter; length of a page line
GOES_ON, LEARN_LINE = 0.9, 80
#: an ending without a full stop and of so many words is a sentence that breaks off
LONG_WORDS = 8
#: a shorter one of so many words, or with three in lower case, has the words of a sentence
SHORT_WORDS = 5
#: closing lines are those that this share of all texts, of so many different lengths, end with
CLOSING_SHARE, CLOSING_LEAST = 2e-4, 3
#: a length is a candidate limit with so many texts, this share of its source's, and so many times the usual
LIMIT_LEAST, LIMIT_SHARE, LIMIT_TIMES = 5, 0.002, 6.0
#: weight of all sources' endings in those of one source, and of the overall share cut in transfer, in texts
PRIOR = 50.0
#: times that an ending counts as seen before it is
RARE = 0.1

UNITS = ("chars", "bare", "bytes")
_FEATURES = "doc_id long, source string, chars long, bare long, bytes long, ending string, template string, trial string, trial_template string"


@dataclass(frozen=True)
class Learnt:
    """Templates of page lines, and what stands before a full stop that ends no sentence."""

    pages: frozenset[str] = frozenset()
    short: frozenset[str] = frozenset()

    def page(self, line: str) -> bool:
        bare = _NUMBER.sub("", line, count=1)
        return any(_PAGE.fullmatch(x) or _DIGITS.sub("9", x) in self.pages for x in (line, bare))

    def abbreviation(self, body: str) -> bool:
        m = _LAST.search(body)
        return bool(m) and (len(m[1]) == 1 or m[1] in self.short)


def learn(documents: DataFrame) -> Learnt:
    """Page lines and abbreviations of all texts.

    A page line is short, has a number, ends in no full stop and stands inside texts. An abbreviation
    is a word of up to six letters whose full stop is mostly followed by a number or a small letter, or
    a single letter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            line: Counter[str] = Counter()
            dot: Counter[str] = Counter()
            on: Counter[str] = Counter()
            for t in b.column("text").to_pylist():
                inner = {_NUMBER.sub("", x.strip(), count=1) for x in _LINES.split(t.strip())[:-1] if len(x) <= LEARN_LINE}
                line.update({_DIGITS.sub("9", x) for x in inner if _DIGITS.search(x) and not _END.search(x)})
                for word, sign in _DOT.findall(t):
                    dot[word] += 1
                    on[word] += sign.isdigit() or sign.islower() or sign in "(§"
            rows = [(False, k, n, n) for k, n in line.items()] + [(True, k, n, on[k]) for k, n in dot.items()]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.bool_(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["dot", "key", "n", "goes_on"])

    docs = documents.where(F.length("text") > 0)
    every = docs.count()
    counts = docs.select("text").mapInArrow(run, "dot boolean, key string, n long, goes_on long").groupBy("dot", "key").agg(F.sum("n").alias("n"), F.sum("goes_on").alias("goes_on"))
    found = counts.where((F.col("n") >= max(LEARN_LEAST, LEARN_SHARE * every)) & (F.col("goes_on") >= GOES_ON * F.col("n"))).select("dot", "key")
    # each is in LEARN_SHARE of the texts at least: so many short lines and short words a text over that share
    rows = found.limit(200_001).collect()
    if len(rows) > 200_000:
        raise ValueError("more page lines and abbreviations than can be sent to the tasks")
    return Learnt(frozenset(r.key for r in rows if not r.dot), frozenset(r.key for r in rows if r.dot))


def ending(text: str, learnt: Learnt = Learnt()) -> tuple[str, str | None, int]:
    """(kind, template, characters before trailing marks) of a text's ending.

    kind: closed (a finished sentence), broken (a sentence without its end), fragment or unclear (a
    short last block, with and without the words of a sentence); the last three with a template that
    has X for capitalised words and 9 for numbers.
    """
    s, bare = text, None
    while True:
        n = len(s)
        while n and (m := _MARK.search(s, max(0, n - 5), n)):
            n = m.start()
        s = s[:n]
        bare = n if bare is None else bare
        i = max(s.rfind("\n"), s.rfind("\r")) + 1
        if i and learnt.page(s[i:].strip()):
            s = s[:i]
            continue
        break
    if not s:
        return "closed", None, bare
    start = 0
    for m in _BLOCK.finditer(s, max(0, len(s) - 4000)):
        start = m.end()
    if not start and len(s) > 4000:
        for m in _BLOCK.finditer(s):
            start = m.end()
    body = " ".join(s[start:].split())
    m = _NUMBER.match(body)
    body = body[m.end() :] if m else body
    if _END.search(body):
        return "broken" if learnt.abbreviation(body) else "closed", None, bare
    words = body.split()
    template = None
    if len(words) <= 2 * LONG_WORDS:
        template = re.sub(r"\d+", "9", re.sub("[^\\W\\d_a-zß-ÿ][\\w’'-]+", "X", body))
    lower = sum(w[:1].islower() for w in words)
    return "broken" if len(words) >= LONG_WORDS else "fragment" if lower >= 3 or len(words) >= SHORT_WORDS else "unclear", template, bare


def trial_cut(doc_id: int, text: str) -> str:
    """The text cut at a place between three and nine tenths of it, drawn by its number."""
    n = len(text)
    draw = (doc_id * 0x9E3779B97F4A7C15 >> 20) % (1 << 32)
    return text[: 3 * n // 10 + (draw * (6 * n // 10) >> 32)]


def endings(documents: DataFrame, learnt: Learnt = Learnt()) -> DataFrame:
    """Length and ending of every text that is not null or empty; trial: the ending of the text when it is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            e = [ending(t, learnt) for t in texts]
            trial = [ending(trial_cut(i, t), learnt) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("source"), pa.array([len(t) for t in texts], pa.int64()), pa.array([x[2] for x in e], pa.int64()),
                    b.column("bytes").cast(pa.int64()), pa.array([x[0] for x in e], pa.string()), pa.array([x[1] for x in e], pa.string()), pa.array([x[0] for x in trial], pa.string()), pa.array([x[1] for x in trial], pa.string()),
                ],
                names=["doc_id", "source", "chars", "bare", "bytes", "ending", "template", "trial", "trial_template"],
            )

    docs = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", F.octet_length("text").alias("bytes")).mapInArrow(run, _FEATURES)


def _phi(x: np.ndarray) -> np.ndarray:
    return np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


_erfc = np.vectorize(math.erfc, otypes=[float])


def _upper(x: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(x, dtype=float) / math.sqrt(2))


def censored_normal(x: np.ndarray, count: np.ndarray, cut: np.ndarray) -> tuple[float, float]:
    """(mean, deviation) by maximum likelihood; of rows with cut only `at least x` is known.

    Expectation-maximisation: a cut value is replaced by its mean and variance beyond x.
    """
    n = count.sum()
    mu = float((x * count).sum() / n)
    sd = max(float(np.sqrt((count * (x - mu) ** 2).sum() / n)), 1e-3)
    for _ in range(200):
        z = (x - mu) / sd
        hazard = _phi(z) / np.maximum(_upper(z), 1e-300)
        mean = np.where(cut, mu + sd * hazard, x)
        var = np.where(cut, sd * sd * np.maximum(1 + z * hazard - hazard * hazard, 0), 0)
        new_mu = float((mean * count).sum() / n)
        new_sd = max(float(np.sqrt((count * (var + (mean - new_mu) ** 2)).sum() / n)), 1e-3)
        done = abs(new_mu - mu) < 1e-9 and abs(new_sd - sd) < 1e-9
        mu, sd = new_mu, new_sd
        if done:
            break
    return mu, sd


def _candidates(features: DataFrame) -> DataFrame:
    """(source, unit, length, n): lengths at which a source's texts pile up; at most 1/LIMIT_SHARE a unit."""
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in UNITS])).alias("u")
    by = features.select("source", units).groupBy("source", "u.unit", "u.length").count()
    key = ["source", "unit"]
    around = Window.partitionBy(*key).orderBy("length").rangeBetween(-50, 50)
    total = Window.partitionBy(*key)
    usual = (F.sum("count").over(around) - F.col("count")) / 100
    near = by.withColumn("usual", usual).withColumn("all", F.sum("count").over(total))
    return near.where((F.col("count") >= LIMIT_LEAST) & (F.col("count") >= LIMIT_SHARE * F.col("all")) & (F.col("count") >= LIMIT_TIMES * F.col("usual"))).select(
        *key, "length", F.col("count").alias("n")
    )


def _small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else joined by shuffle."""
    df = written(df, "small")
    return F.broadcast(df) if df.count() <= rows else df


def _limits(features: DataFrame) -> DataFrame:
    """(source, unit, length, chance): candidate limits with the probability that a text there was cut.

    One fit a source and unit, over the texts' lengths in that unit.
    """
    found = _small(_candidates(features))
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in UNITS])).alias("u")
    by = features.select("source", units).where("u.length > 0").groupBy("source", "u.unit", "u.length").agg(F.count("*").alias("k"))
    key = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["unit"] == b["unit"])
    at = found.select("source", "unit", "length", F.lit(True).alias("at"))
    near = by.join(at, key(by, at) & (by["length"] == at["length"]), "left").select(by["source"], by["unit"], by["length"], "k", F.coalesce("at", F.lit(False)).alias("cut"))
    bins = near.groupBy("source", "unit", F.floor(F.log("length") * 50).alias("bin"), "cut").agg(F.sum("k").alias("k"), (F.sum(F.log("length") * F.col("k")) / F.sum("k")).alias("x"))

    def fit(key, frame):
        import pandas as pd

        mu, sd = censored_normal(frame["x"].to_numpy(), frame["k"].to_numpy().astype(float), frame["cut"].to_numpy())
        return pd.DataFrame({"source": [key[0]], "unit": [key[1]], "mu": [mu], "sd": [sd], "texts": [int(frame["k"].sum())]})

    # a row a fiftieth of a log unit: some hundred a group
    fits = bins.groupBy("source", "unit").applyInPandas(fit, "source string, unit string, mu double, sd double, texts long")

    def chance(frames):
        for x in frames:
            mu, sd, n = x["mu"].to_numpy(), x["sd"].to_numpy(), x["length"].to_numpy()
            expected = x["texts"].to_numpy() * (_upper((np.log(n - 0.5) - mu) / sd) - _upper((np.log(n + 0.5) - mu) / sd))
            x["chance"] = np.clip(1 - expected / x["n"].to_numpy(), 0.0, 0.999)
            yield x[["source", "unit", "length", "chance"]]

    both = found.join(fits, key(found, fits)).select(found["source"], found["unit"], "length", "n", "mu", "sd", "texts")
    return both.mapInPandas(chance, "source string, unit string, length long, chance double")


KINDS = ("closed", "closing", "broken", "fragment", "unclear")


def ending_odds(cut: np.ndarray, whole: np.ndarray, all_cut: np.ndarray, all_whole: np.ndarray) -> tuple[float, np.ndarray]:
    """(share cut in transfer, log odds of each of KINDS) of one source.

    cut, whole: counts of endings of its texts when cut on trial, and of its texts off the limits;
    all_cut, all_whole: those of all sources. Whole texts don't end in a broken sentence, so the
    broken ones off the limits tell the share that transfer cut. Of the other endings, whole texts
    account for what is beyond that share's by more than three deviations, in the source or overall.
    """
    broken = KINDS.index("broken")

    def rates(cut: np.ndarray, whole: np.ndarray, weight: float, base: np.ndarray, base_share: float) -> tuple[float, np.ndarray, np.ndarray]:
        p = (cut + weight * base) / (cut.sum() + weight)
        n = whole.sum()
        share = min(0.5, (whole[broken] / max(p[broken], 0.05) + weight * base_share) / (n + weight))
        more = np.maximum(whole - share * p * n - 3 * np.sqrt(whole), 0)
        more[broken] = 0
        least = np.where(np.arange(len(KINDS)) == broken, RARE, 0.5)
        return share, p, (more + least) / (n + 1)

    flat = np.full(len(KINDS), 1 / len(KINDS))
    every_share, every_p, every_q = rates(all_cut, all_whole, 1.0, flat, 0.0)
    share, p, q = rates(cut, whole, PRIOR, every_p, every_share)
    # the floor of a small source says little: overall rates hold unless the source shows more
    floor = 0.5 / (whole.sum() + 1)
    return share, np.log(p) - np.log(np.where(q > floor, np.maximum(q, every_q), every_q))


def _odds(f: DataFrame) -> DataFrame:
    """(source, share, says): share cut in transfer and log odds of each ending, by source."""
    count = lambda c, k, on: F.count(F.when((F.col(c) == k) & on, 1)).cast("double").alias(f"{c}_{k}")
    off = F.col("limit").isNull()
    by = f.groupBy("source").agg(*[count("trial", k, F.lit(True)) for k in KINDS], *[count("kind", k, off) for k in KINDS])
    # a row a source
    total = by.agg(*[F.sum(c).alias(f"all_{c}") for c in by.columns[1:]])

    def solve(frames):
        for x in frames:
            of = lambda c: x[[f"{c}_{k}" for k in KINDS]].to_numpy()
            rows = [ending_odds(*r) for r in zip(of("trial"), of("kind"), of("all_trial"), of("all_kind"), strict=True)]
            x["share"] = [r[0] for r in rows]
            x["says"] = [list(map(float, r[1])) for r in rows]
            yield x[["source", "share", "says"]]

    return by.crossJoin(F.broadcast(total)).mapInPandas(solve, "source string, share double, says array<double>")


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, ending, limit_unit, limit_length, odds, cut) of every text that is not null or empty.

    odds are the log odds that the text was cut; cut is odds > 0 where the text doesn't end in a
    finished sentence or a closing line. limit_* name the candidate limit the text's length meets, null
    if none. Null and empty texts and null doc_ids give no row; a null source is a source of its own;
    repeated rows of a doc_id count once. Extra columns are ignored.
    """
    features = written(endings(documents, learn(documents)).dropDuplicates(["doc_id"]), "endings")
    n = features.count()
    # copies of a text have its length, so lengths are counted, not texts
    lengths = features.where("template is not null").groupBy("template", "chars").count().groupBy("template").agg(F.count("*").alias("lengths"))
    trials = features.where("trial_template is not null").groupBy(F.col("trial_template").alias("template")).agg(F.count("*").alias("trials"))
    seen = lengths.join(trials, "template", "left").fillna(0, ["trials"]).where("lengths > 1 or trials > 0")
    often = F.col("lengths") >= max(CLOSING_LEAST, CLOSING_SHARE * n)
    # what other texts end with, against what texts cut on trial end with
    again = F.log((F.col("trials") + RARE) / (F.col("lengths") - 1 + RARE))
    f = features.join(_small(seen.select("template", often.alias("often"), again.alias("again"))), "template", "left")
    kind = F.when(F.coalesce("often", F.lit(False)), "closing").otherwise(F.col("ending"))
    limits = _limits(features).groupBy("source").agg(F.collect_list(F.struct("chance", "unit", "length")).alias("limits"))
    limits = _small(limits)
    f = f.alias("f").join(limits.alias("l"), F.col("f.source").eqNullSafe(F.col("l.source")), "left").select("f.*", "limits", kind.alias("kind"))
    own = lambda u: F.when(u == "chars", F.col("chars")).when(u == "bare", F.col("bare")).otherwise(F.col("bytes"))
    # a limit in bytes is cut back to a whole character: up to three bytes less
    meets = lambda x: (x["length"] >= own(x["unit"])) & (x["length"] - own(x["unit"]) <= F.when(x["unit"] == "bytes", 3).otherwise(0))
    f = f.withColumn("limit", F.array_max(F.filter("limits", meets)))
    says = _small(_odds(f))
    f = f.alias("f").join(says.alias("o"), F.col("f.source").eqNullSafe(F.col("o.source")), "left").select("f.*", "share", "says")
    p = F.greatest(F.coalesce(F.col("limit.chance"), F.lit(0.0)), F.col("share"))
    odds = F.log(p / (1 - p)) + F.element_at("says", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int"))
    odds = odds + F.coalesce("again", F.lit(0.0))
    inside = ~F.col("kind").isin("closed", "closing")
    return f.withColumn("odds", odds).select(
        "doc_id", "source", F.col("kind").alias("ending"), F.col("limit.unit").alias("limit_unit"), F.col("limit.length").alias("limit_length"), "odds", (inside & (F.col("odds") > 0)).alias("cut")
    )


def truncation_rates(scored: DataFrame) -> DataFrame:
    """(source, texts, cut, at_limit, rate): how often each source truncates."""
    return scored.groupBy("source").agg(
        F.count("*").alias("texts"), F.count(F.when(F.col("cut"), 1)).alias("cut"), F.count(F.when(F.col("cut") & F.col("limit_unit").isNotNull(), 1)).alias("at_limit")
    ).withColumn("rate", F.col("cut") / F.col("texts"))
