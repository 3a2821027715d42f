import random

import numpy as np
import pytest

from waygraph.llm.truncation import KINDS, Learnt, censored_normal, ending, ending_odds, learn, truncated, truncation_rates

SCHEMA = "doc_id long, text string, source string, ending string"
BODY = "HIGH COURT\nDocket X\n\nHEADNOTE\n— The court held the bond.\n\n1. The lease was correctly upheld by the court in its view."


@pytest.mark.parametrize(
    "tail,kind",
    [
        ("", "closed"), ("\n\n2. It was plainly said that “order to stand.”", "closed"), ("\n\nPage 3\nAB-1999-0001234\n", "closed"),
        ("\n\n- 4 -\n\n", "closed"), ("...", "closed"), ("\n\n2. The harbour was then leased to the tenant of the qua", "broken"),
        ("\n\n2. The harbour was then leased to the tenant of the\n\nPage 2\nAB-1999-0001234", "broken"),
        ("\n\n2. The harbour was then leased to the tenant of the…", "broken"), ("\n\n2. The harbour was then leased to the t�", "broken"),
        ("\n\n2. The harbour was then leased to him ; see Re Axe (1938) 81 Rg. 695, para.", "broken"), ("\n\n2. Neither the defence nor the min", "fragment"),
        ("\n\n2. Had the", "unclear"), ("\n\nStenburg", "unclear"), ("\n\n4. Page 8 of 10", "closed"), ("\n\nhalf a line that goes on and on\nand then sto", "broken"),
    ],
)
def test_endings(tail, kind):
    assert ending(BODY + tail, Learnt(frozenset({"AB-9-9"}), frozenset({"para"})))[0] == kind


def test_censored_fit_recovers_the_lengths():
    rng = np.random.default_rng(1)
    x = rng.normal(7.5, 0.4, 20_000)
    limit = 7.7
    cut = x > limit
    mu, sd = censored_normal(np.minimum(x, limit), np.ones(len(x)), cut)
    assert abs(mu - 7.5) < 0.02 and abs(sd - 0.4) < 0.02


def made(seed):
    rnd = random.Random(seed)
    words = "the court held that lease bond harbour tenant was upheld against its former carrier and clerk".split()
    sentence = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(8, 16))).capitalize() + "."
    rows, cut = [], set()
    for i in range(1500):
        n = max(1, int(rnd.lognormvariate(1.6, 0.5)))
        t = "\n\n".join(f"{k + 1}. {sentence()} {sentence()}" for k in range(n)) + rnd.choice(["", "\n\nCosts reserved", "\n\nStenburg", "\n\nReasons to follow ..."])
        s = rnd.choices(["x", "y", "z", None], [6, 3, 3, 1])[0]
        if s == "x" and len(t) > 900 and t[:900].rstrip()[-1] not in ".":
            body = t[:900]
            if body.rsplit("\n\n", 1)[-1][:1].isdigit() and len(body.rsplit("\n\n", 1)[-1].split()) > 5:
                t = body
                cut.add(i)
        elif s == "z" and rnd.random() < 0.1:
            k = rnd.randrange(len(t) // 2, len(t))
            last = t[:k].rsplit("\n\n", 1)[-1]
            if last[:1].isdigit() and len(last.split()) > 5 and last.rstrip()[-1] != ".":
                t = t[:k] + rnd.choice(["", "...", "…", "\n\n- 2 -"])
                cut.add(i)
        rows.append((i, t, s, "x"))
    return rows + rows[:9] + [(5000, None, "x", ""), (5001, "", "x", ""), (None, "Half a", "x", "")], cut


def test_cut_texts_are_found(spark):
    rows, cut = made(3)
    scored = truncated(spark.createDataFrame(rows, SCHEMA)).cache()
    got = scored.collect()
    assert len(got) == len({r.doc_id for r in got}) == 1500
    assert {r.doc_id for r in got if r.cut} == cut
    assert {(r.limit_unit, r.limit_length) for r in got if r.cut and r.source == "x"} <= {("chars", 900), ("bare", 900), ("bytes", 900), ("bare", 899), (None, None)}
    rates = {r.source: r for r in truncation_rates(scored).collect()}
    assert rates["y"].cut == 0 and rates["x"].at_limit > 0.9 * rates["x"].cut and None in rates


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, ("1. A sentence of the court.\n\n" * 100_000) + "2. And a sentence that simply breaks off in the mid", "x", "")], SCHEMA)
    assert [(r.doc_id, r.cut) for r in truncated(df).collect()] == [(1, True)]
    assert truncated(df.limit(0)).count() == 0


def test_page_lines_and_abbreviations_are_learnt(spark):
    page = "1. The court held the lease, see para. 4 and s. 9. It was upheld.\n\nRegister 17, folio {}\n\n2. The bond was void. No. 7 was not, said A. Axe."
    rows = [(i, page.format(i), "x", "") for i in range(50)] + [(99, None, "x", ""), (98, "", None, "")]
    got = learn(spark.createDataFrame(rows, SCHEMA))
    assert got == Learnt(frozenset({"Register 9, folio 9"}), frozenset({"para", "s", "No"}))
    broken = "1. The lease was held to be\n\nRegister 3, folio 9"
    assert ending(broken)[0] == "unclear" and ending(broken, got)[0] == "fragment" and ending("1. The lease.\n\nRegister 3, folio 9", got)[0] == "closed"
    assert learn(spark.createDataFrame(rows[-2:], SCHEMA)) == Learnt()


def test_odds_follow_the_texts():
    cut = np.array([2.0, 0, 80, 15, 3])
    share, says = ending_odds(cut, np.array([900.0, 90, 8, 2, 0]), cut, np.array([900.0, 90, 8, 2, 0]))
    assert 0.005 < share < 0.02 and all(np.log(share / (1 - share)) + says[KINDS.index(k)] > 0 for k in ("broken", "fragment"))
    # where many whole texts end in a fragment, one says little
    share, says = ending_odds(cut, np.array([600.0, 90, 8, 300, 2]), cut, np.array([600.0, 90, 8, 300, 2]))
    assert np.log(share / (1 - share)) + says[KINDS.index("fragment")] < 0 < np.log(0.99 / 0.01) + says[KINDS.index("fragment")]


def test_the_limit_decides_where_the_ending_does_not(spark):
    """A source whose whole texts end in a few words that are each time new: cut are those at its limit."""
    rnd = random.Random(8)
    words = "the court held that lease bond harbour tenant was upheld against its former carrier and clerk".split()
    sentence = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(8, 16))).capitalize() + "."
    rows, at_limit = [], set()
    for i in range(1200):
        t = "\n\n".join(f"{k + 1}. {sentence()} {sentence()}" for k in range(max(1, int(rnd.lognormvariate(1.6, 0.5)))))
        t += "\n\nread " + " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(5))
        if len(t) > 900:
            t = t[:900]
        kind = ending(t)[0]
        if len(t) == 900 and kind == "fragment":
            at_limit.add(i)
        rows.append((i, t, "x", ""))
    got = {r.doc_id: r for r in truncated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(at_limit) > 20
    assert all(got[i].cut for i in at_limit)
    off = [r for r in got.values() if r.limit_length is None and r.ending == "fragment"]
    assert len(off) > 500 and not any(r.cut for r in off)
