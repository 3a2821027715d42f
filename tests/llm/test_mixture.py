import random

import pytest

from waygraph.llm.mixture import Target, mixture, plan, shares, token_counts, tokenizer_file

DOCS, TARGETS = "doc_id long, text string, source string, tokens int", "source string, target_share double, max_repeats int"


def test_plan_is_the_greatest_mixture():
    t = [Target("a", 0.5, 1), Target("b", 0.5, 3)]
    total, flow = plan({0b01: 1000, 0b10: 100}, t)
    assert total == 600 and flow == {(1, 1, 0): 300, (2, 1, 1): 100, (2, 2, 1): 100, (2, 3, 1): 100}
    # texts of both sources go where they are short
    total, flow = plan({0b01: 1000, 0b11: 300}, t)
    assert sum(n for (_, _, s), n in flow.items() if s == 1) == total // 2 == 900
    assert sum(n for (p, r, _), n in flow.items() if (p, r) == (3, 1)) <= 300
    assert plan({}, t) == (0, {})
    assert plan({0b01: 10}, t)[0] == 10  # a source without texts is left out


def test_repeats_come_last():
    total, flow = plan({1: 100, 2: 1000}, [Target("a", 0.1, 5), Target("b", 0.9, 1)])
    assert total in (1110, 1111)
    assert sum(n for (p, r, _), n in flow.items() if p == 1 and r > 1) <= 12


def made(seed):
    rnd = random.Random(seed)
    words = ["court", "appeal", "bond", "tariff", "costs", "ruling"]
    rows = []
    for i in range(600):
        s = rnd.choices(["a", "b", "c", "other", None], [60, 30, 6, 3, 1])[0]
        rows.append((i, " ".join(rnd.choice(words) + str(rnd.randrange(99)) for _ in range(rnd.randrange(3, 40))), s, 0))
    rows += [(1000 + k, rows[k][1], rnd.choice(["a", "b", "c"]), 0) for k in range(120)]  # copies
    return rows + rows[:10] + [(2000, None, "a", 0), (2001, "", "c", 0), (None, "x", "a", 0)]


def test_mixture_meets_shares_and_caps(spark):
    docs = spark.createDataFrame(made(1), DOCS)
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("missing", 0.05, 2), ("zero", 0.0, 3), (None, 0.1, 1)]
    t = spark.createDataFrame(targets + targets[:1], TARGETS)
    m = mixture(docs, t)
    rows = m.collect()
    caps = {"a": 1, "b": 2, "c": 4}
    assert all(1 <= r.uses <= caps[r.source] for r in rows)
    assert len(rows) == len({(r.doc_id, r.source) for r in rows})
    source = {r[0]: r[2] for r in made(1)}
    assert all(source[r.doc_id] == r.source for r in rows)
    total = sum(r.tokens * r.uses for r in rows)
    for name, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert sum(r.tokens * r.uses for r in rows if r.source == name) / total == pytest.approx(share / 0.95, abs=0.02)
    report = {r.source: r for r in shares(m, t).collect()}
    assert set(report) == {"a", "b", "c", "missing", "zero"} and report["missing"].share == 0
    assert sum(r.share for r in report.values()) == pytest.approx(1)
    assert sorted(mixture(docs.repartition(7), t).collect()) == sorted(rows)  # the same whatever the partitions


def test_tokens_and_empty(spark):
    import tiktoken

    docs = spark.createDataFrame(made(2), DOCS)
    from waygraph.llm.mixture import _encoder

    enc = _encoder(tokenizer_file())
    assert isinstance(enc, tiktoken.Encoding)
    for r in token_counts(docs, ["doc_id"], tokenizer_file()).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.tokens == (len(enc.encode_ordinary(r.text)) if r.text else 0)
    t = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixture(docs.limit(0), t).count() == 0 and mixture(docs, t.limit(0)).count() == 0
