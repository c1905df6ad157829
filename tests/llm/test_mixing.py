"""Mixing: shares, caps and the balance of lengths."""

import random

from lanthorn.llm import mixing


def test_shares_meet_targets(spark):
    rnd = random.Random(4)
    names = ["a"] * 1500 + ["b "] * 600 + ["B"] * 100 + ["c"] * 60 + [None] * 50 + ["other"] * 70
    docs = [(i, s, int(rnd.lognormvariate(5, 1)), 1) for i, s in enumerate(names)] + [(9000, "a", 0, 1), (9001, "a", None, 1)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens int, copies int")
    targets = spark.createDataFrame([("A", 0.3, 1), ("b", 0.5, 3), ("c", 0.15, 2), ("d", 0.05, 4)], "source string, weight double, max_repeat int")
    picked, report = mixing.mix(sized, targets)
    rows, rep = picked.collect(), {r.source: r for r in report.collect()}
    total = sum(n or 0 for _, s, n, _ in docs if s and s.strip().lower() in "abc")
    for s, w, cap in (("a", 0.3, 1), ("b", 0.5, 3)):
        mine = [r for r in rows if r.source == s]
        assert max(r.copies for r in mine) <= cap and min(r.copies for r in mine) >= 1
        assert abs(sum(r.copies * r.n_tokens for r in mine) - w * total) <= max(r.n_tokens for r in mine)
        assert rep[s].reached and rep[s].actual_tokens == sum(r.copies * r.n_tokens for r in mine)
    a = [n for _, s, n, _ in docs if s == "a" and n]
    chosen = [r.n_tokens for r in rows if r.source == "a"]
    assert abs(sum(chosen) / len(chosen) / (sum(a) / len(a)) - 1) < 0.15  # lengths stay as they are
    assert not rep["c"].reached and all(r.copies == 2 for r in rows if r.source == "c")
    assert rep["d"].actual_tokens == 0 and not rep["d"].reached
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    assert {r.source for r in rows} == {"a", "b", "c"}


def test_caps_bind_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "a", 10 + i % 7) for i in range(100)], "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, weight double, max_repeat int")
    picked, report = mixing.mix(docs, targets, total_tokens=2300)
    assert abs(sum(r.copies * r.n_tokens for r in picked.collect()) - 2300) <= 17
    picked, report = mixing.mix(docs, targets, total_tokens=10**6)
    assert {r.copies for r in picked.collect()} == {2}
    picked, report = mixing.mix(docs.limit(0), targets)
    assert picked.count() == 0 and report.count() == 1
    assert mixing.mix(docs, targets.limit(0))[0].count() == 0


def test_dual_with_length_constraint(spark):
    """Where the wanted length differs, the tilt is exponential in it: checked on the solver alone."""
    lengths = spark.createDataFrame([("a", n, 100) for n in range(1, 21)], "source string, n_tokens long, docs long")
    tokens, docs = float(sum(100 * n for n in range(1, 21))), 2000.0
    (a, b) = mixing.solve(lengths, {"a": tokens / 2}, {"a": 1}, {"a": (tokens, docs)})["a"]
    import math

    rates = [min(1.0, math.exp(a + b * (n / (tokens / docs) - 1))) for n in range(1, 21)]
    assert abs(sum(100 * r * n for r, n in zip(rates, range(1, 21))) - tokens / 2) < 1e-3 * tokens
