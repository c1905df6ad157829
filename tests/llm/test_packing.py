"""Packing: every token once, every constraint kept, whole texts whole, little room left."""

import random

import numpy as np
import pytest

from lanthorn.llm import packing, tokens


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("cap,docs,attention", [(100, 256, 1.0), (100, 3, 1.0), (64, 5, 0.4)])
def test_group_keeps_all_constraints(score, cap, docs, attention):
    rnd = random.Random(cap + docs)
    sizes = np.array([rnd.choice([0, 1, 5, 30, 50, 64, 90, 100, 101, 250, 1000]) for _ in range(400)], float)
    capacity = np.array([cap, docs, attention * cap * cap])
    rows = packing.pack_group(sizes, capacity, least_piece=8, score=score)
    boxes, parts = {}, {}
    for i, start, n, c in rows:
        boxes.setdefault(c, []).append(n)
        parts.setdefault(i, []).append((start, n))
    assert set(parts) == set(range(len(sizes)))
    for i, p in parts.items():
        p.sort()
        assert sum(n for _, n in p) == sizes[i] and all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:])) and p[0][0] == 0
        assert sizes[i] > cap or len(p) == 1
    for b in boxes.values():
        assert sum(b) <= cap and len(b) <= docs
        assert len(b) == 1 or sum(n * n for n in b) <= capacity[2]
    if docs > 100:
        assert len(boxes) <= 1.03 * sizes.sum() / cap + 1


def test_pack_over_a_table(spark):
    rnd = random.Random(2)
    docs = [(i, rnd.choice([0, 10, 700, 1500, 3000, 20_000]), "x") for i in range(500)] + [(7, 10, "x"), (None, 5, "x"), (900, None, "x")]
    items = spark.createDataFrame(docs, "doc_id long, n_tokens int, container_id string")
    specs = spark.createDataFrame([(1, 1024), (2, 8192), (3, None)], "pack_id int, capacity_tokens int")
    out = packing.pack(items, specs, group=100)
    rows = out.collect()
    for pack in (1, 2):
        mine = [r for r in rows if r.pack_id == pack]
        assert sum(r.n_tokens for r in mine) == sum(n or 0 for _, n, _ in docs)
        assert sum(r.piece_no == 0 for r in mine) == len(docs)
        assert all(r.used_tokens + r.unused_tokens == {1: 1024, 2: 8192}[pack] for r in mine)
    rep = {r.pack_id: r for r in packing.report(out, specs).collect()}
    assert rep[2].unused_share < 0.05 and rep[3].containers is None
    assert packing.pack(items.limit(0), specs).count() == 0
    assert packing.pack(items, specs.limit(0)).count() == 0


def test_token_counts(spark):
    texts = [None, "", "a b", "<|endoftext|>", "naïve Füße " * 2000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, ["doc_id"]).collect()}
    bpe = tokens.encoder(tokens.VOCABULARY)
    assert got == {i: len(bpe.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
