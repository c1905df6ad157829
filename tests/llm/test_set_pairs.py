"""Similar set pairs against all pairs compared one by one."""

import itertools
import random

from lanthorn.llm import set_pairs


def brute(rows, t):
    sets = []
    for universe, side, i, items in rows:
        s = frozenset(x.strip().lower() for x in items or () if x is not None)
        if len(s) >= 3:
            sets.append((universe, side, i, s))
    out = set()
    for a, b in itertools.combinations(sets, 2):
        if a[0] == b[0] and (a[1], a[2]) != (b[1], b[2]) and len(a[3] & b[3]) >= t * len(a[3] | b[3]) - 1e-9:
            x, y = sorted([(a[2], a[1]), (b[2], b[1])])
            out.add((x[1], x[0], y[1], y[0]))
    return out


def test_pairs_against_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(260):
        base = rnd.sample(range(30), rnd.choice([2, 3, 4, 5, 6, 8, 9, 13, 20]))
        items = [f"t{x}" for x in base]
        if i % 3 == 0 and rows:
            items = list(rnd.choice(rows)[3] or ["t1"])
            for _ in range(rnd.randint(0, 2)):
                items[rnd.randrange(len(items))] = f" T{rnd.randrange(60)} "
        rows.append(("u" if i % 5 else "v", "a" if i % 2 else "b", i + (1000 if i % 2 else 0), items))
    rows += [("u", "a", 5000, None), ("u", "a", 5001, []), ("u", "a", 5002, ["x", "X ", None, "y"]), ("u", "a", 5003, ["p", "q", "r"]), ("u", "b", 5004, ["R", "q", "p"])]
    rows += [("u", "a", 6000, [f"z{x}" for x in range(1500)]), ("u", "b", 6001, [f"z{x}" for x in range(400, 1700)])]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "universe string, side string, id long, items array<string>, set_id string")
    members = set_pairs.set_members(df)
    got = {tuple(r) for r in set_pairs.member_pairs(members, set_pairs.similar_classes(members)).collect()}
    assert got == brute(rows, 0.6)
    empty = set_pairs.set_members(df.limit(0))
    assert set_pairs.similar_classes(empty).count() == 0


def test_no_pair_is_lost_by_the_allocation():
    rnd = random.Random(1)
    scheme = set_pairs.Scheme(0.6, 3, 60)
    for turn in range(6000):
        if turn % 50 == 0:  # which tokens are common, from none to nearly all
            share = rnd.random()
            cost = {hash((x, 7)): 10.0 ** rnd.randint(1, 6) for x in range(200) if rnd.random() < share}
        n = rnd.randint(3, 40) if turn % 2 else rnd.randint(3, 6)
        a = {hash((x, 7)) for x in rnd.sample(range(100), n)}
        b = set(a)
        for _ in range(rnd.randint(1, max(1, n // 3))):
            b.discard(rnd.choice(sorted(b))) if rnd.random() < 0.5 and len(b) > 3 else b.add(hash((rnd.randrange(100, 200), 7)))
        if a == b or len(a & b) < 0.6 * len(a | b):
            continue
        x, y = (a, b) if len(a) <= len(b) else (b, a)
        assert set(scheme.probes(sorted(x), cost)) & set(scheme.stored(sorted(y), cost))
