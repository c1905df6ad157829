"""Canonical mapping: the join against all pairs, the edit distance against a plain one, and the cases of names."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lanthorn.llm import canonical, prefix_join


def test_index_and_join_against_all_pairs(spark):
    rnd = random.Random(5)
    some = lambda n: {f"t{int(rnd.random() ** 2 * 25)}" for _ in range(rnd.randint(1, n))}
    a = [(rnd.choice("xy"), some(12)) for _ in range(150)]
    b = [(rnd.choice("xy"), some(12), rnd.choice([0, 3, 6])) for _ in range(90)]
    want = {(i, j) for i, (k, x) in enumerate(a) for j, (m, y, most) in enumerate(b) if k == m and len(x & y) >= max(len(x), len(y)) - most and x & y}
    index = prefix_join.Index([(y, m, most) for m, y, most in b])
    got = [(i, j) for i, (k, x) in enumerate(a) for j, s in index.probe(x, k, 6) if abs(s - len(x & b[j][1]) / len(x | b[j][1])) < 1e-9]
    assert sorted(got) == sorted(want)
    side = "id int, k string, most int, size int, tokens array<bigint>"
    left = spark.createDataFrame([(i, k, 6, len(x), prefix_join.hash_order(x)[:7]) for i, (k, x) in enumerate(a)], side)
    right = spark.createDataFrame([(j, k, most, len(y), prefix_join.hash_order(y)[: most + 1]) for j, (k, y, most) in enumerate(b)], side)
    pairs = [(r.l.id, r.r.id) for r in prefix_join.overlap_join(left, right, "k").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) >= want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=7), st.text(alphabet="abc", max_size=7))
def test_edits_against_search(a, b):
    def near(s):
        out = {s}
        for i in range(len(s) + 1):
            out |= {s[:i] + c + s[i:] for c in "abc"} | {s[:i] + s[i + 1 :]} | {s[:i] + c + s[i + 1 :] for c in "abc" if i < len(s)}
            if i + 1 < len(s):
                out.add(s[:i] + s[i + 1] + s[i] + s[i + 2 :])
        return out

    one = near(a)
    d = canonical.edits(a, b, 1)
    assert d == (0 if a == b else 1 if b in one else 2)
    if any(b in near(x) for x in one):
        assert canonical.edits(a, b, 2) <= 2


WORDS = ["stezztrurn", "vrixdront", "flezzcrizz", "plackplong", "flirmskird", "prordtrist", "plerkslird", "spuzzflolm", "skirnstast", "vrestflung", "vrardglazz", "gluldbruzz", "trarkvrux", "spurdgleng"]


def products(spark, kinds, words=WORDS):
    """Two products of different kinds for each word; every kind has several."""
    rows = [(100 * i + j + 1, f"{w.title()} {kinds[(i + 2 * j) % len(kinds)].title()}", f"{w[:4].title()} Labs", ["Storkstirm"] if not i and not j else None) for i, w in enumerate(words) for j in (0, 1)]
    rows += [(9000, "Lonesplint " + kinds[0].title(), "Solo Works", None)]
    return spark.createDataFrame(rows, "canon_id int, canon_name string, vendor string, also_known_as array<string>"), {(n.lower()): c for c, n, *_ in rows}


def test_names(spark):
    listed, ids = products(spark, ["monitor", "cloud", "router"])
    one = lambda w, k: ids[f"{w} {k}"]
    mon, cloud, rtr = one("stezztrurn", "monitor"), one("vrixdront", "cloud"), ids.get("flezzcrizz router")
    cases = {
        "STEZZTRURN_MONITOR": mon, "Monitor, Stezztrurn": mon, "Stezztrurn%20Mon": mon, "Stezztrurn&nbsp;Monitor v2.19 SP2": mon, "Stezztrurn&n-\u200bbsp;Monitor": mon, "Stez Labs Stez\u200bztrurn Moni-tor": mon,
        "stеzztrurn monitor": mon, "Ｓtezztrurn监控": mon, "Storkstrim": mon, "powered by Stezztrurn Monitor": mon, "the Stezztrurn Monitor web ui": mon, "Stezztrurn Monitor 登录": mon, "Steztzruurn Monitor": mon,
        "Vrixdront": 0, "Vrixdront Thermostat": 0, "Vrixdront Cloud-1": cloud, "Flezzcrizz Router-5.19 SP2": rtr, "Flezzcrizz Rtr 5.1": rtr, "Lonesplint": 9000, "Solo Works lonesplint": 9000,
        "Stez Labs": 0, "Stez Labs WebUI": 0, "???": 0, "": 0, None: 0, "x" * 20_000: 0,
    }
    # what the other names teach: a translation, an abbreviation of its own and decorations
    shown = [f"{w} 监控" for w in WORDS if f"{w} monitor" in ids] + [f"powered by {n}" for n in ids] + [f"{n} 登录" for n in ids] + [f"the {n} web ui" for n in ids]
    rows = [(i, n, "clash", i) for i, n in enumerate([*cases, *shown])] + [(1000 + i, "Stezztrurn Monitor", "clash", i) for i in range(50)]
    entries = spark.createDataFrame(rows, "row_id int, name string, text string, kind int")
    for ranked in (prefix_join.RANKED, 0):  # the index in memory and the join by a shuffle
        got = {r.name: r.canon_id for r in canonical.map_entries(entries, listed, ranked).collect()}
        assert {n: got[n] for n in cases} == cases and got["Stezztrurn Monitor"] == mon
        assert not [n for n in shown if not got[n]]
    assert canonical.map_entries(entries, listed).count() == len(rows)
    assert canonical.map_entries(entries.limit(0), listed).count() == 0
    assert {r.canon_id for r in canonical.map_entries(entries, listed.limit(0)).collect()} == {0}


def test_recall_on_another_list(spark):
    """A list of other words, kinds, abbreviations, translations and decorations: nothing of them is known beforehand."""
    rnd = random.Random(9)
    kinds = {"kettle": ["ktl", "水壶"], "heater": ["htr", "加热器"], "radio": ["rdo", "收音机"], "freezer": ["frz", "冷柜"], "toaster": ["tst", "烤面包机"]}
    words = sorted({"".join(rnd.choice("bcdfghklmnprstvz") + rnd.choice("aeiou") for _ in range(5)) for _ in range(60)})
    listed, ids = products(spark, list(kinds), words)
    names, want = [], {}
    for full, cid in ids.items():
        w, k = full.rsplit(" ", 1)
        i = rnd.randrange(len(w) - 1)
        forms = [full.upper(), w + k, f"{w}_{kinds[k][0]}", w + kinds[k][1], f"{k} {w}", f"{full} deluxe", f"new {full}", f"{full} v{rnd.randint(1, 9)}.2", w[:i] + w[i + 1] + w[i] + w[i + 2 :] + " " + k]
        forms += [w[:i] + rnd.choice("xqj") + w[i + 1 :] + " " + k, f"{full[: len(w) + 2]}-{full[len(w) + 2 :]}"]
        for f in forms:
            names.append((f,))
            want.setdefault(f, cid)
    other = [f"{w} {k}" for w in words for k in ("windmill", "bicycle")] + ["".join(rnd.choice("bcdfghklmnprstvz") + rnd.choice("aeiou") for _ in range(5)) + " kettle" for _ in range(200)]
    got = {r.name: r.canon_id for r in canonical.map_names(spark.createDataFrame(names + [(n,) for n in other], "name string"), listed).collect()}
    right = sum(got[n] == c for n, c in want.items())
    assert right >= 0.99 * len(want), [(n, c, got[n]) for n, c in want.items() if got[n] != c][:20]
    assert sum(got[n] != 0 for n in other) <= 0.01 * len(other)


def test_slips_anywhere_in_kind_words(spark):
    listed, ids = products(spark, ["monitor", "cloud", "mail", "shop", "panel"])
    of = lambda k: next((n.split()[0].title(), c) for n, c in ids.items() if n.endswith(" " + k))
    cases = {}
    for k, slips in {"monitor": ["Xonitor", "Omnitor", "Onitor", "Moniter"], "mail": ["Mial", "Mal"], "shop": ["Hsop", "Sop"], "cloud": ["Kloud"], "panel": ["Apnel"]}.items():
        w, c = of(k)
        cases |= {f"{w} {x}": c for x in slips} | {f"{slips[-1]} {w}": c}
    cases |= {"Vrixdront Thermostat": 0}
    names = spark.createDataFrame([(n,) for n in cases], "name string")
    assert {r.name: r.canon_id for r in canonical.map_names(names, listed).collect()} == cases


def test_no_name_within_the_allowed_edits_is_lost(spark):
    listed = spark.createDataFrame([(1, "Abcdefgh", "Mk", None), (2, "Droxdrix", "Mk", None), (3, "Aaaapqrs", "Mk", None)], "canon_id int, canon_name string, vendor string, also_known_as array<string>")
    cases = {"Abzdewgh": 1, "Acbdegfh": 1, "Drzxdriq": 2, "Drzxdyix": 2, "Droqdwix": 2, "Aaaazqys": 3}
    names = spark.createDataFrame([(n,) for n in cases], "name string")
    assert {r.name: r.canon_id for r in canonical.map_names(names, listed).collect()} == cases
    rnd = random.Random(4)
    for _ in range(3000):
        ref = "".join(rnd.choice("abcd") for _ in range(rnd.randint(6, 12)))
        s = list(ref)
        for _ in range(canonical.allowed(ref)):
            i = rnd.randrange(len(s) - 1)
            s[i : i + 2] = rnd.choice([s[i : i + 2][::-1], ["x", s[i + 1]], ["y", *s[i : i + 2]], [s[i + 1]]])
        a, b = canonical.tokens(ref), canonical.tokens("".join(s))
        assert len(a & b) >= max(len(a), len(b)) - canonical.EDIT_TOKENS * canonical.allowed(ref)
