"""Linkage: parsing of evidence, the label model on simulated votes, and links of small tables."""

import random

from lanthorn.llm import canonical, linkage

LEXICON = canonical.Lexicon({x: k for k, o in {"mail": ["ml"], "shop": [], "router": ["rtr"], "lamp": []}.items() for x in (k, *o)}, (), ("webui",))


def test_parsing():
    assert linkage.icon(" -5 ") == -5 and linkage.icon("0xFFFFFFFB") == -5 and linkage.icon("4294967291") == -5 and linkage.icon("x") is None
    assert linkage.address("HTTPS://www.a.example/b?x=1") == ("a.example", "b")
    assert linkage.address("//a.example") == linkage.address("a.example/index.html") == ("a.example", "")
    assert linkage.address(None) is None and linkage.address("nothing") is None
    assert linkage.app_evidence("X", "cpe:2.3:a:mk_project:foo_mail:-:*:*:*:*:*:*:*", None, None, LEXICON)[1:4] == ("mail", "foo", "mk")


def test_label_model_recovers_matches():
    rnd = random.Random(6)
    patterns, truth = {}, {}
    for _ in range(20_000):
        m = rnd.random() < 0.3
        def vote(p_match, p_other, silent):
            return 0 if rnd.random() < silent else 1 if rnd.random() < (p_match if m else p_other) else -1
        w = vote(0.9, 0.3, 0.1)
        v = (w, w if rnd.random() < 0.8 else vote(0.9, 0.3, 0.3), vote(0.97, 0.1, 0.4), max(0, vote(0.9, 0.05, 0.3)), max(0, vote(0.8, 0.05, 0.5)), vote(0.95, 0.5, 0.2), vote(0.9, 0.4, 0.3))
        patterns[v] = patterns.get(v, 0) + 1
        truth.setdefault(v, [0, 0])[m] += 1
    model = linkage.LabelModel().fit(patterns)
    right = sum(n[model.posterior(v) >= 0.5] for v, n in truth.items())
    assert right / 20_000 > 0.93
    assert any(len(b) == 2 for b in model.blocks)  # the copied votes were found to be dependent


def test_links_of_small_tables(spark):
    native, apps, want = [], [], set()
    for i in range(60):
        w = f"pro{'bcdfghjklm'[i % 10]}a{'npqrstvwxz'[i // 10]}ulo{'bcdfg'[i % 5]}i"
        native.append((i, f"{w.title()} Mail", f"Maker{i % 6}", w.upper(), [f"http://maker{i % 6}.example/{w}"], ["-7", str(1000 + i)]))
        apps.append((1000 + i, f"{w}-mail", f"cpe:/a:maker{i % 6}:{w}" if i % 3 else None, f"https://www.maker{i % 6}.example/{w}/", [1000 + i]))
        apps.append((2000 + i, f"{w} mail", f"cpe:/a:rival{i % 6}:{w}", f"https://rival{i % 6}.example/{w}", []))
        want.add((i, 1000 + i))
    native += [(500, native[0][1], *native[0][2:]), (501, None, None, None, None, None), (502, "", "", "", [], [None])]
    apps += [(5000, None, None, None, None), (5001, "Maker1 Core", "", None, [])]
    want.add((500, 1000))
    l = spark.createDataFrame(native, "finger_id int, name string, vendor string, product string, link array<string>, icons array<string>")  # noqa: E741
    r = spark.createDataFrame(apps, "app_id int, app string, cpe string, website string, icons array<bigint>")
    left, right = linkage.with_evidence(l, linkage.native_evidence, LEXICON), linkage.with_evidence(r, linkage.app_evidence, LEXICON)
    got = {(x.left_id, x.right_id) for x in linkage.link(left, right).collect()}
    assert got == want
    assert linkage.link(left.limit(0), right).count() == 0
    # one key held by most records splits instead of being dropped
    assert {(x.left_rep, x.right_rep) for x in linkage.candidates(linkage.classes(left)[0], linkage.classes(right)[0], max_block=1).collect()} >= {(i, 1000 + i) for i in range(60)}


def test_candidates_do_not_depend_on_the_block_size(spark):
    # a hot word: maker and kind missing on a side, only one of them on each, or of another kind at the same address
    hot = lambda i, side, m, k: (i, "", k, "", m, [], ["hot", f"{side}{i}"], [])
    left = [hot(i, "l", m, k) for i, (m, k) in enumerate([("", ""), ("mk", ""), ("", "mail"), ("mk", "mail"), ("other", "shop")] * 3)]
    right = [hot(100 + i, "r", m, k) for i, (m, k) in enumerate([("", ""), ("mk", ""), ("", "router"), ("third", "mail")] * 2)]
    l, r = (spark.createDataFrame(x, "rep bigint, " + linkage.EVIDENCE) for x in (left, right))  # noqa: E741
    want = sorted((a[0], b[0]) for a in left for b in right)
    for most in (1, 2, 7, 1000):
        assert sorted(map(tuple, linkage.candidates(l, r, max_block=most).collect())) == want


def test_words_that_are_near_share_a_key():
    rnd = random.Random(3)
    slips = [
        lambda w, i: w[:i] + rnd.choice("abc") + w[i:], lambda w, i: w[:i] + w[i + 1 :], lambda w, i: w[:i] + rnd.choice("abc") + w[i + 1 :], lambda w, i: w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :],
    ]
    for _ in range(3000):
        a = b = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 10)))
        for _ in range(rnd.randint(1, 2)):
            b = rnd.choice(slips)(b, rnd.randrange(len(b)))
        if linkage.near(a, b) == 1:
            assert set(linkage.deletions(a)) & set(linkage.deletions(b)), (a, b)
    assert set(linkage.deletions("fitimuta")) & set(linkage.deletions("fitiimtua"))


def made_up(seed, n=400):
    """Two catalogues of n products with slips, gaps, sister products and namesakes of other makers, and the true pairs."""
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(k))
    makers = [word(3) for _ in range(n // 8)]
    slip = lambda w: w[:3] + rnd.choice("xyz") + w[4:] if rnd.random() < 0.15 else w
    some = lambda x, p: x if rnd.random() < p else None
    native, apps, truth = [], [], set()
    for i in range(n):
        w, m, k = word(4), rnd.choice(makers), rnd.choice(["Mail", "Shop", "Router", "Lamp"])
        native.append((i, f"{slip(w)} {k}", some(m, 0.95), some(w, 0.6), some([f"http://{m}.example/{w}"], 0.7), [str(70_000 + i)] if rnd.random() < 0.4 else []))
        if rnd.random() < 0.7:
            apps.append((10_000 + i, f"{slip(w)}-{k}", some(f"cpe:/a:{m}:{w}", 0.7), some(f"https://www.{m}.example/{w}/", 0.8), [70_000 + i] if rnd.random() < 0.5 else []))
            truth.add((i, 10_000 + i))
        if rnd.random() < 0.3:  # a namesake of another maker
            o = rnd.choice([x for x in makers if x != m])
            apps.append((20_000 + i, f"{w} {k}", f"cpe:/a:{o}:{w}", f"https://{o}.example/{w}", []))
        if rnd.random() < 0.5:  # a sister product
            v = word(4)
            apps.append((30_000 + i, f"{m} {v} {k}", f"cpe:/a:{m}:{v}", f"https://{m}.example/{v}", []))
    return native, apps, truth


def judged(spark, seed, n=400):
    native, apps, truth = made_up(seed, n)
    l = spark.createDataFrame(native, "finger_id int, name string, vendor string, product string, link array<string>, icons array<string>")  # noqa: E741
    r = spark.createDataFrame(apps, "app_id int, app string, cpe string, website string, icons array<bigint>")
    left, right = linkage.with_evidence(l, linkage.native_evidence, LEXICON), linkage.with_evidence(r, linkage.app_evidence, LEXICON)
    return linkage.link(left, right, threshold=0.0).collect(), truth


def test_the_model_decides_and_its_confidence_holds(spark):
    found, truth = judged(spark, 11)
    sure = {(x.left_id, x.right_id) for x in found if x.confidence >= 0.5}
    assert len(sure & truth) >= 0.95 * len(truth) and len(sure & truth) >= 0.95 * len(sure)
    # a majority vote takes namesakes of other makers for matches
    major = {(x.left_id, x.right_id) for x in found if sum(x.votes) > 0}
    assert major != sure and len(major - truth) > 3 * len(sure - truth) + 10
    for low, high in ((0.0, 0.1), (0.9, 1.01)):
        own = [((x.left_id, x.right_id) in truth, x.confidence) for x in found if low <= x.confidence < high]
        assert abs(sum(t for t, _ in own) / len(own) - sum(c for _, c in own) / len(own)) < 0.05


def test_words_with_many_makers_are_no_product_words(spark):
    cols = "word string, kind string, product string, maker string, addresses array<string>, paths array<string>, icons array<bigint>"
    rows = [(i, "suite", "", "", f"maker{i}", [], [], []) for i in range(9)] + [(20, "maker3suite", "", "", "", [], [], []), (21, "lonesuite", "", "", "", [], [], []), (22, "tool", "", "", "maker1", [], [], [])]
    d = spark.createDataFrame(rows, "id bigint, " + cols)
    left, right = linkage.without_generic(d.where("id < 15"), d.where("id >= 15"))
    assert {r.id: r.word for r in left.collect()} == dict.fromkeys(range(9), "")
    assert {r.id: r.word for r in right.collect()} == {20: "", 21: "lonesuite", 22: "tool"}
