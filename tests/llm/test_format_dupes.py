"""Format duplicates against a dictionary, and the radix and trie parts alone."""

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lanthorn.llm import canon, format_dupes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=20).map(str.encode), st.integers(0, 99) | st.none(), st.integers(1, 5)), max_size=40))
def test_trie_counts_like_a_dictionary(rows):
    trie, want = format_dupes.Trie(), {}
    for k, i, n in rows:
        trie.add(k, i, n)
        a, b = want.get(k, (None, 0))
        want[k] = (i if a is None else a if i is None else min(a, i), b + n)
    assert {k: (i, n) for k, i, n in trie.terminals()} == want


def test_canonical_texts():
    assert canon.letters_digits("Ｎｇｉｎｘ-²  Straße​") == canon.letters_digits("NGINX 2/STRASSE")
    assert canon.letters_digits(None) == canon.letters_digits(" .-") == ""
    assert canon.letters_digits("é") != canon.letters_digits("e")
    assert canon.pack(["ab", ""]) != canon.pack(["a", "b"])
    assert set(canon.attrs_items(" A = x Y;b=1|| ")) == {"a=xy", "b=1"}


def test_copies_and_members_with_small_buckets(spark):
    rows = [(i, "Hot Name" if i % 3 == 0 else f"n{i % 7}", None, None, ["b", "a"] if i % 2 else ["a", "b", "a"], "x") for i in range(300)]
    rows += [(None, "HOT-NAME", None, None, ["a", "b"], "x"), (1000, None, None, None, None, "x"), (1001, "", "", "", [None], "x"), (1002, "y" * 50_000, None, None, None, "x"), (1003, "Y" * 50_000 + ".", None, None, None, "x")]
    df = spark.createDataFrame(rows, "id int, name string, vendor string, product string, link array<string>, key string")
    keys = format_dupes.record_keys(df, "c", "id", ["name", "vendor", "product", "link"], format_dupes.native_key)
    want = {}
    for i, name, v, p, link, _ in rows:
        want.setdefault(format_dupes.native_key(name, v, p, link), []).append(i)
    parts = format_dupes.partials(keys)
    groups = format_dupes.count_copies(parts, capacity=5, stride=1)
    got = sorted((r.first_id, r.copies) for r in groups.collect())
    first = lambda ids: min(i for i in ids if i is not None)
    assert got == sorted((first(v), len(v)) for v in want.values())
    pairs = {(r.first_id, r.record_id) for r in format_dupes.members(parts, groups).collect()}
    assert pairs == {(first(v), i) for v in want.values() if len(v) > 1 for i in v}
    # a beginning of 50,000 common bytes costs no level per byte, and no bucket of several keys is over the capacity
    placed = format_dupes.radix_buckets(parts, capacity=5, stride=1).groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys")).collect()
    assert all(r.n <= 5 or r["keys"] == 1 for r in placed)
    empty = format_dupes.record_keys(df.limit(0), "c", "id", ["name", "vendor", "product", "link"], format_dupes.native_key)
    assert format_dupes.count_copies(format_dupes.partials(empty)).count() == 0
