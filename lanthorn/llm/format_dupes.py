"""Duplicates hidden by formatting: recursive radix partitioning on canonical bytes and counting in tries.

1. Every record becomes (catalog, canonical bytes, id), read and folded once. Each map task folds its rows into (key,
   smallest id, copies, ids) before anything moves, so a record that holds a third of all rows sends one row per map
   task and 100,000 rows.
2. Radix partitioning: the partial rows and their bytes are counted by their first bytes. A bucket over ``CAPACITY`` rows
   or ``CAPACITY_BYTES`` is split by further bytes behind what its keys have in common, again and again, until each fits
   or holds a single key. Prefixes of oversized buckets form a table that is joined back; none reaches the driver.
3. Each bucket goes to one task, which counts its keys in a trie with terminal counters (copies, smallest id).
4. ``members`` joins the partial rows to the terminals of their key, which gives every copy its group.

Keys begin with a hash byte pair of the catalog name and are kept whole, however long.

Defined results: null texts and null sets equal empty ones, so records with nothing in the named fields are copies of
each other. Rows without an id take part with id null and are never a group's first unless all ids are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanthorn.llm import canon
from lanthorn.operators.skew import skew_join
from lanthorn.session import checkpoint, shuffle_partitions

#: Partial rows, and bytes of their keys, that one bucket (one task's trie) may hold.
CAPACITY, CAPACITY_BYTES = 200_000, 64 << 20
#: Bytes by which a bucket is split beyond the common ones.
STRIDE = 2
#: Rows that a map task folds before it sends them on.
FOLD_ROWS = 100_000
#: Rows of a table of prefixes that are broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 100_000


class Trie:
    """Byte trie with edges of up to eight bytes and terminal counters; a branch with one key keeps its rest in one edge."""

    EDGE = 8

    def __init__(self) -> None:
        self.root: dict = {}

    @staticmethod
    def _count(t: list, first: int | None, copies: int) -> None:
        t[2] += copies
        if first is not None and (t[1] is None or first < t[1]):
            t[1] = first

    def add(self, key: bytes, first: int | None, copies: int) -> None:
        node, at = self.root, 0
        while True:
            e = key[at : at + self.EDGE]
            at += self.EDGE
            have = node.get(e)
            if have is None:
                node[e] = [key[at:], first, copies]  # a leaf: what is left of the key, smallest id, copies
                return
            if isinstance(have, list):
                if have[0] == key[at:]:
                    self._count(have, first, copies)
                    return
                # a second key goes this way: the leaf moves one edge down
                rest, *counts = have
                node[e] = have = {rest[: self.EDGE]: [rest[self.EDGE :], *counts]}
            node = have

    def terminals(self) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(b"", self.root)]
        while stack:
            key, node = stack.pop()
            for e, x in node.items():
                if isinstance(x, list):
                    yield key + e + x[0], x[1], x[2]
                else:
                    stack.append((key + e, x))


def tag(catalog: str) -> bytes:
    """First two bytes of all keys of a catalog."""
    return hashlib.blake2b(catalog.encode(), digest_size=2).digest()


def record_keys(df: DataFrame, catalog: str, record_id: str, fields: list[str], key: Callable[..., bytes]) -> DataFrame:
    """(catalog, record_id, key) of a table; ``key`` makes canonical bytes of the values of ``fields``."""
    src = df.select(F.col(record_id).cast("bigint").alias("record_id"), *fields)
    start = tag(catalog)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for values in zip(*(c.to_pylist() for c in b.columns[1:])):
                keys.append(start + key(*values))
            cat = pa.array([catalog] * b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([cat, b.column(0), pa.array(keys, pa.binary())], names=["catalog", "record_id", "key"])

    return src.mapInArrow(run, "catalog string, record_id bigint, key binary")


def partials(keys: DataFrame) -> DataFrame:
    """(key, first_id, copies, ids) folded within each map task, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        rows = 0

        def flush() -> pa.RecordBatch:
            first = [min((i for i in v if i is not None), default=None) for v in held.values()]
            cols = [pa.array(list(held), pa.binary()), pa.array(first, pa.int64()), pa.array(map(len, held.values()), pa.int64()), pa.array(list(held.values()), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names=["key", "first_id", "copies", "ids"])

        for b in batches:
            for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(k, []).append(i)
            rows += b.num_rows
            if rows > FOLD_ROWS:
                yield flush()
                held.clear()
                rows = 0
        if held:
            yield flush()

    return checkpoint(keys.select("key", "record_id").mapInArrow(run, "key binary, first_id bigint, copies bigint, ids array<bigint>"))


def common_length(a: Column, b: Column) -> Column:
    """Number of first bytes that two binary values share."""

    @F.pandas_udf("int")
    def run(x, y):
        import pandas as pd

        def same(p, q):
            n = min(len(p), len(q))
            if p[:n] == q[:n]:
                return n
            lo, hi = 0, n  # the first lo bytes agree, the first hi do not
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if p[:mid] == q[:mid] else (lo, mid)
            return lo

        return pd.Series([same(bytes(p), bytes(q)) for p, q in zip(x, y)], dtype="Int32")

    return run(a, b)


def radix_buckets(parts: DataFrame, capacity: int = CAPACITY, stride: int = STRIDE, capacity_bytes: int = CAPACITY_BYTES) -> DataFrame:
    """``parts`` with ``bucket``: the first bytes of the key, as many as its bucket had to be split by.

    Within an oversized prefix the smallest and the largest key tell what all its keys share; the next split comes
    ``stride`` bytes behind, so a long common beginning costs no level of its own. A key that ends within an oversized
    prefix gets the bucket of its exact bytes.
    """
    placed = parts.withColumn("bucket", F.substring("key", 1, stride))
    while True:
        size = placed.groupBy("bucket").agg(
            F.count("*").alias("n"), F.sum(F.length("key")).alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        over = size.where(((F.col("n") > capacity) | (F.col("bytes") > capacity_bytes)) & (F.col("low") != F.col("high")))
        over = checkpoint(over.select("bucket", (common_length(F.col("low"), F.col("high")) + stride).alias("next")))
        n = over.count()
        if not n:
            return placed
        over = F.broadcast(over) if n <= BROADCAST_ROWS else over
        deeper = F.coalesce(F.substring("key", F.lit(1), F.col("next")), F.col("bucket"))
        placed = placed.join(over, "bucket", "left").withColumn("bucket", deeper).drop("next")


def count_copies(parts: DataFrame, capacity: int = CAPACITY, stride: int = STRIDE) -> DataFrame:
    """(key, first_id, copies), one row per distinct key of the partial rows."""

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, bucket = Trie(), None

        def emit() -> pa.RecordBatch:
            rows = list(trie.terminals())
            kinds = (pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["key", "first_id", "copies"])

        for b in batches:
            for p, k, i, n in zip(*(c.to_pylist() for c in b.columns)):
                if p != bucket:
                    if bucket is not None:
                        yield emit()
                    trie, bucket = Trie(), p
                trie.add(k, i, n)
        if bucket is not None:
            yield emit()

    placed = radix_buckets(parts.select("key", "first_id", "copies"), capacity, stride)
    # small buckets share tasks: the shuffle hashes the bucket's prefix
    placed = placed.select("bucket", "key", "first_id", "copies").repartition(shuffle_partitions(parts.sparkSession), "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(tries, "key binary, first_id bigint, copies bigint")


def members(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, first_id, record_id, copies) of every row that has copies."""
    many = groups.where("copies > 1").select(F.xxhash64("key").alias("h"), "key", "first_id", "copies")
    rows = parts.select(F.xxhash64("key").alias("h"), F.col("key").alias("own"), "ids")
    # joined by a 64-bit hash for short shuffle keys, then by the bytes themselves; two keys may share a hash. A key has one
    # partial row for each map task and 100,000 rows at most, which is what its weight counts
    many = many.groupBy("h").agg(F.ceil(F.sum("copies") / FOLD_ROWS).alias("_w"), F.collect_list(F.struct("key", "first_id", "copies")).alias("g"))
    met = skew_join(rows, many, "h", "_w", F.coalesce(F.col("ids")[0], F.lit(0)))
    met = met.select("own", "ids", F.explode("g").alias("g")).where("own = g.key")
    return met.select(F.col("own").alias("key"), "g.first_id", F.explode("ids").alias("record_id"), "g.copies")


def catalog_of(key: Column, catalogs: list[str]) -> Column:
    """Name of the catalog whose tag a key begins with."""
    return F.coalesce(*[F.when(F.substring(key, 1, 2) == F.lit(tag(c)), F.lit(c)) for c in catalogs])


def native_key(name, vendor, product, link) -> bytes:
    texts = [canon.letters_digits(x) for x in (name, vendor, product)]
    return canon.pack([*texts, canon.pack_set(x for x in link or () if x is not None)])


def alias_key(name, attrs, link) -> bytes:
    links = canon.pack_set(x for x in link or () if x is not None)
    return canon.pack([canon.letters_digits(name), canon.pack_set(canon.attrs_items(attrs)), links])


def ehole_key(cms, method, location, keyword) -> bytes:
    texts = [canon.letters_digits(x) for x in (cms, method, location)]
    return canon.pack([*texts, canon.pack_set(canon.plain_items(keyword))])
