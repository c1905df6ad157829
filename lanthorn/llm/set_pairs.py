"""All pairs of set-valued records with Jaccard similarity at a threshold, by pigeonhole partitioning.

Equal sets are folded into one class first. For classes of sizes l <= l' the symmetric difference of a similar pair is
at most H = l + l' - 2 ceil(t (l + l') / (1 + t)). Sizes fall into narrow bands; each pair of bands has its own H and cuts
the token universe into m = H + 1 segments by a hash of the token. The smaller set (the probe) gives each segment a
tolerance -1 (unused), 0 (equal) or 1 (one token more or less) such that the sum of (tolerance + 1) is H + 1: two sets that
differ by more than the tolerance in every segment differ in more than H tokens, so no similar pair is lost. Segments are
chosen by cost: empty segments and those made of common tokens are left out where the sum allows. The larger set (the
index) stores each segment and its one-deletion variants; probes meet them in an equi-join on signature hashes, and
candidates are verified exactly on the items.

A signature of common tokens only (or of none) would bring together a large part of all sets. Such signatures are
refined with one of the rarest tokens: of the l - ceil(t l) + 1 rarest tokens of either set of a similar pair, one is
shared, so both sides repeat a hot signature for each of these and again no pair is lost.

Defined results: null items do not count, items are compared trimmed and without case, sets of fewer than ``least`` items
take no part, an id entered twice with one set gives no pair with itself. Sets of any size work; the number of bands
grows with the logarithm of the size.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanthorn.session import checkpoint

#: A token is common in more than COMMON x sqrt(classes) classes; at most (mean size x sqrt(classes) / COMMON) tokens are.
COMMON = 0.25
#: The table of common tokens, which is broadcast, has at most so many rows: with fewer, only the work differs.
COMMON_ROWS = 500_000
MASK = (1 << 64) - 1
GROWTH = 1.2


def bands(least: int, largest: int, growth: float = GROWTH) -> list[tuple[int, int]]:
    """Size bands [lo, hi] from ``least`` up to ``largest``."""
    out, lo = [], least
    while lo <= largest:
        hi = max(lo, math.ceil(lo * growth) - 1)
        out.append((lo, hi))
        lo = hi + 1
    return out


def max_difference(a: tuple[int, int], b: tuple[int, int], t: float) -> int:
    """Bound on the symmetric difference of a similar pair with sizes in bands a <= b; -1 if none can be similar."""
    top = min(b[1], math.floor(a[1] / t + 1e-9))
    if top < b[0]:
        return -1
    least, most = a[0] + max(a[0], b[0]), a[1] + top
    # x + y - 2 ceil(c (x + y)) grows with x + y but for rounding, so the largest sums hold the maximum
    return max(s - 2 * math.ceil(t / (1 + t) * s - 1e-9) for s in range(max(least, most - 40), most + 1))


def allocate(segments: list[list[int]], cost: dict[int, float], need: int) -> list[int]:
    """Tolerance of each segment (-1, 0, 1) with sum of (tolerance + 1) = ``need`` and small cost."""
    steps = []
    for i, seg in enumerate(segments):
        by = sorted(cost.get(h, 1.0) for h in seg)
        # equal segments share all tokens, so the rarest bounds their number; with one token gone, the second rarest does
        c1 = by[0] if by else 1e12
        c2 = by[1] * (1 + len(by)) if len(by) > 1 else 1e11
        steps += [(c1, 0, i), (max(c1, c2), 1, i)]
    steps.sort()
    tol = [-1] * len(segments)
    for _, _, i in steps[:need]:
        tol[i] += 1
    return tol


def mix(band: int, seg: int, total: int, size: int) -> int:
    """Signature of a segment's tokens (their hash sum and number) under a band pair, as a signed 64-bit value."""
    x = (total + 0x9E3779B97F4A7C15 * (band * 65537 + seg * 31 + size + 1)) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


class Scheme:
    """Bands, their pairs and the signatures of a set given as token hashes."""

    def __init__(self, t: float, least: int, largest: int):
        self.t = t
        self.bands = bands(least, largest)
        self.starts = [lo for lo, _ in self.bands]
        self.probe: dict[int, list[tuple[int, int]]] = {}
        self.index: dict[int, list[tuple[int, int]]] = {}
        for i, a in enumerate(self.bands):
            for j in range(i, len(self.bands)):
                h = max_difference(a, self.bands[j], t)
                if h < 0 and self.bands[j][0] > a[1] / t:
                    break
                if h > 0:  # classes are different sets, so a pair differs in a token at least
                    code = i * 100_000 + j
                    self.probe.setdefault(i, []).append((code, h))
                    self.index.setdefault(j, []).append((code, h))

    def where(self, size: int) -> int:
        """The band of a size."""
        return bisect_right(self.starts, size) - 1

    @staticmethod
    def cut(tokens: list[int], m: int) -> list[list[int]]:
        segs: list[list[int]] = [[] for _ in range(m)]
        for h in tokens:
            segs[((h & MASK) >> 17) % m].append(h)
        return segs

    def _emit(self, code: int, i: int, total: int, size: int, rare: int, ends: list[int]) -> Iterator[int]:
        if rare:
            yield mix(code, i, total, size)
        else:
            for p in ends:
                yield mix(code, i, total + (p | 1) * 0xD6E8FEB86659FD93, size + 1_000_000)

    def ends(self, tokens: list[int], cost: dict[int, float]) -> list[int]:
        """The rarest tokens of a set, of which one is in any set similar to it."""
        n = len(tokens) - math.ceil(self.t * len(tokens) - 1e-9) + 1
        return sorted(tokens, key=lambda h: (cost.get(h, 1.0), h))[:n]

    def stored(self, tokens: list[int], cost: dict[int, float]) -> Iterator[tuple[int, int]]:
        """(signature, role) of a set in the index: role 1 for whole segments, 3 for those with one token left out."""
        ends = self.ends(tokens, cost)
        for code, h in self.index.get(self.where(len(tokens)), ()):
            for i, seg in enumerate(self.cut(tokens, h + 1)):
                total, rare = sum(seg), sum(x not in cost for x in seg)
                for s in self._emit(code, i, total, len(seg), rare, ends):
                    yield s, 1
                for x in seg:
                    for s in self._emit(code, i, total - x, len(seg) - 1, rare - (x not in cost), ends):
                        yield s, 3

    def probes(self, tokens: list[int], cost: dict[int, float]) -> Iterator[tuple[int, int]]:
        """(signature, role) with which a set looks in the index, by the role of what it may meet there."""
        ends = self.ends(tokens, cost)
        for code, h in self.probe.get(self.where(len(tokens)), ()):
            segs = self.cut(tokens, h + 1)
            for i, (seg, tol) in enumerate(zip(segs, allocate(segs, cost, h + 1))):
                if tol < 0:
                    continue
                total, rare = sum(seg), sum(x not in cost for x in seg)
                for own in self._emit(code, i, total, len(seg), rare, ends):
                    yield own, 1
                    if tol:
                        yield own, 3
                if tol:
                    for x in seg:
                        for s in self._emit(code, i, total - x, len(seg) - 1, rare - (x not in cost), ends):
                            yield s, 1


def plain_items(items: Column) -> Column:
    """Items trimmed and without case, each once, in order; nulls dropped."""
    trimmed = F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    return F.array_sort(F.array_distinct(trimmed))


def set_members(records: DataFrame, least: int = 3) -> DataFrame:
    """(set_id, universe, items, side, id) of (universe, side, id, items) records with enough items, each id once."""
    rows = records.select("universe", "side", "id", plain_items(F.col("items")).alias("items")).where(F.size("items") >= least)
    digest = F.unhex(F.md5(F.to_json(F.struct("universe", "items"))))
    return rows.select(digest.alias("set_id"), "universe", "items", "side", "id").dropDuplicates(["set_id", "side", "id"])


def similar_classes(members: DataFrame, t: float = 0.6, least: int = 3) -> DataFrame:
    """(left_set, right_set, shared, total): similar pairs of different sets, each once."""
    # classes by a 64-bit number for short shuffle keys; should two share one, candidates meet both and the items decide
    classes = members.groupBy("set_id").agg(F.first("universe").alias("universe"), F.first("items").alias("items"))
    classes = checkpoint(classes.withColumn("c", F.xxhash64("set_id")))
    hashed = classes.select("c", F.transform("items", lambda x: F.xxhash64("universe", x)).alias("tokens"))
    largest, n, total = hashed.agg(F.max(F.size("tokens")), F.count("*"), F.sum(F.size("tokens"))).first()
    scheme = Scheme(t, least, largest or least)
    often = max(2, COMMON * math.sqrt(n), (total or 0) / COMMON_ROWS)
    common = hashed.select(F.explode("tokens").alias("h")).groupBy("h").count().where(F.col("count") > often)
    cost = hashed.sparkSession.sparkContext.broadcast({r.h: float(r["count"]) for r in common.collect()})

    def signed(side: str, make) -> DataFrame:
        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                idx, sig = [], []
                for i, tokens in enumerate(b.column(1).to_pylist()):
                    own = {s ^ r for s, r in make(tokens)}  # the role is part of what has to be equal
                    sig += own
                    idx += [i] * len(own)
                ids = b.column(0).take(pa.array(idx, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sig, pa.int64())], names=[side, "sig"])

        return hashed.mapInArrow(sign, f"{side} bigint, sig bigint")

    met = signed("a", lambda t: scheme.probes(t, cost.value)).join(signed("b", lambda t: scheme.stored(t, cost.value)), "sig").where("a != b")
    # two sets of one band probe each other: keep the pair once
    pairs = met.select(F.least("a", "b").alias("lc"), F.greatest("a", "b").alias("rc")).distinct()
    side = lambda s: classes.select(F.col("c").alias(f"{s}c"), F.col("set_id").alias(f"{s}_id"), F.col("universe").alias(f"{s}u"), F.col("items").alias(f"{s}i"))
    both = pairs.join(side("l"), "lc").join(side("r"), "rc").where("lu = ru")
    shared = F.size(F.array_intersect("li", "ri"))
    both = both.withColumn("shared", shared).withColumn("total", F.size("li") + F.size("ri") - F.col("shared"))
    both = both.where(F.col("shared") >= F.col("total") * F.lit(t) - F.lit(1e-9))
    return both.select(F.least("l_id", "r_id").alias("left_set"), F.greatest("l_id", "r_id").alias("right_set"), "shared", "total")


def member_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(left_side, left_id, right_side, right_id): similar classes and equal sets expanded to their records."""
    who = members.select("set_id", "side", "id")
    left = who.select(F.col("set_id").alias("left_set"), F.col("side").alias("left_side"), F.col("id").alias("left_id"))
    right = who.select(F.col("set_id").alias("right_set"), F.col("side").alias("right_side"), F.col("id").alias("right_id"))
    many = members.groupBy("set_id").count().where("count > 1").select(F.col("set_id").alias("left_set"), F.col("set_id").alias("right_set"))
    links = classes.select("left_set", "right_set").unionByName(many)
    out = links.join(left, "left_set").join(right, "right_set")
    swap = (F.col("left_set") == F.col("right_set")) & (F.col("left_id") >= F.col("right_id"))
    out = out.where(~swap)
    flip = F.col("left_id") > F.col("right_id")
    return out.select(
        F.when(flip, F.col("right_side")).otherwise(F.col("left_side")).alias("left_side"),
        F.when(flip, F.col("right_id")).otherwise(F.col("left_id")).alias("left_id"),
        F.when(flip, F.col("left_side")).otherwise(F.col("right_side")).alias("right_side"),
        F.when(flip, F.col("left_id")).otherwise(F.col("right_id")).alias("right_id"),
    )
