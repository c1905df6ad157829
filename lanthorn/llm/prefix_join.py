"""Set-similarity join with prefix, length and positional filters.

Tokens of each set stand in one global order, rarest first. A pair is similar when each set lacks at most ``most`` tokens
of the other, so it shares o = max(a, b) - most tokens of sizes a and b, which is a Jaccard similarity of
o / (a + b - o) at least. Then the first most + 1 tokens of both share one: only these prefixes are joined. A pair is
dropped where its sizes differ by more than ``most``, or where the tokens behind the met positions cannot make up o. The
rest is verified exactly. Any global order is lossless; rarity only makes the join small.

``Index`` keeps the prefixes of a bounded reference side in memory, ``overlap_join`` joins sides of any size.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reference sets up to this number are counted and indexed in memory (about 100 MB); beyond it tokens stand in hash order.
RANKED = 200_000


def rarity_rank(token_sets: Iterable[Iterable[str]]) -> dict[str, int]:
    """Rank of each token, rarest first, ties by the token."""
    count = Counter(t for s in token_sets for t in set(s))
    return {t: i for i, t in enumerate(sorted(count, key=lambda t: (count[t], t)))}


def hash_order(tokens: Iterable[str]) -> list[int]:
    """Tokens as numbers in an order that needs no counts."""
    from hashlib import blake2b

    return sorted(int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1 for t in tokens)


class Index:
    """Inverted index over the prefixes of (tokens, group, most) reference sets."""

    def __init__(self, sets: list[tuple[set[str], str, int]]):
        self.sets = sets
        self.rank = rarity_rank(s for s, _, _ in sets)
        self.posts: dict[str, dict[str, list[tuple[int, int, int, int]]]] = defaultdict(lambda: defaultdict(list))
        for i, (s, group, most) in enumerate(sets):
            for pos, t in enumerate(self.order(s)[: most + 1]):
                self.posts[group][t].append((i, pos, len(s), most))

    def order(self, tokens: set[str]) -> list[str]:
        """Rarest first; tokens that no reference set holds are the rarest."""
        rank = self.rank
        return sorted(tokens, key=lambda t: (rank.get(t, -1), t))

    def probe(self, tokens: set[str], group: str, most: int) -> Iterator[tuple[int, float]]:
        """(reference, Jaccard) of all similar reference sets of the group, each once; ``most`` bounds theirs."""
        posts = self.posts.get(group)
        if not posts:
            return
        n, seen = len(tokens), set()
        for pos, t in enumerate(self.order(tokens)[: most + 1]):
            for i, at, m, lacks in posts.get(t, ()):
                # too different a size, or the prefix of this pair ends before
                if abs(n - m) > lacks or pos > lacks or i in seen:
                    continue
                # at the first common token of the prefixes nothing before is shared
                seen.add(i)
                need = max(n, m) - lacks
                if min(n - pos, m - at) >= need:
                    shared = len(tokens & self.sets[i][0])
                    if shared >= need:
                        yield i, shared / (n + m - shared)


def overlap_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Candidate pairs (l, r) of rows of both sides, each once; the exact check is the caller's.

    Rows have ``on``, ``tokens`` (the first most + 1 in the global order, as numbers), ``size``, ``most`` and whatever
    tells them apart; ``most`` of the right side counts for the pair.
    """

    def prefixes(df: DataFrame, s: str) -> DataFrame:
        row = F.struct(*[c for c in df.columns if c not in ("tokens", on)]).alias(s)
        return df.select(row, on, F.posexplode("tokens").alias(f"{s}_pos", "token"))

    met = prefixes(left, "l").join(prefixes(right, "r"), [on, "token"])
    most, need = F.col("r.most"), F.greatest("l.size", "r.size") - F.col("r.most")
    met = met.where((F.col("l_pos") <= most) & (F.abs(F.col("l.size") - F.col("r.size")) <= most))
    met = met.where(F.least(F.col("l.size") - F.col("l_pos"), F.col("r.size") - F.col("r_pos")) >= need)
    return met.select("l", "r").distinct()
