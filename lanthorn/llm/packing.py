"""Filling containers of fixed capacity by vector best-fit.

An item has a demand in three resources: tokens, one document, and attention cost (tokens squared, the work of attention
within the document). A container has a capacity in each; an item goes to the open container that takes it under every
constraint and scores best, by the smallest weighted norm of what is left or the largest weighted dot-product of demand
and residual; if none takes it, a new one opens. Items come in order of decreasing tokens.

Texts that fit are items as a whole. A text longer than the capacity has to be cut, and where it is cut is free: its
pieces are as long as every capacity allows, and its last part fills the room that the others left (whole if a container
takes it, else cut at the largest room). A few long pieces are held back and cut up as well while the room left
elsewhere takes all of one. Pieces of less than ``least_piece`` tokens are not cut off. Documents are spread by a hash over groups of bounded size which pack independently; a group leaves at
most a few containers partly empty, so their number costs little.

Defined results: a row without tokens is an item of size 0 and is assigned as well; repeated ids are items of their own.
A text of at most the capacity's tokens whose attention cost alone is over its capacity stays whole, in a container of its own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one group (one task's work).
GROUP = 8192
#: Weights of tokens, documents and attention cost in the score.
WEIGHTS = (1.0, 0.01, 0.01)
#: Documents of a container, and its attention capacity as a share of its tokens squared.
MAX_DOCS, ATTENTION = 16, 0.8
#: Share of a group's containers for whose rooms long pieces are held back.
HELD = 0.02


class Containers:
    """Open and closed containers of one group; residuals of tokens, documents and attention cost."""

    def __init__(self, capacity: np.ndarray, weights=WEIGHTS, score: str = "norm"):
        self.capacity = np.asarray(capacity, float)
        self.w = np.asarray(weights) / np.maximum(self.capacity, 1) ** 2
        self.score = score
        self.left = np.empty((64, 3))
        self.n = 0
        self.live = np.empty(0, np.int64)  # containers that may still take something
        self.rest = np.empty((0, 3))  # their residuals

    def open(self, tokens: float) -> int:
        if self.n == len(self.left):
            self.left = np.concatenate([self.left, np.empty_like(self.left)])
        self.left[self.n] = self.capacity
        self.n += 1
        self._take(self.n - 1, tokens)
        return self.n - 1

    def _take(self, k: int, tokens: float) -> None:
        self.left[k] -= (tokens, 1.0, tokens * tokens)

    def keep(self, least: float) -> None:
        """Look only at containers that can take ``least`` tokens."""
        left = self.left[: self.n]
        self.live = np.flatnonzero((left[:, 0] >= least) & (left[:, 1] >= 1) & (left[:, 2] >= least * least))
        self.rest = left[self.live]

    def place(self, k: int, tokens: float, least: float) -> None:
        """Put tokens into the k-th live container."""
        c = self.live[k]
        self._take(c, tokens)
        self.rest[k] = self.left[c]
        if self.rest[k, 0] < least or self.rest[k, 1] < 1 or self.rest[k, 2] < least * least:
            self.rest[k] = -1.0

    def choose(self, tokens: float) -> int:
        """Index of the best live container that takes the item under every constraint, or -1."""
        if not len(self.live):
            return -1
        after = self.rest - (tokens, 1.0, tokens * tokens)
        fits = (after >= 0).all(axis=1)
        if self.score == "norm":
            k = int(np.where(fits, (after * after) @ self.w, np.inf).argmin())
        else:
            k = int(np.where(fits, self.rest @ (np.array([tokens, 1.0, tokens * tokens]) * self.w), -np.inf).argmax())
        return k if fits[k] else -1

    def room(self) -> np.ndarray:
        """Tokens that one more piece may hold in each live container."""
        free = np.minimum(self.rest[:, 0], np.sqrt(np.maximum(self.rest[:, 2], 0)))
        return np.where(self.rest[:, 1] >= 1, np.floor(free), -1)


def pack_group(tokens: np.ndarray, capacity: np.ndarray, least_piece: int = 64, score: str = "norm", weights=WEIGHTS) -> list[tuple[int, int, int, int]]:
    """(item, start, length, container) of all pieces of one group's items, given their tokens."""
    cap = float(capacity[0])
    most = min(cap, float(int(np.sqrt(capacity[2]))))  # tokens of a piece that every capacity allows
    least = float(min(least_piece, most))
    # a container full of one long text holds it in one piece, or in two where attention forbids one and allows two
    p = float(int((cap + np.sqrt(max(0.0, 2 * capacity[2] - cap * cap))) / 2))  # p and the rest take all of the attention
    parts = [cap] if most >= cap else [min(p, cap - least), max(cap - p, least)]
    if len(parts) > capacity[1] or sum(x * x for x in parts) > capacity[2] or sum(parts) > cap:
        parts = [most]
    unit = sum(parts)
    out: list[tuple[int, int, int, int]] = []
    box = Containers(capacity, weights, score)
    order = np.argsort(-tokens, kind="stable")
    whole = [i for i in order if tokens[i] <= cap]
    smallest = float(tokens[whole[-1]]) if whole else 0.0
    long: list[tuple[int, int]] = []  # stretches of ``unit`` tokens: (item, start)
    rests: list[tuple[int, int, float]] = []
    for i in order[: len(order) - len(whole)]:
        n = int(tokens[i] // unit)
        long += [(int(i), int(unit) * k) for k in range(n)]
        rests.append((int(i), int(unit) * n, float(tokens[i]) - n * unit))

    def fill(item: int, start: int) -> None:
        c = -1
        for p in parts:
            if c < 0:
                c = box.open(p)
            else:
                box._take(c, p)
            out.append((item, start, int(p), c))
            start += int(p)

    held = min(len(long), 2 + int(HELD * tokens.sum() / cap))
    for i, start in long[: len(long) - held]:
        fill(i, start)
    box.keep(smallest)
    opened_since = 0
    for i in whole:
        t = float(tokens[i])
        k = box.choose(t)
        if k >= 0:
            c = int(box.live[k])
            box.place(k, t, smallest)
        else:
            c = box.open(t)
            box.live = np.append(box.live, c)
            box.rest = np.vstack([box.rest, box.left[c]])
        out.append((int(i), 0, int(t), c))
        opened_since += 1
        if opened_since == 256:  # drop the closed ones from sight
            box.keep(smallest)
            opened_since = 0
    box.keep(1.0)
    for i, start, n in rests:
        spread(box, out, i, start, n, least)
    # a held piece is cut up while the room elsewhere takes all of it
    full = long[len(long) - held :]
    room = box.room() if len(box.live) else np.empty(0)
    total = float(room[room >= least].sum())
    while full and total >= unit + least:
        i, start = full.pop()
        spread(box, out, i, start, unit, least)
        now = box.room()
        total = float(now[now >= least].sum())
    for i, start in full:
        fill(i, start)
    return out


def spread(box: Containers, out: list, item: int, start: int, rest: float, least: float) -> None:
    """Place a part of a cut item: whole into the best container, else by the largest rooms, else into a new one."""
    most = min(box.capacity[0], float(int(np.sqrt(box.capacity[2]))))
    while rest > 0:
        k = box.choose(rest) if rest <= most else -1
        if k >= 0:
            put = rest
        else:
            room = box.room() if len(box.live) else np.empty(0)
            k = int(room.argmax()) if len(room) else -1
            put = min(float(room[k]), rest - least) if k >= 0 else 0.0
            if put < least:  # no room worth a cut
                c = box.open(rest)
                box.live = np.append(box.live, c)
                box.rest = np.vstack([box.rest, box.left[c]])
                out.append((item, start, int(rest), c))
                return
        out.append((item, start, int(put), int(box.live[k])))
        box.place(k, put, 1.0)
        start, rest = start + int(put), rest - put


def pack(
    items: DataFrame, specs: DataFrame, max_docs: int = MAX_DOCS, attention: float = ATTENTION, score: str = "norm", least_piece: int = 64, group: int = GROUP
) -> DataFrame:
    """Containers of every row of ``specs`` (pack_id, capacity_tokens) filled with ``items`` (doc_id, n_tokens).

    Rows: pack_id, container_id, doc_id, piece_no, start_token, n_tokens, used_tokens and unused_tokens of the container.
    ``max_docs`` bounds the texts of a container; ``attention`` times capacity squared is its attention capacity.
    """
    few = specs.select("pack_id", F.col("capacity_tokens").cast("bigint").alias("cap")).where("cap > 0").distinct()
    chosen = few.limit(1001).collect()  # a handful of rows by their nature; they become literals of the plan
    if len(chosen) > 1000:
        raise ValueError("more than 1000 pack specifications")
    groups = max(1, -(-items.count() // group))
    kind, doc = dict(few.dtypes)["pack_id"], dict(items.dtypes)["doc_id"]
    pairs = F.array(*[F.struct(F.lit(r.pack_id).alias("pack_id"), F.lit(r.cap).alias("cap")) for r in chosen])
    each = items.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n"), F.explode(pairs.cast(f"array<struct<pack_id:{kind},cap:bigint>>")).alias("s"))
    each = each.select("s.pack_id", "s.cap", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("grp"), "doc_id", "n")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pack_id, cap, grp = key
        pdf = pdf.sort_values(["n", "doc_id"], ascending=[False, True], kind="stable")
        capacity = np.array([float(cap), float(max_docs), attention * float(cap) * float(cap)])
        rows = np.array(sorted(pack_group(pdf["n"].to_numpy(np.float64), capacity, least_piece, score)), np.int64).reshape(-1, 4)
        used = np.bincount(rows[:, 3], weights=rows[:, 2], minlength=1).astype(np.int64)
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        return pd.DataFrame(
            {
                "pack_id": pack_id,
                "container_id": [f"{grp}-{b}" for b in rows[:, 3]],
                "doc_id": pdf["doc_id"].to_numpy()[rows[:, 0]],
                "piece_no": (np.arange(len(rows)) - first).astype(np.int32),
                "start_token": rows[:, 1],
                "n_tokens": rows[:, 2],
                "used_tokens": used[rows[:, 3]],
                "unused_tokens": cap - used[rows[:, 3]],
            }
        )

    schema = (
        f"pack_id {kind}, container_id string, doc_id {doc}, piece_no int, start_token bigint, n_tokens bigint, "
        "used_tokens bigint, unused_tokens bigint"
    )
    return each.groupBy("pack_id", "cap", "grp").applyInPandas(run, schema)


def report(packed: DataFrame, specs: DataFrame, max_docs: int = MAX_DOCS, attention: float = ATTENTION) -> DataFrame:
    """Per pack: containers, documents, tokens, the unused share, and the shares of containers that a capacity closes.

    A container is closed by documents when it holds ``max_docs`` of them, and by attention when what is left of that
    capacity takes fewer tokens in one piece than are unused.
    """
    cost = F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens"))
    boxes = packed.groupBy("pack_id", "container_id").agg(
        F.max("used_tokens").alias("used"), F.max("unused_tokens").alias("unused"), F.count("*").alias("n"), cost.alias("cost")
    )
    cap = F.col("used") + F.col("unused")
    room = F.sqrt(F.greatest(F.lit(0.0), F.lit(attention) * cap * cap - F.col("cost")))
    boxes = boxes.withColumns({"by_docs": F.col("n") >= max_docs, "by_attention": (F.col("unused") > 0) & (room < F.col("unused"))})
    share = lambda c: (F.count_if(c) / F.count("*")).alias(f"closed_{c}")
    docs = packed.groupBy("pack_id").agg(F.count_if(F.col("piece_no") == 0).alias("documents"), F.count("*").alias("pieces"))
    sums = boxes.groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("unused").alias("unused_tokens"), share("by_docs"), share("by_attention"))
    out = specs.select("pack_id", "capacity_tokens").join(sums, "pack_id", "left").join(docs, "pack_id", "left")
    return out.withColumn("unused_share", F.col("unused_tokens") / (F.col("unused_tokens") + F.col("tokens")))
