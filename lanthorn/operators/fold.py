"""Native hits of a response resolved and merged within its own row.

A text of a catalogue that many entries list makes thousands of hits in every message that holds it, so hits grow with
responses times entries. Here a response travels with the keys it holds (``native.marks``) and the hits of the other
engines, all few; what a key stands for is a broadcast table. The choice of each entry's first rule, the aliases and the
merge happen in that row, with the rows that ``alias.merge`` of the resolved hits gives, and no hit is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanthorn.operators import alias, native
from lanthorn.session import shuffle_partitions

#: Rows of an output batch, and of merged results that a worker keeps.
BATCH_ROWS, KEPT_ROWS = 32_768, 2_000_000
NONE = np.int32(2**31 - 1)
FIELDS = ("framework", "version", "vendor", "product", "froms", "tags")


class Pool:
    """Texts by number, the first ones in their order; others are added behind them."""

    def __init__(self, texts: Sequence):
        self.texts, self.base, self.ids, self.made = list(texts), len(texts), None, None

    def id(self, text) -> int:
        if self.ids is None:
            self.ids = {t: i for i, t in enumerate(self.texts)}
        if text not in self.ids:
            self.ids[text] = len(self.texts)
            self.texts.append(text)
        return self.ids[text]

    def take(self, ids: np.ndarray) -> pa.Array:
        if self.made is None or len(self.made) != len(self.texts):
            self.made = pa.array([",".join(t) if isinstance(t, tuple) else t for t in self.texts], pa.string())
        return self.made.take(pa.array(ids, pa.int32(), mask=ids == NONE))

    def reset(self) -> None:
        if len(self.texts) > self.base:
            del self.texts[self.base :]
            self.ids = self.made = None


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    """Numbers in the order of the texts, NONE for null and the empty text."""
    one = column.cast(pa.string()).combine_chunks().dictionary_encode()
    texts = one.dictionary.to_pylist()
    order = sorted((i for i, t in enumerate(texts) if t), key=texts.__getitem__)
    place = np.full(len(texts) + 1, NONE, np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return place[one.indices.fill_null(len(texts)).to_numpy(zero_copy_only=False)], [texts[i] for i in order]


def _starts(ids: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(ids, np.arange(n + 1)).astype(np.int64)


class Tables:
    """What keys stand for: per key the first matcher of each entry, per entry and rule what its hit says."""

    def __init__(self, dim: pa.Table, said: pa.Table):
        ids = np.unique(np.concatenate([dim["finger_id"].to_numpy(), said["finger_id"].to_numpy()]), return_inverse=True)[1]
        own, rule = ids[: len(dim)].astype(np.int64), dim["rule_idx"].to_numpy().astype(np.int64)
        codes, slots = np.unique(np.concatenate([own << 24 | rule, ids[len(dim) :].astype(np.int64) << 24 | said["rule_idx"].to_numpy()]), return_inverse=True)
        key = dim["key"].combine_chunks().dictionary_encode()
        self.keys, k = key.dictionary, key.indices.to_numpy()
        rank = rule << 36 | dim["kind_rank"].to_numpy().astype(np.int64) << 32 | dim["matcher_idx"].to_numpy().astype(np.int64)
        order = np.lexsort((rank, own, k))
        k, own, rank, slot = k[order], own[order], rank[order], slots[: len(dim)][order]
        first = np.ones(len(k), bool)
        first[1:] = (k[1:] != k[:-1]) | (own[1:] != own[:-1])
        self.starts = _starts(k[first], len(self.keys))
        self.finger, self.rank, self.slot = own[first].astype(np.int32), rank[first], slot[first].astype(np.int32)
        order = np.argsort(slots[len(dim) :], kind="stable")
        self.rows = _starts(slots[len(dim) :][order], len(codes))
        said = said.take(pa.array(order))
        self.of, self.texts = {}, {"froms": []}
        for c in ("framework", "version", "vendor", "product"):
            self.of[c], self.texts[c] = _numbered(said[c])
        lists = [tuple(t or ()) for t in said["tags"].to_pylist()]
        self.texts["tags"] = list(dict.fromkeys([(), *lists]))
        place = {t: i for i, t in enumerate(self.texts["tags"])}
        self.of["tags"], self.of["focus"] = np.array([place[t] for t in lists], np.int32), said["focus"].to_numpy(zero_copy_only=False).astype(bool)


class Fold:
    """Merged rows of one response after another, as numbers of texts."""

    def __init__(self, t: Tables, engine: str, place: int):
        self.t, self.engine, self.place = t, engine, place
        self.key = {k: i for i, k in enumerate(t.keys.to_pylist())}
        self.pools = {c: Pool(t.texts[c]) for c in FIELDS}
        self.kept: dict[tuple, dict[str, np.ndarray]] = {}
        self.size, self.unions = 0, {}

    def reset(self) -> None:
        """Between batches: bounds what is kept."""
        if self.size > KEPT_ROWS or sum(len(p.texts) - p.base for p in self.pools.values()) > 200_000:
            self.kept.clear()
            self.unions.clear()
            self.size = 0
            for p in self.pools.values():
                p.reset()

    def own(self, marks: tuple[tuple[int, str], ...]) -> dict[str, np.ndarray]:
        if marks not in self.kept:
            self.kept[marks] = out = self._own(marks)
            self.size += len(out["framework"]) + 1
        return self.kept[marks]

    def _own(self, marks: tuple[tuple[int, str], ...]) -> dict[str, np.ndarray]:
        t = self.t
        cuts = [slice(t.starts[k], t.starts[k + 1]) for k, _ in marks]
        none = np.empty(0, np.int32)
        finger, rank, slot = (np.concatenate([none, *(a[c] for c in cuts)]).astype(a.dtype) for a in (t.finger, t.rank, t.slot))
        via = np.repeat(np.arange(len(cuts)), [c.stop - c.start for c in cuts])
        won = np.lexsort((rank, finger))
        won = won[np.diff(finger[won], prepend=-1) != 0]
        begin = t.rows[slot[won]]
        n = t.rows[slot[won] + 1] - begin
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        via = np.repeat(via[won], n)
        order = np.argsort(t.of["framework"][at], kind="stable")
        at, via = at[order], via[order]
        framework = t.of["framework"][at]
        if not len(framework):
            return {c: none for c in FIELDS} | {"focus": np.empty(0, bool)}
        g = np.flatnonzero(np.diff(framework, prepend=-1))
        got = np.array([bool(x) for _, x in marks])[via]
        out = {"framework": framework[g], "focus": np.maximum.reduceat(t.of["focus"][at], g), "froms": np.full(len(g), self.pools["froms"].id(self.engine), np.int32)}
        out |= {c: np.minimum.reduceat(x, g) for c, x in (("version", np.where(got, NONE, t.of["version"][at])), ("vendor", t.of["vendor"][at]), ("product", t.of["product"][at]))}
        for i in np.flatnonzero(got):  # versions from the message
            j = np.searchsorted(g, i, "right") - 1
            out["version"][j] = self.pools["version"].id(min([marks[via[i]][1], *self._text("version", out["version"][j])]))
        tags = t.of["tags"][at]
        out["tags"], most = np.minimum.reduceat(tags, g), np.maximum.reduceat(tags, g)
        ends = [*g[1:], len(tags)]
        for j in np.flatnonzero(out["tags"] != most):
            out["tags"][j] = self.union(frozenset(tags[g[j] : ends[j]].tolist()))
        return out

    def _text(self, field: str, number: int) -> list[str]:
        return [] if number == NONE else [self.pools[field].texts[number]]

    def union(self, lists: frozenset[int]) -> int:
        if lists not in self.unions:
            pool = self.pools["tags"]
            self.unions[lists] = pool.id(tuple(sorted({x for i in lists for x in pool.texts[i]})))
        return self.unions[lists]

    def with_others(self, own: dict[str, np.ndarray], others: list[dict]) -> dict[str, np.ndarray]:
        """The rows with the live hits of other engines (framework, i, engine, version, vendor, product, tags, focus)."""
        by: dict[str, list[dict]] = {}
        for o in others:
            by.setdefault(o["framework"], []).append(o)
        out = {c: a.copy() for c, a in own.items()}
        more: dict[str, list] = {c: [] for c in out}
        for name, hits in by.items():
            number = self.pools["framework"].id(name)
            j = int(np.searchsorted(own["framework"], number))
            mine = j < len(own["framework"]) and own["framework"][j] == number
            row = {"framework": number, "focus": any(o["focus"] for o in hits) or bool(mine and out["focus"][j])}
            for c in ("version", "vendor", "product"):
                values = [(o["i"], o["engine"], o[c]) for o in hits if o[c]] + [(self.place, self.engine, x) for x in (self._text(c, own[c][j]) if mine else ())]
                row[c] = self.pools[c].id(min(values)[2]) if values else NONE
            row["froms"] = self.pools["froms"].id(",".join(sorted({o["engine"] for o in hits} | ({self.engine} if mine else set()))))
            tags = {x for o in hits for x in o["tags"] or () if x is not None} | (set(self.pools["tags"].texts[own["tags"][j]]) if mine else set())
            row["tags"] = self.pools["tags"].id(tuple(sorted(tags)))
            for c, x in row.items():
                if mine:
                    out[c][j] = x
                else:
                    more[c].append(x)
        return {c: np.concatenate([a, np.array(more[c], a.dtype)]) for c, a in out.items()}


OTHER = "framework string, i int, engine string, version string, vendor string, product string, tags array<string>, focus boolean"


def live(resolved: DataFrame, order: Sequence[str]) -> DataFrame:
    """Resolved hits that count, under their framework and with their engine's place."""
    kept = resolved.where("not blocked and name is not null")
    return kept.withColumns({"framework": F.lower("name"), "i": alias.engine_rank(F.col("engine"), order), "focus": F.coalesce("focus", F.lit(False))})


def detect(responses: DataFrame, entries: DataFrame, engine: str, others: DataFrame | None, resolve: Callable[[DataFrame], DataFrame], order: Sequence[str]) -> DataFrame:
    """As ``alias.merge`` of the resolved hits of the native ``engine`` and of ``others``, which are hits."""
    spark = responses.sparkSession
    dim, exprs = native.keyed(entries)
    said = live(resolve(native.statics(entries).withColumn("engine", F.lit(engine))), order)
    tags = F.array_sort(F.array_distinct(F.filter("tags", lambda t: t.isNotNull())))
    said = said.select("finger_id", "rule_idx", "framework", "version", "vendor", "product", tags.alias("tags"), "focus").where("finger_id is not null")
    keys = dim.where("finger_id is not null").select("key", "finger_id", "rule_idx", "kind_rank", "matcher_idx")
    given = spark.sparkContext.broadcast(Tables(keys.toArrow(), said.toArrow()))
    mark, other = F.struct("key", "captured"), [x.split()[0] for x in OTHER.split(", ")]
    rows = native.marks(responses, dim, exprs).select("resp_id", mark.alias("mark"), F.lit(None).cast(f"struct<{OTHER.replace(' ', ':')}>".replace(",:", ",")).alias("other"))
    if others is not None:
        hits = live(resolve(others), order).select("resp_id", F.struct(*other).alias("other"))
        rows = rows.unionByName(hits.select("resp_id", F.lit(None).cast(rows.schema["mark"].dataType).alias("mark"), "other"))
    n = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    rows = rows.where("resp_id is not null").repartition(n, "resp_id").groupBy("resp_id").agg(F.collect_list("mark").alias("m"), F.collect_list("other").alias("others"))
    rows = rows.select("resp_id", "m.key", F.transform("m", lambda x: F.coalesce(x["captured"], F.lit(""))).alias("captured"), "others")
    kind, place = rows.schema["resp_id"].dataType.simpleString(), list(order).index(engine) if engine in order else len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold(given.value, engine, place)
        ids, parts, size = [], [], 0

        def flush(of: pa.DataType) -> pa.RecordBatch:
            lengths = [len(p["framework"]) for p in parts]
            resp = pa.array(ids, of).take(pa.array(np.repeat(np.arange(len(ids)), lengths)))
            texts = [fold.pools[c].take(np.concatenate([p[c] for p in parts])) for c in FIELDS]
            return pa.RecordBatch.from_arrays([resp, *texts, pa.array(np.concatenate([p["focus"] for p in parts]))], names=["resp_id", *FIELDS, "focus"])

        for b in batches:
            of = b.column(0).type
            for i, keys, captured, others in zip(*(c.to_pylist() for c in b.columns)):
                part = fold.own(tuple(sorted({(k, x) for k, x in zip((fold.key.get(y) for y in keys), captured) if k is not None})))
                part = fold.with_others(part, others) if others else part
                if len(part["framework"]):
                    ids.append(i)
                    parts.append(part)
                    size += len(part["framework"])
                if size >= BATCH_ROWS:
                    yield flush(of)
                    ids, parts, size = [], [], 0
                    fold.reset()
            if size:
                yield flush(of)
                ids, parts, size = [], [], 0
                fold.reset()

    return rows.mapInArrow(run, f"resp_id {kind}, {', '.join(f'{c} string' for c in FIELDS)}, focus boolean")
