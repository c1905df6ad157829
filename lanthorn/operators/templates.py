"""Template rules: requests with matchers over the parts of a response.

``match`` compiles a few templates to columns. ``match_catalogue`` runs a whole catalogue in one pass over the
responses: an automaton of trigger texts picks the templates that can match a response, and only those are evaluated.

A template is {id, name, requests: [{condition, path, matchers: [...]}]}; a matcher has type word, regex, dsl, status,
favicon, size or binary, its values, part (body by default), condition (or by default) and negative. With
``fold`` the response is lowered and so are words, but not regular expressions or dsl texts.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
import sys
import types
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanthorn.functions import expr
from lanthorn.functions.mmh3 import mmh3, mmh3_batch
from lanthorn.operators import keywords, parse
from lanthorn.operators.shred import unwrap
from lanthorn.session import few, spread


def events(responses: DataFrame, fold: bool = True) -> DataFrame:
    """resp_id and the fields body, all_headers, header, status_code, content_length; no row without a separator."""
    header, body = parse.template_parts(F.col("raw"))
    low = F.lower if fold else (lambda c: c)
    out = responses.select(
        "resp_id",
        low(body).alias("body"),
        parse.normalized_header(header, fold).alias("all_headers"),
        parse.status_code(F.col("raw")).alias("status_code"),
        F.octet_length("raw").alias("content_length"),
    ).where("body is not null")
    return out.withColumn("header", F.col("all_headers")).withColumn("all", F.concat("all_headers", "body"))


def _field(part: str) -> Column:
    return F.col(part if part in ("body", "header", "all_headers", "all") else "body")


def matcher(m: dict, fold: bool = True) -> Column:
    both = lambda cols: reduce((lambda a, b: a & b) if m.get("condition") == "and" else (lambda a, b: a | b), cols, )
    kind, part = m["type"], _field(m.get("part", "body"))
    if kind == "word":
        out = both([F.contains(part, F.lit(w.lower() if fold else w)) for w in m["words"]])
    elif kind == "regex":
        out = both([F.regexp_like(part, F.lit(r)) for r in m["regex"]])
    elif kind == "dsl":
        out = both([expr.to_column(expr.parse(d), F.col) for d in m["dsl"]])
    elif kind == "status":
        values = m["status"] if isinstance(m["status"], list) else [m["status"]]
        out = F.col("status_code").isin(values)
    elif kind == "size":
        out = F.col("content_length").isin(m["size"])
    elif kind == "favicon":
        hashes = [h.strip().lower() for h in m["hash"]]
        out = F.md5("body").isin(hashes) | mmh3(F.col("body")).isin(hashes)
    elif kind == "binary":
        out = both([F.contains(F.hex(part.cast("binary")), F.lit(b.upper())) for b in m["binary"]])
    else:
        raise ValueError(f"unknown matcher type {kind!r}")
    out = F.coalesce(out, F.lit(False))
    return ~out if m.get("negative") else out


def request(r: dict, fold: bool = True) -> Column:
    ms = [matcher(m, fold) for m in r.get("matchers") or []]
    if not ms:
        return F.lit(False)
    return reduce((lambda a, b: a & b) if r.get("condition", "or") == "and" else (lambda a, b: a | b), ms)


def root_only(template: dict) -> dict:
    """The template with the requests that ask for the root path (an empty list of paths counts)."""
    roots = {f"{{{{{b}}}}}{s}" for b in ("BaseURL", "RootURL") for s in ("", "/")}
    keep = [r for r in template["requests"] if not r.get("path") or any(p.strip() in roots for p in r["path"])]
    return template | {"requests": keep}


def match(responses: DataFrame, templates: Sequence[dict], fold: bool = True, chunk: int = 200) -> DataFrame:
    """(resp_id, template_id): templates of which a request matches. Columns are built in chunks of templates."""
    ev = events(responses, fold)
    out = None
    for i in range(0, len(templates), chunk):
        conds = [F.when(reduce(lambda a, b: a | b, [request(r, fold) for r in t["requests"]] or [F.lit(False)]), F.lit(t["id"])) for t in templates[i : i + chunk]]
        part = ev.select("resp_id", F.explode(F.array_compact(F.array(*conds))).alias("template_id"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else ev.select("resp_id", F.lit("").alias("template_id")).where(F.lit(False))


# --- catalogues -------------------------------------------------------------------------------------------------------


def _list(x: object) -> list:
    x = unwrap(x)
    return [] if x is None else [unwrap(v) for v in x] if isinstance(x, list) else [x]


def _number(x: object) -> int | None:
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


def read_template(payload: str | None) -> tuple[dict | None, str | None]:
    """(template, None) of a JSON text, or (None, reason): its requests, matchers and names in one form.

    http counts before requests, a lone value is a list of one, conditions are trimmed and lower case, text that holds
    JSON counts as it.
    """
    try:
        o = unwrap(json.loads(payload)) if payload is not None else None
    except (ValueError, RecursionError):
        return None, "broken"
    if not isinstance(o, dict):
        return None, "not an object"
    if not isinstance(o.get("id"), str) or not o["id"].strip():
        return None, "id"
    info = unwrap(o.get("info"))
    info = info if isinstance(info, dict) else {}
    meta = unwrap(info.get("metadata"))
    meta = meta if isinstance(meta, dict) else {}
    low = lambda x: x.strip().lower() if isinstance(x, str) else ""
    requests = []
    for r in _list(o.get("http")) or _list(o.get("requests")):
        if not isinstance(r, dict):
            continue
        ms = []
        for m in _list(r.get("matchers")):
            kind = low(m.get("type")) if isinstance(m, dict) else ""
            values = _list(m.get({"word": "words", "favicon": "hash"}.get(kind, kind))) if kind in VALUES else []
            values = [v for v in (map(_number, values) if kind in ("status", "size") else values) if v is not None and isinstance(v, (str, int))]
            if kind in VALUES and values:
                ms.append({"type": kind, VALUES[kind]: values if kind in ("status", "size") else [str(v) for v in values], "part": low(m.get("part")) or "body", "condition": low(m.get("condition")) or "or", "negative": unwrap(m.get("negative")) is True})
        requests.append({"condition": low(r.get("matchers-condition")) or "or", "path": [p for p in _list(r.get("path")) if isinstance(p, str)], "matchers": ms})
    name = info.get("name")
    return {"id": o["id"], "name": name if isinstance(name, str) and name else o["id"], "metadata": meta, "requests": requests}, None


#: Types of matchers and the field that holds their values.
VALUES = {"word": "words", "regex": "regex", "dsl": "dsl", "status": "status", "size": "size", "favicon": "hash", "binary": "binary"}


class Compiled:
    """A template as a Python predicate over an event, with what tells where it need not be asked.

    ``sure`` are status codes that alone make it match. For all other responses it can match only where one of ``keys``
    is: a text in the message, or the mark of a status code, a size or a hash of the body. keys is None where there is no
    such set.
    """

    def __init__(self, template: dict, fold: bool = True):
        self.id, self.fold = template["id"], fold
        made = [self._request(r) for r in template["requests"] if r["matchers"]]
        self.tests = [t for t, _, _ in made]
        self.sure = set().union(*(s for _, _, s in made))
        self.keys = self._either([k for _, k, _ in made], self.sure)
        # what a template of nothing but status codes says depends on the code alone
        self.by_status = all(m["type"] == "status" for r in template["requests"] for m in r["matchers"])

    def __call__(self, event: dict) -> bool:
        return any(t(event) for t in self.tests)

    @staticmethod
    def _either(keys: list[set[str] | None], sure: set[int]) -> set[str] | None:
        return None if None in keys else set().union(*keys) - {mark("status", x) for x in sure}

    @staticmethod
    def _both(keys: list[set[str] | None]) -> set[str] | None:
        """Of what has to be there all together, the set that is met least: texts and hashes before codes and sizes."""
        some = [k for k in keys if k is not None]
        return min(some, key=lambda k: (any(x.startswith((mark("status", ""), mark("size", ""))) for x in k), len(k), -min(map(len, k), default=0))) if some else None

    def _request(self, r: dict):
        made = [self._matcher(m) for m in r["matchers"]]
        tests, keys, sure = [t for t, _, _ in made], [k for _, k, _ in made], [s for _, _, s in made]
        if r["condition"] == "and":
            return (lambda e: all(t(e) for t in tests)), self._both(keys), set.intersection(*sure)
        codes = set().union(*sure)
        return (lambda e: any(t(e) for t in tests)), self._either(keys, codes), codes

    def _matcher(self, m: dict):
        kind, part, every = m["type"], m["part"] if m["part"] in PARTS else "body", m["condition"] == "and"
        both = all if every else any
        keys: list[set[str] | None] = [None]
        sure: set[int] = set()
        if kind == "word":
            words = [w.lower() if self.fold else w for w in m["words"]]
            test = lambda e: both(w in e[part] for w in words)
            keys = [{w.lower()} if len(w) >= 3 else None for w in words]
        elif kind == "regex":
            try:
                exprs = [re.compile(x) for x in m["regex"]]
            except (re.error, OverflowError, RecursionError) as e:
                raise ValueError(f"regex: {e}") from e
            test = lambda e: both(x.search(e[part]) is not None for x in exprs)
            keys = [{x} if (x := keywords.required_literal(p)) else None for p in m["regex"]]
        elif kind == "dsl":
            trees = [expr.parse(x) for x in m["dsl"]]
            test = lambda e: both(bool(expr.evaluate(t, e.get)) for t in trees)
            keys = [expr.triggers(t, keywords.required_literal) for t in trees]
        elif kind in ("status", "size"):
            name, values = ("status_code", set(m["status"])) if kind == "status" else ("content_length", set(m["size"]))
            test = lambda e: e[name] in values
            keys, every = [{mark(kind, v) for v in values}], False
            sure = values if kind == "status" else sure
        elif kind == "favicon":
            hashes = {h.strip().lower() for h in m["hash"]}
            test = lambda e: bool(hashes & e["hashes"])
            keys, every = [{mark("hash", h) for h in hashes}], False
        else:
            codes = [b.upper() for b in m["binary"]]
            test = lambda e: both(b in e[part].encode().hex().upper() for b in codes)
        if m["negative"]:
            return (lambda e: not test(e)), None, set()
        return test, self._both(keys) if every else self._either(keys, set()), set(sure)


def mark(kind: str, value: object) -> str:
    """Key of a status code, a size or a hash among keys that are texts."""
    return f"\0{kind}:{value}"


PARTS = ("body", "header", "all_headers", "all")


def catalogue(rows: DataFrame, payload: str = "payload", root: bool = False) -> tuple[list[dict], list[tuple[str | None, str]]]:
    """(templates, refused) of a catalogue table, which passes through the driver once; refused: (id, reason)."""
    good, bad = [], []
    for r in rows.select(payload).toLocalIterator():
        t, why = read_template(r[0])
        try:
            if t is not None:
                t = root_only(t) if root else t
                Compiled(t)
                good.append(t)
        except (ValueError, RecursionError) as e:
            t, why = None, f"{type(e).__name__}: {e}"
        if t is None:
            bad.append((None, why))
    return good, bad


def kept_block(packed: Sequence[bytes], digest: str, fold: bool, index: bool) -> tuple:
    """Compiled templates and their index; a worker keeps those of one block from task to task."""
    kept = sys.modules.setdefault("_lanthorn_kept", types.ModuleType("_lanthorn_kept")).__dict__.setdefault("templates", {})
    if digest not in kept:
        kept.clear()
        rules = [Compiled(pickle.loads(t), fold) for t in packed]  # read one by one: only what is compiled stays
        ids = sorted({r.id for r in rules})
        always = [r for r in rules if not index or (r.keys is None and not r.by_status)]
        plain = [r for r in rules if index and r.by_status]
        by_key: dict[str, list[Compiled]] = {}
        for r in rules:
            for k in r.keys or () if index and not r.by_status else ():
                by_key.setdefault(k, []).append(r)
        texts = sorted(k for k in by_key if k[0] != "\0")
        find = keywords.build_index(texts) if texts else lambda text: set()
        kept[digest] = rules, {x: i for i, x in enumerate(ids)}, pa.array(ids, pa.string()), always, plain, by_key, find, {}
    return kept[digest]


#: Bytes of templates, as JSON, in one pass: compiled they take many times that in each worker. Ids in an output batch.
BLOCK_BYTES, BATCH_IDS = 8 << 20, 100_000


def match_catalogue(responses: DataFrame, templates: Sequence[dict], fold: bool = True, block_bytes: int = BLOCK_BYTES, index: bool = True) -> DataFrame:
    """(resp_id, template_id): as ``match``, for catalogues of any length in one pass for each block of templates.

    Regular expressions are those of Python. Without ``index`` every template is evaluated on every response. A response
    may match thousands of templates, so batches end by the number of ids in them, and what a status code alone decides
    is held once for each code.
    """
    ev = events(spread(responses.select("resp_id", "raw")), fold).select("resp_id", "body", "all_headers", "status_code", "content_length")
    kind = ev.schema["resp_id"].dataType.simpleString()
    out = None

    def part(some: list[dict]) -> DataFrame:
        hashed = any("favicon" in str(t) for t in some)
        packed = [pickle.dumps(t) for t in some]
        digest = hashlib.blake2b(b"".join([bytes([fold, index]), *packed]), digest_size=16).hexdigest()
        given = ev.sparkSession.sparkContext.broadcast(packed)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rules, place, names, always, plain, by_key, find, by_code = kept_block(given.value, digest, fold, index)

            def cut(b: pa.RecordBatch, at: int, found: list[np.ndarray]) -> pa.RecordBatch:
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, names.take(pa.array(np.concatenate(found))))
                return pa.RecordBatch.from_arrays([b.column(0).slice(at, len(found)), lists], names=["resp_id", "found"])

            for b in batches:
                at, found, size = 0, [], 0
                cols = [c.to_pylist() for c in b.columns[1:]]
                raws = [x.encode("utf-8", "surrogatepass") for x in cols[0]] if hashed else []
                mm = mmh3_batch(raws).tolist() if raws else []
                for i, (body, headers, status, length) in enumerate(zip(*cols)):
                    hashes = {hashlib.md5(raws[i]).hexdigest(), str(mm[i])} if hashed else set()
                    e = {"body": body, "all_headers": headers, "header": headers, "all": headers + body, "status_code": status, "content_length": length, "hashes": hashes}
                    if status not in by_code:
                        by_code[status] = np.unique(np.array([place[r.id] for r in plain if r(e)] + [place[r.id] for r in rules if index and status in r.sure], np.int32))
                    keys = {*find(e["all"] if fold else e["all"].lower()), mark("status", status), mark("size", length), *(mark("hash", h) for h in hashes)}
                    near = {id(r): r for k in keys for r in by_key.get(k, ())}
                    more = {place[r.id] for r in (*near.values(), *always) if not (index and status in r.sure) and r(e)}
                    found.append(np.union1d(by_code[status], np.array(list(more), np.int32)) if more else by_code[status])
                    size += len(found[-1])
                    if size >= BATCH_IDS:
                        yield cut(b, at, found)
                        at, found, size = i + 1, [], 0
                if found:
                    yield cut(b, at, found)

        got = ev.mapInArrow(run, f"resp_id {kind}, found array<string>")
        return got.select("resp_id", F.explode("found").alias("template_id"))

    size, some = 0, []
    for t in [*sorted(templates, key=lambda t: t["id"]), None]:  # templates of one id stay together, so blocks share no pair
        if some and (t is None or size > block_bytes and t["id"] != some[-1]["id"]):
            out = part(some) if out is None else out.unionByName(part(some))
            size, some = 0, []
        if t is not None:
            some.append(t)
            size += len(json.dumps(t, default=str))
    return out if out is not None else ev.select("resp_id", F.lit("").alias("template_id")).where(F.lit(False))


def frameworks(responses: DataFrame, templates: Sequence[dict]) -> DataFrame:
    """(resp_id, template_id, name, vendor, product) of the templates that match."""
    rows = responses.sparkSession.createDataFrame(names(templates), "template_id string, name string, vendor string, product string")
    rows = rows.groupBy("template_id").agg(*[F.min(c).alias(c) for c in ("name", "vendor", "product")])
    return match_catalogue(responses, templates).join(few(rows), "template_id").select("resp_id", "template_id", "name", "vendor", "product")


def names(templates: Sequence[dict]) -> list[tuple[str, str, str | None, str | None]]:
    """(id, name, vendor, product): the name else the id; vendor and product only where they are texts."""
    text = lambda x: x if isinstance(x, str) else None
    return [(t["id"], t.get("name") or t["id"], text(t.get("metadata", {}).get("vendor")), text(t.get("metadata", {}).get("product"))) for t in templates]
