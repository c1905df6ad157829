"""Shredding of deeply nested records into an adjacency table and, from it, related flat tables.

Every value of a JSON payload becomes a row of the adjacency table: node, parent, label, ordinal, type and scalar.
``entity`` joins the object nodes of one path with their scalar children (grouping both by the owner node, one shuffle)
and pivots the children into columns; ``anc`` keeps the position of every enclosing list element, so a child row can
name its parent.

Defined results
---------------
* A null, broken or non-object payload has no nodes except a root row of type ``bad`` carrying the reason in ``scalar``.
* Text that holds a JSON object, list, string or null counts as that JSON, at every level and however often wrapped.
* A lone value in place of a list is a list of one: it has ordinal 0.
* Null list elements are counted in the ordinals; their nodes have type ``null``.
* Of two keys of one object that differ only in case, both are kept. A repeated key keeps its last value.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "node int, parent int, path string, label string, ordinal int, anc array<int>, type string, scalar string"


def unwrap(value: object) -> object:
    """The JSON that a text holds, however often it is wrapped; other values as they are."""
    while isinstance(value, str):
        s = value.strip()
        if not s or (s[0] not in '{["' and s != "null"):
            return value
        try:
            value = json.loads(s)
        except (ValueError, RecursionError):
            return value
    return value


def _type(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def shred_value(root: object, prefer: Sequence[Sequence[str]] = ()) -> Iterator[tuple]:
    """Rows of NODE for one parsed value, breadth by an explicit stack (any depth)."""
    stack: list[tuple] = [(root, -1, "", "", -1, [])]
    node = -1
    while stack:
        v, parent, path, label, ordinal, anc = stack.pop()
        v = unwrap(v)
        node += 1
        kind = _type(v)
        scalar = None
        if kind == "string":
            scalar = v
        elif kind in ("number", "boolean"):
            scalar = json.dumps(v)
        yield node, parent, path, label, ordinal, anc, kind, scalar
        if kind == "object":
            skip = set()
            for names in prefer:
                live = [k for k in names if unwrap(v.get(k)) is not None]
                skip.update(live[1:])
            for k, x in v.items():
                if k not in skip:
                    stack.append((x, node, f"{path}.{k}", k, 0, [*anc, 0]))
        elif kind == "array":
            for i, x in enumerate(v):
                # an element keeps the path of its list; a list within a list gets a step of its own
                at = [*anc[:-1], i]
                if isinstance(unwrap(x), list):
                    stack.append((x, node, path + "[]", label, i, [*at, 0]))
                else:
                    stack.append((x, node, path, label, i, at))


def shred(
    df: DataFrame, ids: Sequence[str], payload: str, prefer: Sequence[Sequence[str]] = ()
) -> DataFrame:
    """The adjacency table of a column of JSON texts.

    ``prefer`` lists groups of alternative keys: of the keys of one group that an object holds with a value, only the
    first is followed. ``key`` tells rows apart that share their ids; nothing but the ids, the payload and a hash
    leaves the scan.
    """
    prefer = [list(p) for p in prefer]
    src = df.select(*ids, F.xxhash64(*ids, payload).alias("key"), F.col(payload).cast("string").alias("_payload"))
    fields = [src.schema[c] for c in (*ids, "key")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + NODE
    n_ids = len(fields)
    cols = ["node", "parent", "path", "label", "ordinal", "anc", "type", "scalar"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(batch, idx, out):
            take = pa.array(idx, pa.int32())
            arrays = [batch.column(i).take(take) for i in range(n_ids)]
            arrays += [pa.array(list(x), t) for x, t in zip(zip(*out), kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:n_ids], *cols])

        for batch in batches:
            idx: list[int] = []
            out: list[tuple] = []
            for i, text in enumerate(batch.column(n_ids).to_pylist()):
                reason = None
                root: object = None
                if text is None:
                    reason = "null"
                else:
                    try:
                        root = unwrap(json.loads(text))
                        reason = None if isinstance(root, dict) else "not an object"
                    except RecursionError:
                        reason = "too deep"
                    except ValueError:
                        reason = "broken"
                if reason:
                    out.append((0, -1, "", "", -1, [], "bad", reason))
                    idx.append(i)
                else:
                    rows = list(shred_value(root, prefer))
                    out.extend(rows)
                    idx.extend([i] * len(rows))
                if len(out) > 50_000:
                    yield flush(batch, idx, out)
                    idx, out = [], []
            if out:
                yield flush(batch, idx, out)

    return src.mapInArrow(run, schema)


def element() -> Column:
    """Whether a node is a list element or lone value, not the list around it and not null."""
    return ~F.col("type").isin("array", "null", "bad")


def _lookup(d: dict[str, str], key: Column) -> Column:
    if not d:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), key)


def entities(nodes: DataFrame, ids: Sequence[str], spec: dict[str, tuple[Sequence[str], dict[str, str]]]) -> DataFrame:
    """Flat tables of several entities in one pass over the adjacency table.

    ``spec`` maps an entity's name to (paths of its nodes, {column: label of a scalar child}); a path that ends in
    ``.*`` means every key with a value of the object before it. Object nodes meet their scalar children by the
    owner's node id and the children are pivoted into the columns. One row per entity node: ids, key, entity, node,
    parent, anc, label, scalar and the columns (null where there is no such child, and where a list stands in its place:
    ``items`` gives its elements).
    """
    of_path = {p: name for name, (paths, _) in spec.items() for p in paths if not p.endswith(".*")}
    stars = {p[:-1]: name for name, (paths, _) in spec.items() for p in paths if p.endswith(".*")}
    child = {f"{p}.{label}": c for paths, cols in spec.values() for c, label in cols.items() for p in paths}
    columns = sorted({c for _, cols in spec.values() for c in cols})
    path, live = F.col("path"), ~F.col("type").isin("null", "bad")
    star = F.lit(False)
    name = F.when(element(), _lookup(of_path, path))
    for prefix, e in stars.items():
        hit = live & (path == F.concat(F.lit(prefix), F.col("label")))
        star, name = star | hit, F.when(hit, F.lit(e)).otherwise(name)
    keep = nodes.where(star | (element() & path.isin(*of_path, *child)))
    own = keep.withColumn("entity", name).withColumn("_col", F.when(element(), _lookup(child, path)))
    own = own.withColumn("_owner", F.when(F.col("entity").isNotNull(), F.col("node")).otherwise(F.col("parent")))
    head = F.max(F.when(F.col("entity").isNotNull(), F.struct("entity", "node", "parent", "anc", "label", "scalar")))
    pivot = [F.min(F.when(F.col("_col") == c, F.struct("ordinal", "scalar")))["scalar"].alias(c) for c in columns]
    return (
        own.groupBy(*ids, "key", "_owner")
        .agg(head.alias("_e"), *pivot)
        .where(F.col("_e").isNotNull())
        .select(*ids, "key", "_e.*", *columns)
    )


def items(nodes: DataFrame, ids: Sequence[str], owners: dict[str, Sequence[str]], depth: int = 2) -> DataFrame:
    """The lists below entities as a child table: one row per scalar under a node of an owner's paths.

    ``owners`` maps an entity's name to the paths of its nodes. Rows: ids, key, entity, anc (positions of the owner and of
    all lists around it), field (the path below the owner, ``depth`` steps at most), pos (position in its list, 0 for a
    lone value) and value. Null elements are counted and not returned. No shuffle: a node knows its path and positions.
    """
    out = F.lit(None).cast("struct<entity:string,field:string,steps:int>")
    for name, paths in owners.items():
        for p in paths:
            below = F.substr("path", F.lit(len(p) + 2))
            steps = F.size(F.split(below, "[.]"))
            hit = F.col("path").startswith(p + ".") & ~F.contains(below, F.lit("[]")) & (steps <= depth)
            out = F.when(hit, F.struct(F.lit(name).alias("entity"), below.alias("field"), steps.alias("steps"))).otherwise(out)
    d = nodes.where(F.col("scalar").isNotNull() & ~F.col("type").isin("array", "object", "null", "bad")).withColumn("_o", out).where("_o is not null")
    anc = F.slice("anc", 1, F.size("anc") - F.col("_o.steps"))
    return d.select(*ids, "key", "_o.entity", anc.alias("anc"), "_o.field", F.element_at("anc", -1).alias("pos"), F.col("scalar").alias("value"))
