"""Schemas that drift between the files of a feed.

Records load as path-value maps with raw types: one row per record and path with the type and the raw JSON text of its
value. Per feed and file the types of each path are aggregated; each file is compared with the one before it and the
changes are reported. The steady table then projects the fields of a kind of feed to typed columns by following the
renames back to the first name, and reports the casts that failed.

A path is a top-level field, or with ``depth`` above 1 ``field.key`` for the keys of an object and ``field[]`` for the
elements of a list. A type is string, number, boolean, object or array of the types its elements have, as
``array<string>`` or ``array<number,string>``.

Defined results: a null value is no value, a null element gives its list no type, an empty list is ``array<>``. Payloads
that are no JSON object and rows without feed or file number take no part in the changes; these and records without a
name have no row in the steady table, and ``refused`` gives them with the reason. A file delivered twice counts once:
its fields and types are sets. Where the file before is missing there is nothing to compare.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanthorn.session import checkpoint

#: Share of the records with a value on both sides whose values must agree for a rename.
SAME_SHARE = 0.5


#: Rows of the table of moved fields that are broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def _type(v: object) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, list):
        return f"array<{','.join(sorted({_type(x).partition('<')[0] for x in v if x is not None}))}>"
    return "string" if isinstance(v, str) else "object"


def _paths(o: dict, depth: int) -> Iterator[tuple[str, object]]:
    """(path, value) of all values but nulls, down to ``depth`` steps."""
    stack: list[tuple[str, object, int]] = [(k, v, 1) for k, v in o.items()]
    while stack:
        path, v, at = stack.pop()
        if v is None:
            continue
        yield path, v
        if at < depth and isinstance(v, dict):
            stack += [(f"{path}.{k}", x, at + 1) for k, x in v.items()]
        elif at < depth and isinstance(v, list):
            stack += [(f"{path}[]", x, at + 1) for x in v]


def path_values(df: DataFrame, payload: str = "payload", names: Sequence[str] = ("app", "id"), depth: int = 1) -> DataFrame:
    """(feed, file_seq, record, field, type, raw) for every value down to ``depth``; field is its path, raw canonical JSON.

    A record is named by the first of ``names`` that it has.
    """
    names = list(names)
    cols = ["feed", "file_seq", "record", "field", "type", "raw"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
    src = df.select(F.col("feed").cast("string"), F.col("file_seq").cast("int"), F.col(payload).alias("payload"))
    src = src.where("feed is not null and file_seq is not null and payload is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for feed, seq, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    o = json.loads(text)
                except (ValueError, RecursionError):
                    continue
                if not isinstance(o, dict):
                    continue
                name = next((o[k] for k in names if o.get(k) is not None), None)
                name = name if name is None or isinstance(name, str) else json.dumps(name)
                for k, v in _paths(o, depth):
                    out.append((feed, seq, name, k, _type(v), json.dumps(v, sort_keys=True, ensure_ascii=False)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), kinds)], names=cols)

    return src.mapInArrow(run, "feed string, file_seq int, record string, field string, type string, raw string")


def refused(df: DataFrame, key: str, names: dict[str, str], payload: str = "payload") -> DataFrame:
    """(``key``, reason) of the rows that no steady table holds; ``names`` maps the start of a feed to the record's name.

    Reasons, the first that holds: ``feed`` (none, or of no kind), ``file_seq``, ``null``, ``broken``, ``not an object``,
    ``name``.
    """
    src = df.select(F.col(key), F.col("feed").cast("string"), F.col("file_seq").cast("int"), F.col(payload).cast("string").alias("payload"))
    field = src.schema[key]
    names = dict(names)

    def reason(feed, seq, text) -> str | None:
        name = next((n for p, n in names.items() if feed is not None and feed.startswith(p)), None)
        if name is None or seq is None:
            return "feed" if name is None else "file_seq"
        if text is None:
            return "null"
        try:
            o = json.loads(text)
        except (ValueError, RecursionError):
            return "broken"
        if not isinstance(o, dict):
            return "not an object"
        return "name" if o.get(name) is None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([reason(*v) for v in zip(*(c.to_pylist() for c in b.columns[1:]))], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), found], names=[key, "reason"])

    return src.mapInArrow(run, f"`{key}` {field.dataType.simpleString()}, reason string").where("reason is not null")


def file_fields(values: DataFrame) -> DataFrame:
    """Per feed and file: map of field to its sorted set of types. Partial sets form before the shuffle."""
    per_field = values.groupBy("feed", "file_seq", "field").agg(F.sort_array(F.collect_set("type")).alias("types"))
    return per_field.groupBy("feed", "file_seq").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "types"))).alias("fields")
    )


def changes(df: DataFrame, same_share: float = SAME_SHARE, names: Sequence[str] = ("app", "id"), depth: int = 1) -> DataFrame:
    """(feed, file_seq, change, field, new_field): added, removed, renamed and retyped against file_seq - 1."""
    values = checkpoint(path_values(df, names=names, depth=depth))
    return changes_of(values, checkpoint(file_fields(values)), same_share)


def changes_of(values: DataFrame, files: DataFrame, same_share: float = SAME_SHARE) -> DataFrame:
    """The changes given the path-value rows and their statistics by file.

    A rename is the best pair of a field that went and one that came, mutually, whose values agree for at least
    ``same_share`` of the records that have both. Only values of fields that moved are looked at. They are grouped by
    record, and by record and value, into sets of field names, so that no group grows with the rows of one record.
    """
    by_feed = Window.partitionBy("feed").orderBy("file_seq")  # one row per file
    old, new = F.map_keys("old"), F.map_keys("fields")
    pair = files.withColumns({"before": F.lag("file_seq").over(by_feed), "old": F.lag("fields").over(by_feed)})
    pair = pair.where(F.col("before") == F.col("file_seq") - 1).select(
        "feed", "file_seq", F.array_except(old, new).alias("went"), F.array_except(new, old).alias("came"),
        F.filter(F.array_intersect(old, new), lambda f: F.element_at("fields", f) != F.element_at("old", f)).alias("retyped"),
    )
    pair = checkpoint(pair)
    # only transitions with both a field that went and one that came can hold a rename
    side = lambda fields, back, was: F.transform(fields, lambda f: F.struct((F.col("file_seq") - back).alias("at"), f.alias("field"), F.lit(was).alias("was")))
    moving = pair.where((F.size("went") > 0) & (F.size("came") > 0))
    moving = moving.select("feed", "file_seq", F.explode(F.concat(side("went", 1, True), side("came", 0, False))).alias("m")).select("feed", "file_seq", "m.*")
    if moving.count() <= BROADCAST_ROWS:
        moving = F.broadcast(moving)
    facts = values.where("record is not null").select("feed", F.col("file_seq").alias("at"), "record", "field", F.xxhash64("raw").alias("raw"))
    moved = facts.join(moving, ["feed", "at", "field"])
    key = ["feed", "file_seq", "field", "new_field"]
    names = [F.collect_set(F.when(was, F.col("field"))).alias(c) for was, c in ((F.col("was"), "olds"), (~F.col("was"), "news"))]

    def pairs(d: DataFrame) -> DataFrame:
        d = d.agg(*names).where((F.size("olds") > 0) & (F.size("news") > 0))
        return d.withColumn("field", F.explode("olds")).withColumn("new_field", F.explode("news"))

    have = pairs(moved.groupBy("feed", "file_seq", "record")).groupBy(*key).agg(F.count("*").alias("n"))
    agree = pairs(moved.groupBy("feed", "file_seq", "record", "raw")).select(*key, "record").distinct().groupBy(*key).agg(F.count("*").alias("same"))
    score = have.join(agree, key).where(F.col("same") >= F.col("n") * F.lit(same_share))
    # mutual best by agreement, ties by name: a file has at most (fields that went) x (fields that came) candidates
    rank = F.struct((F.col("same") / F.col("n")).alias("share"), "same", "field", "new_field")
    best = score.groupBy("feed", "file_seq").agg(F.collect_list(rank).alias("r"))
    rival = lambda x: F.exists("r", lambda y: ((y["field"] == x["field"]) | (y["new_field"] == x["new_field"])) & (y > x))
    best = best.select("feed", "file_seq", F.filter("r", lambda x: ~rival(x)).alias("renamed"))
    both = pair.join(best, ["feed", "file_seq"], "left")
    renamed = F.coalesce("renamed", F.array().cast("array<struct<share:double,same:bigint,field:string,new_field:string>>"))
    left = lambda fields, c: F.filter(fields, lambda f: ~F.exists(renamed, lambda r: r[c] == f))
    row = lambda change, f, g: F.struct(F.lit(change).alias("change"), f.alias("field"), g.alias("new_field"))
    found = F.concat(
        F.transform(renamed, lambda r: row("renamed", r["field"], r["new_field"])),
        F.transform(left("went", "field"), lambda f: row("removed", f, F.lit(""))),
        F.transform(left("came", "new_field"), lambda f: row("added", f, F.lit(""))),
        F.transform("retyped", lambda f: row("retyped", f, F.lit(""))),
    )
    return both.select("feed", "file_seq", F.explode(found).alias("x")).select("feed", "file_seq", "x.*")


def steady_names(found: DataFrame, files: DataFrame) -> DataFrame:
    """(feed, file_seq, field, column): the steady column of each field of each file.

    A field's column is the name under which it first came; renames are followed file by file. A group holds one row per
    file of a feed with its field names, so a feed of 100,000 files with 100 fields is folded in about a gigabyte.
    """
    per_file = files.select("feed", "file_seq", F.map_keys("fields").alias("fields"))
    moves = (
        found.where("change = 'renamed'")
        .groupBy("feed", "file_seq")
        .agg(F.map_from_entries(F.collect_list(F.struct("new_field", "field"))).alias("moves"))
    )
    hist = per_file.join(moves, ["feed", "file_seq"], "left")

    def fold(pdf):
        import pandas as pd

        known: dict[str, str] = {}
        rows = []
        for r in pdf.sort_values("file_seq").itertuples():
            moves = dict(r.moves) if isinstance(r.moves, (dict, list)) else {}
            now = {f: known.get(moves.get(f, f), moves.get(f, f)) for f in r.fields}
            known.update(now)
            rows += [(r.feed, r.file_seq, f, c) for f, c in now.items()]
        return pd.DataFrame(rows, columns=["feed", "file_seq", "field", "column"])

    return hist.groupBy("feed").applyInPandas(fold, "feed string, file_seq int, field string, column string")


def steady_table(df: DataFrame, columns: dict[str, str], names: Sequence[str] = ("app", "id")) -> DataFrame:
    """One row per (feed, file_seq, record) with ``columns`` (name to text, number or list) and the failed casts.

    ``failed`` lists the columns whose value could not become the column's type; such a cell is null. Fields outside
    ``columns`` are kept as a JSON map in ``rest``. A record delivered twice gives one row; of different values of one
    cell the largest text is taken.
    """
    values = checkpoint(path_values(df, names=names))
    files = checkpoint(file_fields(values))
    found = changes_of(values, files)
    cells = values.join(steady_names(found, files), ["feed", "file_seq", "field"]).where("record is not null")
    once = cells.groupBy("feed", "file_seq", "record", "column").agg(F.max(F.struct("type", "raw")).alias("v"))
    other = F.when(~F.col("column").isin(*columns), F.struct("column", "v.raw"))
    wide = once.groupBy("feed", "file_seq", "record").agg(
        *[F.max(F.when(F.col("column") == c, F.col("v"))).alias(f"_{c}") for c in columns],
        F.map_from_entries(F.sort_array(F.collect_list(other))).alias("_rest"),
    )
    out, failed = [], []
    for c, kind in columns.items():
        typ, raw = F.col(f"_{c}.type"), F.col(f"_{c}.raw")
        text = F.when(typ == "string", F.try_variant_get(F.try_parse_json(raw), "$", "string")).otherwise(raw)
        if kind == "number":
            cell = F.expr(f"try_cast(case when _{c}.type in ('number', 'string') then trim('\"' from _{c}.raw) end as double)")
        elif kind == "list":
            cell = F.when(typ.startswith("array"), F.from_json(raw, "array<string>")).when(typ.isNotNull(), F.array(text))
        else:
            cell = F.when(typ != "object", F.when(typ.startswith("array"), raw).otherwise(text))
        out.append(cell.alias(c))
        failed.append(F.when(typ.isNotNull() & cell.isNull(), F.lit(c)))
    return wide.select("feed", "file_seq", "record", *out, F.array_compact(F.array(*failed)).alias("failed"), F.to_json("_rest").alias("rest"))
