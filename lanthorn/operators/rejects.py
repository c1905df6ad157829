"""Delimited rows that fail to parse: structural indexing with numpy, then counted and typed checks.

A batch of records is one byte buffer. A mask of its quotes and the parity of their running count tell which commas and
line breaks are outside quotes; those delimit fields and records. Counts and type checks on the fields then make each
record a typed row or a refused row with the first reason that holds: quoting, columns, value, keyword, pattern.

``read_records`` loads files of any size: each block of a file counts its quotes, the parity before a block follows from
the blocks before it, and then every block finds the line breaks outside quotes on its own. Only the records that reach
over a block's end are put together from parts.

Defined results: a null line is an empty one (``columns``). Texts of any length are indexed whole. Bytes are those of
UTF-8, in which quote, comma and line break never occur inside another character.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE, COMMA, NEWLINE = 0x22, 0x2C, 0x0A
VALID = (
    "entry_id bigint, catalog string, name string, field string, value string, level int, keywords array<string>, "
    "expression string, reason string"
)
#: catalog and field that belong together
KINDS = {("native", "regexp"), ("wapp", "html"), ("ehole", "keyword")}


def parity(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quote mask, and for each byte whether an odd number of quotes lies before it in the buffer."""
    quotes = buf == QUOTE
    before = np.cumsum(quotes, dtype=np.int64) - quotes
    return quotes, (before & 1).astype(bool)


def record_ends(buf: np.ndarray, begins_inside: bool = False) -> np.ndarray:
    """Positions of the line breaks that end records (those outside quotes)."""
    _, inside = parity(buf)
    return np.flatnonzero((buf == NEWLINE) & (inside == begins_inside))


#: Blocks whose parities are broadcast at most: 125 TB in blocks of 128 MB.
MOST_BLOCKS = 1_000_000


def _block_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """((file, block), text) of runs of physical lines of one block, each line with its break."""
    for b in batches:
        files, blocks, lines = (c.to_pylist() for c in b.columns)
        at = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or (files[i], blocks[i]) != (files[at], blocks[at]):
                yield (files[at], blocks[at]), "".join(x + "\n" for x in lines[at:i]).encode()
                at = i


def read_records(spark: SparkSession, path: str, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(file_name, block, record_no, line_text): the records of delimited files, line breaks within quotes kept.

    record_no counts within a block. A quote that is never closed takes the rest of its file into its record, which
    ``parse_lines`` then refuses for its quoting. Line ends are LF or CR LF; empty lines are no records.
    """
    meta = [F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*meta, "value")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), data in _block_lines(batches):
            n = int((np.frombuffer(data, np.uint8) == QUOTE).sum())
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([n], pa.int64())], names=["file_name", "block", "n"])

    quotes = lines.mapInArrow(count, "file_name string, block bigint, n bigint").groupBy("file_name", "block").agg(F.sum("n").alias("n"))
    rows = quotes.limit(most_blocks + 1).collect()
    if len(rows) > most_blocks:
        raise ValueError(f"more than {most_blocks} blocks: read the files in several calls")
    odd: dict[tuple[str, int], bool] = {}
    for file in {r.file_name for r in rows}:
        inside = False
        for r in sorted((r for r in rows if r.file_name == file), key=lambda r: r.block):
            odd[file, r.block] = inside
            inside ^= bool(r.n & 1)
    given = spark.sparkContext.broadcast(odd)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = given.value
        # part: 0 a whole record, 1 the beginning of one that goes on in the next block, 2 what goes on from the one before
        key, inside, open_, no, first = None, False, b"", 0, False

        def rest() -> list[tuple]:
            return [(*key, no, 2 if first else 1, open_)] if key and open_ else []

        for now, data in _block_lines(batches):
            out: list[tuple] = []
            if now != key:
                out += rest()
                key, inside, open_, no = now, odd[now], b"", 0
                first = inside
            buf = np.frombuffer(data, np.uint8)
            ends = record_ends(buf, inside)
            at = 0
            for e in ends.tolist():
                record = open_ + data[at:e]
                if record.strip():
                    out.append((*key, no, 2 if first else 0, record))
                    no += 1
                open_, at, first = b"", e + 1, False
            open_ += data[at:]
            inside ^= bool(int((buf == QUOTE).sum()) & 1)
            if out:
                yield flush(out)
        if key and (out := rest()):
            yield flush(out)

    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string())
    names = ["file_name", "block", "record_no", "part", "line_text"]

    def flush(out: list[tuple]) -> pa.RecordBatch:
        texts = [(*x[:4], (x[4] if x[3] == 1 else x[4].removesuffix(b"\r")).decode("utf-8", "replace")) for x in out]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*texts), kinds)], names=names)

    parts = lines.mapInArrow(cut, "file_name string, block bigint, record_no int, part int, line_text string")
    whole = parts.where("part = 0").select("file_name", "block", "record_no", "line_text")
    # at most two parts of each block: the record they belong to begins in the last block before with a beginning
    some = parts.where("part > 0")
    order = Window.partitionBy("file_name").orderBy("block", F.desc("part"))
    chain = some.withColumn("g", F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).over(order))
    joined = chain.groupBy("file_name", "g").agg(F.min("block").alias("block"), F.min_by("record_no", F.struct("block", -F.col("part"))).alias("record_no"), F.sort_array(F.collect_list(F.struct("block", -F.col("part"), "line_text"))).alias("p"))
    return whole.unionByName(joined.select("file_name", "block", "record_no", F.array_join(F.col("p.line_text"), "").alias("line_text")))


def index_records(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Field delimiters of records that lie end to end in ``data`` at ``offsets`` (n + 1 positions).

    Returns (record of each delimiter, position of each delimiter, whether each record's quoting is broken).
    """
    n = len(offsets) - 1
    buf = np.frombuffer(data, np.uint8)
    lens = np.diff(offsets)
    rec = np.repeat(np.arange(n), lens)
    quotes = buf == QUOTE
    total = np.concatenate([[0], np.cumsum(quotes, dtype=np.int64)])
    inside = ((total[:-1] - total[offsets[:-1]][rec]) & 1).astype(bool)  # parity from the start of the own record
    bad = ((total[offsets[1:]] - total[offsets[:-1]]) & 1).astype(bool)
    at = np.flatnonzero(quotes)
    if len(at):
        r = rec[at]
        first, last = at == offsets[:-1][r], at == offsets[1:][r] - 1
        prev, nxt = buf[np.maximum(at - 1, 0)], buf[np.minimum(at + 1, len(buf) - 1)]
        opens = ~inside[at]
        # an opening quote stands at a field's start or doubles the quote before it; a closing one ends a field or is doubled
        ok = np.where(opens, first | (prev == COMMA) | (prev == QUOTE), last | (nxt == COMMA) | (nxt == QUOTE))
        bad[np.unique(r[~ok])] = True
    cut = np.flatnonzero((buf == COMMA) & ~inside)
    return rec[cut], cut, bad


def _field(raw: bytes) -> str:
    s = raw.decode("utf-8", "replace")
    return s[1:-1].replace('""', '"') if s[:1] == '"' else s


def compiled_groups(pattern: str) -> int:
    """Number of groups of a regular expression, -1 if it does not compile."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return re.compile(pattern).groups
    except (re.error, OverflowError, RecursionError):
        return -1


def check_fields(f: list[str]) -> tuple:
    """A VALID row of six fields: typed, or all null but the reason."""
    entry, catalog, name, field, value, level = f
    no = (None,) * 8

    def refused(why: str) -> tuple:
        return (*no, why)

    if not (re.fullmatch(r"[0-9]+", entry) and len(entry.lstrip("0")) <= 18):
        return refused("value")
    if (catalog, field) not in KINDS or not name.strip() or not re.fullmatch(r"[0-5]", level):
        return refused("value")
    words, expression = None, None
    if field == "keyword":
        try:
            words = json.loads(value)
        except (ValueError, RecursionError):
            return refused("keyword")
        if not (isinstance(words, list) and words and all(isinstance(w, str) for w in words)):
            return refused("keyword")
    else:
        expression, *options = value.split(r"\;") if field == "html" else [value]
        groups = compiled_groups(expression)
        if groups < 0:
            return refused("pattern")
        for o in options:
            if (m := re.fullmatch(r"version:(.*)", o, re.S)) and any(int(g) > groups for g in re.findall(r"\\(\d+)", m[1])):
                return refused("pattern")
    return int(entry), catalog, name, field, value, int(level), words, expression, None


def parse_lines(df: DataFrame, line: str = "line_text") -> DataFrame:
    """All columns of ``df`` but the line, and the VALID columns: a typed row (reason null) or a refused one.

    Names of ``df`` that clash with those columns come out with a leading ``src_``.
    """
    names = [c for c in df.columns if c != line]
    typed = [c.split()[0] for c in VALID.split(", ")]
    src = df.select(*[df[c].alias(f"src_{c}" if c in typed else c) for c in names], df[line].cast("string").alias("_line"))
    kept = src.schema.fields[:-1]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + VALID
    types = [pa.int64(), *[pa.string()] * 4, pa.int32(), pa.list_(pa.string()), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the lines of a batch as one buffer, a record at each offset
            lines = [(x or "").encode() for x in batch.column(batch.num_columns - 1).to_pylist()]
            data = b"".join(lines)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lines], dtype=np.int64)]).astype(np.int64)
            rec, cut, bad = index_records(data, offsets)
            fields = np.bincount(rec, minlength=len(lines)) + 1
            start = np.concatenate([[0], np.cumsum(fields - 1)])
            out = []
            for i in range(len(lines)):
                if bad[i]:
                    out.append((*(None,) * 8, "quoting"))
                elif fields[i] != 6:
                    out.append((*(None,) * 8, "columns"))
                else:
                    at = [int(offsets[i]) - 1, *cut[start[i] : start[i + 1]].tolist(), int(offsets[i + 1])]
                    out.append(check_fields([_field(data[a + 1 : b]) for a, b in zip(at, at[1:])]))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays += [pa.array(list(x), t) for x, t in zip(zip(*out) if out else [[]] * 9, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*[f.name for f in kept], *typed])

    return src.mapInArrow(run, schema)
