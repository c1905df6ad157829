"""Many substring patterns over many texts.

``scan`` runs an automaton of all patterns over each text inside the scan and adds the list of those found, so a text is
read once and travels once however many patterns there are. ``keyword_hits`` are its (text, pattern) pairs. It is
lossless and adds nothing: overlapping patterns and patterns within others are all found. ``brute_hits`` is the same as a
theta join, the semantic model of the first; ``window_hits`` decides each pair without the automaton, by the text's
substrings, so that the two can be compared on tables of any size.

The patterns pass through the driver once and are broadcast in blocks of at most BLOCK_BYTES, each with its own pass, so
the size of one automaton is bounded for any catalogue. A Python worker keeps its automaton from task to task.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns in one automaton.
BLOCK_BYTES = 32 << 20


class PlainIndex:
    """Substring search without the automaton library: patterns by their first characters."""

    def __init__(self, patterns: list[str]):
        self.q = min(4, min(map(len, patterns)))
        self.by: dict[str, list[str]] = {}
        for p in patterns:
            self.by.setdefault(p[: self.q], []).append(p)

    def find(self, text: str) -> set[str]:
        q, by = self.q, self.by
        return {p for i in range(len(text) - q + 1) if (c := by.get(text[i : i + q])) for p in c if text.startswith(p, i)}


def build_index(patterns: list[str]):
    """Function text -> set of patterns in it."""
    try:
        import ahocorasick
    except ImportError:
        return PlainIndex(patterns).find
    a = ahocorasick.Automaton()
    for p in patterns:
        a.add_word(p, p)
    a.make_automaton()
    return lambda text: {p for _, p in a.iter(text)}


def blocks(patterns: list[str], size: int) -> list[list[str]]:
    out: list[list[str]] = [[]]
    total = 0
    for p in patterns:
        n = len(p.encode("utf-8", "surrogatepass")) + 1
        if total + n > size and out[-1]:
            out.append([])
            total = 0
        out[-1].append(p)
        total += n
    return out if out[-1] else out[:-1]


def index_of(patterns: list[str], digest: str):
    """``build_index``, kept for the life of the worker process."""
    kept = sys.modules.setdefault("_lanthorn_kept", types.ModuleType("_lanthorn_kept")).__dict__.setdefault("indexes", {})
    if digest not in kept:
        if len(kept) > 7:
            kept.clear()
        kept[digest] = build_index(patterns)
    return kept[digest]


class Block:
    """Patterns of one automaton, as they are broadcast."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        h = hashlib.blake2b(digest_size=16)
        for p in patterns:
            h.update(p.encode("utf-8", "surrogatepass") + b"\0")
        self.digest = h.hexdigest()

    @property
    def find(self):
        return index_of(self.patterns, self.digest)


def scan(texts: DataFrame, patterns: list[str], text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``texts`` that hold a pattern, with ``found``: the patterns in column ``text``.

    Null texts and the empty pattern find nothing. A row comes once for each block of patterns that it holds one of;
    batches keep the rows they came with, so none is larger than what was read.
    """
    out = None
    fields = texts.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", found array<string>"
    at = texts.columns.index(text)

    def part(block: Block) -> DataFrame:
        given = texts.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = given.value.find
            for b in batches:
                found = [sorted(find(t)) if t else [] for t in b.column(at).to_pylist()]
                keep = [i for i, x in enumerate(found) if x]
                if keep:
                    rows = b.take(pa.array(keep, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([found[i] for i in keep], pa.list_(pa.string()))], names=[*b.schema.names, "found"])

        return texts.mapInArrow(run, schema)

    for block in blocks(sorted({p for p in patterns if p}), block_bytes):
        out = part(Block(block)) if out is None else out.unionByName(part(Block(block)))
    return out if out is not None else texts.withColumn("found", F.array().cast("array<string>")).where(F.lit(False))


def keyword_hits(texts: DataFrame, patterns: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, pattern) with the pattern in the text; ``texts`` is (id, text), ``patterns`` has a column pattern.

    Null texts and null patterns hit nothing, the empty pattern is in every text that is not null.
    """
    known = [r.pattern for r in patterns.where("pattern is not null").select("pattern").distinct().toLocalIterator()]
    out = scan(texts.select("id", "text"), known, block_bytes=block_bytes).select("id", F.explode("found").alias("pattern"))
    if "" in known:
        out = out.unionByName(texts.where("text is not null").select("id", F.lit("").alias("pattern")))
    return out


def compiles(pattern: Column) -> Column:
    """Whether the engine that runs regular expressions here takes the pattern; false for null."""
    return F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def with_literals(patterns: DataFrame) -> DataFrame:
    """(pattern, literal, ok) of distinct patterns: whether they compile, and a literal that every match holds or null."""

    @F.pandas_udf("string")
    def literal(s):
        import pandas as pd

        return pd.Series([required_literal(x) for x in s], dtype=object)

    d = patterns.select("pattern").where("pattern is not null").distinct()
    return d.select("pattern", literal("pattern").alias("literal"), compiles(F.col("pattern")).alias("ok"))


def bare_hits(texts: DataFrame, patterns: list[str], text: str = "text", flags: str = "") -> DataFrame:
    """Rows of ``texts`` with each of the ``pattern``s that match; for regular expressions without a literal.

    All of them as one alternation sort out texts that none matches; the others are tried one by one. Expressions that
    count groups cannot stand in an alternation and let every text pass.
    """
    if not patterns:
        return texts.withColumn("pattern", F.lit("")).where(F.lit(False))
    if not any(re.search(r"\\[1-9k]|\(\?[<P]", p) for p in patterns):
        texts = texts.where(F.regexp_like(F.col(text), F.lit(flags + "|".join(f"(?:{p})" for p in sorted(patterns)))))
    each = texts.withColumn("pattern", F.explode(F.array(*[F.lit(p) for p in sorted(patterns)])))
    return each.where(F.regexp_like(F.col(text), F.concat(F.lit(flags), "pattern")))


def brute_hits(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same pairs by a nested-loop join, for checks of the index on small tables."""
    p = patterns.select("pattern").where("pattern is not null").distinct()
    return texts.select("id", "text").join(p, F.contains("text", "pattern")).select("id", "pattern")


class Windows:
    """Substring search by the definition: a pattern is in a text if it equals one of the text's substrings.

    Substrings of all lengths that patterns have are looked up, at those places where the first characters are some
    pattern's, so the time does not grow with the number of patterns that begin alike.
    """

    def __init__(self, patterns: list[str]):
        self.known = set(patterns)
        found: dict[int, dict[str, set[int]]] = {}
        for p in self.known:
            found.setdefault(min(4, len(p)), {}).setdefault(p[:4], set()).add(len(p))
        self.lengths = {q: {k: sorted(v) for k, v in by.items()} for q, by in found.items()}

    def find(self, text: str) -> set[str]:
        known = self.known
        return {w for q, by in self.lengths.items() for i in range(len(text) - q + 1) for n in by.get(text[i : i + q], ()) if (w := text[i : i + n]) in known}


def window_hits(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same pairs as ``brute_hits`` with time in proportion to the texts, and without the automaton.

    The distinct patterns pass through the driver once, as they do for the index.
    """
    known = [r.pattern for r in patterns.where("pattern is not null").select("pattern").distinct().toLocalIterator()]
    given = texts.sparkSession.sparkContext.broadcast([p for p in known if p])
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Windows(given.value).find
        for b in batches:
            found = [sorted(find(t)) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["id", "found"])

    out = texts.select("id", "text").mapInArrow(run, f"id {kind}, found array<string>").select("id", F.explode("found").alias("pattern"))
    if "" in known:
        out = out.unionByName(texts.where("text is not null").select("id", F.lit("").alias("pattern")))
    return out


def required_literal(pattern: str) -> str | None:
    """A literal (lower case ASCII, 3 characters or more) that every match of a regular expression holds, or None.

    The pattern's own syntax tree is read; alternatives, optional parts and classes contribute nothing. Line breaks end
    a literal, so that it lies in the header or in the body of a message.
    """
    import warnings

    try:
        from re import _constants as c
        from re import _parser as parser
    except ImportError:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    best, run = "", ""

    def walk(nodes) -> None:
        nonlocal best, run
        for op, arg in nodes:
            if op is c.LITERAL and arg not in (10, 13):
                run += chr(arg)
                continue
            if op is c.SUBPATTERN and not arg[1] and not arg[2]:
                walk(arg[3])
                continue
            best, run = max(best, run, key=len), ""
            if op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
                best, run = max(best, run, key=len), ""

    walk(tree)
    best = max(best, run, key=len)
    return best.lower() if len(best) >= 3 and best.isascii() else None
