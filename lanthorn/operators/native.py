"""The native rule engine: entries with ordered rules of eight kinds of matchers.

A rule matches by the first of: vuln regexp, regexp, header keyword, body keyword, body md5, body mmh3 (ranks 1 to 6);
only if none of these hits, by a certificate keyword (rank 7). A finger's result comes from its first matching rule.
Matching runs on the lower-case message; keywords are lowered, certificates compared as written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanthorn.functions.mmh3 import mmh3
from lanthorn.operators import keywords, parse
from lanthorn.session import checkpoint, few, spread

KINDS = ("vuln", "regexp", "header", "body", "md5", "mmh3", "cert")


def http_entries(entries: DataFrame) -> DataFrame:
    """Entries of the http protocol, which is the default."""
    return entries.where(F.lower(F.trim(F.coalesce("protocol", F.lit("http")))) == "http")


def rules(entries: DataFrame) -> DataFrame:
    """(finger columns, rule_idx, r): one row per rule that is not null."""
    return entries.select("*", F.posexplode("rule").alias("rule_idx", "r")).where("r is not null").drop("rule")


def _patterns(kind: str, rank: int) -> Column:
    low = kind in ("header", "body")

    def item(x: Column, i: Column) -> Column:
        pattern = F.lower(x) if low else x
        return F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("kind_rank"), i.alias("matcher_idx"), pattern.alias("pattern"))

    return F.transform(F.coalesce(F.col(f"r.regexps.{kind}"), F.array().cast("array<string>")), item)


def matchers(entries: DataFrame) -> DataFrame:
    """(finger_id, rule_idx, kind, kind_rank, matcher_idx, pattern): every pattern of every rule."""
    lists = [_patterns(kind, rank) for rank, kind in enumerate(KINDS, 1)]
    out = rules(entries).select("finger_id", "rule_idx", F.explode(F.concat(*lists)).alias("m"))
    return out.select("finger_id", "rule_idx", "m.*").where("pattern is not null")


#: Places in a message that a pattern is looked for in, by its mark in the index; regular expressions run on the whole.
MARKS = {"header": "h", "body": "b", "cert": "c"}


def located(responses: DataFrame, marked: list[str]) -> DataFrame:
    """(resp_id, content, found) of the responses that hold an indexed literal, found with the mark of its place.

    One automaton pass over the lower-case message, split at its separator, and over the certificate. ``marked`` holds
    literals behind their marks, mark ``a`` meaning anywhere in the message; the message comes along where such a one is
    found.
    """
    by_place: dict[str, set[str]] = {}
    for x in marked:
        by_place.setdefault(x[0], set()).add(x[1:])
    p = spread(responses.select("resp_id", "raw", "cert")).select("resp_id", F.lower("raw").alias("content"), "cert").where("content is not null or cert is not null")
    kind = p.schema["resp_id"].dataType.simpleString()
    out = None

    def part(block: keywords.Block) -> DataFrame:
        mine = {k: v & set(block.patterns) for k, v in by_place.items()}
        given = p.sparkSession.sparkContext.broadcast((block, mine))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, mine = given.value
            find, none = block.find, set()
            anywhere = mine.get("a", none)
            for b in batches:
                keep, texts, lists = [], [], []
                for i, (content, cert) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                    found, seen = [], set()
                    if content:
                        header, sep, body = content.partition(parse.CRLF2)
                        for mark, text in (("h", header if sep else ""), ("b", body if sep else content)):
                            if text:
                                got = find(text)
                                seen |= got & anywhere
                                found += [mark + x for x in got & mine.get(mark, none)]
                        found += ["a" + x for x in seen]
                    if cert and "c" in mine:
                        found += ["c" + x for x in find(cert) & mine["c"]]
                    if found:
                        keep.append(i)
                        texts.append(content if seen else None)
                        lists.append(found)
                if keep:
                    ids = b.column(0).take(pa.array(keep, pa.int32()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array(lists, pa.list_(pa.string()))], names=["resp_id", "content", "found"])

        return p.mapInArrow(run, f"resp_id {kind}, content string, found array<string>")

    for block in keywords.blocks(sorted({x[1:] for x in marked if len(x) > 1}), keywords.BLOCK_BYTES):
        out = part(keywords.Block(block)) if out is None else out.unionByName(part(keywords.Block(block)))
    return out if out is not None else p.select("resp_id", "content", F.array().cast("array<string>").alias("found")).where(F.lit(False))


def refused_patterns(entries: DataFrame) -> DataFrame:
    """(finger_id, rule_idx, kind, matcher_idx, pattern) of the regular expressions that do not compile; no rule uses them."""
    m = matchers(entries).where("kind in ('vuln', 'regexp')")
    return m.where(~keywords.compiles(F.col("pattern"))).drop("kind_rank")


#: First character of the key by which a matcher is found: the mark of its place, of an expression or of a hash.
KEYS = MARKS | {"vuln": "r", "regexp": "r", "md5": "5", "mmh3": "6"}


def keyed(entries: DataFrame, kinds: Sequence[str] = KINDS) -> tuple[DataFrame, DataFrame]:
    """(matchers of ``kinds`` with their key, (pattern, literal) of their regular expressions); those that do not compile
    are in neither."""
    m = checkpoint(matchers(http_entries(entries)).where(F.col("kind").isin(*kinds)))
    known = checkpoint(keywords.with_literals(m.where("kind in ('vuln', 'regexp')"))).where("ok").drop("ok")
    mark = F.create_map(*[F.lit(x) for kv in KEYS.items() for x in kv])
    expr = F.col("kind").isin("vuln", "regexp")
    good = m.where(~expr).unionByName(m.where(expr).join(few(known.select("pattern")), "pattern").select(*m.columns))
    return good.withColumn("key", F.concat(F.try_element_at(mark, F.col("kind")), "pattern")), known


def marks(responses: DataFrame, dim: DataFrame, exprs: DataFrame) -> DataFrame:
    """(resp_id, key, captured): the keys of ``keyed`` matchers that each response holds, whatever entries list them.

    One automaton pass finds keywords and the required literals of regular expressions; a regular expression then runs
    only on the texts that hold its literal, which came along, so nothing is joined back to the responses. Hash kinds
    are equi-joins. Kinds without a pattern cost nothing. captured is group 1 of regular expressions.
    """
    p = parse.parsed(responses)
    present = {r.kind for r in dim.select("kind").distinct().collect()}
    words = dim.where(F.col("kind").isin(*MARKS)).select("key").distinct()
    literals = exprs.where("literal is not null").select(F.concat(F.lit("a"), "literal").alias("key"), "pattern")
    marked = [r.key for r in words.unionByName(literals.select("key").distinct()).toLocalIterator()]
    # the empty group stands in where a pattern has none
    found = F.expr("trim(regexp_extract(content, concat('(?i)', pattern, '()'), 1))")
    none = F.lit(None).cast("string").alias("captured")
    own = F.concat(F.lit("r"), "pattern").alias("key")
    met = located(responses, marked).select("resp_id", "content", F.explode("found").alias("key"))
    far = F.startswith("key", F.lit("a"))
    met = met.withColumn("content", F.when(far, F.col("content"))).join(few(literals), "key", "left")
    met = met.where(~far | F.regexp_like("content", F.concat(F.lit("(?i)"), "pattern")))
    out = met.select("resp_id", F.when(far, own).otherwise(F.col("key")).alias("key"), F.when(far, found).alias("captured"))
    empty = {x for x in marked if len(x) == 1}
    if empty:  # the empty keyword is in every text of its place
        each = F.array(*[F.struct(F.lit(MARKS[k]).alias("key"), t.alias("text")) for k, t in (("header", F.col("header")), ("body", F.coalesce("body", "content")), ("cert", F.col("cert")))])
        texts = p.select("resp_id", F.explode(each).alias("x")).where(F.col("x.text").isNotNull() & F.col("x.key").isin(*empty))
        out = out.unionByName(texts.select("resp_id", "x.key", none))
    bare = [r.pattern for r in exprs.where("literal is null").select("pattern").collect()]
    if bare:
        texts = p.select("resp_id", "content").where("content is not null")
        out = out.unionByName(keywords.bare_hits(texts, bare, "content", "(?i)").select("resp_id", own, found.alias("captured")))
    for kind, of in (("md5", F.md5("body")), ("mmh3", mmh3(F.col("body")))):
        if kind in present:
            hashes = p.where("body is not null").select("resp_id", F.concat(F.lit(KEYS[kind]), of).alias("key"))
            out = out.unionByName(hashes.join(few(dim.where(F.col("kind") == kind).select("key").distinct()), "key").select("resp_id", "key", none))
    return out


def rule_hits(responses: DataFrame, entries: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(resp_id, finger_id, rule_idx, kind, kind_rank, matcher_idx, pattern, captured): all matcher hits of ``kinds``."""
    dim, exprs = keyed(entries, kinds)
    cols = ["resp_id", "finger_id", "rule_idx", "kind", "kind_rank", "matcher_idx", "pattern", "captured"]
    return marks(responses, dim, exprs).join(few(dim), "key").select(*cols)


def first_hits(hits: DataFrame) -> DataFrame:
    """The winning hit of each (resp_id, finger_id): first rule, then kind, then matcher."""
    rank = F.struct("rule_idx", "kind_rank", "matcher_idx")
    best = F.min_by(F.struct("rule_idx", "kind", "matcher_idx", "pattern", "captured"), rank)
    return hits.groupBy("resp_id", "finger_id").agg(best.alias("h")).select("resp_id", "finger_id", "h.*")


def statics(entries: DataFrame) -> DataFrame:
    """(finger_id, rule_idx, name, version, vendor, product, tags, focus): what a hit of each rule says by itself."""
    version = F.when(~F.col("r.version").isin("", "_"), F.col("r.version")).alias("version")
    return rules(http_entries(entries)).select("finger_id", "rule_idx", "name", version, "vendor", "product", "tags", "focus")


def frameworks(responses: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per response and finger: name, version, vendor, product, tags, focus and the match detail."""
    won = first_hits(rule_hits(responses, entries))
    r = rules(http_entries(entries)).select(
        "finger_id", "rule_idx", "name", "vendor", "product", "tags", "focus",
        F.col("r.version").alias("rule_version"), F.col("r.vuln").alias("vuln"), F.col("r.info").alias("info"), F.col("r.send_data").alias("send_data"),
    )
    static = F.when(~F.col("rule_version").isin("", "_"), F.col("rule_version"))
    out = won.join(few(r), ["finger_id", "rule_idx"])
    out = out.withColumn("version", F.coalesce(F.when(F.col("captured") != "", F.col("captured")), static))
    return out.drop("captured", "rule_version")


def vulns(found: DataFrame) -> DataFrame:
    """(resp_id, name, severity, framework): the rule's vuln is HIGH (3), else its info is INFO (1), else the finger's
    name is INFO without a framework when a vuln matcher hit."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    name = F.coalesce(filled("vuln"), filled("info"), F.when(F.col("kind") == "vuln", F.col("name")))
    high = filled("vuln").isNotNull()
    linked = F.coalesce(filled("vuln"), filled("info")).isNotNull()
    out = found.select("resp_id", name.alias("vuln_name"), F.when(high, 3).otherwise(1).alias("severity"), F.when(linked, F.col("name")).alias("framework"))
    out = out.where("vuln_name is not null").groupBy("resp_id", "vuln_name")
    return out.agg(F.max("severity").alias("severity"), F.min("framework").alias("framework"))


def payloads(entries: DataFrame, level: int) -> DataFrame:
    """(finger_id, rule_idx, payload, source): what active probing at ``level`` would send.

    Level 0 and rules above the level send nothing; from 1 the finger's payload, from 2 the rule's as well. A rule with
    a payload of its own has level 1 at least.
    """
    own = F.coalesce(F.col("r.send_data"), F.lit("")) != ""
    need = F.greatest(F.coalesce(F.col("r.level"), F.lit(0)), F.when(own, 1).otherwise(0))
    d = rules(entries).withColumn("need", need).where((F.lit(level) > 0) & ((F.col("need") <= 0) | (F.col("need") <= level)))
    each = F.array(F.struct(F.lit("finger").alias("source"), F.col("send_data").alias("payload")), F.struct(F.lit("rule").alias("source"), F.when(F.lit(level >= 2), F.col("r.send_data")).alias("payload")))
    d = d.select("finger_id", "rule_idx", F.explode(each).alias("x")).select("finger_id", "rule_idx", "x.payload", "x.source")
    return d.where("coalesce(payload, '') != ''")


def active_frameworks(first: DataFrame, entries: DataFrame) -> DataFrame:
    """Frameworks of active probing: rows of ``service.first_active`` with the catalogue's fields, where they come from,
    and the path that was asked (the rule's payload, else the entry's) as detail of a vulnerability."""
    r = rules(entries).select("finger_id", "rule_idx", "name", "vendor", "product", "tags", "focus", F.coalesce(F.when(F.col("r.send_data") != "", F.col("r.send_data")), "send_data").alias("path"), F.col("r.vuln").alias("vuln"), F.col("r.info").alias("info"))
    d = first.join(few(r), ["finger_id", "rule_idx"])
    return d.withColumns({"froms": F.array(F.lit("active")), "kind": F.lit(None).cast("string"), "detail": F.create_map(F.lit("path"), F.array("path"))}).drop("path")
