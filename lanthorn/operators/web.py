"""Keyword, logic, pattern and icon engines for web responses.

Each takes captured responses and its catalogue and returns hits. The large side is read once by the keyword index
(``keywords.scan``) with one anchor per rule, the longest literal that a match must hold; the text stays in the row with
its list of anchors, rules are joined to it from a dimension table, and the whole rule is verified there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanthorn.functions import expr
from lanthorn.operators import keywords, parse
from lanthorn.session import checkpoint, few, spread

norm = lambda c: F.lower(F.trim(F.col(c)))


def _anchored(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (columns, part, anchor) with the columns of each of ``texts`` (part, text) that holds the anchor; rules
    without an anchor meet every text of their part. Rules are joined by (part, anchor) from a broadcast table where
    they are few."""
    rules = checkpoint(rules)
    anchors = [r.anchor for r in rules.where("anchor is not null").select("anchor").distinct().toLocalIterator()]
    met = keywords.scan(texts, anchors).withColumn("anchor", F.explode("found")).drop("found")
    some = met.join(few(rules.where("anchor is not null")), ["part", "anchor"])
    bare = rules.where("anchor is null")
    if bare.head(1):
        far = texts.join(few(bare.drop("anchor")), "part").withColumn("anchor", F.lit(None).cast("string"))
        some = some.unionByName(far.select(some.columns))
    return some


def parts(responses: DataFrame) -> DataFrame:
    """(resp_id, part, text) for header and body of the lower-case message."""
    p = parse.parsed(spread(responses))
    each = F.array(F.struct(F.lit("header").alias("part"), F.col("header").alias("text")), F.struct(F.lit("body").alias("part"), F.col("body").alias("text")))
    return p.select("resp_id", F.explode(each).alias("x")).select("resp_id", "x.*").where("text is not null")


def ehole_hits(responses: DataFrame, ehole: DataFrame) -> DataFrame:
    """(resp_id, ehole_id, cms): all keywords (or regular expressions) of the row hold in its location.

    title is looked for in the body; other locations never match; an empty list matches; the whole of a regular
    expression is lower-cased; icon hashes take no part.
    """
    place = norm("location")
    rules = ehole.select(
        "ehole_id", "cms", norm("method").alias("method"),
        F.when(place.isin("body", "title"), "body").when(place == "header", "header").alias("part"),
        F.transform(F.filter(F.coalesce("keyword", F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.lower(x)).alias("words"),
    ).where("part is not null")
    longest = F.array_max(F.transform("words", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    plain = rules.where("method = 'keyword'").withColumn("anchor", longest["x"])

    @F.pandas_udf("string")
    def literal(lists):
        import pandas as pd

        found = ([x for w in words if (x := keywords.required_literal(w))] for words in lists)
        return pd.Series([max(x, key=len) if x else None for x in found], dtype=object)

    regular = rules.where(F.col("method") == "regular").where(F.forall("words", keywords.compiles)).withColumn("anchor", literal("words"))
    met = _anchored(parts(responses), plain.unionByName(regular))
    text = F.col("text")
    holds = F.when(F.col("method") == "keyword", F.forall("words", lambda k: F.contains(text, k))).otherwise(F.forall("words", lambda k: F.regexp_like(text, k)))
    return met.where(holds).select("resp_id", "ehole_id", "cms", "method")


def _truth(tree: tuple, known: dict[str, bool]) -> bool:
    if tree[0] == "name":
        return known.get(tree[1], False)
    if tree[0] == "not":
        return not _truth(tree[1], known)
    return (any if tree[0] == "or" else all)(_truth(t, known) for t in tree[1:])


def _logic_rules(goby: DataFrame) -> list[tuple[int, tuple, list[tuple[str, str, bool]]]]:
    """(goby_id, tree, [(label, feature, is_equal)]) of the rules whose logic can be read; a catalogue, as the index is."""
    out = []
    for r in goby.select("goby_id", "logic", "rule").toLocalIterator():
        try:
            tree = expr.parse(r.logic or "")
            expr.dnf(tree)  # labels, !, && and || only
        except ValueError:
            continue
        out.append((r.goby_id, tree, [(x.label, x.feature.lower(), bool(x.is_equal)) for x in r.rule or () if x is not None and x.feature is not None]))
    return out


def goby_states(responses: DataFrame, goby: DataFrame, block_bytes: int = keywords.BLOCK_BYTES) -> DataFrame:
    """(resp_id, goby_id, holds): the messages that hold a feature of a rule, and whether its logic over the labels holds.

    A label is true when the message holds its feature or not, as is_equal says. Rules come in blocks with their features;
    each block is one automaton pass in which the logic is evaluated as well. Rules without features are in none.
    """
    rules = [(i, t, f) for i, t, f in _logic_rules(goby) if f]
    texts = spread(responses.where("raw is not null").select("resp_id", "raw")).select("resp_id", F.lower("raw").alias("text"))
    kinds = [texts.schema["resp_id"].dataType.simpleString(), goby.schema["goby_id"].dataType.simpleString()]
    schema = f"resp_id {kinds[0]}, states array<struct<goby_id: {kinds[1]}, holds: boolean>>"
    out = None

    def part(some: list) -> DataFrame:
        block = keywords.Block(sorted({x for _, _, f in some for _, x, _ in f if x}))
        given = texts.sparkSession.sparkContext.broadcast((block, some))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, rules = given.value
            find = block.find if block.patterns else lambda text: set()
            by_feature: dict[str, list[int]] = {}
            for k, (_, _, features) in enumerate(rules):
                for x in {x for _, x, _ in features}:
                    by_feature.setdefault(x, []).append(k)
            always = by_feature.get("", [])  # the empty feature is in every message
            item = pa.struct([("goby_id", pa.int64() if kinds[1] == "bigint" else pa.int32()), ("holds", pa.bool_())])
            for b in batches:
                rows = []
                for text in b.column(1).to_pylist():
                    found = find(text) | {""}
                    met = {k for x in found for k in by_feature.get(x, ())} if found else set(always)
                    rows.append([{"goby_id": rules[k][0], "holds": _truth(rules[k][1], {n: (x in found) == eq for n, x, eq in rules[k][2]})} for k in sorted(met)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(item))], names=["resp_id", "states"])

        return texts.mapInArrow(run, schema)

    size, some = 0, []
    for r in rules:
        some.append(r)
        size += sum(len(x.encode("utf-8", "surrogatepass")) + 1 for _, x, _ in r[2])
        if size > block_bytes:
            out = part(some) if out is None else out.unionByName(part(some))
            size, some = 0, []
    if some or out is None:
        out = part(some) if out is None else out.unionByName(part(some))
    return out.select("resp_id", F.explode("states").alias("s")).select("resp_id", "s.*")


def goby_defaults(goby: DataFrame) -> DataFrame:
    """(goby_id) of the rules that hold for a message without any of their features."""
    ids = [(i,) for i, tree, features in _logic_rules(goby) if _truth(tree, {n: not eq for n, _, eq in features})]
    return goby.sparkSession.createDataFrame(ids, f"goby_id {goby.schema['goby_id'].dataType.simpleString()}")


def goby_hits(responses: DataFrame, goby: DataFrame) -> DataFrame:
    """(resp_id, goby_id, name) of the rules that hold for a message which has a feature of theirs.

    Rules that hold for all other messages as well are not expanded to them; ``goby_defaults`` names them.
    """
    return goby_states(responses, goby).where("holds").join(few(goby.select("goby_id", "name")), "goby_id").select("resp_id", "goby_id", "name")


def goby_counts(responses: DataFrame, goby: DataFrame) -> DataFrame:
    """(goby_id, name, responses): messages for which the logic over the labels holds, with or without features."""
    states = goby_states(responses, goby).groupBy("goby_id").agg(F.count_if("holds").alias("yes"), F.count_if(~F.col("holds")).alias("no"))
    total = responses.agg(F.count("raw").alias("total"))
    by_default = goby_defaults(goby).withColumn("all", F.lit(True))
    d = goby.select("goby_id", "name").join(states, "goby_id", "left").join(by_default, "goby_id", "left").join(F.broadcast(total))  # one row
    n = F.when(F.col("all"), F.col("total") - F.coalesce("no", F.lit(0))).otherwise(F.coalesce("yes", F.lit(0)))
    return d.select("goby_id", "name", n.cast("bigint").alias("responses")).where("responses > 0")


# --- application patterns ---------------------------------------------------------------------------------------------


def versioned(pattern: Column) -> tuple[Column, Column]:
    """(regular expression in lower case, number of the version's group or 0) of a pattern with options behind it."""
    low = F.lower(pattern)
    number = F.regexp_extract(low, r"\;version:\\(\d+)", 1)
    return F.substring_index(low, r"\;", 1), F.when(number != "", number.cast("int")).otherwise(0)


def app_patterns(apps: DataFrame) -> DataFrame:
    """(app_id, app, part, key, idx, expr, grp) of the parts that are evaluated: headers, cookies, meta, html, scriptsrc."""
    one = apps.select("app_id", "app", "headers", "cookies", "meta", "html", "scriptsrc")
    lists = []
    for part in ("headers", "cookies"):
        lists.append(F.transform(F.map_entries(part), _entry(part)))
    meta = F.flatten(F.transform(F.map_entries("meta"), lambda e: F.transform(e["value"], lambda v, i: _pat("meta", e["key"], i, v))))
    lists.append(meta)
    lists += [F.transform("html", _item("html")), F.transform("scriptsrc", _item("scriptsrc"))]
    none = F.array().cast("array<struct<part:string,key:string,idx:int,pattern:string>>")
    out = one.select("app_id", "app", F.explode(F.concat(*[F.coalesce(x, none) for x in lists])).alias("p")).select("app_id", "app", "p.*")
    e, g = versioned(F.col("pattern"))
    return out.where("pattern is not null").withColumns({"expr": e, "grp": g}).drop("pattern")


def _pat(part: str, key: Column, idx: Column, pattern: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), F.lower(key).alias("key"), idx.cast("int").alias("idx"), pattern.alias("pattern"))


def _entry(part: str):
    return lambda e: _pat(part, e["key"], F.lit(0), e["value"])


def _item(part: str):
    return lambda x, i: _pat(part, F.lit(""), i, x)


def _version(text: str = "text") -> Column:
    """Group grp of the last match; '' where the pattern asks for none. The group numbers were checked at load."""
    return F.expr(f"case when grp > 0 and expr != '' then coalesce(element_at(regexp_extract_all({text}, expr, grp), -1), '') else '' end")


KEYED, TEXTS = ("headers", "cookies", "meta"), ("html", "scriptsrc")


def app_hits(responses: DataFrame, apps: DataFrame, parts: Sequence[str] = KEYED + TEXTS, html_only: bool = False) -> DataFrame:
    """(resp_id, app_id, app, part, key, idx, version) of the patterns that match.

    A message becomes rows of (part, key, text) in one pass, its HTML read once: headers, cookies and meta tags by their
    keys, the body and the script sources as texts. Rows meet the patterns (of their key) whose literal they hold and
    those that have none, all in one join with the pattern table. With ``html_only`` body, script and meta
    patterns look at messages whose content type says text/html. Patterns that do not compile match nothing.
    """

    @F.pandas_udf("string")
    def literal(s):
        import pandas as pd

        return pd.Series([keywords.required_literal(x) for x in s], dtype=object)

    pats = app_patterns(apps).where(F.col("part").isin(*parts)).where(keywords.compiles(F.col("expr")))
    lit = F.coalesce(literal("expr"), F.lit(""))
    pats = checkpoint(pats.withColumn("literal", lit))
    pats = pats.withColumn("probe", F.when(F.col("part").isin(*KEYED), F.concat_ws("\0", "key", "literal")).otherwise(F.col("literal")))
    anchors = [r.literal for r in pats.select("literal").distinct().toLocalIterator()]
    header, body = parse.after_split(F.col("raw"))
    row = lambda part, key, text: F.struct(F.lit(part).alias("part"), key.alias("key"), text.alias("text"))
    none = F.array().cast("array<struct<part:string,key:string,text:string>>")
    pairs = lambda part, m: F.transform(F.map_entries(m), lambda e: row(part, e["key"], e["value"]))
    # a generator keeps the parsed message from being computed again for every part of it that is used
    message = F.struct(parse.header_map(header).alias("h"), F.lower(body).alias("body"))
    d = spread(responses.where("raw is not null").select("resp_id", "raw")).select("resp_id", F.explode(F.array(message)).alias("m")).select("resp_id", "m.*")
    if {"meta", "scriptsrc"} & set(parts):
        d = d.withColumn("tags", parse.tags(F.col("body")))
    lists = {
        "headers": lambda: pairs("headers", F.col("h")),
        "cookies": lambda: pairs("cookies", parse.cookie_map(F.try_element_at("h", F.lit("set-cookie")))),
        "meta": lambda: F.transform(F.col("tags.metas"), lambda m: row("meta", F.lower(m["name"]), m["content"])),
        "html": lambda: F.when(F.col("body").isNotNull(), F.array(row("html", F.lit(""), F.col("body")))),
        "scriptsrc": lambda: F.transform(F.col("tags.scripts"), lambda s: row("scriptsrc", F.lit(""), s)),
    }
    gate = F.contains(F.coalesce(F.try_element_at("h", F.lit("content-type")), F.lit("")), F.lit("text/html"))
    of = lambda p: F.when(gate, lists[p]()) if html_only and p not in ("headers", "cookies") else lists[p]()
    texts = d.select("resp_id", F.explode(F.concat(*[F.coalesce(of(p), none) for p in parts])).alias("x")).select("resp_id", "x.*").where("text is not null")
    probed = _probed(texts, [a for a in anchors if a])
    met = probed.join(few(pats.withColumnRenamed("key", "pattern_key").drop("literal")), ["part", "probe"]).where("expr = '' or regexp_like(text, expr)")
    return met.select("resp_id", "app_id", "app", "part", F.col("pattern_key").alias("key"), "idx", _version().alias("version"))


def _probed(rows: DataFrame, anchors: list[str]) -> DataFrame:
    """(part, key, text) rows with each ``probe`` they look for patterns with: the literals of the text and '', behind the
    key where there is one."""
    block = [keywords.Block(b) for b in keywords.blocks(sorted(anchors), keywords.BLOCK_BYTES)] or [keywords.Block([])]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", probes array<string>"
    at = [rows.columns.index(c) for c in ("part", "key", "text")]
    out = None
    for n, one in enumerate(block):
        given = rows.sparkSession.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch], given=given, first=n == 0) -> Iterator[pa.RecordBatch]:
            find = given.value.find if given.value.patterns else lambda text: set()
            for b in batches:
                probes = []
                for part, key, text in zip(*(b.column(i).to_pylist() for i in at)):
                    own = [*sorted(find(text)), *([""] if first else [])]
                    probes.append([f"{key}\0{x}" for x in own] if part in KEYED else own)
                keep = [i for i, x in enumerate(probes) if x]
                if keep:
                    have = b.take(pa.array(keep, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*have.columns, pa.array([probes[i] for i in keep], pa.list_(pa.string()))], names=[*b.schema.names, "probes"])

        some = rows.mapInArrow(run, schema)
        out = some if out is None else out.unionByName(some)
    return out.withColumn("probe", F.explode("probes")).drop("probes")


def app_frameworks(responses: DataFrame, apps: DataFrame) -> DataFrame:
    """One row per response and application name (without case): its version, parts and tags (the names it implies).

    In html and script sources the last pattern that matches supplies the version, in the keyed parts the first; a
    version that is not empty goes before an empty one.
    """
    hits = app_hits(responses, apps)
    keyed = F.col("part").isin("headers", "cookies", "meta")
    rank = F.struct((F.col("version") != "").alias("has"), keyed.alias("keyed"), F.when(keyed, -F.col("idx")).otherwise(F.col("idx")).alias("i"), F.col("part"), F.col("key"), F.col("app_id"), F.col("version"))
    out = hits.groupBy("resp_id", F.lower("app").alias("name"))
    return out.agg(F.max_by("version", rank).alias("version"), F.array_join(F.sort_array(F.collect_set("part")), ",").alias("parts"), F.min("app_id").alias("app_id"))


# --- icons ------------------------------------------------------------------------------------------------------------


def icon_number(c: Column) -> Column:
    """A 32-bit icon hash spelt as decimal, unsigned or 0x-hexadecimal, as signed decimal text; null if unreadable."""
    s = F.lower(F.trim(c))
    dec = F.when(s.rlike("^[+-]?[0-9]{1,10}$"), s.cast("bigint"))
    hexa = F.when(s.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substr(s, F.lit(3)), 16, 10).cast("bigint"))
    n = F.coalesce(dec, hexa)
    return F.when(n >= 2**31, n - 2**32).otherwise(n).cast("string")


def icon_table(entries: DataFrame, ehole: DataFrame) -> DataFrame:
    """(hash, name): icon hashes of both catalogues; a later entry overwrites, the native catalogue comes first."""
    r = entries.select("finger_id", "name", F.explode("rule").alias("r")).where("r.favicon is not null")
    native = [r.select(h, F.lit(0).alias("o"), F.col("finger_id").cast("bigint").alias("i"), "name") for h in (F.explode("r.favicon.md5").alias("hash"), F.explode("r.favicon.mmh3").alias("hash"))]
    other = ehole.where(norm("method") == "faviconhash").select(F.explode("keyword").alias("hash"), F.lit(1).alias("o"), F.col("ehole_id").alias("i"), F.col("cms").alias("name"))
    every = native[0].unionByName(native[1]).unionByName(other).where("hash is not null and name is not null")
    key = F.coalesce(icon_number(F.col("hash")), F.lower(F.trim("hash")))
    return every.groupBy(key.alias("hash")).agg(F.max_by("name", F.struct("o", "i", "name")).alias("name"))


def icon_lookup(icons: DataFrame, known: DataFrame) -> DataFrame:
    """(fav_id, name): by md5 first, else by mmh3."""
    by = lambda a: known.select(F.col("hash").alias(f"{a}_k"), F.col("name").alias(f"{a}_name"))
    d = icons.select("fav_id", F.lower(F.trim("md5")).alias("md5_k"), icon_number(F.col("mmh3")).alias("mmh3_k"))
    d = d.join(by("md5"), "md5_k", "left").join(by("mmh3"), "mmh3_k", "left")
    return d.select("fav_id", F.coalesce("md5_name", "mmh3_name").alias("name")).where("name is not null")
