"""Queries of the training-data operators on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanthorn.llm import canonical, format_dupes, language, linkage, mixing, packing, set_pairs, tokens
from lanthorn.session import checkpoint, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- 1: duplicates hidden by formatting -------------------------------------------------------------------------------


def catalogue_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    keys = format_dupes.record_keys
    native = keys(t("native_finger"), "native_finger", "finger_id", ["name", "vendor", "product", "link"], format_dupes.native_key)
    alias = keys(t("alias_entry"), "alias_entry", "alias_id", ["name", "attrs", "link"], format_dupes.alias_key)
    ehole = keys(t("ehole"), "ehole", "ehole_id", ["cms", "method", "location", "keyword"], format_dupes.ehole_key)
    return native.unionByName(alias).unionByName(ehole)


CATALOGS = ["native_finger", "alias_entry", "ehole"]


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = format_dupes.partials(catalogue_keys(spark, sf_dir))
    found = format_dupes.members(parts, format_dupes.count_copies(parts))
    return found.where("record_id != first_id").select(format_dupes.catalog_of(F.col("key"), CATALOGS).alias("catalog"), "first_id", "record_id").distinct()


@query
def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with its number of copies."""
    groups = format_dupes.count_copies(format_dupes.partials(catalogue_keys(spark, sf_dir)))
    return groups.select(format_dupes.catalog_of(F.col("key"), CATALOGS).alias("catalog"), "first_id", "copies")


# --- 7: all similar pairs of set-valued records -----------------------------------------------------------------------


def set_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(universe, side, id, items): body patterns and keywords share a universe, favicon hashes have their own."""
    finger, ehole = table(spark, sf_dir, "native_finger"), table(spark, sf_dir, "ehole")
    some = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    rules = F.filter(F.coalesce("rule", F.array()), lambda r: r.isNotNull())
    body = F.flatten(F.transform(rules, lambda r: some(r["regexps"]["body"])))
    mmh3 = F.flatten(F.transform(rules, lambda r: some(r["favicon"]["mmh3"])))

    def rec(df, universe, side, key, items):
        return df.select(F.lit(universe).alias("universe"), F.lit(side).alias("side"), F.col(key).cast("bigint").alias("id"), items.alias("items"))

    return (
        rec(finger, "text", "body", "finger_id", body)
        .unionByName(rec(finger, "mmh3", "mmh3", "finger_id", mmh3))
        .unionByName(rec(ehole, "text", "keyword", "ehole_id", F.col("keyword")))
    )


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = checkpoint(set_pairs.set_members(set_records(spark, sf_dir)))
    pairs = set_pairs.member_pairs(members, set_pairs.similar_classes(members))
    sides = F.concat_ws("_", F.least("left_side", "right_side"), F.greatest("left_side", "right_side"))
    kind = F.when(F.col("left_side") == F.col("right_side"), F.col("left_side")).otherwise(sides)
    return pairs.select(kind.alias("kind"), "left_id", "right_id").distinct()


@query
def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: its class of equal sets, the class's size and its number of links to other classes."""
    members = checkpoint(set_pairs.set_members(set_records(spark, sf_dir)))
    links = set_pairs.similar_classes(members)
    ends = links.select(F.col("left_set").alias("set_id")).union(links.select("right_set")).groupBy("set_id").agg(F.count("*").alias("links"))
    classes = members.groupBy("set_id").agg(F.count("*").alias("copies")).join(ends, "set_id", "left")
    out = members.select("side", "id", "set_id").join(classes, "set_id")
    return out.select("side", "id", F.lower(F.hex("set_id")).alias("class_id"), "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


# --- 4: free-entered values to a canonical list -----------------------------------------------------------------------


def entered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, row_id, engine, pos, name) of every entered product name."""
    none = [F.lit("").alias("engine"), F.lit(0).alias("pos")]

    def plain(name, key, field):
        return table(spark, sf_dir, name).select(F.lit(f"{name}.{field}").alias("field"), F.col(key).cast("bigint").alias("row_id"), *none, F.col(field).alias("name"))

    alias = table(spark, sf_dir, "alias_entry").select(F.col("alias_id").cast("bigint").alias("row_id"), F.explode("alias").alias("engine", "names"))
    alias = alias.select(F.lit("alias_entry.alias").alias("field"), "row_id", "engine", F.posexplode("names").alias("pos", "name"))
    out = plain("native_finger", "finger_id", "name").unionByName(plain("ehole", "ehole_id", "cms")).unionByName(plain("goby", "goby_id", "name"))
    return out.unionByName(alias)


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = canonical.map_entries(entered_names(spark, sf_dir), table(spark, sf_dir, "product_list"))
    return mapped.select("field", "row_id", "engine", "pos", "canon_id").distinct()


@query
def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names that reach no entry, with their number of rows."""
    names = canonical.map_names(entered_names(spark, sf_dir).where("name is not null"), table(spark, sf_dir, "product_list"))
    return names.where("canon_id = 0").select("name", F.col("n").alias("rows"))


# --- 5: matching entities across sources without keys -----------------------------------------------------------------


def native_records(spark: SparkSession, sf_dir: str, lexicon: canonical.Lexicon) -> DataFrame:
    finger = table(spark, sf_dir, "native_finger")
    rules = F.filter(F.coalesce("rule", F.array()), lambda r: r.isNotNull())
    some = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    icons = F.flatten(F.transform(rules, lambda r: some(r["favicon"]["mmh3"])))
    return linkage.with_evidence(finger.select("finger_id", "name", "vendor", "product", "link", icons.alias("icons")), linkage.native_evidence, lexicon)


def app_records(spark: SparkSession, sf_dir: str, lexicon: canonical.Lexicon) -> DataFrame:
    apps = table(spark, sf_dir, "wapp_app").select("app_id", "app", "cpe", "website")
    icons = linkage.app_icons(apps, table(spark, sf_dir, "favicon"))
    return linkage.with_evidence(apps.join(icons, "app_id", "left"), linkage.app_evidence, lexicon)


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    # kind words and their spellings as the product list and the names on both sides show them
    names = table(spark, sf_dir, "native_finger").select("name").unionByName(table(spark, sf_dir, "wapp_app").select(F.col("app").alias("name")))
    lexicon = canonical.lexicon_of(names.where("name is not null").distinct(), table(spark, sf_dir, "product_list"))
    left, right = (checkpoint(f(spark, sf_dir, lexicon)) for f in (native_records, app_records))
    return linkage.link(left, right)


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, sf_dir).select(F.col("left_id").alias("finger_id"), F.col("right_id").alias("app_id")).distinct()


@query
def p5_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matching pairs with the posterior of a match and the votes of the functions."""
    votes = F.concat_ws(",", F.transform("votes", lambda v: v.cast("string")))
    out = linked(spark, sf_dir).groupBy(F.col("left_id").alias("finger_id"), F.col("right_id").alias("app_id"))
    return out.agg(F.max("confidence").alias("confidence"), F.max(votes).alias("votes"))


# --- 8 and 9: containers and mixtures ---------------------------------------------------------------------------------


def sized_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """doc_id, further columns and n_tokens; written once, since counting tokens is the dear part."""
    docs = table(spark, sf_dir, "documents")
    return checkpoint(tokens.count_tokens(docs.select("doc_id", *columns, "text"), ["doc_id", *columns]))


@query
def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(sized_documents(spark, sf_dir), table(spark, sf_dir, "pack_spec"))


@query
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "pack_spec")
    return packing.report(packing.pack(sized_documents(spark, sf_dir), specs), specs)


@query
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(sized_documents(spark, sf_dir, "source"), table(spark, sf_dir, "mix_target"))[0]


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(sized_documents(spark, sf_dir, "source"), table(spark, sf_dir, "mix_target"))[1]


# --- 10: missing or wrong language labels -----------------------------------------------------------------------------


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return language.languages(docs, language.fit(docs))


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).where("main is not null")
    # a document gives its own row where the label is missing, no language or another one, and a row for each passage
    own = F.when(F.col("label").isNull() | (F.col("label") != F.col("main")), F.array(F.struct(F.lit(0).alias("block_no"), F.col("main").alias("lang"))))
    parts = F.transform("passages", lambda p: F.struct(p["block_no"].alias("block_no"), p["lang"].alias("lang")))
    both = F.concat(F.coalesce(own, F.array().cast("array<struct<block_no:int,lang:string>>")), parts)
    return rows.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.block_no", "x.lang").distinct()


@query
def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language and confidence (null without prose) and its number of foreign passages."""
    return judged(spark, sf_dir).select("doc_id", F.col("main").alias("lang"), "confidence", F.size("passages").alias("passages"))


@query
def p10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (block 0) and their passages in another language, each with its language and confidence."""
    own = F.array(F.struct(F.lit(0).alias("block_no"), F.col("main").alias("lang"), "confidence"))
    each = judged(spark, sf_dir).where("main is not null").select("doc_id", F.explode(F.concat(own, "passages")).alias("x"))
    return each.select("doc_id", "x.*")


# --- SQL of those that it can express on whole tables -----------------------------------------------------------------

_ITEM = r"lower(regexp_replace(x, '^\s+|\s+$', '', 'g'))"
_SETS = rf"""raw AS (
  SELECT 'text' AS u, 'body' AS side, CAST(finger_id AS BIGINT) AS id, UNNEST(r.regexps.body) AS x FROM (SELECT finger_id, UNNEST(rule) AS r FROM native_finger)
  UNION ALL SELECT 'mmh3', 'mmh3', finger_id, UNNEST(r.favicon.mmh3) FROM (SELECT finger_id, UNNEST(rule) AS r FROM native_finger)
  UNION ALL SELECT 'text', 'keyword', ehole_id, UNNEST(keyword) FROM ehole),
items AS (SELECT DISTINCT u, side, id, {_ITEM} AS x FROM raw WHERE x IS NOT NULL),
sized AS (SELECT *, count(*) OVER (PARTITION BY side, id) AS n FROM items),
pairs AS (SELECT a.side AS ls, a.id AS l, b.side AS rs, b.id AS r, count(*) AS shared, max(a.n) AS ln, max(b.n) AS rn FROM sized a JOIN sized b ON a.u = b.u AND a.x = b.x AND a.id < b.id AND a.n >= 3 AND b.n >= 3
  AND least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) - 1e-9 GROUP BY ALL)"""
SQL["p7_found"] = f"""WITH {_SETS} SELECT DISTINCT CASE WHEN ls = rs THEN ls ELSE least(ls, rs) || '_' || greatest(ls, rs) END AS kind, l AS left_id, r AS right_id
FROM pairs WHERE shared >= 0.6 * (ln + rn - shared) - 1e-9"""

#: Compatibility forms of ASCII; that is all SQL folds, so the SQL holds where names are written with no other forms.
_WIDE, _PLAIN = "".join(chr(0xFF01 + i) for i in range(94)).replace("＇", ""), "".join(chr(0x21 + i) for i in range(94)).replace("'", "")
_TEXT = lambda c: rf"regexp_replace(lower(translate(coalesce({c}, ''), '{_WIDE}', '{_PLAIN}')), '[^\p{{L}}\p{{N}}]', '', 'g')"
_SET = lambda c: f"list_sort(list_distinct(list_filter(coalesce({c}, []), lambda x: x IS NOT NULL)))"
_ATTRS = rf"""list_sort(list_distinct(list_filter(list_transform(string_split_regex(coalesce(attrs, ''), '[;|]'), lambda x: CASE WHEN trim(split_part(x, '=', 1)) <> '' OR trim(substr(x, instr(x || '=', '=') + 1)) <> ''
  THEN lower(trim(split_part(x, '=', 1))) || '=' || {_TEXT("CASE WHEN instr(x, '=') > 0 THEN substr(x, instr(x, '=') + 1) ELSE '' END")} END), lambda x: x IS NOT NULL)))"""
_KEYS = f"""k AS (SELECT 'native_finger' AS catalog, CAST(finger_id AS BIGINT) AS id, [{_TEXT('name')}, {_TEXT('vendor')}, {_TEXT('product')}] || {_SET('link')} AS key FROM native_finger
  UNION ALL SELECT 'alias_entry', alias_id, [{_TEXT('name')}] || {_ATTRS} || ['|'] || {_SET('link')} FROM alias_entry
  UNION ALL SELECT 'ehole', ehole_id, [{_TEXT('cms')}, {_TEXT('method')}, {_TEXT('location')}] || {_SET("list_transform(keyword, lambda x: lower(trim(x)))")} FROM ehole),
g AS (SELECT catalog, key, min(id) AS first_id, count(*) AS copies FROM k GROUP BY ALL)"""
SQL["p1_found"] = f"WITH {_KEYS} SELECT catalog, first_id, id AS record_id FROM k JOIN g USING (catalog, key) WHERE id <> first_id"
SQL["p1_records"] = f"WITH {_KEYS} SELECT catalog, first_id, CAST(copies AS BIGINT) AS copies FROM g"
