"""Alias resolution and the merge of engine results into one row per response and framework."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each kind of engine supports: web, service.
CAPABILITY = {
    "native": (True, True), "template": (True, True), "wappalyzer": (True, False), "ehole": (True, False),
    "goby": (True, False), "nmap": (False, True), "xray": (True, False), "favicon": (True, False),
}
#: Engines that are off unless asked for.
OPTIONAL = ("favicon",)


def normalize(name: Column) -> Column:
    """Lower case without hyphens, underscores and spaces. Han characters stay: their readings are no part of the data."""
    return F.regexp_replace(F.lower(name), "[-_ ]", "")


def fuzzy_match(name: Column, other: Column) -> Column:
    """Whether two names are the same once normalised."""
    return F.coalesce(normalize(name) == normalize(other), F.lit(False))


def engine_key(engine: Column) -> Column:
    return F.lower(F.trim(engine))


def alias_map(aliases: DataFrame) -> DataFrame:
    """(engine, norm, alias_id, alias_name, alias_vendor, alias_product, blocked): the last entry wins per engine and name.

    The bridge is grouped by its key, so a name listed by many entries is one row.
    """
    pairs = aliases.select("alias_id", "name", "vendor", "product", "block", F.explode("alias").alias("e", "names"))
    pairs = pairs.select("*", F.explode("names").alias("n")).where("n is not null")
    key = engine_key(F.col("e"))
    blocked = F.exists(F.coalesce("block", F.array().cast("array<string>")), lambda b: engine_key(b) == key)
    pairs = pairs.select(key.alias("engine"), normalize(F.col("n")).alias("norm"), "alias_id", "name", "vendor", "product", F.coalesce(blocked, F.lit(False)).alias("blocked"))
    best = F.max_by(F.struct("alias_id", F.col("name").alias("alias_name"), F.col("vendor").alias("alias_vendor"), F.col("product").alias("alias_product"), "blocked"), "alias_id")
    return pairs.groupBy("engine", "norm").agg(best.alias("a")).select("engine", "norm", "a.*")


def resolve(hits: DataFrame, amap: DataFrame) -> DataFrame:
    """Hits under the alias's name and attributes where there is one; ``blocked`` marks those an alias blocks."""
    h = hits.withColumn("engine", engine_key(F.col("engine"))).withColumn("norm", normalize(F.col("name")))
    out = h.join(amap, ["engine", "norm"], "left")
    return out.withColumns(
        {
            "name": F.coalesce("alias_name", "name"),
            "vendor": F.coalesce("alias_vendor", "vendor"),
            "product": F.coalesce("alias_product", "product"),
            "blocked": F.coalesce("blocked", F.lit(False)),
        }
    ).drop("norm")


def engine_rank(engine: Column, order: Sequence[str] = ()) -> Column:
    """Place of an engine in ``order``; engines that it does not list stand behind it."""
    if not order:
        return F.lit(0)
    places = F.create_map(*[F.lit(x) for i, e in enumerate(order) for x in (e, i)])
    return F.coalesce(F.try_element_at(places, engine), F.lit(len(order)))


def merge(resolved: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per (resp_id, lower(name)): scalars from the first engine that has them, engines and tags united.

    Engines go in ``order``, those it does not list behind it by name, rows without one last. Exact duplicate rows are harmless: all
    aggregates are order-free choices or sets.
    """
    live = resolved.where("not blocked and name is not null and resp_id is not null")
    live = live.withColumn("rank", F.struct(engine_rank(F.col("engine"), order).alias("i"), F.coalesce("engine", F.lit("~")).alias("e")))
    fill = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.struct("rank", c)))
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull())))))
    return live.groupBy("resp_id", F.lower("name").alias("framework")).agg(
        fill("version").alias("version"), fill("vendor").alias("vendor"), fill("product").alias("product"),
        F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("froms"), F.array_join(tags, ",").alias("tags"),
        F.bool_or(F.coalesce("focus", F.lit(False))).alias("focus"),
    )


def cpe_uri(vendor: Column, product: Column, version: Column, part: str = "a") -> Column:
    """``cpe:/a:vendor:product:version`` without empty ends."""
    clean = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", "_")
    return F.regexp_replace(F.concat_ws(":", F.lit(f"cpe:/{part}"), clean(vendor), clean(product), clean(version)), ":+$", "")


def cpe_parts(cpe: Column) -> Column:
    """struct<part, vendor, product, version> of a cpe in either notation; null if it is none."""
    uri = F.split(F.regexp_replace(F.lower(cpe), "^cpe:/", ""), ":")
    fs = F.split(F.regexp_replace(F.lower(cpe), r"^cpe:2\.3:", ""), r"(?<!\\):")
    pick = lambda a, i: F.when(~F.get(a, F.lit(i)).isin("", "*", "-"), F.regexp_replace(F.get(a, F.lit(i)), r"\\(.)", "$1"))
    make = lambda a: F.struct(*[pick(a, i).alias(n) for i, n in enumerate(("part", "vendor", "product", "version"))])
    low = F.lower(cpe)
    return F.when(low.startswith("cpe:2.3:"), make(fs)).when(low.startswith("cpe:/"), make(uri))
