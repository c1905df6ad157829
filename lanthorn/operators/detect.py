"""End-to-end detection: engines give hits, aliases rename them, and one row per response and framework comes out.

An engine is a name and a function from captured responses to hits (resp_id, name, version, vendor, product, tags,
focus); ``Detector`` keeps them, some switched off. Nothing here opens a socket: what an active engine would send is a
plan table, and its answers are a table that the caller brings.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanthorn.operators import alias, fold, native, web
from lanthorn.session import checkpoint, few

HIT = "name string, version string, vendor string, product string, tags array<string>, focus boolean"


def hits_of(engine: str, found: DataFrame) -> DataFrame:
    """Hits of an engine in the common columns; what it does not give is null."""
    have = set(found.columns)
    cols = [F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in HIT.split(", "))]
    return found.select("resp_id", F.lit(engine).alias("engine"), *cols)


@dataclass
class NativeEngine:
    """Its hits, which are many, are merged within their response's row by ``Detector.detect``."""

    entries: DataFrame

    def __call__(self, responses: DataFrame) -> DataFrame:
        return native.frameworks(responses, self.entries)


def native_engine(entries: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return NativeEngine(entries)


def keyword_engine(rules: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return lambda responses: web.ehole_hits(responses, rules).withColumnRenamed("cms", "name")


def logic_engine(rules: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Rules that hold for every message without features of theirs are not expanded to all of them."""
    return lambda responses: web.goby_hits(responses, rules)


def pattern_engine(apps: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Implied names are tags; vendor and product come from the cpe of the application with the smallest id."""

    def match(responses: DataFrame) -> DataFrame:
        found = web.app_frameworks(responses, apps)
        cpe = alias.cpe_parts(F.col("cpe"))
        more = few(apps.select("app_id", cpe["vendor"].alias("vendor"), cpe["product"].alias("product"), F.col("implies").alias("tags")))
        return found.join(more, "app_id", "left")

    return match


def icon_engine(known: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The body of a response as an icon: its md5, else its hash, among the known ones."""
    from lanthorn.functions.mmh3 import mmh3
    from lanthorn.operators import parse

    def match(responses: DataFrame) -> DataFrame:
        _, body = parse.after_split(F.col("raw"))
        icons = responses.where(body.isNotNull()).select(F.col("resp_id").alias("fav_id"), F.md5(body).alias("md5"), mmh3(body).alias("mmh3"))
        return web.icon_lookup(icons, known).withColumnRenamed("fav_id", "resp_id")

    return match


def template_engine(found: list[dict]) -> Callable[[DataFrame], DataFrame]:
    """Templates as ``templates.catalogue`` reads them."""
    from lanthorn.operators import templates

    return lambda responses: templates.frameworks(responses, found)


def socket_engine(entries: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Native tcp entries over socket banners (resp_id, port, raw): the first of the port's, then the others."""
    from lanthorn.operators import service

    return lambda banners: service.socket_first(banners, entries)


def probe_engine(probes: DataFrame, catalogue: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Service matches over answers (resp_id, port, probe, tls, error, data): the framework of each target's service."""
    from lanthorn.operators import scan

    def match(answers: DataFrame) -> DataFrame:
        told = scan.run(answers.withColumnRenamed("resp_id", "target"), probes, catalogue).where("status = 'Matched'")
        return told.select(F.col("target").alias("resp_id"), F.col("service").alias("name"), "version")

    return match


@dataclass
class Detector:
    """Registered engines, in the order in which their results fill fields."""

    aliases: DataFrame | None = None
    engines: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    enabled: dict[str, bool] = field(default_factory=dict)

    def register(self, name: str, match: Callable[[DataFrame], DataFrame], enabled: bool = True) -> Detector:
        key = name.strip().lower()
        self.engines[key], self.enabled[key] = match, enabled
        return self

    def enable(self, *names: str) -> Detector:
        return self._switch(names, True)

    def disable(self, *names: str) -> Detector:
        return self._switch(names, False)

    def _switch(self, names: Sequence[str], on: bool) -> Detector:
        for n in names:
            if n not in self.engines:
                raise KeyError(f"no engine {n!r}")
            self.enabled[n] = on
        return self

    def hits(self, responses: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """Hits of the enabled engines, or of the named ones whether enabled or not."""
        chosen = [n for n in self.engines if self.enabled[n]] if names is None else list(names)
        out = None
        for n in chosen:
            some = hits_of(n, self.engines[n](responses))
            out = some if out is None else out.unionByName(some)
        if out is None:
            kind = responses.schema["resp_id"].dataType.simpleString()
            out = responses.sparkSession.createDataFrame([], f"resp_id {kind}, engine string, {HIT}")
        return out

    def detect(self, responses: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """One row per response and framework: engines united, renamed and blocked by aliases, merged."""
        chosen = list(dict.fromkeys([n for n in self.engines if self.enabled[n]] if names is None else names))
        if self.aliases is None:
            resolve = lambda found: found.withColumn("blocked", F.lit(False))
        else:
            amap = few(checkpoint(alias.alias_map(self.aliases)))
            resolve = lambda found: alias.resolve(found, amap)
        own = next((n for n in chosen if isinstance(self.engines[n], NativeEngine)), None)
        if own is None:
            return alias.merge(resolve(self.hits(responses, chosen)), list(self.engines))
        rest = [n for n in chosen if n != own]
        return fold.detect(responses, self.engines[own].entries, own, self.hits(responses, rest) if rest else None, resolve, list(self.engines))

    def each(self, responses: DataFrame, call: Callable, names: Sequence[str] | None = None) -> None:
        """Call ``call`` with every partition's iterator of detected rows, on the executors."""
        self.detect(responses, names).foreachPartition(call)

    def answered(self, plan: DataFrame, send: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Detection on what a sender returns for a plan of payloads: ``send`` gives it its responses, each path once."""
        return self.detect(send(plan.dropDuplicates(["target", "payload"])))


def derived_aliases(entries: DataFrame, engine: str = "native") -> DataFrame:
    """An alias entry of every native row: its own name under its engine. Listed entries go before them."""
    names = F.create_map(F.lit(engine), F.array("name"))
    return entries.where("name is not null").select(F.col("finger_id").cast("bigint").alias("alias_id"), "name", "vendor", "product", names.alias("alias"), F.lit(None).cast("array<string>").alias("block"))
