"""Service scans over tables: probes, matches and captured answers (target, probe, tls, ok, error, data).

Answers are bytes; as text each byte is one character, so that patterns with ``\\xNN`` match. A scan ranks the answers of
a target by the order of probes for its port and takes the first that tells a service; nothing is sent from here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanthorn.operators import keywords, service
from lanthorn.session import checkpoint, few

#: Matches that come on top of any probe database, by the probe they belong to (fixed values, in order).
CUSTOM = {
    "GetRequest": [
        r"echo m|^GET / HTTP/1.0\r\n\r\n$|s",
        r"mongodb m|.*It looks like you are trying to access MongoDB.*|s p/MongoDB/",
        r"http m|^HTTP/1\.[01] \d\d\d (?:[^\r\n]+\r\n)*?Server: ([^\r\n]+)| p/$1/",
        r"http m|^HTTP/1\.[01] \d\d\d|",
    ],
    "NULL": [
        r"mysql m|.\x00\x00..j\x04Host '.*' is not allowed to connect to this MariaDB server| p/MariaDB/",
        r"mysql m|.\x00\x00..j\x04Host '.*' is not allowed to connect to this MySQL server| p/MySQL/",
        r"mysql m|.\x00\x00\x00\x0a(\d+\.\d+\.\d+)\x00.*caching_sha2_password\x00| p/MariaDB/ v/$1/",
        r"mysql m|.\x00\x00\x00\x0a([\d.-]+)-MariaDB\x00.*mysql_native_password\x00| p/MariaDB/ v/$1/",
        r"redis m|-DENIED Redis is running in.*| p/Redis/ i/Protected mode/",
        r"telnet m|^.*Welcome to visit (.*) series router!.*|s p/$1 Router/",
        r"telnet m|^Username: ??|",
        r"telnet m|^.*Telnet service is disabled or Your telnet session has expired due to inactivity.*|s i/Disabled/",
        r"telnet m|^.*Telnet connection from (.*) refused.*|s i/Refused/",
        r"telnet m|^.*Command line is locked now, please retry later.*\x0d\x0a\x0d\x0a|s i/Locked/",
        r"telnet m|^.*Warning: Telnet is not a secure protocol, and it is recommended to use Stelnet.*|s",
        r"telnet m|^telnetd:|s",
        r"telnet m|^.*Quopin CLI for (.*)\x0d\x0a\x0d\x0a|s p/$1/",
        r"telnet m|^\x0d\x0aHello, this is FRRouting \(version ([\d.]+)\).*|s p/FRRouting/ v/$1/",
        r"telnet m|^.*User Access Verification.*Username:|s",
        r"telnet m|^Connection failed.  Windows CE Telnet Service cannot accept anymore concurrent users.|s o/Windows/",
        r"telnet m|^\x0d\x0a\x0d\x0aWelcome to the host.\x0d\x0a.*|s o/Windows/",
        r"telnet m|^.*Welcome Visiting Huawei Home Gateway\x0d\x0aCopyright by Huawei Technologies Co., Ltd.*Login:|s p/Huawei/",
        r"telnet m|^..\x01..\x03..\x18..\x1f|s p/Huawei/",
        r"smtp m|^220 ([a-z0-1.-]+).*| h/$1/",
        r"ftp m|^220 H3C Small-FTP Server Version ([\d.]+).* | p/H3C Small-FTP/ v/$1/",
        r"ftp m|^421[- ]Service not available..*|",
        r"ftp m|^220[- ].*filezilla.*|i p/FileZilla/",
        r"msrpc m|^\x05\x00\x0d\x03|s p/Microsoft Windows RPC/",
    ],
    "TerminalServerCookie": [
        r"ms-wbt-server m|^\x03\0\0\x13\x0e\xd0\0\0\x124\0\x02.*\0\x02\0\0\0| p/Microsoft Terminal Services/ o/Windows/ cpe:/o:microsoft:windows/a",
    ],
    "redis-server": [
        r"redis m|^.*redis_version:([.\d]+)\n|s p/Redis key-value store/ v/$1/ cpe:/a:redislabs:redis:$1/",
        r"redis m|^-NOAUTH Authentication required.|s p/Redis key-value store/",
    ],
}


def custom_matches(spark: SparkSession, after: int = 1_000_000) -> DataFrame:
    """The matches of CUSTOM; they stand behind all others of their probe."""
    from lanthorn.sources import catalogs

    text = "\n".join(f"Probe TCP {probe} q||\n" + "\n".join(f"match {m}" for m in ms) for probe, ms in CUSTOM.items())
    _, found = catalogs.parse_probes(text)
    return catalogs.match_table(spark, found).withColumn("idx", F.col("idx") + after)


def as_text(data: Column) -> Column:
    """Bytes as text, one character each."""
    return F.decode(data, "ISO-8859-1")


def matches_of(banners: DataFrame, catalogue: DataFrame) -> DataFrame:
    """All (banner, match) pairs that hold, as ``service.banner_matches`` gives them.

    A pattern runs on the banners of its probe that hold its literal; patterns are joined by (probe, literal) from a
    broadcast table where they are few, so a probe with most banners is no hot key. Bad patterns match nothing.
    """
    m = catalogue.where("pattern is not null")
    exprs = checkpoint(m.join(keywords.with_literals(m).where("ok").drop("ok"), "pattern"))
    words = [r.literal for r in exprs.where("literal is not null").select("literal").distinct().toLocalIterator()]
    texts = banners.where("data is not null")
    met = keywords.scan(texts.withColumn("_low", F.lower("data")), words, "_low").drop("_low").withColumn("literal", F.explode("found")).drop("found")
    near = met.join(few(exprs.where("literal is not null")), ["probe", "literal"]).drop("literal")
    far = exprs.where("literal is null").drop("literal")
    if far.head(1):
        near = near.unionByName(texts.join(few(far), "probe").select(near.columns))
    return near.where("regexp_like(data, pattern)")


def fallback_chain(probes: DataFrame, as_coded: bool = False) -> DataFrame:
    """(probe, step, fallback) of the chain of each probe, each fallback once; a catalogue, so it is walked on the driver.

    With ``as_coded`` a chain has its first step only, whatever follows.
    """
    nxt = {r["name"]: r.fallback for r in probes.where("coalesce(fallback, '') != ''").select("name", "fallback").collect()}
    rows = []
    for name in nxt:
        seen, at = {name}, nxt[name]
        while at and at not in seen and not (as_coded and len(seen) > 1):
            rows.append((name, len(seen), at))
            seen.add(at)
            at = nxt.get(at)
    return probes.sparkSession.createDataFrame(rows, "probe string, step int, fallback string")


def identify(banners: DataFrame, catalogue: DataFrame, probes: DataFrame | None = None, as_coded: bool = False) -> DataFrame:
    """(target, probe, idx, soft, service, version): the winning match of each (target, probe).

    Banners that no match of their own probe tells go down its chain of fallbacks; the first step with a match counts.
    """
    first = service.choose(matches_of(banners, catalogue))
    if probes is None:
        return first
    chain = fallback_chain(probes, as_coded)
    if not chain.head(1):
        return first
    first = checkpoint(first)
    left = banners.join(first.select("target", "probe"), ["target", "probe"], "left_anti").join(few(chain), "probe")
    again = left.select(F.struct("target", "probe", "step").alias("target"), F.col("fallback").alias("probe"), "data")
    found = service.choose(matches_of(again, catalogue)).select(F.col("target.target").alias("target"), F.col("target.probe").alias("probe"), F.col("target.step").alias("step"), "idx", "soft", "service", "version")
    best = found.groupBy("target", "probe").agg(F.min_by(F.struct("idx", "soft", "service", "version"), "step").alias("b")).select("target", "probe", "b.*")
    return first.unionByName(best)


def run(answers: DataFrame, probes: DataFrame, catalogue: DataFrame, level: int = 7) -> DataFrame:
    """(target, port, status, probe, service, version): the state of every target that was asked.

    ``answers``: target, port, probe, tls, error, data (binary). Port 0 is NotMatched. Answers rank by the layers of
    ``service.probe_order`` for the port; the first that tells a service or that nobody listens ends the scan. http under
    TLS is https.
    """
    a = answers.withColumn("data", as_text(F.col("data")))
    told = identify(a.select("target", "probe", "data"), catalogue, probes).select("target", "probe", "service", "version")
    p = probes.select(F.col("name").alias("probe"), "rarity", "ports", "ssl_ports", "seq", "payload")
    has = lambda c: F.coalesce(F.array_contains(c, F.col("port")), F.lit(False))
    early = F.col("port").isin(*service.HTTP_FIRST) & (F.col("probe") == "GetRequest")
    tls_first = F.col("port").isin(*service.TLS_FIRST) & (F.size(F.coalesce("ssl_ports", F.array().cast("array<int>"))) > 0)
    layer = (
        F.when(F.coalesce("payload", F.lit("")) == "", 0).when(early | tls_first, 1).when(has("ports") & (F.col("rarity") >= 1), 1).when(has("ssl_ports"), 2)
        .when((F.col("rarity") >= 1) & (F.col("rarity") <= level), 3)
    )
    d = a.drop("data").join(few(p), "probe").join(told, ["target", "probe"], "left").withColumn("layer", layer).where("layer is not null")
    d = d.withColumn("status", service.classify(F.col("error"), F.col("service"))).withColumn("service", F.when((F.col("service") == "http") & F.col("tls"), "https").otherwise(F.col("service")))
    rank = F.struct((F.col("status") == "NotMatched").alias("late"), "layer", F.when(F.col("layer") == 1, F.when(tls_first, 0).when(early, 1).otherwise(2)).alias("early"), "rarity", "seq")
    best = d.where("port > 0").groupBy("target", "port").agg(F.min_by(F.struct("status", "probe", "service", "version"), rank).alias("b")).select("target", "port", "b.*")
    asked = answers.select("target", "port").distinct().join(best, ["target", "port"], "left")
    return asked.withColumn("status", F.coalesce("status", F.lit("NotMatched")))


def guess(results: DataFrame, services: DataFrame, enabled: bool = False) -> DataFrame:
    """Open targets without a service get the one that their port is registered for, tagged ``guess``; off by default."""
    if not enabled:
        return results.withColumn("tag", F.lit(None).cast("string"))
    known = few(services.where("protocol = 'tcp'").groupBy("port").agg(F.max_by("name", "probability").alias("_guess")))
    d = results.join(known, "port", "left")
    hit = (F.col("status") == "Open") & F.col("service").isNull() & F.col("_guess").isNotNull()
    return d.withColumn("tag", F.when(hit, "guess")).withColumn("service", F.when(hit, F.col("_guess")).otherwise(F.col("service"))).drop("_guess")


def plan(hosts: DataFrame, ports: list[str]) -> DataFrame:
    """(host, port) to be asked: every host with each of the ports, ranges expanded; a port list is a short literal."""
    from lanthorn.operators import parse

    return hosts.select("host", F.explode(F.array_distinct(parse.expand_ports(F.array(*[F.lit(p) for p in ports])))).alias("port"))


def first_framework(found: DataFrame) -> DataFrame:
    """The first framework of each target by its place in the list of its result, else by name."""
    order = [c for c in ("place", "name") if c in found.columns]
    w = Window.partitionBy("target").orderBy(*order)
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_host(payload: Column, host: Column) -> Column:
    """A probe's payload for a host."""
    return F.replace(payload, F.lit("{Host}"), host)


def decoded(send_data: Column) -> Column:
    """Bytes of a payload written with backslash escapes; what is no escape stands for itself."""
    from lanthorn.sources import catalogs

    @F.pandas_udf("binary")
    def run(s):
        import pandas as pd

        return pd.Series([catalogs.unescape(x) if x is not None else None for x in s], dtype=object)

    return run(send_data)
