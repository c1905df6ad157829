"""Service identification from captured probe responses.

Rows are banners (target, probe, data); the catalogue holds ordered matches per probe. Nothing here opens a socket: a
probe that would have to be sent is a row of a plan table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanthorn.operators import keywords, native, parse
from lanthorn.session import checkpoint, few

#: Exact renames of service names (fixed values).
PROTOCOLS = {
    "ssl/http": "https", "http-proxy": "http", "ms-wbt-server": "rdp", "microsoft-ds": "smb", "netbios-ssn": "netbios", "oracle-tns": "oracle",
    "msrpc": "rpc", "ms-sql-s": "mssql", "domain": "dns", "svnserve": "svn", "ibm-db2": "db2", "socks-proxy": "socks5",
}
#: Ports on which TLS is expected (fixed values).
TLS_PORTS = (443, 465, 636, 989, 990, 992, 993, 994, 995, 5986, 8443)
#: Ports that try the HTTP request early, and those that try the TLS probes early (fixed values).
HTTP_FIRST = (80, 443, 8000, 8080, 8443, 8888, 9090)
TLS_FIRST = (443, 3389, 8443)


def fix_protocol(c: Column) -> Column:
    """Service name in this engine's spelling: exact renames, ``ssl/x`` to ``x-ssl``, a digit in front gets an S,
    underscores become hyphens."""
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in PROTOCOLS.items() for x in kv]), c)
    ssl = F.when(c.startswith("ssl/") & (F.length(c) > 4), F.concat(F.substr(c, F.lit(5)), F.lit("-ssl")))
    s = F.when(c.rlike("^[0-9]"), F.concat(F.lit("S"), c)).otherwise(c)
    return F.coalesce(exact, ssl, F.translate(s, "_", "-"))


def fix_service_name(c: Column) -> Column:
    s = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(s == "", "unknown").when(s.isin("www", "www-http"), "http").when(s == "http-ssl", "https")
        .when(s.isin("domain", "nameserver"), "dns").otherwise(F.translate(s, "_", "-"))
    )


def fill_template(template: Column, groups: Column) -> Column:
    """Version text with ``$n`` and ``$P(n)`` replaced by the groups of the match (array, group 1 first), without CR LF."""
    out = F.regexp_replace(template, r"\$P\((\d)\)", r"\$$1")
    for n in range(1, 10):
        out = F.replace(out, F.lit(f"${n}"), F.coalesce(F.get(groups, F.lit(n - 1)), F.lit("")))
    return F.regexp_replace(out, "[\r\n]", "")


def match_groups(data: str, pattern: str, most: int = 9) -> Column:
    """array of the groups 1.. of the first match, as far as the pattern has them (empty groups stand in for the rest)."""
    pads = "()" * most
    return F.array(*[F.expr(f"regexp_extract({data}, concat({pattern}, '{pads}'), {n})") for n in range(1, most + 1)])


def banner_matches(banners: DataFrame, catalogue: DataFrame) -> DataFrame:
    """All (banner, match) pairs that hold: equality of the probe, then the expression, where its literal is there."""
    from lanthorn.operators import scan

    return scan.matches_of(banners, catalogue)


def identify(banners: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(target, probe, idx, soft, service, version): the winning match of each banner.

    In order, the first soft match fixes the service and later matches must have it; the first hard match that may
    count wins; with none, the first soft match stands, without version.
    """
    return choose(banner_matches(banners, catalogue))


def choose(met: DataFrame) -> DataFrame:
    """The winning match of each (target, probe) among the pairs that hold, as ``identify`` gives it."""
    key = ["target", "probe"]
    soft = met.where("soft").groupBy(*key).agg(F.min("idx").alias("s_idx"), F.min_by("service", "idx").alias("s_service"))
    ok = F.col("s_idx").isNull() | (F.col("idx") < F.col("s_idx")) | (F.col("service") == F.col("s_service"))
    hard = met.where("not soft").join(soft, key, "left").where(ok)
    filled = fill_template(F.col("version"), match_groups("data", "pattern"))
    hard = hard.withColumn("v", F.when(F.col("version").isNotNull(), filled))
    win = hard.groupBy(*key).agg(F.min_by(F.struct("idx", "service", F.col("v").alias("version")), "idx").alias("h"))
    out = win.join(soft, key, "full")
    return out.select(
        *key, F.coalesce("h.idx", "s_idx").alias("idx"), F.col("h").isNull().alias("soft"),
        fix_protocol(F.coalesce("h.service", "s_service")).alias("service"), F.col("h.version").alias("version"),
    )


def catalogue_probes(nodes: DataFrame) -> DataFrame:
    """(seq, name, protocol, rarity, ports, ssl_ports, payload) of the probe records of an adjacency table.

    Each record is a probe of its own, seq being its id. The records do not carry what a probe sends: the NULL probes
    (by name) send nothing, all others something, for which the name stands in ``payload``.
    """
    one = lambda p: F.max(F.when(F.col("path") == p, F.col("scalar")))
    many = lambda p: F.sort_array(F.collect_set(F.when(F.col("path") == p, F.col("scalar").try_cast("int"))))
    d = nodes.where("kind = 'probe' and type != 'bad'").groupBy("rec_id", "key").agg(
        one(".name").alias("name"), one(".protocol").alias("protocol"), one(".rarity").try_cast("int").alias("rarity"),
        many(".ports").alias("ports"), many(".ssl_ports").alias("ssl_ports"),
    )
    silent = F.lower(F.coalesce("name", F.lit(""))).endswith("null")
    return d.select(F.col("rec_id").alias("seq"), "name", "protocol", "rarity", "ports", "ssl_ports", F.when(silent, "").otherwise(F.coalesce("name", F.lit("?"))).alias("payload"))


def catalogue_matches(nodes: DataFrame) -> DataFrame:
    """(probe, idx, soft, service, pattern, version) of the probe records of an adjacency table; probe is the record's id."""
    one = lambda p: F.max(F.when(F.col("path") == f".matches.{p}", F.col("scalar")))
    inner = nodes.where("kind = 'probe' and path like '.matches.%'").groupBy(F.col("rec_id").alias("probe"), "key", F.col("anc")[0].alias("idx"))
    d = inner.agg(one("soft").alias("soft"), one("service").alias("service"), one("pattern").alias("pattern"), one("version_info.version").alias("version"))
    return d.select("probe", "idx", F.coalesce(F.lower("soft") == "true", F.lit(False)).alias("soft"), "service", "pattern", "version")


def identify_messages(messages: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``identify`` of (target, data) rows that do not tell their probe: the matches of every probe are tried.

    A pattern runs on the messages that hold its required literal; patterns without one meet all messages.
    """
    m = catalogue.where("pattern is not null")
    exprs = checkpoint(m.join(keywords.with_literals(m).where("ok"), "pattern"))
    words = [r.literal for r in exprs.where("literal is not null").select("literal").distinct().toLocalIterator()]
    texts = messages.where("data is not null").withColumn("low", F.lower("data"))
    met = keywords.scan(texts, words, "low").select("target", "data", F.explode("found").alias("literal"))
    near = met.join(few(exprs.where("literal is not null")), "literal").where("regexp_like(data, pattern)").drop("literal")
    bare = [r.pattern for r in exprs.where("literal is null").select("pattern").distinct().collect()]
    if bare:
        far = keywords.bare_hits(messages.where("data is not null").select("target", "data"), bare, "data")
        near = near.unionByName(far.join(few(exprs.where("literal is null").drop("literal")), "pattern").select(near.columns))
    return choose(near)


def identify_with_fallback(banners: DataFrame, catalogue: DataFrame, fallback: DataFrame) -> DataFrame:
    """``identify``; banners without result are matched once more against the fallback probe's matches (one step)."""
    first = identify(banners, catalogue)
    left = banners.join(first, ["target", "probe"], "left_anti").join(fallback, "probe")
    again = left.select("target", F.col("probe").alias("own"), F.col("fallback").alias("probe"), "data")
    second = identify(again.select("target", "probe", "data"), catalogue).join(again.select("target", "own", "probe"), ["target", "probe"])
    return first.unionByName(second.select("target", F.col("own").alias("probe"), "idx", "soft", "service", "version"))


def probe_order(probes: DataFrame, port: int, level: int) -> DataFrame:
    """Probes for a port in order: those without payload, those for the port by rarity, those for it under TLS, the rest by
    rarity up to ``level``; each probe once, at its first place. ``probes``: name, rarity, ports, ssl_ports, seq, payload."""
    has = lambda c: F.coalesce(F.array_contains(c, port), F.lit(False))
    tls = F.size(F.coalesce("ssl_ports", F.array().cast("array<int>"))) > 0
    early = (F.lit(port in HTTP_FIRST) & (F.col("name") == "GetRequest")) | (F.lit(port in TLS_FIRST) & tls)
    layer = (
        F.when(F.coalesce("payload", F.lit("")) == "", 0).when((has("ports") | early) & (F.col("rarity") >= 1), 1).when(has("ssl_ports"), 2).when((F.col("rarity") >= 1) & (F.col("rarity") <= level), 3)
    )
    d = probes.withColumn("layer", layer).where("layer is not null")
    from pyspark.sql import Window

    # the probe catalogue is a few hundred rows: one window over all of it
    place = F.row_number().over(Window.orderBy("layer", "rarity", F.when(early, 0).otherwise(1), "seq", "name"))
    return d.select(place.alias("place"), "name", "layer")


def udp_probes(probes: DataFrame, port: int, level: int) -> DataFrame:
    """UDP probes for a port: rarity up to ``level``, made for the port or for none in particular, by rarity and name."""
    fit = F.coalesce(F.size("ports"), F.lit(0)) <= 0
    p = probes.where((F.upper("protocol") == "UDP") & (F.col("rarity") <= level) & (fit | F.coalesce(F.array_contains("ports", port), F.lit(False))))
    return p.select("name", "rarity").orderBy("rarity", "name")


def classify(error: Column, service: Column) -> Column:
    """State of a probe response: Closed where nobody listens, Matched with a service, NotMatched otherwise."""
    closed = F.lower(error).rlike("refused|no route|unreachable")
    return F.when(closed, "Closed").when((F.coalesce(error, F.lit("")) != "") | (F.coalesce(service, F.lit("")) == ""), "NotMatched").otherwise("Matched")


def second_pass(first: DataFrame, tls_banners: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Targets whose service is ssl are matched again on what they answered within TLS; http found there is https."""
    again = tls_banners.join(first.where("service = 'ssl'").select("target"), "target", "left_semi")
    inner = identify(again, catalogue).withColumn("service", F.when(F.col("service") == "http", "https").otherwise(F.col("service")))
    best = inner.groupBy("target").agg(F.min_by(F.struct("service", "version"), F.struct("soft", "idx", "probe")).alias("b")).select("target", "b.*")
    other = first.where("service != 'ssl'").select("target", "service", "version")
    kept = first.where("service = 'ssl'").join(best, "target", "left_anti").select("target", "service", "version")
    return other.unionByName(best).unionByName(kept)


def frameworks(results: DataFrame) -> DataFrame:
    """(target, name, version, vendor, product, tags): one row per application cpe of a result, else one row.

    ``results``: target, service, product, version, vendor, info, hostname, device, cpes.
    """
    tag = lambda k, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(k), c) if k else c)
    tags = F.array_compact(F.array(tag("vendor:", F.col("vendor")), tag("", F.col("info")), tag("hostname:", F.col("hostname")), tag("device:", F.col("device"))))
    apps = F.filter(F.coalesce("cpes", F.array().cast("array<string>")), lambda c: F.lower(c).startswith("cpe:/a:"))
    d = results.withColumn("tags", tags).withColumn("cpe", F.explode_outer(apps))
    at = lambda i: F.get(F.split(F.regexp_replace("cpe", "^cpe:/a:", ""), ":"), F.lit(i))
    return d.select(
        "target", F.coalesce(at(1), "product", fix_protocol(F.col("service"))).alias("name"), F.coalesce(F.when(F.col("version") != "", F.col("version")), at(2)).alias("version"),
        F.coalesce(at(0), "vendor").alias("vendor"), F.coalesce(at(1), "product").alias("product"), F.array_join("tags", ",").alias("tags"),
    )


def socket_first(responses: DataFrame, entries: DataFrame) -> DataFrame:
    """(resp_id, finger_id, name): the first tcp finger whose body keyword is in the message as it stands.

    Entries of the message's port go first, then those without port, then all others; among equals the smallest id.
    """
    tcp = entries.where("lower(trim(protocol)) = 'tcp'")
    words = native.rules(tcp).select("finger_id", "name", "default_port", F.explode("r.regexps.body").alias("pattern")).where("pattern is not null")
    texts = responses.where("raw is not null").select(F.struct("resp_id", "port").alias("id"), F.col("raw").alias("text"))
    hit = keywords.keyword_hits(texts, words).select("id.*", "pattern").join(words, "pattern")
    ports = parse.expand_ports(F.coalesce("default_port", F.array().cast("array<string>")))
    mine = F.coalesce(F.array_contains(ports, F.col("port")), F.lit(False))
    order = F.when(mine, 1).when(F.coalesce(F.size("default_port"), F.lit(0)) <= 0, 2).otherwise(3)
    return hit.groupBy("resp_id").agg(F.min_by(F.struct("finger_id", "name"), F.struct(order, "finger_id")).alias("f")).select("resp_id", "f.*")


def first_active(plan: DataFrame, answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(target, finger_id, rule_idx, payload): the first payload in order whose answer holds the rule.

    ``plan`` (finger_id, rule_idx, payload_idx, payload), ``answers`` (target, payload, answer_id), ``hits`` (answer_id,
    finger_id, rule_idx). An answer is taken once per target and payload.
    """
    once = answers.groupBy("target", "payload").agg(F.min("answer_id").alias("answer_id"))
    met = plan.join(once, "payload").join(hits, ["answer_id", "finger_id", "rule_idx"])
    best = F.min_by(F.struct("rule_idx", "payload"), F.struct("rule_idx", "payload_idx"))
    return met.groupBy("target", "finger_id").agg(best.alias("b")).select("target", "finger_id", "b.*")
