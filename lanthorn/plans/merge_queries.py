"""Queries of alias resolution, merging, reports and service identification, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanthorn.operators import alias, equivalence, native, parse, service
from lanthorn.plans.data_queries import P2, _l, _u
from lanthorn.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep


NORM = lambda c: f"regexp_replace(lower({c}), '[-_ ]', '', 'g')"
AMAP = f"""
pairs AS (SELECT alias_id, name, vendor, product, block, lower(trim(k)) AS engine, UNNEST(v) AS n FROM (SELECT *, UNNEST(map_keys(alias)) AS k, UNNEST(map_values(alias)) AS v FROM alias_entry)),
amap AS (SELECT engine, norm, a.alias_id AS alias_id, a.name AS alias_name, a.vendor AS alias_vendor, a.product AS alias_product, a.blocked AS blocked FROM (
  SELECT engine, {NORM('n')} AS norm, arg_max({{'alias_id': alias_id, 'name': name, 'vendor': vendor, 'product': product,
         'blocked': list_contains(list_transform(coalesce(block, []), lambda b: lower(trim(b))), engine)}}, alias_id) AS a FROM pairs WHERE n IS NOT NULL GROUP BY 1, 2))"""
RESOLVED = f"""{AMAP}, resolved AS (
  SELECT h.resp_id, lower(trim(h.engine)) AS engine, coalesce(m.alias_name, h.name) AS name, h.name AS old_name, m.alias_id, h.version, coalesce(m.alias_vendor, h.vendor) AS vendor,
         coalesce(m.alias_product, h.product) AS product, h.tags, h.focus, coalesce(m.blocked, false) AS blocked
  FROM hits h LEFT JOIN amap m ON lower(trim(h.engine)) = m.engine AND {NORM('h.name')} = m.norm)"""


def _map(spark, d):
    return alias.alias_map(table(spark, d, "alias_entry"))


def _resolved(spark, d):
    return alias.resolve(table(spark, d, "hits"), _map(spark, d))


@query(f"SELECT name, {NORM('name')} AS norm, CAST(count(*) AS BIGINT) AS rows FROM hits WHERE name IS NOT NULL GROUP BY 1, 2")
def normalize_name(spark, d):
    n = table(spark, d, "hits").where("name is not null").groupBy("name").agg(F.count("*").alias("rows"))
    return n.select("name", alias.normalize(F.col("name")).alias("norm"), "rows")


@query(f"WITH {AMAP} SELECT engine, norm, alias_id, alias_name, blocked FROM amap")
def alias_bridge(spark, d):
    return _map(spark, d).select("engine", "norm", "alias_id", "alias_name", "blocked")


@query(f"WITH {RESOLVED} SELECT engine, name, CAST(count(*) AS BIGINT) AS hits, CAST(count(alias_id) AS BIGINT) AS renamed FROM resolved GROUP BY 1, 2")
def alias_resolve(spark, d):
    return _resolved(spark, d).groupBy("engine", "name").agg(F.count("*").alias("hits"), F.count("alias_id").alias("renamed"))


@query(f"WITH {RESOLVED} SELECT engine, CAST(count(*) AS BIGINT) AS kept FROM resolved WHERE NOT blocked GROUP BY 1")
def alias_block_anti(spark, d):
    blocked = _map(spark, d).where("blocked").select("engine", "norm")
    h = table(spark, d, "hits").select(alias.engine_key(F.col("engine")).alias("engine"), alias.normalize(F.col("name")).alias("norm"))
    return h.join(blocked, ["engine", "norm"], "left_anti").groupBy("engine").agg(F.count("*").alias("kept"))


@query(f"WITH {AMAP} SELECT norm, min(engine) AS engine, arg_min(alias_id, engine) AS alias_id FROM amap GROUP BY norm")
def alias_find_any(spark, d):
    return _map(spark, d).groupBy("norm").agg(F.min("engine").alias("engine"), F.min_by("alias_id", "engine").alias("alias_id"))


@query("""SELECT alias_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat([vendor, product, metadata['category'], metadata['type']], coalesce(tags, [])), lambda x: lower(x)), lambda x: x <> ''))), ',') AS tags FROM alias_entry""")
def alias_tags(spark, d):
    get = lambda k: F.try_element_at("metadata", F.lit(k))
    every = F.concat(F.array("vendor", "product", get("category"), get("type")), F.coalesce("tags", F.array().cast("array<string>")))
    low = F.filter(F.transform(every, lambda x: F.lower(x)), lambda x: x != "")
    return table(spark, d, "alias_entry").select("alias_id", F.array_join(F.array_sort(F.array_distinct(low)), ",").alias("tags"))


@query("""SELECT lower(name) AS name, array_to_string(list_sort(list_distinct(flatten(list(pocs)))), ',') AS pocs, CAST(count(*) AS BIGINT) AS entries FROM alias_entry WHERE name IS NOT NULL AND pocs IS NOT NULL GROUP BY 1""")
def poc_union(spark, d):
    a = table(spark, d, "alias_entry").where("name is not null and pocs is not null")
    # sets of poc lists form before the shuffle
    pocs = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("pocs")))), ",")
    return a.groupBy(F.lower("name").alias("name")).agg(pocs.alias("pocs"), F.count("*").alias("entries"))




def _fill(c: str) -> str:
    return f"arg_min({c}, (rank, {c})) FILTER (WHERE {c} <> '') AS {c}"


@query(f"""WITH {RESOLVED}, live AS (SELECT *, coalesce(engine, '~') AS rank FROM resolved WHERE NOT blocked AND name IS NOT NULL AND resp_id IS NOT NULL)
SELECT resp_id, lower(name) AS framework, {_fill('version')}, {_fill('vendor')}, {_fill('product')}, coalesce(array_to_string(list_sort(list_distinct(list(engine) FILTER (WHERE engine IS NOT NULL))), ','), '') AS froms,
  array_to_string(list_sort(list_distinct(flatten(list(list_filter(coalesce(tags, []), lambda t: t IS NOT NULL))))), ',') AS tags, bool_or(coalesce(focus, false)) AS focus FROM live GROUP BY resp_id, lower(name)""")
def merge_engines(spark, d):
    out = alias.merge(_resolved(spark, d))
    return out.withColumn("froms", F.coalesce("froms", F.lit("")))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{e}', {w}, {s}, {e not in alias.OPTIONAL})" for e, (w, s) in alias.CAPABILITY.items()) + ") t(engine, web, service, enabled)")
def engine_capability(spark, d):
    rows = [(e, w, s, e not in alias.OPTIONAL) for e, (w, s) in alias.CAPABILITY.items()]
    return spark.createDataFrame(rows, "engine string, web boolean, service boolean, enabled boolean")


@query("SELECT 'native' AS engine, CAST(count(*) AS BIGINT) AS size FROM native_finger UNION ALL SELECT 'wappalyzer', count(*) FROM wapp_app UNION ALL SELECT 'ehole', count(*) FROM ehole UNION ALL SELECT 'goby', count(*) FROM goby UNION ALL SELECT 'alias', count(*) FROM alias_entry")
def engine_sizes(spark, d):
    one = lambda e, t: table(spark, d, t).agg(F.lit(e).alias("engine"), F.count("*").alias("size"))
    out = one("native", "native_finger")
    for e, t in (("wappalyzer", "wapp_app"), ("ehole", "ehole"), ("goby", "goby"), ("alias", "alias_entry")):
        out = out.unionByName(one(e, t))
    return out


@query("""WITH n AS (SELECT name, count(DISTINCT resp_id) AS n FROM hits WHERE name IS NOT NULL GROUP BY 1), t AS (SELECT count(DISTINCT resp_id) AS t FROM hits)
SELECT name, CAST(n AS BIGINT) AS responses, n > t // 3 AS suspicious FROM n, t""")
def fingerprint_frequency(spark, d):
    h = table(spark, d, "hits").select("resp_id", "name")
    total = h.agg(F.count_distinct("resp_id").alias("t"))
    n = h.where("name is not null").distinct().groupBy("name").agg(F.count("resp_id").alias("responses"))
    return n.join(F.broadcast(total)).select("name", "responses", F.expr("responses > t div 3").alias("suspicious"))


@query("""WITH h AS (SELECT DISTINCT resp_id, lower(trim(engine)) AS engine FROM hits WHERE engine IS NOT NULL), t AS (SELECT count(*) AS t FROM responses)
SELECT engine, CAST(count(*) AS BIGINT) AS detected, CAST(max(t) - count(*) AS BIGINT) AS missed FROM h, t GROUP BY engine""")
def engine_detection_counts(spark, d):
    h = table(spark, d, "hits").where("engine is not null").select("resp_id", alias.engine_key(F.col("engine")).alias("engine")).distinct()
    total = table(spark, d, "responses").agg(F.count("*").alias("t"))
    return h.groupBy("engine").agg(F.count("*").alias("detected")).join(F.broadcast(total)).select("engine", "detected", (F.col("t") - F.col("detected")).alias("missed"))


@query("""WITH h AS (SELECT DISTINCT resp_id, lower(trim(engine)) AS engine, lower(name) AS name FROM hits WHERE name IS NOT NULL AND engine IS NOT NULL)
SELECT resp_id, name FROM h WHERE engine <> 'xray' EXCEPT SELECT resp_id, name FROM h WHERE engine = 'xray'""")
def engine_compare_anti(spark, d):
    h = table(spark, d, "hits").where("name is not null and engine is not null")
    h = h.groupBy("resp_id", F.lower("name").alias("name")).agg(F.bool_or(alias.engine_key(F.col("engine")) == "xray").alias("x"))
    return h.where("not x").select("resp_id", "name")


@query("""WITH h AS (SELECT DISTINCT resp_id, lower(trim(engine)) AS engine, lower(name) AS name FROM hits WHERE name IS NOT NULL)
SELECT r.resp_id, CAST(count(*) AS BIGINT) AS missed FROM responses r JOIN (SELECT resp_id, name FROM h WHERE engine <> 'xray' EXCEPT SELECT resp_id, name FROM h WHERE engine = 'xray') m ON r.resp_id = m.resp_id
GROUP BY 1 ORDER BY missed DESC, r.resp_id LIMIT 30""")
def top_k_missed(spark, d):
    """Thirty responses with the most names that one engine misses; the limit is the report."""
    n = engine_compare_anti(spark, d).groupBy("resp_id").agg(F.count("*").alias("missed"))
    n = n.join(table(spark, d, "responses").select("resp_id"), "resp_id", "left_semi")
    return n.orderBy(F.desc("missed"), "resp_id").limit(30)


@query("""SELECT CAST(count(*) AS BIGINT) AS scanned, CAST(count(raw) AS BIGINT) AS open, CAST(count(h.resp_id) AS BIGINT) AS identified, 100.0 * count(h.resp_id) / count(raw) AS rate
FROM responses r LEFT JOIN (SELECT DISTINCT resp_id FROM hits) h ON r.resp_id = h.resp_id""")
def scan_stats(spark, d):
    h = table(spark, d, "hits").select("resp_id").distinct().withColumn("hit", F.lit(1))
    r = table(spark, d, "responses").join(h, "resp_id", "left")
    return r.agg(F.count("*").alias("scanned"), F.count("raw").alias("open"), F.count("hit").alias("identified"), (F.count("hit") * 100.0 / F.count("raw")).alias("rate"))


@query(f"WITH {RESOLVED} SELECT engine, 100.0 * count(alias_id) / count(*) AS percent FROM resolved GROUP BY 1")
def alias_success_rate(spark, d):
    return _resolved(spark, d).groupBy("engine").agg((F.count("alias_id") * 100.0 / F.count("*")).alias("percent"))


@query("SELECT resp_id, engine, name, version, matcher_type, rule_idx, matcher_idx, seen_at, CAST(count(*) AS BIGINT) AS copies FROM hits GROUP BY ALL HAVING count(*) > 1")
def duplicate_hits(spark, d):
    keys = ["resp_id", "engine", "name", "version", "matcher_type", "rule_idx", "matcher_idx", "seen_at"]
    return table(spark, d, "hits").groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


@query("""SELECT 'native_rules' AS catalog, 'name' AS problem, CAST(count(*) FILTER (WHERE coalesce(name, '') = '') AS BIGINT) AS rows FROM native_finger
UNION ALL SELECT 'native_rules', 'rule', count(*) FILTER (WHERE coalesce(len(rule), 0) = 0) FROM native_finger
UNION ALL SELECT 'alias', 'name', count(*) FILTER (WHERE coalesce(name, '') = '') FROM alias_entry
UNION ALL SELECT 'alias', 'mapping', count(*) FILTER (WHERE coalesce(len(map_keys(alias)), 0) = 0) FROM alias_entry
UNION ALL SELECT 'alias', 'priority', count(*) FILTER (WHERE priority NOT BETWEEN 0 AND 5) FROM alias_entry""")
def catalog_validate(spark, d):
    blank = lambda c: F.count_if(F.coalesce(c, F.lit("")) == "")
    f = table(spark, d, "native_finger").agg(blank("name").alias("name"), F.count_if(F.coalesce(F.size("rule"), F.lit(0)) <= 0).alias("rule"))
    a = table(spark, d, "alias_entry").agg(blank("name").alias("name"), F.count_if(F.coalesce(F.size("alias"), F.lit(0)) <= 0).alias("mapping"), F.count_if(~F.col("priority").between(0, 5)).alias("priority"))
    long = lambda df, c: df.select(F.lit(c).alias("catalog"), F.expr("stack(%d, %s)" % (len(df.columns), ", ".join(f"'{x}', {x}" for x in df.columns))).alias("problem", "rows"))
    return long(f, "native_rules").unionByName(long(a, "alias"))


@query(r"SELECT resp_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/.*$', '') AS target FROM responses WHERE url IS NOT NULL")
def host_extract(spark, d):
    r = table(spark, d, "responses").where("url is not null")
    return r.select("resp_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "/.*$", "").alias("target"))


@query(r"""SELECT app_id, coalesce(CASE WHEN part IN ('', '*', '-') THEN NULL ELSE part END, '') AS part, CASE WHEN vendor IN ('', '*', '-') THEN NULL ELSE vendor END AS vendor, CASE WHEN product IN ('', '*', '-') THEN NULL ELSE product END AS product FROM (
SELECT app_id, split_part(s, ':', 1) AS part, split_part(s, ':', 2) AS vendor, split_part(s, ':', 3) AS product FROM (SELECT app_id, regexp_replace(lower(cpe), '^cpe:(/|2\.3:)', '') AS s FROM wapp_app WHERE lower(cpe) LIKE 'cpe:%'))""")
def cpe_parse(spark, d):
    a = table(spark, d, "wapp_app").select("app_id", alias.cpe_parts(F.col("cpe")).alias("c")).where("c is not null")
    return a.select("app_id", F.coalesce("c.part", F.lit("")).alias("part"), "c.vendor", "c.product")


# --- service identification over inline banners -----------------------------------------------------------------------

#: (target, probe, data)
BANNERS = [
    ("t1", "NULL", "220 files FileZilla Server 0.9.60 beta"), ("t2", "NULL", "-NOAUTH Authentication required."), ("t3", "GetRequest", "HTTP/1.1 200 OK\r\nServer: nginx/1.18.0\r\n\r\n"),
    ("t4", "NULL", "$4\r\nredis_version:7.0.1\r\n"), ("t5", "NULL", "SSH-2.0-OpenSSH_8.9p1 Ubuntu"), ("t6", "GenericLines", "220 mail ready ESMTP Postfix"), ("t7", "NULL", "nothing known"),
]
#: (probe, idx, soft, service, pattern, version template)
MATCHES = [
    ("NULL", 1, True, "ftp", "^220 .*", None), ("NULL", 2, False, "smtp", "^220 .*FileZilla", None), ("NULL", 3, False, "ftp", "FileZilla Server ([0-9.]+)", "$1"), ("NULL", 4, True, "redis", "^-NOAUTH", None),
    ("NULL", 5, False, "redis", "redis_version:([0-9.]+)", "v$P(1)"), ("NULL", 6, False, "ssh", "^SSH-([0-9.]+)-OpenSSH_([a-z0-9.]+)", "$2 proto $1"), ("GetRequest", 1, False, "ssl/http", "Server: nginx/([0-9.]+)", "$1"), ("SMTP", 1, False, "smtp", "ESMTP ([A-Za-z]+)", "$1"),
]
FALLBACK = [("GenericLines", "SMTP")]


def _banners(spark):
    return spark.createDataFrame(BANNERS, "target string, probe string, data string")


def _matches(spark):
    return spark.createDataFrame(MATCHES, "probe string, idx int, soft boolean, service string, pattern string, version string")


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''").replace("\r", "'||chr(13)||'").replace("\n", "'||chr(10)||'") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


MET = f"""b AS (SELECT * FROM (VALUES {_values(BANNERS)}) t(target, probe, data)), m AS (SELECT * FROM (VALUES {_values(MATCHES)}) t(probe, idx, soft, service, pattern, version)),
met AS (SELECT b.target, b.data, m.* FROM b JOIN m USING (probe) WHERE regexp_matches(data, pattern)),
s AS (SELECT target, probe, min(idx) AS s_idx, arg_min(service, idx) AS s_service FROM met WHERE soft GROUP BY 1, 2),
h AS (SELECT target, probe, min(met.idx) AS idx FROM met LEFT JOIN s USING (target, probe) WHERE NOT soft AND (s_idx IS NULL OR idx < s_idx OR service = s_service) GROUP BY 1, 2)"""


@query(f"""WITH {MET} SELECT h.target, h.probe, CAST(h.idx AS INTEGER) AS idx, CASE met.service WHEN 'ssl/http' THEN 'https' ELSE met.service END AS service,
replace(replace(replace(met.version, '$P(1)', '$1'), '$1', regexp_extract(data, pattern || '()()', 1)), '$2', regexp_extract(data, pattern || '()()', 2)) AS version FROM h JOIN met USING (target, probe, idx)""")
def nmap_first_hard_match(spark, d):
    return service.identify(_banners(spark), _matches(spark)).where("not soft").select("target", "probe", "idx", "service", "version")


@query(f"WITH {MET} SELECT s.target, s.probe, CAST(s_idx AS INTEGER) AS idx, s_service AS service FROM s ANTI JOIN h USING (target, probe)")
def nmap_soft_match(spark, d):
    return service.identify(_banners(spark), _matches(spark)).where("soft").select("target", "probe", "idx", "service")


@query(f"""WITH {MET} SELECT b.target, b.probe, 'smtp' AS service, regexp_extract(b.data, 'ESMTP ([A-Za-z]+)', 1) AS version FROM b WHERE b.probe = 'GenericLines' AND regexp_matches(b.data, 'ESMTP ([A-Za-z]+)')""")
def nmap_fallback(spark, d):
    f = spark.createDataFrame(FALLBACK, "probe string, fallback string")
    out = service.identify_with_fallback(_banners(spark), _matches(spark), f)
    return out.where("probe = 'GenericLines'").select("target", "probe", "service", "version")


def _nodes(spark, d):
    from lanthorn.plans import data_queries

    return data_queries.nested_nodes(spark, d).where("kind = 'probe'")


def _int_list(e: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform({_l(e)}, lambda x: TRY_CAST(x->>'$' AS INTEGER)), lambda x: x IS NOT NULL)))"


_ONE = lambda c: f"CASE WHEN json_type({c}) IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE {c}->>'$' END"
PROBE_ROWS = f"""{P2}, raw_probe AS (SELECT rec_id, {_u("json_extract(j, '$.name')")} AS n, {_u("json_extract(j, '$.protocol')")} AS p, {_u("json_extract(j, '$.rarity')")} AS r, {_int_list("json_extract(j, '$.ports')")} AS ports, {_int_list("json_extract(j, '$.ssl_ports')")} AS ssl_ports FROM root WHERE k = 'probe'),
probe AS (SELECT rec_id, {_ONE('n')} AS name, {_ONE('p')} AS protocol, TRY_CAST({_ONE('r')} AS INTEGER) AS rarity, coalesce(ports, []) AS ports, coalesce(ssl_ports, []) AS ssl_ports FROM raw_probe)"""


@query(f"""WITH {PROBE_ROWS}, n AS (SELECT rec_id, {_u("json_extract(v, '$.soft')")} AS s FROM mch WHERE json_type(v) = 'OBJECT' AND len(json_keys(v)) > 0)
SELECT p.rec_id, p.name, CAST(count(n.rec_id) FILTER (WHERE coalesce(lower(s->>'$'), '') = 'true') AS BIGINT) AS soft, CAST(count(n.rec_id) FILTER (WHERE coalesce(lower(s->>'$'), '') <> 'true') AS BIGINT) AS hard FROM probe p LEFT JOIN n USING (rec_id) GROUP BY ALL""")
def catalogue_soft_hard(spark, d):
    """Soft and hard matches of the probe records; a probe without matches counts 0."""
    nodes = _nodes(spark, d)
    n = service.catalogue_matches(nodes).groupBy("probe").agg(F.count_if("soft").alias("soft"), F.count_if(~F.col("soft")).alias("hard"))
    p = service.catalogue_probes(nodes).select(F.col("seq").alias("rec_id"), "name")
    return p.join(n.withColumnRenamed("probe", "rec_id"), "rec_id", "left").select("rec_id", "name", F.coalesce("soft", F.lit(0)).alias("soft"), F.coalesce("hard", F.lit(0)).alias("hard"))


@query(f"""WITH {PROBE_ROWS}, l AS (SELECT *, len(ssl_ports) > 0 AS early, CASE WHEN coalesce(lower(name), '') LIKE '%null' THEN 0 WHEN (list_contains(ports, 443) OR name = 'GetRequest' OR len(ssl_ports) > 0) AND rarity >= 1 THEN 1
 WHEN list_contains(ssl_ports, 443) THEN 2 WHEN rarity >= 1 AND rarity <= 7 THEN 3 END AS layer FROM probe)
SELECT CAST(row_number() OVER (ORDER BY layer, rarity NULLS FIRST, CASE WHEN early OR name = 'GetRequest' THEN 0 ELSE 1 END, rec_id) AS INTEGER) AS place, name, CAST(layer AS INTEGER) AS layer FROM l WHERE layer IS NOT NULL""")
def catalogue_probe_order(spark, d):
    """The probe records in their order for port 443 and level 7."""
    return service.probe_order(service.catalogue_probes(_nodes(spark, d)), 443, 7)


@query(f"WITH {PROBE_ROWS} SELECT name, rarity FROM probe WHERE upper(protocol) = 'UDP' AND rarity <= 7 AND (len(ports) = 0 OR list_contains(ports, 137))")
def catalogue_udp_probes(spark, d):
    """The probe records that are asked at UDP port 137 up to level 7."""
    return service.udp_probes(service.catalogue_probes(_nodes(spark, d)), 137, 7)


@query()
def catalogue_identify(spark, d):
    """Services of the captured responses by the matches of the probe records, soft and hard."""
    messages = table(spark, d, "responses").select(F.col("resp_id").alias("target"), F.col("raw").alias("data"))
    return service.identify_messages(messages, service.catalogue_matches(_nodes(spark, d)))


_FIXED = lambda c: f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in service.PROTOCOLS.items()) + f" ELSE CASE WHEN {c} LIKE 'ssl/_%' THEN {c}[5:] || '-ssl' ELSE replace(CASE WHEN regexp_matches({c}, '^[0-9]') THEN 'S' || {c} ELSE {c} END, '_', '-') END END"


@query(f"""WITH {P2}, n AS (SELECT DISTINCT s->>'$' AS name FROM (SELECT {_u("json_extract(v, '$.service')")} AS s FROM mch WHERE json_type(v) = 'OBJECT') WHERE json_type(s) NOT IN ('OBJECT', 'ARRAY', 'NULL'))
SELECT name, {_FIXED('name')} AS protocol FROM n""")
def fix_protocol(spark, d):
    """The service names of the probe records in this engine's spelling."""
    n = service.catalogue_matches(_nodes(spark, d)).where("service is not null").select(F.col("service").alias("name")).distinct()
    return n.select("name", service.fix_protocol(F.col("name")).alias("protocol"))


@query(f"""WITH {P2}, msg AS (SELECT DISTINCT name || '/' || version AS target, lower(split_part(name, ' ', 1)) || ' ' || version || chr(13) || chr(10) AS data FROM hits WHERE name IS NOT NULL AND version IS NOT NULL),
raw_match AS (SELECT rec_id AS probe, pos AS idx, {_u("json_extract(v, '$.soft')")} AS so, {_u("json_extract(v, '$.service')")} AS se, {_u("json_extract(v, '$.pattern')")} AS pa, {_u("json_extract(" + _u("json_extract(v, '$.version_info')") + ", '$.version')")} AS ve FROM mch WHERE json_type(v) = 'OBJECT'),
m AS (SELECT probe, idx, coalesce(lower(so->>'$'), '') = 'true' AS soft, {_ONE('se')} AS service, {_ONE('pa')} AS pattern, {_ONE('ve')} AS version FROM raw_match),
met AS (SELECT msg.target, msg.data, m.* FROM msg, m WHERE pattern IS NOT NULL AND TRY(regexp_matches(data, pattern))),
s AS (SELECT target, probe, min(idx) AS s_idx, arg_min(service, idx) AS s_service FROM met WHERE soft GROUP BY 1, 2),
h AS (SELECT target, probe, arg_min({{'idx': met.idx, 'service': service, 'version': CASE WHEN version IS NOT NULL THEN replace(replace(replace(version, '$P(1)', '$1'), '$1', regexp_extract(data, pattern || '()()', 1)), '$2', regexp_extract(data, pattern || '()()', 2)) END}}, met.idx) AS h
  FROM met LEFT JOIN s USING (target, probe) WHERE NOT soft AND (s_idx IS NULL OR idx < s_idx OR service = s_service) GROUP BY 1, 2),
w AS (SELECT target, probe, coalesce(h.h.idx, s_idx) AS idx, h.h IS NULL AS soft, coalesce(h.h.service, s_service) AS name, h.h.version AS version FROM h FULL JOIN s USING (target, probe))
SELECT target, probe, CAST(idx AS INTEGER) AS idx, soft, {_FIXED('name')} AS service, version FROM w""")
def service_identify(spark, d):
    """Banners of the names and versions found, told by the matches of every probe record: soft and hard matches."""
    h = table(spark, d, "hits").where("name is not null and version is not null").select("name", "version").distinct()
    data = F.concat(F.lower(F.substring_index("name", " ", 1)), F.lit(" "), "version", F.lit("\r\n"))
    messages = h.select(F.concat_ws("/", "name", "version").alias("target"), data.alias("data"))
    return service.identify_messages(messages, service.catalogue_matches(_nodes(spark, d)))


#: name, port, protocol
SERVICES = [("http", 80, "tcp"), ("https", 443, "tcp"), ("https-alt", 8443, "tcp"), ("http-proxy", 8080, "tcp"), ("snmp", 161, "udp")]


@query(f"""WITH s AS (SELECT * FROM (VALUES {_values(SERVICES)}) t(name, port, proto)), r AS (SELECT resp_id, CASE WHEN regexp_full_match(n, '[0-9]{{1,5}}') THEN CAST(n AS INTEGER) END AS port, proto FROM
 (SELECT resp_id, CASE WHEN lower(port[1:2]) = 'u:' THEN port[3:] ELSE port END AS n, CASE WHEN lower(port[1:2]) = 'u:' THEN 'udp' ELSE 'tcp' END AS proto FROM responses))
SELECT resp_id, coalesce(s.name, 'unknown') AS service FROM r LEFT JOIN s ON r.port = s.port AND r.proto = s.proto""")
def port_guess(spark, d):
    s = spark.createDataFrame(SERVICES, "name string, port int, proto string")
    r = table(spark, d, "responses").select("resp_id", parse.port_struct(F.col("port")).alias("p")).select("resp_id", "p.*")
    return r.join(s, ["port", "proto"], "left").select("resp_id", F.coalesce("name", F.lit("unknown")).alias("service"))


@query("""WITH w AS (SELECT finger_id, name, default_port, UNNEST(r.regexps.body) AS pattern FROM (SELECT *, UNNEST(rule) AS r FROM native_finger WHERE lower(trim(protocol)) = 'tcp')),
h AS (SELECT p.resp_id, w.finger_id, w.name, CASE WHEN list_contains(default_port, p.port) OR len(list_filter(default_port, lambda x: regexp_full_match(x, '[0-9]{1,5}-[0-9]{1,5}') AND regexp_full_match(p.port, '[0-9]{1,5}')
   AND TRY_CAST(p.port AS INTEGER) BETWEEN TRY_CAST(split_part(x, '-', 1) AS INTEGER) AND TRY_CAST(split_part(x, '-', 2) AS INTEGER))) > 0 THEN 1 WHEN coalesce(len(default_port), 0) = 0 THEN 2 ELSE 3 END AS o
  FROM responses p, w WHERE contains(p.raw, w.pattern))
SELECT resp_id, arg_min(finger_id, (o, finger_id)) AS finger_id, arg_min(name, (o, finger_id)) AS name FROM h GROUP BY 1""")
def socket_port_group(spark, d):
    return service.socket_first(table(spark, d, "responses"), table(spark, d, "native_finger"))


@query("SELECT host, count(*) AS requests, CAST(count(DISTINCT url) AS BIGINT) AS distinct_urls FROM responses GROUP BY host")
def path_cache_dedup(spark, d):
    """Requests that one answer per address saves: distinct addresses against rows."""
    u = table(spark, d, "responses").groupBy("host", "url").agg(F.count("*").alias("n"))
    return u.groupBy("host").agg(F.sum("n").alias("requests"), F.count("url").alias("distinct_urls"))


@query("""WITH r AS (SELECT finger_id, CAST(i - 1 AS INTEGER) AS rule_idx, rule[i].send_data AS payload FROM (SELECT *, UNNEST(RANGE(1, LEN(rule) + 1)) AS i FROM native_finger) WHERE coalesce(rule[i].send_data, '') <> '')
SELECT 'host' AS target, finger_id, CAST(min(rule_idx) AS INTEGER) AS rule_idx, arg_min(payload, rule_idx) AS payload FROM r GROUP BY finger_id""")
def active_first_hit(spark, d):
    """The first payload of each finger that a host answers; every payload is answered here and every rule holds."""
    plan = native.payloads(table(spark, d, "native_finger"), 99).where("source = 'rule'").withColumn("payload_idx", F.lit(0)).drop("source")
    answers = plan.select(F.lit("host").alias("target"), "payload", F.xxhash64("payload").alias("answer_id"))
    hits = plan.select(F.xxhash64("payload").alias("answer_id"), "finger_id", "rule_idx")
    return service.first_active(plan, answers, hits)


@query("""WITH m AS (SELECT * FROM (VALUES ('positive', 200, 'alpha', 'x-0: beta'), ('wrong_status', 500, 'alpha', 'x-0: beta'), ('empty_body', 200, '', 'x-0: beta'), ('missing_headers', 200, 'alpha', ''),
  ('drop_body[0]', 200, '', 'x-0: beta'), ('drop_hdr[0]', 200, 'alpha', ''), ('solo_body[0]', 200, 'alpha', ''), ('solo_hdr[0]', 200, '', 'beta')) t(mock, status_code, body, all_headers)),
c AS (SELECT (status_code = 200 AND contains(body, 'alpha') AND contains(all_headers, 'beta')) = (contains(body, 'alpha') AND contains(all_headers, 'beta')) AS same FROM m)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE same) AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE NOT same) AS BIGINT) AS failed, bool_and(same) AS consistent FROM c""")
def rule_equivalence(spark, d):
    """A source expression and a target that forgets the status: they differ where only the status is wrong."""
    left = 'status_code == 200 && contains(body, "alpha") && contains(all_headers, "beta")'
    right = 'contains(body, "alpha") && contains(all_headers, "beta")'
    return equivalence.report(equivalence.compare(spark, left, right, ["alpha"], ["beta"]))


@query(f"SELECT resp_id, CAST(port AS INTEGER) IN {service.TLS_PORTS} AS tls FROM responses WHERE regexp_full_match(port, '[0-9]{{1,5}}')")
def tls_port(spark, d):
    r = table(spark, d, "responses").select("resp_id", parse.port_struct(F.col("port")).alias("p")).where("p.port is not null and p.proto = 'tcp'")
    return r.select("resp_id", F.col("p.port").isin(*service.TLS_PORTS).alias("tls"))


STATES = [("t1", "connection refused", None), ("t2", "i/o timeout", None), ("t3", None, "http"), ("t4", None, ""), ("t5", "no route to host", "x"), ("t6", "", "ssh")]


@query(f"""SELECT target, CASE WHEN regexp_matches(lower(error), 'refused|no route|unreachable') THEN 'Closed' WHEN coalesce(error, '') <> '' OR coalesce(service, '') = '' THEN 'NotMatched' ELSE 'Matched' END AS state
FROM (VALUES {_values(STATES)}) t(target, error, service)""")
def response_classify(spark, d):
    s = spark.createDataFrame(STATES, "target string, error string, service string")
    return s.select("target", service.classify(F.col("error"), F.col("service")).alias("state"))


UDP = [("a", "UDP", 1, [137]), ("b", "udp", 3, []), ("c", "UDP", 9, []), ("d", "TCP", 1, [137]), ("e", "UDP", 2, [53])]


@query("SELECT * FROM (VALUES ('t1', 'https', '1.18.0'), ('t2', 'ssl', NULL), ('t3', 'ssh', '9')) t(target, service, version)")
def ssl_second_pass(spark, d):
    first = spark.createDataFrame([("t1", "ssl", None), ("t2", "ssl", None), ("t3", "ssh", "9")], "target string, service string, version string")
    inner = spark.createDataFrame([("t1", "GetRequest", BANNERS[2][2]), ("t3", "GetRequest", BANNERS[2][2])], "target string, probe string, data string")
    return service.second_pass(first, inner, _matches(spark).where("probe = 'GetRequest'"))


RESULTS = [("t1", "http", "nginx", "1.18", None, "web", None, None, ["cpe:/a:igor:nginx:1.18", "cpe:/o:linux:kernel"]), ("t2", "ssl/http", None, "", "v", None, "h", "router", None), ("t3", "x", "p", None, None, None, None, None, ["cpe:/a:m:p1", "cpe:/a:m:p2:7"])]


@query("SELECT * FROM (VALUES ('t1', 'nginx', '1.18', 'igor', 'nginx', 'web'), ('t2', 'https', NULL, 'v', NULL, 'vendor:v,hostname:h,device:router'), ('t3', 'p1', NULL, 'm', 'p1', ''), ('t3', 'p2', '7', 'm', 'p2', '')) t(target, name, version, vendor, product, tags)")
def service_frameworks(spark, d):
    r = spark.createDataFrame(RESULTS, "target string, service string, product string, version string, vendor string, info string, hostname string, device string, cpes array<string>")
    return service.frameworks(r)


@query("""SELECT h.host, count(*) AS responses, CAST(bool_or(a.site IS NOT NULL) AS BOOLEAN) AS listed FROM responses h LEFT JOIN
(SELECT DISTINCT regexp_replace(regexp_extract(lower(website), '^(?:https?:)?(?://)?(?:www[.])?([^/?#]+)', 1), '^www[.]', '') AS site FROM wapp_app WHERE website IS NOT NULL) a
ON list_aggregate(list_slice(string_split(h.host, '.'), -2, -1), 'string_agg', '.') = a.site GROUP BY h.host""")
def target_match(spark, d):
    """Hosts whose registered domain is some application's website."""
    site = F.regexp_extract(F.lower("website"), r"^(?:https?:)?(?://)?(?:www[.])?([^/?#]+)", 1)
    sites = table(spark, d, "wapp_app").where("website is not null").select(site.alias("site")).distinct()
    h = table(spark, d, "responses").groupBy("host").agg(F.count("*").alias("responses")).withColumn("site", F.substring_index("host", ".", -2))
    return h.join(sites.withColumn("hit", F.lit(True)), "site", "left").select("host", "responses", F.coalesce("hit", F.lit(False)).alias("listed"))


@query(f"""WITH {AMAP}, h AS (SELECT DISTINCT lower(trim(engine)) AS engine, name FROM hits WHERE name IS NOT NULL AND engine IS NOT NULL),
p AS (SELECT DISTINCT engine, lower(n) AS n FROM pairs WHERE n IS NOT NULL) SELECT h.engine, h.name, bool_or(contains(lower(h.name), p.n)) AS expected FROM h JOIN p ON h.engine = p.engine GROUP BY 1, 2""")
def expected_alias(spark, d):
    """Names that hold an alias name of their engine, as the expectation check counts them; distinct names against the
    alias list, found by the keyword index."""
    from lanthorn.operators import keywords

    p = table(spark, d, "alias_entry").select(F.explode("alias").alias("e", "ns")).select(alias.engine_key(F.col("e")).alias("engine"), F.explode("ns").alias("n"))
    p = p.where("n is not null").select("engine", F.lower("n").alias("pattern")).distinct()
    h = table(spark, d, "hits").where("name is not null and engine is not null").select(alias.engine_key(F.col("engine")).alias("engine"), "name").distinct()
    h = h.join(p.select("engine").distinct(), "engine", "left_semi")
    hit = keywords.keyword_hits(h.select(F.struct("engine", "name").alias("id"), F.lower("name").alias("text")), p).select("id.*", "pattern")
    yes = hit.join(p, ["engine", "pattern"], "left_semi").select("engine", "name").distinct().withColumn("hit", F.lit(True))
    return h.join(yes, ["engine", "name"], "left").select("engine", "name", F.coalesce("hit", F.lit(False)).alias("expected"))


PRESETS = [("web", ["80", "8000-8002"]), ("win", ["445", "winrm"])]


@query("SELECT * FROM (VALUES ('web', '80'), ('web', '8000'), ('web', '8001'), ('web', '8002'), ('win', '445'), ('win', 'winrm')) t(name, port)")
def port_presets(spark, d):
    p = spark.createDataFrame(PRESETS, "name string, ports array<string>")
    return p.select("name", F.explode(parse.expand_ports(F.col("ports"))).alias("port"))


@query("SELECT resp_id, 'xray_hdr_' || replace(lower(trim(split_part(line, ':', 1))), '-', '_') AS variable FROM (SELECT DISTINCT resp_id, UNNEST(string_split_regex(regexp_extract(raw, '(?s)^(.*?)\\r\\n\\r\\n', 1), '\\r?\\n')) AS line FROM responses) WHERE instr(line, ':') > 0 GROUP BY ALL")
def header_variables(spark, d):
    """Names under which expressions see the headers."""
    header, _ = parse.after_split(F.col("raw"))
    keys = F.array_distinct(F.transform(parse.header_lines(header), lambda x: x["key"]))
    r = table(spark, d, "responses").select("resp_id", F.explode(keys).alias("k"))
    return r.select("resp_id", F.concat(F.lit("xray_hdr_"), F.translate("k", "-", "_")).alias("variable"))


@query("SELECT resp_id, regexp_replace(raw, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS clean FROM responses WHERE raw IS NOT NULL")
def strip_controls(spark, d):
    r = table(spark, d, "responses").where("raw is not null")
    return r.select("resp_id", F.regexp_replace("raw", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "").alias("clean"))
