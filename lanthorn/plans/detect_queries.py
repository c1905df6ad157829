"""Detection from captured responses to merged frameworks, with brute-force SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanthorn.operators import detect, native, web
from lanthorn.plans.merge_queries import NORM, _fill
from lanthorn.plans.native_queries import WON
from lanthorn.plans.web_queries import LINES, _split, _ver
from lanthorn.sources import catalogs
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


def detector(spark, d) -> detect.Detector:
    """All engines over the catalogues of a data directory; icons are off unless asked for."""
    entries, listed = table(spark, d, "native_finger"), table(spark, d, "alias_entry")
    aliases = catalogs.with_yaml_aliases(detect.derived_aliases(entries), listed.select("alias_id", "name", "vendor", "product", "alias", "block"))
    out = detect.Detector(aliases)
    out.register("native", detect.native_engine(entries)).register("wappalyzer", detect.pattern_engine(table(spark, d, "wapp_app")))
    out.register("ehole", detect.keyword_engine(table(spark, d, "ehole"))).register("goby", detect.logic_engine(table(spark, d, "goby")))
    return out.register("favicon", detect.icon_engine(web.icon_table(entries, table(spark, d, "ehole"))), enabled=False)


PARTS = LINES.split("lines AS", 1)[1]
GOBY = """
gf AS (SELECT goby_id, name, logic, r.label AS label, lower(r.feature) AS feature, r.is_equal AS eq FROM (SELECT *, UNNEST(rule) AS r FROM goby) WHERE r.feature IS NOT NULL),
gt AS (SELECT resp_id, goby_id, name, logic, bool_or(hold) AS any_one, count(DISTINCT label) FILTER (WHERE hold) AS n, bool_or(there) AS touched FROM (
  SELECT p.resp_id, gf.*, contains(p.content, gf.feature) AS there, contains(p.content, gf.feature) = gf.eq AS hold FROM parsed p, gf
  WHERE p.content IS NOT NULL AND list_contains(string_split_regex(gf.logic, '&&|\\|\\|'), gf.label)) GROUP BY ALL),
goby_hit AS (SELECT resp_id, goby_id, name FROM gt WHERE touched AND CASE WHEN contains(logic, '&&') THEN n = len(string_split(logic, '&&')) ELSE any_one END)"""
WAPP = f"""
pats AS (SELECT app_id, app, 'html' AS part, '' AS key, CAST(i - 1 AS INTEGER) AS idx, {_split('html[i]')} FROM (SELECT *, UNNEST(RANGE(1, LEN(html) + 1)) AS i FROM wapp_app) WHERE html[i] IS NOT NULL
  UNION ALL SELECT app_id, app, 'cookies', lower(e.key), 0, {_split('e.value')} FROM (SELECT app_id, app, UNNEST(map_entries(cookies)) AS e FROM wapp_app) WHERE e.value IS NOT NULL
  UNION ALL SELECT app_id, app, 'headers', lower(e.key), 0, {_split('e.value')} FROM (SELECT app_id, app, UNNEST(map_entries(headers)) AS e FROM wapp_app) WHERE e.value IS NOT NULL),
wt AS (SELECT resp_id, 'html' AS part, '' AS key, body AS value FROM parsed WHERE body IS NOT NULL UNION ALL SELECT resp_id, 'cookies', key, value FROM cookies UNION ALL SELECT resp_id, 'headers', key, value FROM headers),
wm AS (SELECT resp_id, app_id, app, part, key, idx, {_ver('value')} AS version FROM wt JOIN pats USING (part, key) WHERE expr = '' OR regexp_matches(value, expr)),
wf AS (SELECT resp_id, lower(app) AS name, arg_max(version, (version <> '', part <> 'html', CASE WHEN part <> 'html' THEN -idx ELSE idx END, part, key, app_id, version)) AS version, min(app_id) AS app_id FROM wm GROUP BY ALL),
wcpe AS (SELECT app_id, implies, regexp_replace(lower(cpe), '^cpe:(/|2\\.3:)', '') AS s, lower(cpe) LIKE 'cpe:/%' OR lower(cpe) LIKE 'cpe:2.3:%' AS ok FROM wapp_app),
wapp_hit AS (SELECT resp_id, name, version, CASE WHEN ok AND split_part(s, ':', 2) NOT IN ('', '*', '-') THEN split_part(s, ':', 2) END AS vendor,
  CASE WHEN ok AND split_part(s, ':', 3) NOT IN ('', '*', '-') THEN split_part(s, ':', 3) END AS product, implies AS tags FROM wf JOIN wcpe USING (app_id))"""
EHOLE = """
et AS (SELECT resp_id, 'body' AS part, body AS text FROM parsed WHERE body IS NOT NULL UNION ALL SELECT resp_id, 'header', header FROM parsed WHERE header IS NOT NULL),
er AS (SELECT cms, lower(trim(method)) AS method, CASE WHEN lower(trim(location)) IN ('body', 'title') THEN 'body' WHEN lower(trim(location)) = 'header' THEN 'header' END AS part,
  list_transform(list_filter(coalesce(keyword, []), lambda x: x IS NOT NULL), lambda x: lower(x)) AS words FROM ehole),
ehole_hit AS (SELECT resp_id, cms FROM et JOIN er USING (part) WHERE (method = 'keyword' AND len(list_filter(words, lambda k: NOT contains(text, k))) = 0)
  OR (method = 'regular' AND len(list_filter(words, lambda k: NOT regexp_matches(text, k))) = 0))"""
UNION = f"""{WON}, lines AS{PARTS}, {GOBY}, {WAPP}, {EHOLE},
found AS (SELECT w.resp_id, 'native' AS engine, 0 AS place, w.name, w.version, f.vendor, f.product, f.tags, f.focus FROM frameworks w JOIN native_finger f USING (finger_id)
  UNION ALL SELECT resp_id, 'wappalyzer', 1, name, version, vendor, product, tags, NULL FROM wapp_hit
  UNION ALL SELECT resp_id, 'ehole', 2, cms, NULL, NULL, NULL, NULL, NULL FROM ehole_hit UNION ALL SELECT resp_id, 'goby', 3, name, NULL, NULL, NULL, NULL, NULL FROM goby_hit)"""
BRIDGE = f"""
pairs AS (SELECT CAST(alias_id AS BIGINT) + 1099511627776 AS alias_id, name, vendor, product, block, lower(trim(k)) AS engine, UNNEST(v) AS n FROM (SELECT *, UNNEST(map_keys(alias)) AS k, UNNEST(map_values(alias)) AS v FROM alias_entry)
  UNION ALL SELECT finger_id, name, vendor, product, NULL, 'native', name FROM native_finger WHERE name IS NOT NULL),
amap AS (SELECT engine, norm, a.name AS alias_name, a.vendor AS alias_vendor, a.product AS alias_product, a.blocked AS blocked FROM (
  SELECT engine, {NORM('n')} AS norm, arg_max({{'name': name, 'vendor': vendor, 'product': product, 'blocked': list_contains(list_transform(coalesce(block, []), lambda b: lower(trim(b))), engine)}}, alias_id) AS a FROM pairs WHERE n IS NOT NULL GROUP BY 1, 2)),
live AS (SELECT h.resp_id, h.engine, (h.place, h.engine) AS rank, coalesce(m.alias_name, h.name) AS name, h.version, coalesce(m.alias_vendor, h.vendor) AS vendor, coalesce(m.alias_product, h.product) AS product, h.tags, h.focus
  FROM found h LEFT JOIN amap m ON h.engine = m.engine AND {NORM('h.name')} = m.norm WHERE NOT coalesce(m.blocked, false) AND coalesce(m.alias_name, h.name) IS NOT NULL)"""


@query(f"""WITH {UNION}, {BRIDGE}
SELECT resp_id, lower(name) AS framework, {_fill('version')}, {_fill('vendor')}, {_fill('product')}, array_to_string(list_sort(list_distinct(list(engine))), ',') AS froms,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(list_filter(coalesce(tags, []), lambda t: t IS NOT NULL))))), ','), '') AS tags, bool_or(coalesce(focus, false)) AS focus FROM live GROUP BY resp_id, lower(name)""")
def detect_all(spark, d):
    """Frameworks of every response: the hits of all engines, renamed and blocked by aliases, merged."""
    return detector(spark, d).detect(table(spark, d, "responses"))


@query(f"WITH {UNION} SELECT engine, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT resp_id) AS BIGINT) AS responses FROM found GROUP BY engine")
def detect_hits_by_engine(spark, d):
    found = detector(spark, d).hits(table(spark, d, "responses"))
    return found.groupBy("engine").agg(F.count("*").alias("hits"), F.count_distinct("resp_id").alias("responses"))


@query(f"WITH {UNION} SELECT resp_id, goby_id, name FROM goby_hit")
def goby_hits(spark, d):
    return web.goby_hits(table(spark, d, "responses"), table(spark, d, "goby"))


@query(f"""WITH {UNION}, n AS (SELECT resp_id, lower(name) AS name FROM found WHERE engine = 'native'), w AS (SELECT resp_id, lower(name) AS name FROM found WHERE engine <> 'native') SELECT * FROM n INTERSECT SELECT * FROM w""")
def detect_agreed(spark, d):
    """(resp_id, name) that the native engine and another one both find."""
    found = detector(spark, d).hits(table(spark, d, "responses")).select("resp_id", F.lower("name").alias("name"), (F.col("engine") == "native").alias("own"))
    return found.groupBy("resp_id", "name").agg(F.bool_or("own").alias("a"), F.bool_or(~F.col("own")).alias("b")).where("a and b").select("resp_id", "name")


@query()
def refused_patterns(spark, d):
    """Regular expressions of the native catalogue that do not compile; the rules go on without them."""
    return native.refused_patterns(table(spark, d, "native_finger"))


SQL["wapp_frameworks"] = f"""WITH {WON}, lines AS{PARTS}, {WAPP} SELECT resp_id, lower(app) AS name, arg_max(version, (version <> '', part <> 'html', CASE WHEN part <> 'html' THEN -idx ELSE idx END, part, key, app_id, version)) AS version,
  array_to_string(list_sort(list_distinct(list(part))), ',') AS parts, min(app_id) AS app_id FROM wm GROUP BY resp_id, lower(app)"""

PAGES = "SELECT CAST(ehole_id AS BIGINT) AS resp_id, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Server: ' || coalesce(cms, '') || chr(13) || chr(10) || chr(13) || chr(10) || array_to_string(keyword, ' ') AS raw FROM ehole WHERE keyword IS NOT NULL"


@query(f"""WITH pages AS ({PAGES}), parsed AS (SELECT resp_id, CASE WHEN sep > 0 THEN substr(content, 1, sep - 1) END AS header, CASE WHEN sep > 0 THEN substr(content, sep + 4) END AS body
  FROM (SELECT resp_id, lower(raw) AS content, instr(lower(raw), chr(13) || chr(10) || chr(13) || chr(10)) AS sep FROM pages)),
et AS (SELECT resp_id, 'body' AS part, body AS text FROM parsed WHERE body IS NOT NULL UNION ALL SELECT resp_id, 'header', header FROM parsed WHERE header IS NOT NULL),
er AS (SELECT ehole_id, lower(trim(method)) AS method, CASE WHEN lower(trim(location)) IN ('body', 'title') THEN 'body' WHEN lower(trim(location)) = 'header' THEN 'header' END AS part, list_transform(list_filter(coalesce(keyword, []), lambda x: x IS NOT NULL), lambda x: lower(x)) AS words FROM ehole),
hit AS (SELECT resp_id, ehole_id, method FROM et JOIN er USING (part) WHERE method = 'keyword' AND len(list_filter(words, lambda k: NOT contains(text, k))) = 0)
SELECT method, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT resp_id) AS BIGINT) AS pages, CAST(count(DISTINCT ehole_id) AS BIGINT) AS rules FROM hit GROUP BY method""")
def ehole_own_pages(spark, d):
    """Keyword rules over pages that hold the keywords of the catalogue's own rows: every rule meets its own page at least."""
    rows = table(spark, d, "ehole").where("keyword is not null")
    raw = F.concat(F.lit("HTTP/1.1 200 OK\r\nServer: "), F.coalesce("cms", F.lit("")), F.lit("\r\n\r\n"), F.array_join("keyword", " "))
    none = [F.lit(None).cast("string").alias(c) for c in ("url", "host", "port", "cert")]
    pages = rows.select(F.col("ehole_id").cast("bigint").alias("resp_id"), *none, raw.alias("raw"))
    hit = web.ehole_hits(pages, table(spark, d, "ehole")).where("method = 'keyword'")
    return hit.groupBy("method").agg(F.count("*").alias("hits"), F.count_distinct("resp_id").alias("pages"), F.count_distinct("ehole_id").alias("rules"))
