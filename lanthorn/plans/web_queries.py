"""Queries of the web engines, with brute-force SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanthorn.operators import templates, web
from lanthorn.plans.parse_queries import PARSED
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


def _ehole_sql(method: str, test: str) -> str:
    return f"""WITH {PARSED}, e AS (SELECT ehole_id, cms, CASE WHEN lower(trim(location)) IN ('body', 'title') THEN 'body' WHEN lower(trim(location)) = 'header' THEN 'header' END AS part,
  list_transform(list_filter(coalesce(keyword, []), lambda x: x IS NOT NULL), lambda x: lower(x)) AS words FROM ehole WHERE lower(trim(method)) = '{method}'),
t AS (SELECT resp_id, 'body' AS part, body AS text FROM parsed WHERE body IS NOT NULL UNION ALL SELECT resp_id, 'header', header FROM parsed WHERE header IS NOT NULL)
SELECT resp_id, ehole_id, cms FROM t JOIN e USING (part) WHERE len(list_filter(words, lambda k: NOT {test})) = 0"""


def _ehole(method):
    def run(spark, d):
        return web.ehole_hits(table(spark, d, "responses"), table(spark, d, "ehole")).where(F.col("method") == method).select("resp_id", "ehole_id", "cms")

    return run


for _n, _m, _t in [("ehole_keyword_all", "keyword", "contains(text, k)"), ("ehole_regular_all", "regular", "regexp_matches(text, k)")]:
    QUERIES[_n], SQL[_n] = _ehole(_m), _ehole_sql(_m, _t)


@query(f"""WITH {PARSED}, f AS (SELECT goby_id, name, logic, r.label AS label, lower(r.feature) AS feature, r.is_equal AS eq FROM (SELECT *, UNNEST(rule) AS r FROM goby) WHERE r.feature IS NOT NULL),
t AS (SELECT resp_id, goby_id, name, logic, bool_or(hold) AS any_one, count(DISTINCT label) FILTER (WHERE hold) AS n FROM (
  SELECT p.resp_id, f.*, contains(p.content, f.feature) = f.eq AS hold FROM parsed p, f WHERE p.content IS NOT NULL AND list_contains(string_split_regex(f.logic, '&&|\\|\\|'), f.label)) GROUP BY ALL)
SELECT goby_id, name, CAST(count(*) AS BIGINT) AS responses FROM t WHERE CASE WHEN contains(logic, '&&') THEN n = len(string_split(logic, '&&')) ELSE any_one END GROUP BY ALL""")
def goby_logic(spark, d):
    return web.goby_counts(table(spark, d, "responses"), table(spark, d, "goby"))


LINES = rf"""{PARSED}, lines AS (SELECT resp_id, UNNEST(string_split_regex(raw_header, '\r?\n')) AS line FROM parsed WHERE raw_header IS NOT NULL),
headers AS (SELECT resp_id, lower(trim(split_part(line, ':', 1))) AS key, lower(trim(substr(line, instr(line, ':') + 1))) AS value FROM lines WHERE instr(line, ':') > 0),
cookies AS (SELECT resp_id, split_part(x, '=', 1) AS key, substr(x, instr(x, '=') + 1) AS value FROM (
  SELECT resp_id, trim(UNNEST(CASE WHEN contains(piece, ',') THEN string_split(piece, ',') ELSE string_split(piece, ';') END)) AS x FROM (
    SELECT resp_id, UNNEST(string_split(value, ' ')) AS piece FROM headers WHERE key = 'set-cookie')) WHERE instr(x, '=') > 0)"""


def _split(p: str) -> str:
    return rf"lower(split_part({p}, '\;', 1)) AS expr, coalesce(TRY_CAST(regexp_extract(lower({p}), '\\;version:\\(\d+)', 1) AS INTEGER), 0) AS grp"


def _ver(text: str) -> str:
    case = " ".join(f"WHEN {n} THEN coalesce(list_extract(regexp_extract_all({text}, expr || repeat('()', {n}), {n}), -1), '')" for n in (1, 2, 3))
    return f"CASE WHEN expr = '' THEN '' ELSE CASE grp {case} ELSE '' END END"


def _keyed(part: str, source: str):
    def run(spark, d):
        return web.app_hits(table(spark, d, "responses"), table(spark, d, "wapp_app"), (part,)).select("resp_id", "app_id", "key", "version")

    sql = f"""WITH {LINES}, pats AS (SELECT app_id, lower(e.key) AS key, {_split('e.value')} FROM (SELECT app_id, UNNEST(map_entries({part})) AS e FROM wapp_app) WHERE e.value IS NOT NULL)
SELECT resp_id, app_id, key, {_ver('value')} AS version FROM {source} JOIN pats USING (key) WHERE expr = '' OR regexp_matches(value, expr)"""
    return run, sql


QUERIES["wapp_headers"], SQL["wapp_headers"] = _keyed("headers", "headers")
QUERIES["wapp_cookies"], SQL["wapp_cookies"] = _keyed("cookies", "cookies")


@query(f"""WITH {PARSED}, pats AS (SELECT app_id, CAST(i - 1 AS INTEGER) AS idx, {_split('html[i]')} FROM (SELECT app_id, html, UNNEST(RANGE(1, LEN(html) + 1)) AS i FROM wapp_app) WHERE html[i] IS NOT NULL)
SELECT resp_id, app_id, idx, {_ver('body')} AS version FROM parsed, pats WHERE body IS NOT NULL AND (expr = '' OR regexp_matches(body, expr))""")
def wapp_html(spark, d):
    return web.app_hits(table(spark, d, "responses"), table(spark, d, "wapp_app"), ("html",)).select("resp_id", "app_id", "idx", "version")


@query()
def wapp_meta_version(spark, d):
    """Meta tag patterns; needs an HTML tokenizer, which SQL lacks."""
    return web.app_hits(table(spark, d, "responses"), table(spark, d, "wapp_app"), ("meta",)).select("resp_id", "app_id", "key", "idx", "version")


@query()
def wapp_script_src(spark, d):
    """Script source patterns; needs an HTML tokenizer, which SQL lacks."""
    return web.app_hits(table(spark, d, "responses"), table(spark, d, "wapp_app"), ("scriptsrc",)).select("resp_id", "app_id", "idx", "version")


@query()
def wapp_frameworks(spark, d):
    return web.app_frameworks(table(spark, d, "responses"), table(spark, d, "wapp_app"))


@query(f"""WITH {LINES}, pats AS (SELECT app_id, lower(e.key) AS key, {_split('e.value')} FROM (SELECT app_id, UNNEST(map_entries(cookies)) AS e FROM wapp_app) WHERE e.value IS NOT NULL),
hit AS (SELECT DISTINCT resp_id, app_id FROM cookies JOIN pats USING (key) WHERE expr = '' OR regexp_matches(value, expr))
SELECT resp_id, app_id, array_to_string(list_sort(list_distinct(list_filter(implies, lambda x: x IS NOT NULL))), ',') AS tags FROM hit JOIN wapp_app USING (app_id) WHERE len(implies) > 0""")
def wapp_implies_tags(spark, d):
    """Implied names become tags of the hit, not hits of their own."""
    apps = table(spark, d, "wapp_app")
    hit = web.app_hits(table(spark, d, "responses"), apps, ("cookies",)).select("resp_id", "app_id").distinct()
    tags = F.array_join(F.array_sort(F.array_distinct(F.filter("implies", lambda x: x.isNotNull()))), ",")
    return hit.join(apps.where("size(implies) > 0").select("app_id", tags.alias("tags")), "app_id").select("resp_id", "app_id", "tags")


@query("""SELECT h.name, min(a.description) AS description, min(a.website) AS website, min(a.cpe) AS cpe, CAST(max(h.n) AS BIGINT) AS hits FROM
(SELECT lower(name) AS name, count(*) AS n FROM hits WHERE name IS NOT NULL GROUP BY 1) h LEFT JOIN wapp_app a ON lower(a.app) = h.name GROUP BY 1""")
def wapp_info(spark, d):
    """Names found, enriched with what the application list says; the join is without case."""
    n = table(spark, d, "hits").where("name is not null").groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("hits"))
    a = table(spark, d, "wapp_app").groupBy(F.lower("app").alias("name")).agg(*[F.min(c).alias(c) for c in ("description", "website", "cpe")])
    return n.join(a, "name", "left").select("name", "description", "website", "cpe", "hits")


ICONS = """
icons AS (SELECT CASE WHEN n >= 2147483648 THEN CAST(n - 4294967296 AS VARCHAR) WHEN n IS NOT NULL THEN CAST(n AS VARCHAR) ELSE h END AS hash, name, o, i FROM (
  SELECT *, CASE WHEN regexp_full_match(h, '[+-]?[0-9]{1,10}') THEN CAST(h AS BIGINT) WHEN regexp_full_match(h, '0x[0-9a-f]{1,8}') THEN CAST(h AS BIGINT) END AS n FROM (
    SELECT lower(trim(UNNEST(r.favicon.md5))) AS h, name, 0 AS o, CAST(finger_id AS BIGINT) AS i FROM (SELECT *, UNNEST(rule) AS r FROM native_finger)
    UNION ALL SELECT lower(trim(UNNEST(r.favicon.mmh3))), name, 0, finger_id FROM (SELECT *, UNNEST(rule) AS r FROM native_finger)
    UNION ALL SELECT lower(trim(UNNEST(keyword))), cms, 1, ehole_id FROM ehole WHERE lower(trim(method)) = 'faviconhash')) WHERE h IS NOT NULL AND name IS NOT NULL),
known AS (SELECT hash, arg_max(name, (o, i, name)) AS name FROM icons GROUP BY hash)"""


@query(f"WITH {ICONS} SELECT hash, name FROM known")
def favicon_table(spark, d):
    return web.icon_table(table(spark, d, "native_finger"), table(spark, d, "ehole"))


@query(f"""WITH {ICONS}, f AS (SELECT fav_id, lower(trim(md5)) AS md5, lower(trim(mmh3)) AS h, CASE WHEN regexp_full_match(lower(trim(mmh3)), '[+-]?[0-9]{{1,10}}|0x[0-9a-f]{{1,8}}') THEN CAST(lower(trim(mmh3)) AS BIGINT) END AS n FROM favicon)
SELECT fav_id, coalesce(a.name, b.name) AS name FROM f LEFT JOIN known a ON f.md5 = a.hash
LEFT JOIN known b ON CASE WHEN n >= 2147483648 THEN CAST(n - 4294967296 AS VARCHAR) ELSE CAST(n AS VARCHAR) END = b.hash WHERE coalesce(a.name, b.name) IS NOT NULL""")
def favicon_lookup(spark, d):
    known = web.icon_table(table(spark, d, "native_finger"), table(spark, d, "ehole"))
    return web.icon_lookup(table(spark, d, "favicon"), known)


# --- templates over all responses -------------------------------------------------------------------------------------

TPL = rf"""t AS (SELECT resp_id, raw, CASE WHEN a > 0 THEN substr(raw, 1, a - 1) WHEN b > 0 THEN substr(raw, 1, b - 1) END AS h, lower(CASE WHEN a > 0 THEN substr(raw, a + 4) WHEN b > 0 THEN substr(raw, b + 2) END) AS body
  FROM (SELECT resp_id, raw, instr(raw, chr(13) || chr(10) || chr(13) || chr(10)) AS a, instr(raw, chr(10) || chr(10)) AS b FROM responses)),
ev AS (SELECT resp_id, body, strlen(raw) AS content_length, CAST(coalesce(TRY_CAST(split_part(regexp_extract(raw, '\A([^\r\n]*)', 1), ' ', 2) AS INTEGER), 0) AS INTEGER) AS status_code,
  array_to_string(list_transform(list_filter(string_split_regex(h, '\r?\n'), lambda x: instr(x, ':') > 0), lambda x: lower(trim(split_part(x, ':', 1))) || ': ' || lower(trim(substr(x, instr(x, ':') + 1))) || chr(10)), '') AS all_headers
  FROM t WHERE body IS NOT NULL)"""


def _tpl(name: str, requests: list[dict], where: str, root: bool = False) -> None:
    t = {"id": name, "requests": requests}

    def run(spark, d):
        return templates.match(table(spark, d, "responses"), [templates.root_only(t) if root else t])

    QUERIES[name], SQL[name] = run, f"WITH {TPL} SELECT resp_id, '{name}' AS template_id FROM ev WHERE {where}"


_word = {"type": "word", "words": ["Board</title>", "Router</TITLE>"]}
_tpl("tpl_word", [{"matchers": [_word]}], "contains(body, 'board</title>') OR contains(body, 'router</title>')")
_tpl("tpl_word_and", [{"matchers": [{"type": "word", "words": ["<title>", "_session"], "condition": "and"}]}], "contains(body, '<title>') AND contains(body, '_session')")
_tpl("tpl_word_negative", [{"matchers": [_word | {"negative": True}]}], "NOT (contains(body, 'board</title>') OR contains(body, 'router</title>'))")
_tpl("tpl_regex", [{"matchers": [{"type": "regex", "regex": ["server: [a-z]+/3[.][0-9]+"], "part": "header"}]}], "regexp_matches(all_headers, 'server: [a-z]+/3[.][0-9]+')")
_tpl("tpl_regex_case", [{"matchers": [{"type": "regex", "regex": ["Server: [a-z]+"], "part": "header"}]}], "regexp_matches(all_headers, 'Server: [a-z]+')")
_tpl("tpl_status", [{"matchers": [{"type": "status", "status": [301, 302, 403]}]}], "status_code IN (301, 302, 403)")
_tpl("tpl_size", [{"matchers": [{"type": "size", "size": list(range(100, 121))}]}], "content_length BETWEEN 100 AND 120")
_tpl("tpl_binary", [{"matchers": [{"type": "binary", "binary": ["3c7469746c653e"]}]}], "contains(body, '<title>')")
_tpl("tpl_favicon", [{"matchers": [{"type": "favicon", "hash": ["d41d8cd98f00b204e9800998ecf8427e"]}]}], "body = ''")
_dsl = 'status_code == 200 && (contains(body, "archive") || icontains(all_headers, "SERVER: S")) && !contains(body, "proxy")'
_tpl("tpl_dsl", [{"matchers": [{"type": "dsl", "dsl": [_dsl]}]}], "status_code = 200 AND (contains(body, 'archive') OR contains(all_headers, 'server: s')) AND NOT contains(body, 'proxy')")
_combo = {"condition": "and", "matchers": [{"type": "status", "status": 200}, {"type": "word", "words": ["text/html"], "part": "header"}, {"type": "regex", "regex": ["<title>[a-z]+ portal"]}]}
_tpl("tpl_and_combo", [_combo], "status_code = 200 AND contains(all_headers, 'text/html') AND regexp_matches(body, '<title>[a-z]+ portal')")
_tpl("tpl_two_requests", [_combo, {"matchers": [{"type": "status", "status": [404]}]}, {"matchers": []}], "status_code = 404 OR (status_code = 200 AND contains(all_headers, 'text/html') AND regexp_matches(body, '<title>[a-z]+ portal'))")
_tpl("xray_root_path", [{"path": ["{{BaseURL}}/"], "matchers": [{"type": "status", "status": 200}]}, {"path": ["{{BaseURL}}/login"], "matchers": [{"type": "status", "status": 404}]}], "status_code = 200", root=True)


@query(f"WITH {TPL} SELECT resp_id, status_code, CAST(content_length AS INTEGER) AS content_length, all_headers FROM ev")
def template_event(spark, d):
    return templates.events(table(spark, d, "responses")).select("resp_id", "status_code", "content_length", "all_headers")


def _templates(spark, d):
    return templates.catalogue(table(spark, d, "nested_record").where("kind = 'template'"))


@query()
def tpl_catalogue(spark, d):
    """All templates of the catalogue over all responses, in one pass."""
    return templates.frameworks(table(spark, d, "responses"), _templates(spark, d)[0])


@query()
def tpl_catalogue_refused(spark, d):
    """Templates that cannot be read, by reason."""
    rows = spark.createDataFrame(_templates(spark, d)[1], "id string, reason string")
    return rows.groupBy("reason").agg(F.count("*").alias("templates"))
