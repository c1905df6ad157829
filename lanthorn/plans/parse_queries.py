"""Queries on the parts of captured messages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanthorn.operators import native, parse
from lanthorn.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: A message as both engines see it: content is lower case, header and body are null without an empty line.
PARSED = """
parsed AS (
  SELECT resp_id, url, host, port, cert, raw, content,
         CASE WHEN sep > 0 THEN substr(content, 1, sep - 1) END AS header, CASE WHEN sep > 0 THEN substr(content, sep + 4) END AS body,
         CASE WHEN sep > 0 THEN substr(raw, 1, sep - 1) END AS raw_header, CASE WHEN sep > 0 THEN substr(raw, sep + 4) END AS raw_body
  FROM (SELECT *, lower(raw) AS content, instr(raw, chr(13) || chr(10) || chr(13) || chr(10)) AS sep FROM responses)
)"""


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep


@query(f"WITH {PARSED} SELECT resp_id, header, body FROM parsed")
def split_header_body(spark, d):
    return parse.parsed(table(spark, d, "responses")).select("resp_id", "header", "body")


@query("""
SELECT resp_id, CASE WHEN a > 0 THEN substr(raw, 1, a - 1) WHEN b > 0 THEN substr(raw, 1, b - 1) END AS header,
       CASE WHEN a > 0 THEN substr(raw, a + 4) WHEN b > 0 THEN substr(raw, b + 2) END AS body
FROM (SELECT resp_id, raw, instr(raw, chr(13) || chr(10) || chr(13) || chr(10)) AS a, instr(raw, chr(10) || chr(10)) AS b FROM responses)
""")
def template_split(spark, d):
    header, body = parse.template_parts(F.col("raw"))
    return table(spark, d, "responses").select("resp_id", header.alias("header"), body.alias("body"))


@query(r"""
SELECT resp_id, CAST(coalesce(TRY_CAST(split_part(regexp_extract(raw, '\A([^\r\n]*)', 1), ' ', 2) AS INTEGER), 0) AS INTEGER) AS status_code FROM responses
""")
def status_code_extract(spark, d):
    return table(spark, d, "responses").select("resp_id", F.coalesce(parse.status_code(F.col("raw")), F.lit(0)).alias("status_code"))


@query(rf"""WITH {PARSED}
SELECT resp_id, coalesce(string_agg(lower(trim(split_part(line, ':', 1))) || ': ' || lower(trim(substr(line, instr(line, ':') + 1))) || chr(10), '' ORDER BY i) FILTER (WHERE instr(line, ':') > 0), '') AS headers
FROM (SELECT resp_id, UNNEST(string_split_regex(raw_header, '\r?\n')) AS line, UNNEST(range(len(string_split_regex(raw_header, '\r?\n')))) AS i FROM parsed WHERE raw_header IS NOT NULL) GROUP BY resp_id
""")
def header_normalize(spark, d):
    header, _ = parse.after_split(F.col("raw"))
    return table(spark, d, "responses").select("resp_id", parse.normalized_header(header).alias("headers")).where("headers is not null")


@query(rf"""WITH {PARSED}, lines AS (SELECT resp_id, UNNEST(string_split_regex(raw_header, '\r?\n')) AS line FROM parsed WHERE raw_header IS NOT NULL)
SELECT resp_id, lower(trim(substr(line, instr(line, ':') + 1))) AS server FROM lines WHERE lower(trim(split_part(line, ':', 1))) = 'server'
""")
def header_map_lookup(spark, d):
    header, _ = parse.after_split(F.col("raw"))
    m = table(spark, d, "responses").select("resp_id", parse.header_map(header).alias("m"))
    return m.select("resp_id", F.try_element_at("m", F.lit("server")).alias("server")).where("server is not null")


@query(rf"""WITH {PARSED}, lines AS (SELECT resp_id, UNNEST(string_split_regex(raw_header, '\r?\n')) AS line FROM parsed WHERE raw_header IS NOT NULL),
v AS (SELECT resp_id, UNNEST(string_split(lower(trim(substr(line, instr(line, ':') + 1))), ' ')) AS piece FROM lines WHERE lower(trim(split_part(line, ':', 1))) = 'set-cookie'),
p AS (SELECT resp_id, trim(UNNEST(CASE WHEN contains(piece, ',') THEN string_split(piece, ',') ELSE string_split(piece, ';') END)) AS x FROM v)
SELECT resp_id, split_part(x, '=', 1) AS name, substr(x, instr(x, '=') + 1) AS value FROM p WHERE instr(x, '=') > 0
""")
def cookie_split(spark, d):
    header, _ = parse.after_split(F.col("raw"))
    m = table(spark, d, "responses").select("resp_id", F.try_element_at(parse.header_map(header), F.lit("set-cookie")).alias("c"))
    return m.where("c is not null").select("resp_id", F.explode(parse.cookie_map(F.col("c"))).alias("name", "value"))


@query(rf"""WITH {PARSED} SELECT resp_id, trim(list_extract(t, -1)) AS title FROM (SELECT resp_id, regexp_extract_all(raw_body, '(?is)<title[^>]*>([^<]+)', 1) AS t FROM parsed) WHERE len(t) > 0""")
def title_extract(spark, d):
    _, body = parse.after_split(F.col("raw"))
    return table(spark, d, "responses").select("resp_id", parse.title(body).alias("title")).where("title is not null")


@query("""
SELECT resp_id, CASE WHEN regexp_full_match(n, '[0-9]{1,5}') THEN CAST(n AS INTEGER) END AS port, proto
FROM (SELECT resp_id, CASE WHEN lower(port[1:2]) = 'u:' THEN port[3:] ELSE port END AS n, CASE WHEN lower(port[1:2]) = 'u:' THEN 'udp' ELSE 'tcp' END AS proto FROM responses)
""")
def port_parse(spark, d):
    return table(spark, d, "responses").select("resp_id", parse.port_struct(F.col("port")).alias("p")).select("resp_id", "p.port", "p.proto")


@query("""
WITH p AS (SELECT finger_id, UNNEST(default_port) AS port FROM native_finger)
SELECT DISTINCT finger_id, port FROM (
  SELECT finger_id, CAST(UNNEST(range(CAST(split_part(port, '-', 1) AS INTEGER), CAST(split_part(port, '-', 2) AS INTEGER) + 1)) AS VARCHAR) AS port FROM p WHERE regexp_full_match(port, '[0-9]{1,5}-[0-9]{1,5}')
  UNION ALL SELECT finger_id, port FROM p WHERE NOT regexp_full_match(port, '[0-9]{1,5}-[0-9]{1,5}'))
""")
def port_expand(spark, d):
    ports = table(spark, d, "native_finger").select("finger_id", F.explode(parse.expand_ports(F.col("default_port"))).alias("port"))
    return ports.where("port is not null").distinct()


@query(f"WITH {PARSED} SELECT resp_id, md5(coalesce(nullif(raw_body, ''), raw)) AS favicon_md5 FROM parsed WHERE raw IS NOT NULL")
def favicon_body_md5(spark, d):
    _, body = parse.after_split(F.col("raw"))
    whole = F.coalesce(F.when(body != "", body), F.col("raw"))
    return table(spark, d, "responses").where("raw is not null").select("resp_id", F.md5(whole).alias("favicon_md5"))


@query("SELECT resp_id, UNNEST(string_split(cert, ',')) AS dns_name FROM responses WHERE cert IS NOT NULL")
def cert_names(spark, d):
    return table(spark, d, "responses").where("cert is not null").select("resp_id", F.explode(F.split("cert", ",")).alias("dns_name"))


@query()
def html_tags(spark, d):
    """Script sources and meta tags of the bodies."""
    p = parse.parsed(table(spark, d, "responses")).select("resp_id", parse.tags(F.col("body")).alias("t"))
    return p.select("resp_id", F.array_join("t.scripts", " ").alias("scripts"), F.size("t.metas").alias("metas"))


@query("""
SELECT finger_id, CAST(count(*) AS BIGINT) AS rules, CAST(count(*) FILTER (WHERE coalesce(r.send_data, '') <> '') AS BIGINT) AS active_rules,
       CAST(max(greatest(coalesce(r.level, 0), CASE WHEN coalesce(r.send_data, '') <> '' THEN 1 ELSE 0 END)) AS INTEGER) AS level
FROM (SELECT finger_id, UNNEST(rule) AS r FROM native_finger) WHERE r IS NOT NULL GROUP BY finger_id
""")
def compile_defaults(spark, d):
    own = F.coalesce("r.send_data", F.lit("")) != ""
    level = F.greatest(F.coalesce("r.level", F.lit(0)), F.when(own, 1).otherwise(0))
    return native.rules(table(spark, d, "native_finger")).groupBy("finger_id").agg(F.count("*").alias("rules"), F.count_if(own).alias("active_rules"), F.max(level).alias("level"))
