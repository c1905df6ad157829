"""Queries p2, p3 and p6: nested records, rows that fail to parse, schemas that drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanthorn.operators import drift, rejects, shred
from lanthorn.session import table

#: http counts before requests; a template holds one of them
PREFER = [("http", "requests")]
REQUESTS = [".http", ".requests"]
NESTED = {
    "metadata": ([".info.metadata.*"], {}),
    "request": (REQUESTS, {"condition": "matchers-condition"}),
    "matcher": ([f"{p}.matchers" for p in REQUESTS], {"type": "type", "part": "part", "condition": "condition"}),
    "match": ([".matches"], {"service": "service", "pattern": "pattern", "soft": "soft"}),
    "cpe": ([".matches.version_info.cpes"], {}),
}


def nested_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.shred(table(spark, sf_dir, "nested_record"), ["kind", "rec_id"], "payload", PREFER)


def rule_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacency rows of native_finger.rule, which is structured already: it goes through the same shredder as JSON."""
    entries = table(spark, sf_dir, "native_finger")
    rows = entries.select(
        F.lit("native").alias("kind"),
        F.col("finger_id").cast("bigint").alias("rec_id"),
        F.when(F.col("rule").isNotNull(), F.to_json(F.struct("rule"))).otherwise("{}").alias("payload"),
    )
    return shred.shred(rows, ["kind", "rec_id"], "payload")


def nested_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ent = shred.entities(nested_nodes(spark, sf_dir), ["kind", "rec_id"], NESTED)
    of_kind = F.when(F.col("kind") == "template", F.col("entity").isin("metadata", "request", "matcher"))
    return ent.where(of_kind.when(F.col("kind") == "probe", F.col("entity").isin("match", "cpe")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    anc, e = F.col("anc"), F.col("entity")
    ent = nested_entities(spark, sf_dir)
    nested = ent.select(
        e.alias("kind"),
        "rec_id",
        F.when(e == "matcher", anc[0]).when(e == "cpe", anc[0]).otherwise(-1).alias("parent_pos"),
        F.when(e == "metadata", -1).when(e == "matcher", anc[1]).when(e == "cpe", F.element_at(anc, -1)).otherwise(anc[0]).alias("pos"),
        F.when(e == "metadata", F.col("label")).when(e == "matcher", F.coalesce("type", F.lit("")))
        .when(e == "match", F.coalesce("service", F.lit(""))).when(e == "cpe", F.coalesce("scalar", F.lit(""))).otherwise("").alias("name"),
    )
    rules = shred.entities(rule_nodes(spark, sf_dir), ["kind", "rec_id"], {"rule": ([".rule"], {})})
    rule = rules.select(e.alias("kind"), "rec_id", F.lit(-1).alias("parent_pos"), anc[0].alias("pos"), F.lit("").alias("name"))
    return nested.unionByName(rule).distinct()


def p2_matchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matcher table: one row per matcher with its request's position and its scalar fields."""
    ent = nested_entities(spark, sf_dir).where("entity = 'matcher'")
    return ent.select("rec_id", F.col("anc")[0].alias("request_pos"), F.col("anc")[1].alias("pos"), "type", "part", "condition")


def p2_matcher_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of matchers (words, expressions, codes, hashes) as a table below the matcher table."""
    found = shred.items(nested_nodes(spark, sf_dir).where("kind = 'template'"), ["rec_id"], {"matcher": [f"{p}.matchers" for p in REQUESTS]})
    return found.select("rec_id", F.col("anc")[0].alias("request_pos"), F.col("anc")[1].alias("matcher_pos"), "field", "pos", "value")


def p2_rule_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of a rule (its expressions and icon hashes) as a table below the rule table."""
    found = shred.items(rule_nodes(spark, sf_dir), ["rec_id"], {"rule": [".rule"]})
    found = found.where(F.col("field").contains("."))
    return found.select(F.col("rec_id").alias("finger_id"), F.col("anc")[0].alias("rule_pos"), "field", "pos", "value")


def p2_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads without a table: (rec_id, reason)."""
    bad = nested_nodes(spark, sf_dir).where("type = 'bad'")
    return bad.select("rec_id", F.col("scalar").alias("reason"))


def p2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule table of native_finger with scalar fields."""
    spec = {"rule": ([".rule"], {"version": "version", "vuln": "vuln", "info": "info", "level": "level", "send_data": "send_data"})}
    ent = shred.entities(rule_nodes(spark, sf_dir), ["kind", "rec_id"], spec)
    return ent.select(
        F.col("rec_id").alias("finger_id"), F.col("anc")[0].alias("pos"), "version", "vuln", "info", F.col("level").cast("int").alias("level"), "send_data"
    )


def p3_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a typed row or refused row."""
    return rejects.parse_lines(table(spark, sf_dir, "raw_line").select("line_id", "file_name", "line_no", "line_text"))


def p3_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines refused for their quoting or number of columns, which plain SQL can tell as well."""
    lines = rejects.parse_lines(table(spark, sf_dir, "raw_line").select("line_id", "line_text"))
    return lines.where("reason in ('quoting', 'columns')").select("line_id", "reason")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rejects.parse_lines(table(spark, sf_dir, "raw_line").select("line_id", "line_text"))
    return lines.where("reason is not null").select("line_id", "reason").distinct()


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per file and outcome."""
    lines = rejects.parse_lines(table(spark, sf_dir, "raw_line").select("file_name", "line_text"))
    return lines.groupBy("file_name", F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("lines"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "drift_record"))


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of every feed, down to four steps: the files that have it, the first and last of them, and its types."""
    values = drift.path_values(table(spark, sf_dir, "drift_record"), depth=4)
    once = values.groupBy("feed", "field", "type", "file_seq").agg(F.count("*").alias("n"))
    return once.groupBy("feed", F.col("field").alias("path")).agg(
        F.count_distinct("file_seq").alias("files"), F.min("file_seq").alias("first"), F.max("file_seq").alias("last"),
        F.sum("n").alias("n_values"), F.array_join(F.sort_array(F.collect_set("type")), "|").alias("types"),
    )


def p6_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes below the top level: paths of two to four steps that came, went or changed their types."""
    found = drift.changes(table(spark, sf_dir, "drift_record"), depth=4)
    return found.where(F.col("field").contains(".") | F.col("field").contains("[]"))


WAPP = {"app": "text", "html": "list", "implies": "list", "cats": "list", "website": "text", "cpe": "text", "description": "text"}
TEMPLATE = {"id": "text", "name": "text", "author": "list", "severity": "text", "tags": "list", "metadata": "text", "max_request": "number"}


def p6_wapp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steady table of the wapp feeds."""
    rows = table(spark, sf_dir, "drift_record").where("feed like 'wapp%'")
    return drift.steady_table(rows, WAPP, names=("app",))


def p6_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steady table of the template feeds."""
    rows = table(spark, sf_dir, "drift_record").where("feed like 'template%'")
    return drift.steady_table(rows, TEMPLATE, names=("id",))


def p6_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a place in a steady table: (rec_id, reason)."""
    return drift.refused(table(spark, sf_dir, "drift_record"), "rec_id", {"wapp": "app", "template": "id"})


QUERIES = {
    "p2_found": p2_found,
    "p2_matchers": p2_matchers,
    "p2_matcher_values": p2_matcher_values,
    "p2_rule_values": p2_rule_values,
    "p2_refused": p2_refused,
    "p2_rules": p2_rules,
    "p3_found": p3_found,
    "p3_shape": p3_shape,
    "p3_parsed": p3_parsed,
    "p3_reasons": p3_reasons,
    "p6_found": p6_found,
    "p6_paths": p6_paths,
    "p6_nested": p6_nested,
    "p6_wapp": p6_wapp,
    "p6_template": p6_template,
    "p6_refused": p6_refused,
}

RULE_LISTS = [f"regexps.{k}" for k in ("body", "header", "regexp", "version", "cert", "md5", "mmh3", "vuln")] + ["favicon.mmh3", "favicon.md5"]
FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'


def _u(e: str, deep: int = 3) -> str:
    """SQL: the JSON that a JSON text holds, however often it is wrapped."""
    for _ in range(deep):
        e = (
            f"list_transform([{e}], lambda x: CASE WHEN json_type(x) = 'VARCHAR' AND (left(trim(x->>'$'), 1) IN ('{{', '[', '\"') OR trim(x->>'$') = 'null') AND json_valid(x->>'$') THEN CAST(x->>'$' AS JSON) ELSE x END)[1]"
        )
    return e


def _l(e: str) -> str:
    """SQL: the elements of a list, of a lone value one, of null none."""
    return f"list_transform([{_u(e)}], lambda y: CASE coalesce(json_type(y), 'NULL') WHEN 'ARRAY' THEN CAST(y AS JSON[]) WHEN 'NULL' THEN [] ELSE [y] END)[1]"


def _each(source: str, keep: str, expr: str, name: str) -> str:
    """SQL: (keep, pos, v) of the elements of a list expression over a table that are not null."""
    return (
        f"{name} AS (SELECT {keep}, CAST(i - 1 AS INTEGER) AS pos, {_u('l[i]')} AS v FROM (SELECT *, UNNEST(range(1, len(l) + 1)) AS i FROM (SELECT *, {expr} AS l FROM {source})) "
        f"WHERE coalesce(json_type({_u('l[i]')}), 'NULL') <> 'NULL')"
    )


P2 = f"""o AS (SELECT kind AS k, rec_id, {_u('CAST(payload AS JSON)')} AS j FROM nested_record WHERE payload IS NOT NULL AND json_valid(payload)),
root AS (SELECT * FROM o WHERE json_type(j) = 'OBJECT'),
t AS (SELECT rec_id, {_u("json_extract(j, '$.info')")} AS info, CASE WHEN coalesce(json_type({_u("json_extract(j, '$.http')")}), 'NULL') <> 'NULL' THEN json_extract(j, '$.http') ELSE json_extract(j, '$.requests') END AS r FROM root WHERE k = 'template'),
meta AS (SELECT rec_id, m, UNNEST(json_keys(m)) AS name FROM (SELECT rec_id, {_u("json_extract(info, '$.metadata')")} AS m FROM t WHERE json_type(info) = 'OBJECT') WHERE json_type(m) = 'OBJECT'),
{_each('t', 'rec_id', _l('r'), 'req')},
{_each("(SELECT rec_id, pos AS parent, v AS q FROM req WHERE json_type(v) = 'OBJECT')", 'rec_id, parent', _l("json_extract(q, '$.matchers')"), 'mat')},
{_each("(SELECT rec_id, j AS q FROM root WHERE k = 'probe')", 'rec_id', _l("json_extract(q, '$.matches')"), 'mch')},
{_each(f"(SELECT rec_id, parent, vi AS q FROM (SELECT rec_id, pos AS parent, {_u("json_extract(v, '$.version_info')")} AS vi FROM mch WHERE json_type(v) = 'OBJECT') WHERE json_type(vi) = 'OBJECT')", 'rec_id, parent', _l("json_extract(q, '$.cpes')"), 'cpe')}"""
SCALAR = lambda e: f"coalesce(CASE WHEN json_type({e}) IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE {e}->>'$' END, '')"
NULLABLE = lambda e: f"CASE WHEN json_type({e}) IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE {e}->>'$' END"
#: Lines as the statement of p3_found has them; the engine of this SQL judges the expressions.
P3 = rf"""cut AS (SELECT line_id, t, regexp_full_match(t, '{FIELD}(,{FIELD})*', 's') AS ok, list_transform(regexp_extract_all(t || ',', '({FIELD}),', 1, 's'),
    lambda x: CASE WHEN left(x, 1) = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM (SELECT line_id, coalesce(line_text, '') AS t FROM raw_line)),
  part AS (SELECT *, f[1] AS entry, f[2] AS catalog, f[3] AS name, f[4] AS field, f[5] AS value, f[6] AS level, CASE f[4] WHEN 'html' THEN split_part(f[5], '\;', 1) ELSE f[5] END AS expr,
    CASE WHEN f[4] = 'html' AND instr(f[5], '\;') > 0 THEN substr(f[5], instr(f[5], '\;') + 2) ELSE '' END AS options FROM cut),
  judged AS (SELECT line_id, CASE WHEN NOT ok THEN 'quoting' WHEN len(f) <> 6 THEN 'columns'
    WHEN NOT regexp_full_match(entry, '[0-9]+') OR length(ltrim(entry, '0')) > 18 OR (catalog, field) NOT IN (('native', 'regexp'), ('wapp', 'html'), ('ehole', 'keyword')) OR trim(name) = '' OR NOT regexp_full_match(level, '[0-5]') THEN 'value'
    WHEN field = 'keyword' THEN CASE WHEN NOT json_valid(value) OR regexp_matches(value, ',\s*\]\s*$') OR json_type(value) <> 'ARRAY' OR json_array_length(value) = 0 OR len(list_filter(CAST(value AS JSON[]), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'keyword' END
    WHEN TRY(regexp_matches('', expr)) IS NULL THEN 'pattern'
    WHEN len(list_filter(regexp_extract_all(options, '\\([0-9]+)', 1), lambda x: CAST(x AS INTEGER) > len(regexp_extract_all(regexp_replace(replace(expr, '\(', ''), '\[[^\]]*\]', '', 'g'), '\((?:[^?]|\?P?<)', 0)))) > 0 THEN 'pattern' END AS reason FROM part)"""
SQL = {
    "p3_found": f"WITH {P3} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_reasons": f"WITH {P3} SELECT file_name, coalesce(reason, 'valid') AS outcome, CAST(count(*) AS BIGINT) AS lines FROM judged JOIN raw_line USING (line_id) GROUP BY ALL",
    "p6_refused": """SELECT rec_id, reason FROM (SELECT rec_id, CASE WHEN feed IS NULL OR NOT (feed LIKE 'wapp%' OR feed LIKE 'template%') THEN 'feed' WHEN file_seq IS NULL THEN 'file_seq' WHEN payload IS NULL THEN 'null' WHEN NOT json_valid(payload) THEN 'broken'
        WHEN json_type(payload) <> 'OBJECT' THEN 'not an object' WHEN coalesce(json_type(json_extract(payload, CASE WHEN feed LIKE 'wapp%' THEN '$.app' ELSE '$.id' END)), 'NULL') = 'NULL' THEN 'name' END AS reason FROM drift_record) WHERE reason IS NOT NULL""",
    "p2_found": f"""WITH {P2}
        SELECT DISTINCT 'metadata' AS kind, rec_id, -1 AS parent_pos, -1 AS pos, name FROM meta WHERE coalesce(json_type({_u("json_extract(m, '$.\"' || name || '\"')")}), 'NULL') <> 'NULL'
        UNION SELECT 'request', rec_id, -1, pos, '' FROM req
        UNION SELECT 'matcher', rec_id, parent, pos, {SCALAR(_u("json_extract(v, '$.type')"))} FROM mat
        UNION SELECT 'match', rec_id, -1, pos, {SCALAR(_u("json_extract(v, '$.service')"))} FROM mch
        UNION SELECT 'cpe', rec_id, parent, pos, {SCALAR('v')} FROM cpe
        UNION SELECT 'rule', finger_id, -1, CAST(i - 1 AS INTEGER), '' FROM (SELECT finger_id, rule, UNNEST(RANGE(1, LEN(rule) + 1)) AS i FROM native_finger) WHERE rule[i] IS NOT NULL
    """,
    "p2_matchers": f"""WITH {P2}, m AS (SELECT rec_id, parent, pos, v FROM mat WHERE json_type(v) <> 'ARRAY')
        SELECT rec_id, parent AS request_pos, pos, {NULLABLE(_u("json_extract(v, '$.type')"))} AS type, {NULLABLE(_u("json_extract(v, '$.part')"))} AS part, {NULLABLE(_u("json_extract(v, '$.condition')"))} AS condition FROM m
    """,
    "p2_matcher_values": f"""WITH {P2}, f AS (SELECT rec_id, parent, pos, v, UNNEST(json_keys(v)) AS field FROM mat WHERE json_type(v) = 'OBJECT'),
        {_each("(SELECT rec_id, parent, pos AS matcher_pos, field, v AS q FROM f)", 'rec_id, parent, matcher_pos, field', _l("json_extract(q, '$.\"' || field || '\"')"), 'val')}
        SELECT rec_id, parent AS request_pos, matcher_pos, field, pos, v->>'$' AS value FROM val WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY')
    """,
    "p2_refused": f"""SELECT rec_id, CASE WHEN payload IS NULL THEN 'null' WHEN NOT json_valid(payload) THEN 'broken' ELSE 'not an object' END AS reason FROM nested_record
        WHERE payload IS NULL OR NOT json_valid(payload) OR coalesce(json_type({_u("CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END")}), 'NULL') <> 'OBJECT'
    """,
    "p2_rule_values": " UNION ALL ".join(
        f"""SELECT CAST(finger_id AS BIGINT) AS finger_id, rule_pos, '{f}' AS field, CAST(j - 1 AS INTEGER) AS pos, l[j] AS value FROM (SELECT finger_id, CAST(i - 1 AS INTEGER) AS rule_pos, rule[i].{f} AS l, UNNEST(RANGE(1, LEN(rule[i].{f}) + 1)) AS j
        FROM (SELECT finger_id, rule, UNNEST(RANGE(1, LEN(rule) + 1)) AS i FROM native_finger)) WHERE l[j] IS NOT NULL""" for f in RULE_LISTS
    ),
    "p3_shape": f"""SELECT line_id, CASE WHEN NOT ok THEN 'quoting' ELSE 'columns' END AS reason FROM (
        SELECT line_id, regexp_full_match(t, '{FIELD}(,{FIELD})*', 's') AS ok, len(regexp_extract_all(t || ',', '{FIELD},', 0, 's')) AS n FROM (SELECT line_id, coalesce(line_text, '') AS t FROM raw_line))
        WHERE NOT ok OR n <> 6
    """,
    "p2_rules": """
        SELECT CAST(finger_id AS BIGINT) AS finger_id, CAST(i - 1 AS INTEGER) AS pos, r.version AS version, r.vuln AS vuln,
               r.info AS info, CAST(r.level AS INTEGER) AS level, r.send_data AS send_data
        FROM (SELECT finger_id, i, rule[i] AS r FROM (SELECT finger_id, rule, UNNEST(RANGE(1, LEN(rule) + 1)) AS i FROM native_finger))
        WHERE r IS NOT NULL
    """,
    "p6_found": """
        WITH o AS (SELECT feed, file_seq, CAST(payload AS JSON) AS j FROM drift_record WHERE feed IS NOT NULL AND file_seq IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
        e AS (SELECT feed, file_seq, coalesce(j->>'app', j->>'id') AS record, k AS field, json_extract(j, '$."' || k || '"') AS v FROM (SELECT *, UNNEST(json_keys(j)) AS k FROM o)),
        t AS (SELECT feed, file_seq, record, field, CAST(v AS VARCHAR) AS raw, CASE json_type(v) WHEN 'ARRAY' THEN 'array of ' || array_to_string(list_sort(list_distinct(list_transform(
                CAST(v AS JSON[]), lambda x: CASE WHEN json_type(x) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' ELSE json_type(x) END))), ',')
              WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' ELSE json_type(v) END AS type FROM e WHERE json_type(v) <> 'NULL'),
        f AS (SELECT feed, file_seq, field, list_sort(list(DISTINCT type)) AS types FROM t GROUP BY ALL),
        files AS (SELECT DISTINCT feed, file_seq FROM f),
        step AS (SELECT b.feed, b.file_seq FROM files a JOIN files b ON a.feed = b.feed AND a.file_seq = b.file_seq - 1),
        went AS (SELECT s.feed, s.file_seq, f.field FROM step s JOIN f ON f.feed = s.feed AND f.file_seq = s.file_seq - 1 WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.feed = s.feed AND g.file_seq = s.file_seq AND g.field = f.field)),
        came AS (SELECT s.feed, s.file_seq, f.field FROM step s JOIN f ON f.feed = s.feed AND f.file_seq = s.file_seq WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.feed = s.feed AND g.file_seq = s.file_seq - 1 AND g.field = f.field)),
        score AS (SELECT w.feed, w.file_seq, w.field, c.field AS new_field, count(DISTINCT a.record) AS n, count(DISTINCT a.record) FILTER (WHERE a.raw = b.raw) AS same
                  FROM went w JOIN came c USING (feed, file_seq) JOIN t a ON a.feed = w.feed AND a.file_seq = w.file_seq - 1 AND a.field = w.field
                  JOIN t b ON b.feed = w.feed AND b.file_seq = w.file_seq AND b.field = c.field AND b.record = a.record GROUP BY ALL),
        good AS (SELECT *, same / n AS share FROM score WHERE same > 0 AND same >= n * 0.5),
        renamed AS (SELECT * FROM good x WHERE NOT EXISTS (SELECT 1 FROM good y WHERE y.feed = x.feed AND y.file_seq = x.file_seq AND (y.field = x.field OR y.new_field = x.new_field)
                    AND (y.share, y.same, y.field, y.new_field) > (x.share, x.same, x.field, x.new_field)))
        SELECT feed, file_seq, 'renamed' AS change, field, new_field FROM renamed
        UNION ALL SELECT feed, file_seq, 'removed', field, '' FROM went ANTI JOIN renamed USING (feed, file_seq, field)
        UNION ALL SELECT feed, file_seq, 'added', field, '' FROM came c WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed = c.feed AND r.file_seq = c.file_seq AND r.new_field = c.field)
        UNION ALL SELECT b.feed, b.file_seq, 'retyped', b.field, '' FROM f a JOIN f b ON a.feed = b.feed AND a.file_seq = b.file_seq - 1 AND a.field = b.field WHERE a.types <> b.types
    """,
}
