"""End-to-end detection, the index on large pages, patterns that do not compile, template catalogues and service scans."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from lanthorn.functions import expr
from lanthorn.operators import alias, detect, keywords, native, scan, templates, web
from lanthorn.plans import detect_queries, native_queries
from lanthorn.session import table
from lanthorn.sources import catalogs

OK = "HTTP/1.1 200 OK\r\nServer: nginx/1.18\r\nContent-Type: text/html\r\n\r\n"


def responses(spark, *raws):
    return spark.createDataFrame([(i, None, None, None, r, None) for i, r in enumerate(raws)], "resp_id bigint, url string, host string, port string, raw string, cert string")


def native_rows(spark, data, rows):
    """Entries (id, name, {kind: patterns}) of one rule each."""
    schema = table(spark, data, "native_finger").select("finger_id", "name", "vendor", "product", "protocol", "tags", "focus", "send_data", "rule").schema
    full = []
    for i, name, kinds in rows:
        regexps = {k: kinds.get(k) for k in ("body", "header", "regexp", "version", "cert", "md5", "mmh3", "vuln")}
        rule = {"version": None, "vuln": None, "info": None, "level": None, "send_data": kinds.get("send"), "favicon": None, "regexps": regexps}
        full.append((i, name, None, None, "http", None, False, None, [rule]))
    return spark.createDataFrame(full, schema)


def test_patterns_that_do_not_compile_are_left_out(spark, data):
    r = responses(spark, OK + "hello world 7", None, "no separator")
    f = native_rows(spark, data, [(1, "good", {"regexp": [r"hello (world)"]}), (2, "bad", {"regexp": ["(?P<n>hello)", "hello("]}), (3, "mixed", {"regexp": ["wor[", r"world (\d)"]}), (4, "bare", {"vuln": [r"\d{3}\s[a-z]+"]}), (5, "both", {"vuln": [r"(\d)\s\1", r"[0-9]\.[0-9]"]})])
    got = {(x.finger_id, x.captured) for x in native.rule_hits(r, f).collect()}
    assert got == {(1, "world"), (3, "7"), (4, ""), (5, "")}
    assert sorted((x.finger_id, x.pattern) for x in native.refused_patterns(f).collect()) == [(2, "(?P<n>hello)"), (2, "hello("), (3, "wor[")]
    e = spark.createDataFrame([(1, "a", "regular", "body", ["world", "("]), (2, "b", "regular", "body", ["w.rld"])], "ehole_id bigint, cms string, method string, location string, keyword array<string>")
    assert [x.ehole_id for x in web.ehole_hits(r, e).collect()] == [2]
    cols = "app_id bigint, app string, cookies map<string,string>, headers map<string,string>, html array<string>, scriptsrc array<string>, meta map<string,array<string>>, implies array<string>, cpe string"
    a = spark.createDataFrame([(1, "A", None, {"Server": r"nginx(?:/([\d.]+))?\;version:\1"}, ["wor(ld", "hello \\w+"], None, None, ["B"], "cpe:/a:v:p")], cols)
    found = {(x.part, x.idx, x.version) for x in web.app_hits(r, a).collect()}
    assert found == {("headers", 0, "1.18"), ("html", 1, "")}
    plain = responses(spark, OK.replace("text/html", "text/plain") + "hello world")
    assert {x.part for x in web.app_hits(plain, a, html_only=True).collect()} == {"headers"}
    m = spark.createDataFrame([("p", 1, False, "x", "(?P<n>h)", None), ("p", 2, False, "y", "hello", None)], "probe string, idx int, soft boolean, service string, pattern string, version string")
    b = spark.createDataFrame([("t", "p", "hello")], "target string, probe string, data string")
    assert [x.service for x in scan.identify(b, m).collect()] == ["y"]


def test_large_pages_travel_once(spark):
    words = [f"literal{i:03d}" for i in range(50)]
    page = "".join(w + "x" * 5000 for w in words)
    texts = spark.createDataFrame([(i, page + str(i)) for i in range(40)], "id int, text string")
    rows = keywords.scan(texts, words).select("id", F.length("text").alias("n"), F.size("found").alias("k")).collect()
    assert len(rows) == 40 and all(r.k == 50 and r.n > 250_000 for r in rows)
    hits = keywords.keyword_hits(texts, spark.createDataFrame([(w,) for w in words], "pattern string"))
    assert hits.columns == ["id", "pattern"] and hits.count() == 2000


def test_detector(spark, data):
    r = responses(spark, OK + "alpha beta", OK + "beta", OK + "gamma", None)
    f = native_rows(spark, data, [(1, "Alpha One", {"body": ["alpha"]}), (2, "Beta", {"body": ["beta"]})])
    e = spark.createDataFrame([(1, "alpha-one", "keyword", "body", ["alpha"]), (2, "Gamma", "keyword", "body", ["gamma"])], "ehole_id bigint, cms string, method string, location string, keyword array<string>")
    aliases = spark.createDataFrame([(1, "Alpha", "v", "p", None, {"ehole": ["Alpha One"], "native": ["alpha_one"]}), (2, "Gamma", None, None, ["ehole"], {"ehole": ["gamma"]})], "alias_id bigint, name string, vendor string, product string, block array<string>, alias map<string,array<string>>")
    d = detect.Detector(aliases).register("native", detect.native_engine(f)).register("ehole", detect.keyword_engine(e)).register("favicon", detect.icon_engine(web.icon_table(f, e)), enabled=False)
    rows = lambda df: sorted((x.resp_id, x.framework, x.froms) for x in df.collect())
    assert rows(d.detect(r)) == [(0, "alpha", "ehole,native"), (0, "beta", "native"), (1, "beta", "native")]
    assert rows(d.disable("ehole").detect(r)) == [(0, "alpha", "native"), (0, "beta", "native"), (1, "beta", "native")]
    assert rows(d.detect(r, ["ehole"])) == [(0, "alpha", "ehole")]  # named engines run whether enabled or not
    assert d.disable("native").detect(r).count() == 0 and d.enable("native").hits(r).count() == 3
    with pytest.raises(KeyError):
        d.enable("none")
    seen = spark.sparkContext.accumulator(0)
    d.each(r, lambda part: seen.add(sum(1 for _ in part)))
    assert seen.value == 3
    plan = spark.createDataFrame([("h", "/a"), ("h", "/a"), ("h", "/b")], "target string, payload string")
    assert d.answered(plan, lambda p: responses(spark, *[OK + "beta"] * p.count())).count() == 2
    assert d.detect(r.limit(0)).count() == 0


def test_logic_hits_without_expanding_defaults(spark):
    g = spark.createDataFrame(
        [(1, "and", "a&&b", [("a", "Alpha", True), ("b", "beta", True)]), (2, "not", "a", [("a", "alpha", False)]), (3, "broken", "a&&(", [("a", "x", True)]), (4, "none", "a", None), (5, "or", "a||b", [("a", "zeta", True), ("b", "beta", False)])],
        "goby_id bigint, name string, logic string, rule array<struct<label:string,feature:string,is_equal:boolean>>",
    )
    r = responses(spark, OK + "alpha beta", OK + "alpha", OK + "gamma", None, OK + "zeta beta")
    assert sorted((x.resp_id, x.name) for x in web.goby_hits(r, g).collect()) == [(0, "and"), (4, "or")]
    assert sorted(x.goby_id for x in web.goby_defaults(g).collect()) == [2, 5]
    assert {x.name: x.responses for x in web.goby_counts(r, g).collect()} == {"and": 1, "not": 2, "or": 3}


def test_detect_all_over_the_tables(spark, data):
    assert {"resp_id", "framework", "version", "vendor", "product", "froms", "tags", "focus"} == set(detect_queries.detect_all(spark, data).columns)


TEMPLATES = [
    {"id": "w", "http": [{"matchers": [{"type": "word", "words": ["Alpha", "be"]}]}]},
    {"id": "and", "info": {"name": "And", "metadata": {"vendor": "v", "product": 3}}, "requests": [{"matchers-condition": " AND ", "matchers": [{"type": "status", "status": [200]}, {"type": "word", "words": "gamma", "part": "body"}]}]},
    {"id": "or", "http": [{"matchers": [{"type": "status", "status": 404}, {"type": "regex", "regex": ["delta[0-9]+"]}]}]},
    {"id": "neg", "http": [{"matchers": [{"type": "word", "words": ["alpha"], "negative": True}]}]},
    {"id": "dsl", "http": json.dumps([{"matchers": [{"type": "dsl", "dsl": ['status_code == 200 && contains(body, "alpha") && !contains(body, "beta")']}]}])},
    {"id": "icon", "http": [{"matchers": [{"type": "favicon", "hash": ["d41d8cd98f00b204e9800998ecf8427e"]}]}]},
    {"id": "size", "http": [{"matchers": [{"type": "size", "size": [len(OK) + 5]}]}]},
    {"id": "bin", "http": [{"matchers": [{"type": "binary", "binary": ["67616d"]}]}]},
    {"id": "none", "http": [{"matchers": []}]},
    {"id": "bad", "http": [{"matchers": [{"type": "regex", "regex": ["a("]}]}]},
    {"name": "no id"},
]


def test_template_catalogue(spark):
    rows = spark.createDataFrame([(json.dumps(t),) for t in TEMPLATES] + [(None,), ("{",), ("[1]",)], "payload string")
    found, refused = templates.catalogue(rows)
    assert [t["id"] for t in found] == ["w", "and", "or", "neg", "dsl", "icon", "size", "bin", "none"] and len(refused) == 5
    r = responses(spark, OK + "alpha", OK + "beta gamma", OK, OK.replace("200", "404") + "delta7", OK + "hello", None, "no separator")
    pairs = lambda df: sorted((x.resp_id, x.template_id) for x in df.collect())
    got = pairs(templates.match_catalogue(r, found))
    want = {0: ["dsl", "size", "w"], 1: ["and", "bin", "neg", "w"], 2: ["icon", "neg"], 3: ["neg", "or"], 4: ["neg", "size"]}
    assert got == sorted((i, t) for i, ts in want.items() for t in ts)
    assert got == pairs(templates.match_catalogue(r, found, index=False)) == pairs(templates.match(r, found).distinct()) == pairs(templates.match_catalogue(r, found, block_bytes=200))
    named = {x.template_id: (x.name, x.vendor, x.product) for x in templates.frameworks(r, found).collect()}
    assert named["and"] == ("And", "v", None) and named["w"][0] == "w"
    assert templates.match_catalogue(r, []).count() == 0 and templates.match_catalogue(r.limit(0), found).count() == 0


def test_thousands_of_templates_in_one_pass(spark, data):
    many = [templates.read_template(json.dumps({"id": f"t{i}", "http": [{"matchers-condition": "and", "matchers": [{"type": "word", "words": [f"word{i}x"]}, {"type": "status", "status": [200]}]}]}))[0] for i in range(3000)]
    r = responses(spark, *[OK + f"word{i}x and word{i + 1}x" for i in range(0, 3000, 100)])
    assert templates.match_catalogue(r, many).count() == 60


def test_rules_with_methods(spark):
    rules = {"r0": 'response.status == 200 && response.body.bcontains(b"alpha")', "r1": '"v[0-9]+".bmatches(response.body) || response.headers["X-Powered-By"].icontains("php")', "r2": ""}
    rows = [(200, "alpha", "PHP/8"), (200, "beta v2", ""), (404, "alpha v1", ""), (200, "x", None)]
    d = spark.createDataFrame(rows, "status_code int, body string, header_x_powered_by string")
    for top, want in (("r0() || r1()", [True, True, True, False]), ("r0() && !r1()", [False] * 4), ("r2()", [True] * 4), ("", [True] * 4)):
        tree = expr.compose(top, rules)
        assert [r[0] for r in d.select(F.coalesce(expr.to_column(tree, F.col), F.lit(False))).collect()] == want
        assert [bool(expr.evaluate(tree, dict(zip(d.columns, r)).get)) for r in rows] == want
    with pytest.raises(ValueError):
        expr.compose("r9()", rules)
    assert expr.from_methods("response.body_string.contains('a.contains(b)')") == "contains(body, 'a.contains(b)')"
    assert expr.triggers(expr.parse('contains(body, "Alpha") && status == 1 || contains(body, "beta")'), lambda p: None) == {"alpha", "beta"}
    assert expr.triggers(expr.parse('contains(body, "Alpha") || status == 1'), lambda p: None) is None


def test_service_scan(spark):
    text = "Probe TCP NULL q||\nsoftmatch ftp m|^220 |\nmatch ssh m|^SSH-([\\d.]+)-OpenSSH_(\\S+)| v/$2/\nProbe TCP GetRequest q|GET /|\nports 80\nrarity 1\nfallback Generic\nmatch ssl m|^tls|\nProbe TCP Generic q|x|\nrarity 3\nfallback Deep\nProbe TCP Deep q|y|\nrarity 3\nmatch deep m|^deep (\\d)| v/$1/\n"
    probes, found = catalogs.parse_probes(text)
    p = spark.createDataFrame([(i, x["name"], x["rarity"], x["ports"], x["ssl_ports"], x["fallback"], x["probe"].decode("latin-1")) for i, x in enumerate(probes)], "seq int, name string, rarity int, ports array<int>, ssl_ports array<int>, fallback string, payload string")
    m = catalogs.match_table(spark, found).unionByName(scan.custom_matches(spark))
    assert scan.custom_matches(spark).count() == 31
    answers = [
        ("t1", 22, "NULL", False, None, b"SSH-2.0-OpenSSH_8.9"), ("t2", 21, "NULL", False, None, b"220 hi FileZilla"), ("t3", 80, "GetRequest", True, None, b"HTTP/1.1 200 OK\r\nServer: a\r\n\r\n"), ("t4", 135, "NULL", False, None, b"\x05\x00\x0d\x03\x10"),
        ("t5", 9, "NULL", False, "connection refused", None), ("t6", 80, "GetRequest", False, None, b"deep 7"), ("t7", 0, "NULL", False, None, b"SSH-2.0-OpenSSH_8.9"), ("t8", 7, "NULL", False, None, b"\xff\xfe?"),
    ]
    a = spark.createDataFrame(answers, "target string, port int, probe string, tls boolean, error string, data binary")
    got = {r.target: (r.status, r.service, r.version) for r in scan.run(a, p, m).collect()}
    assert got == {
        "t1": ("Matched", "ssh", "8.9"), "t2": ("Matched", "ftp", None), "t3": ("Matched", "https", None), "t4": ("Matched", "rpc", None), "t5": ("Closed", None, None), "t6": ("Matched", "deep", "7"), "t7": ("NotMatched", None, None),
        "t8": ("NotMatched", None, None),
    }
    assert {r.target: r.status for r in scan.run(a.where("target = 't6'"), p, m.where("probe != 'Deep'")).collect()} == {"t6": "NotMatched"}
    b = a.select("target", "probe", scan.as_text(F.col("data")).alias("data"))
    assert [r.target for r in scan.identify(b, m, p, as_coded=True).where("service = 'deep'").collect()] == []  # the first step only
    assert scan.run(a.limit(0), p, m).count() == 0
    told = detect.Detector().register("probes", detect.probe_engine(p, m)).detect(a.withColumnRenamed("target", "resp_id"))
    assert {(r.resp_id, r.framework) for r in told.collect()} == {("t1", "ssh"), ("t2", "ftp"), ("t3", "https"), ("t4", "rpc"), ("t6", "deep")}


def test_scan_helpers(spark):
    s = spark.createDataFrame([("http", 80, "tcp", 0.5), ("www", 80, "tcp", 0.1), ("dns", 53, "udp", 0.9)], "name string, port int, protocol string, probability double")
    r = spark.createDataFrame([("a", 80, "Open", None), ("b", 80, "Closed", None), ("c", 53, "Open", None)], "target string, port int, status string, service string")
    assert {x.target: (x.service, x.tag) for x in scan.guess(r, s, enabled=True).collect()} == {"a": ("http", "guess"), "b": (None, None), "c": (None, None)}
    assert {x.service for x in scan.guess(r, s).collect()} == {None}
    hosts = spark.createDataFrame([("h1",), ("h2",)], "host string")
    assert sorted(map(tuple, scan.plan(hosts, ["80", "8000-8001", "80"]).collect())) == [(h, p) for h in ("h1", "h2") for p in ("80", "8000", "8001")]
    f = spark.createDataFrame([("t", "b", 1), ("t", "a", 0), ("u", "c", 5)], "target string, name string, place int")
    assert sorted((x.target, x.name) for x in scan.first_framework(f).collect()) == [("t", "a"), ("u", "c")]
    one = spark.range(1).select(scan.with_host(F.lit("Host: {Host}"), F.lit("h1")).alias("a"), scan.decoded(F.lit(r"\x01a\n")).alias("b")).first()
    assert one.a == "Host: h1" and bytes(one.b) == b"\x01a\n"


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"cms": "a", "keyword": ["x"]}]))
    with gzip.open(tmp_path / "e.yaml.gz", "wt") as f:
        f.write("- {cms: b, keyword: [y]}\n")
    assert [r.cms for r in catalogs.read_catalogue(spark, "ehole", str(tmp_path / "e.json")).collect()] == ["a"]
    assert [r.cms for r in catalogs.read_catalogue(spark, "ehole", str(tmp_path / "e.json"), override=str(tmp_path / "e.yaml.gz")).collect()] == ["b"]
    (tmp_path / "apps.json").write_text(json.dumps({"apps": {"X": {"scriptSrc": "x.js", "Headers": {"Server": "x"}, "js": {"b.c": "", "a": ""}, "implies": ["q", "p"], "meta": {"Generator": "g"}, "cats": [2, 1]}}}))
    x = catalogs.read_apps(spark, str(tmp_path / "apps.json")).first()
    assert (x.app, x.scriptsrc, x.headers, x.js, x.implies, x.meta, x.cats) == ("X", ["x.js"], {"server": "x"}, ["a", "b.c"], ["p", "q"], {"generator": ["g"]}, [1, 2])
    (tmp_path / "p.json").write_text(json.dumps([{"name": "NULL", "protocol": "TCP", "rarity": 0, "matches": [{"soft": True, "service": "ftp", "pattern": "^220"}, {"service": "ssh", "pattern": "^SSH", "version_info": {"version": "$1"}}]}]))
    m = catalogs.probe_matches(catalogs.read_json(spark, "probes", str(tmp_path / "p.json"))).collect()
    assert [(r.idx, r.soft, r.service, r.version) for r in m] == [(0, True, "ftp", None), (1, False, "ssh", "$1")]
    (tmp_path / "y").mkdir()
    (tmp_path / "y/a.yaml").write_text("id: a\n")
    (tmp_path / "y/b.yml").write_text("a: [\n")
    rep = {r.path.rsplit("/", 1)[1]: (r.loaded, r.shown) for r in catalogs.merge_yaml(spark, str(tmp_path / "y"), str(tmp_path / "out.json.gz")).collect()}
    assert rep == {"a.yaml": (1, False), "b.yml": (0, True)}
    assert json.loads(catalogs.load_bytes(str(tmp_path / "out.json.gz"))) == [{"id": "a", "_source_file": "a.yaml"}]
    assert catalogs.with_flags("^a$", "s") == "^(?is:a)$" and catalogs.with_flags("a", "") == "a"
    catalogs.write_results(spark.range(2), str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res")).count() == 2


def test_active_results(spark, data):
    f = native_rows(spark, data, [(1, "A", {"body": ["x"], "send": "/probe"}), (2, "B", {"body": ["y"]})])
    first = spark.createDataFrame([("t", 1, 0, "/probe")], "target string, finger_id int, rule_idx int, payload string")
    got = native.active_frameworks(first, f).collect()
    assert [(r.name, r.froms, r.detail) for r in got] == [("A", ["active"], {"path": ["/probe"]})]


def test_the_nested_loops_pairs_without_a_nested_loop(spark, data):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcä\U0001f600 ") for _ in range(n))
    pats = spark.createDataFrame([("",), (None,), ("a",), ("ab",), ("abc",), *((make(rng.randint(1, 9)),) for _ in range(400))], "pattern string")
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "abcabcabc"), *((i, make(rng.randint(0, 40))) for i in range(5, 60))], "id long, text string")
    slow = sorted(map(tuple, keywords.brute_hits(texts, pats).collect()))
    assert sorted(map(tuple, keywords.window_hits(texts, pats).collect())) == slow and len(slow) > 200
    plan = native_queries.prefilter_equals_bruteforce(spark, data)
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.collect() == [(0, 0)]


def test_hits_are_merged_in_the_row_of_their_response(spark, data):
    """Rows of the merge of all hits (shared texts, captured versions, aliases, blocks, tags, other engines, repeated ids), none shuffled."""
    schema = table(spark, data, "native_finger").select("finger_id", "name", "vendor", "product", "protocol", "tags", "focus", "send_data", "rule").schema

    def entry(i, name, rules, vendor=None, tags=None, focus=False):
        full = [None if r is None else {"version": v, "vuln": None, "info": None, "level": None, "send_data": None, "favicon": None, "regexps": {k: r.get(k) for k in ("body", "header", "regexp", "version", "cert", "md5", "mmh3", "vuln")}} for v, r in rules]
        return (i, name, vendor, vendor, "http", tags, focus, None, full)

    rows = [entry(i, f"Common {i % 7}", [("_", {"header": ["nope"]}), (f"{i % 5}.0" if i % 2 else "_", {"body": ["Shared", "page"], "cert": ["ca"]})], f"v{i % 3}" if i % 4 else None, [f"t{i % 6}", None, "a"] if i % 3 else None, i == 9) for i in range(1, 60)]
    rows += [
        entry(70, "Nginx", [("9", {"regexp": [r"nginx/([\d.]+)"], "header": ["nginx"]})], "f5", ["web"]), entry(71, "nginx ", [("", {"regexp": [r"(\d\.\d+)"], "vuln": ["[a-z]/1"]})]),
        entry(72, "Common 1", [(None, None), ("7", {"regexp": [r"nginx/([\d.]+)"]})]), entry(73, None, [("1", {"body": ["page"]})]), entry(74, "Gone", [("1", {"body": ["page"]})]),
        entry(75, "Empty", [("1", {"body": [""], "md5": ["900150983cd24fb0d6963f7d28e17f72"]})]), entry(75, "Twice", [("3", {"header": ["x-none"]})]), entry(76, "Broken", [("1", {"regexp": ["(nginx"], "mmh3": ["1"]})]),
    ]
    entries = spark.createDataFrame(rows, schema)
    alias_rows = [(1, "Web Server", "aliased", None, {"native": ["NGINX", "common-3"], "other": ["thing"]}, None), (2, "Gone", None, None, {"native": ["gone"]}, [" Native "])]
    aliases = spark.createDataFrame(alias_rows, "alias_id bigint, name string, vendor string, product string, alias map<string,array<string>>, block array<string>")
    rs = responses(spark, OK + "a shared page", OK + "shared nginx/2.5", OK + "abc", "no separator, shared page", None, "", OK + "thing").withColumn("cert", F.when(F.col("resp_id") == 6, "CN=ca"))
    rs = rs.unionByName(rs.where("resp_id = 0").withColumn("raw", F.lit(OK + "second page"))).unionByName(rs.where("resp_id = 2").withColumn("resp_id", F.lit(None).cast("bigint")))
    other = lambda responses: responses.where("raw like '%nginx%'").select("resp_id", F.explode(F.array(F.lit("thing"), F.lit("COMMON 1"), F.lit("New"))).alias("name"), F.lit("0.1").alias("version"), F.array(F.lit("b"), F.lit(None)).alias("tags"), F.lit(True).alias("focus"))
    for names in (["other", "native"], ["native", "other"], ["native"], ["other"]):
        for known in (aliases, None):
            d = detect.Detector(known)
            for n in names:
                d.register(n, detect.native_engine(entries) if n == "native" else other)
            hits = d.hits(rs)
            every = alias.merge(alias.resolve(hits, alias.alias_map(known)) if known is not None else hits.withColumn("blocked", F.lit(False)), names)
            got = d.detect(rs)
            assert got.dtypes == every.dtypes
            assert sorted(map(str, got.collect())) == sorted(map(str, every.collect()))
    assert len(every.collect()) == 12 and got.where("resp_id is null").count() == 0
    plan = detect_queries.detect_all(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < min(plan.index("Exchange"), plan.index("Aggregate"))


def test_template_blocks_need_no_distinct(spark):
    """Responses that match thousands of templates, in batches smaller than one read: no pair lost, none twice, and blocks need no distinct."""
    made = [templates.read_template(json.dumps({"id": f"t{i % 2500:05}", "http": [{"matchers": [{"type": "status", "status": [200]} if i % 2 else {"type": "word", "words": ["shared"]}]}]}))[0] for i in range(5000)]
    rs = responses(spark, *[OK + ("shared" if i % 2 else "other") for i in range(300)], "HTTP/1.1 404 no\r\n\r\nshared")
    got = templates.match_catalogue(rs.coalesce(1), made, block_bytes=100_000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("MapInArrow") > 1
    assert got.count() == got.distinct().count() == 150 * 2500 + 150 * 1250 + 1250
