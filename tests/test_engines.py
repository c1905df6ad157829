"""The engines on fixtures: ordered rule choice, all matcher kinds, logic, templates, icons, services, aliases, sources."""

import gzip
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanthorn.functions import expr
from lanthorn.functions.mmh3 import mmh3_batch
from lanthorn.operators import alias, equivalence, keywords, native, parse, service, templates, web
from lanthorn.operators.skew import skew_join
from lanthorn.sources import catalogs
from lanthorn.streaming import matches

R = "resp_id long, url string, host string, port string, raw string, cert string"
CRLF = "\r\n"
NACOS = f"HTTP/1.1 200 OK{CRLF}Server: Tengine/2.3.3{CRLF}X-Powered-By: Nacos-Server/2.1.0{CRLF}{CRLF}<html><title>Nacos</title>Nacos v2.1.0 console-ui/public/js</html>"


def responses(spark, *raws, cert=None):
    return spark.createDataFrame([(i, f"http://h{i}/", f"h{i}", "80", r, cert) for i, r in enumerate(raws, 1)], R)


def finger(fid, name, *rules, **kw):
    full = dict(body=None, header=None, regexp=None, version=None, cert=None, md5=None, mmh3=None, vuln=None)
    rs = [None if r is None else dict(version=r.get("version_text", "_"), vuln=r.get("vuln_name"), info=r.get("info"), level=r.get("level", 0), send_data=r.get("send"), favicon=None, regexps=full | {k: v for k, v in r.items() if k in full}) for r in rules]
    return dict(finger_id=fid, name=name, vendor=kw.get("vendor"), product=None, protocol=kw.get("protocol"), default_port=kw.get("ports"), focus=False, tags=[], level=0, opsec=False, send_data=kw.get("send"), link=None, rule=rs)


def entries(spark, data, *rows):
    schema = spark.read.parquet(f"{data}/native_finger.parquet").drop("loaded_at").schema
    return spark.createDataFrame(list(rows), schema)


def test_rule_order_versions_and_vulns(spark, data):
    raw = f"HTTP/1.1 200 OK{CRLF}Server: Nginx/1.18.0{CRLF}{CRLF}<html>Welcome to NGINX! ver=3.2</html>"
    body = raw.lower().split(CRLF * 2, 1)[1]
    import hashlib

    f = entries(
        spark, data,
        finger(1, "second rule", {"body": ["missing"]}, None, {"body": ["no", "welcome to nginx"], "header": ["server: nginx"]}),
        finger(2, "regexp first", {"body": ["welcome"], "regexp": [r"nginx/([\d.]+)"], "version_text": "9"}),
        finger(3, "vuln first", {"regexp": ["nginx"], "vuln": ["welcome TO (ng)"], "vuln_name": "CVE-1"}),
        finger(4, "info", {"header": ["nginx"], "info": "login", "version_text": "2.1"}),
        finger(5, "hash", {"md5": [hashlib.md5(body.encode()).hexdigest()]}), finger(6, "mmh", {"mmh3": [str(int(mmh3_batch([body.encode()])[0]))]}),
        finger(7, "cert", {"cert": ["CN-x"], "version": [r"ver=([\d.]+)", "(welcome)"]}), finger(8, "tcp", {"body": ["welcome"]}, protocol="tcp"),
        finger(9, "no literal", {"regexp": ["[0-9][.][0-9]+"]}), finger(10, "broken", {"regexp": ["(("]}), finger(11, "empty"), finger(12, "null list", {"body": [None]}),
        finger(13, "vuln name", {"vuln": ["nginx"]}),
    )
    got = {r.name: r for r in native.frameworks(responses(spark, raw, cert="CN-x,other"), f).collect()}
    assert set(got) == {"second rule", "regexp first", "vuln first", "info", "hash", "mmh", "cert", "no literal", "vuln name"}
    assert (got["second rule"].rule_idx, got["second rule"].kind, got["second rule"].matcher_idx) == (2, "header", 0)
    assert got["regexp first"].kind == "regexp" and got["regexp first"].version == "1.18.0"
    assert got["vuln first"].kind == "vuln" and got["vuln first"].version == "ng" and got["info"].version == "2.1"
    found = native.frameworks(responses(spark, raw, cert="CN-x,other"), f)
    assert {(r.vuln_name, r.severity, r.framework) for r in native.vulns(found).collect()} == {("CVE-1", 3, "vuln first"), ("login", 1, "info"), ("vuln name", 1, None)}


def test_messages_without_separator_and_null(spark, data):
    f = entries(spark, data, finger(1, "b", {"body": ["Hello"]}), finger(2, "h", {"header": ["hello"]}))
    r = responses(spark, "hello without separator", None, f"HTTP/1.1 302 Found{CRLF}X: hello{CRLF}{CRLF}", "")
    assert {(x.resp_id, x.name) for x in native.frameworks(r, f).collect()} == {(1, "b"), (3, "h")}


def test_payload_levels(spark, data):
    f = entries(spark, data, finger(1, "f", {"level": 1, "body": ["a"]}, {"level": 2, "send": "/rule"}, {"send": "/own"}, send="/finger"))
    plans = {n: sorted((r.rule_idx, r.payload) for r in native.payloads(f, n).collect()) for n in (0, 1, 2)}
    assert plans[0] == [] and plans[1] == [(0, "/finger"), (2, "/finger")]
    assert plans[2] == [(0, "/finger"), (1, "/finger"), (1, "/rule"), (2, "/finger"), (2, "/own")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=6), min_size=1, max_size=12), st.text(alphabet="abé ", max_size=40))
def test_keyword_indexes_find_all(patterns, text):
    want = {p for p in patterns if p in text}
    assert keywords.build_index(list(set(patterns)))(text) == want == keywords.PlainIndex(list(set(patterns))).find(text)


def test_keyword_hits_in_blocks(spark):
    rnd = random.Random(1)
    texts = spark.createDataFrame([(i, "".join(rnd.choice("abc") for _ in range(30))) for i in range(50)] + [(99, None), (98, "")], "id long, text string")
    pats = spark.createDataFrame([(x,) for x in ["", None, "ab", "abc", "cab", "bbbb", "ab"]], "pattern string")
    got = sorted((r.id, r.pattern) for r in keywords.keyword_hits(texts, pats, block_bytes=6).collect())
    assert got == sorted((r.id, r.pattern) for r in keywords.brute_hits(texts, pats).collect())
    assert keywords.keyword_hits(texts, pats.limit(0)).count() == 0


def test_required_literals():
    assert keywords.required_literal(r"(?i)Nginx/([\d.]+)") == "nginx/"
    assert keywords.required_literal("abc|def") is None and keywords.required_literal("(abc)?de") is None
    assert keywords.required_literal("(?:abcd)+x") == "abcd" and keywords.required_literal("((") is None


def test_skew_join_gives_the_plain_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 5}", 1) for i in range(600)] + [(1000, None, 1)], "i int, k string, w int")
    dim = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.upper("k"))
    for how in ("inner", "left"):
        got = sorted((r.i, r.v) for r in skew_join(rows.drop("w"), dim, "k", "n", F.col("i"), how, hot_rows=50).collect())
        assert got == sorted((r.i, r.v) for r in rows.join(dim.drop("n"), "k", how).collect())


def test_headers_and_cookies(spark):
    raw = f"HTTP/1.1 200 OK{CRLF}A: 1{CRLF}a:Two{CRLF}bad line{CRLF}Set-Cookie: path=/; jsessionid=111; path=/, XSRF-TOKEN=; a=b=c{CRLF}{CRLF}<TITLE x> T1 </title><title>Two</title>"
    header, body = parse.after_split(F.col("raw"))
    r = responses(spark, raw).select(parse.header_map(header).alias("h"), parse.title(body).alias("t"), parse.normalized_header(header).alias("n"), parse.status_code(F.col("raw")).alias("s"), parse.cookie_map(parse.header_map(header)["set-cookie"]).alias("c")).first()
    assert r.h["a"] == "1, two" and "bad line" not in r.h and r.t == "Two" and r.s == 200 and r.n.startswith("a: 1\na: two\n")
    assert r.c == {"path": "/", "jsessionid": "111", "xsrf-token": "", "a": "b=c"}
    assert responses(spark, "x y z").select(parse.status_code(F.col("raw"))).first()[0] == 0
    tags = spark.createDataFrame([('<script async></script><script src="/a.js"></script><script></script><meta name="generator" content="wp 5"/><meta charset="u">',), (None,)], "h string")
    t = tags.select(parse.tags(F.col("h")).alias("t")).collect()
    assert t[0].t.scripts == ["", "/a.js"] and [(m.name, m.content) for m in t[0].t.metas] == [("generator", "wp 5")] and t[1].t.scripts == []


@given(st.one_of(st.none(), st.integers(0, 70000).map(str), st.integers(0, 70000).map(lambda n: f"u:{n}"), st.text(max_size=5)))
@settings(max_examples=30, deadline=None)
def test_port_parsing(spark, port):
    r = spark.createDataFrame([(port,)], "p string").select(parse.port_struct(F.col("p")).alias("x")).first().x
    udp = bool(port) and port[:2].lower() == "u:"
    digits = (port[2:] if udp else port) or ""
    assert r.proto == ("udp" if udp else "tcp")
    assert r.port == (int(digits) if digits.isascii() and digits.isdigit() and len(digits) <= 5 else None)


def test_port_lists(spark):
    r = spark.createDataFrame([(["22", "1000-1002", "winrm"],)], "p array<string>").select(parse.expand_ports(F.col("p")).alias("x")).first()
    assert r.x == ["22", "1000", "1001", "1002", "winrm"]


def test_ehole_and_goby(spark):
    r = responses(spark, f"HTTP/1.1 200 OK{CRLF}Server: X{CRLF}{CRLF}<title>Alpha</title> Beta 77", f"HTTP/1.1 200 OK{CRLF}{CRLF}nothing", None)
    rows = [(1, "all", "keyword", "body", ["ALPHA", "beta"]), (2, "title", "Keyword ", "title", ["alpha"]), (3, "head", "keyword", "header", ["server: x"]), (4, "none", "keyword", "elsewhere", ["alpha"]), (5, "part", "keyword", "body", ["alpha", "gamma"]), (6, "re", "regular", "body", [r"beta \D+", "alpha"]), (7, "re2", "regular", "body", ["[0-9]+"]), (8, "icon", "faviconhash", "body", ["1"]), (9, "vacuous", "keyword", "header", None), (10, "bad", "regular", "body", ["(("])]
    e = spark.createDataFrame(rows, "ehole_id long, cms string, method string, location string, keyword array<string>")
    got = {(x.resp_id, x.cms) for x in web.ehole_hits(r, e).collect()}
    # lower-casing turns \D into \d, so "beta \D+" means digits
    assert got == {(1, "all"), (1, "title"), (1, "head"), (1, "re"), (1, "re2"), (1, "vacuous"), (2, "vacuous")}
    g = [(1, "and", "a&&b", [("a", "Alpha", True), ("b", "gamma", False)]), (2, "not", "!(a||b)", [("a", "alpha", True), ("b", "zz", True)]), (3, "unknown", "a||q", [("a", "zzz", True)]), (4, "null", "a", None), (5, "broken", "a&&", [("a", "alpha", True)]), (6, "absent", "a", [("a", "alpha", False)])]
    goby = spark.createDataFrame(g, "goby_id long, name string, logic string, rule array<struct<label:string,feature:string,is_equal:boolean>>")
    assert {x.name: x.responses for x in web.goby_counts(r, goby).collect()} == {"and": 1, "not": 1, "absent": 1}


def test_application_patterns(spark):
    raw = f"HTTP/1.1 200 OK{CRLF}Server: JBoss-2.3.9{CRLF}Set-Cookie: JSESSIONID=1; path=/{CRLF}{CRLF}" '<meta name="generator" content="mura cms 1"><script src="/jquery-3.1.js"></script><script src="/jquery-3.2.js"></script><p data-x>'
    b = chr(92)
    apps = [
        (1, "JBoss", {"server": f"jboss(?:-([{b}d.]+))?{b};confidence:50{b};version:{b}1"}, None, None, None, None), (2, "Java", None, {"jsessionid": ""}, None, None, None),
        (3, "mura cms", None, None, {"generator": [f"mura cms ([{b}d]+){b};version:{b}1"]}, None, None), (4, "jQuery", None, None, None, None, [f"jquery-([0-9.]+)[.]js{b};version:{b}1"]),
        (5, "Page", None, None, None, ["data-x", "absent"], None), (6, "No", {"server": "nginx"}, None, None, None, None),
    ]
    df = spark.createDataFrame(apps, "app_id long, app string, headers map<string,string>, cookies map<string,string>, meta map<string,array<string>>, html array<string>, scriptsrc array<string>")
    got = {r.name: (r.version, r.parts) for r in web.app_frameworks(responses(spark, raw), df).collect()}
    assert got == {"jboss": ("2.3.9", "headers"), "java": ("", "cookies"), "mura cms": ("1", "meta"), "jquery": ("3.2", "scriptsrc"), "page": ("", "html")}


WORD = lambda w, **k: {"matchers": [{"type": "word", "words": [w], **k}]}
RE = lambda r, **k: {"matchers": [{"type": "regex", "regex": [r], **k}]}
TABLE = [
    ("word body mixed", WORD("<title>Nacos</title>"), True, True), ("word body lower", WORD("<title>nacos</title>"), True, False), ("word body upper", WORD("<TITLE>NACOS</TITLE>"), True, False),
    ("word header mixed", WORD("Tengine/2.3.3", part="header"), True, True), ("word header lower", WORD("tengine/2.3.3", part="header"), True, False),
    ("word and body", {"condition": "and", "matchers": [{"type": "word", "words": ["nacos"]}, {"type": "word", "words": ["nacos"], "part": "header"}]}, True, False),
    ("regex body version", RE(r"nacos v[\d.]+"), True, False), ("regex body mixed", RE(r"Nacos v[\d.]+"), False, True), ("regex header version", RE(r"tengine/[\d.]+", part="header"), True, False),
    ("dsl body lower", {"matchers": [{"type": "dsl", "dsl": ['status_code == 200 && contains(body, "<title>nacos</title>")']}]}, True, False),
    ("dsl body mixed", {"matchers": [{"type": "dsl", "dsl": ['contains(body, "<title>Nacos</title>")']}]}, False, True),
    ("dsl header", {"matchers": [{"type": "dsl", "dsl": ['contains(all_headers, "nacos-server")']}]}, True, False), ("status 200", {"matchers": [{"type": "status", "status": 200}]}, True, True),
    ("combo and", {"condition": "and", "matchers": [{"type": "status", "status": 200}, {"type": "word", "words": ["Tengine"], "part": "header"}, {"type": "regex", "regex": ["console-ui/public/js"]}]}, True, True),
]


@pytest.mark.parametrize("fold", [True, False])
def test_template_truth_table(spark, fold):
    ts = [{"id": n, "requests": [r]} for n, r, *_ in TABLE]
    r = responses(spark, NACOS, "no separator", NACOS.replace(CRLF, "\n"))
    got = {(x.resp_id, x.template_id) for x in templates.match(r, ts, fold, chunk=4).collect()}
    want = {n for n, _, a, b in TABLE if (a if fold else b)}
    assert {t for i, t in got if i == 1} == want == {t for i, t in got if i == 3}
    assert not {t for i, t in got if i == 2}


def test_expressions():
    assert expr.dnf(expr.parse("a && !(b || c)")) == [{"a": True, "b": False, "c": False}]
    assert expr.dnf(expr.parse("a && !a")) == []
    for bad in ("a &&", "(a", "a b", "", "a ||| b"):
        with pytest.raises(ValueError):
            expr.parse(bad)


def test_equivalence(spark):
    same = 'contains(body, "x") && contains(all_headers, "y")'
    r = equivalence.report(equivalence.compare(spark, same, f"({same})", ["x"], ["y"])).first()
    assert r.consistent and r.failed == 0


def test_mmh3_known_values():
    assert mmh3_batch([b"abc", b"abcd", b""]).tolist() == [-1277324294, 1139631978, 0]


def test_icons(spark):
    d = spark.createDataFrame([(" -5 ",), ("4294967291",), ("0xFFFFFFFB",), ("x",), (None,)], "h string").select(web.icon_number(F.col("h")).alias("n"))
    assert [r.n for r in d.collect()] == ["-5", "-5", "-5", None, None]


def test_aliases_and_merge(spark):
    a = spark.createDataFrame(
        [(1, "Tomcat", "apache", "tomcat", ["b1"], {"native": ["Apache-Tomcat", "x"], "ehole": ["apache_tomcat"]}), (2, "Tomcat 2", "apache", "tomcat", ["ehole"], {"Ehole ": ["Apache Tomcat"]}), (3, "n", None, None, None, None)],
        "alias_id long, name string, vendor string, product string, block array<string>, alias map<string,array<string>>",
    )
    m = {(r.engine, r.norm): (r.alias_id, r.blocked) for r in alias.alias_map(a).collect()}
    assert m == {("native", "apachetomcat"): (1, False), ("native", "x"): (1, False), ("ehole", "apachetomcat"): (2, True)}
    h = spark.createDataFrame(
        [(1, "Native", "apache tomcat", "", None, None, ["a"], False), (1, "wappalyzer", "tomcat", "9", "v", None, ["b", None], True), (1, "ehole", "Apache-Tomcat", "8", None, None, None, False), (1, None, None, None, None, None, None, None)] * 2,
        "resp_id long, engine string, name string, version string, vendor string, product string, tags array<string>, focus boolean",
    )
    rows = alias.merge(alias.resolve(h, alias.alias_map(a))).collect()
    assert [(r.framework, r.version, r.vendor, r.froms, r.tags, r.focus) for r in rows] == [("tomcat", "9", "apache", "native,wappalyzer", "a,b", True)]
    c = spark.createDataFrame([("cpe:/a:v:p:1",), ("cpe:2.3:a:v\\:x:p:*:*",), ("none",)], "c string").select(alias.cpe_parts(F.col("c")).alias("x")).collect()
    assert tuple(c[0].x) == ("a", "v", "p", "1") and tuple(c[1].x) == ("a", "v:x", "p", None) and c[2].x is None
    assert spark.range(1).select(alias.cpe_uri(F.lit("My Vendor"), F.lit("P"), F.lit(None))).first()[0] == "cpe:/a:my_vendor:p"


def test_service_templates(spark):
    d = spark.createDataFrame([("a 1.2 b", r"(\d)\.(\d)", "v$1-$P(2)\r\n"), ("a", "a", "plain")], "data string, pattern string, t string")
    got = [r[0] for r in d.select(service.fill_template(F.col("t"), service.match_groups("data", "pattern"))).collect()]
    assert got == ["v1-2", "plain"]


PROBES = r"""# comment
Exclude T:9100
Probe TCP NULL q||
match ftp m|^220 FileZilla ([\d.]+)|i p/FileZilla/ v/$1/ cpe:/a:filezilla:server/
softmatch ftp m|^220 |
Probe UDP Neg q|\0\x41\n\\|
rarity 7
ports 137,139-140
fallback NULL
nonsense line
"""


def test_sources(spark, tmp_path):
    probes, found = catalogs.parse_probes(PROBES)
    assert [(p["name"], p["rarity"], p["ports"], p["fallback"]) for p in probes] == [("NULL", 0, [], None), ("Neg", 7, [137, 139, 140], "NULL")]
    assert probes[1]["probe"] == b"\0A\n\\" and found[0]["pattern"].startswith("^(?i:220") and found[0]["version"] == "$1" and found[1]["soft"]
    (tmp_path / "p.txt").write_text(PROBES)
    p, m = catalogs.read_probes(spark, str(tmp_path / "p.txt"))
    assert m.count() == 2 and {(r.port, r.probe) for r in catalogs.port_map(p).collect()} == {(0, "NULL"), (0, "Neg"), (137, "Neg"), (139, "Neg"), (140, "Neg")}
    (tmp_path / "s.txt").write_text("# c\n\nhttp 80/tcp 0.484143 # World Wide Web HTTP\nx 99/udp\nbad line\n")
    s = catalogs.read_services(spark, str(tmp_path / "s.txt")).collect()
    assert [(r.name, r.port, r.protocol, r.probability, r.comments) for r in s] == [("http", 80, "tcp", 0.484143, "World Wide Web HTTP"), ("x", 99, "udp", 0.0, "")]
    with gzip.open(tmp_path / "e.json.gz", "wt") as f:
        json.dump([{"cms": "a", "keyword": ["x"], "unknown": 1}, {"cms": "b"}], f)
    e = catalogs.read_json(spark, "ehole", str(tmp_path / "e.json.gz"))
    assert sorted(r.cms for r in e.collect()) == ["a", "b"] and catalogs.load_bytes(str(tmp_path / "e.json.gz")).startswith(b"[")
    with pytest.raises(FileNotFoundError):
        catalogs.load_bytes("http://example/x")
    (tmp_path / "y").mkdir()
    (tmp_path / "y/a.yaml").write_text("- {name: n1, rule: [{regexps: {body: [x]}}]}\n- {name: n2, protocol: udp}\n")
    (tmp_path / "y/b.yml").write_text("name: n3\n")
    (tmp_path / "y/c.yml").write_text("a: [\n")
    t, rep = catalogs.read_yaml_tree(spark, "native_rules", str(tmp_path / "y"))
    assert sorted(r.name for r in t.collect()) == ["n1", "n2", "n3"] and sum(r.reason is not None for r in rep.collect()) == 1
    assert sorted(r.name for r in catalogs.append(t.limit(0), t).collect()) == ["n1", "n3"]
    catalogs.write_json(e, str(tmp_path / "out"))
    assert catalogs.read_json(spark, "ehole", str(tmp_path / "out"), lines=True).count() == 2
    assert catalogs.checksums(spark, str(tmp_path / "y")).count() == 3 and '"cms"' in catalogs.schema_json("ehole")


def test_streams_equal_batches(spark, data, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{data}/responses.parquet").repartition(3).write.parquet(str(src))
    f = spark.read.parquet(f"{data}/native_finger.parquet")
    match = lambda r: native.frameworks(r, f).select("resp_id", "finger_id", "version")
    matches.match_stream(spark, str(src), match, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()), key=str)
    assert got == sorted(map(tuple, match(spark.read.parquet(str(src))).collect()), key=str)


def test_services_by_the_probe_records(spark, tmp_path):
    from lanthorn.plans import merge_queries as q

    match = lambda soft, svc, pat, **k: {"soft": soft, "service": svc, "pattern": pat, **k}
    ftp = [match(True, "ftp", "^220 "), match(False, "smtp", "^220 .*FileZilla"), match(False, "ftp", "FileZilla Server ([0-9.]+)", version_info={"version": "$1"})]
    probes = [
        {"name": "FtpNull", "protocol": "tcp", "rarity": None, "ports": None, "ssl_ports": [], "matches": ftp},
        {"name": "WebGet", "protocol": "TCP", "rarity": "1", "ports": [80, 443], "ssl_ports": [443], "matches": json.dumps([match(False, "ssl/http", "[a-z]/([0-9.]+)", version_info={"version": "v$1"}), match(False, "bad", "(")])},
        {"name": "NamePing", "protocol": "UDP", "rarity": 3, "ports": [137], "ssl_ports": None, "matches": None},
        {"name": "RareHello", "protocol": "udp", "rarity": 9, "ports": [], "ssl_ports": None},
    ]
    rows = [(i, "probe", json.dumps(p)) for i, p in enumerate(probes, 1)] + [(8, "probe", "{"), (9, "template", '{"name": "x"}'), (10, "probe", None)]
    spark.createDataFrame(rows, "rec_id bigint, kind string, payload string").write.parquet(str(tmp_path / "nested_record.parquet"))
    raw = [(1, "220 files FileZilla Server 0.9"), (2, "220 ready"), (3, "HTTP/1.1 200\r\nServer: nginx/1.18"), (4, "filezilla"), (5, None)]
    spark.createDataFrame(raw, "resp_id bigint, raw string").write.parquet(str(tmp_path / "responses.parquet"))
    got = lambda fn: sorted(map(tuple, fn(spark, str(tmp_path)).collect()))
    assert got(q.catalogue_soft_hard) == [(1, "FtpNull", 1, 2), (2, "WebGet", 0, 2), (3, "NamePing", 0, 0), (4, "RareHello", 0, 0)]
    assert got(q.catalogue_probe_order) == [(1, "FtpNull", 0), (2, "WebGet", 1), (3, "NamePing", 3)]
    assert got(q.catalogue_udp_probes) == [("NamePing", 3)]
    assert got(q.catalogue_identify) == [(1, 1, 2, False, "ftp", "0.9"), (2, 1, 0, True, "ftp", None), (3, 2, 0, False, "https", "v1.18")]
