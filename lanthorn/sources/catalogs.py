"""Catalogue files as tables: JSON (plain or gzip), YAML trees, and the text databases of service detection.

Catalogues are small dimension tables. JSON goes through Spark's reader with a fixed schema; formats that Spark has no
reader for are parsed on the driver, where a catalogue file belongs, and become tables.
"""

from __future__ import annotations

import glob
import gzip
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = "array<string>"
_REGEXPS = ", ".join(f"{k}: {_STRINGS}" for k in ("body", "header", "regexp", "version", "cert", "md5", "mmh3", "vuln"))
SCHEMAS = {
    "native_rules": f"name string, vendor string, product string, protocol string, default_port {_STRINGS}, focus boolean, tag {_STRINGS}, level int, opsec boolean, send_data string, link {_STRINGS}, author string, description string, "
    f"rule array<struct<version: string, vuln: string, info: string, level: int, send_data: string, favicon: struct<mmh3: {_STRINGS}, md5: {_STRINGS}>, regexps: struct<{_REGEXPS}>>>",
    "ehole": f"cms string, method string, location string, keyword {_STRINGS}",
    "goby": "name string, logic string, rule array<struct<label: string, feature: string, is_equal: boolean>>",
    "alias": f"name string, vendor string, product string, tags {_STRINGS}, priority int, link {_STRINGS}, alias map<string, {_STRINGS}>, block {_STRINGS}, pocs {_STRINGS}, metadata map<string, string>",
    "ports": f"name string, ports {_STRINGS}, tags {_STRINGS}",
    "services": "name string, port int, protocol string, probability double, comments string",
    "probes": "name string, protocol string, rarity int, ports array<int>, ssl_ports array<int>, fallback string, probe string, "
    f"matches array<struct<soft: boolean, service: string, pattern: string, version_info: struct<product: string, version: string, info: string, hostname: string, os: string, device: string, cpes: {_STRINGS}>>>",
    "apps": f"app string, cats array<int>, css {_STRINGS}, cookies map<string, string>, js {_STRINGS}, headers map<string, string>, html {_STRINGS}, scripts {_STRINGS}, scriptsrc {_STRINGS}, meta map<string, {_STRINGS}>, implies {_STRINGS}, description string, website string, cpe string",
}
#: Where a catalogue comes from and what reads it: kind of source by catalogue name.
REGISTRY = {"native_rules": "json", "ehole": "json", "goby": "json", "alias": "yaml", "ports": "yaml", "nmap-services": "services", "nmap-probes": "probes"}


def schema_json(name: str) -> str:
    """JSON form of a catalogue's schema."""
    return T.StructType.fromDDL(SCHEMAS[name]).json()


def read_json(spark: SparkSession, name: str, path: str, lines: bool = False) -> DataFrame:
    """A JSON array (or object) file, or one object a line, gzip by its extension; fields outside the schema are ignored."""
    reader = spark.read.schema(T.StructType.fromDDL(SCHEMAS[name])).option("multiLine", not lines)
    return reader.option("mode", "PERMISSIVE").json(path)


def load_bytes(path: str) -> bytes:
    """A local file, unpacked if its bytes say gzip. There is no other kind of source."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path}: catalogues are read from files only")
    with open(path, "rb") as f:
        data = f.read()
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def from_records(spark: SparkSession, name: str, records: list) -> DataFrame:
    """Dictionaries as a table of the catalogue's schema; wrong types become null through Spark's JSON reader."""
    rows = spark.createDataFrame([(json.dumps(r, default=str),) for r in records], "j string")
    schema = SCHEMAS[name]
    return rows.select(F.from_json("j", schema).alias("x")).select("x.*")


def read_catalogue(spark: SparkSession, name: str, path: str, override: str | None = None) -> DataFrame:
    """A catalogue file, or the file that overrides it: JSON or YAML as its content says, gzip or plain."""
    data = load_bytes(override or path)
    try:
        doc = json.loads(data)
    except ValueError:
        import yaml

        doc = yaml.safe_load(data)
    return from_records(spark, name, doc if isinstance(doc, list) else [doc])


def read_apps(spark: SparkSession, path: str) -> DataFrame:
    """Applications of a file {"apps" or "technologies": {name: {...}}}: names of fields and keys lower case, a lone value
    a list of one, lists sorted, of ``js`` the keys only."""
    doc = json.loads(load_bytes(path))
    apps = doc.get("apps") or doc.get("technologies") or doc
    as_list = lambda x: sorted(str(v) for v in (x if isinstance(x, list) else [] if x is None else [x]))
    out = []
    for app, rec in apps.items():
        r = {k.lower(): v for k, v in rec.items()}
        low = lambda m: {k.lower(): v if isinstance(v, str) else "" for k, v in m.items()} if isinstance(m, dict) else None
        rec = {"app": app, "cats": sorted(c for c in r.get("cats") or [] if isinstance(c, int)), "cookies": low(r.get("cookies")), "headers": low(r.get("headers")), "js": sorted(r["js"]) if isinstance(r.get("js"), dict) else as_list(r.get("js"))}
        rec |= {k: as_list(r.get(k)) for k in ("css", "html", "scripts", "scriptsrc", "implies")}
        rec["meta"] = {k.lower(): as_list(v) for k, v in r["meta"].items()} if isinstance(r.get("meta"), dict) else None
        out.append(rec | {k: r.get(k) for k in ("description", "website", "cpe")})
    return from_records(spark, "apps", out)


def probe_matches(probes: DataFrame) -> DataFrame:
    """The match table of probes that were read from JSON."""
    m = probes.select(F.col("name").alias("probe"), F.posexplode("matches").alias("idx", "m"))
    return m.select("probe", "idx", F.coalesce("m.soft", F.lit(False)).alias("soft"), "m.service", "m.pattern", "m.version_info.*")


def read_yaml_tree(spark: SparkSession, name: str, root: str) -> tuple[DataFrame, DataFrame]:
    """(table, report) of all .yaml and .yml files under a folder or of one file; a file holds one document or a list.

    report: path, loaded, reason. A file that cannot be read is reported and left out.
    """
    import yaml

    paths = [root] if os.path.isfile(root) else sorted(p for e in ("yaml", "yml") for p in glob.glob(f"{root}/**/*.{e}", recursive=True))
    records, report = [], []
    for p in paths:
        try:
            doc = yaml.safe_load(load_bytes(p))
            docs = doc if isinstance(doc, list) else [doc]
            good = [d for d in docs if isinstance(d, dict)]
            records += [d | {"_source_file": os.path.relpath(p, root if os.path.isdir(root) else os.path.dirname(root))} for d in good]
            report.append((p, len(good), None if len(good) == len(docs) else "not an object"))
        except (yaml.YAMLError, UnicodeDecodeError, OSError) as e:
            report.append((p, 0, type(e).__name__))
    return from_records(spark, name, records), spark.createDataFrame(report, "path string, loaded int, reason string")


def append(catalogue: DataFrame, more: DataFrame, protocols: tuple[str, ...] = ("http", "tcp")) -> DataFrame:
    """Two catalogues as one; of entries only those of the named protocols are taken over."""
    if "protocol" in more.columns:
        more = more.where(F.lower(F.coalesce("protocol", F.lit("http"))).isin(*protocols))
    return catalogue.unionByName(more, allowMissingColumns=True)


def read_services(spark: SparkSession, path: str) -> DataFrame:
    """(name, port, protocol, probability, comments) of lines ``name port/proto [probability] [# comment]``.

    Blank lines, comments and lines that do not fit are skipped; a missing probability is 0.
    """
    line = r"^(\S+)\s+(\d{1,5})/(\w+)(?:\s+([0-9.]+))?\s*(?:#\s*(.*))?$"
    t = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)") & F.col("value").rlike(line))
    g = lambda n: F.regexp_extract("value", line, n)
    return t.select(g(1).alias("name"), g(2).cast("int").alias("port"), g(3).alias("protocol"), F.coalesce(g(4).try_cast("double"), F.lit(0.0)).alias("probability"), F.trim(g(5)).alias("comments"))


#: Lines of a probe file that count (fixed values).
COMMANDS = ("Exclude", "Probe", "match", "softmatch", "ports", "sslports", "totalwaitms", "tcpwrappedms", "rarity", "fallback")
_FIELD = r"(?:^|\s){}/((?:[^/\\]|\\.)*)/"


def _ports(text: str) -> list[int]:
    out = []
    for p in text.split(","):
        a, _, b = p.strip().partition("-")
        if a.isdigit() and (not b or b.isdigit()):
            out += range(int(a), int(b or a) + 1)
    return out


def unescape(text: str) -> bytes:
    """Bytes of a probe string with backslash escapes; ``\\0`` is a zero byte."""
    names = {"0": b"\0", "a": b"\a", "b": b"\b", "f": b"\f", "n": b"\n", "r": b"\r", "t": b"\t", "v": b"\v", "\\": b"\\"}
    out, i = bytearray(), 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            if text[i + 1] == "x" and re.fullmatch("[0-9a-fA-F]{2}", text[i + 2 : i + 4]):
                out.append(int(text[i + 2 : i + 4], 16))
                i += 4
                continue
            out += names.get(text[i + 1], text[i + 1].encode("latin-1", "replace"))
            i += 2
        else:
            out += text[i].encode("latin-1", "replace")
            i += 1
    return bytes(out)


def with_flags(pattern: str, flags: str) -> str:
    """A match's regular expression with its options inside; any option brings ``i`` along. ``\\0`` is a zero byte."""
    pattern = pattern.replace(r"\0", r"\x00")
    if not flags:
        return pattern
    inner = pattern.removeprefix("^")
    end = "$" if inner.endswith("$") and not inner.endswith("\\$") else ""
    return f"{'^' if pattern.startswith('^') else ''}(?{''.join(sorted({*flags, 'i'}))}:{inner.removesuffix(end) if end else inner}){end}"


def parse_probes(text: str) -> tuple[list[dict], list[dict]]:
    """(probes, matches) of a probe database text: a probe starts at each ``Probe`` line, ``Exclude`` is left out."""
    probes, found = [], []
    for raw in text.splitlines():
        word, _, rest = raw.partition(" ")
        if len(raw) < 2 or raw.startswith("#") or word not in COMMANDS or word == "Exclude":
            continue
        if word == "Probe":
            m = re.match(r"(TCP|UDP) (\S+) q(.)(.*)\3", rest)
            if m:
                probes.append({"name": m[2], "protocol": m[1], "rarity": 0, "ports": [], "ssl_ports": [], "fallback": None, "probe": unescape(m[4])})
        elif not probes:
            continue
        elif word in ("match", "softmatch"):
            m = re.match(r"(\S+) m(.)(.*?)\2([is]*)(.*)$", rest)
            if not m:
                continue
            info = {k: (x[1] if (x := re.search(_FIELD.format(c), m[5])) else None) for k, c in (("product", "p"), ("version", "v"), ("info", "i"), ("hostname", "h"), ("os", "o"), ("device", "d"))}
            found.append({"probe": probes[-1]["name"], "idx": len(found), "soft": word == "softmatch", "service": m[1], "pattern": with_flags(m[3], m[4]), **info, "cpes": re.findall(r"cpe:/[^/\s]+", m[5])})
        elif word in ("ports", "sslports"):
            probes[-1]["ports" if word == "ports" else "ssl_ports"] = _ports(rest)
        elif word == "rarity":
            probes[-1]["rarity"] = int(rest) if rest.strip().isdigit() else 0
        elif word == "fallback":
            probes[-1]["fallback"] = rest.split(",")[0].strip()
    return probes, found


def read_probes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    probes, found = parse_probes(load_bytes(path).decode("latin-1"))
    p = spark.createDataFrame([tuple(x.values()) for x in probes], "name string, protocol string, rarity int, ports array<int>, ssl_ports array<int>, fallback string, probe binary")
    return p, match_table(spark, found)


def match_table(spark: SparkSession, found: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(x.values()) for x in found], "probe string, idx int, soft boolean, service string, pattern string, product string, version string, info string, hostname string, os string, device string, cpes array<string>")


def port_map(probes: DataFrame) -> DataFrame:
    """(port, probe): every probe under its ports and TLS ports, and all of them under port 0."""
    both = F.concat(F.coalesce("ports", F.array().cast("array<int>")), F.coalesce("ssl_ports", F.array().cast("array<int>")), F.array(F.lit(0)))
    return probes.select(F.explode(F.array_distinct(both)).alias("port"), F.col("name").alias("probe"))


def write_json(df: DataFrame, path: str) -> None:
    """Catalogue sink: gzip JSON, one object a line."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_results(df: DataFrame, path: str) -> None:
    """Sink of scan results."""
    df.write.mode("overwrite").parquet(path)


def merge_yaml(spark: SparkSession, root: str, target: str, level: int = 9, logged: int = 10) -> DataFrame:
    """All YAML records under a folder, each with its ``_source_file``, as one gzip JSON list; the report of the files.

    The report keeps every file; ``shown`` is true for the first ``logged`` failures.
    """
    import yaml

    docs, report, bad = [], [], 0
    for p in sorted(x for e in ("yaml", "yml") for x in glob.glob(f"{root}/**/*.{e}", recursive=True)):
        try:
            doc = yaml.safe_load(load_bytes(p))
            good = [d for d in (doc if isinstance(doc, list) else [doc]) if isinstance(d, dict)]
            docs += [d | {"_source_file": os.path.relpath(p, root)} for d in good]
            report.append((p, len(good), None, False))
        except (yaml.YAMLError, UnicodeDecodeError, OSError) as e:
            bad += 1
            report.append((p, 0, type(e).__name__, bad < logged))
    with open(target, "wb") as f:
        f.write(gzip.compress(json.dumps(docs, default=str, ensure_ascii=False).encode(), level))
    return spark.createDataFrame(report, "path string, loaded int, reason string, shown boolean")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5) of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def with_yaml_aliases(derived: DataFrame, listed: DataFrame) -> DataFrame:
    """Alias entries derived from entries first, listed ones after them, so that a listed entry wins."""
    a = derived.withColumn("alias_id", F.col("alias_id").cast("bigint"))
    top = F.lit(1 << 40)
    return a.unionByName(listed.withColumn("alias_id", F.col("alias_id").cast("bigint") + top), allowMissingColumns=True)
