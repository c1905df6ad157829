"""Captured HTTP messages taken apart, in built-in columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF2 = "\r\n\r\n"


def after_split(text: Column, sep: str = CRLF2) -> tuple[Column, Column]:
    """(header, body) around the first separator; both null without one."""
    at = F.instr(text, sep)
    header = F.when(at > 0, F.substr(text, F.lit(1), at - 1))
    body = F.when(at > 0, F.substr(text, at + len(sep)))
    return header, body


def parsed(responses: DataFrame) -> DataFrame:
    """resp_id, url, host, port, cert, raw, content (lower case), header and body of the content (null if unsplit)."""
    content = F.lower("raw")
    header, body = after_split(F.col("content"))
    return responses.select("resp_id", "url", "host", "port", "cert", "raw", content.alias("content")).withColumns({"header": header, "body": body})


def template_parts(raw: Column) -> tuple[Column, Column]:
    """(header, body) at CRLFCRLF, else at LFLF, else null: templates make no event of a message without separator."""
    h1, b1 = after_split(raw)
    h2, b2 = after_split(raw, "\n\n")
    return F.coalesce(h1, h2), F.coalesce(b1, b2)


def status_code(raw: Column) -> Column:
    """Second space-delimited token of the first line as a number, else 0."""
    line = F.regexp_extract(raw, r"\A([^\r\n]*)", 1)
    return F.coalesce(F.get(F.split(line, " "), F.lit(1)).try_cast("int"), F.lit(0))


def header_lines(header: Column) -> Column:
    """array<struct<key, value>> of the lines with a colon; keys lower case, both trimmed."""
    lines = F.filter(F.split(header, r"\r?\n"), lambda x: F.instr(x, ":") > 0)
    return F.transform(
        lines,
        lambda x: F.struct(
            F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"),
            F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value"),
        ),
    )


def normalized_header(header: Column, fold: bool = True) -> Column:
    """``key: value`` lines; the value is lowered when ``fold``."""
    lines = F.transform(header_lines(header), lambda x: F.concat(x["key"], F.lit(": "), F.lower(x["value"]) if fold else x["value"], F.lit("\n")))
    return F.array_join(lines, "")


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def header_map(header: Column) -> Column:
    """map of lower-case key to lower-case value; repeated keys join their values by ``, ``."""

    def grouped(lines: Column) -> Column:
        keys = F.array_distinct(F.transform(lines, lambda x: x["key"]))
        value = lambda k: F.lower(F.array_join(F.transform(F.filter(lines, lambda x: x["key"] == k), lambda x: x["value"]), ", "))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, value(k))))

    return once(header_lines(header), grouped)


def cookie_pieces(set_cookie: Column) -> Column:
    """The value of set-cookie split on spaces, and each piece on commas, else on semicolons."""
    pieces = F.split(set_cookie, " ")
    return F.flatten(F.transform(pieces, lambda p: F.when(F.contains(p, F.lit(",")), F.split(p, ",")).otherwise(F.split(p, ";"))))


def cookie_map(set_cookie: Column) -> Column:
    """map of cookie names to values; pieces without ``=`` are dropped, the last of a name wins."""
    pairs = F.filter(F.transform(cookie_pieces(set_cookie), lambda p: F.trim(p)), lambda p: F.instr(p, "=") > 0)
    kv = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substr(p, F.instr(p, "=") + 1).alias("v")))

    def last(kv: Column) -> Column:
        names = F.array_distinct(F.transform(kv, lambda x: x["k"]))
        return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(kv, lambda x: x["k"] == n), -1)["v"])))

    return once(kv, last)


def title(body: Column) -> Column:
    """Text of the last title element of the body as written, trimmed; null without one."""
    found = F.regexp_extract_all(body, F.lit(r"(?is)<title[^>]*>([^<]+)"), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def tags(html: Column) -> Column:
    """struct<scripts: array<string>, metas: array<struct<name, content>>> of a lower-case body.

    A script start tag with any attribute counts, with an empty source if it has none; a meta tag needs two attributes.
    """

    @F.pandas_udf("struct<scripts: array<string>, metas: array<struct<name: string, content: string>>>")
    def run(s):
        from html.parser import HTMLParser

        import pandas as pd

        class P(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.scripts, self.metas = [], []

            def handle_starttag(self, tag, attrs):
                d = {}
                for k, v in attrs:
                    d.setdefault(k, v or "")
                if tag == "script" and attrs:
                    self.scripts.append(d.get("src", ""))
                elif tag == "meta" and len(attrs) >= 2:
                    self.metas.append({"name": d.get("name", d.get("property", "")), "content": d.get("content", "")})

        rows = []
        for html in s:
            p = P()
            if html and ("<script" in html or "<meta" in html):
                try:
                    p.feed(html)
                    p.close()
                except (AssertionError, ValueError):  # markup that the tokenizer gives up on keeps what was read
                    pass
            rows.append((p.scripts, p.metas))
        return pd.DataFrame({"scripts": [r[0] for r in rows], "metas": [r[1] for r in rows]})

    return run(html)


def port_struct(port: Column) -> Column:
    """struct<port int, proto string> of ``80`` or ``U:137``; the number is null where it cannot be read."""
    udp = F.lower(F.substr(port, F.lit(1), F.lit(2))) == "u:"
    digits = F.when(udp, F.substr(port, F.lit(3))).otherwise(port)
    number = F.when(digits.rlike("^[0-9]{1,5}$"), digits.cast("int"))
    return F.struct(number.alias("port"), F.when(udp, "udp").otherwise("tcp").alias("proto"))


def expand_ports(ports: Column) -> Column:
    """array<string> of a list of ports in which ``a-b`` is a range; what is no number or range stays as it is."""
    return F.flatten(
        F.transform(
            ports,
            lambda p: F.when(
                p.rlike("^[0-9]{1,5}-[0-9]{1,5}$"),
                F.transform(
                    F.sequence(F.substring_index(p, "-", 1).cast("int"), F.greatest(F.substring_index(p, "-", 1).cast("int"), F.substring_index(p, "-", -1).cast("int"))),
                    lambda x: x.cast("string"),
                ),
            ).otherwise(F.array(p)),
        )
    )
