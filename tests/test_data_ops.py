"""Nested records, refused rows and drifting schemas against plain versions on whole small tables and on edge cases."""

import csv
import io
import json
import random
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lanthorn.operators import drift, rejects, shred
from lanthorn.plans import data_queries
from lanthorn.session import table


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_shred_counts_nulls_lone_values_and_wrapped_text(spark):
    payload = json.dumps({"http": [None, {"matchers": json.dumps({"type": "word"})}], "info": json.dumps({"metadata": {"a": [], "b": None, "c.d": 0}})})
    df = spark.createDataFrame([("template", 1, json.dumps(payload), "x"), ("template", 2, None, None), ("template", 3, "{", ""), ("probe", 4, "[]", "")], "kind string, rec_id long, payload string, node string")
    nodes = shred.shred(df, ["kind", "rec_id"], "payload", data_queries.PREFER)
    ent = shred.entities(nodes, ["kind", "rec_id"], data_queries.NESTED)
    got = {(r.entity, tuple(r.anc), r.label, r.type) for r in ent.collect()}
    assert got == {("request", (1,), "http", None), ("matcher", (1, 0), "matchers", "word"), ("metadata", (0, 0, 0), "a", None), ("metadata", (0, 0, 0), "c.d", None)}
    assert rows(nodes.where("type = 'bad'").select("rec_id", "scalar")) == [(2, "null"), (3, "broken"), (4, "not an object")]


def test_shred_of_lists_in_lists_and_empty_table(spark):
    out = {(p, o, tuple(a), s) for _, _, p, _, o, a, t, s in shred.shred_value({"a": [[1, None], 2]}) if t != "array"}
    assert out == {("", -1, (), None), (".a[]", 0, (0, 0), "1"), (".a[]", 1, (0, 1), None), (".a", 1, (1,), "2")}
    empty = spark.createDataFrame([], "kind string, rec_id long, payload string")
    assert shred.shred(empty, ["kind", "rec_id"], "payload").count() == 0


def brute_nested(kind, rec_id, payload):
    def un(x):
        while isinstance(x, str):
            try:
                y = json.loads(x)
            except ValueError:
                return x
            if not (y is None or isinstance(y, (dict, list, str))):
                return x
            x = y
        return x

    def lst(x):
        x = un(x)
        return [] if x is None else x if isinstance(x, list) else [x]

    o = un(payload) if payload is not None else None
    if not isinstance(o, dict):
        return
    if kind == "template":
        meta = un((un(o.get("info")) or {}).get("metadata"))
        for k, v in (meta or {}).items():
            if un(v) is not None:
                yield "metadata", rec_id, -1, -1, k
        reqs = o.get("http") if un(o.get("http")) is not None else o.get("requests")
        for i, r in enumerate(lst(reqs)):
            if un(r) is None:
                continue
            yield "request", rec_id, -1, i, ""
            for j, m in enumerate(lst(un(r).get("matchers"))):
                if un(m) is not None:
                    yield "matcher", rec_id, i, j, un(m).get("type") or ""
    else:
        for i, m in enumerate(lst(o.get("matches"))):
            if un(m) is None:
                continue
            yield "match", rec_id, -1, i, un(m).get("service") or ""
            for j, c in enumerate(lst((un(un(m).get("version_info")) or {}).get("cpes"))):
                if c is not None:
                    yield "cpe", rec_id, i, j, c


def test_p2_found_against_plain_walk(spark, data):
    want = set()
    for r in table(spark, data, "nested_record").collect():
        want |= set(brute_nested(r.kind, r.rec_id, r.payload))
    for r in table(spark, data, "native_finger").select("finger_id", "rule").collect():
        want |= {("rule", r.finger_id, -1, i, "") for i, x in enumerate(r.rule or []) if x is not None}
    assert rows(data_queries.p2_found(spark, data)) == sorted(want)


def scan_fields(line):
    """Field by field, as the rule is written; None if the quoting is broken."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j = i + 1
            while True:
                j = line.find('"', j)
                if j < 0:
                    return None
                if line[j + 1 : j + 2] == '"':
                    j += 2
                    continue
                break
            out.append(line[i + 1 : j].replace('""', '"'))
            i = j + 1
            if i < len(line) and line[i] != ",":
                return None
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return None
            out.append(line[i:j])
            i = j
        if i >= len(line):
            return out
        i += 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='a",\né', max_size=12), min_size=1, max_size=5))
def test_structural_index_against_scan(lines):
    enc = [x.encode() for x in lines]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in enc])]).astype(np.int64)
    rec, cut, bad = rejects.index_records(b"".join(enc), offsets)
    for i, line in enumerate(lines):
        want = scan_fields(line)
        assert bool(bad[i]) == (want is None)
        if want is not None:
            at = [int(offsets[i]) - 1, *cut[rec == i].tolist(), int(offsets[i + 1])]
            assert [rejects._field(b"".join(enc)[a + 1 : b]) for a, b in zip(at, at[1:])] == want


def test_record_ends_skip_quoted_breaks():
    buf = np.frombuffer(b'a,"x\ny"\nb\n', np.uint8)
    assert rejects.record_ends(buf).tolist() == [7, 9]


def test_files_are_cut_at_record_ends(spark, tmp_path):
    rnd = random.Random(3)
    want = {}
    for k in range(3):
        rows = [[str(i), "x" * rnd.randint(0, 30), 'q"uo"te' if i % 3 == 0 else "p", "line\nbreak, and\r\nmore\n" * rnd.randint(0, 60) if i % 7 == 0 else "y"] for i in range(300)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\r\n" if k else "\n").writerows(rows)
        (tmp_path / f"f{k}.csv").write_bytes(out.getvalue().encode())
        want[f"f{k}.csv"] = sorted(rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {}
            for r in rejects.read_records(spark, str(tmp_path)).collect():
                got.setdefault(r.file_name.rsplit("/", 1)[1], []).append(next(csv.reader(io.StringIO(r.line_text, newline=""), strict=True)))
            assert {k: sorted(v) for k, v in got.items()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "open.csv").write_bytes(b'a,b\n"c,d\ne,f\n')
    bad = rejects.read_records(spark, str(tmp_path / "open.csv"))
    assert sorted(r.line_text for r in bad.collect()) == ['"c,d\ne,f\n', "a,b"]
    assert [r.reason for r in rejects.parse_lines(bad.where("line_text like '%c%'")).collect()] == ["quoting"]


def test_lists_below_matchers(spark):
    payload = json.dumps({"id": "t", "http": [{"matchers": [{"type": "word", "words": ["a", None, "b"]}, {"type": ["status", "x"], "status": 200}]}]})
    df = spark.createDataFrame([("template", 1, payload)], "kind string, rec_id int, payload string")
    nodes = shred.shred(df, ["kind", "rec_id"], "payload", data_queries.PREFER)
    got = sorted((tuple(r.anc), r.field, r.pos, r.value) for r in shred.items(nodes, ["rec_id"], {"matcher": [".http.matchers"]}).collect())
    assert got == [((0, 0), "type", 0, "word"), ((0, 0), "words", 0, "a"), ((0, 0), "words", 2, "b"), ((0, 1), "status", 0, "200"), ((0, 1), "type", 0, "status"), ((0, 1), "type", 1, "x")]
    ent = shred.entities(nodes, ["rec_id"], {"matcher": ([".http.matchers"], {"type": "type"})}).collect()
    assert {tuple(r.anc): r.type for r in ent} == {(0, 0): "word", (0, 1): None}


def test_p3_against_csv_reader(spark, data):
    got = dict(rows(data_queries.p3_found(spark, data)))
    for r in table(spark, data, "raw_line").collect():
        fields = scan_fields(r.line_text)
        if fields is None:
            assert got[r.line_id] == "quoting"
            continue
        assert next(csv.reader(io.StringIO(r.line_text, newline=""), strict=True)) == fields
        if len(fields) != 6:
            assert got[r.line_id] == "columns"
        else:
            ok = re.fullmatch("[0-9]+", fields[0]) and fields[2].strip() and re.fullmatch("[0-5]", fields[5])
            ok = ok and (fields[1], fields[3]) in rejects.KINDS
            assert (got.get(r.line_id) == "value") == (not ok)


def test_lines_with_odd_values(spark):
    lines = [None, "", '1,wapp,n,html,"a(b)\\;version:\\2",3', '1,wapp,n,html,"a(b)\\;version:\\1",3', '1,native,n,regexp,a(,3', '1,ehole,n,keyword,"[""a""]",0', '1,ehole,n,keyword,"[1]",0', "1,ehole,n,keyword,[],0", "x" * 100_000]
    df = spark.createDataFrame([(i, x, "r") for i, x in enumerate(lines)], "line_id int, line_text string, reason string")
    got = {r.line_id: (r.reason, r.keywords) for r in rejects.parse_lines(df).collect()}
    assert [got[i][0] for i in range(9)] == ["columns", "columns", "pattern", None, "pattern", None, "keyword", "keyword", "columns"]
    assert got[5][1] == ["a"]
    assert "src_reason" in rejects.parse_lines(df).columns
    assert rejects.parse_lines(df.limit(0)).count() == 0


def test_p6_against_plain_comparison(spark, data):
    files = defaultdict(list)
    for r in table(spark, data, "drift_record").collect():
        files[r.feed, r.file_seq].append(json.loads(r.payload))
    want = set()
    for (feed, seq), recs in files.items():
        if (feed, seq - 1) not in files:
            continue

        def read(recs):
            types, vals = defaultdict(set), defaultdict(dict)
            for o in recs:
                for k, v in o.items():
                    if v is not None:
                        types[k].add((type(v).__name__, *sorted({type(x).__name__ for x in v})) if isinstance(v, list) else type(v).__name__.replace("float", "int"))
                        vals[k][o.get("app", o.get("id"))] = v
            return types, vals

        (t0, v0), (t1, v1) = read(files[feed, seq - 1]), read(recs)
        went, came = set(t0) - set(t1), set(t1) - set(t0)
        moved = {}
        for a in went:
            for b in came:
                common = set(v0[a]) & set(v1[b])
                if common and sum(v0[a][x] == v1[b][x] for x in common) >= len(common) / 2:
                    moved[a] = b
        want |= {(feed, seq, "renamed", a, b) for a, b in moved.items()}
        want |= {(feed, seq, "removed", a, "") for a in went - set(moved)}
        want |= {(feed, seq, "added", b, "") for b in came - set(moved.values())}
        want |= {(feed, seq, "retyped", k, "") for k in set(t0) & set(t1) if t0[k] != t1[k]}
    assert rows(data_queries.p6_found(spark, data)) == sorted(want)


def test_drift_edge_cases_and_steady_table(spark):
    recs = [
        ("f", 1, '{"app": "a", "html": ["x"], "n": 1}'), ("f", 1, '{"app": "b", "html": ["y"], "n": 2}'),
        ("f", 2, '{"app": "a", "HTML": ["x"], "n": "no"}'), ("f", 2, '{"app": "b", "HTML": ["y"], "n": "3"}'), ("f", 2, '{"app": "b", "HTML": ["y"], "n": "3"}'),
        ("f", 3, '{"app": "a", "HTML": ["x"], "n": null}'), ("f", 5, '{"app": "a"}'), ("f", None, '{"app": "a"}'), (None, 3, "{}"), ("f", 3, None), ("f", 3, "[1]"), ("f", 3, "{"),
    ]
    df = spark.createDataFrame(recs, "feed string, file_seq int, payload string")
    assert rows(drift.changes(df)) == [("f", 2, "renamed", "html", "HTML"), ("f", 2, "retyped", "n", ""), ("f", 3, "removed", "n", "")]
    got = {(r.file_seq, r.app): r for r in drift.steady_table(df, {"app": "text", "html": "list", "n": "number"}).collect()}
    assert got[2, "a"].html == ["x"] and got[2, "a"].failed == ["n"] and got[2, "b"].n == 3.0
    assert drift.changes(df.limit(0)).count() == 0


def test_list_types_and_nested_paths(spark):
    recs = [
        ("f", 1, '{"app": "a", "html": ["x"], "m": {"v": "one", "k": 1}, "e": [], "r": [{"t": "w"}]}'),
        ("f", 2, '{"app": "a", "html": [{"p": "x"}], "m": {"maker": "one", "k": "1"}, "e": [null], "r": [{"t": ["w"]}]}'),
        ("f", 3, '{"app": "a", "html": [1, "x"], "m": {"maker": "one", "k": "1"}, "e": [], "r": [{"t": ["w"]}]}'),
    ]
    df = spark.createDataFrame(recs, "feed string, file_seq int, payload string")
    assert rows(drift.changes(df)) == [("f", 2, "retyped", "html", ""), ("f", 3, "retyped", "html", "")]
    deep = {(r.file_seq, r.change, r.field, r.new_field) for r in drift.changes(df, depth=4).collect() if "." in r.field}
    assert deep == {(2, "renamed", "m.v", "m.maker"), (2, "retyped", "m.k", ""), (2, "retyped", "r[].t", ""), (2, "added", "r[].t[]", "")} | {x for x in deep if "html" in x[2]}
    assert {x for x in deep if "html" in x[2]} == {(2, "added", "html[].p", ""), (3, "removed", "html[].p", "")}


def test_rows_without_a_place_in_the_steady_table(spark, tmp_path):
    recs = [
        (1, "wapp_a", 1, '{"app": "a"}'), (2, "template_a", 1, '{"id": "a"}'), (3, None, 1, '{"app": "a"}'), (4, "wapp_a", None, '{"app": "a"}'), (5, "wapp_a", 1, None), (6, "wapp_a", 1, "{"),
        (7, "wapp_a", 1, "[1]"), (8, "wapp_a", 1, '{"id": "a"}'), (9, "template_a", 1, '{"id": null, "app": "a"}'), (10, "other", 1, "{}"),
    ]
    spark.createDataFrame(recs, "rec_id bigint, feed string, file_seq int, payload string").write.parquet(str(tmp_path / "drift_record.parquet"))
    got = rows(data_queries.p6_refused(spark, str(tmp_path)))
    assert got == [(3, "feed"), (4, "file_seq"), (5, "null"), (6, "broken"), (7, "not an object"), (8, "name"), (9, "name"), (10, "feed")]
    assert data_queries.p6_wapp(spark, str(tmp_path)).count() + data_queries.p6_template(spark, str(tmp_path)).count() + len(got) == len(recs)
