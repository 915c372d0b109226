import csv
import re
from datetime import datetime

from corvane.operators import drift
from tests.conftest import DATA

FILES = "manifest_id bigint, folder string, category string, collected_at timestamp, received_at timestamp, line_text string"
LINES = "manifest_id bigint, line_no int, line_text string, folder string"


def tables(spark, files, extra=()):
    t = lambda i: datetime(2020, 1, i)
    f = [(i, folder, None, t(day), None, "clash") for i, folder, day, _ in files]
    lines = [(i, n, x, "clash") for i, _, _, ls in files for n, x in enumerate(ls, 1)]
    return spark.createDataFrame(f + [tuple(x) for x in extra], FILES), spark.createDataFrame(lines + lines[:2] if lines else [], LINES)


def test_changes(spark):
    f, lines = tables(
        spark,
        [
            (1, "a", 1, ["# note", "", "\ufeffStatus,url, domain ,detected_year", 'ok,"u,1",www.X.org,2019', "status,URL,domain,detected_year", "ok", None]),
            (2, "a", 2, ["state;url;host;detected_year;lang", "ok;u;x.org;2019.0;en", "ok;v;;2020;de"]),
            (3, "a", 3, ["url\tstatus\thost", 'u\t\t"say ""hi"""']),
            (4, "a", 3, []),
            (5, "b", 1, ["status", "ok"]),
        ],
    )
    got = {tuple(r) for r in drift.drift(f, lines).collect()}
    assert got == {
        (2, "status", "renamed"), (2, "domain", "renamed"), (2, "detected_year", "type_changed"), (2, "lang", "added"),
        (3, "status", "renamed"), (3, "detected_year", "removed"), (3, "lang", "removed"),
        (4, "url", "removed"), (4, "status", "removed"), (4, "domain", "removed"),
    }


def test_records(spark):
    f, lines = tables(spark, [(1, "a", 1, ["status,filename,domain,detected_year,size_bytes,lang", "ok,C:\\x\\y.pdf, WWW.Q.org ,FY2019,0.3 MB,en", "ok,z.md,,x,12.0"])])
    rows = {r.line_no: r for r in drift.records(f, lines).collect()}
    assert (rows[2].filename, rows[2].domain, rows[2].detected_year, rows[2].size_bytes, rows[2].failed_casts) == ("y.pdf", "q.org", 2019, None, "size_bytes")
    assert rows[2].extra == '{"lang":"en"}'
    assert (rows[3].filename, rows[3].domain, rows[3].detected_year, rows[3].size_bytes, rows[3].failed_casts) == ("z.md", None, None, 12, "detected_year")


def test_unnamed_headers_go_by_their_values(spark):
    f, lines = tables(spark, [(1, "a", 1, ["status,where", "ok,https://x.org/a"])])
    assert {r.field_name for r in drift.path_types(lines).collect()} == {"status", "url"}


def test_empty(spark):
    f, lines = spark.createDataFrame([], FILES), spark.createDataFrame([], LINES)
    assert drift.drift(f, lines).count() == 0
    assert drift.records(f, lines).count() == 0


def brute(files, lines):
    names = {a: k for k, v in drift.ALIASES.items() for a in (*v, k)}

    def kind(v):
        for name, p in (("integer", r"[+-]?\d+"), ("decimal", r"[+-]?(\d+|\d*\.\d+)"), ("date", r"\d{4}-\d\d-\d\d")):
            if v and all(re.fullmatch(p, x) for x in v):
                return name
        return "text" if v else None

    def schema(m):
        ls = [x.replace("\ufeff", "") for _, x in sorted(lines.get(m, []))]
        ls = [x for x in ls if x.strip() and not x.strip().startswith("#")]
        if not ls:
            return {}
        d = max(",;\t|", key=ls[0].count)
        head = [x.strip().lower() for x in next(csv.reader([ls[0]], delimiter=d))]
        vs = {x: [] for x in head}
        for x in ls[1:]:
            cells = next(csv.reader([x], delimiter=d))
            if [c.strip().lower() for c in cells] != head:
                for a, b in zip(head, cells):
                    if b.strip():
                        vs[a].append(b.strip())
        return {names.get(x, x): (x, kind(vs[x])) for x in head}

    out, last = set(), {}
    for m, folder, at in sorted(files, key=lambda x: (x[1], x[2], x[0])):
        now = schema(m)
        if folder in last:
            was = last[folder]
            out |= {(m, k, "added") for k in now.keys() - was.keys()} | {(m, k, "removed") for k in was.keys() - now.keys()}
            for k in now.keys() & was.keys():
                if k in drift.FIELDS and now[k][0] != was[k][0]:
                    out.add((m, k, "renamed"))
                if now[k][1] and was[k][1] and now[k][1] != was[k][1]:
                    out.add((m, k, "type_changed"))
        last[folder] = now
    return out


def test_against_brute_force(spark):
    f, lines = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("manifest_files", "manifest_lines"))
    by = {}
    for m, n, x in lines.select("manifest_id", "line_no", "line_text").distinct().collect():
        by.setdefault(m, []).append((n, x or ""))
    want = brute({tuple(r) for r in f.select("manifest_id", "folder", "collected_at").collect()}, by)
    assert {tuple(r) for r in drift.drift(f, lines).collect()} == want
