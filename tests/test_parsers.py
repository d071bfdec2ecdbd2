from __future__ import annotations

import csv
import json
import pickle
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyvane.functions import findings as fn
from tallyvane.operators import clusters, corpus, density, hierarchy, stats
from tallyvane.sources import analyzers, documents, sinks

KEYS = ["class_name", "project"]


def raw(spark, *texts):
    return spark.createDataFrame([("kernel", f"p{k}", t) for k, t in enumerate(texts)], "class_name string, project string, raw string")


def rows(df):
    return [(r["filename"], r["line"], r["cwe"], r["rule"], r["message"]) for r in df.orderBy("project", "run", "pos").collect()]


def test_sarif(spark):
    spot = lambda uri, line: {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line}}}
    doc = {"runs": [{"tool": {"driver": {"rules": [{"id": "a", "properties": {"tags": ["external/cwe/cwe-020"]}}, {"id": "a", "properties": {"tags": ["x", "external/cwe/cwe-022", "external/cwe/cwe-023"]}}]}},
                     "results": [{"ruleId": "a", "message": {"text": "m"}, "locations": [spot("f.c", 3), spot("g.c", 4)]},
                                 {"ruleId": "a", "message": {"text": "m"}, "properties": {"tags": ["xCWE-7", "CWE-77"]}, "locations": [spot("f.c", 0)]},
                                 {"ruleId": "b", "message": {"text": "CWE-119!/CWE-120"}, "locations": []}]}]}
    got = rows(analyzers.parse_sarif(raw(spark, "tool 1.0\n" + json.dumps(doc), "", "{bad", None), KEYS, F.lit("codeql")))
    assert got == [("f.c", 3, "CWE-022", "a", "m"), ("f.c", None, "CWE-77", "a", "m"), (None, None, "CWE-119", "b", "CWE-119!/CWE-120")]


def test_semgrep_takes_text_and_lists(spark):
    item = lambda cwe: {"path": "a.c", "check_id": "r", "start": {"line": 2}, "extra": {"message": "m", "metadata": {"cwe": cwe}}}
    doc = {"results": [item("CWE-78: x"), item(["CWE-79: y", "CWE-80"]), item(22), item(None)]}
    got = rows(analyzers.parse_semgrep(raw(spark, json.dumps(doc)), KEYS))
    assert [g[2] for g in got] == ["CWE-78", "CWE-79", "CWE-22", None] and got[0][:2] == ("a.c", 2)


XML = """Checking a.c ...
<?xml version="1.0"?><results version="2"><errors>
<error id="x" severity="style" msg="m &gt; n" verbose="v" cwe="398"><location file="a.c" line="5"/><location file="b.c" line="6"/></error>
<error id="y" severity="style" verbose="only"/>
<error id="z" severity="style" msg="cut"""


def test_cppcheck_keeps_complete_elements(spark, tmp_path):
    want = [("a.c", 5, "CWE-398", "x", "m > n"), (None, None, None, "y", "only")]
    assert rows(analyzers.parse_cppcheck(raw(spark, XML), KEYS)) == want
    (tmp_path / "kernel" / "p").mkdir(parents=True)
    (tmp_path / "kernel" / "p" / "stderr.txt").write_text(XML)
    got = analyzers.read_cppcheck(spark, str(tmp_path)).collect()
    assert sorted((r["filename"] or "", r["line"], r["cwe"], r["rule"]) for r in got) == [("", None, None, "y"), ("a.c", 5, "CWE-398", "x")]


def test_ikos(spark):
    doc = {"files": [{"id": 1, "path": "a.c"}], "statements": [{"id": 9, "file_id": 1, "line": 12}],
           "checks": [{"status": 1, "check": 4, "statement_id": 9}, {"status": "error", "kind": "Double_Free", "location": {"file": "b.c", "line": 3}, "message": "mm"},
                      {"status": "safe", "check": "boa"}, {"status": "unreachable", "rule_id": ""}]}
    got = rows(analyzers.parse_ikos(raw(spark, json.dumps(doc)), KEYS))
    assert got == [("a.c", 12, "CWE-369", "division-by-zero", "IKOS finding: division-by-zero"), ("b.c", 3, "CWE-415", "free", "mm"), (None, None, None, "ikos.unknown", "IKOS finding: ikos.unknown")]


def test_ikos_takes_repeated_and_missing_ids(spark):
    checks = [{"status": 1, "check": 4, "statement_id": k} for k in (9, 8, 7)] + [{"status": 1, "check": 4, "location": {"file": "own.c", "line": 4}}]
    doc = {"files": [{"id": 1, "path": "old.c"}, {"path": "none.c"}, {"id": 1, "path": "new.c"}], "checks": checks,
           "statements": [{"id": 9, "file_id": 1, "line": 1}, {"file_id": 1, "line": 2}, {"id": 9, "file_id": 1, "line": 3}, {"id": 8, "file_id": 5, "line": 6}]}
    got = rows(analyzers.parse_ikos(raw(spark, json.dumps(doc), "", "{bad", None), KEYS))
    assert [g[:2] for g in got] == [("new.c", 3), (None, 6), (None, None), ("own.c", 4)]
    two = analyzers.parse_ikos(raw(spark, json.dumps(doc), json.dumps(doc | {"files": []})).withColumn("project", F.lit(None).cast("string")), KEYS)
    assert sorted(str(r["filename"]) for r in two.collect()) == ["None"] * 5 + ["new.c", "own.c", "own.c"]


def test_output_folders(spark, tmp_path):
    (tmp_path / "kernel" / "p1" / "semgrep").mkdir(parents=True)
    (tmp_path / "kernel" / "p1" / "semgrep" / "stdout.json").write_text('{"results":\n []}\n')
    (row,) = analyzers.read_outputs(spark, str(tmp_path)).collect()
    assert (row["class_name"], row["project"], row["file"]) == ("kernel", "p1", "stdout.json") and row["raw"] == '{"results":\n []}\n' and row["folder"] == "semgrep"


def test_scalar_functions(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]
    assert [one(x, fn.first_cwe) for x in ("79", "see cwe_079", "none", '["a", "CWE 12"]', None)] == ["CWE-79", "CWE-079", None, "CWE-12", None]
    assert [one(x, fn.canonical_cwe) for x in ("xCWE-0007y", "cwe 12345", "7", None)] == ["CWE-007", "CWE-12345", None, None]
    assert [one(x, fn.cwe_number) for x in ("CWE-079", "007", "cwe_5", "0", "x")] == [79, 7, 5, 0, None]
    assert [one(x, fn.positive_line) for x in ("5", "0", "-1", "x", None)] == [5, None, None, None, None]
    path = lambda x: one(x, lambda c: fn.normalize_path(c, F.lit("kernel"), F.lit("wrk")))
    given = ["/workspace/src/./a/../b.c", "file:///dataset/kernel/wrk/x.c", "C:\\work\\wrk\\src\\a.c", "/a/wrk/b/wrk/c.c", "wrk/./d.c", "/workspace", "../../e.c", "./", "/workspacefoo/x.c"]
    assert [path(x) for x in given] == ["src/b.c", "x.c", "src/a.c", "c.c", "d.c", "", "../../e.c", "", "foo/x.c"]
    assert one("Owner/Repo-src", fn.name_candidates) == ["owner/repo-src", "repo-src", "owner", "repo"]
    code = 'a = "//no"; // yes\nb = \'"\'; /* x\ny */ c /* open'
    assert one(code, fn.strip_comments) == 'a = "//no";  \nb = \'"\';   c /* open'
    for text, want in (("int a; /* open\nint b;", "int a; /* open\nint b;"), ("#error don't\nx; // c\ny = 'z';", "#error don't\nx; // c\ny = 'z';"), ('s = "a\n// b";', 's = "a\n// b";')):
        assert one(text, fn.strip_comments) == want
    strange = spark.createDataFrame([("a /\u00e9/ b\n \n\nc",)], "text string")
    assert corpus.clean_code(strange).first()[0] == "a  \nc"
    assert one(" a\n \n\n b\n", fn.collapse_blank_lines) == "a\n b"
    assert one("é{x", lambda c: fn.payload(c, "{")) == "{x" and one("none", lambda c: fn.payload(c, "{")) is None


def test_source_files(spark, tmp_path):
    names = ["src/a.C", "Tests/b.c", "lib/c.tar.hpp", "x/d.py", "e", "vcpkg_installed/f.h"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("int x;\nint y;\n")
    got = documents.read_source_files(spark, str(tmp_path)).collect()
    assert {r["text"] for r in got} == {"int x;\nint y;\n"}
    assert sorted(r["path"] for r in got) == ["lib/c.tar.hpp", "src/a.C"]


def test_documents(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"name": "a", "url": "u"}, {"name": "b", "url": "v", "folders": ["x"]}]')
    assert [(r["name"], r["folders"]) for r in documents.read_projects(spark, str(tmp_path / "p.json")).collect()] == [("a", []), ("b", ["x"])]
    report = '{"summary": {"tools": 1}, "tools": [{"tool": "t", "status": "completed"}], "findings": [{"tool": "t", "line": 3}]}'
    parsed = documents.parse_reports(raw(spark, report, "{bad"), KEYS)
    assert documents.report_findings(parsed, KEYS).count() == 1 and documents.report_runs(parsed, KEYS).first()["status"] == "completed"
    with pytest.raises(Exception, match="MALFORMED"):
        documents.parse_reports(raw(spark, "{bad"), KEYS, strict=True).collect()
    meta = documents.parse_metadata(raw(spark, '{"a": {"loc": 5}, "b": null}'), ["class_name"]).collect()
    assert [(r["project"], r["loc"]) for r in meta] == [("a", 5)]
    files = spark.createDataFrame([("kernel", "my_lib_two_out_of_four.json", "[{},{}]"), ("kernel", "x_four_out_four_no_cwe.json", "{}"), ("kernel", "other.json", "[]")], "class_name string, file string, raw string")
    assert sorted((r["project"], r["rule"], r["clusters"]) for r in documents.cluster_file_counts(files).collect()) == [("my_lib", "two_out_of_four", 2), ("x", "four_out_four_no_cwe", 0)]
    (tmp_path / "tags.json").write_text('{"_type":"tag","name":"f","path":"a.c","kind":"function","line":5,"end":3}\n{bad\n')
    assert [(r["start_line"], r["end_line"]) for r in documents.read_ctags(spark, str(tmp_path / "tags.json")).collect()] == [(5, 5)]


CATALOG = """<Weakness_Catalog><Weaknesses>
<Weakness ID="110" Name="Child"><Related_Weaknesses><Related_Weakness Nature="ChildOf" CWE_ID="100" View_ID="1000"/><Related_Weakness Nature="PeerOf" CWE_ID="5" View_ID="1000"/></Related_Weaknesses></Weakness>
<Weakness ID="100" Name="Top"/></Weaknesses>
<Categories><Category ID="7" Name="Cat"><Relationships><Has_Member CWE_ID="110" View_ID="699"/><Has_Member Nature="ChildOf" CWE_ID="9" View_ID="699"/></Relationships></Category></Categories>
<Views><View ID="1000" Name="View"><Members><Has_Member CWE_ID="100" View_ID="1000"/></Members></View></Views></Weakness_Catalog>"""


def test_cwe_catalog(spark, tmp_path):
    (tmp_path / "cwe.xml").write_text(CATALOG)
    text = spark.createDataFrame([(CATALOG,), ("",), (None,), ("<Weakness",)], "raw string")
    for tables in (documents.read_cwe_catalog(spark, str(tmp_path / "cwe.xml")), documents.parse_cwe_catalog(text)):
        assert sorted(tuple(r) for r in tables["weaknesses"].collect()) == [(7, "Cat", "category", 3), (100, "Top", "weakness", 2), (110, "Child", "weakness", 1), (1000, "View", "view", 4)]
        assert sorted(tuple(r) for r in tables["parents"].collect()) == [(7, 9, "ChildOf", 699, 1, "category", 3), (110, 100, "ChildOf", 1000, 0, "weakness", 1)]
        assert sorted(tuple(r) for r in tables["members"].collect()) == [(7, 9, 699, 1, "category", 3), (7, 110, 699, 0, "category", 3), (1000, 100, 1000, 0, "view", 4)]


def test_catalog_order_over_files(spark, tmp_path):
    """Elements of many files have one order, by file and place; the first parent follows from it."""
    rng = random.Random(3)
    folder, texts, ids = tmp_path / "catalog", [], [*range(1, 301)]
    folder.mkdir()
    rng.shuffle(ids)
    for k in range(6):
        own = ids[k * 50 : (k + 1) * 50]
        weak = "\n".join(f'<Weakness ID="{i}" Name="w"><Related_Weaknesses><Related_Weakness Nature="ChildOf" CWE_ID="{i + 1000}" View_ID="{1000 if i % 2 else 5}"/></Related_Weaknesses></Weakness>' for i in own)
        cats = "\n".join(f'<Category ID="{i + 5000}" Name="c"><Relationships><Has_Member CWE_ID="{m}"/></Relationships></Category>' for i in own[:5] for m in (7,))
        texts.append(f"<Weakness_Catalog><Weaknesses>{weak}</Weaknesses><Categories>{cats}</Categories></Weakness_Catalog>")
        (folder / f"part-{k}.xml").write_text(texts[-1])
    listed = spark.createDataFrame([(f"part-{k}", t) for k, t in enumerate(texts)], "name string, raw string").repartition(4)
    wanted = [*ids, *(i + 5000 for k in range(6) for i in ids[k * 50 : k * 50 + 5])]
    for tables in (documents.read_cwe_catalog(spark, str(folder)), documents.parse_cwe_catalog(listed, "name")):
        rows = tables["weaknesses"].orderBy("seq").collect()
        assert [r["cwe"] for r in rows] == wanted and [r["seq"] for r in rows] == list(range(1, len(wanted) + 1))
        parents = hierarchy.root_parents(tables["parents"], tables["members"])
        first = {r["node"]: r["next"] for r in hierarchy.first_parents(parents).collect()}
        assert first == {i: i + 1000 for i in ids if i % 2} and sorted(r["parent"] for r in parents.where("child = 7").collect()) == sorted([1007, *(i + 5000 for k in range(6) for i in ids[k * 50 : k * 50 + 5])])


def test_taxonomy(spark):
    sheet = spark.createDataFrame([(1, "a", "x", "X"), (2, "", "y", ""), (3, None, "z", " x"), (4, "b", "w", "x")], "row_no int, project string, folder string, marker string")
    assert {r["project"]: r["folders"] for r in documents.kernel_taxonomy(sheet).collect()} == {"a": ["x", "z"], "b": ["w"]}
    apps = spark.createDataFrame([(2, "O/R", "late", "s"), (1, " o/r", "first", "s")], "row_no int, repo string, category string, subcategory string")
    assert sorted(tuple(r) for r in documents.application_taxonomy(apps).collect()) == [(k, "first", "first", "s") for k in ("o", "o/r", "r")]


def cluster(project, rule, number, cwes, top, *findings):
    return ("kernel", project, rule, number, ["codeql", "semgrep"], cwes, top, [("codeql", "f.c", line, "CWE-100", None) for line in findings])


CLUSTER = "class_name string, project string, rule string, cluster_id int, tools array<string>, cwes array<int>, representative int, findings array<struct<tool:string,filename:string,line:int,cwe:string,function:string>>"


def test_cluster_documents(spark, tmp_path):
    """One array for each project and rule, in order, also where a name is odd, written twice, or has nothing."""
    rows = [cluster("a:b c++", "two_out_of_four", k, [20, 7], 7 if k % 2 else None, k) for k in range(1, 41)] + [cluster("x", "four_out_of_four", 1, [100], 100), cluster("x", "unlisted", 1, [100], 100)]
    found = spark.createDataFrame(rows, CLUSTER).repartition(5)
    projects = spark.createDataFrame([("kernel", "a:b c++"), ("kernel", "x"), ("application", "y")], "class_name string, project string")
    for _ in range(2):
        sinks.write_clusters(found, str(tmp_path / "out"), projects, ["two_out_of_four", "four_out_of_four"])
    names = sorted(p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith("."))
    assert names == [f"{c}/{p}_{r}_out_of_four.json" for c, p in (("application", "y"), ("kernel", "a%3Ab c++"), ("kernel", "x")) for r in ("four", "two")]
    docs = {n: json.loads((tmp_path / "out" / n).read_text()) for n in names}
    assert docs["application/y_two_out_of_four.json"] == [] and docs["kernel/x_four_out_of_four.json"][0]["findings"] == []
    many = docs["kernel/a%3Ab c++_two_out_of_four.json"]
    assert [d["cluster_id"] for d in many] == list(range(1, 41))
    assert many[0] == {"cluster_id": 1, "rule": "two_out_of_four", "tools": ["codeql", "semgrep"], "cwes": ["CWE-020", "CWE-007"], "representative_cwe": "CWE-007",
                       "findings": [{"tool": "codeql", "filename": "f.c", "line": 1, "cwe": "CWE-100", "function": None}]}
    assert many[1]["representative_cwe"] is None and list(many[0]) == ["cluster_id", "rule", "tools", "cwes", "representative_cwe", "findings"]
    back = documents.read_clusters(spark, str(tmp_path / "out")).collect()
    assert sorted((r["class_name"], r["project"], r["rule"], r["cluster_id"]) for r in back) == sorted(("kernel", p, r, k) for _, p, r, k, *_ in rows if r != "unlisted")
    counts = {(r["class_name"], r["project"], r["rule"]): r["clusters"] for r in documents.read_cluster_counts(spark, str(tmp_path / "out")).collect()}
    assert len(counts) == 6 and counts["kernel", "a:b c++", "two_out_of_four"] == 40 and counts["application", "y", "two_out_of_four"] == 0


def test_class_documents(spark, tmp_path):
    key = "class_name string, project string"
    summary = spark.createDataFrame([("kernel", "b", "two_out_of_four", 1000, 2, 3, "CWE-1000"), ("kernel", "b", "two_out_of_four", 99, 1, 3, "CWE-099")], key + ", rule string, number int, n long, tot_vulns long, cwe string")
    hits = spark.createDataFrame([("kernel", "b", "codeql", 4)], key + ", tool string, hits long")
    sizes = spark.createDataFrame([("kernel", "b", 10, None), ("kernel", "a", None, 5), ("application", "c", 1, 2)], key + ", loc long, functions long")
    sinks.write_summaries(clusters.project_documents(summary, hits, sizes), str(tmp_path))
    got = json.loads((tmp_path / "kernel.json").read_text())
    assert [list(d) for d in got] == [["a"], ["b"]] and sorted(p.name for p in tmp_path.glob("*.json")) == ["application.json", "kernel.json"]
    own, nothing = got[1]["b"], {"unique_cwes": [], "tot_vulns": 0, "vulns_per_cwe": {}}
    assert (own["LOC"], own["functions"], own["hits_per_tool"]) == (10, 0, {"codeql": 4, "cppcheck": 0, "flawfinder": 0, "semgrep": 0})
    assert own["two_out_of_four"] == {"unique_cwes": ["CWE-099", "CWE-1000"], "tot_vulns": 3, "vulns_per_cwe": {"CWE-099": 1, "CWE-1000": 2}}
    assert list(own)[3:] == documents.RULES and all(own[r] == nothing for r in documents.RULES if r != "two_out_of_four") and got[0]["a"]["one_out_of_four"] == nothing
    back = documents.read_class_summaries(spark, str(tmp_path)).where("rule = 'two_out_of_four'").orderBy("project").collect()
    assert [(r["class_name"], r["project"], r["tot_vulns"], r["vulns_per_cwe"]) for r in back] == [("kernel", "a", 0, {}), ("kernel", "b", 3, {"CWE-099": 1, "CWE-1000": 2}), ("application", "c", 0, {})]


def test_numbers_in_tables(spark, tmp_path):
    values = [1e-15, 1234567.123456789, 1e20, 0.1, 2.5, 100.0, 1e-5, 123456789012345.0, -0.0, None, 1 / 3]
    rows = spark.createDataFrame([(k, v, v) for k, v in enumerate(values)], "k int, `a b` double, c double").coalesce(1)
    sinks.write_table(rows, str(tmp_path / "t"), {"c": 3})
    (file,) = (tmp_path / "t").glob("*.csv")
    lines = file.read_text().splitlines()
    assert lines[0] == "k,a b,c"
    assert lines[1:] == [f"{k}," + ("" if v is None else f"{v:.12g}") + "," + ("" if v is None else f"{v:.3f}") for k, v in enumerate(values)]


def test_comparison_table(spark, tmp_path):
    shares = [(f"CWE-{c}", f"p{k}", "kernel" if k < 6 else "application", float((k * c) % 7)) for c in (3, 5, 9) for k in range(15)]
    tested = stats.compare_classes(spark.createDataFrame(shares, "cwe string, project string, class_name string, share double"))
    intervals = spark.createDataFrame([("CWE-3", 0.01, 1.0, -0.5, 1 / 3)], "cwe string, p_low double, p_high double, delta_low double, delta_high double")
    names = spark.createDataFrame([("CWE-3", "Three, or so")], "cwe string, name string")
    sinks.write_table(stats.comparison_table(tested, intervals, names).coalesce(1), str(tmp_path / "t"), stats.COMPARISON_DIGITS)
    (file,) = (tmp_path / "t").glob("*.csv")
    header, *rows = csv.reader(file.open())
    assert ",".join(header) == "ID,Name,Mann-Whitney U,p-value,p-value CI low,p-value CI high,q-value (BY),Cliff's delta,delta CI low,delta CI high,Cliff's interpretation,Dominance,kernel mean %,application mean %"
    want = {r["cwe"]: r for r in tested.collect()}
    assert [r[0] for r in rows] == sorted(want, key=lambda c: (want[c]["p"], -abs(want[c]["delta"]), c))
    own, r = next(r for r in rows if r[0] == "CWE-3"), want["CWE-3"]
    assert own == ["CWE-3", "Three, or so", f"{r['u']:.6f}", f"{r['p']:.12g}", "0.01", "1", f"{r['q']:.12g}", f"{r['delta']:.6f}", "-0.500000", "0.333333", r["label"], r["dominance"], f"{r['mean_1']:.6f}", f"{r['mean_2']:.6f}"]
    assert [r[1:2] + r[4:6] for r in rows if r[0] != "CWE-3"] == [["Unknown", "", ""]] * 2


def test_taxonomy_cells(spark):
    key = "class_name string, project string"
    projects = spark.createDataFrame([("kernel", "Linux", 1), ("kernel", "bsd", 2), ("kernel", "bare", 3), ("application", "App", 4), ("application", "other", 5), ("tool", "App", 6)], key + ", vulns long")
    selection = spark.createDataFrame([(" LINUX", ["a", "b"]), ("app", ["z"])], "project string, folders array<string>")
    apps = documents.application_taxonomy(spark.createDataFrame([(1, "Owner/App-src", "C1 Tools", ""), (2, "x/app", "C2 Late", ""), (3, "", "C3", ""), (4, "other", " ", "")], "row_no int, repo string, category string, subcategory string"))
    meta = spark.createDataFrame([("kernel", "Linux", ["m"]), ("kernel", "bsd", ["q", "", None, "r"]), ("kernel", "bare", None), ("application", "App", ["f"])], key + ", folders array<string>")
    got = {(r["class_name"], r["project"]): (r["taxonomy_code"], r["taxonomy_label"], r["folders"]) for r in density.taxonomy_cells(projects, selection, apps, meta).collect()}
    assert got == {("kernel", "Linux"): ("2 folders", "a, b", ["a", "b"]), ("kernel", "bsd"): ("2 folders", "q, r", ["q", "r"]), ("kernel", "bare"): (None, None, []),
                   ("application", "App"): ("C1", "C1 Tools", []), ("application", "other"): (None, None, []), ("tool", "App"): (None, None, [])}


def test_cppcheck_streams_and_chunks(spark, tmp_path):
    error = lambda i, more="": f'<error id="{i}" msg="m"{more}><location file="a.c" line="{len(i)}"/></error>'
    head = '<?xml version="1.0"?><results version="2"><cppcheck version="2.17"/><errors>'
    texts = {
        "kernel/p/cppcheck/stderr.txt": head + error("err"), "kernel/p/cppcheck/stdout.xml": head + error("out"),
        "kernel/q/cppcheck/chunks/b/stderr.txt": "Checking ...\nno elements", "kernel/q/cppcheck/chunks/b/stdout.xml": "banner\n" + head + error("b1", ' cwe="7"') + error("b22") + '<error id="cut" msg="',
        "kernel/q/cppcheck/chunks/a/stderr.txt": error("a1") + "</errors></results>", "kernel/q/cppcheck/chunks/a/notes.md": "<error id='no'/>",
        "kernel/r/cppcheck/stderr.txt": "",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = analyzers.read_cppcheck(spark, str(tmp_path)).orderBy("project", "pos").collect()
    assert [(r["project"], r["pos"], r["rule"], r["line"]) for r in got] == [("p", 0, "err", 3), ("q", 0, "a1", 2), ("q", 1, "b1", 2), ("q", 2, "b22", 3)]
    chunks = spark.createDataFrame([("kernel", "q", "b", head + error("b1") + "<error"), ("kernel", "q", "a", error("a1")), ("kernel", "s", None, None)], "class_name string, project string, chunk string, raw string")
    merged = {r["project"]: r["raw"] for r in analyzers.merged_cppcheck(chunks, KEYS).collect()}
    assert merged["q"] == '<?xml version="1.0" encoding="UTF-8"?>\n<results version="2"><cppcheck version="2.17" /><errors>' + error("a1") + error("b1") + "</errors></results>"
    assert merged["s"].endswith('<cppcheck version="2" /><errors></errors></results>')
    again = analyzers.parse_cppcheck(spark.createDataFrame([("kernel", "q", merged["q"])], "class_name string, project string, raw string"), KEYS)
    assert [r["rule"] for r in again.orderBy("pos").collect()] == ["a1", "b1"]


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([("kernel", "a", "two_out_of_four", 1.25, None)], "class_name string, project string, rule string, v double, w string")
    sinks.write_table(found, str(tmp_path / "t"))
    assert {line for f in (tmp_path / "t").glob("*.csv") for line in f.read_text().splitlines()} == {"class_name,project,rule,v,w", "kernel,a,two_out_of_four,1.25,"}
    totals = sinks.rule_totals(found, found, ["one_out_of_four", "two_out_of_four"]).collect()
    assert sorted((r["rule"], r["tot_vulns"]) for r in totals) == [("one_out_of_four", 0), ("two_out_of_four", 1)]
    sinks.write_documents(found, str(tmp_path / "d"))
    sinks.write_reports(found.drop("rule"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1


def test_cluster_files_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    """The driver neither names nor lists files: a task's message is its folder, and no reader of Spark is given their paths."""
    from pyspark.sql import DataFrameReader

    from tallyvane.sources import array_files

    out = tmp_path / "out"
    writer = array_files.ArrayWriter(str(out))
    names = [("k", f"{p}_{r}.json") for p in ("a%b", "c/d", "e:f", ".g", "_h") for r in ("two_out_of_four", "four_out_of_four")]
    batch = pa.record_batch([[f for f, _ in names], [n for _, n in names], ["{}"] * len(names)], ["folder", "file", "item"])
    message = writer.write(iter([batch]))
    assert len(pickle.dumps(message)) < 400 and len(pickle.dumps(writer.write(iter([batch.slice(0, 1)])))) == len(pickle.dumps(message))
    writer.commit([message, None])
    assert sorted(p.name for p in out.iterdir()) == ["k"] and len(list((out / "k").iterdir())) == 10
    (out / "k" / "z_two_out_of_four.json").write_text('﻿[{"cluster_id": 3,\n "rule": "two_out_of_four"}]')
    (out / "k" / "y_two_out_of_four.json").write_text("no list")
    for reader in ("json", "text"):
        monkeypatch.setattr(DataFrameReader, reader, lambda *a, **k: pytest.fail("listed"))
    counts = {(r["project"], r["rule"]): r["clusters"] for r in documents.read_cluster_counts(spark, str(out)).collect()}
    assert counts == {(p, r): 1 for p in ("a%b", "c/d", "e:f", ".g", "_h") for r in ("two_out_of_four", "four_out_of_four")} | {("z", "two_out_of_four"): 1, ("y", "two_out_of_four"): 0}
    back = sorted((r["project"], r["cluster_id"]) for r in documents.read_clusters(spark, str(out)).select("project", "cluster_id").where("project in ('y', 'z')").collect())
    assert back == [("y", None), ("z", 3)]
