"""Readers of the engine's own documents and of tables about projects, functions and weaknesses."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyvane.functions.findings import category_code, name_candidates
from tallyvane.operators.ranks import running_number
from tallyvane.sources.array_files import read_texts

REPORT = """struct<summary:struct<tools:int,completed:int,failed:int,timeout:int,unavailable:int,findings:int>,
 tools:array<struct<tool:string,status:string,exit_code:int,findings:bigint,raw_output:string,stderr:string,message:string,duration_seconds:double>>,
 findings:array<struct<tool:string,filename:string,line:int,cwe:string,rule:string,message:string>>>"""
METADATA = "map<string,struct<name:string,url:string,class:string,source_files:bigint,loc:bigint,functions:bigint,folders:array<string>>>"
PROJECTS = "name string, url string, folders array<string>"
CTAG = "_type string, name string, path string, kind string, scope string, line int, end int"
RULE = "struct<unique_cwes:array<string>,tot_vulns:bigint,vulns_per_cwe:map<string,bigint>>"
RULES = ["one_out_of_four", "two_out_of_four", "three_out_of_four", "four_out_of_four", "two_out_four_no_cwe", "three_out_four_no_cwe", "four_out_four_no_cwe"]
SUMMARY = f"array<map<string,struct<LOC:bigint,functions:bigint,hits_per_tool:map<string,bigint>,{','.join(f'{r}:{RULE}' for r in RULES)}>>>"

# Suffixes of C and C++ files, and folders that hold no project code.
CODE_SUFFIXES = [".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hh", ".hxx", ".ixx", ".cppm", ".hppm"]
SKIPPED_FOLDERS = [
    "android", "java", "node_modules", "python", "site-packages", ".venv", "env", "build", "cmake-build-debug",
    "cmake-build-release", "out", "bin", "obj", "x64", "x86", "arm", "arm64", ".vs", "artifacts", "vcpkg_installed",
    ".conan", "third_party", "thirdparty", "external", "deps", ".git", ".github", ".idea", ".vscode", "docs",
    "documentation", "html", "site", "assets", "images", "media", "tests", "test", "testing", "benchmarks", "perf",
]


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(PROJECTS).json(path, multiLine=True)
    return rows.withColumn("folders", F.coalesce("folders", F.expr("cast(array() as array<string>)")))


def is_source_file(path: Column) -> Column:
    """True for C and C++ files that no skipped folder holds, whatever the case of the names."""
    folders = F.transform(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.lower)
    suffix = F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(\.[^.]+)$", 1))
    return suffix.isin(CODE_SUFFIXES) & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS)))


def read_source_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the code files under path; the suffixes and folders are tested before any text is looked at."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    relative = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + path.rstrip("/").replace(".", r"\.") + "/", "")
    return rows.select(relative.alias("path"), F.col("value").alias("text")).where(is_source_file(F.col("path")))


def parse_reports(raw: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Add `report`; malformed JSON is an error if strict, else null."""
    return raw.withColumn("report", F.from_json("raw", REPORT, {"mode": "FAILFAST" if strict else "PERMISSIVE"})).select(*keys, "report")


def report_findings(reports: DataFrame, keys: list[str]) -> DataFrame:
    return reports.select(*keys, F.posexplode("report.findings").alias("finding_idx", "x")).select(*keys, "finding_idx", "x.*")


def report_runs(reports: DataFrame, keys: list[str]) -> DataFrame:
    return reports.select(*keys, F.posexplode("report.tools").alias("ord", "x")).select(*keys, "ord", "x.*")


def parse_metadata(raw: DataFrame, keys: list[str]) -> DataFrame:
    """One row per project of an object keyed by project; entries that are no objects are left out."""
    return raw.select(*keys, F.explode(F.from_json("raw", METADATA)).alias("project", "m")).where("m is not null").select(*keys, "project", "m.loc", "m.functions", "m.source_files", "m.folders")


def parse_class_summary(raw: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, project, LOC, functions, hits, rule, tot_vulns, vulns_per_cwe) from a list of objects with one key each."""
    items = raw.select(*keys, F.explode(F.from_json("raw", SUMMARY)).alias("item")).where(F.size("item") == 1)
    rows = items.select(*keys, F.explode("item").alias("project", "s"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"s.{r}").alias("v")) for r in RULES))
    rows = rows.select(*keys, "project", F.col("s.LOC").alias("loc"), "s.functions", F.col("s.hits_per_tool").alias("hits"), F.explode(rules).alias("x"))
    return rows.where("x.v is not null").select(*keys, "project", "loc", "functions", "hits", "x.rule", "x.v.tot_vulns", "x.v.vulns_per_cwe")


def cluster_file_counts(raw: DataFrame) -> DataFrame:
    """(class_name, project, rule, clusters) from files named <project>_<rule>.json; what is no list counts 0."""
    rule = F.regexp_extract("file", rf"_({'|'.join(RULES)})\.json$", 1)
    project = F.regexp_extract("file", rf"^(.*)_(?:{'|'.join(RULES)})\.json$", 1)
    size = F.when(F.startswith(F.ltrim("raw"), F.lit("[")), F.json_array_length("raw"))
    return raw.select("class_name", project.alias("project"), rule.alias("rule"), F.coalesce(size, F.lit(0)).cast("long").alias("clusters")).where("rule <> ''")


CLUSTER = """cluster_id int, rule string, tools array<string>, cwes array<string>, representative_cwe string,
 findings array<struct<tool:string,filename:string,line:int,cwe:string,function:string>>"""


def _decoded(name: Column) -> Column:
    """What a file's or folder's name stands for, from how paths are shown; see array_files.file_name."""
    shown = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    for escaped, plain in (("%3A", ":"), ("%2F", "/"), ("%25", "%")):
        shown = F.replace(shown, F.lit(escaped), F.lit(plain))
    return shown


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """The clusters in files path/<class>/<project>_<rule>.json, a row for each element; an empty array has none, and what is no
    JSON is one row of nulls."""
    project = F.regexp_extract("file", rf"^(.*)_(?:{'|'.join(RULES)})\.json$", 1).alias("project")
    kind = f"array<struct<{re.sub(r'(\w+) (int|string|array)', r'\1:\2', CLUSTER)}>>"
    nothing = F.when(F.trim("raw") != "", F.array(F.lit(None))).cast(kind)
    rows = read_texts(spark, path).select(F.col("folder").alias("class_name"), project, F.coalesce(F.from_json("raw", kind), nothing).alias("found"))
    return rows.where("project <> ''").select("class_name", "project", F.explode("found").alias("c")).select("class_name", "project", "c.*")


def read_cluster_counts(spark: SparkSession, path: str) -> DataFrame:
    """(class_name, project, rule, clusters) of the same files, empty ones included; see cluster_file_counts."""
    return cluster_file_counts(read_texts(spark, path).withColumnRenamed("folder", "class_name"))


def read_class_summaries(spark: SparkSession, path: str) -> DataFrame:
    """parse_class_summary of the files path/<class>.json."""
    rows = spark.read.text(f"{path}/*.json", wholetext=True)
    return parse_class_summary(rows.select(F.regexp_replace(_decoded(F.col("_metadata.file_name")), r"\.json$", "").alias("class_name"), F.col("value").alias("raw")), ["class_name"])


def parse_ctags(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Function spans from JSON lines in the column `line`; other tags, and lines without name, path or line, are left out."""
    tags = lines.select(*keys, F.from_json("line", CTAG).alias("t")).where("t._type = 'tag' and t.kind = 'function' and t.name is not null and t.path is not null and t.line > 0")
    end = F.greatest("t.line", F.coalesce("t.end", "t.line"))
    return tags.select(*keys, F.col("t.path").alias("filename"), "t.name", "t.scope", F.col("t.line").alias("start_line"), end.alias("end_line"))


def read_ctags(spark: SparkSession, path: str) -> DataFrame:
    return parse_ctags(spark.read.text(path).withColumnRenamed("value", "line"), [])


RELATED = "Related_Weaknesses struct<Related_Weakness:array<struct<_Nature:string,_CWE_ID:int,_View_ID:int>>>"
HAS_MEMBER = "struct<Has_Member:array<struct<_Nature:string,_CWE_ID:int,_View_ID:int>>>"
CATALOG = {"Weakness": f"_ID int, _Name string, {RELATED}", "Category": f"_ID int, _Name string, Relationships {HAS_MEMBER}", "View": f"_ID int, _Name string, Members {HAS_MEMBER}"}


def read_cwe_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """catalog_tables of the XML files under path, in the order of their names."""
    found = {}
    for tag, schema in CATALOG.items():
        rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
        # A file may be read in blocks, each by one task from its beginning on.
        found[tag] = rows.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("nth")).alias("at"))
    return catalog_tables(found)


def parse_cwe_catalog(raw: DataFrame, file: str | None = None) -> dict[str, DataFrame]:
    """catalog_tables of XML texts in the column raw, in the order of the column `file`, or of the texts' hashes."""
    element = lambda tag: F.lit(rf'(?s)<{tag}\s(?:[^>"]|"[^"]*")*?(?:/>|>.*?</{tag}>)')
    texts = raw.select("raw", (F.col(file) if file else F.xxhash64("raw")).alias("file"))
    found = {tag: texts.select("file", F.posexplode(F.regexp_extract_all("raw", element(tag), F.lit(0))).alias("nth", "x")) for tag in CATALOG}
    return catalog_tables({tag: rows.select(F.from_xml("x", CATALOG[tag]).alias("e"), F.struct("file", "nth").alias("at")).select("e.*", "at") for tag, rows in found.items()})


def catalog_tables(elements: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """weaknesses(cwe, name, kind, seq), parents(child, parent, nature, view_id, ord, kind, seq), members(owner, member,
    view_id, ord, kind, seq).

    Parents are the ChildOf links of weaknesses, and those among the members of categories; ord is the place in the list,
    kind and seq those of the element that states the link. seq numbers the elements of all files in one order: weaknesses
    before categories before views, and each kind by `at`, which orders files and what is in them.
    """
    kinds = {"Weakness": ("weakness", "Related_Weaknesses.Related_Weakness"), "Category": ("category", "Relationships.Has_Member"), "View": ("view", "Members.Has_Member")}
    link = "array<struct<_Nature:string,_CWE_ID:int,_View_ID:int>>"
    parts = [elements[tag].select(F.lit(k).alias("part"), "at", F.col("_ID").alias("cwe"), F.col("_Name").alias("name"), F.lit(kind).alias("kind"), F.col(field).cast(link).alias("links")) for k, (tag, (kind, field)) in enumerate(kinds.items())]
    rows = running_number(reduce(DataFrame.union, parts).where("cwe is not null"), [], ["part", "at"], "seq")
    links = rows.select("cwe", "kind", "seq", F.posexplode("links").alias("ord", "r"))
    parents, members = links.where("kind <> 'view' and r._Nature = 'ChildOf'"), links.where("kind <> 'weakness'")
    rest = (F.col("r._View_ID").alias("view_id"), "ord", "kind", "seq")
    return {
        "weaknesses": rows.select("cwe", "name", "kind", "seq"),
        "parents": parents.select(F.col("cwe").alias("child"), F.col("r._CWE_ID").alias("parent"), F.col("r._Nature").alias("nature"), *rest),
        "members": members.select(F.col("cwe").alias("owner"), F.col("r._CWE_ID").alias("member"), *rest),
    }


def kernel_taxonomy(rows: DataFrame) -> DataFrame:
    """(project, folders) of marked rows (row_no, project, folder, marker); a blank project repeats the one above.

    The forward fill needs one order over the sheet, which is a hand-made table of a few hundred rows.
    """
    above = Window.orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("project", F.last(F.nullif(F.trim("project"), F.lit("")), True).over(above))
    marked = filled.where((F.upper(F.trim("marker")) == "X") & F.col("project").isNotNull())
    return marked.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "folder"))), lambda x: x["folder"]).alias("folders"))


def application_taxonomy(rows: DataFrame) -> DataFrame:
    """(key, code, category, subcategory): for each name that a repository may go by, the first row (by row_no) wins.

    Rows without repository or category are left out.
    """
    cell = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = rows.select(cell("repo").alias("repo"), cell("category").alias("category"), cell("subcategory").alias("subcategory"), "row_no").where("repo <> '' and category <> ''")
    named = rows.select(F.explode(name_candidates(F.col("repo"))).alias("key"), "category", "subcategory", "row_no")
    first = named.groupBy("key").agg(F.min_by(F.struct("category", "subcategory"), "row_no").alias("x"))
    return first.select("key", category_code(F.col("x.category")).alias("code"), "x.category", "x.subcategory")


def ordered_names(found: list[DataFrame], column: str, fixed: list[str]) -> DataFrame:
    """(name, place): the distinct names of all tables, the fixed ones first in their order, then the rest alphabetically."""
    names = found[0].select(F.col(column).alias("name"))
    for rows in found[1:]:
        names = names.union(rows.select(column))
    place = F.array_position(F.array(*map(F.lit, fixed)), F.col("name"))
    names = names.where("name is not null").distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy(F.when(place > 0, place).otherwise(len(fixed) + 1), F.lower("name"), "name")))


def parse_projects(raw: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, name, url, folders) of project lists in the column raw; missing folders are an empty list."""
    rows = raw.select(*keys, F.posexplode(F.from_json("raw", f"array<struct<{PROJECTS.replace(' ', ':').replace(',:', ',')}>>")).alias("place", "p"))
    return rows.select(*keys, "place", "p.name", "p.url", F.coalesce("p.folders", F.expr("cast(array() as array<string>)")).alias("folders"))
