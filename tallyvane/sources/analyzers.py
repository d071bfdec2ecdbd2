"""Readers of raw analyzer output.

Each parse_* takes rows with identifying columns and one whole raw output in the column `raw`; each read_* loads a folder
of outputs laid out as <class>/<project>/<anything> and parses it. Malformed or empty outputs give no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.functions.findings import first_cwe, payload, positive_line, tag_cwe
from tallyvane.operators.ranks import running_number
from tallyvane.session import cut

SARIF = """struct<runs:array<struct<
 tool:struct<driver:struct<rules:array<struct<id:string,properties:struct<tags:array<string>>>>>>,
 results:array<struct<ruleId:string,message:struct<text:string>,properties:struct<tags:array<string>>,
  locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:string>>>>>>>>>"""
SEMGREP = """struct<results:array<struct<path:string,check_id:string,start:struct<line:string>,
 extra:struct<message:string,metadata:struct<cwe:string>>>>>"""
IKOS_ENTRY = "array<struct<status:string,check:string,kind:string,rule_id:string,message:string,description:string,statement_id:int,location:struct<file:string,line:string>>>"
IKOS = f"""struct<results:{IKOS_ENTRY},checks:{IKOS_ENTRY},reports:{IKOS_ENTRY},
 files:array<struct<id:int,path:string>>,statements:array<struct<id:int,file_id:int,line:int>>>"""
CPPCHECK_ERROR = "_id string, _severity string, _msg string, _verbose string, _cwe string, location array<struct<_file:string,_line:string>>"

# The result and check codes of one analyzer, their other names, and the weaknesses they stand for.
IKOS_STATUS = {"0": "safe", "1": "warning", "2": "error", "3": "unreachable", "ok": "safe", "safe": "safe", "warning": "warning", "error": "error", "unreachable": "unreachable"}
IKOS_NUMBERS = [
    "unreachable", "unexpected-operand", "uninitialized-variable", "assert", "division-by-zero", "shift-count", "begin-int-overflow",
    "signed-int-underflow", "signed-int-overflow", "unsigned-int-underflow", "unsigned-int-overflow", "end-int-overflow",
    "null-pointer-deref", "null-pointer-comparison", "invalid-pointer-comparison", "pointer-comparison", "pointer-overflow",
    "invalid-pointer-deref", "unknown-memory-access", "unaligned-pointer", "begin-buffer-overflow", "buffer-overflow-gets",
    "buffer-overflow", "end-buffer-overflow", "begin-soundness", "ignored-store", "ignored-memory-copy", "ignored-memory-move",
    "ignored-memory-set", "ignored-free", "ignored-call-side-effect-pointer-param", "ignored-call-side-effect",
    "recursive-function-call", "end-soundness", "begin-function-call", "function-call-inline-asm",
    "unknown-function-call-pointer", "function-call", "end-function-call", "free",
]
IKOS_ALIASES = {
    "boa": "buffer-overflow", "buffer-overflow-checker": "buffer-overflow", "dbz": "division-by-zero", "dfa": "free",
    "double-free": "free", "nullity": "null-pointer-deref",
}
IKOS_WEAKNESSES = {
    "unreachable": "CWE-561", "uninitialized-variable": "CWE-457", "assert": "CWE-617", "division-by-zero": "CWE-369",
    "shift-count": "CWE-758", "signed-int-underflow": "CWE-191", "signed-int-overflow": "CWE-190",
    "unsigned-int-underflow": "CWE-191", "unsigned-int-overflow": "CWE-190", "null-pointer-deref": "CWE-476",
    "null-pointer-comparison": "CWE-758", "invalid-pointer-comparison": "CWE-758", "pointer-comparison": "CWE-758",
    "pointer-overflow": "CWE-823", "invalid-pointer-deref": "CWE-119", "unknown-memory-access": "CWE-119",
    "unaligned-pointer": "CWE-758", "buffer-overflow-gets": "CWE-242", "buffer-overflow": "CWE-119",
    "unknown-function-call-pointer": "CWE-758", "function-call": "CWE-758", "free": "CWE-415",
}

OUT = ["tool", "filename", "line", "cwe", "rule", "message"]


def _lookup(table: dict[str, str | None], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def parse_sarif(raw: DataFrame, keys: list[str], tool: Column) -> DataFrame:
    """One row per result: its first location, and the CWE of its tags, its rule's tags or its message, in that order.

    A rule id that occurs twice in a run means its last entry. Rules are looked up before the results become rows, so that
    no row carries them.
    """
    runs = raw.select(*keys, tool.alias("tool"), F.posexplode(F.from_json(payload(F.col("raw"), "{"), SARIF)["runs"]).alias("run", "r"))
    listed = F.transform(F.coalesce(F.col("r.tool.driver.rules"), F.array()), lambda x, k: F.struct(x["id"].alias("id"), k.alias("k"), x["properties"]["tags"].alias("tags")))
    # In the order of ids and places, a rule counts if the next one has another id.
    ordered = F.array_sort(F.filter(listed, lambda x: x["id"].isNotNull()))
    last = F.transform(F.filter("ordered", lambda x, k: F.coalesce(F.get(F.col("ordered"), k + 1)["id"] != x["id"], F.lit(True))), lambda x: F.struct(x["id"], x["tags"]))
    runs = runs.withColumn("ordered", ordered).withColumn("rules", F.map_from_entries(last))
    found = F.transform("r.results", lambda x: F.struct(x.alias("x"), F.col("rules")[x["ruleId"]].alias("tags")))
    results = runs.select(*keys, "tool", "run", F.posexplode(found).alias("pos", "y")).select(*keys, "tool", "run", "pos", "y.x", "y.tags")
    spot = F.get(F.col("x.locations"), F.lit(0))["physicalLocation"]
    text = F.col("x.message.text")
    return results.select(
        *keys, "run", "pos", "tool", spot["artifactLocation"]["uri"].alias("filename"), positive_line(spot["region"]["startLine"]).alias("line"),
        F.coalesce(tag_cwe(F.col("x.properties.tags")), tag_cwe(F.col("tags")), first_cwe(text)).alias("cwe"),
        F.col("x.ruleId").alias("rule"), F.coalesce(text, F.lit("")).alias("message"),
    )


def parse_semgrep(raw: DataFrame, keys: list[str]) -> DataFrame:
    rows = raw.select(*keys, F.posexplode(F.from_json(payload(F.col("raw"), "{"), SEMGREP)["results"]).alias("pos", "x"))
    return rows.select(
        *keys, F.lit(0).alias("run"), "pos", F.lit("semgrep").alias("tool"), F.col("x.path").alias("filename"), positive_line(F.col("x.start.line")).alias("line"),
        first_cwe(F.col("x.extra.metadata.cwe")).alias("cwe"), F.col("x.check_id").alias("rule"), F.coalesce("x.extra.message", F.lit("")).alias("message"),
    )


def _cppcheck_rows(errors: DataFrame, keys: list[str]) -> DataFrame:
    spot = F.get(F.col("x.location"), F.lit(0))
    return errors.select(
        *keys, F.lit(0).alias("run"), "pos", F.lit("cppcheck").alias("tool"), spot["_file"].alias("filename"), positive_line(spot["_line"]).alias("line"),
        first_cwe(F.col("x._cwe")).alias("cwe"), F.col("x._id").alias("rule"), F.coalesce("x._msg", "x._verbose", F.lit("")).alias("message"),
    )


def _cppcheck_elements(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)<error\b(?:[^>\"]|\"[^\"]*\")*?(?:/>|>.*?</error>)"), F.lit(0))


def parse_cppcheck(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Every complete <error> element, so that a cut-off output keeps what it holds."""
    rows = raw.select(*keys, F.posexplode(_cppcheck_elements(payload(F.col("raw"), "<"))).alias("pos", "element"))
    return _cppcheck_rows(rows.withColumn("x", F.from_xml("element", CPPCHECK_ERROR)).where("x._id is not null"), keys)


def choose_stream(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk, raw): of each run's outputs (keys, chunk, stream, raw) the standard error where it holds XML, else the
    standard output; a run of one chunk may have null there. Which it is, is known by text alone, before any is parsed."""
    held = F.trim(F.coalesce(payload(F.col("raw"), "<"), F.lit(""))) != ""
    kind = F.when((F.col("stream") == "stderr") & held, 2).when(F.col("stream") == "stdout", 1)
    rows = outputs.select(*keys, "chunk", kind.alias("__kind"), "raw").where("__kind is not null")
    best = rows.groupBy(*keys, "chunk").agg(F.max("__kind").alias("__best"))
    same = [rows[c].eqNullSafe(best[c]) for c in (*keys, "chunk")]
    return rows.alias("r").join(best.alias("b"), [*same, F.col("__kind") == F.col("__best")]).select(*(F.col(f"r.{c}") for c in (*keys, "chunk", "raw")))


def parse_cppcheck_chunks(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of chunks (keys, chunk, raw), which together are one run for each of keys: pos numbers the elements of all its
    chunks, in the order of the chunks' names and of their texts, from 0. A cut-off chunk keeps its whole elements."""
    found = parse_cppcheck(chunks, [*keys, "chunk"])
    numbered = running_number(found, keys, [F.col("chunk").asc_nulls_first(), "pos"], "__nth")
    return numbered.withColumn("pos", (F.col("__nth") - 1).cast("int")).drop("__nth", "chunk")


def merged_cppcheck(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, raw): one document of all whole elements of a run's chunks, in order, with the last chunk's version that is
    given, 2 where none is. One text per run, as the analyzer itself would have written it."""
    text = payload(F.col("raw"), "<")
    version = F.nullif(F.regexp_extract(text, r'<cppcheck\s+version="([^"]+)"', 1), F.lit(""))
    part = F.struct(F.coalesce("chunk", F.lit("")).alias("chunk"), version.alias("version"), F.array_join(_cppcheck_elements(text), "").alias("errors"))
    rows = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    last = F.coalesce(F.element_at(F.concat(F.array(F.lit("2")), F.filter("parts.version", lambda v: v.isNotNull())), -1), F.lit("2"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<results version="2"><cppcheck version="'), last, F.lit('" /><errors>'))
    return rows.select(*keys, F.concat(head, F.array_join("parts.errors", ""), F.lit("</errors></results>")).alias("raw"))


def read_cppcheck(spark: SparkSession, path: str) -> DataFrame:
    """Findings of all runs under path/<class>/<project>/: of each folder of outputs stderr.* where it holds XML, else
    stdout.*; folders below the first are the run's chunks. Banners and cut-off ends, which an XML reader refuses, are fine."""
    rows = read_outputs(spark, path)
    inside = F.substring_index(F.col("folder"), "/", -1)
    stream = F.regexp_extract("file", r"^(stderr|stdout)\b", 1)
    outputs = rows.select("class_name", "project", F.when(F.col("folder") != "", inside).alias("chunk"), stream.alias("stream"), "raw")
    return parse_cppcheck_chunks(choose_stream(outputs, ["class_name", "project"]), ["class_name", "project"])


def _hyphened(name: Column) -> Column:
    return F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit("-"))


def ikos_rule(entry: Column) -> Column:
    """The check's name by the first of check, kind and rule_id that is there: a number's name, or the text's usual name."""
    value = F.coalesce(entry["check"], entry["kind"], entry["rule_id"])
    name = F.when(value.rlike(r"^\d+$"), F.coalesce(F.get(F.array(*map(F.lit, IKOS_NUMBERS)), value.try_cast("int")), value)).otherwise(_hyphened(value))
    return F.coalesce(_lookup(IKOS_ALIASES, name), F.nullif(name, F.lit("")), F.lit("ikos.unknown"))


def ikos_status(entry: Column) -> Column:
    return F.coalesce(_lookup(IKOS_STATUS, _hyphened(entry["status"])), _hyphened(entry["status"]))


def parse_ikos(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of the first list among results, checks and reports that are errors, warnings or unreachable code.

    The place is that of the entry's statement, whose file is looked up, or else the entry's own location. Of statements
    and files with the same id the last counts; those without an id are left out. Both are joined by output and id.
    """
    doc = cut(raw.select(*keys, F.xxhash64(*keys).alias("k"), F.xxhash64("raw").alias("h"), F.from_json(payload(F.col("raw"), "{"), IKOS).alias("d")))

    def last(items: str, value: Column) -> DataFrame:
        rows = doc.select("k", "h", F.posexplode(items).alias("at", "i")).where("i.id is not null")
        return rows.groupBy("k", "h", F.col("i.id").alias("id")).agg(F.max_by(value, "at").alias("v"))

    statements = last("d.statements", F.struct("i.file_id", "i.line")).select("k", "h", F.col("id").alias("statement"), F.col("v").alias("s"))
    files = last("d.files", F.col("i.path")).select("k", "h", F.col("id").alias("file"), F.col("v").alias("path"), F.lit(True).alias("known"))
    rows = doc.select(*keys, "k", "h", F.posexplode(F.coalesce("d.results", "d.checks", "d.reports")).alias("pos", "x"))
    rows = rows.where(ikos_status(F.col("x")).isin("error", "warning", "unreachable")).withColumn("statement", F.col("x.statement_id"))
    rows = rows.join(statements, ["k", "h", "statement"], "left").withColumn("file", F.col("s.file_id")).join(files, ["k", "h", "file"], "left")
    rule = ikos_rule(F.col("x"))
    return rows.select(
        *keys, F.lit(0).alias("run"), "pos", F.lit("ikos").alias("tool"), F.when(F.col("known"), F.coalesce("path", F.lit(""))).otherwise(F.col("x.location.file")).alias("filename"),
        F.coalesce(positive_line(F.col("s.line").cast("string")), positive_line(F.col("x.location.line"))).alias("line"),
        _lookup(IKOS_WEAKNESSES, rule).alias("cwe"), rule.alias("rule"), F.coalesce(F.nullif("x.message", F.lit("")), F.nullif("x.description", F.lit("")), F.concat(F.lit("IKOS finding: "), rule)).alias("message"),
    )


def read_outputs(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(class_name, project, folder, file, raw) of every file under path/<class>/<project>/; folder is what lies between."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    parts = F.split(F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + path.rstrip("/").replace(".", r"\."), ""), "/")
    return rows.select(F.get(parts, F.lit(1)).alias("class_name"), F.get(parts, F.lit(2)).alias("project"), F.array_join(F.slice(parts, 4, F.size(parts) - 4), "/").alias("folder"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw"))
