"""Raw analyzer outputs and documents that Spark derives from findings, as inputs of the parsers: one text per project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROJECT = ["class_name", "project"]


def _texts(rows: DataFrame, by: list[str], item: Column, before: str, between: str, after: str) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct("finding_idx", item.alias("x")))), lambda s: s["x"])
    return rows.groupBy(*by).agg(F.concat(F.lit(before), F.array_join(items, between), F.lit(after)).alias("raw"))


def sarif(findings: DataFrame) -> DataFrame:
    """codeql puts the CWE on the rule's tags, flawfinder on the result's, or in its message for odd rows."""
    number = F.regexp_extract("cwe", r"(\d+)", 1)
    rows = findings.where("tool in ('codeql', 'flawfinder')").withColumn("rule", F.when(F.col("tool") == "codeql", F.concat_ws("-", "rule", F.coalesce("cwe", F.lit("none")))).otherwise(F.col("rule")))
    tag = F.concat(F.lit("external/cwe/cwe-"), number)
    on_result = (F.col("tool") == "flawfinder") & F.col("cwe").isNotNull() & (F.col("finding_idx") % 2 == 0)
    text = F.when((F.col("tool") == "flawfinder") & F.col("cwe").isNotNull() & (F.col("finding_idx") % 2 == 1), F.concat(F.lit("see CWE-"), number, F.lit(", CWE-999"))).otherwise("found")
    place = F.struct(F.struct(F.struct(F.col("filename").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule").alias("ruleId"), F.struct(text.alias("text")).alias("message"), F.struct(F.when(on_result, F.array(F.lit("security"), tag)).alias("tags")).alias("properties"), F.array(place).alias("locations")
    )
    rules = F.collect_set(F.when(F.col("tool") == "codeql", F.struct(F.col("rule").alias("id"), F.struct(F.when(F.col("cwe").isNotNull(), F.array(tag)).alias("tags")).alias("properties"))))
    results = F.transform(F.array_sort(F.collect_list(F.struct("finding_idx", F.to_json(result).alias("x")))), lambda s: s["x"])
    head = F.concat(F.lit('banner 1.0\n{"runs":[{"tool":{"driver":{"rules":'), F.to_json(rules), F.lit('}},"results":['))
    return rows.groupBy(*PROJECT, "tool").agg(F.concat(head, F.array_join(results, ","), F.lit("]}]}")).alias("raw"))


def semgrep(findings: DataFrame) -> DataFrame:
    """The CWE is text on even rows and a list on odd ones."""
    cwe = F.when(F.col("cwe").isNull(), "null").when(F.col("finding_idx") % 2 == 0, F.concat(F.lit('"'), "cwe", F.lit(': text"'))).otherwise(F.concat(F.lit('["'), "cwe", F.lit('","CWE-1"]')))
    item = F.concat(F.lit('{"path":"'), "filename", F.lit('","check_id":"'), "rule", F.lit('","start":{"line":'), F.coalesce(F.col("line").cast("string"), F.lit("0")), F.lit('},"extra":{"message":"m","metadata":{"cwe":'), cwe, F.lit("}}}"))
    return _texts(findings.where("tool = 'semgrep'"), PROJECT, item, '{"results":[', ",", "]}")


def cppcheck(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every output ends in the middle of an element, as a stopped run leaves it."""
    number = F.regexp_extract("cwe", r"(\d+)", 1)
    item = F.concat(F.lit('<error id="'), "rule", F.lit('" severity="style" msg="m &lt;x&gt;" verbose="v"'), F.when(F.col("cwe").isNotNull(), F.concat(F.lit(' cwe="'), number, F.lit('"'))).otherwise(""),
                    F.lit('><location file="'), "filename", F.lit('" line="'), F.coalesce(F.col("line").cast("string"), F.lit("0")), F.lit('"/></error>'))
    return _texts(findings.where("tool = 'cppcheck'"), by or PROJECT, item, 'Checking...\n<?xml version="1.0"?><results version="2"><errors>', "\n", '\n<error id="cut" msg="')


def cppcheck_streams(findings: DataFrame) -> DataFrame:
    """Three chunks for each project, each with two streams: an even one has its elements in stderr and an empty document in
    stdout, an odd one only a banner in stderr."""
    raw = cppcheck(findings.withColumn("chunk", F.concat(F.lit("c"), (F.col("finding_idx") % 3).cast("string"))), [*PROJECT, "chunk"])
    even = F.col("chunk") != "c1"
    stream = lambda name, text: F.struct(F.lit(name).alias("stream"), text.alias("raw"))
    streams = F.array(stream("stderr", F.when(even, F.col("raw")).otherwise("Checking f.c ...\n")), stream("stdout", F.when(even, '<results version="2"/>').otherwise(F.col("raw"))))
    return raw.select(*PROJECT, "chunk", F.inline(streams))


def ikos(findings: DataFrame) -> DataFrame:
    """Even rows name their place by a statement, odd ones by a location; status and check are numbers or names."""
    status = F.element_at(F.array(*map(F.lit, ['"ok"', "1", '"error"', '"Unreachable"'])), (F.col("finding_idx") % 4 + 1).cast("int"))
    check = F.element_at(F.array(*map(F.lit, ['"boa"', "4", '"signed_int_overflow"'])), (F.col("finding_idx") % 3 + 1).cast("int"))
    line = F.coalesce(F.col("line").cast("string"), F.lit("0"))
    place = F.when(F.col("finding_idx") % 2 == 0, F.concat(F.lit('"statement_id":'), F.col("finding_idx").cast("string"))).otherwise(F.concat(F.lit('"location":{"file":"'), "filename", F.lit('","line":'), line, F.lit("}")))
    sort = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("finding_idx", x.alias("x")))), lambda s: s["x"]), ",")
    idx = F.col("finding_idx").cast("string")
    entry = F.concat(F.lit('{"status":'), status, F.lit(',"check":'), check, F.lit(","), place, F.lit("}"))
    file = F.concat(F.lit('{"id":'), idx, F.lit(',"path":"'), "filename", F.lit('"}'))
    statement = F.concat(F.lit('{"id":'), idx, F.lit(',"file_id":'), idx, F.lit(',"line":'), line, F.lit("}"))
    return findings.groupBy(*PROJECT).agg(F.concat(F.lit('{"checks":['), sort(entry), F.lit('],"files":['), sort(file), F.lit('],"statements":['), sort(statement), F.lit("]}")).alias("raw"))


def ctags(spans: DataFrame) -> DataFrame:
    """JSON lines, each function followed by a line that is no function."""
    tag = F.to_json(F.struct(F.lit("tag").alias("_type"), "name", F.col("filename").alias("path"), F.lit("function").alias("kind"), "scope", F.col("start_line").alias("line"), F.col("end_line").alias("end")))
    return spans.select(*PROJECT, F.explode(F.array(tag, F.lit('{"_type":"tag","kind":"macro","name":"m","path":"p","line":1}'), F.lit("{bad"))).alias("line"))


def metadata(rows: DataFrame) -> DataFrame:
    value = F.struct(F.col("project").alias("name"), F.col("class_name").alias("class"), "source_files", "loc", "functions")
    entry = F.concat(F.to_json(F.array("project")), F.to_json(value))
    item = F.concat(F.regexp_replace(entry, r'^\["(.*?)"\]', '"$1":'))
    return rows.groupBy("class_name").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(item), ","), F.lit(',"note":null}')).alias("raw"))


def cwe_catalog(part: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Catalog texts: parts are weaknesses with one or two parents, nations categories of parts, regions views of nations."""
    number = lambda c: F.col(c).cast("long")
    link = lambda tag, nature, cwe: F.concat(F.lit(f'<{tag} Nature="{nature}" CWE_ID="'), cwe.cast("string"), F.lit('" View_ID="1000"/>'))
    named = lambda tag, ident, name: F.concat(F.lit(f'<{tag} ID="'), ident.cast("string"), F.lit('" Name="'), name, F.lit('"'))
    key = number("p_partkey")
    parents = F.concat(F.when(key > 1, link("Related_Weakness", "ChildOf", F.expr("p_partkey div 2"))).otherwise(""), link("Related_Weakness", "PeerOf", key + 1), F.when(key % 3 == 0, link("Related_Weakness", "ChildOf", F.expr("p_partkey div 3"))).otherwise(""))
    weakness = F.concat(named("Weakness", key, F.col("p_name")), F.when((key > 1) | (key % 3 == 0), F.concat(F.lit(">\n<Related_Weaknesses>"), parents, F.lit("</Related_Weaknesses></Weakness>"))).otherwise("/>"))
    weaknesses = part.select((key % 64).alias("file"), weakness.alias("x")).groupBy("file").agg(F.array_join(F.collect_list("x"), "\n").alias("x"))
    weaknesses = weaknesses.select(F.concat(F.lit("<Weakness_Catalog><Weaknesses>"), "x", F.lit("</Weaknesses></Weakness_Catalog>")).alias("raw"))
    listed = part.select((key % 25).alias("n_nationkey"), F.struct(key.alias("k"), link("Has_Member", "Member", key).alias("x")).alias("m")).groupBy("n_nationkey").agg(F.array_sort(F.collect_list("m")).alias("m"))
    category = F.concat(named("Category", number("n_nationkey") + 10_000_000, F.col("n_name")), F.lit("><Relationships>"), link("Has_Member", "ChildOf", number("n_regionkey") + 20_000_000), F.array_join(F.transform(F.coalesce("m", F.array()), lambda m: m["x"]), ""), F.lit("</Relationships></Category>"))
    categories = nation.join(listed, "n_nationkey", "left").select(F.concat(F.lit("<Categories>"), category, F.lit("</Categories>")).alias("raw"))
    held = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct(number("n_nationkey").alias("k"), link("Has_Member", "Member", number("n_nationkey") + 10_000_000).alias("x")))).alias("m"))
    view = F.concat(named("View", number("r_regionkey") + 20_000_000, F.col("r_name")), F.lit("><Members>"), F.array_join(F.transform("m", lambda m: m["x"]), ""), F.lit("</Members></View>"))
    return weaknesses.union(categories).union(region.join(held, "r_regionkey").select(F.concat(F.lit("<Views>"), view, F.lit("</Views>")).alias("raw")))
