"""Clusters of agreeing findings under the seven vote rules, and their summaries."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from tallyvane.functions.findings import format_cwe, function_id
from tallyvane.operators.hierarchy import ancestors, related_pairs, representatives
from tallyvane.operators.ranks import running_number
from tallyvane.operators.vote import FILE, PROJECT, agree, line_labels, with_positions
from tallyvane.session import keep, lean

#: Rule names by threshold; the last three let any two CWEs agree inside a function.
CWE_RULES = {1: "one_out_of_four", 2: "two_out_of_four", 3: "three_out_of_four", 4: "four_out_of_four"}
ANY_RULES = {2: "two_out_four_no_cwe", 3: "three_out_four_no_cwe", 4: "four_out_four_no_cwe"}
TOOLS = ["codeql", "cppcheck", "flawfinder", "semgrep"]
#: Lines of the longest function whose findings meet in one row.
LONG = 4096


def _rules(rules: dict[int, str]) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("least"), F.lit(name).alias("rule")) for k, name in rules.items()))


def gather(labelled: DataFrame, members: bool) -> DataFrame:
    """One row per label: earliest finding, tools, CWEs, size, and the findings where members are asked for."""
    number = F.substr("cwe", F.lit(5)).cast("int")
    entry = F.struct("filename", F.col("line").alias("at"), "tool", "cwe", "finding_idx", "line", "function", number.alias("number"), F.lit(1).cast("long").alias("n"))
    lists = [F.array_sort(F.collect_list(entry)).alias("entries")] if members else []
    return labelled.groupBy(*PROJECT, "label").agg(
        F.min("finding_idx").alias("min_idx"), F.array_sort(F.collect_set("tool")).alias("tools"), F.array_sort(F.collect_set(number)).alias("cwes"), (F.sum("n") if "n" in labelled.columns else F.count("*")).alias("size"), *lists
    ).drop("label")


def by_rule(rows: DataFrame, rules: dict[int, str], members: bool = True, numbered: bool = True) -> DataFrame:
    """One row per cluster and rule whose threshold its distinct tools reach; thresholds are cumulative.

    Tools are sorted, CWEs distinct and in numeric order, findings by file, line, tool, CWE and position. cluster_id counts
    each project's clusters of a rule from 1 by their earliest finding, after the threshold. Without members the findings
    are left out: a summary then moves bounded rows, however large a cluster; it needs no ids either, which are null unless
    numbered.
    """
    rows = rows.withColumn("r", F.explode(F.filter(_rules(rules), lambda r: r["least"] <= F.size("tools")))).withColumn("rule", F.col("r.rule"))
    findings = F.transform("entries", lambda e: F.struct(e["tool"].alias("tool"), e["filename"].alias("filename"), e["line"].alias("line"), e["cwe"].alias("cwe"), e["function"].alias("function")))
    rows = running_number(rows, [*PROJECT, "rule"], ["min_idx"], "cluster_id") if numbered else rows.withColumn("cluster_id", F.lit(None))
    return rows.withColumn("cluster_id", F.col("cluster_id").cast("int")).select(*PROJECT, "rule", "cluster_id", (F.col("min_idx") if numbered else F.lit(None).cast("long")).alias("min_idx"), "tools", "cwes", "size", *([findings.alias("findings")] if members else []))


def single_clusters(findings: DataFrame, members: bool = True, numbered: bool = True) -> DataFrame:
    """The first rule: every finding with a CWE is a cluster and its own representative; its id is its position."""
    rows = findings if members else findings.select(*PROJECT, "tool", "cwe", "finding_idx")
    rows = with_positions(rows) if numbered else rows.withColumn("position", F.lit(None))
    one = [F.array(F.struct("tool", "filename", "line", "cwe", "function")).alias("findings")] if members else []
    cwes = F.array(F.substr("cwe", F.lit(5)).cast("int")).alias("cwes")
    rows = rows.select(*PROJECT, F.lit(CWE_RULES[1]).alias("rule"), F.col("position").cast("int").alias("cluster_id"), F.col("finding_idx").alias("min_idx"), F.array("tool").alias("tools"), cwes, F.lit(1).cast("long").alias("size"), *one)
    return rows.withColumn("representative", F.get("cwes", F.lit(0)))


def agreeing(lines: list, tools: list, numbers: list, related: set) -> list[list[int]]:
    """Places, in the lists, of findings of one function that agree by line or by related CWEs, and have two tools at least.

    Findings of a tool and CWE stand for each other once another tool has an equal or related CWE, so only these meet in pairs.
    """
    parent = list(range(len(lines)))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def join(places: list[int]) -> None:
        first = find(places[0])
        for k in places[1:]:
            parent[find(k)] = first

    on_line, kinds, held = {}, {}, {}
    for k, (line, tool, number) in enumerate(zip(lines, tools, numbers)):
        on_line.setdefault(line, []).append(k)
        kinds.setdefault((tool, number), []).append(k)
        held.setdefault(number, set()).add(tool)
    for places in on_line.values():
        if len({tools[k] for k in places}) > 1:
            join(places)
    pairs = [(c, c) for c in held] + [(a, b) for a, b in related if a in held and b in held]
    met = set()
    for a, b in pairs:
        for one in held[a]:
            for two in held[b]:
                if one != two:
                    join([kinds[one, a][0], kinds[two, b][0]])
                    met |= {(one, a), (two, b)}
    for kind in met:
        join(kinds[kind])
    found = {}
    for k in range(len(lines)):
        found.setdefault(find(k), []).append(k)
    return [places for places in found.values() if len({tools[k] for k in places}) > 1]


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _agreeing(lines: pd.Series, tools: pd.Series, numbers: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
    rows = zip(lines, tools, numbers, one, two)
    return pd.Series([agreeing(x.tolist(), t.tolist(), n.tolist(), set() if a is None else set(zip(a.tolist(), b.tolist()))) for x, t, n, a, b in rows], dtype=object)


def place_groups(findings: DataFrame, members: bool) -> DataFrame:
    """The findings of each function, and of each line outside all, where at least two tools meet, as one array.

    Findings are those of attach_functions, where a line has one function, so that no agreement leaves a place. Without
    members, those of a line, tool and CWE are counted before they move, which bounds a row by the lines and kinds of a function.
    """
    number = F.substr("cwe", F.lit(5)).cast("int").alias("number")
    place = [*FILE, "function", F.when(F.col("function").isNull(), F.col("line")).alias("bare")]
    if members:
        rows = findings.select(*place, F.struct("filename", F.col("line").alias("at"), "tool", "cwe", "finding_idx", "line", "function", number, F.lit(1).cast("long").alias("n")).alias("x"))
    else:
        key = [c for c in ("near", *FILE, "bucket") if c in findings.columns]
        counted = findings.groupBy(*key, "function", "line", "tool", number).agg(F.count("*").alias("n"), F.min("finding_idx").alias("finding_idx"))
        rows = counted.select(*place, F.struct("line", "tool", "number", "finding_idx", "n").alias("x"))
    key = ["near", *FILE, "function", "bare"]
    here = Window.partitionBy(*key)
    # The test for a file's name is within: as a filter of its own it would be made at the scan, and clean all paths twice.
    tool = F.when(F.col("filename").isNotNull(), F.col("x.tool"))
    rows = rows.withColumn("near", F.xxhash64(*key[1:])).withColumn("some", F.min(tool).over(here) < F.max(tool).over(here)).where("some")
    groups = rows.groupBy(*key).agg(F.collect_list("x").alias("entries"))
    return groups.select(*PROJECT, "entries", F.array_sort(F.array_distinct("entries.number")).alias("numbers"))


def function_groups(findings: DataFrame, members: bool) -> tuple[DataFrame, DataFrame | None]:
    """place_groups, and the findings with line_labels of functions of more than LONG lines, or of unknown length; None if there are none."""
    # Without its length a function may be any.
    seen, long = Observation(), F.col("length") > LONG if "length" in findings.columns else F.col("function").isNotNull()
    met = findings.where("line is not null").withColumn("long", F.coalesce(long, F.lit(False)))
    groups = keep(place_groups(met.observe(seen, F.count_if("long").alias("n")).where("not long"), members))
    return groups, keep(line_labels(met.where("long").drop("long", "near", "bucket", "length"))) if seen.get["n"] else None


def piece_groups(pieces: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """function_groups, without members, of the rows of vote.place_pieces; those of a function in many blocks meet here."""
    sets = lambda rows: rows.withColumn("numbers", F.array_sort(F.array_distinct("entries.number")))
    seen, long = Observation(), F.coalesce(F.col("length") > LONG, F.lit(False))
    pieces = keep(sets(pieces).withColumn("long", long).observe(seen, F.count_if("open").alias("open"), F.count_if(F.col("open") & F.col("long")).alias("long")))
    groups, far = pieces.where("not open").select(*PROJECT, "entries", "numbers"), None
    if seen.get["open"]:
        met = pieces.where("open and not long").groupBy(F.xxhash64(*FILE, "span").alias("near"), *FILE, "span").agg(F.flatten(F.collect_list("entries")).alias("entries"))
        groups = groups.union(keep(sets(met.where(F.array_min("entries.tool") < F.array_max("entries.tool"))).select(*PROJECT, "entries", "numbers")))
    if seen.get["long"]:
        rows = pieces.where("open and long").select(*FILE, F.col("span").alias("function"), F.explode("entries").alias("e"))
        # Labels need an index, also where findings are not numbered.
        index = F.coalesce("e.finding_idx", F.monotonically_increasing_id()).alias("finding_idx")
        far = keep(line_labels(rows.select(*FILE, "function", "e.line", "e.tool", format_cwe(F.col("e.number")).alias("cwe"), index, "e.n")))
    return groups, far


def _related_sets(groups: DataFrame, related: DataFrame) -> DataFrame:
    """groups with one and two, the related CWEs in numbers; found once for each distinct set of these, of which there are few."""
    sets = groups.select("numbers").distinct().select("numbers", F.explode("numbers").alias("a")).select("numbers", "a", F.explode("numbers").alias("b"))
    sets = keep(sets.where("a < b").join(lean(related), ["a", "b"]).groupBy("numbers").agg(F.collect_list("a").alias("one"), F.collect_list("b").alias("two")))
    return groups.join(lean(sets), "numbers", "left")


def _place_clusters(groups: DataFrame, related: DataFrame | None) -> DataFrame:
    """(project, picked): the findings of each cluster in place_groups; related as in agree."""
    if related is None:
        return groups.select(*PROJECT, F.col("entries").alias("picked"))
    groups = _related_sets(groups, related)
    # Two tools at least are in each group, so one line or one CWE is one cluster; of two findings, so are related CWEs, and else none.
    one, two = (F.size("numbers") == 1) | (F.array_min("entries.line") == F.array_max("entries.line")), F.size("entries") == 2
    whole = groups.where(one | (two & F.col("one").isNotNull())).select(*PROJECT, F.col("entries").alias("picked"))
    found = groups.where(~(one | two)).withColumn("found", _agreeing("entries.line", "entries.tool", "entries.number", "one", "two"))
    found = found.select(*PROJECT, "entries", F.explode("found").alias("places")).select(*PROJECT, F.transform("places", lambda k: F.get("entries", k)).alias("picked"))
    return whole.unionByName(found)


@F.pandas_udf(ArrayType(LongType()))
def _least(indices: pd.Series, lines: pd.Series, tools: pd.Series, numbers: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
    found = []
    for i, x, t, n, a, b in zip(indices, lines, tools, numbers, one, two):
        labels = i.tolist()
        for places in agreeing(x.tolist(), t.tolist(), n.tolist(), set() if a is None else set(zip(a.tolist(), b.tolist()))):
            least = min(int(i[k]) for k in places)
            for k in places:
                labels[k] = least
        found.append(labels)
    return pd.Series(found, dtype=object)


def member_labels(members: DataFrame, related: DataFrame | None) -> DataFrame:
    """(project, finding_idx, label) of the rows of vote.place_members: the smallest finding_idx of those that agree with each,
    its own included; related as in agree. Only functions of hot blocks, and of more than LONG lines where these go beyond a
    block, are voted on by star contractions."""
    seen, long = Observation(), F.col("open") & (F.col("length") > LONG)
    counts = {"open": F.col("open"), "long": long, "hot": F.col("hot")}
    members = keep(members.observe(seen, *(F.count_if(c).alias(name) for name, c in counts.items())))
    # A function beyond its block may have its other findings in a hot one.
    far = F.col("hot") | (F.col("open") if seen.get["hot"] else long)
    rows = members.where("entries is not null")
    own = members.where("alone is not null").select(*PROJECT, F.explode("alone").alias("finding_idx")).withColumn("label", F.col("finding_idx"))
    groups = rows.where("not open and not hot").select(*PROJECT, "entries")
    if seen.get["open"]:
        met = rows.where(F.col("open") & ~far).groupBy(F.xxhash64(*FILE, "span").alias("near"), *FILE, "span").agg(F.flatten(F.collect_list("entries")).alias("entries"))
        met = keep(met.select(*PROJECT, "entries", (F.array_min("entries.tool") < F.array_max("entries.tool")).alias("some")))
        groups = groups.union(met.where("some").drop("some"))
        own = own.union(met.where("not some").select(*PROJECT, F.explode("entries.finding_idx").alias("finding_idx")).withColumn("label", F.col("finding_idx")))
    least = F.array_min("entries.finding_idx").alias("label")
    if related is None:
        found = groups.select(*PROJECT, F.explode("entries.finding_idx").alias("finding_idx"), least)
    else:
        groups = _related_sets(groups.withColumn("numbers", F.array_sort(F.array_distinct("entries.number"))), related)
        # As in _place_clusters.
        one, two = (F.size("numbers") == 1) | (F.array_min("entries.line") == F.array_max("entries.line")), F.size("entries") == 2
        index = F.explode("entries.finding_idx").alias("finding_idx")
        found = groups.where(one | two).select(*PROJECT, index, F.when(one | F.col("one").isNotNull(), F.array_min("entries.finding_idx")).alias("label"))
        found = found.withColumn("label", F.coalesce("label", "finding_idx"))
        labels = _least("entries.finding_idx", "entries.line", "entries.tool", "entries.number", "one", "two")
        rest = groups.where(~(one | two)).withColumn("labels", labels)
        rest = rest.select(*PROJECT, F.explode(F.arrays_zip(F.col("entries.finding_idx").alias("i"), F.col("labels").alias("l"))).alias("e"))
        found = found.union(rest.select(*PROJECT, "e.i", "e.l"))
    if seen.get["hot"] or seen.get["long"]:
        each = rows.where(far).select(*FILE, F.col("span").alias("function"), F.explode("entries").alias("e"))
        each = each.select(*FILE, "function", "e.line", "e.tool", format_cwe(F.col("e.number")).alias("cwe"), "e.finding_idx")
        found = found.union(agree(each, related).select(*PROJECT, "finding_idx", "label"))
    return own.union(found)


@F.pandas_udf(ArrayType(StringType()))
def _kind_pairs(tools: pd.Series, numbers: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
    """The pairs of kinds, tool and CWE, of which the tools differ and the CWEs are equal or related, as texts."""
    out = []
    for t, n, a, b in zip(tools, numbers, one, two):
        held = {}
        for tool, number in zip(t.tolist(), n.tolist()):
            held.setdefault(number, set()).add(tool)
        met = [(x, c, y, c) for c, names in held.items() for x in names for y in names if x < y]
        for c, d in [] if a is None else zip(a.tolist(), b.tolist()):
            met += [(x, c, y, d) if x < y else (y, d, x, c) for x in held[c] for y in held[d] if x != y]
        out.append(["|".join(map(str, m)) for m in met])
    return pd.Series(out, dtype=object)


def function_pairs(pieces: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, function, pairs): of functions in the named rows of vote.place_pieces, how many pairs of tool and CWE agree."""
    kinds = F.array_distinct(F.transform("entries", lambda e: F.struct(e["tool"].alias("tool"), e["number"].alias("number")))).alias("kinds")
    # The number of a span holds its start, and length is that of its lines.
    start = (F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).alias("start_line")
    rows = keep(pieces.where("span is not null").select(*FILE, "span", "length", "open", start, "name", "scope", kinds))
    named = ["span", "length", "start_line", "name", "scope"]
    met = rows.where("open").groupBy(F.xxhash64(*FILE, "span").alias("near"), *FILE, *named).agg(F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"))
    groups = rows.where("not open").select(*FILE, *named, "kinds").unionByName(met.drop("near"))
    # Pairs need two tools, which functions beyond a block may not have.
    groups = groups.where(F.array_min("kinds.tool") < F.array_max("kinds.tool")).withColumn("numbers", F.array_sort(F.array_distinct("kinds.number")))
    groups = _related_sets(groups, related_pairs(ancestors(edges)))
    function = function_id(F.col("filename"), F.col("scope"), F.col("name"), F.col("start_line"), F.col("start_line") + F.col("length") - 1)
    found = groups.select("project", function.alias("function"), _kind_pairs("kinds.tool", "kinds.number", "one", "two").alias("pairs")).where(F.size("pairs") > 0)
    return found.groupBy("project", "function").agg(F.size(F.array_distinct(F.flatten(F.collect_list("pairs")))).cast("long").alias("pairs"))


def _build_places(picked: DataFrame, members: bool) -> DataFrame:
    """The clusters of _place_clusters as build has them before the rules."""
    size = F.aggregate("picked.n", F.lit(0).cast("long"), lambda a, n: a + n)
    lists = [F.array_sort("picked").alias("entries")] if members else []
    return picked.select(*PROJECT, F.array_min("picked.finding_idx").alias("min_idx"), F.array_sort(F.array_distinct("picked.tool")).alias("tools"), F.array_sort(F.array_distinct("picked.number")).alias("cwes"), size.alias("size"), *lists)


def _voted(groups: DataFrame, far: DataFrame | None, related: DataFrame | None, members: bool) -> DataFrame:
    """The clusters of function_groups or piece_groups before the rules; related as in agree."""
    rows = _build_places(_place_clusters(groups, related), members)
    if far is not None:
        rows = rows.unionByName(gather(agree(far.drop("label", "on_line", "in_function"), related, far, alone=False), members))
    return rows


def two_tool_clusters(pieces: DataFrame, edges: DataFrame) -> DataFrame:
    """The clusters of related CWEs, of two tools at least, in the rows of vote.place_pieces, to be counted: without ids,
    representatives or members, so that nothing is written but the pieces."""
    groups, far = piece_groups(pieces)
    return _voted(groups, far, related_pairs(ancestors(edges)), False)


def all_clusters(findings: DataFrame, edges: DataFrame, members: bool = True, numbered: bool = True, rules: list[str] | None = None, prepared: DataFrame | None = None) -> DataFrame:
    """The clusters of all seven rules, or of those in rules, with their representative CWE; findings are prepared and have functions.

    Only rules that ask for related CWEs have representatives; those of the other three are null. Findings of a function
    meet in one row; those of functions of more than LONG lines, or of unknown length, are voted on by star contractions, which
    are only run where there are any. Without members findings may be the rows of vote.place_pieces; prepared: the same
    findings before they had functions, for the first rule, which needs none without members.
    """
    wanted = lambda names: {k: v for k, v in names.items() if rules is None or v in rules}
    closure = ancestors(edges)
    if "entries" in findings.columns:
        groups, far = piece_groups(findings)
    else:
        findings = findings.select(*PROJECT, "tool", "filename", "line", "cwe", "finding_idx", *(c for c in ("function", "near", "bucket", "length") if c in findings.columns))
        findings = keep(findings) if members else findings
        groups, far = function_groups(findings, members)
    voted = []
    # The rules that are voted on ask for two tools at least.
    for names, related in ((wanted({k: v for k, v in CWE_RULES.items() if k > 1}), related_pairs(closure)), (wanted(ANY_RULES), None)):
        if names:
            rows = by_rule(_voted(groups, far, related, members), names, members, numbered)
            voted.append(rows.withColumn("representative", F.lit(None).cast("int")) if related is None else add_representatives(keep(rows), closure))
    singles = [single_clusters(findings if members or prepared is None else prepared, members, numbered)] if wanted({1: CWE_RULES[1]}) else []
    return reduce(DataFrame.unionByName, [*singles, *voted])


def add_representatives(clusters: DataFrame, closure: DataFrame) -> DataFrame:
    """Add representative; it is found once per distinct set of CWEs, of which there are few."""
    return clusters.join(representatives(clusters.select("cwes").distinct(), closure), "cwes", "left")


def rule_summary(clusters: DataFrame) -> DataFrame:
    """(project, rule, cwe, n, tot_vulns): a cluster counts for its representative, else for every CWE it holds."""
    numbers = F.when(F.col("representative").isNotNull(), F.array("representative")).otherwise(F.col("cwes"))
    # A null beside the numbers counts the cluster itself, so that clusters are made and read once.
    counted = clusters.select(*PROJECT, "rule", F.explode(F.concat(F.array(F.lit(None).cast("int")), numbers)).alias("number")).groupBy(*PROJECT, "rule", "number").agg(F.count("*").alias("n"))
    total = F.max(F.when(F.col("number").isNull(), F.col("n"))).over(Window.partitionBy(*PROJECT, "rule"))
    return counted.withColumn("tot_vulns", total).where("number is not null").withColumn("cwe", format_cwe(F.col("number")))


def hits_per_tool(findings: DataFrame) -> DataFrame:
    """(project, tool, hits) for the four voting tools, zero where a project has none; other tools are left out."""
    counts = [F.count_if(F.col("tool") == t).alias(t) for t in TOOLS]
    return findings.groupBy(*PROJECT).agg(*counts).unpivot(PROJECT, TOOLS, "tool", "hits")


def project_documents(summary: DataFrame, hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """One nested row per project: LOC, functions, hits_per_tool, and for each rule its CWEs, total and counts.

    Every project has all rules and tools, with nothing where it has no cluster or hit; sizes it does not have are 0.
    """
    counts = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("number", "cwe", "n"))), lambda x: F.struct(x["cwe"], x["n"])))
    per_rule = summary.groupBy(*PROJECT, "rule").agg(F.first("tot_vulns").alias("tot_vulns"), counts.alias("vulns_per_cwe"))
    value = F.struct(F.map_keys("vulns_per_cwe").alias("unique_cwes"), "tot_vulns", "vulns_per_cwe")
    rules = per_rule.groupBy(*PROJECT).agg(F.map_from_entries(F.collect_list(F.struct(F.col("rule"), value))).alias("rules"))
    tools = hits.groupBy(*PROJECT).agg(F.map_from_entries(F.collect_list(F.struct("tool", "hits"))).alias("found"))
    nothing = F.struct(F.array().cast("array<string>").alias("unique_cwes"), F.lit(0).cast("long").alias("tot_vulns"), F.create_map().cast("map<string,bigint>").alias("vulns_per_cwe"))
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    every_tool = F.create_map(*(x for t in TOOLS for x in (F.lit(t), F.coalesce(F.col("found")[t], F.lit(0).cast("long")))))
    every_rule = [F.coalesce(F.col("rules")[r], nothing).alias(r) for r in [*CWE_RULES.values(), *ANY_RULES.values()]]
    rows = sizes.select(*PROJECT, zero("loc").alias("LOC"), zero("functions").alias("functions")).join(tools, PROJECT, "left").join(rules, PROJECT, "left")
    return rows.select(*PROJECT, "LOC", "functions", every_tool.alias("hits_per_tool"), *every_rule)
