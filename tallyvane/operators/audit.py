"""Run coverage: tool runs, reports, what to run again, and merging of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.operators.ranks import running_number
from tallyvane.session import cut, lean

PROJECT = ["class_name", "project"]
TOOL_ORDER = ["codeql", "cppcheck", "flawfinder", "semgrep", "ikos"]


def report_summary(runs: DataFrame) -> DataFrame:
    """Per project: tools, completed, failed, timeout, unavailable and findings; skipped runs are in no status count."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "timeout", "unavailable")]
    return runs.groupBy(*PROJECT).agg(F.count("*").alias("tools"), *counts, F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"))


def ordered_findings(findings: DataFrame) -> DataFrame:
    """finding_idx in report order: file, line (none first), tool, rule, then the order of arrival."""
    order = ["filename", F.coalesce("line", F.lit(-1)), "tool", F.coalesce("rule", F.lit("")), "arrival"]
    return running_number(findings, PROJECT, order, "finding_idx").withColumn("finding_idx", F.col("finding_idx") - 1)


def findings_per_tool(runs: DataFrame) -> DataFrame:
    """(tool, findings) over all completed runs, with a TOTAL row."""
    rows = runs.where("status = 'completed'").rollup("tool").agg(F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"))
    return rows.select(F.coalesce("tool", F.lit("TOTAL")).alias("tool"), "findings")


def tool_table(runs: DataFrame, tools: list[str]) -> DataFrame:
    """One row per project and a column per tool: the last run's findings, null unless it completed."""
    last = runs.groupBy(*PROJECT, "tool").agg(F.max_by(F.struct("status", "findings"), "ord").alias("r"))
    cell = F.when(F.col("r.status") == "completed", F.col("r.findings"))
    return last.select(*PROJECT, "tool", cell.alias("n")).groupBy(*PROJECT).pivot("tool", tools).agg(F.first("n"))


def tools_to_rerun(projects: DataFrame, runs: DataFrame, enabled: list[str]) -> DataFrame:
    """(project, tool): enabled tools without a completed run; a project without a readable report needs all of them."""
    wanted = projects.select(*PROJECT).distinct().withColumn("tool", F.explode(F.array(*map(F.lit, enabled))))
    return wanted.join(runs.where("status = 'completed'"), [*PROJECT, "tool"], "left_anti")


def merge_runs(old: DataFrame, fresh: DataFrame, fresh_runs: DataFrame) -> DataFrame:
    """Old rows of tools that did not run again, and all fresh rows; a tool that ran without findings clears its old ones."""
    kept = old.join(fresh_runs.select(*PROJECT, "tool").distinct(), [*PROJECT, "tool"], "left_anti")
    return kept.unionByName(fresh)


def merge_reports(old_runs: DataFrame, old_findings: DataFrame, fresh_runs: DataFrame, fresh_findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, findings) of the merged reports, for report_documents: fresh runs take the place of their tools' old ones,
    with all their findings; other tools keep theirs.

    Runs are in the order of the tools' names (ord, from 1). Findings are put in report order again and numbered anew; of
    equal ones the kept come first, each lot in its own order. A project that has no old report has the fresh one.
    """
    again = cut(fresh_runs.select(*PROJECT, "tool").distinct())
    kept = lambda rows: rows.join(lean(again), [*PROJECT, "tool"], "left_anti")
    runs = kept(old_runs).unionByName(fresh_runs).drop("ord")
    runs = runs.withColumn("ord", F.row_number().over(Window.partitionBy(*PROJECT).orderBy("tool")))
    arrival = lambda rows, lot: rows.withColumn("arrival", F.struct(F.lit(lot).alias("lot"), "finding_idx")).drop("finding_idx")
    found = arrival(kept(old_findings), 0).unionByName(arrival(fresh_findings, 1))
    return runs, ordered_findings(found).drop("arrival")


def merged_documents(old_runs: DataFrame, old_findings: DataFrame, fresh_runs: DataFrame, fresh_findings: DataFrame) -> DataFrame:
    """The merged reports as documents; their summaries are counted anew, findings being those that the report lists."""
    docs = report_documents(*merge_reports(old_runs, old_findings, fresh_runs, fresh_findings))
    return docs.withColumn("summary", F.col("summary").withField("findings", F.size("findings").cast("long")))


def chunk_status(chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by, status, message) over chunks (chunk, status, exit_code): completed if all are, else failed, timeout, or failed.

    The message tells how many completed and what became of the others; a run of completed chunks has none.
    """
    status, done = F.col("status"), F.count_if(F.col("status") == "completed")
    told = F.concat("chunk", F.lit(" ("), "status", F.when(F.col("exit_code").isNotNull(), F.concat(F.lit(", exit "), F.col("exit_code").cast("string"))).otherwise(""), F.lit(")"))
    failed = F.array_sort(F.collect_list(F.when(status != "completed", F.struct("chunk", told.alias("told")))))
    rows = chunks.groupBy(*by).agg(F.bool_and(status == "completed").alias("all"), F.bool_or(status == "failed").alias("f"), F.bool_or(status == "timeout").alias("t"), done.alias("done"), F.count("*").alias("n"), failed.alias("failed"))
    message = F.concat(F.col("done").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" chunks completed; failed: "), F.array_join(F.col("failed.told"), ", "))
    return rows.select(*by, F.when(F.col("all"), "completed").when(F.col("f"), "failed").when(F.col("t"), "timeout").otherwise("failed").alias("status"), F.when(~F.col("all"), message).alias("message"))


def first_projects(projects: DataFrame, names: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the named projects, then the first `limit` of each class in list order (ord)."""
    if names:
        projects = projects.where(F.col("project").isin(names))
    if limit is None:
        return projects
    return projects.withColumn("__r", F.row_number().over(Window.partitionBy("class_name").orderBy("ord"))).where(F.col("__r") <= limit).drop("__r")


def report_documents(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """One nested report per project: summary, tools in order, findings in report order."""
    tools = runs.groupBy(*PROJECT).agg(F.array_sort(F.collect_list(F.struct("ord", "tool", "status", "findings"))).alias("t"))
    rows = findings.groupBy(*PROJECT).agg(F.array_sort(F.collect_list(F.struct("finding_idx", "tool", "filename", "line", "cwe", "rule"))).alias("f"))
    summary = report_summary(runs).select(*PROJECT, F.struct("tools", "completed", "failed", "timeout", "unavailable", "findings").alias("summary"))
    drop = lambda name, first: F.transform(F.coalesce(F.col(name), F.array()), lambda x: x.dropFields(first))
    return summary.join(tools, PROJECT).join(rows, PROJECT, "left").select(*PROJECT, "summary", drop("t", "ord").alias("tools"), drop("f", "finding_idx").alias("findings"))


def select_tools(runs: DataFrame, tools: list[str]) -> DataFrame:
    """Runs of the selected tools; the filter reaches the scan."""
    return runs.where(F.col("tool").isin(tools))


def select_classes(rows: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """Rows of the requested classes, of all where none is; by class folders it prunes partitions."""
    return rows.where(F.col("class_name").isin(requested)) if requested else rows


def classes(rows: DataFrame, first: tuple[str, ...] = ("kernel", "application")) -> DataFrame:
    """(class_name, place) of the classes that occur: the usual ones, then others by name whatever its case."""
    usual = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, first)), F.col("class_name")), F.lit(0)), F.lit(len(first) + 1))
    return rows.select("class_name").distinct().withColumn("place", F.row_number().over(Window.orderBy(usual, F.lower("class_name"), "class_name")))
