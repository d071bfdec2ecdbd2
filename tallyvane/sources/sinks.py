"""Writers of reports, clusters, summaries and tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.functions.findings import format_cwe
from tallyvane.operators.ranks import running_number
from tallyvane.sources.array_files import JsonArrays

KEY = ["class_name", "project", "rule"]


def write_reports(reports: DataFrame, path: str) -> None:
    """One folder per class and project."""
    reports.write.mode("overwrite").partitionBy("class_name", "project").json(path)


def write_arrays(items: DataFrame, path: str, files: DataFrame | None = None) -> None:
    """Files path/<folder>/<file>, each one JSON array of its items in the order of nth; a file without items is [].

    items: (folder, file, nth, json), json on one line; files: (folder, file) of all that are wanted, or those with items.
    Each file is the sorted rows of one task, which streams them, however many there are; see array_files for how files get
    their names. Other files in the folders stay.
    """
    items.sparkSession.dataSource.register(JsonArrays)
    rows = items if files is None else files.select("folder", "file").distinct().join(items, ["folder", "file"], "left")
    rows = rows.repartition("folder", "file").sortWithinPartitions("folder", "file", "nth")
    rows.select("folder", "file", F.col("json").alias("item")).write.format("json_arrays").mode("append").save(path)


def write_clusters(clusters: DataFrame, path: str, projects: DataFrame, rules: list[str]) -> None:
    """A file <class>/<project>_<rule>.json for each project and rule: an array of its clusters, [] without any.

    CWEs, and the representative, are text; findings keep their order, and nulls are written.
    """
    wanted = projects.select(*KEY[:2]).distinct().withColumn("rule", F.explode(F.array(*map(F.lit, rules))))
    name = F.concat("project", F.lit("_"), "rule", F.lit(".json")).alias("file")
    cwe = lambda c: format_cwe(c)
    shown = F.struct("cluster_id", "rule", "tools", F.transform("cwes", cwe).alias("cwes"), cwe(F.col("representative")).alias("representative_cwe"), "findings")
    items = clusters.where(F.col("rule").isin(rules)).select(F.col("class_name").alias("folder"), name, F.col("cluster_id").alias("nth"), F.to_json(shown, {"ignoreNullFields": "false"}).alias("json"))
    write_arrays(items, path, wanted.select(F.col("class_name").alias("folder"), name))


def write_summaries(documents: DataFrame, path: str) -> None:
    """A file <class>.json for each class: an array of objects, each with one project as its only key.

    documents: clusters.project_documents. Projects are in the order of their names.
    """
    value = F.struct(*(c for c in documents.columns if c not in KEY))
    item = F.to_json(F.map_from_arrays(F.array("project"), F.array(value)), {"ignoreNullFields": "false"})
    rows = running_number(documents.select("class_name", "project", item.alias("json")), ["class_name"], ["project"], "nth")
    write_arrays(rows.select(F.lit("").alias("folder"), F.concat("class_name", F.lit(".json")).alias("file"), "nth", "json"), path)


def rule_totals(projects: DataFrame, clusters: DataFrame, rules: list[str]) -> DataFrame:
    """(class_name, project, rule, tot_vulns) for every project and rule, 0 where a rule has no cluster."""
    wanted = projects.select(*KEY[:2]).distinct().withColumn("rule", F.explode(F.array(*map(F.lit, rules))))
    return wanted.join(clusters.groupBy(*KEY).agg(F.count("*").alias("tot_vulns")), KEY, "left").fillna(0, ["tot_vulns"])


def write_documents(rows: DataFrame, path: str) -> None:
    """JSON documents, sorted by project within each file."""
    rows.repartitionByRange("class_name", "project").sortWithinPartitions("class_name", "project").write.mode("overwrite").json(path)


def formatted(spec: str):
    """A column function: numbers as text in the given format, null stays null."""

    @F.pandas_udf("string")
    def show(values: pd.Series) -> pd.Series:
        return values.map(("{:" + spec + "}").format, na_action="ignore").astype(object).where(values.notna(), None)

    return show


def write_table(rows: DataFrame, path: str, fixed: dict[str, int] | None = None) -> None:
    """CSV with a header; null is an empty cell. Numbers with a fraction have up to twelve significant digits, as C's %.12g
    shows them, or, for the columns in `fixed`, that many digits after the point."""
    fixed, general = fixed or {}, formatted(".12g")
    cells = [formatted(f".{fixed[c]}f")(f"`{c}`").alias(c) if c in fixed else general(f"`{c}`").alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in rows.dtypes]
    rows.select(*cells).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
