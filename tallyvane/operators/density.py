"""Alert density per thousand functions and lines, with denominators from metadata or summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions.findings import per_thousand, project_key
from tallyvane.session import lean

PROJECT = ["class_name", "project"]


def with_metadata(reports: DataFrame, metadata: DataFrame) -> DataFrame:
    """Reports joined to metadata; a report without metadata is an error."""
    missing = reports.select(*PROJECT).distinct().join(metadata, PROJECT, "left_anti")
    if (n := missing.count()) > 0:
        raise ValueError(f"{n} projects have no metadata, such as {missing.first()['project']}")
    return reports.join(metadata, PROJECT)


def vulnerability_counts(summary: DataFrame, detail: DataFrame) -> DataFrame:
    """(project, vulns): projects of either table; the number of detailed clusters counts first, else the summary's, else 0."""
    return summary.select(*PROJECT, "tot_vulns").join(detail.select(*PROJECT, "clusters"), PROJECT, "full_outer").select(*PROJECT, F.coalesce("clusters", "tot_vulns", F.lit(0)).cast("long").alias("vulns"))


def denominators(projects: DataFrame, metadata: DataFrame, summary: DataFrame) -> DataFrame:
    """Add functions, loc and denominator_source: metadata first, then the summary.

    The label is synthesis as soon as one of the two values fell back, with /partial if one is still missing; null if both are.
    """
    rows = projects.join(metadata.select(*PROJECT, F.col("functions").alias("mf"), F.col("loc").alias("ml")), PROJECT, "left")
    rows = rows.join(summary.select(*PROJECT, F.col("functions").alias("sf"), F.col("loc").alias("sl")), PROJECT, "left")
    rows = rows.withColumn("functions", F.coalesce("mf", "sf")).withColumn("loc", F.coalesce("ml", "sl"))
    fell = (F.col("mf").isNull() & F.col("sf").isNotNull()) | (F.col("ml").isNull() & F.col("sl").isNotNull())
    label = F.concat(F.when(fell, "synthesis").otherwise("metadata"), F.when(F.col("functions").isNull() | F.col("loc").isNull(), "/partial").otherwise(""))
    return rows.withColumn("denominator_source", F.when(F.col("functions").isNotNull() | F.col("loc").isNotNull(), label)).drop("mf", "ml", "sf", "sl")


def with_densities(rows: DataFrame) -> DataFrame:
    return rows.withColumn("per_kfunctions", per_thousand(F.col("vulns"), F.col("functions"))).withColumn("per_kloc", per_thousand(F.col("vulns"), F.col("loc")))


def class_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Vulnerabilities over all projects; densities only over those that have the denominator."""
    out = rows.groupBy(*by).agg(
        F.count("*").alias("projects"), F.sum("vulns").alias("vulns"), F.sum("functions").alias("functions"), F.sum("loc").alias("loc"),
        F.sum(F.when(F.col("functions").isNotNull(), F.col("vulns"))).alias("vf"), F.sum(F.when(F.col("loc").isNotNull(), F.col("vulns"))).alias("vl"),
    )
    return out.select(*by, "projects", "vulns", "functions", "loc", per_thousand(F.col("vf"), F.col("functions")).alias("per_kfunctions"), per_thousand(F.col("vl"), F.col("loc")).alias("per_kloc"))


def category_density(rows: DataFrame, size: str = "functions") -> DataFrame:
    """(code, category, projects, vulns, size, density) per taxonomy category, per thousand of the column `size`.

    rows have taxonomy_code and taxonomy_label; projects without one are together, as Unclassified. A project without the
    size adds to the vulnerabilities only; categories without any of it are left out.
    """
    key = (F.coalesce("taxonomy_code", F.lit("NULL")).alias("code"), F.coalesce("taxonomy_label", F.lit("Unclassified")).alias("category"))
    out = rows.groupBy(*key).agg(F.count("*").alias("projects"), F.sum("vulns").alias("vulns"), F.coalesce(F.sum(size), F.lit(0)).alias(size))
    return out.where(F.col(size) > 0).withColumn("density", per_thousand(F.col("vulns"), F.col(size)))


def votes_per_rule(summary: DataFrame) -> DataFrame:
    """Clusters per CWE rule over all classes and projects; summary has one row per project and rule."""
    return summary.where(F.col("rule").rlike("out_of_four$")).groupBy("rule").agg(F.sum("tot_vulns").alias("votes"))


def with_taxonomy(projects: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Add code, category and subcategory of the project's name in the taxonomy (key, ...); null if it is not there."""
    named = lean(taxonomy.select("key", "code", "category", "subcategory"))
    return projects.join(named, project_key(projects["project"]) == F.col("key"), "left").drop("key")


def taxonomy_cells(projects: DataFrame, selection: DataFrame, taxonomy: DataFrame, metadata: DataFrame) -> DataFrame:
    """Add taxonomy_code, taxonomy_label and folders.

    An application has the code and name of its category. A kernel has '<n> folders' and their names, of the hand-made
    selection (project, folders) or else of its metadata (class_name, project, folders), where it has any. Others have
    nothing, and no folders.
    """
    chosen = lean(selection.select(project_key(F.col("project")).alias("key"), F.col("folders").alias("chosen")))
    named = lean(taxonomy.select(F.col("key").alias("__key"), F.col("code").alias("__code"), F.col("category").alias("__label")))
    rows = projects.drop("folders").join(named, project_key(F.col("project")) == F.col("__key"), "left")
    rows = rows.join(chosen, project_key(F.col("project")) == F.col("key"), "left").drop("key")
    rows = rows.join(metadata.select(*PROJECT, F.filter("folders", lambda f: f.isNotNull() & (f != "")).alias("own")), PROJECT, "left")
    none = F.array().cast("array<string>")
    folders = F.when(F.col("class_name") == "kernel", F.when(F.size("chosen") > 0, F.col("chosen")).otherwise(F.col("own")))
    rows = rows.withColumn("folders", F.coalesce(folders, none))
    application, some = F.col("class_name") == "application", F.size("folders") > 0
    code = F.when(application, F.col("__code")).when(some, F.concat(F.size("folders").cast("string"), F.lit(" folders")))
    label = F.when(application, F.col("__label")).when(some, F.array_join("folders", ", "))
    return rows.withColumn("taxonomy_code", code).withColumn("taxonomy_label", label).select(*(c for c in projects.columns if c != "folders"), "taxonomy_code", "taxonomy_label", "folders")


#: The columns of the density table, and where they come from.
DENSITY_COLUMNS = {
    "class": "class_name", "project": "project", "taxonomy code": "taxonomy_code", "taxonomy label": "taxonomy_label", "selected kernel folders": "folders",
    "vulnerabilities": "vulns", "functions": "functions", "LOC": "loc", "vulns per 1k functions": "per_kfunctions", "vulns per KLOC": "per_kloc",
    "denominator source": "denominator_source",
}


def density_table(reports: DataFrame) -> DataFrame:
    """The density table of project reports, for sinks.write_table: folders in one cell, NULL as the source of no size."""
    rows = reports.withColumn("folders", F.array_join("folders", "; ")).withColumn("denominator_source", F.coalesce("denominator_source", F.lit("NULL")))
    rows = with_densities(rows).withColumn("functions", F.nullif("functions", F.lit(0))).withColumn("loc", F.nullif("loc", F.lit(0)))
    return rows.select(*(F.col(source).alias(name) for name, source in DENSITY_COLUMNS.items()))


def density_ranking(rows: DataFrame, column: str = "per_kfunctions") -> DataFrame:
    """Add place among all projects of the class by falling density; ties by project; projects without density come last."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("class_name").orderBy(F.desc_nulls_last(column), "project")))
