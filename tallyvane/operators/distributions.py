"""CWE distributions: shares per project, by weakness and by root category, and sets per class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.session import lean

PROJECT = ["class_name", "project"]


def share_matrix(counts: DataFrame, totals: DataFrame, value: str = "cwe") -> DataFrame:
    """(class_name, project, value, share): clusters of each value in percent of the project's clusters.

    counts: (project, value, n); totals: (project, tot_vulns). Every project of a class meets every value that the class
    has, with 0 where absent; projects without clusters stay, with 0. A cluster may count for several values, so shares
    can add up to more than 100. The values are bounded by the catalog, so the grid grows with the projects only.
    """
    grid = totals.join(counts.select("class_name", value).distinct(), "class_name")
    rows = grid.join(counts.select(*PROJECT, value, "n"), [*PROJECT, value], "left")
    share = F.when(F.col("tot_vulns") > 0, F.coalesce("n", F.lit(0)) * 100.0 / F.col("tot_vulns")).otherwise(0.0)
    return rows.select(*PROJECT, value, share.alias("share"))


def by_root(counts: DataFrame, roots: DataFrame) -> DataFrame:
    """Counts per root instead of CWE; a CWE without a root goes to UNKNOWN."""
    rows = counts.join(lean(roots.select(F.col("cwe").alias("number"), "root")), "number", "left")
    return rows.groupBy(*PROJECT, F.coalesce(F.col("root").cast("string"), F.lit("UNKNOWN")).alias("root")).agg(F.sum("n").alias("n"))


def class_means(shares: DataFrame, value: str = "cwe") -> DataFrame:
    return shares.groupBy("class_name", value).agg(F.avg("share").alias("mean_share"), F.count("*").alias("projects"))


def presence(counts: DataFrame, value: str = "cwe", classes: tuple[str, str] = ("kernel", "application")) -> DataFrame:
    """(value, in_<class>, ...): which class has each value."""
    return counts.groupBy(value).agg(*(F.max(F.col("class_name") == c).alias(f"in_{c}") for c in classes))


def set_sizes(found: DataFrame, top: DataFrame, value: str = "number") -> DataFrame:
    """One row: sizes of both classes' sets, union, intersection, exclusives, and members of the Top-25 table (value)."""
    rows = found.join(lean(top.select(value).distinct().withColumn("top", F.lit(True))), value, "left")
    k, a = F.col("in_kernel"), F.col("in_application")
    return rows.agg(
        F.count_if(k).alias("kernel"), F.count_if(a).alias("application"), F.count_if(k | a).alias("in_any"), F.count_if(k & a).alias("in_both"), F.count_if(k & ~a).alias("kernel_only"),
        F.count_if(a & ~k).alias("application_only"), F.count_if(k & F.col("top")).alias("kernel_top"), F.count_if(a & F.col("top")).alias("application_top"),
    )


def set_rows(counts: DataFrame, value: str = "cwe") -> DataFrame:
    """(part, value) for the exclusive parts and the intersection of both classes' sets."""
    kernel, application = (counts.where(F.col("class_name") == c).select(value) for c in ("kernel", "application"))
    parts = {"kernel_only": kernel.subtract(application), "application_only": application.subtract(kernel), "both": kernel.intersect(application)}
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("part"), value)
        out = rows if out is None else out.union(rows)
    return out
