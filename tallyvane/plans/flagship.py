"""The flagship plan: vote across tools, then alert density per class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.operators import clusters, density, hierarchy, vote
from tallyvane.plans.fixtures import Tables
from tallyvane.session import keep


def clusters_of(tables: Tables, members: bool = False, numbered: bool = True, rules: list[str] | None = None) -> DataFrame:
    """The clusters of the seven rules, or of those in rules, with representatives; their members only where asked for.
    Their ids and earliest findings are null unless numbered: findings then need no order, and are not put in one."""
    findings = vote.prepare(tables.get("findings"))
    if not numbered:
        findings = findings.withColumn("finding_idx", F.lit(None).cast("long"))
    elif not members:
        # Read for the vote and for the first rule, so the report is put in order, and its paths cleaned, once.
        findings = keep(findings.select(*vote.PROJECT, "tool", "filename", "line", "cwe", "finding_idx"))
    placed = vote.attach_functions(findings, tables.get("spans"), keyed=True) if members else vote.place_pieces(findings if numbered else findings.drop("finding_idx"), tables.get("spans"))
    return clusters.all_clusters(placed, tables.get("edges"), members, numbered, rules, findings)


def labels(tables: Tables, related: bool) -> DataFrame:
    """(project, finding_idx, label): findings with the label of their component, where related CWEs agree or any two do."""
    members = vote.place_members(vote.prepare(tables.get("findings")), tables.get("spans"))
    return clusters.member_labels(members, hierarchy.related_pairs(hierarchy.ancestors(tables.get("edges"))) if related else None)


def vote_and_density(tables: Tables) -> DataFrame:
    """Per class: projects, two-tool clusters, and their density per thousand functions and lines."""
    findings = vote.prepare(tables.get("findings")).drop("finding_idx")
    pieces = vote.place_pieces(findings, tables.get("spans"))
    found = clusters.two_tool_clusters(pieces, tables.get("edges")).groupBy(*vote.PROJECT).agg(F.count("*").alias("vulns"))
    rows = tables.get("metadata").join(found, vote.PROJECT, "left").fillna(0, ["vulns"])
    return density.class_totals(rows, ["class_name"])
