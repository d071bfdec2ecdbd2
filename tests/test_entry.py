from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")
#: The rest are compared at every size by the driver; these cover each module here.
SAMPLE = ["a12_cwe_catalog", "b02_cluster_files", "b03_class_documents", "b05_density_table", "c14_comment_stripping", "d04_classes", "f01_report_summary", "f18_project_report", "g06_forest_tops", "g08_forest_paths", "g09_typed_descendants", "g11_forest_roots", "h04_benjamini_yekutieli", "h07_comparison_order", "a03_sarif", "a04_semgrep", "a05_cppcheck", "a05_cppcheck_chunks", "a06_ikos", "a09_class_summary", "c06_paths", "e03_functions", "e07_denominators", "e12_merged_report", "e13_validated_shares", "f03_tool_table", "f07_rule_summary", "f15_root_shares", "f15_validated_roots", "flagship_vote_density", "g03_representatives", "g05_vote_by_place", "j01_mann_whitney", "j02_comparison", "j02_validated_comparison", "j07_kendall"]


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else round(float(value), 5) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def test_every_query_is_registered_with_an_oracle_or_a_reason():
    without = set(CORE) - set(entry.oracle_sql())
    assert without == {"j03_bootstrap", "j03_bootstrap_parity", "j05_poisson_test", "j08_kendall_intervals"}


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sorted(r["class_name"] for r in rows) == ["application", "kernel"] and all(r["vulns"] > 0 for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, name):
    base = duckdb.connect()
    for t in TABLES:
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    want = base.sql(entry.oracle_sql()[name])
    place = [list(want.columns).index(c) for c in got.columns]
    ours = sorted([tuple(map(plain, r)) for r in got.collect()], key=repr)
    theirs = sorted([tuple(plain(r[k]) for k in place) for r in want.fetchall()], key=repr)
    assert ours == theirs and ours
