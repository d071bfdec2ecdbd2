from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyvane.operators import audit, clusters, density, hierarchy, ranks, stats, vote
from tallyvane.plans.fixtures import Tables
from tallyvane.streaming.reports import Store, current_findings, merge_stream

FINDING = "class_name string, project string, tool string, filename string, line int, cwe string, rule string, finding_idx long"
SPAN = "class_name string, project string, filename string, name string, scope string, start_line int, end_line int"
RELATED = {(110, 100), (111, 110), (112, 110), (111, 100), (112, 100), (120, 100), (121, 120), (121, 210), (121, 100), (121, 200), (210, 200), (211, 210), (211, 200)}


def related(a, b):
    return a == b or (a, b) in RELATED or (b, a) in RELATED


def pairwise(rows, by_cwe):
    """Labels by testing every pair; rows: (idx, tool, file, line, function, cwe number)."""
    parent = {r[0]: r[0] for r in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in rows:
        for b in rows:
            if a[1] == b[1] or a[2] != b[2]:
                continue
            line = a[3] is not None and a[3] == b[3]
            inside = a[4] is not None and a[4] == b[4] and (not by_cwe or related(a[5], b[5]))
            if (line or inside) and (x := find(a[0])) != (y := find(b[0])):
                parent[max(x, y)] = min(x, y)
    return {r[0]: find(r[0]) for r in rows}


def edges(spark):
    return Tables(spark, "").get("edges")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6))
def test_votes_match_pairwise(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice(clusters.TOOLS), rng.choice("ab"), rng.choice([None, *range(1, 30)]), None, rng.choice([100, 110, 111, 112, 120, 121, 210, 211, 300])) for k in range(rng.randint(1, 60))]
    spans = [("kernel", "p", f, f"f{k}", "s" if k % 2 else None, 8 * k + 1, 8 * k + 6) for f in "ab" for k in range(4)] + [("kernel", "p", "a", "in", None, 2, 3)]
    found = spark.createDataFrame([("kernel", "p", t, f, line, f"cwe-{c}", "r", k) for k, t, f, line, _, c in rows], FINDING)
    placed = vote.attach_functions(vote.prepare(found), spark.createDataFrame(spans, SPAN)).cache()
    functions = {}
    for r in placed.collect():
        functions[r["finding_idx"]] = r["function"]
    for k, _, f, line, _, _ in rows:
        held = [(e - s, s, e, n, sc) for _, _, ff, n, sc, s, e in spans if ff == f and line is not None and s <= line <= e]
        want = min(held, key=lambda x: x[:4]) if held else None
        assert functions[k] == (None if want is None else f"{f}::{want[4] + '::' if want[4] else ''}{want[3]}:{want[1]}-{want[2]}")
    rows = [(k, t, f, line, functions[k], c) for k, t, f, line, _, c in rows]
    pairs = hierarchy.related_pairs(hierarchy.ancestors(edges(spark)))
    for by_cwe, table in ((True, pairs), (False, None)):
        got = {r["finding_idx"]: r["label"] for r in vote.agree(placed, table).collect()}
        assert got == pairwise(rows, by_cwe)


def test_single_line_cluster_with_unrelated_cwes(spark):
    found = spark.createDataFrame([("application", "p", "cppcheck", "a.c", 5, "CWE-100", "x", 0), ("application", "p", "flawfinder", "a.c", 5, "CWE-200", "y", 1), ("application", "p", "flawfinder", "a.c", 5, "CWE-200", "y", 2), ("application", "p", "semgrep", "a.c", 6, None, "y", 3)], FINDING)
    placed = vote.attach_functions(vote.prepare(found), spark.createDataFrame([], SPAN))
    got = {(r["rule"], r["cluster_id"]): r for r in clusters.all_clusters(placed, edges(spark)).collect()}
    assert sorted(got) == [("one_out_of_four", 1), ("one_out_of_four", 2), ("one_out_of_four", 3), ("two_out_four_no_cwe", 1), ("two_out_of_four", 1)]
    two = got["two_out_of_four", 1]
    assert two["tools"] == ["cppcheck", "flawfinder"] and two["cwes"] == [100, 200] and two["representative"] is None and two["size"] == 3
    assert [f["tool"] for f in two["findings"]] == ["cppcheck", "flawfinder", "flawfinder"]
    summary = {(r["rule"], r["cwe"]): (r["n"], r["tot_vulns"]) for r in clusters.rule_summary(clusters.all_clusters(placed, edges(spark))).collect()}
    assert summary["two_out_of_four", "CWE-100"] == (1, 1) and summary["one_out_of_four", "CWE-200"] == (2, 3)


def test_hierarchy(spark):
    t = Tables(spark, "")
    closure = hierarchy.ancestors(edges(spark))
    assert {(r["cwe"], r["ancestor"]) for r in closure.collect()} == RELATED | {(301, 302), (302, 301)}
    sets = spark.createDataFrame([([110, 111, 112],), ([111, 112],), ([121, 210],), ([300],)], "cwes array<int>")
    assert {tuple(r["cwes"]): r["representative"] for r in hierarchy.representatives(sets, closure).collect()} == {(110, 111, 112): 110, (111, 112): None, (121, 210): 210, (300,): 300}
    tops = {r["cwe"]: (r["top_parent"], r["chain"]) for r in hierarchy.top_parents(t.get("nodes"), edges(spark)).collect()}
    assert tops[121] == (100, [121, 120, 100]) and tops[300][0] is None and tops[301][0] is None and tops[100][0] is None
    members = t.get("view_members").where("view_id = 1000").select("cwe", "ord")
    roots = {r["cwe"]: r["root"] for r in hierarchy.view_roots(t.get("nodes"), members, edges(spark)).collect()}
    assert roots[121] == 100 and roots[211] == 200 and roots[301] is None and roots[300] is None


def catalog(rng, weaknesses=14, categories=6):
    """(first parents and further ones, categories' members, views' members), all with order; categories hold later ones."""
    childof = [(c, p, k) for c in range(weaknesses) for k, p in enumerate(rng.sample(range(weaknesses), rng.randrange(3)))]
    owners = range(100, 100 + categories)
    members = [(o, m, k) for o in owners for k, m in enumerate(rng.sample([*range(weaknesses), *range(o + 1, 100 + categories)], rng.randrange(5)))]
    views = [(v, m, k) for v in (1000, 2000) for k, m in enumerate(rng.sample([*range(weaknesses), *owners], rng.randrange(1, 6)))]
    return childof, members, views


def walk_view(view, members, views):
    """What the book says: (where each CWE hangs at last, how often each membership is passed)."""
    hung, passed = {}, {}

    def enter(owner, rows):
        for o, m, _ in rows:
            if o == owner:
                hung[m] = view if rows is views else owner
                passed[(owner, m)] = passed.get((owner, m), 0) + 1
                enter(m, members)

    enter(view, views)
    return hung, passed


def walk_path(cwe, hung, view, up):
    seen, at = set(), cwe
    while at is not None and at not in seen:
        seen.add(at)
        if at in hung:
            path, here = [], at
            while here != view:
                path.insert(0, here)
                here = hung[here]
            return path if at == cwe else [*path, cwe]
        at = up.get(at)
    return None


def walk_root(cwe, members, tops, up):
    claimed = {}

    def claim(m, root):
        if m not in claimed:
            claimed[m] = root
            for o, x, _ in members:
                if o == m:
                    claim(x, root)

    for top in tops:
        claim(top, top)
    seen, at = set(), cwe
    while cwe not in claimed and at is not None and at not in seen:
        if at in tops:
            return at
        seen.add(at)
        at = up.get(at)
    return claimed.get(cwe)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_catalog_walks(spark, seed):
    rng = random.Random(seed)
    childof, members, views = catalog(rng)
    E = spark.createDataFrame(childof, "child int, parent int, ord int")
    M, V = spark.createDataFrame(members, "owner int, member int, ord int"), spark.createDataFrame(views, "view_id int, cwe int, ord int")
    nodes = [*range(14), *range(100, 106), 77]
    N = spark.createDataFrame([(n,) for n in nodes], "cwe int")
    up = {c: p for c, p, k in childof if k == 0}
    walks = {v: walk_view(v, members, views) for v in (1000, 2000)}

    assert {(r["view_id"], r["cwe"]): r["parent"] for r in hierarchy.view_parents(V, M).collect()} == {(v, c): p for v, (hung, _) in walks.items() for c, p in hung.items()}
    assert {(r["view_id"], r["parent"], r["child"]): r["times"] for r in hierarchy.view_links(V, M).collect()} == {(v, *k): n for v, (_, passed) in walks.items() for k, n in passed.items()}

    pairs = spark.createDataFrame([(n, v) for n in nodes for v in (1000, 2000, 3000)], "cwe int, view_id int")
    got = {(r["cwe"], r["view_id"]): r["path"] for r in hierarchy.paths_in_views(pairs, V, M, E).collect()}
    assert got == {(n, v): walk_path(n, walks[v][0], v, up) if v in walks else None for n in nodes for v in (1000, 2000, 3000)}

    links = E.select("child", "parent", F.lit("weakness").alias("kind"), F.lit(1000).alias("view_id"), F.lit(0).alias("seq"), "ord")
    parents = hierarchy.root_parents(links, M.select("*", F.lit("category").alias("kind"), F.col("owner").alias("seq")))
    over = dict(reversed([(m, o) for o, m, _ in members])) | up
    tops = [m for v, m, _ in views if v == 1000]
    roots = {r["cwe"]: r["root"] for r in hierarchy.view_roots(N, V.where("view_id = 1000"), parents, M).collect()}
    assert roots == {n: walk_root(n, members, tops, over) for n in nodes}

    chains = {r["node"]: (r["end"], r["chain"]) for r in hierarchy.follow(hierarchy.first_parents(E)).collect()}
    for n in up:
        chain = [n]
        while up.get(chain[-1]) is not None and up[chain[-1]] not in chain:
            chain.append(up[chain[-1]])
        assert chains[n] == (None if chain[-1] in up else chain[-1], chain)

    kinds = [(n, "weakness") for n in range(14)] + [(n, "category") for n in range(100, 106)] + [(1000, "view"), (2000, "view")]
    for depth in (None, 0, 2):
        want = []
        for n in [*nodes, 1000]:
            kind = dict(kinds).get(n, "unknown").capitalize()
            graphs = {str(n): walks[n][1]} if kind == "View" else {}
            if kind == "Category":
                graphs = {str(v): passed for v, (hung, passed) in walks.items() if n in hung} or {"no_view": {(o, m): 1 for o, m, _ in members}}
            want += [] if graphs else [(n, kind, None, None, None, None)]
            for view, graph in graphs.items():
                level, found, d = {n: 1}, [], 0
                while level and (depth is None or d < depth):
                    d, below = d + 1, {}
                    for (o, m), k in graph.items():
                        if o in level:
                            below[m] = below.get(m, 0) + level[o] * k
                    level = below
                    found += [(n, kind, view, d, m, k) for m, k in level.items()]
                want += found or [(n, kind, view, None, None, None)]
        got = hierarchy.typed_descendants(spark.createDataFrame([(n,) for n in [*nodes, 1000]], "id int"), spark.createDataFrame(kinds, "cwe int, kind string"), V, M, depth)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_roots_and_paths_of_a_small_catalog(spark):
    """A member's descendants by ChildOf are not its own where a first parent leads elsewhere; ancestors between are left out."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    E = frame([(9, 1, 0), (9, 6, 1), (6, 5, 0)], "child int, parent int, ord int")
    roots = hierarchy.view_roots(frame([(9,), (6,)], "cwe int"), frame([(5, 0), (1, 1)], "cwe int, ord int"), E)
    assert {tuple(r) for r in roots.collect()} == {(9, 1), (6, 5)}
    E, none = frame([(111, 110, 0), (110, 100, 0)], "child int, parent int, ord int"), frame([], "owner int, member int, ord int")
    paths = hierarchy.paths_in_views(frame([(111, 1)], "cwe int, view_id int"), frame([(1, 100, 0)], "view_id int, cwe int, ord int"), none, E)
    assert paths.first()["path"] == [100, 111]
    ring = frame([(7, 8, 0), (8, 7, 0)], "owner int, member int, ord int")
    with pytest.raises(ValueError, match="contain themselves"):
        hierarchy.view_parents(frame([(1, 7, 0)], "view_id int, cwe int, ord int"), ring)
    with pytest.raises(ValueError, match="contain themselves"):
        hierarchy.category_descendants(frame([(7,)], "cwe int"), ring)
    assert {(r["depth"], r["cwe"]) for r in hierarchy.category_descendants(frame([(7,)], "cwe int"), ring, 3).collect()} == {(1, 8), (2, 7), (3, 8)}


@pytest.mark.parametrize("seed", [1, 2])
def test_categories_that_contain_themselves(spark, seed):
    """With rings a walk does not enter a category that it is in; plain walks over catalogs whose categories hold any other."""
    rng = random.Random(seed)
    owners = range(100, 105)
    members = [(100, 101, 9), (101, 100, 9)] + [(o, m, k) for o in owners for k, m in enumerate(rng.sample([*range(4), *owners], 3)) if (o, m) not in ((100, 101), (101, 100))]
    views = [(1000, 100, 0), (1000, 102, 1), (2000, 103, 0)]
    hung, passed = {}, {}

    def enter(view, owner, path, rows):
        for o, m, _ in sorted((r for r in rows if r[0] == owner), key=lambda r: r[2]):
            if m not in path:
                hung[(view, m)] = owner
                passed[(view, owner, m)] = passed.get((view, owner, m), 0) + 1
                enter(view, m, [*path, m], members)

    for view in (1000, 2000):
        enter(view, view, [], views)
    M, V = spark.createDataFrame(members, "owner int, member int, ord int"), spark.createDataFrame(views, "view_id int, cwe int, ord int")
    assert {(r["view_id"], r["cwe"]): r["parent"] for r in hierarchy.view_parents(V, M, rings=True).collect()} == hung
    assert {(r["view_id"], r["parent"], r["child"]): r["times"] for r in hierarchy.view_links(V, M, rings=True).collect()} == passed
    want = {}

    def descend(start, at, path, depth):
        for o, m, _ in members:
            if o == at and m not in path:
                want[(start, depth, m)] = want.get((start, depth, m), 0) + 1
                descend(start, m, [*path, m], depth + 1)

    for start in owners:
        descend(start, start, [start], 1)
    found = hierarchy.category_descendants(spark.createDataFrame([(o,) for o in owners], "cwe int"), M, rings=True)
    assert {(r["start"], r["depth"], r["cwe"]): r["times"] for r in found.collect()} == want


def test_nodes_that_are_listed_twice(spark):
    """A number that is a weakness and a category: one row in the tops, as many rows as nodes have in the roots."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    nodes, E = frame([(9,), (9,), (1,)], "cwe int"), frame([(9, 1, 0)], "child int, parent int, ord int")
    assert sorted((r["cwe"], r["top_parent"]) for r in hierarchy.top_parents(nodes, E).collect()) == [(1, None), (9, 1)]
    roots = hierarchy.view_roots(nodes, frame([(1, 0)], "cwe int, ord int"), E)
    assert sorted(tuple(r) for r in roots.collect()) == [(1, 1), (9, 1), (9, 1)]


def test_denominators_and_totals(spark):
    key = "class_name string, project string"
    projects = spark.createDataFrame([("k", p) for p in "abcd"], key)
    meta = spark.createDataFrame([("k", "a", 10, 100), ("k", "b", None, 100), ("k", "c", None, None)], key + ", functions long, loc long")
    summary = spark.createDataFrame([("k", "b", 7, 9), ("k", "c", None, 5)], key + ", functions long, loc long")
    got = {r["project"]: (r["functions"], r["loc"], r["denominator_source"]) for r in density.denominators(projects, meta, summary).collect()}
    assert got == {"a": (10, 100, "metadata"), "b": (7, 100, "synthesis"), "c": (None, 5, "synthesis/partial"), "d": (None, None, None)}
    rows = spark.createDataFrame([("k", "a", 5, 10, None), ("k", "b", 7, None, 100)], key + ", vulns long, functions long, loc long")
    total = density.class_totals(rows, ["class_name"]).first()
    assert (total["vulns"], total["per_kfunctions"], total["per_kloc"]) == (12, 500.0, 70.0)
    with pytest.raises(ValueError, match="no metadata"):
        density.with_metadata(projects, meta)


def test_audit(spark):
    key = "class_name string, project string, tool string"
    runs = spark.createDataFrame([("k", "a", "codeql", "completed", 5, 0), ("k", "a", "semgrep", "failed", 3, 1), ("k", "b", "codeql", "skipped", None, 0)], key + ", status string, findings long, ord int")
    assert {r["project"]: r["tools"] for r in audit.report_summary(runs).collect()} == {"a": 2, "b": 1}
    assert {r["tool"]: r["findings"] for r in audit.findings_per_tool(runs).collect()} == {"codeql": 5, "TOTAL": 5}
    table = {r["project"]: (r["codeql"], r["semgrep"]) for r in audit.tool_table(runs, ["codeql", "semgrep"]).collect()}
    assert table == {"a": (5, None), "b": (None, None)}
    chunks = spark.createDataFrame([(1, "x", "completed", 0), (1, "y", "timeout", None), (2, "x", "completed", 0), (3, "x", "skipped", None), (4, "b", "failed", 137), (4, "a", "failed", None)], "id int, chunk string, status string, exit_code int")
    got = {r["id"]: (r["status"], r["message"]) for r in audit.chunk_status(chunks, ["id"]).collect()}
    assert got == {1: ("timeout", "1/2 chunks completed; failed: y (timeout)"), 2: ("completed", None), 3: ("failed", "0/1 chunks completed; failed: x (skipped)"), 4: ("failed", "0/2 chunks completed; failed: a (failed), b (failed, exit 137)")}
    old = spark.createDataFrame([("k", "a", "codeql"), ("k", "a", "semgrep"), ("k", "b", "semgrep")], key)
    merged = audit.merge_runs(old, old.limit(0), spark.createDataFrame([("k", "a", "semgrep")], key))
    assert sorted((r["project"], r["tool"]) for r in merged.collect()) == [("a", "codeql"), ("b", "semgrep")]


def test_merged_reports(spark):
    key = "class_name string, project string, tool string"
    runs, found = key + ", status string, findings long, ord int", key + ", filename string, line int, cwe string, rule string, finding_idx long"
    old = spark.createDataFrame([("k", "a", "semgrep", "completed", 2, 1), ("k", "a", "codeql", "failed", 0, 2), ("k", "b", "ikos", "completed", 1, 1)], runs)
    fresh = spark.createDataFrame([("k", "a", "codeql", "completed", 2, 1), ("k", "a", "semgrep", "timeout", 0, 2), ("k", "c", "ikos", "skipped", 0, 1)], runs)
    had = spark.createDataFrame([("k", "a", "semgrep", "z.c", 1, None, "r", 0), ("k", "a", "semgrep", "z.c", 2, None, "r", 1), ("k", "b", "ikos", "b.c", None, None, None, 0)], found)
    new = spark.createDataFrame([("k", "a", "codeql", "b.c", 5, None, "q", 0), ("k", "a", "codeql", "b.c", None, None, None, 1)], found)
    got = {r["project"]: r for r in audit.merged_documents(old, had, fresh, new).collect()}
    assert sorted(got) == ["a", "b", "c"]
    assert got["a"]["summary"].asDict() == {"tools": 2, "completed": 1, "failed": 0, "timeout": 1, "unavailable": 0, "findings": 2}
    assert [t["tool"] for t in got["a"]["tools"]] == ["codeql", "semgrep"] and [(f["line"], f["rule"]) for f in got["a"]["findings"]] == [(None, None), (5, "q")]
    assert got["b"]["summary"]["findings"] == 1 and got["c"]["findings"] == [] and got["c"]["summary"]["tools"] == 1
    same = spark.createDataFrame([("k", "a", "codeql", "z.c", 2, None, "r", 0), ("k", "a", "codeql", "z.c", 2, None, "r", 1)], found)
    runs_, rows = audit.merge_reports(old, had, fresh.where("tool = 'codeql'"), same)
    assert [(r["tool"], r["line"]) for r in rows.where("project = 'a'").orderBy("finding_idx").collect()] == [("semgrep", 1), ("codeql", 2), ("codeql", 2), ("semgrep", 2)]


def test_mann_whitney_and_kendall(spark):
    rng = np.random.default_rng(1)
    rows = [("c", f"p{k}", "kernel" if k < 7 else "application", float(v)) for k, v in enumerate(rng.integers(0, 6, 30))]
    got = stats.with_p(stats.mann_whitney(spark.createDataFrame(rows, "cwe string, project string, class_name string, share double"), ["cwe"])).first()
    a, b = [r[3] for r in rows if r[2] == "kernel"], [r[3] for r in rows if r[2] != "kernel"]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert got["u"] == u and got["delta"] == pytest.approx(sum((x > y) - (x < y) for x in a for y in b) / (len(a) * len(b))) and 0 < got["p"] <= 1
    x, y = np.arange(6.0), np.array([0, 2, 1, 3, 5, 4.0])
    # 15 pairs, 2 inversions: 1 + 5 + 14 = 20 of 720 orders have at most 2.
    assert stats.tau_b(x, y) == pytest.approx(11 / 15) and stats.kendall_p(x, y) == pytest.approx(2 * 20 / 720)
    assert stats.kendall_p(np.repeat(x, 2), np.repeat(y, 2)) < 0.01
    table = spark.createDataFrame([("k", f"p{k}", a, b) for k, (a, b) in enumerate(zip(x.tolist(), y.tolist()))], "class_name string, project string, x double, y double")
    assert stats.kendall(table, ["class_name"], "x", "y").first()["tau"] == pytest.approx(11 / 15)
    tied = [("k" if k % 3 else "a", float(v), float(w)) for k, (v, w) in enumerate(rng.integers(0, 9, (90, 2)))]
    got = {r["class_name"]: (r["n"], r["tau"]) for r in stats.kendall(spark.createDataFrame(tied, "class_name string, x double, y double"), ["class_name"], "x", "y").collect()}
    for c in "ka":
        v = np.array([r[1:] for r in tied if r[0] == c])
        assert got[c] == (len(v), pytest.approx(stats.tau_b(v[:, 0], v[:, 1])))
    first, second = (stats.kendall_intervals(table, ["class_name"], "x", "y", "project", draws=50).first() for _ in range(2))
    assert first == second and first["low"] <= first["tau"] <= first["high"]


def test_e_test():
    assert stats.e_test(5, 100, 5, 100) == pytest.approx(1.0)
    assert stats.e_test(0, 10, 0, 10) == 1.0
    assert stats.e_test(10, 100, 40, 100) < 1e-4
    # Twelve against six with equal exposure, from the published E-test.
    assert stats.e_test(12, 100, 6, 100) == pytest.approx(0.17, abs=0.015)


def test_benjamini_yekutieli(spark):
    p = [0.001, 0.02, 0.02, 0.9]
    rows = spark.createDataFrame([(f"c{k}", v) for k, v in enumerate(p)], "cwe string, p double")
    got = {r["cwe"]: r["q"] for r in stats.benjamini_yekutieli(rows).collect()}
    h = sum(1 / k for k in range(1, 5))
    assert got == pytest.approx({"c0": 0.004 * h, "c1": 0.08 * h / 3, "c2": 0.08 * h / 3, "c3": 1.0})


def test_ranks_go_on_across_ranges(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(500) ** 2, 2)
    rows = spark.createDataFrame([(f"c{k:03d}", float(v), "x") for k, v in enumerate(p)], "cwe string, p double, q0 string").repartition(7)
    got = {r["cwe"]: r["q"] for r in stats.benjamini_yekutieli(rows).collect()}
    order = sorted(range(500), key=lambda k: (p[k], k))
    h, best, want = sum(1 / k for k in range(1, 501)), 1.0, {}
    for rank in range(500, 0, -1):
        k = order[rank - 1]
        want[f"c{k:03d}"] = best = min(best, p[k] * h * 500 / rank)
    assert got == pytest.approx(want)
    assert stats.benjamini_yekutieli(rows.limit(0)).count() == 0


def slow_tau(x, y):
    sx, sy = (np.sign(v[:, None] - v[None, :]) for v in (x, y))
    scale = np.sqrt(float((sx != 0).sum()) * float((sy != 0).sum()))
    return float((sx * sy).sum()) / scale if scale else np.nan


def slow_p(n, inverted):
    """By listing all orders."""
    counts = [sum(a > b for i, a in enumerate(p) for b in p[i + 1 :]) for p in itertools.permutations(range(n))]
    fewer = min(inverted, n * (n - 1) // 2 - inverted)
    return min(1.0, 2 * sum(c <= fewer for c in counts) / len(counts))


def test_exact_p_of_kendall():
    for n in range(3, 8):
        for inverted in range(n * (n - 1) // 2 + 1):
            assert stats.exact_kendall(n, inverted) == pytest.approx(slow_p(n, inverted))
    x = np.arange(60.0)
    swapped = x.copy()
    swapped[[3, 4]] = swapped[[4, 3]]
    assert stats.kendall_p(x, x) == pytest.approx(2 / math.factorial(60)) and stats.kendall_p(x, -swapped) == pytest.approx(2 / math.factorial(59))


@pytest.mark.parametrize("top", [2, 9, 10_000])
def test_kendall_over_ranges(spark, top):
    """Ranges of a few rows, with a value that most rows have, against all pairs."""
    rng = np.random.default_rng(top)
    x, y = rng.integers(0, top, 160).astype(float), rng.integers(0, top, 160).astype(float)
    x[:70], y[40:100] = 1.0, 1.0
    rows = [("a" if k < 120 else None, float(v), float(w)) for k, (v, w) in enumerate(zip(x, y))] + [("few", 1.0, 2.0), ("few", 2.0, None), ("flat", 1.0, 1.0)] + [("flat", 1.0, float(k)) for k in range(5)] + [("line", float(k), 2.0 * k) for k in range(40)]
    got = {r["key"]: r for r in stats.kendall(spark.createDataFrame(rows, "key string, x double, y double"), ["key"], "x", "y", size=16).where("key is not null").collect()}
    assert got["few"]["tau"] is None and got["few"]["p"] is None and got["flat"]["p"] is None and got["flat"]["n"] == 6
    assert got["line"]["tau"] == 1 and got["line"]["p"] == pytest.approx(2 / math.factorial(40))
    assert got["a"]["n"] == 120 and got["a"]["tau"] == pytest.approx(slow_tau(x[:120], y[:120])) and got["a"]["p"] == pytest.approx(stats.kendall_p(x[:120], y[:120]))


def test_tau_matches_all_pairs():
    rng = np.random.default_rng(5)
    for n in (2, 3, 5, 20, 70):
        for top in (1, 3, 1000):
            x, y = rng.integers(0, top, n).astype(float), rng.integers(0, top, n).astype(float)
            assert stats.tau_b(x, y) == pytest.approx(slow_tau(x, y), nan_ok=True)


def test_intervals_match_plain_loops(spark):
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 20, 25).astype(float), rng.integers(0, 5, 25).astype(float)
    names = sorted(f"p{k}" for k in range(25))
    table = spark.createDataFrame([("k", n, float(a), float(b)) for n, a, b in zip(names, x, y)], "class_name string, project string, x double, y double")
    got = stats.kendall_intervals(table, ["class_name"], "x", "y", "project", draws=300, block=70).first()
    draw, taus = np.random.default_rng(42), []
    for _ in range(300):
        at = draw.integers(0, 25, size=25)
        taus.append(slow_tau(x[at], y[at]))
    low, high = np.percentile(np.array(taus)[~np.isnan(taus)], [2.5, 97.5])
    assert (got["tau"], got["low"], got["high"]) == pytest.approx((slow_tau(x, y), low, high))

    kernel, application = rng.integers(0, 4, 7).astype(float), rng.integers(0, 4, 18).astype(float)
    shares = [("c", f"p{k:02d}", "kernel" if k < 7 else "application", float(v)) for k, v in enumerate([*kernel, *application])]
    shares = spark.createDataFrame(shares, "cwe string, project string, class_name string, share double")
    draw, ps, deltas = np.random.default_rng(42), [], []
    for _ in range(200):
        a, b = kernel[draw.integers(0, 7, size=7)], application[draw.integers(0, 18, size=18)]
        u = sum((v > w) + 0.5 * (v == w) for v in a for w in b)
        ties = np.unique([*a, *b], return_counts=True)[1].astype(float)
        spread = math.sqrt(7 * 18 / 12 * (26 - (ties**3 - ties).sum() / (25 * 24)))
        ps.append(min(1.0, math.erfc((abs(u - 63) - 0.5) / spread / math.sqrt(2))) if spread else 1.0)
        deltas.append(2 * u / 126 - 1)
    got = stats.bootstrap_exact_parity(shares, "cwe", draws=200).first()
    assert [got[c] for c in ("p_low", "p_high", "delta_low", "delta_high")] == pytest.approx([*np.percentile(ps, [2.5, 97.5]), *np.percentile(deltas, [2.5, 97.5])])
    near = stats.bootstrap_mann_whitney(shares, "cwe", draws=400).first()
    assert abs(near["delta_low"] - got["delta_low"]) < 0.2 and abs(near["delta_high"] - got["delta_high"]) < 0.2


def test_hot_file_and_long_chains_have_one_label(spark):
    """Findings of one file in a chain of lines and functions; every label is the first finding's."""
    n = 400
    rows = [("k", "p", "abcd"[k % 2], "a.c", k // 2, "CWE-100", "r", k, f"f{(k + 1) // 2}") for k in range(n)]
    placed = spark.createDataFrame(rows, FINDING + ", function string")
    got = {r["finding_idx"]: r["label"] for r in vote.agree(placed, None).collect()}
    assert got == dict.fromkeys(range(n), 0)


def test_one_project_holds_all_findings(spark):
    """Positions, report order and cluster ids of a project that lies in many ranges."""
    rng, n = random.Random(12), 2000
    found = [("k", "p", rng.choice(["codeql", "semgrep", "cppcheck"]), f"f{rng.randrange(6)}.c", rng.choice([None, *range(1, 300)]), f"CWE-{rng.choice([100, 110, 200])}", rng.choice(["r", None]), k) for k in range(n)]
    table = spark.createDataFrame(found, FINDING).repartition(6)
    placed = vote.attach_functions(vote.prepare(table), spark.createDataFrame([], SPAN))
    got = clusters.all_clusters(placed, edges(spark), members=False).collect()
    for rule in {r["rule"] for r in got}:
        own = sorted((r["min_idx"], r["cluster_id"]) for r in got if r["rule"] == rule)
        assert [c for _, c in own] == list(range(1, len(own) + 1)), rule
    assert sum(r["rule"] == "one_out_of_four" for r in got) == n and any(r["rule"] == "three_out_of_four" for r in got)
    assert all(r["representative"] is None for r in got if r["rule"].endswith("no_cwe")) and any(r["representative"] for r in got if r["rule"] == "two_out_of_four")
    order = {r["arrival"]: r["finding_idx"] for r in audit.ordered_findings(table.withColumnRenamed("finding_idx", "arrival")).collect()}
    want = sorted(found, key=lambda f: (f[3], f[4] or -1, f[2], f[6] or "", f[7]))
    assert order == {f[7]: k for k, f in enumerate(want)}


def test_selections(spark):
    rows = spark.createDataFrame([("zoo", "codeql"), ("application", "ikos"), ("Beta", "codeql"), ("kernel", "semgrep")], "class_name string, tool string")
    assert [r["class_name"] for r in audit.classes(rows).orderBy("place").collect()] == ["kernel", "application", "Beta", "zoo"]
    assert audit.select_classes(rows).count() == 4 and audit.select_classes(rows, ["zoo"]).count() == 1
    assert audit.select_tools(rows, ["codeql"]).count() == 2


def test_stream_keeps_the_latest_runs(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()

    def run(tool, sequence, *lines):
        found = [{"filename": "f", "line": n, "cwe": None, "rule": "r", "message": "m"} for n in lines]
        return json.dumps({"class_name": "k", "project": "a", "tool": tool, "sequence": sequence, "findings": found})

    batches = [[run("codeql", 1, 1), run("semgrep", 1, 2, 5), run("cppcheck", 1, 7)], [run("codeql", 2, 3), run("codeql", 3, 4), run("semgrep", 2)]]
    for k, lines in enumerate(batches):
        (incoming / f"{k}.json").write_text("\n".join(lines))
        query = merge_stream(spark, str(incoming), str(tmp_path / "store"), str(tmp_path / "check"))
        query.awaitTermination(120)
        assert query.exception() is None
    got = current_findings(spark, str(tmp_path / "store")).collect()
    assert sorted((r["tool"], r["line"]) for r in got) == [("codeql", 4), ("cppcheck", 7)]


def test_late_runs_and_compaction(spark, tmp_path):
    """An older run in a later batch changes nothing, before compaction and after; a store stopped half-way is whole."""
    store = Store(spark, str(tmp_path / "store"))
    schema = "class_name string, project string, tool string, sequence bigint, findings array<struct<filename:string,line:int,cwe:string,rule:string,message:string>>"

    def add(number, *runs):
        store.add(spark.createDataFrame([("k", "a", tool, sequence, [("f", n, None, "r", "m") for n in lines]) for tool, sequence, lines in runs], schema), number)

    def lines():
        return sorted((r["tool"], r["line"]) for r in current_findings(spark, str(tmp_path / "store")).collect())

    assert lines() == []
    add(0, ("codeql", 5, [1, 2]), ("semgrep", 2, [3]), ("ikos", None, [8]))
    add(1, ("codeql", 3, [9]), ("semgrep", 4, []), ("cppcheck", 1, [7]))
    want = [("codeql", 1), ("codeql", 2), ("cppcheck", 7), ("ikos", 8)]
    assert lines() == want
    store.compact()
    assert lines() == want and store.layout() == (1, [])
    add(1, ("codeql", 9, [50]))  # a repeated batch that the base holds
    add(2, ("codeql", 4, [9]), ("semgrep", 3, [9]), ("cppcheck", 1, [6]))
    assert lines() == [("codeql", 1), ("codeql", 2), ("cppcheck", 6), ("ikos", 8)] and store.layout() == (1, [2])
    add(3, ("semgrep", 6, [4]))
    runs, findings = store.latest()
    store._write(findings, "findings", "base", 3)  # stopped before the runs
    want = [("codeql", 1), ("codeql", 2), ("cppcheck", 6), ("ikos", 8), ("semgrep", 4)]
    assert store.layout() == (1, [2, 3]) and lines() == want
    store.compact()
    assert store.layout() == (3, []) and lines() == want
    assert sorted(p.name for p in (tmp_path / "store" / "runs").iterdir()) == ["base-3"]
    store.compact()
    assert store.layout() == (3, []) and lines() == want


def test_registered_bootstraps_run_all_draws(spark, monkeypatch):
    from tallyvane.plans import queries

    called = []

    def mann_whitney(samples, key, value="share", draws=2000, seed=42):
        called.append(draws)
        return spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0)], "cwe string, p_low double, p_high double, delta_low double, delta_high double")

    def intervals(rows, by, x, y, key, draws=1000, seed=42):
        called.append((x, y, draws, "combined" in {r[0] for r in rows.select("class_name").distinct().collect()}))
        return spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0)], "class_name string, tau double, p double, low double, high double")

    monkeypatch.setattr(queries.stats, "bootstrap_mann_whitney", mann_whitney)
    monkeypatch.setattr(queries.stats, "kendall_intervals", intervals)
    queries.QUERIES["j03_bootstrap"](spark, "/root/testdata/sf0.001")
    queries.QUERIES["j08_kendall_intervals"](spark, "/root/testdata/sf0.001")
    assert called == [2000, ("loc", "per_kloc", 10_000, True), ("functions", "per_kfunctions", 10_000, True)]


def test_running_numbers_of_one_large_key(spark):
    rng = random.Random(6)
    rows = [("big" if k % 3 else rng.choice(["a", "b", None]), rng.randrange(40), k) for k in range(3000)]
    table = spark.createDataFrame(rows, "key string, v int, id int").repartition(7)
    got = ranks.running_number(table, ["key"], [F.desc("v"), F.asc("id")], "nth").collect()
    want, seen = {}, {}
    for key, _, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        seen[key] = seen.get(key, 0) + 1
        want[i] = seen[key]
    assert got[0].__fields__ == ["key", "v", "id", "nth"] and {r["id"]: r["nth"] for r in got} == want
    totals = {(r["key"], r["v"]): r["sum"] for r in ranks.running_total(table.groupBy("key", "v").agg(F.sum("id").alias("n")), ["key"], "v", "n", "sum").collect()}
    assert totals == {(key, v): sum(i for k, w, i in rows if k == key and w < v) for key, v, _ in rows}
    everything = ranks.running_number(table, [], ["id"]).collect()
    assert sorted((r["id"], r["place"]) for r in everything) == [(k, k + 1) for k in range(3000)]
    assert ranks.running_number(table.limit(0), ["key"], ["id"]).count() == 0


def test_resamples_are_those_of_the_plain_forms(spark):
    """Draws of the bootstrap by Spark's own hash, and tau of resamples by tau_b of the drawn rows."""
    rng = np.random.default_rng(3)
    i = np.array([0, 1, 7, 123_456, 2**40])
    want = spark.createDataFrame([(int(v),) for v in i], "i long").select(F.xxhash64(F.lit(42), F.lit("kernel"), F.lit(5), "i"), F.xxhash64(F.lit(42), F.lit("kernel"), F.lit(5))).collect()
    assert stats._seeded(want[0][1], stats._hashed(i)).tolist() == [r[0] for r in want]
    for n in (4, 50, 300):
        x, y = rng.integers(0, n // 2, n).astype(float), rng.integers(0, n, n).astype(float)
        resampled = stats.Resampled(x, y)
        for _ in range(5):
            at = rng.integers(0, n, n)
            assert np.array_equal(resampled.tau(at), stats.tau_b(x[at], y[at]), equal_nan=True)


def test_paths_without_and_with_ways_up(spark):
    from tallyvane.functions.findings import normal_path

    cases = ["src/./a.c", "./a", "a/", "a//b/./", "/", ".", "", "a/../b", "../a/..", "a/.b/..c", "a.", "./.", "a/./.hid"]
    plain = lambda p: [x for x in p.split("/") if x not in ("", ".")]
    got = spark.createDataFrame([(c,) for c in cases], "p string").select("p", normal_path(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in got if ".." not in r["p"]} == {c: "/".join(plain(c)) for c in cases if ".." not in c}
    assert {r["p"]: r["n"] for r in got if ".." in r["p"]} == {"a/../b": "b", "../a/..": "..", "a/.b/..c": "a/.b/..c"}


def test_findings_of_a_function_need_no_search(spark, monkeypatch):
    """Clusters of functions come from one row for each, without star contractions; those of long ones, by these, are the same."""
    rng = random.Random(5)
    found = [("kernel", "p", rng.choice(clusters.TOOLS), rng.choice("ab"), rng.choice([None, *range(1, 150)]), f"CWE-{rng.choice([100, 110, 111, 121, 200, 211, 300])}", "r", k) for k in range(150)]
    spans = [("kernel", "p", f, f"f{k}", None, 20 * k + 1, 20 * k + 18) for f in "ab" for k in range(7)]
    placed = vote.attach_functions(vote.prepare(spark.createDataFrame(found, FINDING)), spark.createDataFrame(spans, SPAN), keyed=True).cache()
    rows = lambda: sorted(map(repr, clusters.all_clusters(placed, edges(spark)).collect()))
    monkeypatch.setattr(clusters, "LONG", 0)
    searched = rows()
    monkeypatch.undo()
    monkeypatch.setattr(vote, "connected_components", lambda *_: pytest.fail("searched"))
    assert rows() == searched and any("three_out_of_four" in r for r in searched)


def test_summaries_read_no_function_names(spark, monkeypatch):
    """Numbers of spans stand for functions, and findings are numbered by shares of a report; both give the rows of the cluster files."""
    from tallyvane.plans import flagship

    rng = random.Random(8)
    found = [("kernel", "p", rng.choice(clusters.TOOLS), rng.choice("ab"), rng.choice([None, *range(1, 300)]), f"CWE-{rng.choice([100, 110, 111, 121, 200, 211, 300])}", "r", 3 * k) for k in range(300)]
    lines = [(a, a + rng.choice([0, 3, 20, 90])) for a in rng.sample(range(-3, 300), 40)]
    spans = [("kernel", "p", rng.choice("ab"), name, None, a, b) for a, b in lines for name in rng.choice(["x", "xy", "x_"])] + [("kernel", "p", "a", None, None, 1, 300), ("kernel", "p", "a", "back", None, 90, 10)]
    tables = {"findings": spark.createDataFrame(found, FINDING), "spans": spark.createDataFrame(spans, SPAN), "edges": edges(spark)}
    given = type("Given", (), {"get": lambda self, name: tables[name]})()
    rows = lambda members: sorted(map(repr, flagship.clusters_of(given, members).select("project", "rule", "cluster_id", "min_idx", "tools", "cwes", "size", "representative").collect()))
    want = rows(True)
    monkeypatch.setattr(vote, "SHARE", 7)
    monkeypatch.setattr(vote, "attach_functions", lambda *a, **k: pytest.fail("names"))
    assert rows(False) == want and any("three_out_of_four" in r for r in want)


def test_functions_in_blocks_of_lines(spark, monkeypatch):
    """Functions inside of a block, in many, and too long for one row give the rows of the cluster files, numbered or not,
    also where a block has more findings than are taken at a time."""
    from tallyvane.plans import flagship

    rng = random.Random(21)
    cwes = [100, 110, 111, 121, 200, 211, 300]
    found = [("kernel", rng.choice("pq"), rng.choice([*clusters.TOOLS, None]), rng.choice(["a", "b", None]), rng.choice([None, *range(1, 200)]), f"CWE-{rng.choice(cwes)}", "r", k) for k in range(500)]
    found += [("kernel", "p", t, "hot", 5 + k % 2, "CWE-100", "r", 500 + 2 * k + (t == "semgrep")) for k in range(150) for t in ("codeql", "semgrep")]
    lines = [(a, a + rng.choice([0, 3, 9, 20, 60, 150])) for a in rng.sample(range(-5, 200), 50)]
    spans = [("kernel", rng.choice("pq"), rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), None, a, b) for a, b in lines] + [("kernel", "p", "hot", "x", None, 1, 9)] * 2
    tables = {"findings": spark.createDataFrame(found, FINDING), "spans": spark.createDataFrame(spans, SPAN), "edges": edges(spark)}
    given = type("Given", (), {"get": lambda self, name: tables[name]})()
    columns = ["project", "rule", "tools", "cwes", "representative"]
    rows = lambda *more, **how: sorted(map(repr, flagship.clusters_of(given, **how).select(*columns, *more).collect()))
    numbers = ["cluster_id", "min_idx", "size"]
    want, plain = rows(*numbers, members=True), rows(members=True)
    assert rows(*numbers) == want and rows(numbered=False) == plain
    monkeypatch.setattr(vote, "BATCH", 40)
    monkeypatch.setattr(vote, "BLOCK", 16)
    assert rows(*numbers) == want
    monkeypatch.setattr(clusters, "LONG", 30)
    assert rows(*numbers) == want and rows(numbered=False) == plain
    pieces = vote.place_pieces(vote.prepare(tables["findings"]), tables["spans"]).where("open").agg(F.max("length"), F.min("length")).first()
    assert pieces[0] > 30 >= pieces[1]


def test_blocks_of_the_same_hash_stay_apart():
    rng = random.Random(4)
    rows = [(rng.choice("pq"), rng.choice("ab"), rng.choice(clusters.TOOLS), (rng.randrange(1, 60) << 32) + 100, None) for _ in range(300)]
    rows += [(p, f, None, b << 32, [(1 << 32) + 20, (25 << 32) + 3]) for p in "pq" for f in "ab" for b in (0, 32)]
    kept = []
    for near in (lambda p, f, at: ("pq".index(p) * 2 + "ab".index(f)) * 2 + (at >> 32) // 32, lambda *_: 7):
        made = sorted((near(p, f, at), n, "k", p, f, tool, at, held) for n, (p, f, tool, at, held) in enumerate(rows))
        names = ["near", "class_name", "project", "filename", "tool", "at", "held"]
        columns = [[r[k] for r in made] for k in (0, 2, 3, 4, 5, 6, 7)]
        types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.list_(pa.int64())]
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)
        kept.append(sorted(repr({**r, "entries": sorted(map(repr, r["entries"]))}) for b in vote._pieces([batch], 32, 10**6) for r in b.to_pylist()))
    assert kept[0] == kept[1] and len(kept[0]) > 20


def test_ids_are_read_alike_with_and_without_a_search(spark):
    from tallyvane.functions.findings import canonical_cwe

    cases = {"cwe_7": "CWE-007", "CWE-079": "CWE-079", "Cwe 1000": "CWE-1000", "cwe_0": "CWE-000", "cwe_2147483647": "CWE-2147483647", "cwe_2147483648": None, "cwe_7\n": "CWE-007", "cwe_ 7": None, "cwe_+7": None, "CWE7": "CWE-007", "a/cwe-0079": "CWE-079"}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", canonical_cwe(F.col("c")).alias("n")).collect()
    assert {r["c"]: r["n"] for r in got} == cases


def test_density_moves_findings_once_without_names(spark, monkeypatch):
    """The flagship's clusters are those of the labels, from one row for each function and block: no name, window or search."""
    from tallyvane.plans import flagship

    rng = random.Random(31)
    found = [(c, rng.choice("pq"), rng.choice(clusters.TOOLS), rng.choice(["a", "b", None]), rng.choice([None, *range(1, 120)]), f"CWE-{rng.choice([100, 110, 111, 121, 200, 211, 300])}", "r", k) for k in range(300) for c in ("kernel", "application")]
    spans = [(c, p, f, f"f{k}", None, 12 * k + 1, 12 * k + 10) for c in ("kernel", "application") for p in "pq" for f in "ab" for k in range(9)]
    sizes = [(c, p, 1000, 50) for c in ("kernel", "application") for p in "pqz"]
    tables = {"findings": spark.createDataFrame(found, FINDING), "spans": spark.createDataFrame(spans, SPAN), "edges": edges(spark), "metadata": spark.createDataFrame(sizes, "class_name string, project string, loc int, functions long")}
    given = type("Given", (), {"get": lambda self, name: tables[name]})()
    placed = vote.attach_functions(vote.prepare(tables["findings"].where("filename is not null")), tables["spans"])
    rows = vote.agree(placed, hierarchy.related_pairs(hierarchy.ancestors(edges(spark)))).groupBy(*vote.PROJECT, "label").agg(F.countDistinct("tool").alias("n")).where("n > 1")
    want = {r["class_name"]: r["count"] for r in rows.groupBy("class_name").count().collect()}
    for step in ("attach_functions", "agree", "line_labels", "connected_components"):
        monkeypatch.setattr(vote, step, lambda *a, **k: pytest.fail("names"))
    assert {r["class_name"]: r["vulns"] for r in flagship.vote_and_density(given).collect()} == want and min(want.values()) > 10


def test_labels_in_blocks_of_lines(spark, monkeypatch):
    """Findings that are voted on in blocks have the labels of the search: inside of blocks, beyond them, in long functions and
    in blocks of which no task holds all; without a line or file they are alone."""
    from tallyvane.plans import flagship

    rng = random.Random(17)
    cwes = [100, 110, 111, 121, 200, 211, 300]
    found = [("kernel", rng.choice("pq"), rng.choice([*clusters.TOOLS, None]), rng.choice(["a", "b", None]), rng.choice([None, *range(1, 200)]), f"CWE-{rng.choice(cwes)}", "r", k) for k in range(500)]
    found += [("kernel", "p", rng.choice(clusters.TOOLS), "hot", rng.randrange(1, 40), f"CWE-{rng.choice(cwes)}", "r", 500 + k) for k in range(200)]
    lines = [(a, a + rng.choice([0, 3, 9, 20, 60, 150])) for a in rng.sample(range(-5, 200), 50)]
    spans = [("kernel", rng.choice("pq"), rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), None, a, b) for a, b in lines]
    spans += [("kernel", "p", "hot", "x", None, a, a + n) for a, n in ((1, 9), (1, 9), (4, 2), (14, 7), (23, 3))]
    tables = {"findings": spark.createDataFrame(found, FINDING).repartition(5), "spans": spark.createDataFrame(spans, SPAN), "edges": edges(spark)}
    given = type("Given", (), {"get": lambda self, name: tables[name]})()
    table = vote.attach_functions(vote.prepare(tables["findings"].where("filename is not null")), tables["spans"]).cache()
    pairs, want = hierarchy.related_pairs(hierarchy.ancestors(edges(spark))), {}
    for related in (True, False):
        rows = vote.agree(table, pairs if related else None).select("project", "finding_idx", "label").collect()
        want[related] = sorted([tuple(r) for r in rows] + [(f[1], f[7], f[7]) for f in found if f[3] is None])
    monkeypatch.setattr(vote, "attach_functions", lambda *a, **k: pytest.fail("names"))
    got = lambda related: sorted(tuple(r) for r in flagship.labels(given, related).select("project", "finding_idx", "label").collect())
    assert [got(k) for k in (True, False)] == [want[True], want[False]] and sum(i != x for _, i, x in want[True]) > 100
    monkeypatch.setattr(vote, "BATCH", 20)
    monkeypatch.setattr(vote, "BLOCK", 16)
    monkeypatch.setattr(vote, "PACKED", 3)
    assert got(True) == want[True]
    monkeypatch.setattr(clusters, "LONG", 30)
    assert got(True) == want[True]
    monkeypatch.setattr(vote, "HOT", 45)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        assert vote.place_members(vote.prepare(tables["findings"]), tables["spans"]).where("hot").count() > 0
        assert [got(k) for k in (True, False)] == [want[True], want[False]]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pairs_of_functions_need_no_search(spark, monkeypatch):
    """Pairs of tool and CWE that agree in a function, also beyond blocks and of spans of the same lines, against a plain loop."""
    rng = random.Random(11)
    cwes = [100, 110, 111, 121, 200, 211, 300]
    found = [(c, rng.choice("pq") + c[0], rng.choice(clusters.TOOLS), rng.choice(["a", "b", None]), rng.choice([None, *range(1, 200)]), f"CWE-{rng.choice(cwes)}", "r", k) for k in range(300) for c in ("kernel", "application")]
    lines = [(a, a + rng.choice([0, 3, 9, 20, 60, 150])) for a in rng.sample(range(-5, 200), 40)]
    spans = [(c, q + c[0], f, name, scope, a, b) for c in ("kernel", "application") for q in "pq" for f in ("a", "b") for a, b in lines for name, scope in rng.sample([("y", None), ("x", "t"), ("x", "s"), ("xy", None), (None, None)], 2)]
    rows, tables = spark.createDataFrame(found, FINDING), spark.createDataFrame(spans, SPAN)
    placed = vote.attach_functions(vote.prepare(rows), tables).where("function is not null").select("project", "function", "tool", F.substr("cwe", F.lit(5)).cast("int").alias("number")).distinct().collect()
    want = {}
    for a in placed:
        for b in placed:
            if a[:2] == b[:2] and a["tool"] < b["tool"] and related(a["number"], b["number"]):
                want[a[:2]] = want.get(a[:2], 0) + 1
    for step in ("attach_functions", "line_labels", "function_hubs"):
        monkeypatch.setattr(vote, step, lambda *a, **k: pytest.fail("names"))
    found = vote.prepare(rows).drop("finding_idx")
    got = lambda: {r[:2]: r["pairs"] for r in clusters.function_pairs(vote.place_pieces(found, tables, named=True), edges(spark)).select("project", "function", "pairs").collect()}
    assert got() == want and sum(want.values()) > 50
    monkeypatch.setattr(vote, "BATCH", 20)
    monkeypatch.setattr(vote, "BLOCK", 16)
    assert got() == want
