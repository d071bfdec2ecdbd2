"""Findings, function spans, project metadata and tool runs as projections of the star-schema tables.

Each text runs unchanged in Spark and in DuckDB; {names} stand for tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLASS = "CASE WHEN {key} % 5 = 0 THEN 'kernel' ELSE 'application' END AS class_name, concat('p', CAST({key} AS STRING)) AS project"

FINDINGS = f"""
SELECT {CLASS.replace("{key}", "l_suppkey")},
       CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'codeql' WHEN 1 THEN 'cppcheck' WHEN 2 THEN 'flawfinder' ELSE 'semgrep' END AS tool,
       concat('/workspace/src/./f', CAST(l_partkey % 20 AS STRING), '.c') AS filename,
       CASE WHEN l_quantity = 1 THEN NULL ELSE CAST(1 + l_orderkey % 400 AS INT) END AS line,
       CASE WHEN (l_partkey + l_linenumber) % 11 = 0 THEN NULL ELSE concat('cwe_', CAST(m.cwe_num AS STRING)) END AS cwe,
       concat('r', CAST(l_linenumber AS STRING)) AS rule,
       CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS finding_idx
FROM {{lineitem}} AS lineitem
LEFT JOIN (SELECT * FROM (VALUES (1,100),(2,110),(3,111),(4,112),(5,120),(6,121),(7,210),(8,211),(9,300),(10,301)) AS v(pick, cwe_num)) AS m
  ON (l_partkey + l_linenumber) % 11 = m.pick
"""

DIGITS = "(SELECT * FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) AS v({0}))"

SPANS = f"""
WITH s AS (
  SELECT {CLASS.replace("{key}", "s_suppkey")}, concat('src/f', CAST(10 * h + d AS STRING), '.c') AS filename, 10 * a + b AS k
  FROM {{supplier}} AS supplier CROSS JOIN {DIGITS.format("a")} AS ta CROSS JOIN {DIGITS.format("b")} AS tb
  CROSS JOIN {DIGITS.format("h")} AS th CROSS JOIN {DIGITS.format("d")} AS td WHERE a < 4 AND h < 2)
SELECT class_name, project, filename, concat('fn', CAST(k AS STRING)) AS name, CASE WHEN k % 3 = 0 THEN 'ns' END AS scope, 10 * k + 1 AS start_line, 10 * k + 9 AS end_line FROM s
UNION ALL SELECT class_name, project, filename, 'inner', NULL, 10 * k + 3, 10 * k + 5 FROM s WHERE k % 2 = 0
"""

METADATA = f"""
SELECT {CLASS.replace("{key}", "s_suppkey")},
       CASE WHEN s_suppkey % 11 = 4 THEN NULL ELSE 1000 + 37 * s_suppkey END AS loc,
       CASE WHEN s_suppkey % 7 = 3 THEN NULL ELSE CAST(1200 AS BIGINT) END AS functions,
       CAST(20 AS BIGINT) AS source_files, r_name AS category, CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey % 4 AS INT) END AS n_folders
FROM {{supplier}} AS supplier JOIN {{nation}} AS nation ON s_nationkey = n_nationkey JOIN {{region}} AS region ON n_regionkey = r_regionkey
"""

RUNS = f"""
SELECT {CLASS.replace("{key}", "s_suppkey")}, t.tool, t.ord, CASE WHEN (s_suppkey + t.ord) % 9 = 0 THEN 'timeout' WHEN (s_suppkey + 3 * t.ord) % 31 = 5 THEN 'failed'
       WHEN (s_suppkey + 3 * t.ord) % 31 = 11 THEN 'skipped' WHEN (s_suppkey + 3 * t.ord) % 31 = 17 THEN 'unavailable' ELSE 'completed' END AS status
FROM {{supplier}} AS supplier CROSS JOIN (SELECT * FROM (VALUES ('codeql',0),('cppcheck',1),('flawfinder',2),('semgrep',3)) v(tool,ord)) t
"""

EDGES = "SELECT * FROM (VALUES (110,100,0),(111,110,0),(112,110,0),(120,100,0),(121,120,0),(121,210,1),(210,200,0),(211,210,0),(301,302,0),(302,301,0)) AS v(child, parent, ord)"
NODES = "SELECT * FROM (VALUES (100),(110),(111),(112),(120),(121),(200),(210),(211),(300),(301),(302)) AS v(cwe)"
#: Members of view 1000 and of the Top-25 view 1435.
VIEW_MEMBERS = "SELECT * FROM (VALUES (1000,100,0),(1000,200,1),(1435,111,0),(1435,121,1),(1435,300,2)) AS v(view_id, cwe, ord)"

#: A weakness forest that grows with the table: roots 1 to 10, a first parent each, and a second one for every seventh.
FOREST_EDGES = """
SELECT p_partkey AS child, CAST(floor(p_partkey / 3) AS BIGINT) AS parent, 0 AS ord FROM {part} AS part WHERE p_partkey > 10 AND p_partkey < 30
UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 10) AS BIGINT), 0 FROM {part} AS part WHERE p_partkey >= 30
UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 7) AS BIGINT), 1 FROM {part} AS part WHERE p_partkey >= 30 AND p_partkey % 7 = 0
"""
FOREST_NODES = """SELECT p_partkey AS cwe FROM {part} AS part
UNION ALL SELECT * FROM (VALUES (CAST(900000 AS BIGINT)), (900001), (900002), (900003), (900004), (900005), (900006), (900007), (900009), (900011), (900012)) AS v(cwe)"""
FOREST_MEMBERS = """SELECT p_partkey AS cwe, CAST(11 - p_partkey AS INT) AS ord FROM {part} AS part WHERE p_partkey <= 10 AND p_partkey <> 4
UNION ALL SELECT * FROM (VALUES (CAST(900002 AS BIGINT), 0), (900000, 7), (900012, 12)) AS v(cwe, ord)"""
#: Categories over the forest: every fifth weakness is in one of 17, and some categories hold others, one of them in two ways.
FOREST_CATEGORIES = """
SELECT 900000 + p_partkey % 17 AS owner, p_partkey AS member, p_partkey AS ord FROM {part} AS part WHERE p_partkey % 5 = 0
UNION ALL SELECT * FROM (VALUES (CAST(900000 AS BIGINT), CAST(900001 AS BIGINT), CAST(3 AS BIGINT)), (900001, 900003, 7), (900001, 900005, 50), (900002, 900005, 1), (900003, 900007, 100000000),
 (900004, 900009, 2), (900005, 900011, 4), (900002, 900011, 100000000), (900012, 4, 1)) AS v(owner, member, ord)
"""
#: Two views over the categories; the first lists one of them itself and by another.
FOREST_VIEWS = """SELECT * FROM (VALUES (CAST(800001 AS BIGINT), CAST(900001 AS BIGINT), CAST(0 AS BIGINT)), (800001, 900000, 1), (800001, 7, 2), (800002, 900004, 0), (800002, 900002, 1), (800002, 3, 2), (800002, 5, 3)) AS v(view_id, cwe, ord)"""

TEXTS = {"forest_edges": FOREST_EDGES, "forest_nodes": FOREST_NODES, "forest_members": FOREST_MEMBERS, "forest_categories": FOREST_CATEGORIES, "forest_views": FOREST_VIEWS, "findings": FINDINGS, "spans": SPANS, "metadata": METADATA, "runs": RUNS, "edges": EDGES, "nodes": NODES, "view_members": VIEW_MEMBERS}


BASES = ("lineitem", "supplier", "nation", "region", "part")


class Tables:
    """The base tables of one folder, and the projections over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def get(self, name: str) -> DataFrame:
        text = TEXTS[name]
        used = {t: self.base(t) for t in BASES if f"{{{t}}}" in text}
        if name == "spans":
            # A supplier is 1,200 spans: a file of few bytes is one task as it is read, and all spans would be made in it.
            used["supplier"] = used["supplier"].repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return self.spark.sql(text, **used)


def duckdb_ctes() -> str:
    """The projections as common table expressions over the tables of the same name."""
    plain = {t: t for t in BASES}
    return ",\n".join(f"{name} AS ({text.format(**plain)})" for name, text in TEXTS.items())
