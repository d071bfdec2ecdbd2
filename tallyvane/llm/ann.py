"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.llm._common import cut

#: Bits of a code, and of each of the substrings that are indexed.
BITS, PART = 256, 64
PARTS = BITS // PART


class Coder:
    """Rotated binary codes: the signs of the centred vectors after orthogonal rotations that were fitted to a sample.

    Alternates between the signs of the rotated sample and the rotation that is nearest to them. With fewer dimensions
    than BITS, several rotations, each from another start, stand side by side; with more, the leading directions rotate.
    """

    def __init__(self, sample: np.ndarray, rounds: int = 30, seed: int = 5):
        self.mean = sample.mean(axis=0)
        sample, rng = sample - self.mean, np.random.default_rng(seed)
        _, vectors = np.linalg.eigh(sample.T @ sample)
        basis = vectors[:, ::-1][:, : min(sample.shape[1], BITS)]
        inside, out, width = sample @ basis, [], 0
        while width < BITS:
            turn = np.linalg.qr(rng.normal(size=(inside.shape[1],) * 2))[0]
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(np.sign(inside @ turn).T @ inside)
                turn = (u @ vt).T
            out.append(basis @ turn)
            width += turn.shape[1]
        self.rotation = np.hstack(out)[:, :BITS]

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        """One row of PARTS unsigned words for each vector."""
        return np.packbits((vectors - self.mean) @ self.rotation > 0, axis=1, bitorder="little").view("<u8")


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in the same order for every row, so that equal vectors tie."""
    return (vectors * query).sum(axis=1)


@cache
def flips(threshold: int) -> np.ndarray:
    """All differences of up to `threshold` bits of a substring."""
    return np.array([sum(1 << b for b in bits) for n in range(threshold + 1) for bits in combinations(range(PART), n)], np.uint64)


class SubstringIndex:
    """For each substring of the codes, the values that occur, in order, and which rows have them."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = [np.unique(codes[:, s], return_inverse=True) for s in range(PARTS)]

    def candidates(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of which some substring is within its threshold; the thresholds plus one add up to radius + 1.

        By the pigeonhole principle no row within the radius is left out. The values within a threshold are looked up
        while they are fewer than those that occur, and else the values that occur are compared.
        """
        seen = np.zeros(len(self.codes), bool)
        for s, (values, rows) in enumerate(self.tables):
            threshold = (radius + 1) // PARTS - 1 + (s < (radius + 1) % PARTS)
            if threshold < 0:
                continue
            if threshold <= 3 and sum(comb(PART, n) for n in range(threshold + 1)) < len(values):
                probes = flips(threshold) ^ code[s]
                at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
                hit = np.zeros(len(values), bool)
                hit[at[values[at] == probes]] = True
            else:
                hit = np.bitwise_count(values ^ code[s]) <= threshold
            seen |= hit[rows]
        return np.flatnonzero(seen)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows at most `radius` bits from code."""
        rows = self.candidates(code, radius)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of vectors that take part: not null, not all zero, no null or non-finite component, and of
    the commonest length (the smaller one of a tie)."""
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"])
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 20_000,
            probes: int = 200, reach: float = 0.95, block: int = 8192, group: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product of each row whose id is divisible by `every`.

    Candidates are all usable rows but the query's own; ties go to the smaller vec_id. Equal vectors are indexed once with
    their k + 1 smallest ids, which is all that any answer can need. The rotations are learned from at most `sample` rows
    (smallest hashes). The radius is the `reach` quantile of the code distance of the true neighbours of at most `probes`
    queries, found against all rows. Every row is indexed, in blocks of about `block` rows; queries in groups of about
    `group` visit each block and take what is within the radius there. Queries that have fewer than k + 1 rows in all
    search again with a radius that grows, in each block, until it holds k + 1 or all are taken, so each query gets
    min(k, candidates) answers. Rows that repeat an id and a vector count once; other columns are left out; an empty table
    gives an empty result.
    """
    rows = cut(usable(vectors, id_col, vector_col))
    spark, result = rows.sparkSession, "query_id long, rank int, vec_id long, score double"
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], result)
    ranked = Window.partitionBy("v").orderBy("vec_id")
    index = cut(rows.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1).drop("r"))
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = cut(asked.groupBy("v").agg(F.min("vec_id").alias("q"), F.count("*").alias("copies")))
    picked = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()["v"]
    coder = Coder(np.stack(picked.array))

    tests = queries.orderBy(F.xxhash64("q"), "q").limit(probes).toPandas()
    if not len(tests):
        return spark.createDataFrame([], result)
    ids, points = tests["q"].to_numpy(), np.stack(tests["v"].array)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = coder(points)
        for batch in batches:
            v = np.stack(batch["v"].array)
            own, scores = coder(v), points @ v.T
            top = np.argpartition(-scores, min(k + 1, len(v) - 1), axis=1)[:, : k + 1]
            far = np.bitwise_count(own[top] ^ codes[:, None, :]).sum(axis=2)
            yield pd.DataFrame({"q": np.repeat(ids, top.shape[1]), "score": np.take_along_axis(scores, top, 1).ravel(), "d": far.ravel().astype(np.int32)})

    best = Window.partitionBy("q").orderBy(F.desc("score"))
    found = index.mapInPandas(scan, "q long, score double, d int").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    radius = int(np.ceil(found.agg(F.percentile("d", F.lit(reach))).first()[0]))

    size = index.count()
    blocks = max(1, -(-size // block))

    def search_all(queries: DataFrame, grow: bool) -> DataFrame:
        groups = max(1, -(-queries.count() // group))
        left = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = queries.select("q", "v", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

        def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            found: dict[str, list] = {"q": [np.empty(0, np.int64)], "vec_id": [np.empty(0, np.int64)], "score": [np.empty(0)]}
            if len(rows) and len(asked):
                v, names, points = np.stack(rows["v"].array), rows["vec_id"].to_numpy(), np.stack(asked["v"].array)
                index = SubstringIndex(coder(v))
                for q, point, code in zip(asked["q"].to_numpy(), points, coder(points)):
                    within = radius
                    while len(near := index.within(code, within)) <= k and grow and within < BITS:
                        within += 4 * PARTS
                    score = inner(v[near], point)
                    top = np.lexsort((names[near], -score))[: k + 1]
                    for name, values in (("q", np.full(len(top), q)), ("vec_id", names[near[top]]), ("score", score[top])):
                        found[name].append(values)
            return pd.DataFrame({name: np.concatenate(parts) for name, parts in found.items()})

        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(search, "q long, vec_id long, score double")

    parts = cut(search_all(queries, False))
    enough = parts.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") >= min(k + 1, size))
    short = cut(queries.join(enough, "q", "left_anti"))
    if not short.isEmpty():
        parts = parts.join(enough, "q", "left_semi").union(search_all(short, True))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = parts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = cut(queries.join(lists.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near")), "q"))
    # Vectors with many copies among the queries, at most one for each 500th part of the queries, go to theirs by broadcast.
    many = max(n // 10_000, 10_000)
    hot = F.broadcast(lists.where(F.col("copies") > many))
    answers = asked.join(hot, "v").unionByName(asked.join(hot.select("v"), "v", "left_anti").join(lists.where(F.col("copies") <= many), "v"))
    mine = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answers.select(F.col("vec_id").alias("query_id"), "near").select("query_id", F.posexplode(mine).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
