"""Hard negatives by score windows below each positive, found in R-trees packed by sort-tile-recursive."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.llm._common import cut

LONGEST = np.iinfo(np.int64).max


def tiles(points: np.ndarray, rows: np.ndarray, axes: list[int], leaf: int) -> Iterator[np.ndarray]:
    """Sort-tile-recursive: rows in slabs of equal size along the first axis, each slab likewise along the rest.

    With n leaves to fill and k axes left, an axis is cut into about the k-th root of n slabs, of whole leaves each.
    """
    leaves = -(-len(rows) // leaf)
    if leaves <= 1:
        yield rows
        return
    slabs = leaves if len(axes) <= 1 else max(2, round(leaves ** (1 / len(axes))))
    ordered = rows[np.argsort(points[rows, axes[0]], kind="stable")]
    step = -(-leaves // slabs) * leaf
    for a in range(0, len(ordered), step):
        yield from tiles(points, ordered[a : a + step], axes[1:] or axes, leaf)


class RTree:
    """Boxes over labelled points: the smallest and largest value of each coordinate, of the labels, and the smallest id.

    Leaves hold `leaf` points, inner nodes `fan` neighbouring ones of the level below. From a box follows an interval that
    holds the inner products of all its points with a query.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, leaf: int = 64, fan: int = 8):
        # Labels tile first, then the coordinates that vary most, as many as halve the leaves.
        spread = np.argsort(-points.var(axis=0), kind="stable") if len(points) else np.empty(0, int)
        axes = [0, *(int(a) + 1 for a in spread[: max(1, int(np.log2(max(2, len(points) / leaf))))])]
        keyed = np.column_stack([labels.astype(np.float64), points])
        groups = list(tiles(keyed, np.lexsort((ids,)), axes, leaf)) if len(points) else []
        order = np.concatenate(groups) if groups else np.empty(0, np.int64)
        self.ids, self.labels, self.points = ids[order], labels[order], points[order]
        begin = np.cumsum([0, *map(len, groups)])[:-1]
        level = [np.minimum.reduceat(self.points, begin), np.maximum.reduceat(self.points, begin), np.minimum.reduceat(self.labels, begin),
                 np.maximum.reduceat(self.labels, begin), np.minimum.reduceat(self.ids, begin)] if groups else []
        #: Of each level, from the leaves up: where its boxes begin in the level below (in the points, for leaves), and the boxes.
        self.levels = [(np.append(begin, len(order)), level)] if groups else []
        while self.levels and len(self.levels[-1][1][0]) > 1:
            below = self.levels[-1][1]
            begin = np.arange(0, len(below[0]), fan)
            join = (np.minimum, np.maximum, np.minimum, np.maximum, np.minimum)
            self.levels.append((np.append(begin, len(below[0])), [f.reduceat(x, begin) for f, x in zip(join, below)]))

    def search(self, query: np.ndarray, own: int, label: int, same: bool, windows: list[tuple[float, float]], k: int) -> list[list[tuple[float, int]]]:
        """For each window (low, high) of scores, the k points with the largest (score, -id) inside it, best first.

        same: only points of the label; else only points of other labels. The point `own` takes no part. Nodes come from
        one queue by the best score that any window can still get from them, and a node is left out if no window needs it:
        its interval lies outside the window, or its best score is strictly below the k-th found (equal ones count by id).
        """
        found: list[list[tuple[float, int]]] = [[] for _ in windows]  # heaps of (score, -id), the worst first
        if not self.levels:
            return found
        up, down = np.maximum(query, 0), np.minimum(query, 0)

        def worth(best: float, least: float, first: int) -> float:
            """The best score that any window can still get from a node; minus infinity if none needs it."""
            out = -np.inf
            for heap, (low, high) in zip(found, windows):
                if low <= high and least <= high and best >= low:
                    top = min(best, high)
                    if top > out and (len(heap) < k or (top, -first) > heap[0]):
                        out = top
            return out

        def push(level: int, a: int, b: int) -> None:
            lo, hi, first_label, last_label, first = (x[a:b] for x in self.levels[level][1])
            no = (first_label > label) | (last_label < label) if same else (first_label == label) & (last_label == label)
            nodes = zip(range(a, b), no.tolist(), (hi @ up + lo @ down).tolist(), (lo @ up + hi @ down).tolist(), first.tolist())
            for node, other, best, least, first in nodes:
                if not other and (top := worth(best, least, first)) > -np.inf:
                    heapq.heappush(queue, (-top, level, node, best, least, first))

        queue: list[tuple] = []
        top = len(self.levels) - 1
        push(top, 0, len(self.levels[top][1][0]))
        while queue:
            _, level, node, best, least, first = heapq.heappop(queue)
            if worth(best, least, first) == -np.inf:
                continue
            begin = self.levels[level][0]
            a, b = int(begin[node]), int(begin[node + 1])
            if level:
                push(level - 1, a, b)
                continue
            score, names, kinds = self.points[a:b] @ query, self.ids[a:b], self.labels[a:b]
            takes = ((kinds == label) == same) & (names != own)
            for heap, (low, high) in zip(found, windows):
                fits = takes & (score >= low) & (score <= high)
                if len(heap) == k:
                    fits &= score >= heap[0][0]
                for at in np.flatnonzero(fits):
                    entry = (float(score[at]), -int(names[at]))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        return [sorted(heap, reverse=True) for heap in found]


def labelled_points(vectors: DataFrame, scale: int, shift_every: int, classes: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): usable rows, components scaled and rounded down, labels of every `shift_every`-th id moved on.

    Rows without id, label or vector, with a null or non-finite component, or of another length than most (the smaller one
    of a tie) are left out; of rows that repeat an id, the one with the smallest label and vector counts.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    moved = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    rows = rows.where(F.size("v") == (common["d"] if common else 0))
    return rows.select("vec_id", moved.alias("label"), F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, percent: int = 80, scale: int = 256, shift_every: int = 7, classes: int = 10,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = 8192, group: int = 2048) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by `every`. A score is the inner product of the scaled, rounded vectors, exact
    while sums stay below 2^53. An anchor's positives are its `positives` best other rows of the same label; a positive's
    negatives the `negatives` best rows of other labels that score at least `percent` percent of the positive and at most as
    much. Better is the higher score, then the smaller id; fewer are returned where there are fewer. See labelled_points for
    the rows that take part; other columns are left out; an empty table gives an empty result.

    Rows are dealt by ranges of label, first coordinate and id into blocks of about `block`, so that neither a label nor a
    vector, however common, is one block; each block is an R-tree. Anchors, in groups of about `group`, visit every block and
    bring back at most `positives` rows, or `negatives` for each positive, of which the best overall are kept.
    """
    points = labelled_points(vectors, scale, shift_every, classes, id_col, vector_col, label_col)
    spark = points.sparkSession
    points = cut(points)
    n = points.count()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if n == 0:
        return spark.createDataFrame([], result)
    first = F.coalesce(F.get("v", F.lit(0)), F.lit(0.0))
    dealt = cut(points.repartitionByRange(max(1, -(-n // block)), "label", first, "vec_id").withColumn("block", F.spark_partition_id()))
    anchors = dealt.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("own"), F.col("v").alias("point"))
    parts = max(1, -(-anchors.count() // group))
    part = F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).cast("int").alias("part")
    last = dealt.agg(F.max("block")).first()[0]

    def visit(asked: DataFrame, same: bool) -> DataFrame:
        """(anchor_id, w, vec_id, score): what each anchor finds for its windows (w is the window's place) in each block."""
        k = positives if same else negatives
        left = dealt.select("block", "vec_id", "label", "v", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        right = asked.select("anchor_id", "own", "point", "low", "high", part, F.explode(F.sequence(F.lit(0), F.lit(last))).alias("place"))

        def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if len(rows) and len(asked):
                tree = RTree(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), np.stack(rows["v"].array))
                for anchor, label, point, low, high in zip(asked["anchor_id"].tolist(), asked["own"].tolist(), asked["point"], asked["low"], asked["high"]):
                    lists = tree.search(np.asarray(point), anchor, label, same, list(zip(low, high)), k)
                    out += [(anchor, w, -name, int(score)) for w, best in enumerate(lists) for score, name in best]
            return pd.DataFrame(out, columns=["anchor_id", "w", "vec_id", "score"]).astype({"anchor_id": "int64", "w": "int32", "vec_id": "int64", "score": "int64"})

        found = left.groupBy("block", "part").cogroup(right.groupBy("place", "part")).applyInPandas(search, "anchor_id long, w int, vec_id long, score long")
        best = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
        return cut(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))

    ends = lambda low, high: (F.array(low).alias("low"), F.array(high).alias("high"))
    everything = ends(F.lit(float("-inf")), F.lit(float("inf")))
    chosen = visit(anchors.select("*", *everything), True).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("w"))
    score = F.transform(F.array_sort(F.collect_list(F.struct("w", "positive_score"))), lambda x: x["positive_score"])
    # The least whole number that is at least `percent` percent of the score.
    windows = chosen.groupBy("anchor_id").agg(score.alias("s")).select("anchor_id", F.transform("s", lambda x: x.cast("double")).alias("high"), F.transform("s", lambda x: F.ceil(F.lit(percent) * x / F.lit(100.0)).cast("double")).alias("low"))
    missed = visit(anchors.join(windows, "anchor_id"), False).select("anchor_id", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(missed, ["anchor_id", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
