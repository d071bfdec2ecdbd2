"""Rank statistics: Mann-Whitney, Cliff's delta, false discovery, Poisson rates, Kendall's tau, bootstrap intervals."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyvane.functions.findings import dominance, effect_label
from tallyvane.operators.ranks import running_number, running_total
from tallyvane.session import cut, keep, lean


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc, na_action="ignore")


def average_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Add avg_rank, the mean rank of tied values, and ties, how many share the value."""
    tied = Window.partitionBy(*by, value)
    ranked = rows.withColumn("ties", F.count("*").over(tied)).withColumn("avg_rank", F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.col("ties") - 1) / 2.0)
    return ranked


def mann_whitney(samples: DataFrame, by: list[str], value: str = "share", group: str = "class_name", first: str = "kernel", second: str = "application", weight: str | None = None) -> DataFrame:
    """One row per key that both groups have: n1, n2, u, delta, z of the two-sided test with ties and continuity, means.

    Ranks need no sort of pairs: equal values are counted first, and a running sum over distinct values gives their ranks.
    weight is a column that says how many times a row counts.
    """
    times = F.col(weight) if weight else F.lit(1).cast("long")
    count = lambda name: F.sum(F.when(F.col(group) == name, times).otherwise(F.lit(0).cast("long")))
    counts = samples.groupBy(*by, value).agg(count(first).alias("k1"), count(second).alias("k2"))
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("k1") + F.col("k2")
    ranked = counts.withColumn("rank", F.coalesce(F.sum(t).over(before), F.lit(0)) + (t + 1) / 2.0)
    sums = ranked.groupBy(*by).agg(
        F.sum("k1").alias("n1"), F.sum("k2").alias("n2"), F.sum(F.col("k1") * F.col("rank")).alias("r1"), F.sum((t * t * t - t).cast("double")).alias("tie"),
        (F.sum(F.col("k1") * F.col(value)) / F.sum("k1")).alias("mean_1"), (F.sum(F.col("k2") * F.col(value)) / F.sum("k2")).alias("mean_2"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    rows = sums.where((n1 > 0) & (n2 > 0)).withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2.0).withColumn("delta", 2.0 * F.col("u") / (n1 * n2) - 1)
    spread = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    z = F.greatest(F.abs(F.col("u") - n1 * n2 / 2.0) - 0.5, F.lit(0.0)) / F.nullif(spread, F.lit(0.0))
    return rows.withColumn("z", F.coalesce(z, F.lit(0.0))).select(*by, "n1", "n2", "u", "delta", "z", "mean_1", "mean_2")


def with_p(tested: DataFrame) -> DataFrame:
    return tested.withColumn("p", F.least(erfc(F.col("z") / math.sqrt(2)), F.lit(1.0)))


def benjamini_yekutieli(rows: DataFrame, p: str = "p", key: str = "cwe") -> DataFrame:
    """Add q over all rows, whose number is not bounded: they are dealt out by ranges of (p, key).

    A rank is the number of rows in earlier ranges and the place in its own; the minimum over later ranks likewise that of
    the rest of its range and of later ranges. Only one row per range is gathered.
    """
    dealt = cut(rows.repartitionByRange(p, key).withColumn("__range", F.spark_partition_id()))
    own, one = Window.partitionBy("__range"), Window.orderBy("__range")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    m = dealt.count()
    harmonic = sum(1 / k for k in range(1, m + 1)) if m < 1_000_000 else math.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m)
    ranked = dealt.join(F.broadcast(starts), "__range").withColumn("__rank", F.col("start") + F.row_number().over(own.orderBy(p, key)))
    ranked = ranked.withColumn("__raw", F.col(p) * harmonic * m / F.col("__rank"))
    least = ranked.groupBy("__range").agg(F.min("__raw").alias("least"))
    later = least.withColumn("later", F.min("least").over(one.rowsBetween(1, Window.unboundedFollowing))).drop("least")
    here = F.min("__raw").over(own.orderBy("__rank").rowsBetween(0, Window.unboundedFollowing))
    out = ranked.withColumn("__here", here).join(F.broadcast(later), "__range")
    return out.withColumn("q", F.least("__here", "later", F.lit(1.0))).select(*rows.columns, "q")


def compare_classes(samples: DataFrame, key: str = "cwe", alpha: float = 0.05) -> DataFrame:
    """All tests with q, effect size and dominance, in order of p, effect and key; significance is tested after q."""
    rows = benjamini_yekutieli(with_p(mann_whitney(samples, [key])), "p", key)
    rows = rows.withColumn("label", effect_label(F.col("delta"))).withColumn("dominance", dominance(F.col("delta"), "kernel", "application"))
    return rows.withColumn("significant", F.col("p") < alpha).orderBy("p", F.desc(F.abs("delta")), key)


#: The columns of the comparison table, where they come from, and the digits of those with a fixed number.
COMPARISON_COLUMNS = {
    "ID": "key", "Name": "name", "Mann-Whitney U": "u", "p-value": "p", "p-value CI low": "p_low", "p-value CI high": "p_high", "q-value (BY)": "q",
    "Cliff's delta": "delta", "delta CI low": "delta_low", "delta CI high": "delta_high", "Cliff's interpretation": "label", "Dominance": "dominance",
    "kernel mean %": "mean_1", "application mean %": "mean_2",
}
COMPARISON_DIGITS = {name: 6 for name, source in COMPARISON_COLUMNS.items() if source in ("u", "delta", "delta_low", "delta_high", "mean_1", "mean_2")}


def comparison_table(tested: DataFrame, intervals: DataFrame, names: DataFrame, key: str = "cwe") -> DataFrame:
    """The table of compare_classes' rows, for sinks.write_table with COMPARISON_DIGITS: each with its intervals (key, p_low,
    p_high, delta_low, delta_high), if there are any, and its name (key, name), or Unknown."""
    rows = tested.join(intervals, key, "left").join(lean(names.select(key, "name")), key, "left").fillna({"name": "Unknown"})
    rows = rows.withColumn("key", F.col(key).cast("string")).orderBy("p", F.desc(F.abs("delta")), key)
    return rows.select(*(F.col(source).alias(name) for name, source in COMPARISON_COLUMNS.items()))


def percentile_interval(rows: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Linear-interpolated lower and upper percentile of the values that are numbers; null without any."""
    tail = (1 - level) / 2
    kept = F.when(~F.isnan(F.col(value)), F.col(value))
    pair = F.percentile(kept, F.array(F.lit(tail), F.lit(1 - tail)))
    return rows.groupBy(*by).agg(pair.alias("ci")).select(*by, F.get("ci", F.lit(0)).alias("low"), F.get("ci", F.lit(1)).alias("high"))


def _hashed(i: np.ndarray) -> np.ndarray:
    """What xxhash64 of a long makes of the number before its seed comes in."""
    with np.errstate(over="ignore"):
        mixed = i.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed << np.uint64(31) | mixed >> np.uint64(33)) * np.uint64(0x9E3779B185EBCA87)


def _seeded(seed: int, mixed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs, given _hashed of them, with a seed (the hash of the columns before)."""
    one, two, three, four, five = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = (np.int64(seed).astype(np.uint64) + five + np.uint64(8)) ^ mixed
        h = (h << np.uint64(27) | h >> np.uint64(37)) * one + four
        h = (h ^ h >> np.uint64(33)) * two
        h = (h ^ h >> np.uint64(29)) * three
        return (h ^ h >> np.uint64(32)).view(np.int64)


def bootstrap_mann_whitney(samples: DataFrame, key: str, value: str = "share", draws: int = 2000, seed: int = 42, block: int = 50) -> DataFrame:
    """(key, p_low, p_high, delta_low, delta_high) from resampling the projects of each class.

    Draw i of a replicate takes the member pmod(xxhash64(seed, class, replicate, i), n), so a repeated or lost task gives the
    same draws. A task makes `block` replicates of one key: it holds the key's sample, sorted, one value per project, and
    each replicate is a count of draws per project and one running sum over the sorted values.
    """
    names = ["kernel", "application"]
    members = running_number(samples.select("class_name", "project").distinct(), ["class_name"], ["project"], "at").withColumn("at", F.col("at") - 1)
    members = keep(members.where(F.col("class_name").isin(names)))
    sizes = members.agg(*(F.count_if(F.col("class_name") == c).alias(f"n{k}") for k, c in enumerate(names)))
    both = samples.groupBy(key).agg(F.count_distinct("class_name").alias("c")).where("c = 2").select(key)
    rows = samples.join(lean(both), key).join(members, ["class_name", "project"])
    spot = F.struct(F.col(value).cast("double").alias("v"), (F.col("class_name") == names[1]).alias("second"), "at")
    sample = rows.groupBy(key).agg(F.array_sort(F.collect_list(spot)).alias("s")).select(key, "s.v", "s.second", "s.at")
    sample = keep(sample.crossJoin(F.broadcast(sizes)))
    reps = samples.sparkSession.range(draws).select(F.col("id").cast("int").alias("rep"))
    reps = reps.select("rep", *(F.xxhash64(F.lit(seed), F.lit(c), "rep").alias(f"x{k}") for k, c in enumerate(names)))
    # In one order for both classes: the pair of a replicate is sorted as one.
    pairs = F.array_sort(F.collect_list(F.struct("rep", "x0", "x1")))
    hashes = [F.transform(pairs, lambda r: r["x0"]).alias("h0"), F.transform(pairs, lambda r: r["x1"]).alias("h1")]
    seeds = cut(reps.groupBy(F.floor(F.col("rep") / block).alias("block")).agg(*hashes))

    @F.pandas_udf("array<struct<p:double,delta:double>>")
    def replicates(v: pd.Series, second: pd.Series, at: pd.Series, n0: pd.Series, n1: pd.Series, h0: pd.Series, h1: pd.Series) -> pd.Series:
        out = []
        for values, side, place, sizes, seeds in zip(v, second, at, zip(n0, n1), zip(h0, h1)):
            values, side, place, found = np.asarray(values), np.asarray(side, bool), np.asarray(place, np.int64), []
            runs = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            mixed = [_hashed(np.arange(n)) for n in sizes]
            for pair in zip(*seeds):
                drawn = [np.bincount(_seeded(h, m) % n, minlength=n) for h, m, n in zip(pair, mixed, sizes)]
                k1 = np.add.reduceat(np.where(side, 0, drawn[0][np.where(side, 0, place)]), runs)
                k2 = np.add.reduceat(np.where(side, drawn[1][np.where(side, place, 0)], 0), runs)
                a, b, t = int(k1.sum()), int(k2.sum()), (k1 + k2).astype(float)
                if a and b:
                    u = float((k1 * (np.cumsum(t) - t + (t + 1) / 2)).sum()) - a * (a + 1) / 2
                    n = a + b
                    spread = math.sqrt(max(a * b / 12 * ((n + 1) - float((t * t * t - t).sum()) / (n * (n - 1))), 0.0))
                    z = max(abs(u - a * b / 2) - 0.5, 0.0) / spread if spread else 0.0
                    found.append((min(1.0, math.erfc(z / math.sqrt(2))), 2 * u / (a * b) - 1))
            out.append([{"p": p, "delta": d} for p, d in found])
        return pd.Series(out)

    # As many tasks as there are blocks, or as a shuffle has: rows are few and long, so that none may be put together.
    tasks = max(1, min(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), 10 * -(-draws // block)))
    work = sample.crossJoin(F.broadcast(seeds)).repartition(tasks, key, "block")
    tested = cut(work.select(key, F.inline(replicates("v", "second", "at", "n0", "n1", "h0", "h1"))))
    p, delta = percentile_interval(tested, [key], "p"), percentile_interval(tested, [key], "delta")
    return p.select(key, F.col("low").alias("p_low"), F.col("high").alias("p_high")).join(delta.select(key, F.col("low").alias("delta_low"), F.col("high").alias("delta_high")), key)


def _u_test(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(p, delta) of two samples: the normal approximation with ties and continuity; p is 1 if all values are equal."""
    n1, n2, ordered = len(x), len(y), np.sort(y)
    u = float(np.searchsorted(ordered, x, "left").sum() + np.searchsorted(ordered, x, "right").sum()) / 2
    ties = np.unique(np.concatenate([x, y]), return_counts=True)[1].astype(float)
    n = n1 + n2
    spread = math.sqrt(n1 * n2 / 12 * (n + 1 - float((ties**3 - ties).sum()) / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / spread if spread > 0 else 0.0
    return min(1.0, math.erfc(z / math.sqrt(2))), 2 * u / (n1 * n2) - 1


def bootstrap_exact_parity(samples: DataFrame, key: str, value: str = "share", draws: int = 2000, seed: int = 42) -> DataFrame:
    """The same intervals with numpy's generator restarted for each key, the first class drawn before the second.

    A key's sample is one value per project; it is the unit that one task holds.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (rows.loc[rows["class_name"] == c].sort_values("project")[value].to_numpy() for c in ("kernel", "application"))
        if not len(a) or not len(b):
            return pd.DataFrame({key: [], "p_low": [], "p_high": [], "delta_low": [], "delta_high": []})
        rng, found = np.random.default_rng(seed), []
        for _ in range(draws):
            x = a[rng.integers(0, len(a), len(a))]
            found.append(_u_test(x, b[rng.integers(0, len(b), len(b))]))
        ends = np.percentile(found, [2.5, 97.5], axis=0).T.ravel()
        return pd.DataFrame([[rows[key].iloc[0], *ends]], columns=[key, "p_low", "p_high", "delta_low", "delta_high"])

    kind = dict(samples.dtypes)[key]
    return samples.groupBy(key).applyInPandas(one, f"{key} {kind}, p_low double, p_high double, delta_low double, delta_high double")


def poisson_rates(totals: DataFrame) -> DataFrame:
    """(class_name, vulns, functions, rate, expected, chi2): both classes against their pooled rate.

    totals: one row per class with vulns and functions over projects that have functions.
    """
    everything = Window.partitionBy(F.lit(1))
    pooled = F.sum("vulns").over(everything) / F.sum("functions").over(everything)
    rows = totals.withColumn("expected", pooled * F.col("functions")).withColumn("rate", F.col("vulns") * 1000.0 / F.col("functions"))
    return rows.withColumn("chi2", F.sum(F.pow(F.col("vulns") - F.col("expected"), 2) / F.col("expected")).over(everything))


def e_test(k1: int, n1: float, k2: int, n2: float) -> float:
    """Two-sided p of equal Poisson rates by the published E-test: the chance, with the pooled rate, of a statistic at
    least as large as the observed one, over all pairs of counts within the tails."""
    rate = (k1 + k2) / (n1 + n2)
    if rate == 0:
        return 1.0
    statistic = lambda a, b: np.abs(a / n1 - b / n2) / np.sqrt(np.maximum(a / n1**2 + b / n2**2, 1e-300))
    seen = float(statistic(np.array(float(k1)), np.array(float(k2))))
    reach = lambda m: np.arange(max(0, int(m - 12 * math.sqrt(m) - 12)), int(m + 12 * math.sqrt(m) + 24))
    x, y = reach(rate * n1), reach(rate * n2)
    logs = lambda k, m: np.exp(k * math.log(m) - m - np.array([math.lgamma(v + 1) for v in k]))
    px, py, total = logs(x, rate * n1), logs(y, rate * n2), 0.0
    for a, p in zip(x, px):
        far = statistic(np.full(len(y), float(a)), y.astype(float)) >= seen - 1e-12
        far |= (a == 0) & (y == 0) & (seen <= 0)
        total += p * float(py[far].sum())
    return min(1.0, total)


def poisson_test(totals: DataFrame) -> DataFrame:
    """One row: E-test p, chi-squared and its p, for exactly two classes; none otherwise."""

    @F.pandas_udf("double")
    def p_value(k1: pd.Series, n1: pd.Series, k2: pd.Series, n2: pd.Series) -> pd.Series:
        return pd.Series([e_test(*row) for row in zip(k1, n1, k2, n2)], dtype=float)

    rows = poisson_rates(totals).agg(F.array_sort(F.collect_list(F.struct("class_name", "vulns", "functions"))).alias("c"), F.max("chi2").alias("chi2")).where(F.size("c") == 2)
    cell = lambda k, f: F.get("c", F.lit(k))[f]
    p = p_value(cell(0, "vulns"), cell(0, "functions").cast("double"), cell(1, "vulns"), cell(1, "functions").cast("double"))
    return rows.select("chi2", erfc(F.sqrt(F.col("chi2") / 2)).alias("chi2_p"), p.alias("p")).withColumn("significant", F.col("p") < 0.05)


def concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> int:
    """Concordant less discordant pairs of rows that count w times (once without w); ties in x or y count nothing.

    Rows are taken in the order of x and split by the bits of y's ranks: of two different ranks, one has a 0 and the other
    a 1 in their highest differing bit. So for each bit, among rows whose higher bits agree, rows with a 1 count those with
    a 0 that have a smaller or larger x; that is one running sum per bit.
    """
    order = np.lexsort((y, x))
    rx, ry = (np.unique(v[order], return_inverse=True)[1] for v in (x, y))
    w = np.ones(len(x), np.int64) if w is None else w[order]
    total = 0
    for level in range(int(ry.max(initial=0)).bit_length()):
        group = np.argsort(ry >> level + 1, kind="stable")
        high, one, held = ry[group] >> level + 1, ry[group] >> level & 1, w[group]
        zeros = np.concatenate([[0], np.cumsum((1 - one) * held)])
        block, rest = np.searchsorted(high, high, "left"), np.searchsorted(high, high, "right")
        # Within a group rows are still in the order of x; equal x are a run of it.
        run = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (rx[group][1:] != rx[group][:-1])]))
        length = np.diff(np.append(run, len(x)))
        begin, end = np.repeat(run, length), np.repeat(run + length, length)
        total += int((one * held * ((zeros[begin] - zeros[block]) - (zeros[rest] - zeros[end]))).sum())
    return total


def _ranges(rows: DataFrame, by: list[str], value: str, name: str, size: int) -> DataFrame:
    """Add `name`, the range of the value within its group: about `size` rows each, in order. Equal values are in one range,
    and a value with more than `size` rows has one of its own, whose number is odd."""
    counts = rows.groupBy(*by, value).agg(F.sum("w").alias("__n"))
    key = [F.col(c).alias(f"__{c}") for c in by]
    placed = running_total(counts, by, value, "__n", "__before")
    spot = F.floor(F.col("__before") / size) * 2 + F.when(F.col("__n") > size, 1).otherwise(0)
    placed = placed.select(*key, F.col(value).alias("__value"), spot.alias(name))
    same = F.col(value) == F.col("__value")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(placed, same).drop("__value", *(f"__{c}" for c in by))


def concordances(rows: DataFrame, by: list[str], size: int = 4096, most: int = 1000) -> DataFrame:
    """(by, s): concordant less discordant pairs of the rows (by, x, y, w) of each group, w how often a row counts.

    Each axis is cut into ranges. Pairs that share neither are told from the counts of the cells alone, at most `most` ranges
    each way; those that share a range of x are counted inside it, and those that share one of y, but not of x, inside that.
    A range holds a bounded part of its group; one that is a single common value has no pairs to count.
    """
    total = cut(rows.groupBy(*by).agg(F.sum("w").alias("__total")))
    largest = total.agg(F.max("__total")).first()[0] or 0
    size = max(size, -(-largest // most))
    cells = cut(_ranges(_ranges(rows, by, "x", "rx", size), by, "y", "ry", size))
    kinds = dict(rows.dtypes)
    head = "".join(f"{c} {kinds[c]}, " for c in by)

    def keyed(pdf: pd.DataFrame, s: int) -> pd.DataFrame:
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in by} | {"s": [s]})

    def along_x(pdf: pd.DataFrame) -> pd.DataFrame:
        return keyed(pdf, concordance(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy()))

    def along_y(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (pdf[c].to_numpy() for c in "xyw")
        inside = sum(concordance(x[at], y[at], w[at]) for at in (np.flatnonzero(pdf["rx"].to_numpy() == r) for r in pdf["rx"].unique()) if len(at) > 1)
        return keyed(pdf, concordance(x, y, w) - inside)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        (_, a), (_, b) = (np.unique(pdf[c].to_numpy(), return_inverse=True) for c in ("rx", "ry"))
        grid = np.zeros((a.max() + 2, b.max() + 2), np.int64)
        np.add.at(grid, (a + 1, b + 1), pdf["n"].to_numpy())
        below = grid.cumsum(0).cumsum(1)
        left = below[:-1, :-1] - (below[:-1, -1:] - below[:-1, 1:])  # earlier in x: those lower in y less those higher
        return keyed(pdf, int((grid[1:, 1:] * left).sum()))

    schema = f"{head}s long"
    parts = cells.where("rx % 2 = 0").groupBy(*by, "rx").applyInPandas(along_x, schema)
    parts = parts.union(cells.where("ry % 2 = 0").groupBy(*by, "ry").applyInPandas(along_y, schema))
    parts = parts.union(cells.groupBy(*by, "rx", "ry").agg(F.sum("w").alias("n")).groupBy(*by).applyInPandas(across, schema))
    return parts.groupBy(*by).agg(F.sum("s").alias("s"))


def exact_kendall(n: int, inverted: int) -> float:
    """The chance that an order of n untied values has at most that many, or at least as many less, inversions."""
    fewer = min(inverted, n * (n - 1) // 2 - inverted)
    if n < 3 or 4 * fewer == n * (n - 1):
        return 1.0
    if fewer < 2:
        return math.exp(math.log(2) - math.lgamma(n + 1 - fewer))
    ways = np.array([1.0])
    for k in range(2, n + 1):
        ways = np.convolve(ways, np.ones(k))[: fewer + 1] / k
    return min(1.0, 2 * float(ways.sum()))


def kendall(rows: DataFrame, by: list[str], x: str, y: str, least: int = 4, size: int = 4096) -> DataFrame:
    """(by, n, concordance, tau, z, p): Kendall's tau-b of x and y over rows that have both, the size of its normal deviate
    with the variance of ties, and the two-sided p; null under `least` rows or where x or y is constant.

    p is exact where no value is tied and either the group has at most 33 rows or at most one pair stands against the rest,
    else that of the deviate. Equal rows are counted first; see concordances for the pairs.
    """
    kept = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    kept = cut(kept.groupBy(*by, "x", "y").agg(F.count("*").alias("w")))
    t = F.col("t")

    def ties(c: str) -> DataFrame:
        counts = kept.groupBy(*by, c).agg(F.sum("w").cast("double").alias("t"))
        sums = (t * (t - 1), t * (t - 1) * (t - 2), t * (t - 1) * (2 * t + 5))
        return counts.groupBy(*by).agg(*(F.sum(v).alias(f"{c}{k}") for k, v in enumerate(sums, 1)))

    out = kept.groupBy(*by).agg(F.sum("w").alias("n")).join(concordances(kept, by, size), by).join(ties("x"), by).join(ties("y"), by)
    n, s = F.col("n").cast("double"), F.col("s").cast("double")
    pairs = n * (n - 1)
    free = (pairs - F.col("x1")) * (pairs - F.col("y1"))
    spread = (pairs * (2 * n + 5) - F.col("x3") - F.col("y3")) / 18 + F.col("x1") * F.col("y1") / (2 * pairs) + F.col("x2") * F.col("y2") / (9 * pairs * (n - 2))
    known = (F.col("n") >= least) & (free > 0)
    inverted = (pairs / 2 - s) / 2
    untied = (F.col("x1") == 0) & (F.col("y1") == 0) & ((n <= 33) | (F.least(inverted, pairs / 2 - inverted) <= 1))

    @F.pandas_udf(DoubleType())
    def chance(n: pd.Series, inverted: pd.Series, z: pd.Series, exact: pd.Series) -> pd.Series:
        return pd.Series([exact_kendall(int(a), round(b)) if e else math.erfc(c / math.sqrt(2)) for a, b, c, e in zip(n, inverted, z, exact)], dtype=float)

    out = out.select(*by, "n", s.alias("concordance"), F.when(known, 2 * s / F.sqrt(free)).alias("tau"), F.when(known, F.abs(s) / F.sqrt(spread)).alias("z"), inverted.alias("inverted"), untied.alias("untied"))
    p = F.when(F.col("tau").isNotNull(), chance("n", "inverted", F.coalesce("z", F.lit(0.0)), "untied"))
    return out.withColumn("p", p).drop("inverted", "untied")


def tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b; nan if either is constant."""
    pairs = len(x) * (len(x) - 1) / 2
    free = [pairs - float((c * (c - 1)).sum()) / 2 for c in (np.unique(v, return_counts=True)[1] for v in (x, y))]
    return concordance(x, y) / math.sqrt(free[0] * free[1]) if min(free) > 0 else math.nan


class Resampled:
    """tau_b of resamples of one sample: what concordance sorts is the same for all of them, and only weights change."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.lexsort((y, x))
        self.order, self.levels = order, []
        self.rx, self.ry = (np.unique(v[order], return_inverse=True)[1] for v in (x, y))
        for level in range(int(self.ry.max(initial=0)).bit_length()):
            group = np.argsort(self.ry >> level + 1, kind="stable")
            high, one = self.ry[group] >> level + 1, (self.ry[group] >> level & 1).astype(bool)
            block, rest = np.searchsorted(high, high, "left"), np.searchsorted(high, high, "right")
            run = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (self.rx[group][1:] != self.rx[group][:-1])]))
            length = np.diff(np.append(run, len(x)))
            places = (np.repeat(run, length), np.repeat(run + length, length), block, rest)
            self.levels.append((group.astype(np.int32), ~one, np.flatnonzero(one).astype(np.int32), *(v[one].astype(np.int32) for v in places)))

    def tau(self, at: np.ndarray) -> float:
        """That of the rows at these places; nan if either side is constant."""
        n = len(self.order)
        w, total = np.bincount(at, minlength=n)[self.order], 0
        for group, zero, ones, begin, end, block, rest in self.levels:
            held = w[group]
            zeros = np.concatenate([[0], np.cumsum(held * zero)])
            total += int((held[ones] * (zeros[begin] - zeros[block] - zeros[rest] + zeros[end])).sum())
        pairs = len(at) * (len(at) - 1) / 2
        counts = (np.bincount(r, w).astype(np.int64) for r in (self.rx, self.ry))
        free = [pairs - float((c * (c - 1)).sum()) / 2 for c in counts]
        return total / math.sqrt(free[0] * free[1]) if min(free) > 0 else math.nan


def kendall_p(x: np.ndarray, y: np.ndarray) -> float:
    """Two-sided p: exact by counting inversions for untied values, if at most 33 or with at most one pair against the rest,
    else normal with the variance of ties."""
    n, tau = len(x), tau_b(x, y)
    if math.isnan(tau):
        return 1.0
    t, u = (np.unique(v, return_counts=True)[1].astype(float) for v in (x, y))
    pairs = n * (n - 1) / 2
    s = round(tau * math.sqrt((pairs - (t * (t - 1)).sum() / 2) * (pairs - (u * (u - 1)).sum() / 2)))
    inverted = round((pairs - s) / 2)
    if len(t) == n and len(u) == n and (n <= 33 or min(inverted, pairs - inverted) <= 1):
        return exact_kendall(n, inverted)
    v0, vt, vu = (float((c * (c - 1) * (2 * c + 5)).sum()) for c in (np.array([float(n)]), t, u))
    v1 = float((t * (t - 1)).sum() * (u * (u - 1)).sum()) / (2 * n * (n - 1))
    v2 = float((t * (t - 1) * (t - 2)).sum() * (u * (u - 1) * (u - 2)).sum()) / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0.0
    spread = math.sqrt(max((v0 - vt - vu) / 18 + v1 + v2, 0.0))
    return math.erfc(abs(s) / spread / math.sqrt(2)) if spread else 1.0


def kendall_intervals(rows: DataFrame, by: list[str], x: str, y: str, key: str, draws: int = 1000, seed: int = 42, block: int = 250) -> DataFrame:
    """(by, tau, p, low, high) of groups of at least four rows that have both values.

    Draws come from one numpy generator per group, in the order of key, and constant samples do not count, so the ends are
    those of a plain loop. One pass per group draws without counting and notes the generator's state before every `block`
    draws; a task is given a block's state and the group's sample, one pair of numbers per project, sorts that once, and makes
    those draws alone. A draw costs n log n, in running sums.
    """
    kept = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pair = F.struct(F.col(key), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    sample = kept.groupBy(*by).agg(F.array_sort(F.collect_list(pair)).alias("s")).where(F.size("s") >= 4).select(*by, F.col("s.x").alias("x"), F.col("s.y").alias("y"))

    @F.pandas_udf("tau double, p double")
    def whole(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(tau_b(np.array(a), np.array(b)), kendall_p(np.array(a), np.array(b))) for a, b in zip(xs, ys)], columns=["tau", "p"])

    @F.pandas_udf("array<string>")
    def borders(sizes: pd.Series) -> pd.Series:
        out = []
        for n in sizes.tolist():
            rng, states = np.random.default_rng(seed), []
            for i in range(draws):
                if i % block == 0:
                    states.append(json.dumps(rng.bit_generator.state))
                rng.integers(0, n, size=n)
            out.append(states)
        return pd.Series(out)

    @F.pandas_udf("array<double>")
    def replicate(xs: pd.Series, ys: pd.Series, blocks: pd.Series, states: pd.Series) -> pd.Series:
        out, rng = [], np.random.default_rng(seed)
        for a, b, k, state in zip(xs.map(np.array), ys.map(np.array), blocks, states):
            rng.bit_generator.state = json.loads(state)
            resampled = Resampled(a, b)
            out.append([resampled.tau(rng.integers(0, len(a), size=len(a))) for _ in range(min(block, draws - k * block))])
        return pd.Series(out)

    points = sample.select(*by, whole("x", "y").alias("w")).select(*by, "w.tau", "w.p")
    starts = cut(sample.select(*by, borders(F.size("x")).alias("states"))).select(*by, F.posexplode("states").alias("block", "state"))
    # Rows are few and long: with a number of partitions none are put together into one task.
    blocks = sample.join(starts, by).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "block")
    reps = blocks.select(*by, F.explode(replicate("x", "y", "block", "state")).alias("t"))
    return points.join(percentile_interval(reps, by, "t"), by)
