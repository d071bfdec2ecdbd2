"""Soft-membership mixing: domain posteriors, then document rates by projected gradient (DataFrame functions only)."""

from __future__ import annotations

import math
import re
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.llm._common import cut

#: Characters that part words beside the space; the rarer of them count as marks.
STOPS = "\n\t\r.,"
MARKS = ";:!?*&$%#|()[]{}<>\"'/\\-_+=~@"
WORD = "[^ " + re.escape(STOPS + MARKS) + "]+"


def _all(columns: list[Column]) -> Column:
    return reduce(Column.__add__, columns)


def document_words(text: Column) -> Column:
    """The lower-cased words of a whole text, in order, as an array; empty if it has none."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _share(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit(kind)) / F.greatest(F.length(text), F.lit(1))


def _told(words: list[str]) -> Column:
    return F.log1p(F.size(F.filter("told", lambda w: w.isin(words)))) if words else F.lit(0.0)


def features(docs: DataFrame, id_col: str, text_col: str, lists: list[list[str]]) -> DataFrame:
    """(doc_id, tokens, f0 ...): the figures that the classifier sees. Null text counts as empty; tokens are words.

    A text is split into words once, and its distinct words meet the telling words of all domains once; each domain is
    then counted in that short array.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("words", document_words(F.col("text")))
    rows = rows.select("doc_id", "text", F.size("words").cast("double").alias("tokens"), F.array_distinct("words").alias("words"))
    telling = sorted({w for words in lists for w in words})
    rows = rows.withColumn("told", F.array_intersect("words", F.array(*map(F.lit, telling))) if telling else F.expr("cast(array() as array<string>)"))
    columns = [
        F.log1p("tokens"), _share(F.col("text"), "[A-Z]"), _share(F.col("text"), "[" + re.escape(MARKS) + "]"), _share(F.col("text"), "[0-9]"),
        F.size("words") / F.greatest("tokens", F.lit(1.0)), *(_told(words) for words in lists),
    ]
    return rows.select("doc_id", "tokens", *(c.cast("double").alias(f"f{k}") for k, c in enumerate(columns)))


def telling_words(labelled: DataFrame, domains: list[str], each: int = 40, least: int = 3) -> list[list[str]]:
    """For each domain, the words with the highest smoothed odds of occurring in its documents rather than others'."""
    words = labelled.select("domain", F.explode(F.array_distinct(document_words(F.coalesce("text", F.lit(""))))).alias("word"))
    counts = words.groupBy("word").agg(*(F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)))
    totals = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    counts, n, out = cut(counts.where(F.greatest(*(F.col(f"n{k}") for k in range(len(domains))), F.lit(0)) >= least)), sum(totals.values()), []
    for k, d in enumerate(domains):
        own, rest = F.col(f"n{k}"), _all([F.col(f"n{j}") for j in range(len(domains)) if j != k] or [F.lit(0)])
        odds = F.log((own + 0.5) / (totals.get(d, 0) + 1)) - F.log((rest + 0.5) / (n - totals.get(d, 0) + 1))
        top = counts.where(own >= least).select("word", (odds * F.log1p(own)).alias("odds")).where("odds > 0").orderBy(F.desc("odds"), "word").limit(each)
        out.append([r["word"] for r in top.collect()])
    return out


def domain_posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, p0 ...) of every row: the probability of each domain, in the order given; they add up to 1.

    labelled: (text, domain). A normal density per domain and figure, with the domains' shares as priors; only those
    means and variances (domains x figures) reach the driver. Domains without labelled rows get 0, and with no labelled
    row at all every domain gets the same.
    """
    labelled = labelled.where(F.col("domain").isin(domains))
    lists = telling_words(labelled, domains)
    known = features(labelled.withColumn("__id", F.col("domain")), "__id", "text", lists)
    rows = features(docs, id_col, text_col, lists)
    names = [c for c in rows.columns if c.startswith("f")]
    figures = known.groupBy("doc_id").agg(F.count("*").alias("n"), *(x for c in names for x in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))))
    fitted = {r["doc_id"]: r for r in figures.collect()}
    n = sum(r["n"] for r in fitted.values())
    scores = []
    for d in domains:
        if d not in fitted:
            scores.append(F.lit(None).cast("double") if n else F.lit(0.0))
            continue
        r = fitted[d]
        parts = []
        for c in names:
            v = max(r[f"v_{c}"], 1e-3)
            parts.append(-F.pow(F.col(c) - r[f"m_{c}"], 2) / (2 * v) - 0.5 * math.log(v))
        scores.append(F.lit(math.log(r["n"] / n)) + _all(parts))
    rows = rows.select("doc_id", "tokens", *(s.alias(f"s{k}") for k, s in enumerate(scores)))
    top = F.greatest(*(F.coalesce(f"s{k}", F.lit(-1e300)) for k in range(len(domains))), F.lit(-1e300))
    rows = rows.select("doc_id", "tokens", *(F.coalesce(F.exp(F.col(f"s{k}") - top), F.lit(0.0)).alias(f"e{k}") for k in range(len(domains))))
    whole = _all([F.col(f"e{k}") for k in range(len(domains))])
    return rows.select("doc_id", "tokens", *((F.col(f"e{k}") / whole).alias(f"p{k}") for k in range(len(domains))))


def fit_rates(members: DataFrame, targets: list[float], max_rate: float | None = None, rounds: int = 60, tolerance: float = 1e-3) -> DataFrame:
    """Add to (doc_id, tokens, p0 ...) a column rate >= 0, so that the sums of rate * tokens * p_k come near targets.

    Accelerated projected gradient on the weighted least squares of the totals, from rate 1, in the metric of tokens: each
    round is one aggregation of as many numbers as there are domains, and the step is r <- max(0, y - sum of c_k p_k), at
    most max_rate if given, where y goes on from r in the direction of the last step. Ends when every total is within the
    tolerance (as a share of all target tokens). Ends with a warning that names totals and targets when a round no longer
    changes the squared error by a thousandth, as no rates of that range give the targets, or after `rounds`. Documents
    without tokens keep their place at rates that cost nothing.
    """
    k = range(len(targets))
    members = cut(members)
    grams = [F.sum(F.col("tokens") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i in k for j in k if i <= j]
    row = members.agg(F.sum("tokens").alias("w"), *grams).first()
    w = row["w"] or 0.0
    rates = members.withColumn("rate", F.lit(1.0)).withColumn("ahead", F.lit(1.0))
    if not w:
        return rates.drop("ahead")
    gram = [[row[f"g{min(i, j)}_{max(i, j)}"] / w for j in k] for i in k]
    weight = [1 / max(gram[i][i], 1e-9) for i in k]
    # The largest eigenvalue of the scaled Gram matrix is at most its largest row sum.
    step = 1 / max(sum(abs(gram[i][j]) * math.sqrt(weight[i] * weight[j]) for j in k) for i in k)
    total, before, pace = sum(targets) or 1.0, math.inf, 1.0
    for turn in range(rounds + 1):
        totals = [F.sum(F.col(c) * F.col("tokens") * F.col(f"p{i}")).alias(f"{c}{i}") for c in ("rate", "ahead") for i in k]
        sums = rates.agg(*totals).first()
        errors = [sums[f"rate{i}"] - targets[i] for i in k]
        loss = sum(v * e * e for v, e in zip(weight, errors))
        met = max(map(abs, errors)) <= tolerance * total
        if met or turn == rounds or abs(loss - before) <= 1e-3 * loss:
            if not met:
                warnings.warn(f"mixing totals {[round(e + t) for e, t in zip(errors, targets)]} instead of {[round(t) for t in targets]} after {turn} rounds", stacklevel=2)
            break
        before, after = loss, (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        moved = F.greatest(F.col("ahead") - _all([F.lit(step * weight[i] * (sums[f"ahead{i}"] - targets[i]) / w) * F.col(f"p{i}") for i in k]), F.lit(0.0))
        rates = rates.withColumn("moved", F.least(moved, F.lit(float(max_rate))) if max_rate is not None else moved)
        rates = rates.withColumn("ahead", F.col("moved") + F.lit((pace - 1) / after) * (F.col("moved") - F.col("rate"))).withColumn("rate", F.col("moved")).drop("moved")
        pace = after
        if turn % 4 == 3:
            rates = cut(rates)
    return rates.drop("ahead")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", max_rate: float | None = None) -> DataFrame:
    """(doc_id, tokens, posteriors array<double> in the order of weights, rate) of every row.

    weights: the share of tokens that each domain is to have; domains that no document belongs to are left out of the
    shares. The budget is all tokens of docs. With max_rate it is what the domain of the largest weight can give, and no
    target is above what its domain has. Null and empty texts have no tokens. Extra columns are left out, and an empty
    table gives an empty result. Repeated rows have the same rate, and count as often as they occur.
    """
    domains = list(weights)
    members = cut(domain_posteriors(docs, labelled, domains, id_col, text_col))
    have = members.agg(*(F.sum(F.col("tokens") * F.col(f"p{k}")).alias(f"h{k}") for k in range(len(domains)))).first()
    held = [have[f"h{k}"] or 0.0 for k in range(len(domains))]
    wanted = [v if h > 0 else 0.0 for h, v in zip(held, weights.values())]
    share = sum(wanted) or 1.0
    targets = [sum(held) * v / share for v in wanted]
    if max_rate is not None:
        main = max(range(len(domains)), key=lambda k: wanted[k])
        scale = max_rate * held[main] / targets[main] if targets[main] else 0.0
        targets = [min(scale * t, max_rate * h) for t, h in zip(targets, held)]
    rates = fit_rates(members, targets, max_rate)
    return rates.select("doc_id", "tokens", F.array(*(f"p{k}" for k in range(len(domains)))).alias("posteriors"), "rate")
