from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyvane.llm import mixing, packing
from tallyvane.llm.labelled import labelled_rows
from tallyvane.llm.queries import labelled_domain

from test_dedup_pack_simhash import brute_classes


@pytest.fixture
def folder(spark, tmp_path):
    rng, rows = random.Random(11), []
    for k in range(120):
        words = [rng.choice(["river", "house", "over", "the", "walk", "stone"]) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(5, 80))]
        if k % 4 == 0:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words)))
        if k % 10 == 1:
            rows.append((200 + k, " ".join(words)))
        if k % 10 == 2:
            rows.append((400 + k, " ".join([*words[:-1], "last"])))
    rows += [(600, None), (601, ""), (602, "12 34"), (603, " \n")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in rows if i % 2 == 0 and i < 120], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_run_matches_brute_force(spark, folder):
    sf_dir, rows = folder
    kept = {i: t for i, t in rows if t and any(c.isalpha() for c in t)}
    groups = defaultdict(list)
    for i, t in kept.items():
        groups[t].append(i)
    kept = {max(g): t for t, g in groups.items()}
    ids, words = sorted(kept), {i: t.lower().split() for i, t in kept.items()}
    label = brute_classes([{tuple(words[i][n : n + 5]) for n in range(max(1, len(words[i]) - 4))} for i in ids], 0.8)
    kept = {i: kept[i] for n, i in enumerate(ids) if label[n] == n}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name in ("language_id", "exact_dedup", "simhash_near_dedup"):
        before = docs
        docs = stage(name)(spark, docs, sf_dir)
        assert docs.columns == before.columns
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(kept)

    known = labelled_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True), ["quality", "toxic"], bound=20_000).select("text", labelled_domain().alias("domain"))
    rates = {r["doc_id"]: r["rate"] for r in mixing.mix(docs, known, corpus_pipeline.WEIGHTS, max_rate=1.0).collect()}
    draws = {r["doc_id"]: r["x"] / (1 << 30) for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)).alias("x")).collect()}
    kept = {i for i in kept if draws[i] < rates[i]}
    placed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in placed} == kept
    assert sum(r["length"] for r in placed) == sum(r["length"] for r in packing.token_pieces(docs.where(F.col("doc_id").isin(*kept))).collect())
    ends = defaultdict(int)
    for r in sorted(placed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 1024


def test_stages_take_odd_and_empty_tables(spark, folder):
    """Null ids and texts, repeated rows, an empty table, and extra columns with names that the operators use."""
    sf_dir, _ = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.where("doc_id >= 600").unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), "source", "n_chars"))
    clash = docs.limit(20).withColumns({c: F.lit(7) for c in ("rate", "node", "fp", "component_id", "keep_id", "text_sha256", "near", "tokens", "k", "group_size", "kept", "words", "piece")})
    for rows in (docs.limit(0), odd, odd.union(odd), clash):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, rows, sf_dir)
            assert name == "best_fit_packing" or out.columns == rows.columns
            out.collect()


def test_rates_match_dense_projected_gradient(spark):
    rng = np.random.default_rng(12)
    p = rng.dirichlet([0.5, 0.3, 0.2], 200)
    tokens = rng.integers(1, 500, 200).astype(float)
    targets = np.array([0.5, 0.3, 0.2]) * tokens.sum()
    table = spark.createDataFrame([(k, float(t), *map(float, row)) for k, (t, row) in enumerate(zip(tokens, p))], "doc_id long, tokens double, p0 double, p1 double, p2 double")
    got = {r["doc_id"]: r["rate"] for r in mixing.fit_rates(table, targets.tolist(), rounds=12, tolerance=0.0).collect()}
    w, rate, ahead, pace = tokens.sum(), np.ones(200), np.ones(200), 1.0
    gram = p.T @ (p * tokens[:, None]) / w
    weight = 1 / np.diag(gram)
    step = 1 / np.abs(gram * np.sqrt(np.outer(weight, weight))).sum(1).max()
    for _ in range(12):
        new, after = np.maximum(0, ahead - p @ (step * weight * (p.T @ (ahead * tokens) - targets) / w)), (1 + np.sqrt(1 + 4 * pace**2)) / 2
        rate, ahead, pace = new, new + (pace - 1) / after * (new - rate), after
    assert np.allclose([got[k] for k in range(200)], rate)
    assert np.abs(p.T @ (rate * tokens) - targets).max() < 0.02 * w


def test_near_stage_links_five_word_jaccard(spark, tmp_path):
    rng, texts = random.Random(5), {}
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    for k in range(0, 60, 2):
        base = words(60)
        texts[k] = " ".join(base)
        cut_at = 20 if k % 4 else 0
        texts[k + 1] = " ".join([*base[:-3], *words(3)] if cut_at == 0 else [*words(20), *base[20:]])
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in texts.items() if (w := t.split())}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    expected = {i for i in texts if i % 2 == 0 or jaccard(i - 1, i) < 0.8}
    assert 30 < len(expected) < 60
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in stage("simhash_near_dedup")(spark, docs, "").collect()} == expected


def test_posteriors_match_brute_force(spark, make_docs):
    """Normal densities of the figures, computed here from the texts by other means."""
    rng = random.Random(14)
    kinds = {"a": ["river", "house", "over"], "b": ["BUY", "now!!", "2024", "cheap$"]}
    rows = [(k, " ".join(rng.choice(kinds["ab"[k % 2]] + ["the", "of"]) for _ in range(rng.randint(1, 30))), "en") for k in range(80)] + [(90, None, "en"), (91, "", "en"), (92, "!!! ...", "en")]
    labelled = [(t, "ab"[k % 2]) for k, t, _ in rows[:50]]
    table = spark.createDataFrame(labelled, "text string, domain string")
    lists = mixing.telling_words(table, ["a", "b"])
    stops = set(" " + mixing.STOPS + mixing.MARKS)

    def figures(text):
        words = "".join(" " if c in stops else c for c in text.lower()).split()
        share = lambda test: sum(map(test, text)) / max(len(text), 1)
        shares = [share(lambda c: "A" <= c <= "Z"), share(lambda c: c in mixing.MARKS), share(lambda c: "0" <= c <= "9")]
        return len(words), [math.log1p(len(words)), *shares, len(set(words)) / max(len(words), 1), *(math.log1p(len(set(words) & set(ws))) for ws in lists)]

    known = {d: np.array([figures(t)[1] for t, x in labelled if x == d]) for d in "ab"}
    got = {r["doc_id"]: r for r in mixing.domain_posteriors(make_docs(rows), table, ["a", "b"]).collect()}
    for k, text, _ in rows:
        tokens, x = figures(text or "")
        logs = []
        for d in "ab":
            v = np.maximum(known[d].var(0), 1e-3)
            logs.append(math.log(len(known[d]) / 50) + float((-((np.array(x) - known[d].mean(0)) ** 2) / (2 * v) - 0.5 * np.log(v)).sum()))
        p = np.exp(np.array(logs) - max(logs))
        assert got[k]["tokens"] == tokens and np.allclose([got[k]["p0"], got[k]["p1"]], p / p.sum())


def test_unreachable_targets_are_reported(spark):
    table = spark.createDataFrame([(1, 10.0, 0.5, 0.5), (2, 10.0, 0.5, 0.5)], "doc_id long, tokens double, p0 double, p1 double")
    with pytest.warns(UserWarning, match="mixing totals"):
        rates = mixing.fit_rates(table, [15.0, 5.0]).collect()
    assert all(abs(r["rate"] - 1) < 1e-6 for r in rates)
