from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tallyvane.llm import _words, decontaminate, importance, negatives, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BIG = 2**53 + 1


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("name", ["op11_importance", "op12_negatives", "op13_decontaminate"])
def test_query_equals_oracle(spark, name):
    base = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.queries()[name](spark, SF), base.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    theirs = {tuple(r) for r in want.select(*(f'"{c}"' for c in got.columns)).fetchall()}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(theirs) and set(rows) == theirs


def test_words_and_hashes_of_odd_texts():
    texts = ["Ab-cD 12_é\x00ÄB 漢字 🙂!", None, "", "...", "x" * 9, "x" * 64 + " " + "x" * 65, "a\u0085b c", "Z"]
    known, which, sizes = _words.flat(texts)
    want = [[w.encode() for w in plain_words(t)] for t in texts]
    ends = np.cumsum(sizes)
    assert [[known[k] for k in which[e - n : e]] for n, e in zip(sizes, ends)] == want
    hashed = _words.Hashed(texts)
    assert hashed.sizes.tolist() == _words.word_counts(texts).tolist() == [len(w) for w in want]
    by_word = {}
    for h, b, e in zip(hashed.ids.tolist(), hashed.begin, hashed.end):
        assert by_word.setdefault(hashed.data[b:e], h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert _words.Hashed(["q x" + "x" * 8]).ids[1] == hashed.ids[np.flatnonzero(hashed.owner == 4)[0]]
    assert [p for p in _words.portions(["aa", "b" * 9, "", None, "c"], 4)] == [slice(0, 1), slice(1, 2), slice(2, 5)] and list(_words.portions([])) == []


def test_crc_of_columns_equals_crc_of_strings():
    rng = random.Random(1)
    strings = [bytes(rng.randrange(256) for _ in range(rng.randrange(12))) for _ in range(500)] + [b"", b"a" * 3000]
    assert importance.crc_all(strings).tolist() == [zlib.crc32(s) for s in strings]
    assert importance.crc_all([]).tolist() == []


def brute_resample(rows, target, most, buckets, percent, least):
    def runs(text):
        w = plain_words(text)
        return [" ".join(w[k : k + n]) for n in range(1, most + 1) for k in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, runs(text)))
    for text in target:
        t.update(map(bucket, runs(text)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out, pool = {}, []
    for k, (i, text) in enumerate(rows):
        f = runs(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[k] = [i, len(f), weight, None if i is None else score]
        if i is not None and len(plain_words(text)) >= least:
            pool.append((-score, i, k))
    ranks = {k: r for r, (_, _, k) in enumerate(sorted(pool)[: percent * len(pool) // 100], 1)}
    return [(*v, ranks.get(k)) for k, v in out.items()]


@pytest.mark.parametrize("most", [1, 3])
def test_resample_matches_brute_force(spark, make_docs, most):
    rng = random.Random(most)
    vocabulary = ["alpha", "Beta", "g4", "δέλτα", "x", "yy", "漢"]
    texts = lambda n: [" ".join(rng.choices(vocabulary, k=rng.randrange(12))) for _ in range(n)]
    rows = [*zip(range(60), texts(60)), (None, "alpha beta x yy g4 x"), (BIG, None), (BIG + 2, "alpha, BETA; x yy g4 x"), (-5, ""), (-6, "?!")]
    target = spark.createDataFrame([(t,) for t in texts(9)] + [(None,)], "text string")
    got = importance.importance_resample(make_docs([(i, t, "en") for i, t in rows]), target, most, 50, 40, 5).collect()
    want = brute_resample(rows, [r["text"] for r in target.collect()], most, 50, 40, 5)
    assert got[0].__fields__ == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and any(r["rank"] for r in got)


def test_resample_odd_and_empty_tables(spark, make_docs, odd_rows):
    target = spark.createDataFrame([("word and more",)], "text string")
    got = importance.importance_resample(make_docs(odd_rows), target, least=1, percent=100).collect()
    assert len(got) == len(odd_rows) and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 7))
    assert importance.importance_resample(make_docs([]), target).count() == 0
    assert importance.importance_resample(make_docs(odd_rows), target.limit(0)).where("rank is not null").count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, rank int, score long, block int, v string"


def make_vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, -1, 3, "x") for i, v, label in rows], VECTORS)


def brute_negatives(rows, positives, negatives_, every, percent):
    first = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            first[i] = min(first.get(i, (label, v)), (label, v))
    p = {i: ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, (label, v) in first.items()}
    out = set()
    for a in (i for i in p if i % every == 0):
        score = {b: sum(x * y for x, y in zip(p[a][1], p[b][1])) for b in p if b != a}
        ranked = sorted(score, key=lambda b: (-score[b], b))
        for pos in [b for b in ranked if p[b][0] == p[a][0]][:positives]:
            fits = [b for b in ranked if p[b][0] != p[a][0] and percent * score[pos] <= 100 * score[b] <= 100 * score[pos]]
            out |= {(a, pos, r, b, score[pos], score[b]) for r, b in enumerate(fits[:negatives_], 1)}
    return out


@pytest.mark.parametrize("dim,grid", [(1, True), (3, True), (6, False)])
def test_negatives_match_brute_force(spark, dim, grid):
    rng = np.random.default_rng(dim)
    cloud = rng.integers(-2, 3, (400, dim)) / 2 if grid else rng.normal(size=(400, dim)) + rng.integers(0, 3, (400, 1)) * 2
    rows = [(k, [float(np.float32(x)) for x in v], int(rng.integers(0, 4))) for k, v in enumerate(cloud)]
    rows += [(k + 1000, rows[5][1], 1) for k in range(150)]  # a common vector
    rows += [rows[3], (20, [9.0] * dim, 3), (2000, None, 1), (2010, [float("nan")] * dim, 1), (2020, [None] * dim, 1), (2030, [1.0] * dim, None), (None, [1.0] * dim, 1), (BIG, [1.0] * dim, 2)]
    want = brute_negatives(rows, 3, 4, 10, 80)
    got = negatives.hard_negatives(make_vectors(spark, rows), positives=3, negatives=4, every=10, block=100, group=16).collect()
    assert got[0].__fields__ == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert len(got) == len(want) and {tuple(r) for r in got} == want and want


def test_negatives_of_odd_tables(spark):
    assert negatives.hard_negatives(make_vectors(spark, [])).count() == 0
    assert negatives.hard_negatives(make_vectors(spark, [(100, [1.0], 1)])).count() == 0
    assert negatives.hard_negatives(make_vectors(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0
    other = [(100, [1.0, 1.0], 1), (101, [1.0, 1.0], 1), (102, [1.0, 1.0], 2), (103, [1.0], 2), (100, [1.0, 1.0], 1)]
    assert [tuple(r) for r in negatives.hard_negatives(make_vectors(spark, other)).collect()] == [(100, 101, 1, 102, 131072, 131072)]


def test_tree_prunes_and_keeps_every_row():
    rng = np.random.default_rng(4)
    points = np.floor(256 * np.repeat(rng.normal(size=(40, 3)), 60, axis=0) + rng.normal(size=(2400, 3)))
    ids, labels = rng.permutation(2400), rng.integers(0, 3, 2400)
    tree = negatives.RTree(ids, labels, points, leaf=16, fan=4)
    assert sorted(tree.ids.tolist()) == list(range(2400)) and max(np.diff(tree.levels[0][0])) <= 16 and len(tree.levels[-1][1][0]) == 1
    for lo, hi, *_ in [level for _, level in tree.levels]:
        assert (lo <= hi).all()
    query, score, seen = points[0], points @ points[0], [0]
    real, tree.points = tree.points, Counted(tree.points, seen)
    windows = [(-np.inf, np.inf), (0.5 * score.max(), 0.8 * score.max()), (5.0, 4.0)]
    got = tree.search(query, int(ids[0]), 1, False, windows, 4)
    for (low, high), found in zip(windows, got):
        rest = [(float(s), -int(i)) for s, i, label in zip(score, ids, labels) if label != 1 and i != ids[0] and low <= s <= high]
        assert found == sorted(rest, reverse=True)[:4]
    assert 0 < seen[0] < len(real) / 2


class Counted:
    """Points that count how many of them are looked at."""

    def __init__(self, points, seen):
        self.points, self.seen = points, seen

    def __getitem__(self, key):
        self.seen[0] += key.stop - key.start
        return self.points[key]


def brute_leaks(rows, items, size):
    out = []
    for i, text in rows:
        w, hit, named = plain_words(text), set(), set()
        for item, content in items:
            own = plain_words(content)
            for win in [own] if 0 < len(own) < size else [own[k : k + size] for k in range(len(own) - size + 1)]:
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win and item is not None:
                        hit.update(range(k, k + len(win)))
                        named.add(str(item))
        out.append((i, len(w), len(hit), tuple(sorted(named))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bound", [0, 1000])
def test_leaks_match_brute_force(spark, make_docs, bound):
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choices(["a", "B", "c", "dd", "é"], k=n))
    items = [(k, say(rng.randrange(1, 12))) for k in range(12)] + [(100, "A,  b! c dd"), (101, "a b c DD"), (102, None), (103, "?"), (None, "a a a a"), (10, "a")]
    rows = [(k, say(rng.randrange(60))) for k in range(80)] + [(None, "a b c dd a b"), (BIG, "x a-b_c/dd"), (BIG + 2, "a b c"), (7, None), (8, ""), (9, "a b c dd " * 3000)]
    rows += [rows[5], rows[5]]
    table = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, start string")
    got = decontaminate.contamination(make_docs([(i, t, "en") for i, t in rows]), table, size=5, width=2, bound=bound).collect()
    assert got[0].__fields__ == ["doc_id", "n_words", "n_hit", "items"]
    assert sorted([(*r[:3], tuple(r["items"])) for r in got], key=repr) == brute_leaks(rows, items, 5)


def test_leaks_of_empty_tables(spark, make_docs, odd_rows):
    items = spark.createDataFrame([(1, "word and more word and more word and more word"), (2, "漢字")], "item_id long, text string")
    assert decontaminate.contamination(make_docs([]), items).count() == 0
    rows = decontaminate.contamination(make_docs(odd_rows), items.limit(0)).collect()
    assert len(rows) == len(odd_rows) and all(r["n_hit"] == 0 and r["items"] == [] for r in rows)
    by = {r["doc_id"]: r for r in decontaminate.contamination(make_docs(odd_rows), items).collect()}
    assert (by[6]["n_hit"], by[6]["n_words"], by[6]["items"]) == (59_998, 60_000, ["1"]) and by[7]["items"] == ["2"] and by[7]["n_hit"] == 1
