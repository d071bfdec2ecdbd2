from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tallyvane.llm import exact_dedup, packing, simhash
from tallyvane.llm._common import without
from tallyvane.operators import graph


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_exact_groups_match_brute_force(make_docs):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", None, "", f"t{k}", f"u{k // 3}"]), "en") for k in range(400)]
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    got = as_dict(exact_dedup.exact_groups(make_docs(rows), support=0.05))
    assert len(got) == len(rows)
    for i, t, _ in rows:
        own = groups[t or ""]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(own), len(own), i == max(own), hashlib.sha256((t or "").encode()).hexdigest())
    kept = exact_dedup.exact_dedup(make_docs(rows), support=0.05)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(v) for v in groups.values())
    assert kept.columns == make_docs(rows).columns


@pytest.mark.parametrize("bound", [0, 100])
def test_without_gives_the_same_rows_broadcast_or_shuffled(spark, make_docs, bound):
    docs = make_docs([(k if k % 7 else None, f"t{k}", "en") for k in range(50)])
    dropped = spark.createDataFrame([(3,), (4,), (99,)], "doc_id long")
    got = without(docs, dropped, "doc_id", bound)
    assert got.columns == docs.columns and sorted(r["text"] for r in got.collect()) == sorted(f"t{k}" for k in range(50) if k not in (3, 4))


def test_exact_odd_rows_and_empty_table(make_docs, odd_rows):
    got = exact_dedup.exact_groups(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert [r["kept"] for r in by[5]] == [True, True] and by[4][0]["keep_id"] == 5 and by[4][0]["group_size"] == 3
    assert by[None][0]["keep_id"] == 2 and not by[None][0]["kept"]
    assert exact_dedup.exact_groups(make_docs([])).count() == 0
    assert exact_dedup.exact_dedup(make_docs([])).count() == 0


def test_fullest_matches_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        room = rng.randint(1, 30)
        counts = np.zeros(31, np.int64)
        for _ in range(rng.randint(0, 6)):
            counts[rng.randint(1, 30)] += rng.randint(1, 3)
        reach = {0}
        for n in range(1, room + 1):
            for _ in range(counts[n]):
                reach |= {r + n for r in reach if r + n <= room}
        found = packing.fullest(counts, room)
        assert sum(n * k for n, k in found) == max(reach)
        assert all(0 < k <= counts[n] for n, k in found)


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(1, 65, 3000), minlength=65)
    used, bins = np.zeros(65, np.int64), 0
    for times, inside in packing.plan_bins(counts, 64):
        assert sum(n * k for n, k in inside) <= 64
        for n, k in inside:
            used[n] += times * k
        bins += times
    assert (used == counts).all()
    assert bins <= 1.01 * int((counts * np.arange(65)).sum()) / 64 + 1


def test_packing_round_trip(make_docs, odd_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(odd_rows)] + [(50, "<|endoftext|> it's 1,234\n\n  x", "en")]
    got = defaultdict(list)
    for r in packing.best_fit_pack(make_docs(rows), capacity=64).collect():
        got[r["doc_id"]].append(r)
    places = defaultdict(list)
    for k, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(got[k], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces))) and sum(p["length"] for p in pieces) == len(ids)
        assert all(p["length"] == 64 for p in pieces[1:]) and (len(ids) > 64 or len(pieces) == 1)
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
            places[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.best_fit_pack(make_docs([])).count() == 0


def brute_fingerprint(text):
    words = [w for w in __import__("re").findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """{id: smallest id} with links at 3 or fewer bits."""
    ids, parent = list(fps), {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for k, a in enumerate(ids):
        for b in ids[k:]:
            if (fps[a] ^ fps[b]).bit_count() <= 3 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {a: find(a) for a in ids}


def test_simhash_fingerprint():
    for text in ["", None, " \t\n", "One", "a B", "The quick brown FOX jumps", "É é 漢字 x y\x0bz", "x " * 30_000]:
        assert simhash.simhash(text) == brute_fingerprint(text)


def test_simhash_components_match_brute_force(make_docs, odd_rows):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]
        rows.append((100 + 2 * k, " ".join(words), "en"))
        if rng.random() < 0.5 and len(words) > 3:
            words[rng.randrange(len(words))] = "changed"
            rows.append((101 + 2 * k, " ".join(words), "en"))
    rows += [r for r in odd_rows if r[0] is not None and r != odd_rows[6]]
    want = brute_components({i: brute_fingerprint(t) for i, t, _ in rows})
    got = as_dict(simhash.simhash_components(make_docs(rows)))
    assert {i: got[i]["component_id"] for i in want} == want
    assert all(got[i]["fingerprint"] == f"{brute_fingerprint(t):016x}" for i, t, _ in rows)
    assert simhash.simhash_components(make_docs([])).count() == 0


@pytest.mark.parametrize("block", [2048, 8])
def test_dense_groups_lose_no_link(spark, block):
    """Chains and balls of fingerprints; small blocks force the splitting of hot keys."""
    rng = random.Random(5)
    fps = {0}
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(60):
            base ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                base ^= 1 << rng.randrange(64)
            fps.add(base)
    fps = dict(enumerate(sorted(fps)))
    unique = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in fps.items()], "fp long, rep long")
    edges = simhash.near_links(unique, block=block)
    got = {k: k for k in fps} | {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got == brute_components(fps)


def test_threshold_allocation_covers_the_radius():
    rng = np.random.default_rng(6)
    bits = (rng.random((500, 64)) < rng.random(64)).astype(float)
    for n in (100, 10**5, 10**7, 10**9):
        plan = simhash.allocate(n, bits.T @ bits * n / 500)
        assert sum(t + 1 for _, t in plan) == 4
        assert len({b for part, _ in plan for b in part}) == sum(len(part) for part, _ in plan)


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 100)] + [(200, k) for k in range(201, 260)] + [(300, 300), (None, 5)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(101)} | {k: 200 for k in range(200, 260)}


def test_packing_gives_the_added_token_its_id(spark, make_docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tallyvane.llm import queries

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny", "<|endoftext |> none", "it's 1,234  <|endoftext|>  é 漢字"]
    make_docs([(k, t, "en") for k, t in enumerate(texts)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.queries()["op3_best_fit_packing"](spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (got[k]["length"], got[k]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def brute_classes(sets, similarity):
    """The smallest index that links of at least this Jaccard similarity reach, by all pairs."""
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= similarity * len(a | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("columns", [7, 4096])
def test_alike_matches_all_pairs(columns):
    rng = random.Random(8)
    sets = []
    for _ in range(60):
        base = set(rng.sample(range(400), rng.randint(1, 40)))
        sets += [base, {x if rng.random() > 0.08 else 1000 + rng.randrange(50) for x in base}]
    sets += [set(), set(), sets[0]]
    got = simhash.alike([np.array(sorted(s), "<u8") for s in sets], 0.8, columns)
    assert got.tolist() == brute_classes(sets, 0.8)


@pytest.mark.parametrize("block", [512, 8])
def test_similar_components_match_all_pairs(spark, make_docs, odd_rows, block):
    """Near copies of near copies: classes are those of all pairs, whatever the size of the blocks."""
    rng, rows = random.Random(9), []
    for k in range(6):
        words = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for j in range(20):
            rows.append((100 * k + j, " ".join(words), "en"))
            words = list(words)
            words[rng.randrange(120)] = f"new{k}_{j}"
    rows += [(1000 + k, t, lang) for k, (_, t, lang) in enumerate(odd_rows)]
    words = [(t or "").lower().split() for _, t, _ in rows]
    sets = [{tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))} - {()} for w in words]
    texts = {}
    want = defaultdict(set)
    for (i, t, _), label in zip(rows, brute_classes(sets, 0.8)):
        texts[i] = t
        want[label].add(t or "")
    got = defaultdict(set)
    found = simhash.similar_components(make_docs(rows), block=block).collect()
    for r in found:
        got[r["component_id"]].add(texts[r["doc_id"]] or "")
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    assert simhash.similar_components(make_docs([])).count() == 0


def test_null_and_large_ids_stay_whole(spark, make_docs):
    """A null id beside ids that doubles cannot hold."""
    ids = [2**53 + 1, None, 2**53 + 3, -(2**60) - 7, 2**62 + 1]
    docs = make_docs([(i, "the same words again and again " * (k % 2 + 1) * 300, "en") for k, i in enumerate(ids)]).coalesce(1)
    by = lambda r: (r is not None, r or 0)
    assert sorted((r["doc_id"] for r in simhash.simhash_components(docs).collect()), key=by) == sorted(ids, key=by)
    assert {r["component_id"] for r in simhash.simhash_components(docs).collect()} <= set(ids)
    pieces = packing.best_fit_pack(docs).collect()
    assert {r["doc_id"] for r in pieces} == set(ids) and pieces[0].__fields__ == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for i in ids:
        own = sorted((r["piece"], r["start"], r["length"]) for r in pieces if r["doc_id"] == i)
        assert [p for p, _, _ in own] == list(range(len(own))) and all(a + n == b for (_, a, n), (_, b, _) in zip(own, own[1:])) and all(n == 1024 for _, _, n in own[1:])


@pytest.mark.parametrize("how", [{}, {"block": 16, "pairs": 64}])
def test_values_within_the_threshold_are_no_rows(spark, monkeypatch, how):
    """Rows of the index do not grow with the values that are looked up, and no pair within both bounds is lost, also in split groups."""
    rng, fps = random.Random(15), set()
    for _ in range(6):
        one = [rng.getrandbits(64), rng.getrandbits(64)]
        for _ in range(50):
            one = list(one)
            for _ in range(rng.randrange(1, 14)):
                one[rng.randrange(2)] ^= 1 << rng.randrange(64)
            fps.add(tuple(one))
    fps = sorted(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    unique = spark.createDataFrame([(signed(a), signed(b), 10 * k - 900) for k, (a, b) in enumerate(fps)], "fp long, fp2 long, rep long")
    monkeypatch.setattr(simhash, "allocate", lambda *_: [(list(range(k, 64, 4)), 2) for k in range(4)])
    made, plain = [], type(unique).mapInPandas
    monkeypatch.setattr(type(unique), "mapInPandas", lambda self, f, schema, *more: made.append((schema, plain(self, f, schema, *more))) or made[-1][1])
    edges = simhash.near_links(unique, 11, total=30, **how)
    got = {10 * k - 900: 10 * k - 900 for k in range(len(fps))} | {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    parent = {k: k for k in range(len(fps))}
    for a in range(len(fps)):
        for b in range(a):
            near = (fps[a][0] ^ fps[b][0]).bit_count()
            if near <= 11 and near + (fps[a][1] ^ fps[b][1]).bit_count() <= 30:
                old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
                parent = {k: new if v == old else v for k, v in parent.items()}
    assert got == {10 * k - 900: 10 * v - 900 for k, v in parent.items()} and 6 <= len(set(parent.values())) < len(fps) - 50
    if not how:
        rows = [df for schema, df in made if "rep" in schema]
        assert len(rows) == 1 and rows[0].count() < 40 * len(fps)
