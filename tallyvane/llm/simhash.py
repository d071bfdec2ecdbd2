"""SimHash near-duplicates, linked through a generalised pigeonhole index."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.llm._common import cut
from tallyvane.operators.graph import connected_components

BITS = 64
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: What a value that is looked up costs in the threshold allocation, and a candidate pair checked inside a task.
ROW_COST, PAIR_COST = 1.0, 0.02
#: Rows of a group of the index, and pairs that are compared at a time in it.
GROUP, PAIRS = 1 << 21, 1 << 20


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of one whole text, in order; a text of fewer words is one shingle, one without words has none."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(UPPER))
    if not words:
        return np.empty(0, "<u8")
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles), "<u8")


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero without any."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint of one whole text: bit b is 1 if it is set in over half of its shingles' XXH64 values."""
    return _majority(shingle_hashes(text, width))


def second_word(hashes: np.ndarray) -> int:
    """64 more bits of a fingerprint, from the same shingles by other bits of their hashes."""
    mixed = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0x9FB21C651E98DF25)
    return _majority(mixed ^ mixed >> np.uint64(28))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, words: int = 1) -> DataFrame:
    """(doc_id, fp): one row per input row, fp the fingerprint's bits as a signed long. Null or wordless text has fp 0.

    With two words, fp2 holds 64 further bits. Only texts go through Python, so ids, null or of any size, stay as they are.
    """

    def run(texts: pd.Series) -> pd.DataFrame:
        hashes = [shingle_hashes(t, width) for t in texts.array]
        out = {"fp": np.array([*map(_majority, hashes)], dtype=np.uint64).view(np.int64)}
        if words == 2:
            out["fp2"] = np.array([*map(second_word, hashes)], dtype=np.uint64).view(np.int64)
        return pd.DataFrame(out)

    marks = F.pandas_udf(run, "fp long" + ", fp2 long" * (words == 2))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), marks(F.col(text_col)).alias("m")).select("doc_id", "m.*")


def _bit_moments(unique: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each two bits, in how many both are set; one fixed-size sum per partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy().astype("<i8").view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
            n, both = n + len(batch), both + bits.T @ bits
        if n:
            yield pd.DataFrame({"cell": np.arange(-1, BITS * BITS), "n": np.concatenate([[n], both.ravel()]).round().astype(np.int64)})

    both = np.zeros(BITS * BITS + 1)
    for row in unique.select("fp").mapInPandas(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        both[row["cell"] + 1] = row["n"]
    return int(both[0]), both[1:].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bits into parts of nearly equal size, each grown from the most correlated bits that are left."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    tie = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        part = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        while len(part) < size:
            part.append(max((b for b in left if b not in part), key=lambda b: (tie[b, part].sum(), -b)))
        left = [b for b in left if b not in part]
        out.append(sorted(part))
    return out


def allocate(n: int, both: np.ndarray, radius: int = 3) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part in use, with the least estimated cost.

    General pigeonhole principle: if the thresholds plus one add up to radius + 1, two fingerprints within the radius are
    within the threshold of some part; a threshold of -1 leaves a part out. For each number of parts, dynamic programming
    over the parts spends the radius + 1 units. The candidates of a part come from the distribution of the distance of two
    random fingerprints in its bits (a sum of independent bits, from each bit's share over all data).
    """
    share = np.diag(both) / max(n, 1)
    differ = 2 * share * (1 - share)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(2, 9):
        groups = group_bits(n, both, parts)
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            near = np.array([1.0])
            for b in bits:
                near = np.convolve(near, [1 - differ[b], differ[b]])
            cost = {-1: 0.0}
            for t in range(min(radius, 2) + 1):
                rows = 1 + sum(comb(len(bits), e) for e in range(1, t + 1)) / 2
                cost[t] = ROW_COST * n * rows + PAIR_COST * n * n / 2 * near[: t + 1].sum()
            following: dict[int, tuple[float, list[int]]] = {}
            for spent, (total, chosen) in state.items():
                for t, c in cost.items():
                    key = min(spent + t + 1, radius + 1)
                    if key not in following or total + c < following[key][0]:
                        following[key] = (total + c, [*chosen, t])
            state = following
        if radius + 1 not in state:
            continue
        total, chosen = state[radius + 1]
        if total < best[0]:
            best = (total, [(bits, t) for bits, t in zip(groups, chosen) if t >= 0])
    return best[1]


def _spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars that connect what the edges (u, v) connect: at most one per node."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _value(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint as one number, the first of them lowest."""
    out = np.zeros(len(fps), np.uint64)
    for j, b in enumerate(bits):
        out |= (fps >> np.uint64(b) & np.uint64(1)) << np.uint64(j)
    return out


def _flips(bits: int, most: int, least: int = 0) -> list[int]:
    """Masks of least to most of so many bits."""
    return [sum(1 << j for j in flips) for e in range(least, most + 1) for flips in combinations(range(bits), e)]


def group_prefix(n: int, both: np.ndarray, bits: list[int], t: int) -> tuple[list[int], int]:
    """The bits of a part, the most even first, and how many of them name its groups: the fewest for which a group has GROUP
    rows at most, with those that visit it."""
    bits = sorted(bits, key=lambda b: (abs(both[b, b] / max(n, 1) - 0.5), b))
    rows = lambda g: n / 2**g * (1 + sum(comb(g, e) for e in range(1, t + 1)) / 2)
    return bits, next((g for g in range(min(4, len(bits)), len(bits)) if rows(g) <= GROUP), len(bits))


def _links(fps: np.ndarray, reps: np.ndarray, role: np.ndarray, group: int, bits: list[int], prefix: int, t: int, radius: int, more: np.ndarray | None = None, both: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the pairs within the radius between rows that ask and rows that are indexed (role 1, 0, or 2 for both)
    in one group, of those whose bits of the part differ in t at most.

    Rows that ask may come from other groups; inside of the group a pair is asked by its smaller value, or else by its
    smaller representative. With second words in `more`, the bits that differ in both words together must be at most `both`.
    """
    low = _value(fps, bits[prefix:])
    index = np.flatnonzero(role != 1)
    index = index[np.argsort(low[index], kind="stable")]
    keys, first, times = np.unique(low[index], return_index=True, return_counts=True)
    away = np.bitwise_count(_value(fps, bits[:prefix]) ^ np.uint64(group))
    asks = np.flatnonzero(role != 0)
    asks = asks[np.argsort(low[asks], kind="stable")]
    us, vs, held = [], [], 0
    for e in range(t + 1 if len(keys) else 0):
        asking = asks[away[asks] == e]
        for mask in _flips(len(bits) - prefix, t - e) if len(asking) else []:
            wanted = low[asking] ^ np.uint64(mask)
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[place] == wanted
            if e == 0 and mask:
                hit &= wanted > low[asking]
            one, place = asking[hit], place[hit]
            ends = np.cumsum(times[place])
            done = 0
            while done < len(one):
                # As many rows that ask as make PAIRS pairs, or one.
                last = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
                n = times[place[done:last]]
                x = np.repeat(one[done:last], n)
                y = index[np.repeat(first[place[done:last]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                far = np.bitwise_count(fps[x] ^ fps[y])
                near = np.flatnonzero((far <= radius) & (reps[x] != reps[y] if e or mask else reps[x] < reps[y]))
                if more is not None:
                    near = near[far[near] + np.bitwise_count(more[x[near]] ^ more[y[near]]) <= both]
                us.append(reps[x[near]])
                vs.append(reps[y[near]])
                held += len(near)
                if held > 500_000:
                    u, v = _spanning(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], 0 if len(u) > 250_000 else len(u)
                done = last
    return _spanning(np.concatenate([np.empty(0, np.int64), *us]), np.concatenate([np.empty(0, np.int64), *vs]))


def near_links(unique: DataFrame, radius: int = 3, block: int = 1 << 20, total: int | None = None, pairs: int = 1 << 28) -> DataFrame:
    """Edges (u, v) between representatives that connect all fingerprints within the radius of each other.

    unique: (fp, rep), each rep once. In each part, rows whose first bits are the same are a group, and a row also visits the
    groups of larger bits that differ in no more of them than the part's threshold; there its values within the threshold
    are looked up among the group's, so these are never rows. A group with more than `block` rows, or more than `pairs`
    pairs of equal values, is split into cells of a block of its rows and a share of those that ask, so that no task holds
    more. Every pair is verified, and a cell returns at most one edge per row. With a total, unique has fp2 as well, and a
    pair is verified by it too: at most `total` bits of both words may differ.
    """
    extra = [] if total is None else ["fp2"]
    n, both = _bit_moments(unique)
    if n < 2:
        return unique.sparkSession.createDataFrame([], "u long, v long")
    plan = [(*group_prefix(n, both, bits, t), t) for bits, t in allocate(n, both, radius)]
    top = lambda part, value: (value | np.uint64(part << 56)).view(np.int64)

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy().view(np.uint64)
            for part, (bits, prefix, _) in enumerate(plan):
                yield pd.DataFrame({"group": top(part, _value(fps, bits[:prefix])), "value": _value(fps, bits[prefix:]).view(np.int64)})

    counted = unique.select("fp").mapInPandas(values, "group long, value long").groupBy("group", "value").agg(F.count("*").alias("n"))
    counted = counted.groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs")).where((F.col("n") > block) | (F.col("pairs") > pairs))
    # At most as many as there are groups, which a part's bits bound.
    cells = {r["group"]: (-(-r["n"] // block), max(1, -int(-r["pairs"] // pairs))) for r in counted.collect()}

    def dealt(group: np.ndarray, rows: pd.DataFrame, own: bool) -> Iterator[pd.DataFrame]:
        """Rows that ask in their groups, and are indexed there if these are their own."""
        split = np.isin(group, list(cells)) if cells else np.zeros(len(group), bool)
        yield rows[~split].assign(group=group[~split], cell=0, role=2 if own else 1)
        mixed = (rows["rep"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64)
        for g in np.unique(group[split]):
            here, (blocks, shares) = group == g, cells[g]
            some = rows[here].assign(group=g)
            yield from (some.assign(cell=b * shares + mixed[here] % shares, role=1) for b in range(blocks))
            if own:
                yield from (some.assign(cell=mixed[here] // shares % blocks * shares + k, role=0) for k in range(shares))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy().view(np.uint64)
            for part, (bits, prefix, t) in enumerate(plan):
                own = _value(fps, bits[:prefix])
                yield from dealt(top(part, own), batch, True)
                for mask in _flips(prefix, min(t, prefix), 1):
                    other = own ^ np.uint64(mask)
                    go = other > own
                    yield from dealt(top(part, other[go]), batch[go], False)

    columns = ["fp", "rep", *extra]
    rows = unique.select(*columns).mapInPandas(emit, ", ".join(f"{c} long" for c in columns) + ", group long, cell int, role byte")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for batch in batches:
            at = batch["group"].to_numpy(), batch["cell"].to_numpy()
            cuts = np.flatnonzero((at[0][1:] != at[0][:-1]) | (at[1][1:] != at[1][:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                if b > a and (at[0][a], at[1][a]) != key:
                    if held:
                        yield found(pd.concat(held))
                    key, held = (at[0][a], at[1][a]), []
                held.append(batch.iloc[a:b])
        if held:
            yield found(pd.concat(held))

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["group"].iloc[0])
        bits, prefix, t = plan[group >> 56]
        more = rows["fp2"].to_numpy().view(np.uint64) if extra else None
        u, v = _links(rows["fp"].to_numpy().view(np.uint64), rows["rep"].to_numpy(), rows["role"].to_numpy(), group & (1 << 56) - 1, bits, prefix, t, radius, more, total or 0)
        return pd.DataFrame({"u": u, "v": v})

    # Of few bytes and many pairs: as many tasks as a shuffle has, whatever their bytes.
    tasks = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "group", "cell").sortWithinPartitions("group", "cell").mapInPandas(match, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest doc_id that links reach. Null,
    empty and wordless texts have fingerprint zero and link like any other. Equal fingerprints are joined first, so that
    copies, however many, are one node. A document whose id is null has a fingerprint and the component of its group
    (null where every id of its fingerprint is null). Other columns of docs are left out.
    """
    marked = cut(fingerprints(docs, id_col, text_col, width))
    unique = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    components = connected_components(near_links(unique, radius))
    classes = unique.join(components, unique["rep"] == components["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return marked.join(classes, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def alike(sets: list[np.ndarray], similarity: float, columns: int = 4096) -> np.ndarray:
    """For each of the sorted sets, the first one that links of at least this Jaccard similarity reach.

    Members that sets share are counted by products of their 0/1 matrix, `columns` members at a time.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    _, member, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    shared = times[member] > 1
    order = np.argsort(place[member[shared]], kind="stable")
    column, row = place[member[shared]][order], np.repeat(np.arange(n), sizes)[shared][order]
    both = np.zeros((n, n), np.float32)
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        a, b = np.searchsorted(column, [first, first + columns])
        part = np.zeros((n, columns), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        both += part @ part.T
    near = (both >= similarity * (sizes[:, None] + sizes - both) - 1e-6) & (sizes > 0)
    label = np.arange(n)
    nodes, ends = _spanning(*np.nonzero(np.triu(near, 1)))
    label[nodes] = ends
    return label


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 11, total: int = 30, width: int = 5,
                       similarity: float = 0.8, block: int = 512, largest: int = 64, pivots: int = 8) -> DataFrame:
    """(doc_id, node, component_id) for each row of docs whose text links to another text; node is the hash of the text.

    Candidates are the components of fingerprints of two words that differ in at most `radius` of the 64 bits of either
    word and `total` of all 128. Each word is indexed and probed, so that similar texts are missed only where both are far
    apart; both together keep texts that have nothing in common from joining by chance, however many there are. Inside
    each component, two texts link if the Jaccard similarity of their sets of shingles, all of them, is at least
    `similarity`; component_id is the smallest node that links reach.

    In the `largest` components every text first meets `pivots` of its component; those alike to the same pivot are linked
    by it, and need not meet each other. What is left of a component is split into blocks of about `block` texts, and each
    two blocks that no pivot has linked meet in one group, so no link is lost. Null counts as empty text, texts without
    words link to none, repeated texts are one node, and an empty table gives an empty result; other columns are left out.
    """
    node = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    marked = cut(fingerprints(docs.select(node.alias("node"), text_col), "node", text_col, width, 2).distinct())
    unique = cut(marked.groupBy("fp", "fp2").agg(F.min("doc_id").alias("rep")))
    swapped = unique.select(F.col("fp2").alias("fp"), F.col("fp").alias("fp2"), "rep")
    found = connected_components(near_links(unique, radius, total=total).union(near_links(swapped, radius, total=total)))
    classes = unique.join(found, unique["rep"] == found["node"], "left").select("fp", "fp2", F.coalesce("component", "rep").alias("near"))
    near = cut(marked.join(classes, ["fp", "fp2"]).select(F.col("doc_id").alias("node"), "near"))
    sizes = cut(near.groupBy("near").agg(F.count("*").alias("n")).where("n > 1"))
    groups_of = sizes.select("near")
    members = cut(near.join(F.broadcast(groups_of) if sizes.count() <= 200_000 else groups_of, "near"))
    few = members.limit(200_001).count() <= 200_000
    texts = docs.select(node.alias("node"), F.col(text_col).alias("text")).join(F.broadcast(members) if few else members, "node")

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)).tobytes() for t in batch["text"].array]
            yield batch.drop(columns="text").assign(shingles=sets)

    rows = cut(texts.select("node", "near", "text").mapInPandas(shingled, "node long, near long, shingles binary").dropDuplicates(["node"]))
    big = [r["near"] for r in sizes.where(F.col("n") > 2 * block).orderBy(F.desc("n"), "near").limit(largest).collect()]
    place = F.row_number().over(Window.partitionBy("near").orderBy(F.xxhash64("node"), "node"))
    heads: dict[int, list[tuple[int, np.ndarray]]] = {}
    for r in rows.where(F.col("near").isin(big)).withColumn("r", place).where(F.col("r") <= pivots).collect() if big else []:
        heads.setdefault(r["near"], []).append((r["node"], np.frombuffer(r["shingles"], "<u8")))

    def against(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = (np.frombuffer(s, "<u8") for s in batch["shingles"])
            links = [[p for p, head in heads.get(g, ()) if p == n or jaccard(own, head) >= similarity] for n, g, own in zip(batch["node"], batch["near"], sets)]
            yield batch.assign(links=links)

    rows = cut(rows.mapInPandas(against, "node long, near long, shingles binary, links array<long>").withColumn("label", F.get("links", F.lit(0))))
    kinds = rows.groupBy("near", "label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    kinds = cut(kinds.withColumn("first", F.coalesce(F.sum("blocks").over(Window.partitionBy("near").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")))
    cells = kinds.select("near", "label", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("cell"))
    other = cells.select("near", F.col("label").alias("label2"), F.col("cell").alias("cell2"))
    met = cells.join(other, "near").where("cell <= cell2 and not (label <=> label2 and label is not null)")
    sides = F.explode(F.array_distinct(F.array("cell", "cell2"))).alias("side")
    pairs = met.select("near", F.struct("cell", "cell2").alias("pair"), sides).groupBy("near", F.col("side").alias("cell")).agg(F.collect_list("pair").alias("pairs"))
    split = kinds.where("blocks > 1 or first > 0").select("near", "label", "blocks", "first")
    split = F.broadcast(split) if split.limit(100_001).count() <= 100_000 else split
    dealt = rows.alias("r").join(split.alias("k"), (F.col("r.near") == F.col("k.near")) & F.col("r.label").eqNullSafe(F.col("k.label")), "left")
    cell = F.coalesce(F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks")), F.lit(0)).cast("int")
    dealt = dealt.select("node", F.col("r.near").alias("near"), "shingles", cell.alias("cell")).join(pairs, ["near", "cell"])
    groups = dealt.select("node", "near", "shingles", F.explode("pairs").alias("p")).select("node", "near", "shingles", F.concat_ws("-", "p.cell", "p.cell2").alias("pair"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, nodes, sets = None, [], []

        def edges() -> pd.DataFrame:
            label = alike(sets, similarity)
            rest, nodes_ = label != np.arange(len(nodes)), np.array(nodes, np.int64)
            return pd.DataFrame({"u": nodes_[rest], "v": nodes_[label[rest]]})

        for batch in batches:
            for near_, pair, n, s in zip(batch["near"], batch["pair"], batch["node"], batch["shingles"]):
                if (near_, pair) != key:
                    if len(nodes) > 1:
                        yield edges()
                    key, nodes, sets = (near_, pair), [], []
                if not nodes or nodes[-1] != n:
                    nodes.append(n)
                    sets.append(np.frombuffer(s, "<u8"))
        if len(nodes) > 1:
            yield edges()

    links = groups.repartition("near", "pair").sortWithinPartitions("near", "pair", "node").mapInPandas(link, "u long, v long")
    links = links.union(rows.select(F.col("node").alias("u"), F.explode("links").alias("v")))
    components = cut(connected_components(links))
    few = components.limit(200_001).count() <= 200_000
    return docs.select(F.col(id_col).alias("doc_id"), node.alias("node")).join(
        F.broadcast(components) if few else components, "node"
    ).select("doc_id", "node", F.col("component").alias("component_id"))
