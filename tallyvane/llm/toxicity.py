"""Toxicity: noisy-channel restoration of obfuscated words, then a logistic score of words and beginnings of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.llm._common import cut
from tallyvane.llm.langid import SPACE, _letters, letters

#: Which letters a symbol can stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
#: What may part the letters of one word, up to three at a time; symbols that also begin, and that also end ordinary words.
SEPARATORS, OPENINGS, ENDINGS = " .-_*/", "(*", "!|+(*$"
UNIT, PARTED = re.compile(r"[ .\-_/]+|(.)\1*", re.S), re.compile(r"[ .\-_/]+")
BUCKETS, SHORTEST, LONGEST = 1 << 22, 3, 10
SIGNS, GAP = 28, 27  # a to z, any other letter, the space
#: The channel, as log-probabilities: a letter doubled, a symbol for a letter, a symbol that is none.
DOUBLED, SWAPPED, AS_IT_IS = -8.0, -1.0, -7.0
WINDOW, REMEMBERED = 2000, 64  # units of a span that are held before the part all paths share is settled; spans up to that length are kept in memory


def chunks(texts: list[str], chars: int = 200_000) -> Iterator[list[str]]:
    """The texts in order, in lists of about that many characters, so that array work has few calls."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _sign(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == SPACE, 27, np.where((codes >= 97) & (codes <= 122), codes - np.uint64(97), 26)).astype(np.int64)


def learn_character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-probabilities of a letter after two others, from the trigrams of every text; partitions return fixed-size sums."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIGNS**3, np.int64)
        for batch in batches:
            for part in chunks([t for t in batch["text"].array if t]):
                s = _sign(letters("\n".join(part)))
                total += np.bincount((s[:-2] * SIGNS + s[1:-1]) * SIGNS + s[2:], minlength=SIGNS**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": total[at]})

    counts = np.zeros(SIGNS**3)
    for row in docs.select(F.col(text_col).alias("text")).mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[row["cell"]] = row["n"]
    counts = counts.reshape(SIGNS, SIGNS, SIGNS) + 0.1
    return np.log(counts / counts.sum(2, keepdims=True))


def _options(char: str, run: int, doubled: float, free: bool) -> list[tuple[str, float]]:
    """What one observed character, repeated `run` times, can stand for, with the channel's log-probability.

    doubled: the share of the span's letters that are doubled besides the first such, which makes each of them less of a
    surprise; a single doubled letter is none. free: whether the symbol may stand there in an ordinary text.
    """
    if char.isalpha():
        if run == 1:
            return [(char, 0.0)]
        return [(char * 2, 0.0 if run == 2 else -1.5), (char, DOUBLED * (1 - doubled) if run == 2 else -0.5)]
    stands = LEET.get(char, "")
    out = [(" ", 0.0 if not stands or free else AS_IT_IS)] + [(c, SWAPPED) for c in stands]
    return out + [(c * 2, 2 * SWAPPED) for c in stands if run == 2] + ([("", -4.0)] if char in SEPARATORS else [])


def _gap(gap: str, k: int, sizes: list[int]) -> list[tuple[str, float]]:
    """The same for the separators after the k-th part of a span; parts have these sizes.

    Single characters in a row are spelled out: a single separator between them is likely none, a wider one and those
    around them likely stand. Else a part is the less likely broken off the longer it is.
    """
    left, right = sizes[k], sizes[k + 1]
    spelled = left == 1 and k > 0 and sizes[k - 1] == 1 or right == 1 and k + 2 < len(sizes) and sizes[k + 2] == 1
    if spelled and left == right == 1 and len(gap) == 1:
        return [("", 0.0), (" ", -6.0)]
    return [(" ", 0.0), ("", -9.0 if spelled else -3.0 - 1.5 * min(left, right, 4))]


def viterbi(span: str, model: list) -> str:
    """The likeliest words behind one span: the best path through the lattice of its characters' readings.

    model[a][b][c] is the log-probability of sign c after a and b. A state is the last two letters of a reading; it keeps
    its best predecessor. Where the paths of all states have their beginning in common, it is settled and forgotten, as soon
    as `WINDOW` units are held; so a span of any length has its likeliest reading, and is held no longer than paths differ.
    """
    units = [(m[0], m[1]) for m in UNIT.finditer(span)]
    sizes = [*map(len, PARTED.split(span))]
    letters_, twice = (sum(c is not None and c.isalpha() and len(u) in n for u, c in units) for n in ((1, 2), (2,)))
    states, back, part, settled, held = {(GAP, GAP): 0.0}, [], 0, [], WINDOW

    def settle(state: tuple[int, int], end: int) -> None:
        out = []
        for came in reversed(back[:end]):
            state, reading = came[state]
            out.append(reading)
        settled.append("".join(reversed(out)))
        del back[:end]

    for k, (unit, char) in enumerate(units):
        if char is None:
            options, part = _gap(unit, part, sizes), part + 1
        else:
            options = _options(char, len(unit), max(twice - 1, 0) / max(letters_, 1), not k and char in OPENINGS or k and k == len(units) - 1 and char in ENDINGS)
        following: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for state, logp in states.items():
            for reading, cost in options:
                (x, y), p = state, logp
                if reading != " " or y != GAP or not k:
                    p += cost
                for c in reading:
                    z = ord(c) - 97 if "a" <= c <= "z" else GAP if c == " " else 26
                    if z != GAP or y != GAP:
                        p, x, y = p + model[x][y][z], y, z
                if (x, y) not in following or p > following[x, y]:
                    following[x, y], came[x, y] = p, (state, reading)
        states = following
        back.append(came)
        if len(back) >= held:
            ends, at = {*states}, len(back)
            while at and len(ends) > 1:
                at -= 1
                ends = {back[at][state][0] for state in ends}
            if at and len(ends) == 1:
                settle(ends.pop(), at)
            held = max(WINDOW, 2 * len(back))
    settle(max(states, key=lambda s: states[s] + (model[s[0]][s[1]][GAP] if s[1] != GAP else 0.0)), len(back))
    return "".join(settled)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@cache
def _kinds() -> np.ndarray:
    """For each code point: 1 a letter, 2 a symbol that can stand for one, 3 a separator, else 0; * is a separator."""
    kinds = (_letters() != SPACE).astype(np.uint8)
    for char in LEET:
        kinds[ord(char)] = 2
    for char in SEPARATORS:
        kinds[ord(char)] = 3
    return kinds


def suspects(codes: np.ndarray, model: np.ndarray, doubt: float = 6.0) -> np.ndarray:
    """Positions of lower-cased text around which a reading other than the literal one may be likelier.

    Letters beside a symbol; a letter three times running, or twice where the model finds one of them much likelier; gaps
    of one to three separators that the model would rather not have, and single letters in a row. Endings such as the ! of
    an ordinary word count only before a letter or another symbol. What has no letter at all is a number and stays.
    """
    kinds = _kinds()[codes]
    letter, symbol = kinds == 1, (kinds == 2) | (codes == ord("*"))
    hit = np.zeros(len(codes), bool)
    hit[1:] |= symbol[:-1] & letter[1:]
    # What follows a run of endings: an ordinary word has no letter or other symbol there.
    after = np.append(~(symbol & np.isin(codes, [*map(ord, ENDINGS)])), True)
    following = np.minimum.accumulate(np.where(after, np.arange(len(after)), len(after))[::-1])[::-1]
    near = np.flatnonzero(symbol[1:] & letter[:-1])
    hit[near[np.append(symbol | letter, False)[following[near + 1]]]] = True
    sign = np.concatenate([[False], letter | symbol, [False]])
    single = np.flatnonzero(sign[1:-1] & ~sign[:-2] & ~sign[2:])
    if len(single):
        chain = np.cumsum(np.append(0, (np.diff(single) != 2) | (kinds[single[1:] - 1] != 3)))
        spelled = (np.bincount(chain) >= 3) & (np.bincount(chain, letter[single]) > 0)
        hit[single[spelled[chain]]] = True
    at = np.flatnonzero(letter)
    if len(at) < 2:
        return np.flatnonzero(hit)
    signs, apart = np.concatenate([_sign(codes[at].astype(np.uint64)), [GAP]]), np.append(np.diff(at) > 1, True)

    def around(k: np.ndarray) -> tuple[np.ndarray, ...]:
        """Letters k and k + 1, the one before and the one after them, as far as they touch."""
        before = np.where((k > 0) & ~apart[k - 1], signs[k - 1], GAP)
        return before, signs[k], signs[k + 1], np.where(apart[k + 1], GAP, signs[k + 2])

    gaps = np.flatnonzero(apart[:-1] & (np.diff(at) <= 4))
    other = np.cumsum(np.append(0, kinds != 3))
    gaps = gaps[other[at[gaps + 1]] == other[at[gaps] + 1]]
    a, b, c, d = around(gaps)
    gain = model[a, b, c] + model[b, c, d] - model[a, b, GAP] - model[b, GAP, c] - model[GAP, c, d]
    found = [gaps[(gain > doubt) | (a == GAP) & (d == GAP)]]
    doubles = np.flatnonzero((codes[at[1:]] == codes[at[:-1]]) & ~apart[:-1])
    a, b, c, d = around(doubles)
    found.append(doubles[model[a, b, d] - model[a, b, c] - model[b, c, d] > doubt])
    found.append(doubles[1:][np.diff(doubles) == 1])
    found = np.concatenate(found)
    hit[at[found]] = hit[at[found + 1]] = True
    return np.flatnonzero(hit)


class Restorer:
    """Puts the likeliest words in the place of suspect spans of whole lower-cased texts; all else stays as it is."""

    def __init__(self, model: np.ndarray):
        self.model, rows = model, model.tolist()
        short = lru_cache(100_000)(lambda span: viterbi(span, rows))
        self.decode = lambda span: short(span) if len(span) <= REMEMBERED else viterbi(span, rows)

    def __call__(self, texts: list[str]) -> list[str]:
        out, codes = list(texts), _codes("\n".join(texts))
        at = suspects(codes, self.model)
        if not len(at):
            return out
        # A piece is a run of letters and symbols; a span is the pieces of suspects that only separators part.
        kinds = _kinds()[codes]
        edges = np.concatenate([[-1], np.flatnonzero((kinds == 0) | (kinds == 3) & (codes != ord("*"))), [len(codes)]])
        k = np.searchsorted(edges, at)
        starts, stops = edges[k - 1] + 1, edges[k]
        other = np.cumsum(np.append(0, kinds != 3))
        apart = (starts[1:] - stops[:-1] > 3) | (other[starts[1:]] > other[np.minimum(stops[:-1], starts[1:])])
        first = np.flatnonzero(np.append(True, apart))
        starts, stops = starts[first], np.maximum.reduceat(stops, first)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        owner = np.searchsorted(begins, starts, "right") - 1
        for i in np.unique(owner).tolist():
            mine, done, parts = owner == i, 0, []
            for a, b in zip((starts[mine] - begins[i]).tolist(), (stops[mine] - begins[i]).tolist()):
                parts += [texts[i][done:a], self.decode(texts[i][a:b])]
                done = b
            out[i] = "".join([*parts, texts[i][done:]])
        return out


MIX, BASE = np.uint64(0xD6E8FEB86659FD93), 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power of 1 to n, modulo 2 ** 64, and the inverses."""
    return tuple(np.cumprod(np.full(n, x, np.uint64)) for x in (BASE, pow(BASE, -1, 1 << 64)))


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word beginnings of SHORTEST to LONGEST letters, and whole words of any length, of lower-cased texts.

    Returns the buckets and, for each, the number of its text. A hash is a difference of running sums, so that a word of
    any length costs the same.
    """
    codes = np.append(_letters()[_codes("\n" + "\n".join(texts))], SPACE).astype(np.uint64)
    space = codes == SPACE
    at, end = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    owner = np.searchsorted(np.cumsum([1, *(len(t) + 1 for t in texts[:-1])]), at, "right") - 1
    up, down = _powers(1 << len(codes).bit_length())
    mixed = codes * MIX
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ mixed >> np.uint64(29)) * up[: len(codes)])])
    found, owners = [(sums[end] - sums[at]) * down[at] ^ MIX], [owner]
    for k in range(SHORTEST, LONGEST + 1):
        long = end - at >= k
        at, end, owner = at[long], end[long], owner[long]
        found.append((sums[at + k] - sums[at]) * down[at])
        owners.append(owner)
    hashes = np.concatenate(found)
    hashes ^= hashes >> np.uint64(32)
    return (hashes * MIX >> np.uint64(42)).astype(np.int64), np.concatenate(owners)


def distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """sequences, each bucket once per text."""
    found, owner = sequences(texts)
    both = np.unique(owner << 22 | found)
    return both & (BUCKETS - 1), both >> 22


_tables: dict[bytes, np.ndarray] = {}


class ToxicityModel:
    """A character model, and the logistic weights of some buckets; base is the log-odds of a text without any of them."""

    def __init__(self, characters: np.ndarray, buckets: np.ndarray, weights: np.ndarray, base: float):
        self.characters, self.buckets, self.weights, self.base = characters, buckets, weights, base

    def _table(self) -> np.ndarray:
        """The weight of every bucket; a worker keeps the table of the last model."""
        key = self.buckets.tobytes() + self.weights.tobytes()
        if key not in _tables:
            _tables.clear()
            _tables[key] = np.zeros(BUCKETS, np.float32)
            _tables[key][self.buckets] = self.weights
        return _tables[key]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of each restored text, from all its weighted words and beginnings, each counted once."""
        table, restore, out = self._table(), Restorer(self.characters), []
        for part in chunks([(t or "").lower() for t in texts]):
            found, owner = sequences(restore(part))
            weighted = table[found] != 0
            both = np.unique(owner[weighted] << 22 | found[weighted])
            odds = self.base + np.bincount(both >> 22, table[both & (BUCKETS - 1)], len(part))
            out.append(1 / (1 + np.exp(-odds)))
        return np.concatenate(out) if out else np.empty(0)


def fit_logistic(rows: np.ndarray, features: np.ndarray, y: np.ndarray, n: np.ndarray, size: int, ridge: float = 0.5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and base of a ridge logistic regression on sparse 0/1 features, by accelerated gradient steps.

    (rows, features) are the ones of the matrix; each row has a label y and stands for n texts. The base is not penalised.
    """
    w, momentum, t = np.zeros(size + 1), np.zeros(size + 1), 1.0
    w[-1] = momentum[-1] = np.log((n @ y + 0.5) / (n @ (1 - y) + 0.5))
    per_row = np.bincount(rows, minlength=len(y)) + 1.0
    # Each feature has its own step: half the sum, over its rows, of what bounds the curvature there.
    curve = 0.25 * np.append(np.bincount(features, (n * per_row)[rows], size), n @ per_row) + ridge
    for _ in range(rounds):
        odds = momentum[-1] + np.bincount(rows, momentum[features], len(y))
        error = n * (1 / (1 + np.exp(-odds)) - y)
        slope = np.append(np.bincount(features, error[rows], size) + ridge * momentum[:-1], error.sum())
        new, t_new = momentum - slope / curve, (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labelled: DataFrame, label_col: str = "toxic", text_col: str = "text", evidence: float = 8.0,
                 lift: float = 4.0) -> ToxicityModel:
    """Learn from rows (doc_id, text, label): a logistic score of the words and beginnings of words that tell the labels.

    docs, all of them, give the character model. Each labelled text is restored first. A bucket is a feature if its
    log-likelihood ratio against the base rate, over the labelled texts, is at least `evidence`, and the odds of the label
    with it are at least `lift` times those of all texts: fixed bars, however many texts there are. labelled is a bounded
    sample (labelled_rows), so the driver may fit the weights on what it holds of the features, equal rows summed up
    before. Without toxic labels every score is 0.
    """
    characters = learn_character_model(docs, text_col)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore, have, rows = Restorer(characters), np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for y, texts in batch.groupby("y")["text"]:
                rows[y] += len(texts)
                for part in chunks([(t or "").lower() for t in texts]):
                    np.add.at(have[y], distinct(restore(part))[0], 1)
        at = np.flatnonzero(have.any(0))
        yield pd.DataFrame({"bucket": np.append(at, -1), "n0": np.append(have[0, at], rows[0]), "n1": np.append(have[1, at], rows[1])})

    rows = labelled.where(F.col(label_col).isin(0, 1)).select("text", F.col(label_col).cast("int").alias("y"))
    sums = cut(rows.mapInPandas(count, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    total = sums.where("bucket = -1").first()
    if total is None or not total["n1"]:
        return ToxicityModel(characters, np.empty(0, np.int64), np.empty(0), -np.inf)
    prior = (total["n1"] + 0.5) / (total["n0"] + total["n1"] + 1)
    share = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    told = F.col("n1") * F.log(share / prior) + F.col("n0") * F.log((1 - share) / (1 - prior))
    found = sums.where((F.col("bucket") >= 0) & (share / (1 - share) >= lift * prior / (1 - prior)) & (told >= evidence)).select("bucket").orderBy("bucket").collect()
    buckets = np.array([r["bucket"] for r in found], np.int64)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore, place = Restorer(characters), np.full(BUCKETS, -1, np.int32)
        place[buckets] = np.arange(len(buckets))
        for batch in batches:
            has = []
            for part in chunks([(t or "").lower() for t in batch["text"].array]):
                found, owner = distinct(restore(part))
                mine = place[found] >= 0
                has += [x.tobytes() for x in np.split(place[found[mine]], np.searchsorted(owner[mine], np.arange(1, len(part))))]
            yield pd.DataFrame({"y": batch["y"], "has": has})

    points = rows.mapInPandas(held, "y int, has binary").groupBy("y", "has").agg(F.count("*").alias("n")).orderBy("y", "has").toPandas()
    sizes = points["has"].map(len).to_numpy() // 4
    features = np.frombuffer(b"".join(points["has"]), np.int32).astype(np.int64)
    weights, base = fit_logistic(np.repeat(np.arange(len(points)), sizes), features, points["y"].to_numpy(float), points["n"].to_numpy(float), len(buckets))
    return ToxicityModel(characters, buckets, weights, base)


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """The score, 0 to 1, of each whole text, restored first.

    Null and empty texts, and those without any learned word or beginning, get the base score. Nothing is cut: tokens and
    texts of any length are read to their end. Equal texts have equal scores.
    """

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(list(texts.array)), dtype=float)

    return F.pandas_udf(run, "double")(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; other columns are left out, so their names cannot clash.

    Null texts score as empty ones, repeated rows give repeated results, ties stay ties, and an empty table gives none.
    """
    return docs.select(F.col(id_col).alias("doc_id"), toxicity(F.col(text_col), model).alias("score"))
