"""Toxicity by a support vector machine over a gapped subsequence string kernel with Nyström landmarks.

A text is a bag of units: its words (A-Z and other letters lowered, signs and digits inside removed, so that inserted
characters go), the parts between signs, and runs of single letters joined. The kernel of two units is the cosine of
their weighted counts of three-character subsequences; a subsequence that spans s characters more than three weighs
DECAY ** s, up to REACH characters. Kernels count by what they have over FLOOR: units less alike say nothing. Landmarks
are the units that together cover the sample's toxic texts, COVER times where
they can, while staying out of the others (near copies count as one), and the clean units nearest to them. They are
looked for round by round, each among the CANDIDATES best units of the texts still uncovered, until a round finds none:
so their number follows the insults of the sample. A linear machine on the landmarks' Nyström features learns from the
labelled texts: a text's value is that of its highest unit, so that one insult in a long text tells, and a toxic text
must have a unit over the margin, a clean one none (the units that stand for toxic texts and the machine are found in
turn, until they stay). A logistic fit puts values on a scale of probability.

Scoring folds landmarks into tables of each subsequence's largest weight in any of them, which bound a unit's kernel with
all of them, or with a lot of like ones, at once: only units whose bound reaches FLOOR are compared with each landmark.

Texts that are null, empty or without letters have no units and get the value of such. If the sample has one class only,
all scores are 0. Repeated rows get equal scores, an empty table gives no rows; a doc_id with several labels has the
highest. Units over LONGEST letters are taken in overlapping parts; texts may have any length. Columns of the documents
may have any name.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semiflow.llm.common import by_length, held_out, small_batches

DECAY, REACH, LONGEST, KEPT = 0.6, 5, 24, 20_000
SIZE = 64**3
#: Landmarks that are to be found for each toxic text of the sample; units that a round of the search compares.
COVER, CANDIDATES = 3, 300
#: The least kernel of a unit and a landmark that counts; turns in which toxic texts choose their units anew.
FLOOR, ROUNDS = 0.45, 10
#: Landmarks whose bounds are taken together.
LOT = 32
#: Offsets of a subsequence's second and third character, and its weight.
SHAPES = [(a, b, DECAY ** (b - 2)) for b in range(2, REACH) for a in range(1, b)]
#: ASCII without letters and blanks.
SIGNS = bytes(b for b in range(128) if not (chr(b).isalpha() or chr(b).isspace()))
APART = bytes(32 if bytes([b]) in SIGNS else b for b in range(256))


def units_of(text: str) -> set[str]:
    raw = text.lower().encode()
    tokens = raw.translate(None, SIGNS).split()
    units = set(tokens)
    if len(raw.translate(None, SIGNS)) != len(raw):
        units.update(raw.translate(APART).split())
    run: list[bytes] = []
    for t in tokens:
        if len(t) == 1:
            run.append(t)
        elif run:
            if len(run) > 2:
                units.add(b"".join(run))
            run = []
    if len(run) > 2:
        units.add(b"".join(run))
    out = {u.decode() for u in units if len(u) > 1}
    if any(len(u) > LONGEST for u in out):
        out = {u[i : i + LONGEST] for u in out for i in range(0, max(1, len(u) - LONGEST // 2), LONGEST // 2)}
    return out


def symbols(c: np.ndarray) -> np.ndarray:
    """Numbers under 64 of the characters of units in rows, with marks at both ends."""
    c = c.astype(np.int64)
    s = np.where((c >= 97) & (c <= 122), c - 96, 29 + (c * 2654435761 >> 7) % 35)
    ends = np.full((len(c), 1), 27)
    return np.hstack([ends, s, ends + 1])


def subsequences(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all subsequences of the units in rows, and the weights of the columns."""
    s = symbols(c)
    n = s.shape[1]
    codes, weights = [], []
    for a, b, w in SHAPES:
        if b < n:
            codes.append(s[:, : n - b] * 4096 + s[:, a : n - b + a] * 64 + s[:, b:])
            weights += [w] * (n - b)
    if not codes:
        return np.zeros((len(c), 0), np.int64), np.zeros(0)
    return np.hstack(codes), np.array(weights)


def norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Lengths of the units' feature vectors: weights of equal codes add up first."""
    order = np.argsort(codes, axis=1, kind="stable")
    k, w = np.take_along_axis(codes, order, 1), weights[order]
    n, m = k.shape
    first = np.ones((n, m), bool)
    first[:, 1:] = k[:, 1:] != k[:, :-1]
    group = np.cumsum(first.ravel()) - 1
    total = np.bincount(group, w.ravel())
    return np.sqrt(np.bincount(np.repeat(np.arange(n), first.sum(1)), total**2, n))


def features(units: list[str], columns: np.ndarray) -> np.ndarray:
    """Unit-length feature vectors, on the given subsequences only. columns: each code's place, or -1."""
    width = int(columns.max()) + 1
    out = np.zeros((len(units), width), np.float32)
    for at, c in by_length(units, LONGEST):
        codes, w = subsequences(c)
        if codes.shape[1]:
            col = columns[codes]
            row = np.broadcast_to(at[:, None], col.shape)
            ok = col >= 0
            np.add.at(out, (row[ok], col[ok]), np.broadcast_to(w / norms(codes, w)[:, None], col.shape)[ok])
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton steps; the last coefficient is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    active = None
    for _ in range(rounds):
        now = y * (x @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        a, s = x[active], weight[active][:, None]
        w = np.linalg.solve(a.T @ (a * s) + keep, a.T @ (s[:, 0] * y[active]))
    return w


def logistic(v: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of class 1, for smoothed targets, so that separable data stay finite."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([v, np.ones_like(v)], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (t - p)) - 1e-3 * b)
        b = b + np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


class Landmarks:
    """Kernels of units and texts with fixed units."""

    def __init__(self, units: list[str]):
        self.units = units
        #: Landmarks in lots of like ones: places, each subsequence's row in `marks`, its weight in each landmark, its largest.
        self.lots: list[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]] = []
        order = sorted(range(len(units)), key=units.__getitem__)
        for lo in range(0, len(order), LOT):
            places = order[lo : lo + LOT]
            own = [units[i] for i in places]
            columns = np.full(SIZE, -1, np.int32)
            codes = np.unique(np.concatenate([np.unique(subsequences(c)[0]) for _, c in by_length(own, LONGEST)]))
            columns[codes] = np.arange(len(codes))
            marks = np.vstack([features(own, columns).T, np.zeros((1, len(own)), np.float32)])
            columns[columns < 0] = len(codes)
            self.lots.append((places, columns, marks, marks.max(1)[columns]))
        self.top = np.max([top for *_, top in self.lots], axis=0)

    def near(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the units that are FLOOR or more alike to a landmark, and a row for each: its kernel with every landmark, less FLOOR."""
        places, rows = [], []
        for at, c in by_length(units, LONGEST):
            codes, w = subsequences(c)
            if not codes.shape[1]:
                continue
            w = w.astype(np.float32)
            # A vector is at least as long as if no subsequence came twice.
            least = (FLOOR - 1e-4) * math.sqrt((w**2).sum())
            high = np.flatnonzero(self.top[codes] @ w >= least)
            if not len(high):
                continue
            codes = codes[high]
            k = np.zeros((len(high), len(self.units)), np.float32)
            for own, columns, marks, top in self.lots:
                ok = np.flatnonzero(top[codes] @ w >= least)
                if len(ok):
                    col, dot = columns[codes[ok]], np.zeros((len(ok), len(own)), np.float32)
                    for j, v in enumerate(w):
                        dot += v * marks[col[:, j]]
                    k[np.ix_(ok, own)] = dot
            ok = np.flatnonzero(k.max(1) >= least)
            k = k[ok] / norms(codes[ok], w)[:, None].astype(np.float32)
            real = k.max(1) >= FLOOR
            places.append(at[high[ok[real]]])
            rows.append(np.maximum(k[real] - FLOOR, 0) / (1 - FLOOR))
        if not places:
            return np.zeros(0, np.int64), np.zeros((0, len(self.units)), np.float32)
        return np.concatenate(places), np.concatenate(rows)


@dataclass
class Model:
    #: None if there was one class only; then the weight of each landmark, the offset, the slope and offset of the probability.
    landmarks: Landmarks | None
    weights: np.ndarray | None = None
    offset: float = 0.0
    slope: float = 0.0
    shift: float = 0.0

    def probability(self, v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * v + self.shift, -50, 50)))

    def scorer(self):
        #: Of the units seen, those that are near a landmark.
        seen: set[str] = set()
        known: dict[str, float] = {}

        def score(texts: list[str | None]) -> np.ndarray:
            if self.landmarks is None:
                return np.zeros(len(texts))
            if len(seen) > KEPT:
                seen.clear()
                known.clear()
            each = [units_of(t) if t else set() for t in texts]
            if new := list(set().union(*each) - seen):
                at, rows = self.landmarks.near(new)
                known.update(zip((new[i] for i in at), (rows @ self.weights + self.offset).tolist()))
                seen.update(new)
            return self.probability(np.array([max((known[u] for u in d & known.keys()), default=self.offset) for d in each]))

        return score


def copies_weight(docs: list[set[str]]) -> np.ndarray:
    """1 / size of the group of near copies that each text is in: those whose rare units share the least two hashes.

    Texts without rare units are copies if they are equal.
    """
    seen = Counter(u for d in docs for u in d)
    rare = [[u for u in d if seen[u] <= max(2, len(docs) // 20)] for d in docs]
    keys = [tuple(heapq.nsmallest(2, (zlib.crc32(u.encode()) for u in r))) if r else tuple(sorted(d)) for r, d in zip(rare, docs)]
    size = Counter(keys)
    return np.array([1 / size[k] for k in keys])


def above(kernel: float) -> float:
    """A kernel as Landmarks.near gives it."""
    return (kernel - FLOOR) / (1 - FLOOR) - 1e-6


def found_landmarks(docs: list[set[str]], y: np.ndarray, near: float, same: float) -> tuple[list[str], list[str]]:
    """Units that cover the toxic texts, and the clean units nearest to them."""
    outside = Counter(u for d, t in zip(docs, y) if not t for u in d)
    clean, n_out = sorted(outside), int((1 - y).sum())
    toxic = [d for d, t in zip(docs, y) if t]
    weight, against = copies_weight(toxic), copies_weight([d for d, t in zip(docs, y) if not t])
    holders: dict[str, list[int]] = {}
    for i, d in enumerate(d for d, t in zip(docs, y) if not t):
        for u in d:
            holders.setdefault(u, []).append(i)
    times, picked = np.zeros(len(toxic)), []
    nearest = np.zeros(len(clean), np.float32)
    while True:
        left = [i for i in range(len(toxic)) if times[i] < COVER]
        inside = Counter(u for i in left for u in toxic[i] if len(u) > 2)
        value = {u: n * math.log((n + 0.5) / len(left) * n_out / (outside[u] + 0.5)) for u, n in inside.items()}
        chosen = sorted((u for u in value if u not in picked), key=lambda u: (-value[u], u))[:CANDIDATES]
        if not chosen:
            break
        marks = Landmarks(chosen)
        at, like = marks.near(clean)
        own, k = marks.near(chosen)
        gram = np.zeros((len(chosen),) * 2, np.float32)
        gram[own] = k
        place = {u: i for i, u in enumerate(chosen)}
        holds = np.zeros((len(toxic), len(chosen)), bool)
        for i in left:
            for u in toxic[i] & place.keys():
                holds[i] |= gram[place[u]] >= above(near)
        wrong = np.zeros(len(chosen))
        for j in range(len(chosen)):
            texts = {i for c in at[like[:, j] >= above(same)] for i in holders[clean[c]]}
            wrong[j] = against[list(texts)].sum()
        before, mine = len(picked), []
        while True:
            gain = (weight * (times < COVER)) @ holds - 3.0 * wrong
            gain[mine] = -1
            k = int(np.argmax(gain))
            if gain[k] < 2 - 1e-6:
                break
            mine.append(k)
            picked.append(chosen[k])
            times += holds[:, k]
            nearest[at] = np.maximum(nearest[at], like[:, k])
        if len(picked) == before:
            if not picked:
                picked = [chosen[0]]
                nearest[at] = like[:, 0]
            break
    order = np.argsort(-nearest, kind="stable")[: len(picked)]
    return picked, [clean[i] for i in order if nearest[i] > 0 and clean[i] not in picked]


def fit(texts: list[str], toxic: list[int], clean_weight: float = 1.0, near: float = 0.6, same: float = 0.8) -> Model:
    """clean_weight: how many clean texts of the corpus each clean text of the sample stands for.

    Units at `near` or more stand for each other; a clean unit at `same` or more speaks against a landmark.
    """
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        return Model(None)
    docs = [units_of(t or "") for t in texts]
    if not any(d for d, t in zip(docs, y) if t):
        return Model(None)
    bad, clean = found_landmarks(docs, y, near, same)
    marks = Landmarks(bad + clean)
    own, k = marks.near(marks.units)
    gram = np.zeros((len(marks.units),) * 2)
    gram[own] = k
    size, axes = np.linalg.eigh((gram + gram.T) / 2)
    root = axes / np.sqrt(np.maximum(size, 1e-3))

    every = sorted(set().union(*docs))
    at, rows = marks.near(every)
    place = {every[i]: j for j, i in enumerate(at)}
    bags = [sorted(place[u] for u in d & place.keys()) for d in docs]
    x = np.vstack([rows @ root, np.zeros((1, len(marks.units)))])  # the last row: a text with no unit near a landmark
    lone = [len(x) - 1]
    spoken = rows[:, : len(bad)].max(1) if len(rows) else np.zeros(0)
    witness = np.array([max(b, key=lambda j: (spoken[j], -j)) for b, t in zip(bags, y) if t and b])
    if not len(witness):
        return Model(None)
    quiet = Counter(j for b, t in zip(bags, y) if not t for j in b or lone)
    negative = np.array(sorted(quiet))
    share = np.array([quiet[j] for j in negative], float)
    for _ in range(ROUNDS):
        use = np.concatenate([witness, negative])
        sign = np.concatenate([np.ones(len(witness)), -np.ones(len(negative))])
        weight = np.concatenate([np.full(len(witness), 0.5 / len(witness)), 0.5 * share / share.sum()]) * len(docs)
        w = svm(x[use], sign, weight)
        value = x @ w[:-1] + w[-1]
        new = np.array([max(b, key=lambda j: (value[j], -j)) for b, t in zip(bags, y) if t and b])
        if (new == witness).all():
            break
        witness = new
    model = Model(marks, root @ w[:-1], float(w[-1]))
    v = np.array([value[b or lone].max() for b in bags])
    model.slope, model.shift = logistic(v, y, np.where(y == 1, 1.0, clean_weight))
    return model


def learn(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 1200, class_bytes: int = 16 << 20) -> Model:
    """Fitted on labelled texts for which train (a column of doc_id) is true.

    Of each class the first per_class in the order of a hash of their ids teach, as far as their texts have class_bytes together.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {t: n for t, n in marks.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model(None)
    ids = None
    for t in (0, 1):
        part = marks.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.union(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    upto = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).filter(F.col("upto") <= class_bytes).select("text", "toxic").orderBy("toxic", "upto").collect()
    weight = sizes[0] / min(sizes[0], per_class) / (sizes[1] / min(sizes[1], per_class))
    return fit([r[0] for r in rows], [r[1] for r in rows], max(1.0, weight))


def scorer(model: Model):
    """A column function of a text: the probability that it is toxic."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for x in texts:
            yield pd.Series(np.concatenate([of(list(x.iloc[i : i + 500])) for i in range(0, len(x), 500)] or [np.zeros(0)]), dtype=float)

    return score


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted. Rows that are held out teach nothing."""
    out = held_out(F.col("doc_id"))
    of = scorer(learn(docs, labels, ~out))
    x = small_batches(docs).select("doc_id", out.alias("held_out"), of(F.col("text")).alias("score"))
    return x.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under 0.5 after learning from all labels."""
    of = scorer(learn(docs, labels, F.lit(True)))
    return small_batches(docs).filter(of(F.col("text")) < 0.5)
