"""Approximate nearest neighbours by learned partitions.

A graph joins each vector of a bounded sample with its nearest; it is split into balanced parts by moving vertices to
the part of most of their neighbours while there is room; a softmax classifier learns each vector's part. It then puts
every vector of the table into its most probable part, and sends a query to its several most probable parts, whose
vectors are compared with it exactly: the most probable one first, whose k-th score bounds what the others need to give.
How many parts a query visits is set on the sample, by recall against brute force. Tables of any size are searched so:
n vectors make sqrt(n) / 2 parts, as far as the sample has PER_PART vectors for each. Parts are packed into bins, which
tasks compare with the queries that visit any of their parts, each with the parts that it visits.

Nearness is the inner product, in double precision, added up from the first component to the last; ties go to the
smaller vec_id. Vectors that are null, zero, or hold null or non-finite components take no part. Inner products need
equal lengths: vectors of another length than most are searched among their own, with an index for each length. Rows
with a query's own vec_id are not its candidates; repeated rows count each as candidates and once as a query (the least
vector, if they differ); rows with a null vec_id take no part. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semiflow.llm.common import cut, id_fraction, small_batches

#: Vectors of the sample for each part, the sample's size, and the recall on it for which visits are set.
PER_PART, SAMPLE, GOAL = 40, 16_000, 0.94
#: Candidates and queries that one task compares.
BLOCK, QUERIES = 6_000, 2_000


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k largest inner products of each row with other rows."""
    out = np.zeros((len(x), k), np.int64)
    for lo in range(0, len(x), 256):
        s = x[lo : lo + 256] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + 256] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 7, rounds: int = 15, slack: float = 1.1) -> np.ndarray:
    """A part for each vertex; none has more than slack times the mean."""
    rng = np.random.default_rng(seed)
    n, room = len(x), int(np.ceil(slack * len(x) / parts - 1e-9))
    centre = x[rng.choice(n, parts, replace=False)]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    part = np.zeros(n, np.int64)

    def fill(gain: np.ndarray) -> np.ndarray:
        """Vertices with most to lose choose first; a full part sends them to the next best."""
        best = np.sort(gain, axis=1)
        order = np.argsort(-(best[:, -1] - (best[:, -2] if gain.shape[1] > 1 else 0)), kind="stable")
        count, got, wish = np.zeros(parts, int), np.zeros(n, np.int64), np.argsort(-gain, axis=1, kind="stable")
        for v in order:
            for p in wish[v]:
                if count[p] < room:
                    got[v] = p
                    count[p] += 1
                    break
        return got

    for _ in range(8):
        c = centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        part = fill(unit @ c.T)
        centre = np.stack([x[part == p].mean(0) if (part == p).any() else centre[p] for p in range(parts)])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        for j in range(graph.shape[1]):
            np.add.at(votes, (np.arange(n), part[graph[:, j]]), 1)
            np.add.at(votes, (graph[:, j], part), 1)
        votes[np.arange(n), part] += 0.5
        new = fill(votes)
        if (new == part).mean() > 0.995:
            break
        part = new
    return part


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Router:
    weights: np.ndarray
    probes: int
    scale: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x * self.scale
        return np.hstack([x, np.ones((len(x), 1))]) @ self.weights

    def part(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(self.logits(x), axis=1)

    def route(self, x: np.ndarray) -> np.ndarray:
        """All parts, most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def train(x: np.ndarray, parts: int, k: int = 20, goal: float = GOAL, steps: int = 300) -> Router:
    dim = x.shape[1]
    scale = 1 / max(1e-12, float(np.sqrt((x**2).mean())))
    if parts < 2:
        return Router(np.zeros((dim + 1, 1)), 1, scale)
    label = balanced_parts(x, neighbour_graph(x, min(10, len(x) - 1)), parts)
    z = np.hstack([x * scale, np.ones((len(x), 1))])
    w, m, v, hot = np.zeros((dim + 1, parts)), 0.0, 0.0, np.eye(parts)[label]
    for i in range(1, steps + 1):
        g = z.T @ (softmax(z @ w) - hot) / len(z) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    router = Router(w, parts, scale)
    own, test = router.part(x), np.arange(0, len(x), max(1, len(x) // 400))
    s = x[test] @ x.T
    s[np.arange(len(test)), test] = -np.inf
    true = own[np.argpartition(-s, k - 1, axis=1)[:, :k]]
    order = router.route(x[test])
    rank = np.argsort(order, axis=1)
    at = np.take_along_axis(rank, true, 1)
    for probes in range(1, parts + 1):
        if (at < probes).mean() >= goal:
            break
    router.probes = probes
    return router


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.select("vec_id", e.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & e.isNotNull()).filter(~bad & F.exists(e, lambda v: v != 0))


def nearest(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int, bound: np.ndarray) -> list[tuple[int, int, float]]:
    """(query, candidate, score) of each query's k nearest among the candidates, without those below its bound."""
    out = []
    ct = np.ascontiguousarray(c.T)
    for lo in range(0, len(q), 256):
        s = np.zeros((len(q[lo : lo + 256]), len(c)))
        for d in range(len(ct)):
            s += q[lo : lo + 256, d, None] * ct[d]
        s[q_id[lo : lo + 256, None] == c_id[None, :]] = -np.inf
        least = bound[lo : lo + 256].copy()
        if s.shape[1] > k:
            least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
        row, col = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        score = s[row, col]
        order = np.lexsort((c_id[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, np.arange(len(s)))
        ok = np.arange(len(row)) - first[row] < k
        out += zip(q_id[lo + row[ok]].tolist(), c_id[col[ok]].tolist(), score[ok].tolist())
    return out


def packed(sizes: dict[int, int]) -> dict[int, int]:
    """A bin for each part: parts in order, as many as together have BLOCK vectors at most."""
    out, at, n = {}, 0, 0
    for p in sorted(sizes):
        if n and n + sizes[p] > BLOCK:
            at, n = at + 1, 0
        out[p] = at
        n += sizes[p]
    return out


def search(rows: DataFrame, k: int = 20, every: int = 20, sample: int = SAMPLE) -> DataFrame:
    """The k nearest found of each query (a row whose vec_id is divisible by `every`): query_id, rank, vec_id, score.

    The index of each length is fitted on about `sample` vectors, chosen by a hash of their id, and holds every vector.
    """
    vectors = usable(rows)
    out = None
    for length, n in vectors.groupBy(F.size("embedding").alias("n")).agg(F.count("*")).orderBy("n").collect():
        part = search_length(vectors.filter(F.size("embedding") == length), n, k, every, sample)
        out = part if out is None else out.union(part)
    return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def search_length(vectors: DataFrame, n: int, k: int, every: int, sample: int) -> DataFrame:
    """search() over n vectors of one length."""
    small_batches(vectors)
    chosen = vectors.filter(id_fraction(F.col("vec_id")) < sample / n).limit(2 * sample).select("embedding")
    x = np.array([r[0] for r in chosen.collect()] or [vectors.first()[1]])
    router = train(x, max(1, min(round(n**0.5 / 2), len(x) // PER_PART)), k)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(part=router.part(np.stack(b.embedding.to_numpy())).astype(np.int32))

    index = cut(vectors.mapInPandas(put, "vec_id long, embedding array<double>, part int"), "ann-index")
    # One row for each part, of which there are at most sample / PER_PART.
    sizes = dict(index.groupBy("part").agg(F.count("*")).collect())
    asked = index.filter(F.col("vec_id") % every == 0).select("vec_id").distinct().count()
    bins = packed(sizes)
    full: dict[int, int] = {}
    for p, b in bins.items():
        full[b] = full.get(b, 0) + sizes[p]
    # A bin of one large part is split; lots of queries go to copies of a bin.
    splits = {b: c // BLOCK + 1 for b, c in full.items()}
    #: At first a query visits one bin, and then the bins of the further parts.
    lots = {b: asked * c // n // QUERIES + 1 for b, c in full.items()}, dict.fromkeys(full, asked // QUERIES + 1)

    def sender(turn: int):
        """Sends queries to their most probable part (turn 0), or to the others that they visit (turn 1)."""

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                out = []
                for i, e, least, order in zip(b.vec_id, b.embedding, b.bound, router.route(np.stack(b.embedding.to_numpy()))):
                    seen = got = 0
                    visits: dict[int, list[int]] = {}
                    for p in order.tolist():
                        if p in sizes:
                            if turn == (got > k):
                                visits.setdefault(bins[p], []).append(p)
                            seen, got = seen + 1, got + sizes[p]
                            if got > k and (seen >= router.probes or not turn):
                                break
                    for c, parts in visits.items():
                        out += [(i, e, least, parts, c, s, i // every % lots[turn][c]) for s in range(splits[c])]
                yield pd.DataFrame(out, columns=["vec_id", "embedding", "bound", "parts", "bin", "block", "lot"])

        return send

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(q) and len(c):
            ids, vecs, bound = q.vec_id.to_numpy(), np.stack(q.embedding.to_numpy()), q.bound.to_numpy()
            c = c.sort_values("part", kind="stable")
            cids, cvecs, parts = c.vec_id.to_numpy(), np.stack(c.embedding.to_numpy()), c.part.to_numpy()
            visits = np.repeat(np.arange(len(q)), q.parts.map(len).to_numpy())
            wanted = np.concatenate(q.parts.to_list())
            for p in np.unique(parts):
                own = visits[wanted == p]
                lo, hi = np.searchsorted(parts, p), np.searchsorted(parts, p, "right")
                if len(own):
                    got += nearest(ids[own], vecs[own], cids[lo:hi], cvecs[lo:hi], k, bound[own])
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    def of(values: dict[int, int], key: str):
        return F.element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), F.col(key))

    def found(queries: DataFrame, turn: int) -> DataFrame:
        sent = queries.mapInPandas(sender(turn), "vec_id long, embedding array<double>, bound double, parts array<int>, bin int, block int, lot int")
        cands = index.withColumn("bin", of(bins, "part"))
        cands = cands.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), of(splits, "bin").cast("long")).cast("int"))
        cands = cands.withColumn("lot", F.explode(F.sequence(F.lit(0), of(lots[turn], "bin") - 1)))
        keys = ("bin", "block", "lot")
        return sent.groupBy(*keys).cogroup(cands.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")

    def best(x: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return x.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    queries = index.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    first = best(found(queries.withColumn("bound", F.lit(float("-inf"))), 0))
    if len(sizes) < 2:
        return first
    # A query's k-th score in its first part bounds its k nearest: further parts only give what reaches it.
    first = cut(first, "ann-first")
    bounds = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    more = found(queries.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))), 1)
    return best(first.drop("rank").union(more))
