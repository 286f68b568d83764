"""Near-duplicate documents by ProbMinHash over word shingles.

Shingles are five consecutive words (all words, where a text has fewer). Each distinct shingle is a Poisson process;
each arrival falls on one of the signature's components, which keeps its earliest; a shingle stops once its arrivals
come later than all components' earliest. Two signatures agree in a component with the probability Jaccard similarity of
the weighted shingles, which also verifies a link. By default each distinct shingle weighs one, which makes it the
Jaccard similarity of the sets; with by_times a shingle weighs as often as the text repeats it. Bands of components give
candidates, and a similarity (of shingles as 32-bit hashes) of 0.8 or more verifies a link. Classes are the components of
the links.

Texts with equal shingle sets are one class from the start and go on as one. In a bucket each is compared with the
bucket's leader, not with every other; then each pair of members of classes that are still apart is compared, if bounds
on their similarity allow. So every colliding pair is in one class, compared, or shown to be no link: by an exact bound,
or by signatures that agree in far too few components.

Null and empty texts, and texts without words, are classes of their own; rows with one doc_id are one document (that of the least text, if they differ); a null
doc_id has a null class; an empty table gives no rows. Texts may have any length: words are hashed in chunks, and a text
costs memory in proportion to its distinct shingles. Columns of the documents may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semiflow.llm.common import among, cut, folded_bytes, mixed, not_among, small_batches
from semiflow.scratch import forget

WORDS, LEAST, BANDS, ROWS = 5, 0.8, 30, 5
#: Standard deviations by which an estimate from signatures may fall short of `least`: a link is lost once in 3 million.
SHORT = 5.0
GOLD = np.uint64(0x9E3779B97F4A7C15)
B = 0x100000001B3
BI = pow(B, -1, 2**64)


class Powers:
    """Powers of B and of its inverse modulo 2**64, as far as texts have needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(B, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(BI, k, 2**64))])
        return self.up[:n], self.down[:n]


#: Bytes of a text whose words are hashed at once (more, if a word is longer).
CHUNK = 1 << 16


def word_hashes(s: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of the words of a folded text, in order."""
    gaps, out, lo = np.flatnonzero(s == 32), [], 0
    while lo < len(s):
        k = np.searchsorted(gaps, lo + CHUNK)
        hi = int(gaps[k]) if k < len(gaps) else len(s)
        up, down = powers.to(hi - lo + 1)
        upto = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((s[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:-1], out=upto[1:])
        cuts = gaps[np.searchsorted(gaps, lo) : k] - lo
        first, end = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [hi - lo]])
        out.append(mixed((upto[end] - upto[first]) * down[first]))
        lo = hi + 1
    return np.concatenate(out)


def shingle_hashes(text: str, powers: Powers, words: int = WORDS) -> np.ndarray:
    """Hashes of the text's shingles, in order."""
    s, _ = folded_bytes(text)
    if len(s) and s[-1] == 32:
        s = s[:-1]
    if not len(s):
        return np.zeros(0, np.uint64)
    w = word_hashes(s, powers)
    n = max(1, len(w) - words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(w))):
        out = mixed(out + GOLD) + w[i : i + n]
    return mixed(out)


def probminhash(ids: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Signatures, a row for each document; doc tells which document an element (id, weight) belongs to."""
    earliest, sig = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    alive, at, done = np.arange(len(ids)), np.zeros(len(ids)), 0
    seed = mixed(ids + GOLD)
    while len(alive):
        many = int(max(1, min(64, 30_000 // len(alive))))
        step = (np.arange(done, done + many, dtype=np.uint64) + np.uint64(1)) * GOLD
        r = mixed(seed[alive][:, None] + step[None, :])
        u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        x = at[alive][:, None] + np.cumsum(-np.log(u) / weight[alive][:, None], axis=1)
        k = ((mixed(r ^ GOLD) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        slot = (doc[alive][:, None] * m + k.astype(np.int64)).ravel()
        flat = x.ravel()
        last = earliest.reshape(docs, m).max(1)
        ok = np.flatnonzero(flat < np.repeat(last[doc[alive]], many))
        np.minimum.at(earliest, slot[ok], flat[ok])
        won = ok[earliest[slot[ok]] == flat[ok]]
        sig[slot[won]] = ids[alive[won // many]]
        at[alive] = x[:, -1]
        done += many
        last = earliest.reshape(docs, m).max(1)
        alive = alive[at[alive] < last[doc[alive]]]
    return sig.reshape(docs, m)


def sketches(texts: list[str], powers: Powers, bands: int, rows: int, by_times: bool = False) -> tuple[np.ndarray, ...]:
    """For each text with words: its place, two fingerprints of its weighted shingles, its signature in 16 bits each, band keys."""
    counted = [np.unique(shingle_hashes(t or "", powers), return_counts=True) for t in texts]
    each = [s for s, _ in counted]
    at = np.array([i for i, s in enumerate(each) if len(s)], np.int64)
    if not len(at):
        return at, at, at, np.zeros((0, bands * rows), np.int16), np.zeros((0, bands), np.int64)
    n = np.array([len(each[i]) for i in at])
    ids = np.concatenate([each[i] for i in at])
    times = np.concatenate([counted[i][1] for i in at])
    # The measure that verified() compares: weights of one, or times.
    weight = times.astype(float) if by_times else np.ones(len(ids))
    marked = mixed(ids + times.astype(np.uint64) * GOLD) if by_times else ids
    doc = np.repeat(np.arange(len(at)), n)
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    one, two = (np.add.reduceat(mixed(marked ^ np.uint64(c)), start).view(np.int64) for c in (0x1234567, 0x7654321))
    sig = probminhash(ids, weight, doc, len(at), bands * rows).reshape(len(at), bands, rows)
    key = np.zeros((len(at), bands), np.uint64)
    for r in range(rows):
        key = mixed(key + GOLD) + sig[:, :, r]
    key = mixed(key + np.arange(bands, dtype=np.uint64) * GOLD).view(np.int64)
    short = (sig.reshape(len(at), -1) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)
    return at, one, two, short, key


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, by_times: bool = False) -> DataFrame:
    """(doc_id, one, two, keys, sig) of each row; all but the first are null where a text has no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for b in batches:
            for lo in range(0, len(b), 100):
                x = b.iloc[lo : lo + 100]
                at, one, two, sig, key = sketches(list(x.text), powers, bands, rows, by_times)
                out = pd.DataFrame({"doc_id": x.doc_id.values, "one": pd.array([None] * len(x), "Int64"), "two": pd.array([None] * len(x), "Int64"), "keys": None})
                out.loc[at, "one"], out.loc[at, "two"] = one, two
                keys, sigs = np.empty(len(x), object), np.empty(len(x), object)
                keys[at], sigs[at] = list(key), list(sig)
                yield out.assign(keys=keys, sig=sigs)

    return small_batches(docs).select("doc_id", "text").mapInPandas(run, "doc_id long, one long, two long, keys array<long>, sig array<smallint>")


def shingle_sets(docs: DataFrame, by_times: bool = False) -> DataFrame:
    """(doc_id, shingles): the distinct shingles of each text as 32-bit hashes; with by_times also `times`, how often each comes."""

    def counted(t: str | None, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        return np.unique((shingle_hashes(t or "", powers) >> np.uint64(32)).astype(np.uint32), return_counts=True)

    @F.pandas_udf("array<int>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        powers = Powers()
        for x in texts:
            yield pd.Series([counted(t, powers)[0].view(np.int32) for t in x])

    @F.pandas_udf("shingles array<int>, times array<int>")
    def weighted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for x in texts:
            got = [counted(t, powers) for t in x]
            yield pd.DataFrame({"shingles": [s.view(np.int32) for s, _ in got], "times": [n.astype(np.int32) for _, n in got]})

    if by_times:
        return small_batches(docs).select("doc_id", weighted(F.col("text")).alias("s")).select("doc_id", "s.shingles", "s.times")
    return small_batches(docs).select("doc_id", of(F.col("text")).alias("shingles"))


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The sum over common elements i of 1 / (the sum over all j of max(x_j / x_i, y_j / y_i)), for the weights x and y."""
    every = np.union1d(a, b)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a)], y[np.searchsorted(every, b)] = wa, wb
    ratio = np.divide(x, y, out=np.full(len(every), np.inf), where=y > 0)
    order = np.argsort(ratio)
    x, y, ratio = x[order], y[order], ratio[order]
    # From the first j whose ratio is at least that of i on, x_j / x_i is the greater.
    above, below = np.append(np.cumsum(x[::-1])[::-1], 0), np.append(0, np.cumsum(y))
    own = np.flatnonzero((x > 0) & (y > 0))
    at = np.searchsorted(ratio, ratio[own])
    return float((1 / (above[at] / x[own] + below[at] / y[own])).sum())


def verified(pairs: DataFrame, sets: DataFrame, least: float, per_copy: int = 200) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity, or probability Jaccard where sets have times, is at least `least`. A b with many pairs is copied for each per_copy of them."""
    heavy = pairs.groupBy("b").agg((F.floor(F.count("*") / per_copy) + 1).cast("int").alias("copies"))
    right = sets.withColumnRenamed("doc_id", "b").withColumnRenamed("shingles", "sb").join(heavy, "b")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    left = pairs.join(heavy, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("copies").cast("long")).cast("int")).drop("copies")
    left = left.join(sets.withColumnRenamed("doc_id", "a").withColumnRenamed("shingles", "sa").withColumnRenamed("times", "ta"), "a")
    x = left.join(right.withColumnRenamed("times", "tb"), ["b", "salt"])
    if "times" in sets.columns:

        @F.pandas_udf("boolean")
        def alike(sa: pd.Series, ta: pd.Series, sb: pd.Series, tb: pd.Series) -> pd.Series:
            return pd.Series([probability_jaccard(*p) >= least - 1e-9 for p in zip(sa, ta, sb, tb)], dtype=bool)

        return x.filter(alike("sa", "ta", "sb", "tb")).select("a", "b")
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    x = x.filter(small >= large * least - 1e-9).withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return x.filter(F.col("both") >= F.lit(least) * (F.size("sa") + F.size("sb") - F.col("both")) - 1e-9).select("a", "b")


def packed(df: DataFrame, rows: int, name: str) -> DataFrame:
    """df, of about so many narrow rows at most, written by tasks of some 100 000 rows each, but twelve at least."""
    return cut(df.coalesce(max(12, rows // 100_000)), name)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the edges' ends; label is the least node of the component. Labels spread and jump until none changes."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    n = both.count()
    labels = packed(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), n, "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("root"))
        old = labels
        new = packed(step.join(jump, "low").select("node", F.least("low", "root").alias("label"), (F.least("low", "root") < F.col("label")).alias("moved")), n, "labels")
        forget(old)
        if new.filter("moved").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
        labels._cut_at = new._cut_at


def apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, doc_id, class) of the members of buckets that hold more than one class."""
    x = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", F.coalesce("label", "doc_id").alias("class"))
    mixed_ = x.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("band")
    return x.join(mixed_, "band")


def rivals(left: DataFrame, sets: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of members of one bucket but different classes that may be as alike as `least`; left is from apart().

    A shingle that no member of another class has is in no intersection. With s and t shingles, of which c and d occur
    in other classes, two texts are as alike as m / (s + t - m) at most, where m is the lesser of c and d: pairs below
    the bound are left out, and no link is lost. So are pairs whose signatures agree in too few components, SHORT
    standard deviations fewer than those of a pair at `least` do.
    """
    many = F.size("a.sig")
    agree = F.size(F.filter(F.zip_with("a.sig", "b.sig", lambda x, y: x == y), lambda e: e))
    alike = agree >= many * least - SHORT * F.sqrt(many * least * (1 - least))
    # Once for each pair: in the first of the bands that both are in.
    once = F.col("a.band") == F.array_min(F.array_intersect("a.keys", "b.keys"))
    marks = among(sigs.select("doc_id", "keys", "sig"), cut(left.select("doc_id").distinct(), "ids"), "doc_id")
    if "times" in sets.columns:  # the bound is one on sets
        x = cut(left.join(marks, "doc_id"), "rivals")
        a, b = x.alias("a"), x.alias("b")
        pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.class") < F.col("b.class")) & alike & once)
        return pairs.select(F.greatest("a.doc_id", "b.doc_id").alias("a"), F.least("a.doc_id", "b.doc_id").alias("b"))
    own = sets.join(left.select("doc_id", "class").distinct(), "doc_id")
    each = own.select("doc_id", "class", F.explode("shingles").alias("s"))
    common = each.groupBy("s").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("s")
    shared = each.join(common, "s").groupBy("doc_id").agg(F.count("*").alias("shared"))
    size = own.select("doc_id", F.size("shingles").alias("n")).join(shared, "doc_id")
    x = cut(left.join(size.filter(F.col("shared") >= F.col("n") * least - 1e-9).join(marks, "doc_id"), "doc_id"), "rivals")
    a, b = x.alias("a"), x.alias("b")
    m = F.least("a.shared", "b.shared")
    near = m * (1 + least) >= (F.col("a.n") + F.col("b.n")) * least - 1e-6
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.class") < F.col("b.class")) & near & alike & once)
    return pairs.select(F.greatest("a.doc_id", "b.doc_id").alias("a"), F.least("a.doc_id", "b.doc_id").alias("b"))


def classes(docs: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, by_times: bool = False) -> DataFrame:
    """(doc_id, class_id), a row for each doc_id (and each row with none): class_id is the least doc_id of its class."""
    docs = one_row_each(docs.select("doc_id", "text"))
    sigs = cut(signatures(docs, bands, rows, by_times), "signatures")
    known = sigs.filter(F.col("doc_id").isNotNull())
    same = cut(known.filter("one is not null").groupBy("one", "two").agg(F.min("doc_id").alias("rep")), "same")
    reps = known.select("doc_id", "keys").join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode("keys").alias("band"))
    led = reps.groupBy("band").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = cut(reps.join(led, "band"), "members")
    texts = among(docs.select("doc_id", "text"), cut(members.select("doc_id").distinct(), "ids"), "doc_id")
    sets = cut(shingle_sets(texts, by_times), "sets")

    # Each member with its bucket's first.
    pairs = members.filter("doc_id <> leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).distinct()
    n = members.count()
    labels = components(packed(verified(pairs, sets, least), n, "links"))

    # Members of classes that are still apart with each other.
    left = packed(apart(members, labels), n, "apart")
    if not left.isEmpty():
        links = packed(verified(rivals(left, sets, known, least), sets, least), n, "links")
        if not links.isEmpty():
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))
    reps_of = known.select("doc_id", "one", "two").join(same, ["one", "two"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("node"))
    out = reps_of.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("class_id"))
    return out.union(sigs.filter(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id")))


def one_row_each(docs: DataFrame) -> DataFrame:
    """docs with one row for each doc_id, that of the least text (a null is the greatest); rows without doc_id stay."""
    known = docs.filter(F.col("doc_id").isNotNull())
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs
    least = F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNull(), "text")).alias("row")
    kept = cut(known.groupBy(F.col("doc_id").alias("id")).agg(least).select("row.*"), "one-row-each")
    return kept.union(docs.filter(F.col("doc_id").isNull()))


def deduplicated(docs: DataFrame, least: float = LEAST, by_times: bool = False) -> DataFrame:
    """One document of each class, the one with the least doc_id; rows without doc_id stay. Of rows with one doc_id that of the least text stays."""
    docs = one_row_each(docs)
    found = cut(classes(docs, least, by_times=by_times), "classes")
    drop = cut(found.filter("class_id <> doc_id").select("doc_id"), "copies")
    return not_among(docs, drop, "doc_id")
