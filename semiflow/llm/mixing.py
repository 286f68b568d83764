"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket. The bucket in which a source's budget runs out is found from running
sums, and only that bucket is summed again by finer buckets, until a bucket is one hash value. A row is then taken by
comparing its hash with its source's threshold: nothing is sorted, and reruns agree.

Null texts have size 0, and texts may have any length; null sources form one group, ordered last; rows with one id share
a hash and are taken or left together, and so do rows with a null id and equal texts; an empty table gives an empty
result. Columns of the input may have any name: those that the operator adds are named apart from them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semiflow.llm.common import cut, free_name, small_side

#: Bits of the hash that each round of histograms resolves.
LEVELS = (12, 10, 10)
BITS = sum(LEVELS)


def size_of(text: Column) -> Column:
    """Words: runs of other characters than blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(key: Column, text: Column) -> Column:
    """A hash of the key, or of the text where the key is null: rows without a key would else be taken or left all together."""
    known = F.coalesce(key.cast("string"), F.concat(F.lit("?"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(known.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """sizes (source, source_size) with target: a share of the whole by weight, at most cap times a source's size.

    share is a fraction, numerator and denominator, of all sizes. What a capped source can't take goes to the others by
    weight. Sources are ordered by code point, null last; the i-th has the weight i modulo their number.
    The table has a row for each source.
    """
    num, den = share
    order = Window.orderBy(F.col("source").isNull(), "source")
    x = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wide = lambda c: c.cast("decimal(38,0)")
    x = x.select(
        "*",
        F.sum("source_size").over(every).alias("all"),
        (F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("source_size")).alias("before"),
        F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
    )
    full = wide(F.col("source_size") * (cap * den)) * F.col("left") <= wide(F.col("all") * num - F.col("before") * (cap * den)) * F.col("w")
    x = x.withColumn("full", full)
    x = x.select(
        "source", "source_size", "w", "full",
        (F.col("all") * num - F.sum(F.when(F.col("full"), F.col("source_size") * (cap * den)).otherwise(0)).over(every)).alias("rest"),
        F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every).alias("wide"),
    )
    share_of = F.col("w").cast("double") * F.col("rest").cast("double") / (F.lit(float(den)) * F.col("wide"))
    return x.select("source", "source_size", F.when(F.col("full"), F.col("source_size") * float(cap)).otherwise(share_of).alias("target"))


@dataclass
class Mix:
    """rules: source, source_size, target, whole (times that each row is taken), threshold (hashes below are taken once more)."""

    rules: DataFrame

    def apply(self, rows: DataFrame, hash_: Column, size: Column, source: str = "source") -> tuple[DataFrame, str]:
        """rows with four more columns, and the prefix of their names: size, source_size, target and copies follow it."""
        tag = free_name(rows)
        rules = self.rules.select(*[F.col(c).alias(f"{tag}{c}") for c in self.rules.columns])
        x = rows.withColumns({f"{tag}h": hash_, f"{tag}size": size}).join(rules, F.col(source).eqNullSafe(F.col(f"{tag}source")))
        took = F.col(f"{tag}whole") + F.when(F.col(f"{tag}h") < F.col(f"{tag}threshold"), 1).otherwise(0)
        return x.select(*rows.columns, *[f"{tag}{c}" for c in ("size", "source_size", "target")], took.cast("long").alias(f"{tag}copies")), tag


def plan(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2) -> Mix:
    """The rules for rows (source, n, h); n is a row's size, h its hash."""
    sums = rows.groupBy("source").agg(F.sum("n").alias("source_size"))
    rules = cut(targets(sums, weights, share, cap), "targets")
    rules = rules.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap - 1))).otherwise(0).cast("int"))
    rules = rules.withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    #: prefix: the bits known of the hash at which the goal is met; done: the size below it.
    state, shift = rules.select("source", "goal", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("done")), BITS
    for bits in LEVELS:
        known = small_side(cut(state.withColumnRenamed("source", "s"), "mix-state"))
        inside = rows.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift) == F.col("prefix")))
        shift -= bits
        bucket = inside.groupBy("source", "goal", "prefix", "done", F.shiftright("h", shift).alias("b")).agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        ran = bucket.withColumn("upto", F.col("done") + F.sum("n").over(upto))
        over = ran.filter(F.col("upto") > F.col("goal")).groupBy("source", "goal").agg(F.min(F.struct("b", "upto", "n")).alias("x"))
        state = over.select("source", "goal", F.col("x.b").alias("prefix"), (F.col("x.upto") - F.col("x.n")).alias("done"), F.col("x.upto").alias("upto"))
    near = F.col("upto") - F.col("goal") < F.col("goal") - F.col("done")
    ends = state.select(F.col("source").alias("s"), (F.col("prefix") + near.cast("long")).alias("t"))
    out = rules.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    out = out.select("source", "source_size", "target", "whole", F.coalesce("t", F.lit(1 << BITS)).alias("threshold"))
    return Mix(small_side(cut(out, "mix-rules")))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("n"), hash_of(F.col("doc_id"), F.col("text")).alias("h"))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """A row for each document: its size, its source's size and target, and the words of it that the mix takes."""
    rows = cut(sized(docs), "mix-sizes")
    x, tag = plan(rows, weights).apply(rows, F.col("h"), F.col("n"))
    size, copies = F.col(f"{tag}size"), F.col(f"{tag}copies")
    return x.select("doc_id", size.alias("size"), F.col(f"{tag}source_size").alias("source_size"), F.col(f"{tag}target").alias("target"), (copies * size).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """The documents that the mix takes, with `copies`, the times that each is taken.

    A column of that name is kept as copies_in (with more _in, where that is taken too).
    """
    rows = cut(sized(docs), "mix-sizes")
    x, tag = plan(rows, weights).apply(docs, hash_of(F.col("doc_id"), F.col("text")), size_of(F.col("text")))
    kept = "copies"
    while kept in docs.columns:
        kept += "_in"
    copies = F.col(f"{tag}copies")
    return x.filter(copies > 0).select(*[F.col(c).alias(kept if c == "copies" else c) for c in docs.columns], copies.alias("copies"))
