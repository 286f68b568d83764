"""Views on Structured Streaming, kept by foreachBatch.

A micro-batch is a delta: weighted rows (_w), and for a query that joins two inputs a column _side, "l" or "r", that
tells which one a row belongs to (both_sides() makes such a stream of two). Batches' deltas and changes are written under
their number, so that a batch that comes again after a failure overwrites what it wrote; a join's state is its inputs'
written deltas, of which a batch writes its own, and every COMPACT batches they are consolidated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from semiflow.scratch import folder, scratch
from semiflow.streaming import zset
from semiflow.streaming.incremental import COMPACT, NotIncremental, Query, running


def deltas(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of weighted rows from parquet files: all new ones at a time, or so many, oldest first."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def fed(parts: Iterable[DataFrame]) -> tuple[DataFrame, Iterator[None]]:
    """A stream of files, and what feeds it: each step appends the next part, which becomes a micro-batch of its own."""
    parts = list(parts)
    src = folder(parts[0].sparkSession, "stream-in")

    def feed() -> Iterator[None]:
        for p in parts:
            p.write.mode("append").parquet(src)
            yield

    return deltas(parts[0].sparkSession, src, parts[0].schema), feed()


def endless(spark: SparkSession, rows_per_batch: int = 1000) -> DataFrame:
    """The natural numbers, for ever: (value, timestamp)."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", 2).load()


def both_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """One stream of two inputs without common columns but _w: each row has the other's columns null."""
    l, r = left.withColumn("_side", F.lit("l")), right.withColumn("_side", F.lit("r"))
    return l.unionByName(r, allowMissingColumns=True)


def drained(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, feed: Iterable[None] = (None,), mode: str = "append") -> None:
    """Gives each micro-batch to `batch`, until the stream's present end; again after each step of `feed`, from where it stopped."""
    for _ in feed:
        stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def take(stream: DataFrame, n: int, by: str = "value") -> DataFrame:
    """A window of an endless stream: its rows with by < n, once the stream has come so far. by grows along the stream."""
    spark = stream.sparkSession
    out, seen = scratch(spark, "window"), []

    def batch(df: DataFrame, i: int) -> None:
        df.filter(F.col(by) < n).write.mode("overwrite").parquet(f"{out}/batch={i}")
        top = df.agg(F.max(by)).first()[0]
        seen.append(top is not None and top >= n - 1)

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", scratch(spark, "window-state")).start()
    try:
        while not any(seen):
            if q.awaitTermination(0.2):
                raise RuntimeError(f"the stream ended before {n}")
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(*[f"{out}/batch={i}" for i in range(seen.index(True) + 1)])


@dataclass
class Deltas:
    """An input's written deltas, by batch, under a path; consolidated ones lie under the number of the last of them."""

    path: str
    schema: StructType

    def write(self, df: DataFrame, n: int) -> DataFrame:
        at = f"{self.path}/batch={n}"
        df.write.mode("overwrite").parquet(at)
        return df.sparkSession.read.schema(self.schema).parquet(at)

    def before(self, spark: SparkSession, n: int) -> DataFrame:
        """All rows of batches under n; after every COMPACT of them they are one table."""
        base = n // COMPACT * COMPACT
        paths = [f"{self.path}/batch={i}" for i in range(base, n)] + ([f"{self.path}-upto/batch={base}"] if base else [])
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def compact(self, spark: SparkSession, n: int) -> None:
        """Batch n has been written: consolidates all so far, if it is the last of COMPACT."""
        if (n + 1) % COMPACT == 0:
            base = n + 1 - COMPACT
            paths = [f"{self.path}/batch={i}" for i in range(base, n + 1)] + ([f"{self.path}-upto/batch={base}"] if base else [])
            zset.consolidate(spark.read.schema(self.schema).parquet(*paths)).write.mode("overwrite").parquet(f"{self.path}-upto/batch={n + 1}")


def sides(stream: DataFrame, join: tuple[Column, Column], left: list[str], right: list[str]) -> Callable[[DataFrame, int], DataFrame]:
    """A function of a micro-batch and its number: the change of the join of the two inputs, whose columns are given."""
    spark = stream.sparkSession
    kinds = {f.name: f for f in stream.schema.fields}
    l, r = (Deltas(scratch(spark, f"join-{s}"), StructType([kinds[c] for c in (*own, zset.W)])) for s, own in (("l", left), ("r", right)))
    a, b = join

    def change(df: DataFrame, n: int) -> DataFrame:
        dl = l.write(df.filter("_side = 'l'").select(*left, zset.W), n)
        dr = r.write(df.filter("_side = 'r'").select(*right, zset.W), n)
        new = zset.join(dl, r.before(spark, n), a, b).unionByName(zset.join(l.before(spark, n), dr, a, b)).unionByName(zset.join(dl, dr, a, b))
        for side in (l, r):
            side.compact(spark, n)
        return zset.consolidate(new)

    return change


def fan_out(stream: DataFrame, branches: dict[str, list[tuple]], join: tuple[Column, Column] | None = None, left: list[str] = (), right: list[str] = (), feed: Iterable[None] = (None,)) -> DataFrame:
    """(branch, step, value): the running value of each branch after each micro-batch. A branch is a list of stages that ends in a sum or count.

    The input, or the join of the two sides, is computed once for each batch and feeds all branches.
    """
    spark = stream.sparkSession
    queries = {name: Query(stages) for name, stages in branches.items()}
    if any(not q.folds for q in queries.values()):
        raise NotIncremental("each branch must end in a sum or count")
    if not stream.isStreaming:
        raise NotIncremental("fan_out needs a stream")
    source, out, mid = sides(stream, join, list(left), list(right)) if join else (lambda df, n: df), scratch(spark, "branches"), scratch(spark, "change")

    def batch(df: DataFrame, n: int) -> None:
        change = source(df, n)
        change.write.mode("overwrite").parquet(f"{mid}/batch={n}")
        change = spark.read.schema(change.schema).parquet(f"{mid}/batch={n}")
        rows = None
        for name, q in queries.items():
            x = q.linear(change).select(F.lit(name).alias("branch"), F.lit(n).cast("long").alias("step"), F.col("value").cast("long").alias("value"))
            rows = x if rows is None else rows.union(x)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={n}")

    drained(stream, batch, scratch(spark, "branches-state"), feed)
    return running(spark.read.parquet(out).drop("batch"), ("branch",))


def run(query: Query, stream: DataFrame, checkpoint: str, sink: Callable[[object, int], None], left: list[str] = (), right: list[str] = (), feed: Iterable[None] = (None,)) -> None:
    """Gives sink the view's change for each micro-batch, until the stream's present end.

    A query that joins needs a stream of both sides, and their columns. A sink gets a batch again after a failure, under
    the same number, and should overwrite.
    """
    if query.join is not None and ("_side" not in stream.columns or not left or not right):
        raise NotIncremental("a join needs a stream of both sides (both_sides) and the columns of each")
    source = sides(stream, query.join, list(left), list(right)) if query.join is not None else (lambda df, n: df)
    drained(stream, lambda df, n: sink(query.linear(source(df, n)), n), checkpoint, feed)


def changes(query: Query, stream: DataFrame, left: list[str] = (), right: list[str] = (), feed: Iterable[None] = (None,)) -> DataFrame:
    """The view's changes, written as a table: a column step, the micro-batch's number, and the view's own."""
    spark = stream.sparkSession
    out = scratch(spark, "changes")

    def sink(df: DataFrame, n: int) -> None:
        df.select(F.lit(n).cast("long").alias("step"), "*").write.mode("overwrite").parquet(f"{out}/batch={n}")

    run(query, stream, scratch(spark, "changes-state"), sink, left, right, feed)
    return spark.read.parquet(out).drop("batch")


def windowed(stream: DataFrame, time: str, width: str, late: str, aggs: dict[str, Column], keys: tuple[str, ...] = (), slide: str | None = None) -> DataFrame:
    """Event-time windows of a stream, or of a table; of a stream, rows later than `late` are dropped by the watermark.

    Times without a zone are taken in the session's, as watermarks need instants, and windows get them back without one.
    """
    kind = dict(stream.dtypes)[time]
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if stream.isStreaming else rows
    w = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = rows.groupBy(w.alias("w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return grouped.select(F.col("w.start").cast(kind).alias("start"), F.col("w.end").cast(kind).alias("end"), *keys, *aggs)


def latest(windows: DataFrame, keys: list[str], feed: Iterable[None] = (None,)) -> DataFrame:
    """A stream of changing groups, drained into a table: the last row of each key."""
    spark = windows.sparkSession
    out = scratch(spark, "windows")

    def batch(df: DataFrame, n: int) -> None:
        df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    drained(windows, batch, scratch(spark, "windows-state"), feed, "update")
    rest = [c for c in windows.columns if c not in keys]
    x = spark.read.parquet(out).groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r"))
    return x.select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in windows.columns])


def sessions(rows: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    """Sessions of each key: start, end and number of rows, with gaps of at least `gap` between them."""
    g = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def chosen_per_batch(stream: DataFrame, checkpoint: str, guard: Callable[[DataFrame], bool], fast: Callable, slow: Callable, sink: Callable, cutoff: int = 3) -> list[str]:
    """Runs fast on batches for which the guard holds, else slow; after `cutoff` failures slow for good. What was chosen, batch by batch."""
    chosen: list[str] = []

    def batch(df: DataFrame, n: int) -> None:
        ok = chosen.count("slow") < cutoff and guard(df)
        chosen.append("fast" if ok else "slow")
        sink((fast if ok else slow)(df), n)

    drained(stream, batch, checkpoint)
    return chosen
