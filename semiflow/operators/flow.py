"""Pipelines over a DataFrame in the manner of list verbs.

A Flow is a DataFrame and, where its rows have an order, the columns that give it; they should be unique, since ties
leave the order open. Verbs that need positions number the rows in parallel (positions()); verbs on bags never do.
Predicates are two-valued: where one is null it counts as false.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semiflow.functions import monoids
from semiflow.scratch import cut

POS = "_pos"
Element = Callable[[DataFrame], Column] | Column | str


def holds(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def positions(df: DataFrame, by: tuple[str, ...], name: str = POS) -> DataFrame:
    """df with the 0-based position of each row in the order of `by`, without one task that sees all rows.

    Rows are dealt to ranges of the whole order, and rows that tie there by a hash of all their columns, so that a column
    of few values makes no large range; they are numbered within their range, and the ranges' counts give each its first
    position. The ranges are written once: dealt anew, they might differ.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in by]
    hashed = [c for c, kind in df.dtypes if not ("map<" in kind or "variant" in kind)]
    ranges = df.withColumn("__tie", F.xxhash64(*hashed) if hashed else F.lit(0).cast("long"))
    ranges = ranges.repartitionByRange(parts, *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    x = cut(ranges.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "positions")
    counts = x.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each range
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    return x.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + F.col("__at")).cast("long")).drop("__part", "__at", "__start")


@dataclass(frozen=True)
class Flow:
    df: DataFrame
    by: tuple[str, ...] = ()
    #: Whether the order is given by 0-based positions without gaps in the column _pos.
    dense: bool = False

    # The order.

    def ordered(self, *by: str) -> Flow:
        return Flow(self.df, by)

    def need_order(self) -> None:
        if not self.by:
            raise ValueError("this verb depends on the order of rows: name one with ordered(...)")

    def indexed(self) -> Flow:
        self.need_order()
        return self if self.dense else Flow(positions(self.df.drop(POS) if POS not in self.by else self.df, self.by, "__new").drop(POS).withColumnRenamed("__new", POS), (POS,), True)

    def size(self) -> int:
        return self.df.count()

    def rows(self) -> DataFrame:
        """The rows as a bag, without the position."""
        return self.df.drop(POS)

    def sorted_rows(self) -> DataFrame:
        return self.df.orderBy(*self.by).drop(POS) if self.by else self.df

    def _with(self, df: DataFrame, dense: bool = False) -> Flow:
        return replace(self, df=df, dense=self.dense and dense)

    def _keys(self, taken: list[str]) -> list[Column]:
        return [F.col(c) for c in self.by if c not in taken]

    # Elements.

    def map(self, *exprs: Column | str) -> Flow:
        """Each row to the expressions; the order's columns stay."""
        out = self.df.select(*exprs)
        return self._with(self.df.select(*exprs, *self._keys(out.columns)), True)

    def map_batches(self, f, schema: str) -> Flow:
        """A function of pandas batches, for what expressions can't say. Rows keep their order only if f keeps its columns."""
        return self._with(self.df.mapInPandas(f, schema))

    def map_indexed(self, f: Callable[[Column], Column], name: str = "value") -> Flow:
        x = self.indexed()
        return x._with(x.df.select(f(F.col(POS)).alias(name), POS), True)

    def filter(self, p: Column) -> Flow:
        return self._with(self.df.filter(p))

    def filter_in(self, column: str, values: set) -> Flow:
        return self.filter(F.col(column).isin(*values))

    def remove(self, p: Column) -> Flow:
        return self._with(self.df.filter(~holds(p)))

    def keep(self, e: Column, name: str = "value") -> Flow:
        """The expression where it isn't null."""
        return self.map(e.alias(name)).filter(F.col(name).isNotNull())

    def mapcat(self, array: Column, name: str = "value") -> Flow:
        """The elements of each row's array, in order."""
        if not self.by:
            return Flow(self.df.select(F.explode(array).alias(name)))
        x = self.df.select(*self.by, F.posexplode(array).alias("_sub", name))
        return Flow(x, (*self.by, "_sub"))

    def pairs_with(self, other: Flow, where: Column) -> Flow:
        """Pairs of rows for which the condition holds; an equality makes it an equi-join."""
        return Flow(self.rows().join(other.rows(), where))

    # Order-sensitive verbs.

    def take(self, n: int) -> Flow:
        self.need_order()
        return self._with(self.df.orderBy(*self.by).limit(n), True)

    def drop(self, n: int) -> Flow:
        return self._slice(F.col(POS) >= n)

    def _slice(self, p: Column) -> Flow:
        x = self.indexed()
        return x._with(x.df.filter(p))

    def _break(self, p: Column) -> tuple[Flow, Column]:
        """The least position at which p fails, as a column; one row, joined by broadcast."""
        x = self.indexed()
        m = x.df.agg(F.min(F.when(~holds(p), F.col(POS))).alias("__m"))
        return x._with(x.df.crossJoin(F.broadcast(m)), True), F.col("__m")

    def take_while(self, p: Column) -> Flow:
        x, m = self._break(p)
        return x._with(x.df.filter(m.isNull() | (F.col(POS) < m)).drop("__m"), True)

    def drop_while(self, p: Column) -> Flow:
        x, m = self._break(p)
        return x._with(x.df.filter(F.col(POS) >= m).drop("__m"))

    def drop_last(self) -> Flow:
        x = self.indexed()
        top = x.df.agg(F.max(POS).alias("__m"))
        return x._with(x.df.crossJoin(F.broadcast(top)).filter(F.col(POS) < F.col("__m")).drop("__m"), True)

    def take_nth(self, k: int) -> Flow:
        return self._slice(F.col(POS) % k == 0) if k else self

    def nth(self, i: int, column: str, default) -> DataFrame:
        """One row: the column at position i, or the default."""
        x = self.indexed()
        return x.df.agg(F.coalesce(F.max(F.when(F.col(POS) == i, F.struct(F.col(column).alias("v"))))["v"], F.lit(default)).alias("value"))

    def first(self, column: str) -> DataFrame:
        """One row: the column of the first row, null if there is none."""
        self.need_order()
        return self.df.agg(F.min_by(column, F.struct(*self.by)).alias("value"))

    def last(self, column: str) -> DataFrame:
        self.need_order()
        return self.df.agg(F.max_by(column, F.struct(*self.by)).alias("value"))

    def second(self, column: str) -> DataFrame:
        return self.rest().first(column)

    def rest(self) -> Flow:
        return self.drop(1)

    def reverse(self) -> Flow:
        x = self.indexed()
        top = x.df.agg(F.max(POS).alias("__m"))
        return x._with(x.df.crossJoin(F.broadcast(top)).withColumn(POS, F.col("__m") - F.col(POS)).drop("__m"), True)

    def concat(self, *others: Flow) -> Flow:
        out, first = None, 0
        for f in (self, *others):
            x = f.indexed().df
            part = x.withColumn(POS, F.col(POS) + first)
            out = part if out is None else out.unionByName(part)
            first += x.count()
        return Flow(out, (POS,), True)

    def interpose(self, sep: Column, column: str) -> Flow:
        x = self.indexed()
        y = x.df.select(POS, F.posexplode(F.when(F.col(POS) > 0, F.array(sep, F.col(column))).otherwise(F.array(F.col(column)))).alias("__i", column))
        return Flow(y.select(F.col(column), (2 * F.col(POS) - F.when((F.col(POS) > 0) & (F.col("__i") == 0), 1).otherwise(0)).alias(POS)), (POS,), True)

    def zip(self, other: Flow, left: str, right: str) -> Flow:
        a, b = self.indexed(), other.indexed()
        x = a.df.select(POS, F.col(left).alias("l")).join(b.df.select(POS, F.col(right).alias("r")), POS)
        return Flow(x, (POS,), True)

    def interleave(self, other: Flow, left: str, right: str, name: str = "value") -> Flow:
        x = self.zip(other, left, right).df.select(POS, F.posexplode(F.array("l", "r")).alias("__i", name))
        return Flow(x.select(name, (2 * F.col(POS) + F.col("__i")).alias(POS)), (POS,), True)

    def partition_all(self, n: int, column: str, name: str = "chunk") -> Flow:
        """Chunks of n values in order; the last may be shorter. n = 0 makes one chunk, which then is one row."""
        x = self.indexed()
        group = F.floor(F.col(POS) / n) if n else F.lit(0).cast("long")
        y = x.df.groupBy(group.alias("__g")).agg(F.array_sort(F.collect_list(F.struct(POS, F.col(column).alias("v")))).alias("t"))
        return Flow(y.select(F.transform("t", lambda s: s["v"]).alias(name), F.col("__g").alias(POS)), (POS,), True)

    def partition(self, n: int, column: str, name: str = "chunk") -> Flow:
        x = self.partition_all(n, column, name)
        return x._with(x.df.filter(F.size(name) == n), True)

    def reductions(self, value: Column, init=0, over=F.sum, merge=lambda a, b: a + b, name: str = "value") -> Flow:
        """Running folds, init first. Ranges of rows are folded in parallel, and each range goes on from those before it.

        over is an aggregate and merge the same operation of two columns; both must be associative.
        """
        x = self.indexed()
        y = x._ranges()[0].select(POS, value.alias("__v"), "__g")
        sums = y.groupBy("__g").agg(over("__v").alias("__s"))  # a row for each range
        before = over("__s").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1))
        starts = sums.select("__g", F.coalesce(merge(F.lit(init), before), F.lit(init)).alias("__start"))
        run = over("__v").over(Window.partitionBy("__g").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0))
        z = y.join(F.broadcast(starts), "__g").select((F.col(POS) + 1).alias(POS), merge(F.col("__start"), run).alias(name))
        zero = x.df.sparkSession.range(1).select(F.lit(0).cast("long").alias(POS), F.lit(init).cast(dict(z.dtypes)[name]).alias(name))
        return Flow(zero.union(z), (POS,), True)

    def dedupe(self, *columns: str) -> Flow:
        """Without rows equal to the row before."""
        x = self.indexed()
        y, _ = x._ranges()
        row = F.struct(*[F.col(c).alias(c) for c in columns])
        # Within a range a lag; before a range's first row comes the last of the range before it, a row for each range.
        last = y.groupBy("__g").agg(F.max_by(row, POS).alias("__last")).withColumn("__g", F.col("__g") + 1)
        prev = F.coalesce(F.lag(row).over(Window.partitionBy("__g").orderBy(POS)), F.col("__last"))
        y = y.join(F.broadcast(last), "__g", "left").withColumn("__prev", prev)
        return x._with(y.filter((F.col(POS) == 0) | ~F.col("__prev").eqNullSafe(row)).select(*x.df.columns))

    def _ranges(self) -> tuple[DataFrame, int]:
        """The rows with the range __g that their position is in, as many ranges as shuffles have partitions; and a range's length."""
        parts = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        span = max(1, -(-self.size() // parts))
        return self.df.withColumn("__g", F.floor(F.col(POS) / span)), span

    def sort(self, *columns: str) -> Flow:
        """Ascending and stable: the order so far breaks ties."""
        return Flow(self.df, (*columns, *[c for c in self.by if c not in columns]))

    def top(self, n: int, *columns: str) -> Flow:
        return self.sort(*columns).take(n)

    # Folds.

    def reduce(self, agg: Column, init, merge=lambda a, b: a + b) -> DataFrame:
        """One row: init combined once with the aggregate over all rows; init alone if there are none."""
        return self.df.agg(agg.alias("__a")).select(F.when(F.col("__a").isNull(), F.lit(init)).otherwise(merge(F.lit(init), F.col("__a"))).alias("value"))

    def fold_ordered(self, step: Callable, init, value: str, schema: str = "value long") -> DataFrame:
        """A left fold whose step isn't associative. One task takes all values in order: no other way gives the result."""
        self.need_order()
        x = self.df.select(F.struct(*self.by).alias("k"), F.col(value).alias("v")).orderBy("k").select("v").coalesce(1)

        def run(batches):
            import pandas as pd

            acc = init
            for b in batches:
                for v in b.v:
                    acc = step(acc, v)
            yield pd.DataFrame({schema.split()[0]: [acc]})

        return x.mapInPandas(run, schema)

    def fold_composed(self, rows: Callable, compose: Callable, apply: Callable, init, value: str, schema: str) -> DataFrame:
        """A left fold whose steps compose: ranges of rows are folded to one function each, in parallel, and those are applied in order.

        rows makes the function of a list of values (in order), compose that of two functions, the first applied first,
        and apply takes a function and a state. Functions are tuples with the given schema: a row for each range.
        """
        x = self.indexed()
        y, _ = x._ranges()
        names = [c.split()[0] for c in schema.split(",")]

        def run(batches):
            import pandas as pd

            out = []
            for b in batches:
                for g, own in b.groupby("__g", sort=False):
                    f = rows(own[value].tolist())
                    if out and out[-1][0] == g:
                        out[-1] = (g, compose(out[-1][1], f))
                    else:
                        out.append((g, f))
            yield pd.DataFrame([(g, *f) for g, f in out], columns=["__g", *names])

        dealt = y.select("__g", POS, value).repartition("__g").sortWithinPartitions("__g", POS)
        acc = init
        for r in sorted(dealt.mapInPandas(run, f"__g long, {schema}").collect()):  # a row for each range
            acc = apply(tuple(r)[1:], acc)
        return self.df.sparkSession.createDataFrame([(acc,)], "value long")

    def apply(self, op: str, column: str) -> DataFrame:
        """+, * or max over a column, with the identities 0, 1 and 0. Products of whole numbers are exact, up to 38 digits."""
        if op == "+":
            agg, e = F.sum(column), 0
        elif op == "max":
            agg, e = F.max(column), 0
        elif op == "*" and dict(self.df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint"):
            return monoids.fold(self.df, monoids.TIMES, F.col(column).cast("decimal(38,0)"))
        elif op == "*":
            agg, e = F.product(column), 1
        else:
            raise ValueError(f"{op} has no identity over all values")
        return self.df.agg(F.coalesce(agg, F.lit(e)).alias("value"))

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"))

    def some(self, p: Column) -> DataFrame:
        return self.df.agg(holds(F.bool_or(holds(p))).alias("value"))

    def every(self, p: Column) -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_and(holds(p)), F.lit(True)).alias("value"))

    # Groups.

    def group_by(self, *keys: Column | str) -> Groups:
        return Groups(self, tuple(F.col(k) if isinstance(k, str) else k for k in keys))

    def frequencies(self, *columns: str) -> DataFrame:
        return self.df.groupBy(*columns).agg(F.count("*").alias("n"))

    def distinct(self, *columns: str) -> Flow:
        """The first row of each value of the columns; without an order any row. Without columns, all but the order's count."""
        columns = columns or tuple(c for c in self.df.columns if c not in self.by)
        if not self.by:
            return Flow(self.df.dropDuplicates(list(columns)))
        rest = [c for c in self.df.columns if c not in columns]
        x = self.df.groupBy(*columns).agg(F.min_by(F.struct(*rest), F.struct(*self.by)).alias("__r"))
        return self._with(x.select(*[F.col(c) if c in columns else F.col(f"__r.{c}") for c in self.df.columns]))

    # Joins.

    def join(self, other: Flow, left: Column, right: Column) -> DataFrame:
        """Pairs struct l, struct r with equal keys; null equals null. Copies multiply."""
        a = self.rows().select(F.struct("*").alias("l"), left.alias("__k"))
        b = other.rows().select(F.struct("*").alias("r"), right.alias("__m"))
        return a.join(b, F.col("__k").eqNullSafe(F.col("__m"))).select("l", "r")

    def member_of(self, other: Flow, left: Column, right: Column, absent: bool = False) -> Flow:
        """The rows whose key is among the other's; or isn't. Null counts as a value: absence is two-valued, unlike NOT IN."""
        keys = other.df.select(right.alias("__m")).distinct()
        return self._with(self.df.join(keys, left.eqNullSafe(F.col("__m")), "left_anti" if absent else "left_semi"))

    def lookup(self, table: DataFrame, left: Column, key: str, value: str, name: str = "found") -> Flow:
        """The value at each row's key in a table with unique keys, else null."""
        t = table.select(F.col(key).alias("__m"), F.col(value).alias(name))
        return self._with(self.df.join(t, left.eqNullSafe(F.col("__m")), "left").drop("__m"), True)

    def with_own_group(self, *keys: str, name: str = "group", unique: bool = False) -> Flow:
        """Each row with the array of all rows of its group. If the keys are declared unique, that is the row alone.

        A group becomes one array in each of its rows: for keys with few rows each.
        """
        row = F.struct("*")
        if unique:
            return self._with(self.df.select("*", F.array(row).alias(name)), True)
        groups = self.df.select(row.alias("__r"), *[F.col(k).alias(f"__{k}") for k in keys]).groupBy(*[f"__{k}" for k in keys]).agg(F.array_sort(F.collect_list("__r")).alias(name))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return self._with(self.df.join(groups, on).select(*self.df.columns, name))

    # Sets.

    def union(self, other: Flow) -> Flow:
        return Flow(self.rows().unionByName(other.rows()).distinct())

    def difference(self, other: Flow) -> Flow:
        return Flow(self.rows().subtract(other.rows()))

    def intersection(self, other: Flow) -> Flow:
        return Flow(self.rows().intersect(other.rows()))


@dataclass(frozen=True)
class Groups:
    flow: Flow
    keys: tuple[Column, ...]

    def agg(self, *aggs: Column) -> DataFrame:
        return self.flow.df.groupBy(*self.keys).agg(*aggs)

    def vals_agg(self, *aggs: Column) -> DataFrame:
        """A row for each group, keys left out."""
        named = [k.alias(f"__k{i}") for i, k in enumerate(self.keys)]
        return self.flow.df.groupBy(*named).agg(*aggs).drop(*[f"__k{i}" for i in range(len(named))])

    def entries(self, value: str = "rows") -> DataFrame:
        """A row for each key, with the array of its rows, which must fit in memory; agg() has no such bound."""
        return self.agg(F.array_sort(F.collect_list(F.struct(*[c for c in self.flow.df.columns if c != POS]))).alias(value))

    def keys_only(self) -> DataFrame:
        return self.flow.df.select(*self.keys).distinct()

    def vals(self, value: str = "rows") -> DataFrame:
        return self.entries(value).select(value)
