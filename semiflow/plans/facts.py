"""Declared facts about tables, and what they make needless.

A fact is declared by the caller, or inferred from a sample. Only declared facts, and inferred unique keys that a check
of the whole table has confirmed, license leaving out a filter or a deduplication. Inferred ranges only estimate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """low <= column < high; either end may be open (None)."""

    column: str
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Facts:
    ranges: tuple[Range, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    distinct: bool = False

    def range_of(self, column: str) -> Range:
        low = max((r.low for r in self.ranges if r.column == column and r.low is not None), default=None)
        high = min((r.high for r in self.ranges if r.column == column and r.high is not None), default=None)
        return Range(column, low, high)

    def is_unique(self, *columns: str) -> bool:
        return any(set(u) <= set(columns) for u in self.unique)


@dataclass
class Known:
    """A table with facts, and notes of what was decided for each step."""

    df: DataFrame
    facts: Facts = field(default_factory=Facts)
    notes: tuple[str, ...] = ()

    def _next(self, df: DataFrame, facts: Facts, note: str) -> Known:
        return Known(df, facts, (*self.notes, note))

    def filter_range(self, column: str, low=None, high=None) -> Known:
        """low <= column < high; left out if the facts imply it, empty if they contradict it."""
        r = self.facts.range_of(column)
        over = low is None or (r.low is not None and r.low >= low)
        under = high is None or (r.high is not None and r.high <= high)
        if over and under:
            return self._next(self.df, self.facts, f"filter {column}: dropped, always true (declared)")
        if (low is not None and r.high is not None and r.high <= low) or (high is not None and r.low is not None and r.low >= high):
            return self._next(self.df.limit(0), self.facts, f"filter {column}: always false (declared), empty")
        p = F.lit(True)
        if not over:
            p = p & (F.col(column) >= low)
        if not under:
            p = p & (F.col(column) < high)
        facts = Facts((*self.facts.ranges, Range(column, low, high)), self.facts.unique, self.facts.distinct)
        return self._next(self.df.filter(p), facts, f"filter {column}: kept")

    def distinct(self) -> Known:
        if self.facts.distinct or self.facts.unique:
            return self._next(self.df, self.facts, "distinct: dropped, rows are distinct (declared)")
        return self._next(self.df.distinct(), Facts(self.facts.ranges, self.facts.unique, True), "distinct: kept")

    def distinct_by(self, *columns: str) -> Known:
        if self.facts.is_unique(*columns):
            return self._next(self.df, self.facts, f"distinct by {', '.join(columns)}: dropped, unique (declared)")
        facts = Facts(self.facts.ranges, (*self.facts.unique, columns), True)
        return self._next(self.df.dropDuplicates(list(columns)), facts, f"distinct by {', '.join(columns)}: kept")

    def project(self, *columns: str) -> Known:
        """Facts about columns that stay, stay."""
        ranges = tuple(r for r in self.facts.ranges if r.column in columns)
        unique = tuple(u for u in self.facts.unique if set(u) <= set(columns))
        return self._next(self.df.select(*columns), Facts(ranges, unique, bool(unique)), "project")

    def group_by_key_agg(self, key: str, **rows: str) -> Known:
        """Aggregates by key, given as expressions of one row; a unique key needs no grouping."""
        if self.facts.is_unique(key):
            return self._next(self.df.select(key, *[F.expr(v).alias(k) for k, v in rows.items()]), Facts(unique=((key,),)), f"group by {key}: dropped, unique (declared)")
        return self._next(self.df.groupBy(key).agg(*[F.expr(f"sum({v})").alias(k) for k, v in rows.items()]), Facts(unique=((key,),)), f"group by {key}: kept")

    def report(self) -> str:
        return "\n".join(self.notes)


def unlocked(df: DataFrame, steps, tiers: dict[str, Facts]) -> dict[str, list[str]]:
    """For each named set of facts, the notes of the steps that it lets drop. steps: a function of Known."""
    return {name: [n for n in steps(Known(df, f)).notes if "dropped" in n or "empty" in n] for name, f in tiers.items()}


def profile(df: DataFrame, small: int = 16) -> DataFrame:
    """A row for each column: rows, distinct values (approximate), their ratio, least and largest as text, longest text, whether few values."""
    out = None
    for c, kind in df.dtypes:
        if kind.startswith(("array", "map", "struct", "binary", "variant")):
            continue
        x = df.agg(
            F.lit(c).alias("column"), F.count("*").alias("n"), F.approx_count_distinct(c).alias("ndv"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high"),
            F.max(F.length(F.col(c).cast("string"))).alias("longest"),
        )
        out = x if out is None else out.union(x)
    return out.withColumns({"ratio": F.col("ndv") / F.greatest("n", F.lit(1)), "small_domain": F.col("ndv") <= small})


def key_candidates(df: DataFrame, sample: int = 10_000) -> list[str]:
    """Columns without repeats in the first rows found: candidates only, to be guarded."""
    head = df.limit(sample)
    counts = head.agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(c) for c, k in df.dtypes if not k.startswith(("array", "map", "struct"))]).first().asDict()
    return [c for c, v in counts.items() if c != "n" and counts["n"] and v == counts["n"]]


def is_unique(df: DataFrame, *columns: str) -> bool:
    """Checked on the whole table."""
    return df.groupBy(*columns).count().filter("count > 1").isEmpty()


def guarded(df: DataFrame, key: tuple[str, ...], fast, slow) -> tuple[DataFrame, str]:
    """fast(df) if the key is unique on the whole table, else slow(df); and which it was."""
    if is_unique(df, *key):
        return fast(df), "guarded"
    return slow(df), "fell back"


def selectivity(df: DataFrame, p, fraction: float = 0.01, seed: int = 7) -> float:
    """The share of rows for which p holds, estimated on a sample, between 0.01 and 1."""
    got = df.sample(fraction=fraction, seed=seed).agg(F.avg(F.coalesce(p, F.lit(False)).cast("double"))).first()[0]
    return min(1.0, max(0.01, 1.0 if got is None else got))
