"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semiflow.scratch import cut, scratch, shared_dir  # noqa: F401
from semiflow.sources.tables import table  # noqa: F401


#: Bytes and rows that Spark hands to a Python worker at once.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches are bounded, so that neither a task's JVM nor its worker holds many texts.

    A session that has set smaller ones keeps them. A batch has one row at least, so a longer text makes a longer batch.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        now = int(re.sub(r"\D", "", conf.get(f"spark.sql.execution.arrow.{key}")) or 0)
        if not 0 < now <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", most)
    return df


def free_name(df: DataFrame, *more: str) -> str:
    """A prefix with which no column's name begins."""
    return "_" * (1 + max(map(len, (*df.columns, *more, ""))))


def small_side(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """df marked for broadcast if it has at most max_rows rows, else df, to be joined by a shuffle."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


#: Bits of a prefilter for each id, and in all (64 MB, the most that is broadcast); bits of one of its bitmaps.
ID_BITS, MOST_BITS, BITMAP = 32, 1 << 29, 1 << 15


def maybe_among(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, str]:
    """df with one more column, and its name: true for each row whose key is in ids (a written table of distinct keys), and for few others.

    Each id sets one bit of bitmaps with ID_BITS bits for each id, MOST_BITS at most, which are broadcast. So rows that
    an exact join would leave as they are need no shuffle. More ids than the bitmaps have room for only make more rows
    true.
    """
    n = ids.count()
    bits = min(MOST_BITS, max(1, -(-n * ID_BITS // BITMAP)) * BITMAP)
    tag = free_name(df)
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    lot, bit = F.floor(place / BITMAP), place % BITMAP
    spots = ids.select(lot.alias(f"{tag}lot"), bit.alias("bit")).repartition(f"{tag}lot")
    maps = cut(spots.groupBy(f"{tag}lot").agg(F.bitmap_construct_agg("bit").alias(f"{tag}map")), "id-bits")
    octet = F.conv(F.hex(F.substr(F.col(f"{tag}map"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.bit_get(octet, (bit % 8).cast("int")) == 1, F.lit(False))
    x = df.withColumn(f"{tag}lot", lot).join(F.broadcast(maps), f"{tag}lot", "left")
    return x.select(*df.columns, is_set.alias(tag)), tag


def among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ids, a written table of distinct keys; few others are shuffled."""
    x, maybe = maybe_among(df, ids, key)
    return x.filter(F.col(maybe)).drop(maybe).join(ids.select(key), key, "left_semi").select(*df.columns)


def not_among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is null or not in ids, a written table of distinct keys; df is read twice, and few rows are shuffled."""
    x, maybe = maybe_among(df, ids, key)
    seen = x.filter(F.col(maybe)).drop(maybe).join(ids.select(key), key, "left_anti").select(*df.columns)
    return x.filter(~F.col(maybe)).drop(maybe).union(seen)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def id_fraction(col: Column) -> Column:
    """A number in [0, 1) that depends on the value of col alone."""
    return F.pmod(F.xxhash64(col), F.lit(1 << 30)) / F.lit(float(1 << 30))


WORD_BYTE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def folded_bytes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of the text with A-Z lowered and each run of other ASCII than letters and digits as one space.

    No space comes first. The second array holds each byte's place in the UTF-8 of the text.
    """
    raw = np.frombuffer(text.encode("utf-8").lower(), np.uint8)
    word = WORD_BYTE[raw]
    keep = word.copy()
    keep[1:] |= word[:-1]
    at = np.flatnonzero(keep)
    return np.where(word, raw, 32).astype(np.uint8)[at], at


def folded(text: str) -> str:
    return folded_bytes(text)[0].tobytes().decode("utf-8")


def source_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of the text for spans in code points of folded(text)."""
    if not spans:
        return []
    out, at = folded_bytes(text)
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    # Bytes before each code point of the folded text, and code points before each byte of the text.
    starts = np.append(np.flatnonzero((out & 0xC0) != 0x80), len(out))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    got = []
    for lo, hi in spans:
        first, last = int(starts[min(lo, len(starts) - 1)]), int(starts[min(hi, len(starts) - 1)])
        start = int(at[first]) if first < len(at) else len(raw)
        end = int(at[last - 1]) + 1 if last > first else start
        got.append((int(points[start]), int(points[end])))
    return got


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number (SplitMix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Words that one group holds, which bounds the arrays made from it.
WORDS_AT_ONCE = 4_000


def by_length(words: list[str], most: int):
    """Groups of words of one length: (places, code points by word). Words over `most` letters must be cut before."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, places in groups.items():
        for lo in range(0, len(places), WORDS_AT_ONCE):
            part = places[lo : lo + WORDS_AT_ONCE]
            flat = "".join([words[i] for i in part]).encode("utf-32-le")
            yield np.array(part), np.frombuffer(flat, np.uint32).reshape(len(part), n)
