"""WARC archives and their index, by external merging.

Pages become WARC records: of records with equal payloads that with the largest page_id is a response, others are
revisits that name it. Each record is a gzip member of its own, so that readers can seek; Spark's text writer puts them
into archives in a folder that all executors share, whose commit survives lost tasks. Reading the archives back writes
each archive's captures as a locally sorted run. A sample of the keys splits the key space into ranges of about
RANGE_ROWS captures, however many there are, and in each range a loser tree merges the runs by URL key and time, so that
the parts, in order, hold the captures in global order. A task holds one range.

A null html is an empty payload, a null url the empty url. A null page_id is written as an empty id and counts as smaller
than all; rows that repeat the largest page_id are all responses. An empty table gives empty archives and no captures.
A capture's time is that of a named column (null: EPOCH), else EPOCH and page_id seconds, modulo CYCLE. Payloads may have
any length that a task can hold; other columns of the pages are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semiflow.llm.common import cut, scratch, small_batches

EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
#: Seconds after which made-up times start anew.
CYCLE = 50 * 365 * 86_400
SEP = b"\r\n\r\n"
#: Captures that one task merges.
RANGE_ROWS = 50_000
CAPTURE = "url_key string, ts string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, archive string, record int"


def url_key(url: str) -> str:
    """The sort-friendly form of a url: host labels from the last to the first, then port, path and query, lowered."""
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return url.lower()
    host = host.removeprefix("www.")
    rest = (p.path or "/").lower() + (f"?{p.query.lower()}" if p.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + rest


def record_id(page_id: int | None) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{'' if page_id is None else page_id}").urn


def record(page_id: int | None, url: str, ts: str, payload: str, refers: int | None, digest: str, size: int) -> bytes:
    """One record; a revisit's block is empty. X- fields hold what the ids, as UUIDs, can't give back."""
    kind = "response" if refers is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id)}>", f"X-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}", f"WARC-Date: {ts}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <{record_id(refers)}>", f"X-Refers-To-Page: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = payload.encode() if refers is None else b""
    return "\r\n".join([*head, "Content-Type: text/html", f"Content-Length: {len(block)}"]).encode() + SEP + block + SEP


def member(raw: bytes) -> bytes:
    """A gzip member without its last byte, a zero, which the writer adds as the end of the line.

    That byte is the highest of the length: a record of 16 MB or more is followed by an empty member, which ends so too.
    """
    out = gzip.compress(raw, 6, mtime=0)
    return out[:-1] if out[-1] == 0 else out + gzip.compress(b"", mtime=0)[:-1]


def write(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = 16_000_000, time: str | None = None) -> None:
    """Writes archives of about archive_bytes of payload. pages: page_id, url, html. Payloads under least_bytes are all responses."""
    html = F.coalesce("html", F.lit(""))
    zero = int(EPOCH.timestamp())
    secs = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(CYCLE)) if time is None else F.coalesce(F.col(time).cast("timestamp").cast("long") - zero, F.lit(0))
    x = pages.select("page_id", "url", secs.cast("long").alias("secs"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("digest"))
    mean = x.agg(F.avg("size")).first()[0] or 1
    known = x.filter(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    x = x.join(known, ["digest", "size"], "left")
    older = F.col("last").isNotNull() & (F.coalesce(F.col("page_id") < F.col("last"), F.lit(True)))
    x = small_batches(x).select("page_id", "url", "secs", "html", "size", "digest", F.when(older, F.col("last")).alias("refers"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, url, secs, h, size, digest, refers in b.itertuples(index=False):
                i, refers = (None if pd.isna(v) else int(v) for v in (i, refers))
                ts = (EPOCH + timedelta(seconds=int(secs))).strftime("%Y-%m-%dT%H:%M:%SZ")
                out.append(member(record(i, url or "", ts, h, refers, base64.b32encode(bytes.fromhex(digest)).decode(), int(size))))
            yield pd.DataFrame({"value": out})

    # The bytes pass through the text writer as they are: it writes a string's bytes without reading them as text.
    lines = x.mapInPandas(build, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", max(1, int(archive_bytes / mean))).text(path)


def members(raw: bytes) -> Iterator[bytes]:
    """What each gzip member of an archive holds, unpacked one at a time."""
    view, at = memoryview(raw), 0
    while at < len(view):
        out, unpack, read = [], zlib.decompressobj(31), at
        while not unpack.eof and read < len(view):
            out.append(unpack.decompress(view[read : read + 65_536]))
            read += 65_536
        at = min(read, len(view)) - len(unpack.unused_data)
        yield b"".join(out)


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    for one in members(raw):
        if one:
            end = one.index(SEP)
            head = dict(x.split(": ", 1) for x in one[:end].decode().split("\r\n")[1:])
            yield head, one[end + 4 : end + 4 + int(head["Content-Length"])]


def captures(archive: str, raw: bytes) -> list[tuple]:
    """An archive's captures, a run sorted by key, time and id. A response's size and digest are taken from its block anew."""
    out = []
    for k, (head, block) in enumerate(records(raw)):
        own = head["X-Page-ID"]
        kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"][5:], int(head["X-Payload-Length"])
        if kind == "response":
            digest, size = base64.b32encode(hashlib.sha1(block).digest()).decode(), len(block)
        url = head["WARC-Target-URI"]
        out.append((url_key(url), head["WARC-Date"], int(own) if own else None, kind, int(head["X-Refers-To-Page"]) if kind == "revisit" else None, size, digest, url, archive, k))
    return sorted(out, key=order)


def order(x: tuple) -> tuple:
    return x[0], x[1], -1 if x[2] is None else x[2], x[8], x[9]


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers of the matches between runs, so that each step plays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.n = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * self.n
        for i in range(self.n):
            self.play(i)

    def less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (order(x), a) < (order(y), b))

    def play(self, i: int) -> None:
        node = (i + self.n) // 2
        while node:
            j = self.tree[node]
            if j < 0:
                self.tree[node] = i
                return
            if self.less(j, i):
                self.tree[node], i = i, j
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.n and self.heads[w := self.tree[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self.play(w)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under the path; each archive's are one run, in order."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CAPTURE.split(", ")]
        for b in batches:
            for archive, raw in zip(b.path, b.content):
                yield typed(pd.DataFrame(captures(archive, bytes(raw)), columns=names))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return small_batches(files).select("path", "content").mapInPandas(parse, CAPTURE)


def typed(x: pd.DataFrame) -> pd.DataFrame:
    return x.astype({"page_id": "Int64", "refers_to": "Int64"})


def merged(runs: DataFrame, parts: int | None = None) -> DataFrame:
    """The captures in global order by url key, time and id: part after part, each merged from its pieces of the written runs."""
    runs = cut(runs, "runs")
    parts = parts or runs.count() // RANGE_ROWS + 1
    # Ranges of the whole order, so that a url with many captures is split by time; within a range runs stay apart and in order.
    x = runs.repartitionByRange(parts, "url_key", "ts", "page_id", "archive", "record").sortWithinPartitions("archive", "url_key", "ts", "page_id", "record")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, pieces = None, {}
        for b in batches:
            names = list(b.columns)
            b = b.astype(object).where(b.notna(), None)
            for row in b.itertuples(index=False, name=None):
                pieces.setdefault(row[8], []).append(row)
        lot = []
        for row in LoserTree([iter(p) for p in pieces.values()]):
            lot.append(row)
            if len(lot) == 10_000:
                yield typed(pd.DataFrame(lot, columns=names))
                lot = []
        if lot:
            yield typed(pd.DataFrame(lot, columns=names))

    return x.mapInPandas(merge, CAPTURE)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder and returns the merged index of what is read back."""
    spark = pages.sparkSession
    at = scratch(spark, "warc")
    write(pages, at, least_bytes)
    return merged(read(spark, at))
