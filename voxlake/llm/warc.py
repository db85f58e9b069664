"""WARC archives of pages, and a globally ordered capture index of them.

*Writing.*  Each page is one record, a ``response`` with its payload or, if an equal payload
of at least ``LEAST_REVISIT`` bytes is held by a page with a smaller id, a ``revisit`` of that
one.  Records are strings built by DataFrame functions; Spark's text writer puts the blank
lines that end a WARC record between them, so its files are gzipped WARC files and its commit
protocol makes them safe against lost tasks.  Offsets count bytes of the archive as it was before
compression.  The archive's rows never shuffle unless the
table of repeated payloads is too large for Spark to broadcast.

*Reading.*  Archives are read as binary files, one parser pass each, in the tasks.

*Index.*  Each task that reads archives gives a run of captures sorted by (URL key, timestamp,
page).  Bounds, every ``SPACING``-th key of a sorted sample by hash, cut all runs into segments; there
are as many ranges as the captures need, about ``RANGE_ROWS`` rows each, or one for each shuffle
partition.  The segments of a range meet in one task, packed; a loser tree merges them, with a few
rows of each run unpacked at a time, and streams them out.  Ranges and places within them order
all captures, so a URL's history is contiguous.
"""

from __future__ import annotations

import gzip
import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm.common import materialise, new_folder, shuffle_partitions

LEAST_REVISIT = 100
#: Pages of up to so many payload bytes go so many to an archive: no archive holds more than
#: 64 MB of payloads, or else a single record.
ARCHIVES = [(1 << 17, 500), (1 << 22, 16), (None, 1)]
EPOCH = 946684800  # captures have no time of their own: this plus the page id
END = "\r\n\r\n"
CAPTURE = "url_key string, ts string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
CAPTURE_ARROW = pa.schema(
    [("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
RANGE_ROWS = 250_000  # captures in a range, about
SPACING = 16  # sampled keys in a range
SEGMENT_ROWS = 256  # captures that are unpacked at a time
KEYS = ["url_key", "ts", "page_id", "archive", "offset"]


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _page_uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``record``: the WARC record of each page, without the two line ends after it, and ``bytes``
    of its payload."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    p = p.withColumn("bytes", F.octet_length("payload")).withColumn("digest", F.sha2("payload", 256))
    # Only payloads that repeat matter for the join; minima are combined before the shuffle.
    repeated = p.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select(F.col("digest").alias("_digest"), "first")
    p = p.join(repeated, (p["digest"] == repeated["_digest"]) & (p["bytes"] >= LEAST_REVISIT), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    p = p.withColumn("revisit", revisit).withColumn("block", F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload"))))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _page_uri(F.col("page_id"))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(F.col("revisit"), _page_uri(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return p.select(F.concat(head, F.col("block")).alias("record"), "bytes")


def write_warc(pages: DataFrame, folder: str) -> None:
    """Write archives, of which ``ARCHIVES`` bounds the bytes, into new folders in ``folder``."""
    records = warc_records(pages)
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    above = -1
    for k, (most, per_file) in enumerate(ARCHIVES):
        if above < longest:
            own = (F.col("bytes") > above) & (F.col("bytes") <= most if most else F.lit(True))
            records.where(own).select("record").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(f"{folder}/size-{k}")
        above = most


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query, in lower case: ``org,example)/a?b``."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0].lower()
    cut = min((k for k in (rest.find(c) for c in "/?") if k >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].split("."))) + ")" + (rest[cut:] or "/")


def parse_warc(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers in lower case, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        begin = end + 4
        stop = begin + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it should")
        yield at, stop - at, headers, data[begin:stop]
        at = stop + 4


def _id_of(uri: str | None) -> int | None:
    tail = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return None if tail in ("", "none") else int(tail)


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of each archive."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            name = path.as_py().rsplit("/", 1)[-1]
            rows = []
            for offset, length, h, block in parse_warc(gzip.decompress(content.as_buffer().to_pybytes())):
                http, _, payload = block.partition(b"\r\n\r\n")
                said = h["warc-payload-digest"].removeprefix("sha256:")
                size = int(http.rsplit(b"Content-Length: ", 1)[1])
                if h["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != said):
                    raise ValueError(f"{name}: the payload at byte {offset} is not the one that was written")
                url = h.get("warc-target-uri")
                rows.append((url_key(url), h["warc-date"], _id_of(h["warc-record-id"]), url, size, said, h["warc-type"], _id_of(h.get("warc-refers-to")), name, offset, length))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CAPTURE_ARROW.types, strict=True)], schema=CAPTURE_ARROW)


def _order(row: tuple) -> tuple:
    """URL key, timestamp, page (null first), then place in the archives."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of the archives in ``folder``: payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.mapInArrow(_captures, CAPTURE)


class LoserTree:
    """k-way merge of sorted iterables: each inner node holds the loser of its match, the root's
    winner comes next.  One row of each run is held."""

    def __init__(self, runs: list[Iterable[tuple]]) -> None:
        self.runs, self.k = [iter(r) for r in runs], max(1, len(runs))
        self.heads: list[tuple | None] = [next(r, None) for r in self.runs] or [None]
        self.keys = [None if h is None else _order(h) for h in self.heads]
        self.loser = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None if x is None or y is None else (x, a) < (y, b)

    def _play(self, node: int) -> int:
        """Play the matches under ``node``; leaves are k .. 2k - 1."""
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if not self._less(a, b):
            a, b = b, a
        self.loser[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while self.keys[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self.keys[w] = None if self.heads[w] is None else _order(self.heads[w])
            node = (w + self.k) // 2
            while node >= 1:
                if self._less(self.loser[node], w):
                    self.loser[node], w = w, self.loser[node]
                node //= 2
            self.winner = w


def sorted_runs(captures: DataFrame) -> DataFrame:
    """Each partition sorted by URL key, timestamp, page and place, and written as a run; ``_id``
    counts up within a run, its high bits are the run's."""
    order = [F.asc_nulls_first(c) for c in KEYS]
    return materialise(captures.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "warc-runs")


def range_bounds(runs: DataFrame) -> list[tuple]:
    """Keys that part the captures into ranges; one for each range reaches the driver."""
    n = runs.count()
    ranges = max(shuffle_partitions(runs.sparkSession), -(-n // RANGE_ROWS))
    one_in = max(1, n // (ranges * SPACING))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            at = [k for k in range(b.num_rows) if (seen + k + 1) % SPACING == 0]
            seen += b.num_rows
            yield b.take(pa.array(at, pa.int64()))

    sample = runs.select(*KEYS).where(F.pmod(F.xxhash64("archive", "offset"), F.lit(one_in).cast("long")) == 0)
    picked = sample.orderBy(*(F.asc_nulls_first(c) for c in KEYS)).mapInArrow(every, sample.schema)
    return sorted((r["url_key"], r["ts"], r["page_id"] is not None, r["page_id"] or 0, r["archive"], r["offset"]) for r in picked.collect())


def merge_index(runs: DataFrame) -> DataFrame:
    """Merge runs (``sorted_runs``) into one global order.

    Adds ``range`` (int) and ``place`` (long, from 0 in each range): ordered by both, captures
    are ordered by URL key, timestamp and page."""
    bounds = range_bounds(runs)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut runs at the bounds; a segment travels as one row."""
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in KEYS), strict=True))
            where = [bisect_right(bounds, (u, t, p is not None, p or 0, a, o)) for u, t, p, a, o in keys]
            ids = batch.column("_id").to_pylist()
            captures = batch.select(CAPTURE_ARROW.names)
            rows, a = [], 0
            for b in range(1, len(ids) + 1):
                if b == len(ids) or where[b] != where[a] or ids[b] != ids[b - 1] + 1 or b - a == SEGMENT_ROWS:
                    part = pa.RecordBatch.from_arrays([pc.take(c, pa.array(range(a, b))) for c in captures.columns], schema=CAPTURE_ARROW)
                    rows.append((where[a], ids[a], part.serialize().to_pybytes()))
                    a = b
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["range", "first", "segment"])

    def unpacked(packed: list[pa.Scalar]) -> Iterator[tuple]:
        for s in packed:
            part = pa.ipc.read_record_batch(s.as_buffer(), CAPTURE_ARROW)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, pa.Scalar]] = []
        at = None
        for b in batches:
            found += zip(b.column("first").to_pylist(), b.column("segment"), strict=True)
            at = b.column("range")[0].as_py() if b.num_rows else at
        found.sort(key=lambda f: f[0])
        by_run = [[s for _, s in own] for _, own in groupby(found, key=lambda f: f[0] >> 33)]
        rows, place = iter(LoserTree([unpacked(r) for r in by_run])), 0
        while some := list(islice(rows, 4096)):
            out = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), CAPTURE_ARROW.types, strict=True)]
            yield pa.RecordBatch.from_arrays([*out, pa.array([at] * len(some), pa.int32()), pa.array(range(place, place + len(some)), pa.int64())], names=[*CAPTURE_ARROW.names, "range", "place"])
            place += len(some)

    merged.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    cut = runs.mapInArrow(segments, "range int, first long, segment binary")
    return cut.groupBy("range").applyInArrow(merged, f"{CAPTURE}, range int, place long")


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html), read them back and index them.

    Returns one row for each page, the columns of ``read_warc`` with ``range`` and ``place``.
    A null html is an empty payload; payloads under 100 bytes are always responses.  Rows that
    repeat the smallest id of equal payloads are all responses.  A null id has no order: it
    becomes a revisit where an id is known, else a response.  A null URL has no target line
    and an empty key; line ends in URLs are escaped.  Extra columns are not archived."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write_warc(pages, folder)
    return merge_index(sorted_runs(read_warc(spark, folder)))
