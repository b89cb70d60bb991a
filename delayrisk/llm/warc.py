"""WARC archives of pages, and their index as one ordered capture history.

Writing is DataFrame work: each page becomes the text of one WARC record, and Spark's
text writer ends each with the blank lines that end a WARC record, so files
commit like any other output and can lie in any store. Of equal payloads of at
least ``SAME`` bytes the one with the largest id is kept, the others
are revisit records that refer to it.

Reading streams through each archive and checks each payload against its
digest.  Its captures, sorted by URL key and time, are one run; runs are
stored, dealt by ranges of (URL key, time, id), and inside each range merged by a
loser tree.  Ranges are cut to a bounded number of captures, and as id is part of the
order, captures of one hot URL spread over several.

Defined cases: a null payload is empty; a null URL has no target and the empty
key; control characters and blanks in a URL are escaped; rows with a null id
read back with a null id (revisits, if their payload is kept under an id); repeated rows
with the kept id are all kept in full; an empty table gives no captures.
Pages carry no capture time: ``date`` gives it, by default the id in seconds.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, scratch, stage

SAME = 1000              # bytes from which equal payloads are stored once
PER_FILE = 10_000        # records of a file at most
PER_RANGE = 50_000       # captures that are merged together, about
END = "\r\n\r\n"

CAPTURE = ("url_key string, captured_at string, id long, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, url string, file string, offset long, length long")
NAMES = [c.strip().split()[0] for c in CAPTURE.split(",")]


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """One header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, url: str = "url", payload: str = "html", id_col: str = "page_id",
            date: Column | None = None) -> DataFrame:
    """(value): the text of one WARC record per row."""
    date = date if date is not None else F.timestamp_seconds(F.pmod(F.coalesce(F.col(id_col), F.lit(0)), F.lit(10**9)))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20").alias("url"),
                        F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.coalesce(payload, F.lit("")).alias("body"))
    rows = rows.withColumn("size", F.octet_length("body").cast("long")).withColumn("sha", F.sha1(F.col("body").cast("binary")))
    # Digests that come more than once, with the id that stands for them: combined before any
    # shuffle; on the other side a hot payload's rows can be split.
    kept = (rows.filter(F.col("size") >= SAME).groupBy("sha").agg(F.max("id").alias("kept"), F.count("*").alias("n"))
            .filter("n > 1 AND kept IS NOT NULL").select("sha", "kept"))
    rows = rows.join(kept, "sha", "left")
    again = F.col("kept").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("kept")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("body")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _uuid(F.coalesce(F.col("id").cast("string"), F.lit("none")), F.col("sha"))),
        _line("WARC-Target-URI", F.col("url")), _line("WARC-Date", F.col("date")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))), _line("X-Source-Id", F.col("id").cast("string")),
        F.when(again, F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
            _line("WARC-Refers-To", _uuid(F.col("kept").cast("string"), F.col("sha"))),
            _line("X-Refers-To-Source-Id", F.col("kept").cast("string")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END))
    return rows.select(F.concat(header, block).alias("value"))


def write(pages: DataFrame, folder: str, **columns) -> None:
    """Write ``pages`` as gzipped WARC files; the separator of records is the writer's line end."""
    (records(pages, **columns).write.option("lineSep", END).option("maxRecordsPerFile", PER_FILE)
     .option("compression", "gzip").text(folder))


def url_key(url: str | None) -> str:
    """Host parts from the right, then path and sorted query: captures of a site stand together."""
    if not url:
        return ""
    try:
        u = urlsplit(url)
        host = ",".join(reversed((u.hostname or "").split(".")))
        port = f":{u.port}" if u.port else ""
    except ValueError:
        return url
    query = "&".join(sorted(u.query.split("&"))) if u.query else ""
    return f"{host}{port}){u.path or '/'}{'?' + query if query else ''}"


def _inflate(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """Bytes of gzip members one after the other."""
    at = 0
    while at < len(data):
        machine = zlib.decompressobj(31)
        while at < len(data) and not machine.eof:
            part = data[at:at + step]
            at += len(part)
            yield machine.decompress(part)
            if machine.eof:
                at -= len(machine.unused_data)


def _fields(header: bytes) -> dict[str, str]:
    lines = (x.partition(b":") for x in header.split(b"\r\n")[1:])
    return {k.decode().lower(): v.strip().decode() for k, _, v in lines}


def read_archive(data: bytes) -> Iterator[tuple]:
    """(header fields, HTTP fields, payload, offset, length) of each record, one in memory at a time."""
    buffer, base, parts = bytearray(), 0, _inflate(data)

    def more(n: int) -> bool:
        while len(buffer) < n:
            part = next(parts, None)
            if part is None:
                return False
            buffer.extend(part)
        return True
    while more(1):
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more(len(buffer) + 1):
                raise ValueError(f"a record's header does not end (offset {base})")
        header = _fields(bytes(buffer[:end]))
        size = end + 4 + int(header["content-length"])
        if not more(size + 4) or bytes(buffer[size:size + 4]) != b"\r\n\r\n":
            raise ValueError(f"a record is cut short (offset {base})")
        head, _, payload = bytes(buffer[end + 4:size]).partition(b"\r\n\r\n")
        yield header, _fields(head), payload, base, size + 4
        del buffer[:size + 4]
        base += size + 4


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def captures(name: str, data: bytes) -> list[tuple]:
    """One archive's captures, sorted: a run."""
    rows = []
    for header, http, payload, offset, length in read_archive(data):
        digest = header["warc-payload-digest"].removeprefix("sha1:")
        kind = header["warc-type"]
        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload and digest differ: {name}, offset {offset}")
        n = len(payload) if kind == "response" else int(http["content-length"])
        url = header.get("warc-target-uri")
        rows.append((url_key(url), header["warc-date"], _number(header.get("x-source-id")), n, digest, kind,
                     _number(header.get("x-refers-to-source-id")), url, name, offset, length))
    rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2]))
    return rows


def _runs(batches):
    schema = pa.schema([(c.strip().split()[0], pa.string() if c.strip().endswith("string") else pa.int64()) for c in CAPTURE.split(",")])
    for b in batches:
        for name, data in zip(b.column("path").to_pylist(), b.column("content")):
            rows = captures(name, data.as_py())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


class LoserTree:
    """Merges sorted sequences of keys: inner nodes hold the losers of their matches, so a
    step replays one path from a leaf to the root."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, max(len(runs), 1)
        self.at = [0] * len(runs)
        self.loser = [-1] * self.k
        self.winner = self._build(1)

    def _before(self, a: int, b: int) -> bool:
        """Whether run ``a`` goes first; used-up runs go last, equal keys in the order of their runs."""
        x, y = (r < len(self.runs) and self.at[r] < len(self.runs[r]) for r in (a, b))
        if not (x and y):
            return x or (not y and a < b)
        p, q = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return p < q or (p == q and a < b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        first, second = (a, b) if self._before(a, b) else (b, a)
        self.loser[node] = second
        return first

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position) in the order of the keys."""
        while self.winner < len(self.runs) and self.at[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield run, self.at[run]
            self.at[run] += 1
            node = (run + self.k) // 2
            while node:
                if self._before(self.loser[node], run):
                    self.loser[node], run = run, self.loser[node]
                node //= 2
            self.winner = run


def _merge(batches):
    """Merge one range: its rows come run by run, each run sorted."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    files = table.column("file").to_pylist()
    ids = table.column("id").to_pylist()
    keys = list(zip(table.column("url_key").to_pylist(), table.column("captured_at").to_pylist(),
                    [x is not None for x in ids], [x or 0 for x in ids]))
    starts = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1]]
    runs = [keys[a:z] for a, z in zip(starts, [*starts[1:], len(files)])]
    order = [starts[r] + p for r, p in LoserTree(runs)]
    for at in range(0, len(order), 10_000):
        yield from table.take(pa.array(order[at:at + 10_000])).to_batches()


def history(spark: SparkSession, folder: str) -> DataFrame:
    """All captures of the archives in ``folder``, in global order of URL key, time and id."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    runs = stage(arrow_map(files, _runs, CAPTURE), "runs")
    ranges = runs.count() // PER_RANGE + 1
    order = [F.col("url_key"), F.col("captured_at"), F.col("id").asc_nulls_first()]
    dealt = (runs.repartitionByRange(ranges, *order, F.col("offset"), F.col("file"))
             .sortWithinPartitions("file", *order))
    return arrow_map(dealt, _merge, CAPTURE)


def archived(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` to a new shared folder and read the archives back as an ordered history."""
    folder = scratch(pages.sparkSession, "warc")
    write(pages, folder, **columns)
    return history(pages.sparkSession, folder)
