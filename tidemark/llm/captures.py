"""Web archives: records written, read back, and their captures brought into one global order.

Tasks write gzip members of WARC records into archives in the shared folder and report what they finished;
files of lost attempts are never read. Each archive read back yields a run of captures sorted by URL key and
timestamp. Runs are cut at common boundaries, and the slices of a key range meet in one task, which merges
them with a loser tree: one comparison per level and row, however many runs there are.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, stored_path

#: Bytes after which a task starts the next archive; an archive is read back whole by one task.
ARCHIVE_BYTES = 8 << 20
#: Captures have no time of their own in the table: the page's number counts seconds from here.
EPOCH = datetime.datetime(2020, 1, 1)


def url_key(url: str | None) -> str:
    """Host labels reversed, then port, path and query: pages of a site and its subdomains sort together."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return "!" + (url or "")
    labels = [x for x in host.lower().split(".") if x]
    if labels and labels[0] == "www":
        labels = labels[1:]
    default = {"http": 80, "https": 443}.get(parts.scheme)
    return ",".join(reversed(labels)) + (f":{port}" if port and port != default else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def stamp(page_id: int | None) -> str:
    seconds = (page_id or 0) % (250 * 365 * 86_400)
    return (EPOCH + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has headers only and names the payload it stands for."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Date: {stamp(page_id)}",
        f"WARC-Payload-Digest: sha1:{bare_digest(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode()
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(archive: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the unpacked archive, headers, payload) of each record."""
    data, at = gzip.GzipFile(fileobj=archive).read(), 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(head["Content-Length"])
        block = data[stop + 4 : stop + 4 + size]
        yield at, head, block[block.index(b"\r\n\r\n") + 4 :]
        at = stop + 4 + size + 4


def archive_pages(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for every row and return the archives written: file, records.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest page_id is the response.
    Payload groups are counted by digest; only groups of two and more meet the pages again in a join.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    groups = (
        rows.filter(F.octet_length("html") >= least).groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(F.col("digest").alias("__digest"), "keeper")
    )
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    decided = rows.join(groups, F.col("digest") == F.col("__digest"), "left").select("page_id", "url", "html", refers.alias("refers_to"))
    spark = pages.sparkSession
    folder = stored_path(spark, "archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        out, done, name, size, n = None, [], "", 0, 0
        for batch in batches:
            # Arrow keeps longs whole beside nulls; texts are unpacked one by one.
            for page, link, text, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                packed = gzip.compress(record(page, link, text.as_py().encode(), refers), 1, mtime=0)
                out.write(packed)
                size, n = size + len(packed), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["file", "records"])

    return stored(decided.mapInArrow(write, "file string, records long"), "archive-list")


RUN = "run string, url_key string, ts string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, position long"
RUN_SCHEMA = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (x.split() for x in RUN.split(", "))])


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in RUN_SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RUN_SCHEMA)], schema=RUN_SCHEMA)


def capture_runs(archives: DataFrame) -> DataFrame:
    """Read the archives back: one run of captures per archive, sorted by URL key, timestamp and page.

    The files listed are dealt out to tasks and opened there; an archive is bounded by its writer.
    Payloads of responses are hashed again; a revisit carries its payload's length and digest in its headers.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(file if "://" in file else f"file://{file}")
                with store.open_input_stream(path, compression=None) as stream:
                    archive = io.BytesIO(stream.read())
                rows = []
                for at, head, payload in records(archive):
                    kind = head["WARC-Type"]
                    size, digest = len(payload), bare_digest(payload)
                    if kind == "revisit":
                        size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    page, refers = head["X-Page-ID"], head.get("X-Refers-To-Page")
                    link = head["WARC-Target-URI"]
                    rows.append((file, url_key(link), head["WARC-Date"], int(page) if page else None, link, size, digest, kind, int(refers) if refers else None, file.rpartition("/")[2], at))
                rows.sort(key=capture_order)
                yield as_batch(rows)

    spread = archives.select("file").repartition(2 * archives.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(parse, RUN)


def capture_order(row: tuple) -> tuple:
    """URL key, timestamp, page (none first), then place in the archives, so the order is total."""
    return row[1], row[2], -1 if row[3] is None else row[3], row[9], row[10]


def loser_tree_merge(runs: list[list[tuple]], key=capture_order) -> Iterator[tuple]:
    """Merge sorted runs. Node i of the tree holds the run that lost the match there, node 0 the winner."""
    k = len(runs)
    if not k:
        return
    heads = [iter(r) for r in runs]
    rows = [next(h, None) for h in heads]
    keys = [None if r is None else key(r) for r in rows]

    def beats(a: int, b: int) -> bool:
        if keys[a] is None or keys[b] is None:
            return keys[a] is not None
        return (keys[a], a) < (keys[b], b)

    tree = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while keys[best] is not None:
        yield rows[best]
        rows[best] = next(heads[best], None)
        keys[best] = None if rows[best] is None else key(rows[best])
        node = (best + k) // 2
        while node:
            if beats(tree[node], best):
                tree[node], best = best, tree[node]
            node //= 2


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in one global order: partitions hold ascending key ranges, rows ascend within them.

    Boundaries are over URL key, timestamp and page, so the history of one URL may span many tasks; a task
    holds the slice of the runs that fall into its range. Equal captures keep the order of the archives.
    """
    ranged = runs.repartitionByRange("url_key", "ts", F.col("page_id").asc_nulls_first(), "archive", "position")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                slices.setdefault(row[0], []).append(row)
        for part in slices.values():
            part.sort(key=capture_order)  # in order already unless the shuffle mixed a run's blocks
        yield from in_batches(loser_tree_merge([slices[r] for r in sorted(slices)]))

    return ranged.mapInArrow(merge, RUN)


def in_batches(rows: Iterable[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    chunk: list[tuple] = []
    for row in rows:
        chunk.append(row)
        if len(chunk) == size:
            yield as_batch(chunk)
            chunk = []
    if chunk:
        yield as_batch(chunk)


def capture_histories(pages: DataFrame, least: int = 0, **columns: str) -> DataFrame:
    """Archive the pages, read them back, and return every capture in the global order of the merged index.

    Null html is an empty payload, a null URL an empty one, a null page_id is never a response that others
    refer to unless its whole group has none. Repeated page_ids with equal payloads are all responses. Extra
    columns are ignored. An empty table gives an empty index.
    """
    archives = archive_pages(pages, least, **columns)
    return merge_runs(capture_runs(archives)).drop("run")
