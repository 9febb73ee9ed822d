"""WARC archives with an index: records are written first, then read back by coalesced byte ranges.

Each writing task streams its records, one gzip member each, to a file of its own in a shared folder and
returns an index row per record: file, offset, length, URL and digest. A task that runs again writes
another file, and only the rows of the attempt that succeeded are in the index, so lost executors leave
unused files at most. Readers sort the selected index rows by file and offset, join ranges that lie close
together, read each range once and check every payload against its digest.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bound_batches, scratch_path, stored, table, to_arrow

DATE = "1970-01-01T00:00:00Z"  # records carry no time of their own, so that reruns give equal bytes
GAP = 64 << 10  # ranges nearer than this are read as one
RANGE = 8 << 20  # but none grows beyond this, unless a record is larger
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the payload's length and digest alone."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:x-page:{page_id}>")
    head.append(f"WARC-Date: {DATE}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:x-page:{refers_to}>")
    head.append(f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers, payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def number(urn: str | None) -> int | None:
    return int(urn.strip("<>").rpartition(":")[2]) if urn else None


FEW_DIGESTS = 1_000_000  # repeated payloads whose digests are broadcast, at most; more are joined by a shuffle


def classify(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """page_id, url, html, revisit, refers_to. Of equal payloads, those with the largest id are responses."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    top = rows.filter(F.octet_length("html") >= least).groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1")
    top = stored(top.drop("n"), "warc-repeated")
    top = F.broadcast(top) if top.count() <= FEW_DIGESTS else top
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return rows.join(top, "sha", "left").select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes a record for each row and returns the index, a table of the shared folder.

    A null payload is empty; a null URL or id has no header. Payloads under ``least`` bytes are all
    responses. Rows that tie on the largest id are all responses. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    folder = folder or scratch_path(spark, "warc")
    arrow = to_arrow(spark, INDEX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        offset = 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for b in _chain(first, batches):
                cols = {c: [] for c in arrow.names}
                for page_id, url, html, revisit, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "revisit", "refers_to")), strict=True):
                    payload = html.encode()
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = z.compress(record(page_id, url, payload, refers_to, revisit)) + z.flush()
                    out.write(member)
                    for c, v in zip(arrow.names, (page_id, url, f"{folder}/{name}", offset, len(member), digest_of(payload), "revisit" if revisit else "response"), strict=True):
                        cols[c].append(v)
                    offset += len(member)
                yield pa.RecordBatch.from_pydict(cols, schema=arrow)

    return stored(classify(pages, id_col, url_col, payload_col, least).mapInArrow(write, INDEX), "warc-index")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def coalesced(spans: list[tuple[int, int]], gap: int = GAP, most: int = RANGE) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) to (start, end, members)."""
    group: list[tuple[int, int]] = []
    end = 0
    for o, n in spans:
        if group and (o - end > gap or o + n - group[0][0] > most):
            yield group[0][0], end, group
            group, end = [], 0
        group.append((o, n))
        end = max(end, o + n)
    if group:
        yield group[0][0], end, group


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows, read by coalesced ranges. A payload that misses its digest raises.

    Revisits give their payload's size and digest; their payload is null (it is their response's).
    """
    bound_batches(index.sparkSession)
    arrow = to_arrow(index.sparkSession, RECORD)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            byfile: dict[str, list[tuple[int, int]]] = {}
            for f, o, n in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                byfile.setdefault(f, []).append((o, n))
            for f, spans in byfile.items():
                store, path = fs.FileSystem.from_uri(f)
                with store.open_input_file(path) as src:
                    for start, end, members in coalesced(sorted(spans)):
                        raw = src.read_at(end - start, start)
                        cols = {c: [] for c in arrow.names}
                        for o, n in members:
                            w, http, payload = parse(zlib.decompress(raw[o - start : o - start + n], 31))
                            digest = w["WARC-Payload-Digest"].removeprefix("sha1:")
                            revisit = w["WARC-Type"] == "revisit"
                            if not revisit and digest_of(payload) != digest:
                                raise ValueError(f"{f} at {o}: the payload does not have the digest {digest}")
                            row = (number(w.get("WARC-Record-ID")), w.get("WARC-Target-URI"), int(http["Content-Length"]), digest, w["WARC-Type"], number(w.get("WARC-Refers-To")), None if revisit or not with_payload else payload.decode())
                            for c, v in zip(arrow.names, row, strict=True):
                                cols[c].append(v)
                        yield pa.RecordBatch.from_pydict(cols, schema=arrow)

    dealt = index.select("file", "offset", "length").repartition(F.col("file")).sortWithinPartitions("file", "offset")
    out = dealt.mapInArrow(read, RECORD)
    return out if with_payload else out.drop("payload")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"))
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, upper(sha1(coalesce(html, ''))) AS x FROM pages),
g AS (SELECT x, max(page_id) AS top FROM p GROUP BY 1),
v AS (SELECT page_id, x, i, CAST(('0x' || substr(x, 5 * i + 1, 5)) AS BIGINT) AS n FROM p, range(8) AS r(i)),
b AS (SELECT page_id, x, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(n >> 15 AS INT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((n >> 10) & 31 AS INT) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((n >> 5) & 31 AS INT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(n & 31 AS INT) + 1, 1), '' ORDER BY i) AS d FROM v GROUP BY 1, 2)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, b.d AS payload_digest,
  CASE WHEN p.page_id = g.top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id = g.top THEN NULL ELSE g.top END AS refers_to
FROM p JOIN g USING (x) JOIN b ON b.page_id = p.page_id AND b.x = p.x
"""
