"""WARC archives, index first: write records and an index of them, then read selected records by coalesced byte ranges.

Writing: narrow rows (page, digest, length) decide which record of equal payloads of at least `least` bytes is the
response (the largest page_id) and which revisit it; only then the payloads meet their decisions, joined on the page,
so that a payload shared by a third of all pages makes no hot key. Each task writes one archive of its own, a gzip member
a record, into the shared folder, and returns its index rows: file, offset, length, URL and digest. The index is a Parquet
table. A task that runs again writes another file; only files that the index names are ever read.

Reading: selected index rows are split into byte ranges by file and place; each task sorts its rows by offset, reads
neighbours closer than `gap` bytes in one request of at most `most` bytes, and parses the records.

Cases: null html is an empty payload; null url an empty URI. Repeated rows with one page_id and payload: the first is the
response, the rest revisit it, under the same id. Null page_ids compare as smaller than all others. Other columns are
ignored. An empty table makes an empty index and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import as_bytes, map_batches, partitions, read, shared_dir, small_batches, written

LEAST = 1000
GAP, MOST = 64 << 10, 8 << 20
INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string"


def decisions(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """name, digest, answer: the page_id of the response for the payload, null where the page is one itself by size."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("bytes")).distinct()
    large = narrow.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("answer"))
    return narrow.join(large, "digest", "left").select(name_of_page(), "digest", "answer")


def name_of_page():
    """A page's id as text, never null: a key of plain equality."""
    return F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("name")


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record, compressed on its own."""
    kind = "revisit" if refers_to is not None else "response"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n", 6, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a compressed record."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its header says")
    return fields, rest[:size]


def one_line(url) -> str:
    return "".join((url or "").splitlines())


def write(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archives of all pages (page_id, url, html) in the shared folder; their index, as a written table."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark)}/annalist-warc-{uuid.uuid4().hex}"
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # Payloads are dealt out once, by page: the join finds them so, and rows of one page and payload come one after another.
    rows = pages.select("page_id", "url", "html", F.sha1(body).alias("digest"), name_of_page()).repartition(partitions(spark), "name", "digest")
    rows = rows.join(decisions(pages, least), ["name", "digest"], "left").select("page_id", "url", "html", "digest", "answer", "name")
    rows = rows.sortWithinPartitions("name", "digest").drop("name")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(INDEX))

    def run(batches):
        out, where, name, last = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz", None
        try:
            for batch in batches:
                index = []
                texts = as_bytes(batch.column("html"))
                rest = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "answer"))
                for html, page, url, digest, answer in zip(texts, *rest, strict=True):
                    if out is None:
                        out = opened(name, write=True)
                    again = (page, digest) == last  # repeated rows come one after another
                    refers = answer if answer is not None and (page != answer or again) else None
                    last = (page, digest)
                    data = record(page, one_line(url), html or b"", digest, refers)
                    out.write(data)
                    index.append((name, where, len(data), one_line(url), digest, page, "response" if refers is None else "revisit"))
                    where += len(data)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*index, strict=True), arrow, strict=True)], schema=arrow)
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(run, INDEX), "warc-index")


def opened(path: str, write: bool = False):
    """A stream of any file system that Arrow knows; a folder that is missing is made."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(place, compression=None)  # the records are compressed one by one
    return system.open_input_file(place)


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = MOST):
    """Sorted (offset, length) as runs of indexes that one request each reads."""
    run: list[int] = []
    for i, (offset, length) in enumerate(rows):
        if run and (offset - sum(rows[run[-1]]) > gap or offset + length - rows[run[0]][0] > most):
            yield run
            run = []
        run.append(i)
    if run:
        yield run


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that rows of an index name: RECORD columns; payload is null if payloads is False, and for revisits."""
    spark = index.sparkSession
    # Rows of one stretch of one file go together: a stretch is as long as a request may be.
    near = index.repartition(partitions(spark), "file", (F.col("offset") / F.lit(MOST)).cast("bigint")).sortWithinPartitions("file", "offset")

    def make(batch):
        columns = {k.split()[0]: [] for k in RECORD.split(", ")}
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][0] == rows[at][0]:
                end += 1
            with opened(rows[at][0]) as f:
                own = [(o, n) for _, o, n in rows[at:end]]
                for run in ranges(own):
                    first = own[run[0]][0]
                    f.seek(first)
                    data = f.read(sum(own[run[-1]]) - first)
                    for i in run:
                        fields, block = parse(data[own[i][0] - first : sum(own[i]) - first])
                        add(columns, fields, block, payloads)
            at = end
        return columns

    return map_batches(near, make, RECORD)


def add(columns: dict, fields: dict, block: bytes, payloads: bool) -> None:
    number = lambda k: int(v) if (v := fields[k][len("<urn:page:") : -1]) else None
    response = fields["WARC-Type"] == "response"
    digest = hashlib.sha1(block).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if response and (digest != fields["WARC-Payload-Digest"].removeprefix("sha1:") or len(block) != int(fields["X-Payload-Length"])):
        raise ValueError("a WARC payload is not what its digest says")
    for name, value in (
        ("page_id", number("WARC-Record-ID")), ("url", fields["WARC-Target-URI"]), ("record_type", fields["WARC-Type"]), ("refers_to", None if response else number("WARC-Refers-To")),
        ("payload", block if payloads and response else None), ("payload_bytes", int(fields["X-Payload-Length"])), ("payload_digest", digest),
    ):
        columns[name].append(value)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write(read(spark, sf_dir, "pages")), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN m USING (d)
"""
