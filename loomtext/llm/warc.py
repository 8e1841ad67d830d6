"""WARC records as a table of chunks.

A record is stored as rows (record, chunk, n_chunks, body, digest): the bodies of a record's chunks in order are its
bytes in a WARC file, head first.  Payloads are cut into chunks before they leave the JVM, and each row carries the
SHA-256 of the payload up to and with its chunk, so writer and reader hash as they stream, check each chunk, and hold
one chunk of a record at a time.  A first pass over the chunks tells each payload's digest; equal digests meet without
their payloads, hot ones cut into parts, and payloads are shuffled once, by page.  Of records with equal payloads of ``LEAST`` (100) bytes or more, that of the smallest
page_id is a response and the others are revisits of it, which name the payload's digest and length but hold no
payload; smaller payloads are always responses.

A null html counts as empty; a null url leaves the target out; a null page_id can revisit another but is never the
response that others name, unless all ids of its payload are null: then all are responses.  Rows repeated with the
smallest page_id are all responses.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import NULL_ID, join_split, materialize, partitions, steps, table

LEAST, CHUNK = 100, 1 << 20
CHUNKS = "record string, chunk bigint, n_chunks bigint, body binary, digest string"
_CHUNKS = pa.schema([("record", pa.string()), ("chunk", pa.int64()), ("n_chunks", pa.int64()), ("body", pa.binary()), ("digest", pa.string())])


def head(kind: str, record: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    length = 0 if kind == "revisit" else size
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{record}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _cut(pages: DataFrame, columns: list[str | Column], chunk_bytes: int, whole: Column) -> DataFrame:
    """``columns``, chunk, n_chunks and piece: a row for each chunk of ``html``, a page's chunks one after another.

    Where ``whole`` is false the payload is left out.
    """
    html = F.when(whole, F.col("html")).otherwise(F.lit(b""))
    last = F.greatest(F.floor((F.octet_length(html) - 1) / chunk_bytes), F.lit(0)).cast("int")
    rows = pages.select(*columns, html.alias("html"), (last + 1).cast("long").alias("n_chunks"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks").cast("int") - 1)))
    return rows.withColumn("piece", F.substring("html", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))).drop("html")


DIGESTS = "page bigint, twin bigint, size bigint, digest string"
_DIGESTS = pa.schema([("page", pa.int64()), ("twin", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])


def _digested(batches):
    """The digest of each payload from its chunks."""
    digest = None
    for batch in steps(batches, "piece"):
        out = []
        for page, twin, size, n, k, piece in zip(*(batch.column(x).to_pylist() for x in ("page", "twin", "size", "n_chunks", "chunk", "piece")), strict=True):
            digest = hashlib.sha256() if not k else digest
            digest.update(piece)
            if k == n - 1:
                out.append((page, twin, size, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _DIGESTS, strict=True)], schema=_DIGESTS)


def _written(batches):
    digest = None
    for batch in steps(batches, "piece"):
        out = []
        for row in batch.to_pylist():
            k, last = row["chunk"], row["chunk"] == row["n_chunks"] - 1
            kind = "response" if row["refers_to"] is None else "revisit"
            opening = b"" if k else head(kind, row["record"], row["page_id"], row["url"], row["digest"], row["size"], row["refers_to"])
            digest = digest if k else hashlib.sha256()
            digest.update(row["piece"])
            if last and kind == "response" and digest.hexdigest() != row["digest"]:
                raise ValueError(f"the payload of page {row['page_id']} changed between two readings")
            out.append({"record": row["record"], "chunk": k, "n_chunks": row["n_chunks"], "body": b"".join((opening, row["piece"], b"\r\n\r\n" if last else b"")), "digest": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema=_CHUNKS)


def write(pages: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """Write a record for each page; returns the written chunk table."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    rows = rows.select("*", F.coalesce("page_id", F.lit(NULL_ID)).alias("page"), F.xxhash64("html").alias("twin"), F.octet_length("html").cast("long").alias("size"))
    told = materialize(_cut(rows, ["page", "twin", "size"], chunk_bytes, F.lit(True)).mapInArrow(_digested, DIGESTS), "warc-digests")
    # payloads that stand more than once, by their digests alone
    large = told.where(F.col("size") >= LEAST)
    first = large.groupBy("digest").agg(F.min(F.when(F.col("page") != NULL_ID, F.col("page"))).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first, "warc-firsts")
    refers = F.when(F.col("least") != F.col("page"), F.col("least")).alias("refers_to")
    named = join_split(large, first, ["digest"], F.xxhash64("page", "twin"), first.agg(F.sum("n")).first()[0] or 0, "left").select("page", "twin", "size", "digest", refers)
    named = named.unionByName(told.where(F.col("size") < LEAST).withColumn("refers_to", F.lit(None).cast("bigint"))).distinct()
    records = rows.join(named, ["page", "twin", "size"]).withColumn("record", F.expr("uuid()"))
    chunks = _cut(records, ["page_id", "url", "size", "digest", "refers_to", "record"], chunk_bytes, F.col("refers_to").isNull())
    return materialize(chunks.mapInArrow(_written, CHUNKS), "warc")


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


class Reader:
    """Takes a record's chunks in order; holds its head and digest only."""

    def __init__(self, body: bytes):
        end = body.index(b"\r\n\r\n") + 4
        version, *lines = body[: end - 4].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        self.fields = dict(line.split(": ", 1) for line in lines)
        self.left, self.start, self.digest = int(self.fields["Content-Length"]), end, hashlib.sha256()

    def take(self, body: bytes, told: str) -> None:
        piece = memoryview(body)[self.start :][: self.left]
        self.digest.update(piece)
        self.left, self.start = self.left - len(piece), 0
        if self.digest.hexdigest() != told:
            raise ValueError(f"a chunk of {self.fields['WARC-Record-ID']} differs from its digest")

    def row(self) -> dict:
        f = self.fields
        digest, kind = f["WARC-Payload-Digest"].removeprefix("sha256:"), f["WARC-Type"]
        if self.left or kind == "response" and digest != self.digest.hexdigest():
            raise ValueError(f"{f['WARC-Record-ID']} is cut short or changed")
        refers = f.get("WARC-Refers-To")
        return {"page_id": int(f["X-Page-ID"]) if "X-Page-ID" in f else None, "payload_bytes": int(f["X-Payload-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": refers and int(refers.removeprefix("<urn:page:").rstrip(">"))}


def _read(batches):
    reader, record = None, None
    for batch in steps(batches, "body"):
        out = []
        for name, chunk, n_chunks, body, digest in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if not chunk:
                reader, record = Reader(body), name
            elif record != name:
                raise ValueError(f"record {name} lacks its first chunks")
            reader.take(body, digest)
            if chunk == n_chunks - 1:
                out.append(reader.row())
        yield pa.RecordBatch.from_pylist(out, schema=_READ)


def read(chunks: DataFrame) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    whole = chunks.where("n_chunks = 1")
    many = chunks.where("n_chunks > 1").repartition(partitions(chunks.sparkSession), "record").sortWithinPartitions("record", "chunk")
    return whole.mapInArrow(_read, READ).unionByName(many.mapInArrow(_read, READ))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages")))


def op7_sql() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT d, min(page_id) AS least FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN least IS NULL OR least = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN least IS NOT NULL AND least <> page_id THEN least END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
