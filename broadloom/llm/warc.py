"""Writing and reading WARC archives, with boundary-chain verification.

Archives are uncompressed and read in splits, however large a file is. A task cuts its split at every
``CRLF CRLF WARC/1.0 CRLF``, which may as well stand inside a payload, and emits each candidate with the offset its own
header names as its successor's. Only what the chain from the file's start reaches is a record: each split's chains
are contracted to their exits, pointer jumping over the exits finds where the chain enters each split, and the split's
candidates on the chain are kept. A record whose payload holds such a mark is put together again from its parts.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from broadloom.session import durable, new_path

MAGIC = b"WARC/1.0\r\n"
BETWEEN = b"\r\n\r\n"
MARK = BETWEEN + MAGIC
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)", re.M)
PAGE = "urn:x-page:"
META = ("file string, block bigint, i bigint, at bigint, size bigint, header_bytes bigint, content_bytes bigint, exit bigint, type string, "
        "page_id bigint, uri string, refers_to bigint, declared_digest string, declared_bytes bigint, payload_digest string, payload_bytes bigint")


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 100,
               date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per row, each task's rows in one file under ``path``.

    Of rows with equal payloads of at least ``least_bytes`` those with the smallest id are responses, the others
    revisits of it without payload (rows that repeat the smallest id are responses all; a NULL id is never the
    smallest). NULL payloads are empty. CR, LF in URLs are percent-encoded; NULL URLs and ids name no such header. Payloads
    do not move: only digests and ids are shuffled, and the table of repeated payloads is joined by whatever way its
    written size suggests to Spark.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("id"), F.col(url).alias("url"), body.alias("body"),
                        F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).cast("bigint").alias("bytes"))
    repeated = durable(rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("digest", "first"))
    rows = rows.join(repeated, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    ident = lambda c: F.concat(F.lit("<" + PAGE), c.cast("string"), F.lit(">"))
    content = F.lit(len(HTTP)) + F.when(again, F.lit(0)).otherwise(F.col("bytes"))
    record = F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        optional("WARC-Record-ID", ident(F.col("id"))), optional("WARC-Target-URI", safe), line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(again, F.concat(line("WARC-Refers-To", ident(F.col("first"))), line(
            "WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", content.cast("string")),
        F.lit("\r\n" + HTTP), F.when(again, "").otherwise(F.col("body")))
    rows.select(record.alias("value")).write.option("lineSep", BETWEEN.decode()).text(path)


def _page(value: bytes | None) -> int | None:
    m = re.search(rb"x-page:(-?\d+)", value or b"")
    return int(m[1]) if m else None


def _payload(block: bytes, content_type: bytes) -> bytes:
    """What follows the HTTP header, or the whole block if there is none."""
    if not content_type.lower().startswith(b"application/http"):
        return block
    end = block.find(BETWEEN)
    return block[end + 4:] if end >= 0 else b""


def _header(chunk: bytes) -> tuple[int, dict[bytes, bytes]]:
    """Bytes of the header with its blank line, and its fields; a chunk that is all header ends where the mark began."""
    end = chunk.find(BETWEEN)
    head = chunk if end < 0 else chunk[:end]
    return len(head) + 4, {k.strip().lower(): v.strip() for k, v in FIELD.findall(head)}


def _candidates(batches):
    """Candidates of each split with their successors. ``at`` and ``exit`` are the places behind a candidate's magic,
    counted from the split's first chunk."""
    held, split, at = [], None, 0

    def out():
        exits: dict[int, int] = {}
        for row in reversed(held):  # the chain from each candidate to beyond the split
            if row[6] is not None:
                after = row[3] + row[5] + row[6] + len(BETWEEN) + len(MAGIC)
                exits[row[3]] = row[7] = exits.get(after, after)
        for i in range(0, len(held), 4096):
            columns = list(zip(*held[i:i + 4096]))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, TYPES)], names=NAMES)

    for batch in batches:
        for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
            if (file, block) != split:
                yield from out()
                held, split, at = [], (file, block), 0
            size, row = len(value), [None] * len(NAMES)
            row[:5] = file, block, len(held), at, size
            begins = block == 0 and at == 0
            if not begins or value.startswith(MAGIC):
                chunk = value[len(MAGIC):] if begins else value
                length, fields = _header(chunk)
                if re.fullmatch(rb"\d{1,18}", fields.get(b"content-length", b"")):
                    n = int(fields[b"content-length"])
                    row[5], row[6] = length, n
                    kind = fields.get(b"warc-type", b"")
                    row[8:14] = (kind.decode("utf-8", "replace"), _page(fields.get(b"warc-record-id")), fields[b"warc-target-uri"].decode("utf-8", "replace")
                                 if b"warc-target-uri" in fields else None, _page(fields.get(b"warc-refers-to")), fields.get(
                        b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha256:") or None, int(
                        fields[b"x-payload-length"]) if fields.get(b"x-payload-length", b"").isdigit() else None)
                    if length + n <= len(chunk):  # the whole block lies in this chunk
                        p = _payload(chunk[length:length + n], fields.get(b"content-type", b""))
                        row[14], row[15] = hashlib.sha256(p).hexdigest(), len(p)
            if begins:
                row[3] = len(MAGIC)  # the others' magic was cut off with the mark
            at += size + len(MARK)
            held.append(row)
    yield from out()


NAMES = [f.split()[0] for f in META.split(", ")]
TYPES = [pa.string() if f.split()[1] == "string" else pa.int64() for f in META.split(", ")]


def _on_chain(pdf):
    """Follow the chain from the split's entry."""
    after = dict(zip(pdf["start"].tolist(), pdf["next"].tolist()))
    at = pdf.loc[pdf["entry"], "start"].tolist()
    reached = set()
    if at:
        x = at[0]
        while x in after and x not in reached:
            reached.add(x)
            x = after[x]
    return pdf.assign(reached=pdf["start"].isin(reached)).drop(columns=["entry"])


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MARK.decode()).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"), F.col("value").cast("binary").alias("value"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Verified records: file, offset, record_bytes, type, page_id, uri, refers_to, declared_digest, declared_bytes,
    payload_digest, payload_bytes (both of the payload read; NULL where the record is cut off), one row each.

    A file that does not begin with a record yields none, and the chain ends where no candidate follows: what lies
    beyond damage is not trusted. Empty folders and files give no rows. The archives are read once; twice if some
    payload holds a record's mark, and then only the parts of such records are shuffled.
    """
    chunks = _chunks(spark, path)
    meta = durable(chunks.select("file", "block", "value").mapInArrow(_candidates, META))
    # Offsets in the file: the chunks tile it, so a split begins where the sum of those before ends.
    splits = meta.groupBy("file", "block").agg(F.sum(F.col("size") + len(MARK)).alias("bytes"))
    splits = splits.withColumn("base", F.sum("bytes").over(W.partitionBy("file").orderBy("block")) - F.col("bytes"))
    shift = F.col("base") - len(MAGIC)
    placed = durable(meta.join(splits.select("file", "block", "base"), ["file", "block"]).withColumn("start", shift + F.col("at")).withColumn(
        "next", F.col("start") + len(MAGIC) + F.col("header_bytes") + F.col("content_bytes") + len(BETWEEN)).withColumn(
        "exit", shift + F.col("exit")).drop("at", "base"))

    jumps = placed.filter("exit is not null").select("file", "start", "exit")
    entries = durable(jumps.filter("start = 0").select("file", "start"))
    n = entries.count()
    while True:  # entries after 1, 2, 4, ... further splits
        far = entries.join(jumps, ["file", "start"]).select("file", F.col("exit").alias("start")).join(jumps, ["file", "start"], "left_semi")
        entries = durable(entries.union(far).distinct())
        now = entries.count()
        if now == n:
            break
        n, jumps = now, durable(jumps.join(jumps.select("file", F.col("start").alias("exit"), F.col("exit").alias("beyond")), [
            "file", "exit"], "left").select("file", "start", F.coalesce("beyond", "exit").alias("exit")))
    flagged = placed.join(entries.withColumn("entry", F.lit(True)), ["file", "start"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    light = flagged.filter("next is not null").select("file", "block", "i", "start", "next", "entry")
    chain = light.groupBy("file", "block").applyInPandas(_on_chain, "file string, block bigint, i bigint, start bigint, next bigint, reached boolean")
    records = durable(placed.join(chain.filter("reached").select("file", "block", "i"), ["file", "block", "i"]))
    torn = records.filter("payload_digest is null")
    if not torn.isEmpty():
        mended = _mend(chunks, placed, records, torn)
        records = records.join(mended, ["file", "start"], "left").withColumn("payload_digest", F.coalesce("payload_digest", "m_digest")).withColumn(
            "payload_bytes", F.coalesce("payload_bytes", "m_bytes"))
    return records.select("file", F.col("start").alias("offset"), (F.col("next") - F.col("start")).alias("record_bytes"), "type", "page_id", "uri",
                          "refers_to", "declared_digest", "declared_bytes", "payload_digest", "payload_bytes")


def _numbered(batches):
    split, i = None, 0
    for batch in batches:
        out = []
        for s in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
            i = i + 1 if s == split else 0
            split = s
            out.append(i)
        yield pa.record_batch([batch.column("file"), batch.column("block"), pa.array(out, pa.int64()), batch.column("value")],
                              names=["file", "block", "i", "value"])


def _mend(chunks: DataFrame, placed: DataFrame, records: DataFrame, torn: DataFrame) -> DataFrame:
    """(file, start, m_digest, m_bytes) of records cut at marks in their payloads: the chunks up to the next record."""
    marked = placed.select("file", "block", "i", "start").join(records.select("file", "block", "i", F.col("start").alias("own")), ["file", "block", "i"], "left")
    here = F.max("own").over(W.partitionBy("file", "block").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    before = marked.groupBy("file", "block").agg(F.max("own").alias("top"))
    before = before.withColumn("carried", F.max("top").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    owned = marked.withColumn("here", here).join(before.select("file", "block", "carried"), ["file", "block"]).select(
        "file", "block", "i", F.coalesce("here", "carried").alias("start"))
    parts = owned.join(torn.select("file", "start", "content_bytes"), ["file", "start"])
    values = chunks.select("file", "block", "value").mapInArrow(_numbered, "file string, block bigint, i bigint, value binary")

    def mend(pdf):
        pdf = pdf.sort_values(["block", "i"])
        whole = MARK.join(pdf["value"])
        whole = whole[len(MAGIC):] if pdf["start"].iloc[0] == 0 else whole
        length, fields = _header(whole)
        block = whole[length:length + int(pdf["content_bytes"].iloc[0])]
        cut = len(block) < pdf["content_bytes"].iloc[0]
        p = _payload(block, fields.get(b"content-type", b""))
        return pdf.iloc[:1][["file", "start"]].assign(m_digest=None if cut else hashlib.sha256(p).hexdigest(), m_bytes=None if cut else len(p))

    return values.join(parts, ["file", "block", "i"]).groupBy("file", "start").applyInPandas(
        mend, "file string, start bigint, m_digest string, m_bytes bigint")


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and read them back: one row per page, revisits with what they refer to."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(pages, path, page_id, url, payload)
    back = read_warc(spark, path)
    again: Column = F.col("type") == "revisit"
    return back.select("page_id", F.when(again, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                       F.when(again, F.col("declared_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
                       F.col("type").alias("record_type"), "refers_to")
