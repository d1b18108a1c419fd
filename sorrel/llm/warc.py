"""Web archives: writing records, and finding them again by boundary-chain verification.

A WARC file has no index, and the magic that begins a record may also occur inside a payload. Tasks scan
archives and emit, for each occurrence, a candidate edge from its offset to the offset where its
declared length says that the next record begins. Pointer jumping from each file's start, doubling the
distance by a join in every round, then keeps the candidates that the chain reaches and rejects the rest.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, table

CRLF, RECORD_END = "\r\n", "\r\n\r\n"
ID = "urn:sorrel:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
#: An archive is scanned as one row, so it holds 32 MB at most, a single longer record excepted: records of so many bytes and how many of them a file takes.
ARCHIVE = 32 << 20
SIZES = [(0, 1 << 15, 1024), (1 << 15, 1 << 20, 32), (1 << 20, 1 << 62, 1)]
#: More bytes than a record has beside its payload and url.
ALLOWANCE = 2048
CANDIDATES = "file string, off long, next long, size long, kind string, record string, refers string, declared string, found string, payload_bytes long"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 40 bits of the hex form are eight digits."""
    h = F.sha1(payload)
    chunks = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*chunks), HEX32, BASE32)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 1024, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row below ``path``, in any store that Spark writes to.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest id is a
    response and the others are revisits that refer to it and hold no payload. Null payloads are
    empty; null urls have no target line; a null id is never the largest unless alone; a row that repeats the
    largest id is a response too; other columns are ignored; an empty table gives no record.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    # Payloads of one SHA-1 may be made to differ: equal ones share their SHA-256 too.
    rows = rows.withColumn("digest", base32_sha1("payload")).withColumn("n", F.octet_length("payload").cast("long")).withColumn("strong", F.sha2("payload", 256))
    # Only payloads that occur more than once matter here. The table is written first, so that its size is
    # known: small, it is broadcast and payloads are not shuffled; large, both sides are.
    repeated = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n", "strong").agg(F.max("id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    joined = rows.join(materialize(repeated, "repeated"), ["digest", "n", "strong"], "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    n = F.col("n").cast("string")
    line = lambda k, *v: F.concat(F.lit(f"{k}: "), *v, F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), line("Content-Length", n), F.lit(CRLF))
    block = F.when(refers.isNotNull(), http).otherwise(F.concat(http, F.col("payload")))
    length = F.when(refers.isNotNull(), F.octet_length(http)).otherwise(F.octet_length(http) + F.col("n"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(refers.isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("id"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("digest")),
        F.when(refers.isNotNull(), F.concat(line("WARC-Refers-To", name(refers)), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
    )
    # No header but for the url is longer than the allowance.
    most = F.col("n") + F.coalesce(F.octet_length("url"), F.lit(0)) + ALLOWANCE
    longest, total = (x or 0 for x in rows.agg(F.max(most), F.sum(most)).first())
    # Records go to files by their size, so that a file's bound holds whatever sizes are side by side.
    sizes = [s for s in SIZES if s[0] <= longest] if total > ARCHIVE else SIZES[:1]
    for low, high, fits in sizes:
        part = joined.where((most >= low) & (most < high)) if len(sizes) > 1 else joined
        part.select(F.concat(header, block).alias("record")).write.mode("append").option("lineSep", RECORD_END).option("maxRecordsPerFile", min(fits, records_per_file)).text(path)


FIELDS = (b"content-length", b"warc-type", b"warc-record-id", b"warc-refers-to", b"warc-payload-digest")


def headers(content: bytes):
    """``(off, end, fields)`` of each place where a header begins, however long it is; ``end`` is where its empty line begins.

    Places with one end are read together, from the end on, so that many of them cost no more than their bytes.
    """
    marks, k = [m.span() for m in MAGIC.finditer(content)], 0
    while k < len(marks):
        end = content.find(b"\r\n\r\n", marks[k][0])
        if end < 0:
            return
        last = k
        while last < len(marks) and marks[last][0] < end:
            last += 1
        rows, fields, at, found = content[marks[k][1] : end].split(b"\r\n"), {}, end, []
        for off, begin in reversed(marks[k:last]):
            while rows and at - len(rows[-1]) >= begin:
                row = rows.pop()
                at -= len(row) + 2
                name, sep, v = row.partition(b":")
                name = name.strip().lower()
                if sep and name in FIELDS and name not in fields:
                    fields = {**fields, name: v.strip().decode("utf-8", "replace")}
            found.append((off, end, fields))
        yield from reversed(found)
        k = last


def candidates(name: str, content: bytes) -> list[tuple]:
    """All places of a file where a record may begin, with what its header says; ``next`` is -1 where the record cannot be whole."""
    out, hashed = [], (None, None)
    for at, end, fields in headers(content):
        if not fields.get(b"content-length", "").isdigit():
            continue
        body, stop = end + 4, end + 4 + int(fields[b"content-length"])
        after = stop + 4 if content[stop : stop + 4] == b"\r\n\r\n" else -1
        split = content.find(b"\r\n\r\n", body, stop)
        http = content[body : split + 4 if split >= 0 else stop]
        kind, found, n = fields.get(b"warc-type"), None, None
        if after > 0 and kind == "response":
            payload = memoryview(content)[body + len(http) : stop]
            if hashed[0] != (body, stop):
                hashed = (body, stop), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            found, n = hashed[1], len(payload)
        elif after > 0 and kind == "revisit":
            # A revisit keeps the headers of the response, whose length field is that of the whole payload.
            declared = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
            n = int(declared[1]) if declared else None
        digest = fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
        out.append((name, at, after, len(content), kind, fields.get(b"warc-record-id"), fields.get(b"warc-refers-to"), digest or None, found, n))
    return out


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The candidates of all files below ``path``; a task holds one file at a time if batches hold one row."""

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64()]
        names = [f.split()[0] for f in CANDIDATES.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = candidates(name, content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CANDIDATES)


def reachable(found: DataFrame, max_rounds: int = 64) -> DataFrame:
    """The ``(file, off)`` of candidates ``(file, off, next)`` on the chain from each file's start.

    A candidate without a whole record (``next`` -1) ends the chain and is not on it. In round k every pointer spans 2**k records; one join moves the pointers and the reached set alike.
    """
    jump = found.where("next > 0").select("file", "off", F.col("next").alias("to"))
    offs = found.where("next > 0").select("file", "off")
    state = materialize(
        jump.select("file", "off", "to", F.lit(False).alias("root")).unionAll(offs.where("off = 0").select("file", F.lit(-1).cast("long").alias("off"), F.col("off").alias("to"), F.lit(True).alias("root"))), "chain"
    )
    before = -1
    for _ in range(max_rounds):
        now = state.where("root").count()
        if now == before:
            break
        before = now
        pointers = state.where("not root").select("file", F.col("off").alias("to"), F.col("to").alias("far"))
        moved = state.join(pointers, ["file", "to"]).select("file", "off", F.col("far").alias("to"), "root")
        roots = state.where("root").unionByName(moved.where("root")).select("file", F.lit(-1).cast("long").alias("off"), "to", F.lit(True).alias("root")).distinct()
        state = materialize(roots.unionByName(moved.where("not root")), "chain")
    else:
        raise RuntimeError("a chain did not end")
    # The last pointer of a whole file leads to its end, where no candidate is.
    return state.where("root").select("file", F.col("to").alias("off")).join(offs, ["file", "off"], "left_semi")


def read_archives(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """The records of all archives below ``path``: ``(record_id, kind, refers_id, payload_bytes, payload_digest)``.

    Ids are those of ``write_archives`` as text. A response whose payload does not have the digest that it
    declares is an error. Of a damaged file the records before the damage are returned; if archives must be
    ``whole``, a file whose chain of records does not reach its end is an error instead. Header fields
    other than those returned are left alone.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "1")
    try:
        found = materialize(scan(spark, path), "candidates")
    finally:
        spark.conf.set(batch, before)
    rows = found.join(reachable(found), ["file", "off"])
    if whole:
        rows = materialize(rows, "records")
        ends = rows.groupBy("file").agg(F.max("next").alias("end"))
        sizes = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
        short = sizes.join(ends, "file", "left").where(F.col("length") != F.coalesce("end", F.lit(0))).select("file").head(3)
        if short:
            raise ValueError(f"the records do not reach the end of {', '.join(r['file'] for r in short)}")
    own = lambda c: F.nullif(F.regexp_extract(c, f"^<{ID}(.*)>$", 1), F.lit("null"))
    bad = (F.col("kind") == "response") & ~F.col("found").eqNullSafe(F.col("declared"))
    digest = F.when(bad, F.raise_error(F.concat(F.lit("payload digest differs: "), "record"))).otherwise(F.col("declared"))
    return rows.select(own("record").alias("record_id"), "kind", F.when(F.col("kind") == "revisit", own("refers")).alias("refers_id"), "payload_bytes", digest.cast("string").alias("payload_digest"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as archives and read back."""
    path = scratch(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    got = read_archives(spark, path, whole=True)
    return got.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_id").cast("long").alias("refers_to")
    )


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(sha1(t), (1 + 10 * (i // 8))::BIGINT, 10))::BIGINT) >> (35 - 5 * (i % 8))::BIGINT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p
"""
