"""WARC archives: written by Spark's text writer, read back and assembled into transactions.

write_archive() turns each page into a request, a response (or a revisit of the response with the same
payload) and a metadata record, concurrent to one another, and writes them uncompressed inside but gzipped as files.
read_records() splits the files at the record boundary, so a file is streamed and its size doesn't matter. Each record's
Content-Length is held against what came: only files in which a payload itself contains the boundary are read
again, whole, by a parser that goes by Content-Length. captures() brings request, response and metadata records together by
WARC-Concurrent-To in one shuffle and emits one nested row for each capture; a revisit finds its response through
WARC-Refers-To. Digests are worked out from the payloads read back.

Defined results: a null html is an empty payload; equal payloads of `least` bytes or more have one response, that of the
smallest page_id (then of the smallest row), which the others revisit; smaller payloads are all responses; repeated
page rows are captures of their own; a null url is written as an empty target; a null page_id sorts first and reads
back as null; records of a kind that isn't known are ignored by captures(); an empty table gives no records.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabriloom.llm.common import new_path, stage
from fabriloom.llm import textops as T

#: The record boundary, the format's version line and the date of all records.
BREAK, VERSION, DATE = "\r\n\r\n", "WARC/1.0\r\n", "2024-01-01T00:00:00Z"
#: Repeated digests up to which they are broadcast (about 100 bytes each).
BROADCAST_ROWS = 100_000
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: four runs of 40 bits, each 8 digits."""
    digest = F.sha1(data)
    return F.concat(*(F.translate(F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0"), _HEX32, _BASE32) for i in range(4)))


def transactions(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload, digest, ids of the records, and for revisits that of the response."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("capture", F.uuid())
    rows = stage(rows.select("page_id", "url", "capture", "digest", F.octet_length("payload").alias("size"), "payload"), "pages")
    # firsts are combined by payload before the shuffle; the payloads meet only the few digests that repeat
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "capture")
    firsts = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.col("first.capture").alias("first_capture"), F.lit(True).alias("repeats"))
    small = rows.where(F.col("size") < least).withColumn("first_capture", F.lit(None).cast("string"))
    # few repeated digests are broadcast, so that payloads aren't shuffled
    firsts = stage(firsts, "firsts")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    large = rows.where(F.col("size") >= least).join(firsts, "digest", "left").select(*small.columns)
    return large.unionByName(small).withColumn("refers", F.when(F.col("first_capture") != F.col("capture"), F.col("first_capture")))


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """The record's bytes without the boundary behind it, as a string column that holds any bytes."""
    head = [F.lit(f"{VERSION}WARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:"), record_id, F.lit(f">\r\nWARC-Date: {DATE}")]
    for name, value in headers:
        head += [F.lit(f"\r\n{name}: "), value]
    head += [F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(BREAK)]
    return F.concat(F.concat(*head).cast("binary"), block).cast("string")


def records(rows: DataFrame) -> DataFrame:
    """The archive's records, one string each, of transactions()."""
    url = F.regexp_replace("url", r"[\r\n]", " ")
    concurrent = ("WARC-Concurrent-To", F.concat(F.lit("<urn:uuid:"), F.col("capture"), F.lit(">")))
    target = ("WARC-Target-URI", url)
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + BREAK).cast("binary")
    request = _record("request", F.concat("capture", F.lit("-q")), [concurrent, target, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1" + BREAK)).cast("binary"))
    response = _record("response", F.col("capture"), [target, digest, ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.col("payload")))
    refers = ("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), F.coalesce("refers", F.lit("")), F.lit(">")))
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))
    revisit = _record("revisit", F.col("capture"), [target, digest, refers, profile, ("Content-Type", F.lit("application/http; msgtype=response"))], http)
    fields = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")).cast("binary")
    metadata = _record("metadata", F.concat("capture", F.lit("-m")), [concurrent, ("Content-Type", F.lit("application/warc-fields"))], fields)
    return rows.select(F.explode(F.array(request, F.when(F.col("refers").isNull(), response).otherwise(revisit), metadata)).alias("record"))


def write_archive(pages: DataFrame, path: str, least: int = 0) -> None:
    records(transactions(pages, least)).write.option("lineSep", BREAK).option("compression", "gzip").text(path)


_SCHEMA = "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, digest string, content_type string, block binary, whole boolean"


def parsed(raw: DataFrame) -> DataFrame:
    """Records in columns; whole tells whether the block is as long as Content-Length says."""
    data = F.col("raw")
    end = F.instr(data, BREAK)
    df = raw.select("path", "raw", F.when(end > 0, F.substring(data, F.lit(1), end - 1)).otherwise(data).alias("head"))
    size = F.octet_length("head") + len(BREAK)
    body = F.substring(F.col("raw").cast("binary"), size + 1, F.greatest(F.octet_length("raw") - size, F.lit(0)))

    def header(name: str) -> Column:
        got = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
        return F.when(got != "", F.regexp_replace(got, r"^<urn:uuid:(.*)>$", "$1"))

    df = df.select("path", header("WARC-Type").alias("warc_type"), header("WARC-Record-ID").alias("record_id"), header("WARC-Concurrent-To").alias("concurrent_to"), header("WARC-Refers-To").alias("refers_to"), header("WARC-Target-URI").alias("target_uri"), header("WARC-Payload-Digest").alias("digest"), header("Content-Type").alias("content_type"), header("Content-Length").try_cast("long").alias("length"), body.alias("block"))
    # the last record of a file comes with the boundary behind it
    last = F.col("block").substr(F.greatest(F.octet_length("block") - 3, F.lit(1)), F.lit(4)) == F.lit(BREAK).cast("binary")
    cut = last & (F.octet_length("block") == F.col("length") + len(BREAK))
    df = df.withColumn("block", F.when(cut, F.substring(F.col("block"), F.lit(1), F.col("length").cast("int"))).otherwise(F.col("block")))
    return df.withColumn("whole", F.coalesce(F.octet_length("block") == F.col("length"), F.lit(False))).drop("length")


def _by_length(batches):
    """Records of whole archive files, found by Content-Length alone."""
    for batch in batches:
        for path, content in zip(T.column(batch, "path").to_pylist(), T.column(batch, "content")):
            import gzip

            data = content.as_py()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            at, raw = 0, []
            while (end := data.find(BREAK.encode(), at)) >= 0:
                head = data[at:end]
                size = next((int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                raw.append(data[at : end + 4 + size])
                at = end + 4 + size + len(BREAK)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(raw), pa.string()), pa.array(raw, pa.binary())], names=["path", "raw"])


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under a path: warc_type, record_id, concurrent_to, refers_to, target_uri, digest (as the header
    says), payload_bytes and payload_digest (of what was read), text of records of other kinds, and payload. Without payloads
    the files are read once, and what is left of the records is staged."""
    lines = spark.read.option("lineSep", BREAK + VERSION).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    raw = lines.select("path", F.when(F.startswith("value", F.lit(VERSION)), F.substring("value", len(VERSION) + 1, 2**31 - 1)).otherwise(F.col("value")).alias("raw"))
    found = digested(parsed(raw.where("raw <> ''")), payloads)
    found = found if payloads else stage(found, "records")
    torn = [r["path"] for r in found.where("not whole").select("path").distinct().collect()]
    if not torn:
        return found.drop("whole", "path")
    again = spark.read.format("binaryFile").load(torn).select("path", "content").mapInArrow(_by_length, "path string, raw binary")
    again = parsed(again.select("path", F.substring(F.col("raw"), F.lit(len(VERSION) + 1), F.lit(2**31 - 1)).cast("string").alias("raw")))
    return found.where(~F.col("path").isin(torn)).unionByName(digested(again, payloads)).drop("whole", "path")


def digested(found: DataFrame, payloads: bool) -> DataFrame:
    """Records with what their blocks hold: of responses and revisits the payload behind the HTTP head, of others the text."""
    main = F.col("warc_type").isin("response", "revisit")
    http_end = F.instr(F.col("block").cast("string"), BREAK)
    head = F.octet_length(F.substring(F.col("block").cast("string"), F.lit(1), http_end - 1)) + len(BREAK)
    payload = F.when(http_end > 0, F.substring(F.col("block"), head + 1, F.octet_length("block") - head)).otherwise(F.col("block"))
    rows = found.withColumn("payload", F.when(main, payload))
    digest = F.when(F.col("warc_type") == "response", base32_sha1(F.col("payload")))
    return rows.select("path", "whole", "warc_type", "record_id", "concurrent_to", "refers_to", "target_uri", F.regexp_replace("digest", "^sha1:", "").alias("digest"), F.octet_length("payload").alias("payload_bytes"), digest.alias("payload_digest"), F.when(~main, F.col("block").cast("string")).alias("text"), *(["payload"] if payloads else []))


def captures(found: DataFrame) -> DataFrame:
    """One nested row for each response or revisit: the record, its requests and its metadata, which meet in one shuffle by the
    record id that they are concurrent to."""
    main = F.col("warc_type").isin("response", "revisit")
    fields = [c for c in found.columns if c not in ("record_id", "concurrent_to", "text")]
    side = F.struct(F.col("record_id").alias("id"), "target_uri", "text")
    rows = found.where(main | F.col("warc_type").isin("request", "metadata")).select(
        F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("record_id"), F.when(main, F.struct(*fields)).alias("response"),
        *(F.when(F.col("warc_type") == kind, side).alias(kind) for kind in ("request", "metadata")),
    )
    got = rows.groupBy("record_id").agg(F.first("response", ignorenulls=True).alias("response"), *(F.sort_array(F.collect_list(kind)).alias(name) for kind, name in (("request", "requests"), ("metadata", "metadata"))))
    return got.where("response is not null")


def page_of(metadata: Column) -> Column:
    return F.regexp_extract(F.get(metadata, 0)["text"], r"page_id: (-?\d+)", 1).try_cast("long")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = captures(read_records(spark, path, payloads=False))
    rows = found.select("record_id", page_of(F.col("metadata")).alias("page_id"), "response.warc_type", F.col("response.refers_to").alias("refers"), F.col("response.payload_bytes").cast("long").alias("payload_bytes"), "response.payload_digest")
    rows = stage(rows, "captures")
    responses = rows.where("warc_type = 'response'")
    first = responses.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    # responses need no look-up; only revisits meet the response they refer to, whose payload is theirs
    direct = responses.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = rows.where("warc_type = 'revisit'").select("page_id", "refers").join(first, "refers", "left").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return direct.unionByName(again)
