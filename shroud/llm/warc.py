"""WARC archives: write captures, read them back, assemble transactions.

Writing: every page becomes three records, request, response (or revisit) and metadata; request and
metadata name the response in WARC-Concurrent-To. A payload of at least `min_bytes` that several
pages share is stored once, by the smallest page id; the others are revisit records that carry the
payload digest and name the stored record in WARC-Refers-To. Every record is a gzip member of its
own, so a reader can seek to it; a file begins with a warcinfo record and ends once it holds
`file_bytes` (compressed). Tasks put the members of a file together, Spark's text writer writes them,
so any store that Spark writes to will do and a lost task rewrites its own files only.

Reading: files are parsed record by record in tasks (one record is in memory at a time beside its
file), then request, response and metadata records are joined through their concurrent-to
identifiers into one nested row per capture. `digest_ok` says of a response whether its payload has
the digest that its record names (null: none named, or of an unknown kind).

Defined cases: null payload = empty; null page id is larger than any id and is written as an empty
field; pages that repeat the smallest id of a group are all responses, of which revisits name none
(the digest still leads there); a record that nothing links
to a response or revisit belongs to no capture; bytes that are no record are skipped up to the next
one, a cut-off last record is left out; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage
from ..sources.tables import read_table
from .common import each, text_or_empty, tidy

CRLF = "\r\n"
RECORD_END = CRLF + CRLF
ANCHORS = ("response", "revisit")
RECORD_SCHEMA = ("record_id string, warc_type string, target_uri string, concurrent_to array<string>, "
                 "payload_digest string, refers_to string, payload_bytes bigint, payload_sha256 string, digest_ok boolean, "
                 "fields map<string,string>, payload binary")
ARROW_SCHEMA = pa.schema([
    ("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()),
    ("concurrent_to", pa.list_(pa.string())), ("payload_digest", pa.string()), ("refers_to", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("digest_ok", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _urn(*seed: Column) -> Column:
    """A urn:uuid from a hash of the seeds."""
    return F.regexp_replace(F.md5(F.concat_ws("|", *seed)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _record(kind: str | Column, record_id: Column, date: str, content_type: str, block: Column, *headers: Column) -> Column:
    """The record without its end; null headers are left out."""
    return F.concat(
        F.concat_ws(CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind),
                    F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {date}"), *headers,
                    F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))),
        F.lit(RECORD_END), block)


#: A gzip member ends with the high byte of its length, 0 under 16 MB; after a longer one this byte is
#: padding, which gzip readers skip.
FILE_END = "\0"


def _member(record: bytes) -> bytes:
    return gzip.compress(record + RECORD_END.encode(), 6, mtime=0)


def _file_info(date: str, software: str) -> bytes:
    """A warcinfo record without its end."""
    block = f"software: {software}{CRLF}format: WARC File Format 1.1{CRLF}"
    return CRLF.join(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{uuid.uuid4().urn}>", f"WARC-Date: {date}",
                      "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", block]).encode()


def _file(members: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members).removesuffix(FILE_END.encode())], pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 32 << 20,
                   software: str = "shroud") -> None:
    """Writes gzip WARC files under `path`, none larger than `file_bytes` by more than one record."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_or_empty(body_col).alias("body"))
    base = base.withColumn("digest", F.sha2("body", 256)).withColumn("bytes", F.octet_length("body"))
    shared = (base.where(F.col("bytes") >= min_bytes).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n")).groupBy("digest")
              .agg(F.min("page_id").alias("first_id"), (F.min_by("n", "page_id") == 1).alias("one_stored"), F.sum("n").alias("n"))
              .where("n > 1").drop("n"))
    stored = F.when(F.col("one_stored"), _urn(F.col("digest"), F.lit("stored")))  # known to the revisits without another join
    tagged = (base.join(shared, "digest", "left")
              .withColumn("revisit", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
              # unique in the whole job, also for rows that repeat; made once a row, so its three records agree
              .withColumn("capture", F.coalesce(F.when(F.col("page_id") == F.col("first_id"), stored),
                                                _urn(F.col("digest"), F.monotonically_increasing_id().cast("string")))))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    uri_header = F.concat(F.lit("WARC-Target-URI: "), uri)
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), F.col("capture"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(RECORD_END))
    get = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{RECORD_END}"))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    records = F.array(
        _record("request", _urn(F.col("capture"), F.lit("request")), date, "application/http; msgtype=request", get, uri_header, concurrent),
        _record(F.when(F.col("revisit"), "revisit").otherwise("response"), F.col("capture"), date,
                "application/http; msgtype=response", F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("body"))),
                uri_header, F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
                F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), stored)),
                F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _record("metadata", _urn(F.col("capture"), F.lit("metadata")), date, "application/warc-fields", fields, uri_header, concurrent))
    def files(batches):
        members, size = [], 0
        for batch in batches:
            for record in each(batch.column(0)):
                if not members:
                    members = [_member(_file_info(date, software))]
                members.append(_member(record))
                size += len(members[-1])
                if size >= file_bytes:
                    yield _file(members)
                    members, size = [], 0
        if members:
            yield _file(members)

    # a row is a file; the row end that the writer adds is the file's last byte
    (tagged.select(F.explode(records.cast("array<binary>")).alias("value")).mapInArrow(tidy(files), "value binary")
     .select(F.col("value").cast("string")).write.option("lineSep", FILE_END).option("maxRecordsPerFile", 1).text(path))


def _headers(stream) -> list[tuple[str, str]]:
    out = []
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out.append((name.strip().lower(), value.strip()))
    return out


#: The type of the row that stands for what could not be read of a file.
CUT_OFF = "cut-off"


def parse_records(content: bytes, cut_off=lambda: None):
    """Yields (headers, block) of each whole record; gzip (any number of members) or plain. Calls
    `cut_off` if the file ends early."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            headers = _headers(stream)
            length = dict(headers).get("content-length", "")
            if not length.isdigit():
                continue
            block = stream.read(int(length))
            if len(block) < int(length):
                cut_off()
                return
            yield headers, block
    except (EOFError, OSError, zlib.error):  # cut off or damaged compression: what follows can't be read
        cut_off()


def digest_holds(named: str | None, payload: bytes) -> bool | None:
    """Whether the payload has the digest `kind:value`, in hex or base 32; null if that can't be told."""
    kind, _, value = (named or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return None
    real = hashlib.new(kind, payload).digest()
    return value.strip().lower() == real.hex() or value.strip().upper().rstrip("=") == base64.b32encode(real).decode().rstrip("=")


def _row(headers: list[tuple[str, str]], block: bytes, with_payload: bool) -> dict:
    h = dict(headers)
    kind, media = h.get("warc-type"), h.get("content-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if media.startswith("application/http") else block
    whole = kind == "response"
    pairs = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if media.startswith("application/warc-fields") else ()
    return {"record_id": h.get("warc-record-id"), "warc_type": kind, "target_uri": h.get("warc-target-uri"),
            "concurrent_to": [v for k, v in headers if k == "warc-concurrent-to"],
            "payload_digest": h.get("warc-payload-digest"), "refers_to": h.get("warc-refers-to"), "payload_bytes": len(payload) if whole else None,
            "payload_sha256": hashlib.sha256(payload).hexdigest() if whole else None,
            "digest_ok": digest_holds(h.get("warc-payload-digest"), payload) if whole else None,
            "fields": list({k.strip(): v.strip() for k, _, v in pairs}.items()), "payload": payload if with_payload else None}


def read_records(spark: SparkSession, path: str, with_payload: bool = True, batch_bytes: int = 8 << 20,
                 names: str = "{part-*,*.warc,*.warc.gz}") -> DataFrame:
    """One row per record of all files under `path` with such names; a file that ends early (cut off or
    damaged) adds a row of type CUT_OFF with its path as target_uri."""
    def parse(batches):
        rows, held = [], 0
        for batch in batches:
            for content, name in zip(*batch.columns):
                cut = []
                for headers, block in parse_records(content.as_py(), lambda: cut.append(name.as_py())):
                    rows.append(_row(headers, block, with_payload))
                    held += 200 + (len(block) if with_payload else 0)
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW_SCHEMA)
                        rows, held = [], 0
                rows += [_row([("warc-type", CUT_OFF), ("warc-target-uri", x)], b"", False) for x in cut]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW_SCHEMA)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path)
    return files.select("content", "path").mapInArrow(parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit record with the arrays `requests` and
    `metadata` of the records tied to it by a concurrent-to identifier, in either direction."""
    anchors = records.where(F.col("warc_type").isin(*ANCHORS))
    others = records.where(~F.col("warc_type").isin(*ANCHORS))
    named = others.select("record_id", F.explode("concurrent_to").alias("anchor_id"))
    naming = anchors.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("anchor_id"))
    links = named.unionByName(naming).distinct()
    body = F.struct("record_id", "target_uri", "fields", "payload").alias("record")
    tied = others.select("record_id", "warc_type", body).join(links, "record_id")
    kinds = (tied.groupBy("anchor_id")
             .agg(F.collect_list(F.when(F.col("warc_type") == "request", F.col("record"))).alias("requests"),
                  F.collect_list(F.when(F.col("warc_type") == "metadata", F.col("record"))).alias("metadata")))
    return (anchors.join(kinds, anchors["record_id"] == kinds["anchor_id"], "left")
            .select(F.struct(*[anchors[c] for c in records.columns if c not in ("concurrent_to", "fields")]).alias("response"), "requests", "metadata"))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Digest columns of every capture: page_id, payload_bytes, payload_digest, record_type, refers_to.
    A revisit takes size and page id from the response that has its payload digest."""
    flat = captures.select(
        F.get("metadata", F.lit(0))["fields"]["page-id"].try_cast("bigint").alias("page_id"),
        F.col("response.warc_type").alias("record_type"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_sha256", F.regexp_replace("response.payload_digest", "^sha256:", "")).alias("payload_digest"))
    stored = flat.where("record_type = 'response'")
    originals = stored.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("original_bytes"))
    revisits = (flat.where("record_type = 'revisit'").join(originals, "payload_digest", "left")
                .select("page_id", F.col("original_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))
    return stored.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to")).unionByName(revisits)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(read_table(spark, sf_dir, "pages"), path)
    records = cut_lineage(read_records(spark, path, with_payload=False))  # narrow; several joins read it
    return resolve_revisits(cut_lineage(assemble(records)))


OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
