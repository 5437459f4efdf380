"""WARC archives: write captures, read records back, assemble transactions through concurrent-to ids.

Archives are gzip files of WARC/1.1 records written by Spark's text sink: a record is one value,
its two closing line ends are the line separator. The reader goes by Content-Length, so payloads
may hold any bytes, blank lines included.
"""

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n"
#: Payloads below this many bytes are never replaced by a revisit record.
LEAST_REVISIT = 100
#: Fixed value of the standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("record_id string, record_type string, concurrent_to array<string>, target_uri string, date string,"
           " payload_digest string, refers_to string, fields map<string, string>, content_length long,"
           " payload_bytes long, payload binary")


def _uuid(*parts):
    code = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws(
        "-", *(F.substring(code, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind, record_id, uri, date, headers, block, media):
    """Text of one record without its closing line ends; NULL headers are left out."""
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id),
            F.concat(F.lit("WARC-Date: "), date), F.concat(F.lit("WARC-Target-URI: "), uri)]
    head += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    head += [F.lit(f"Content-Type: {media}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, *head), F.lit(END * 2), block)


def captures(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, html, digest, first_page): the smallest page_id of the payload, where it matters.

    NULL html is an empty payload. first_page is NULL for payloads under LEAST_REVISIT bytes and
    where one row alone has the payload.
    """
    plain = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    plain = plain.withColumn("digest", F.sha2("html", 256))
    firsts = (plain.where((F.octet_length("html") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest")
              .agg(F.min(F.struct("page_id", "url")).alias("first"), F.min("page_id").alias("first_page"),
                   F.count(F.lit(1)).alias("n"))
              .where("n > 1")
              .select("digest", "first_page", F.col("first.url").alias("first_url")))
    return plain.join(firsts, "digest", "left")


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write request, response or revisit, and metadata records of every page row.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the smallest page_id are
    responses (a NULL page_id is always a response); the others are revisits that name the digest
    and the URI of the first. Repeated rows give records with ids of their own. Runs a job.
    """
    rows = captures(pages).withColumn("uid", F.monotonically_increasing_id().cast("string"))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    main, date = _uuid(F.lit("main"), key, "digest", "uid"), F.lit(date)
    revisit = F.coalesce(F.col("page_id") > F.col("first_page"), F.lit(False))
    size = F.octet_length("html")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                    size.cast("string"), F.lit(END * 2))
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"))]
    first_uri = F.regexp_replace("first_url", r"[\x00-\x20\x7F]", "%20")
    response = _record(F.lit("response"), main, uri, date, digest, F.concat(http, "html"),
                       "application/http; msgtype=response")
    again = _record(F.lit("revisit"), main, uri, date,
                    [*digest, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To-Target-URI", first_uri),
                     ("WARC-Refers-To-Date", date)], http, "application/http; msgtype=response")
    link = [("WARC-Concurrent-To", main)]
    request = _record(F.lit("request"), _uuid(F.lit("request"), key, "digest", "uid"), uri, date, link,
                      F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END * 2}")), "application/http; msgtype=request")
    fields = F.concat(F.when(F.col("page_id").isNotNull(), F.concat(F.lit("page-id: "), key, F.lit(END)))
                      .otherwise(F.lit("")), F.lit(f"via: crawl{END}"))
    metadata = _record(F.lit("metadata"), _uuid(F.lit("metadata"), key, "digest", "uid"), uri, date, link, fields,
                       "application/warc-fields")
    records = rows.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))
    records.write.option("lineSep", END * 2).option("compression", "gzip").text(path)


def _records(file, keep_payload):
    """Dicts of one archive's records, read one after the other."""
    while True:
        line = file.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:80]!r}")
            continue
        head = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head.setdefault(name.strip().lower(), []).append(value.strip())
        get = lambda name: head.get(name, [None])[0]
        length = int(get("content-length") or 0)
        block = file.read(length)
        if len(block) < length:
            raise ValueError("an archive ends inside a record")
        kind, payload, fields = get("warc-type"), b"", {}
        media = get("content-type") or ""
        if media.startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        elif media.startswith("application/warc-fields"):
            lines = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x)
            fields = {k.strip(): v.strip() for k, _, v in lines}
        else:
            payload = block
        full = kind in ("response", "resource")
        yield {"record_id": get("warc-record-id"), "record_type": kind,
               "concurrent_to": head.get("warc-concurrent-to", []), "target_uri": get("warc-target-uri"),
               "date": get("warc-date"),
               "payload_digest": hashlib.sha256(payload).hexdigest() if full
               else (get("warc-payload-digest") or "").rpartition(":")[2] or None,
               "refers_to": get("warc-refers-to-target-uri"), "fields": list(fields.items()),
               "content_length": length, "payload_bytes": len(payload) if full else None,
               "payload": payload if full and keep_payload else None}


def _parse(batches, keep_payload, schema, rows=512, size=8 << 20):
    for batch in batches:
        for content in batch.column(0):
            held, weight = [], 0
            with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as file:
                for record in _records(io.BufferedReader(file, 1 << 20), keep_payload):
                    held.append(record)
                    weight += len(record["payload"] or b"")
                    if len(held) >= rows or weight >= size:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, weight = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per WARC record below `path`. Digest and size of full payloads are computed from their bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORDS))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(lambda batches: _parse(batches, keep_payload, schema), RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its requests and metadata.

    Records join through WARC-Concurrent-To, whichever side names the other; those that name no
    capture in the archives are left out. Columns: capture (struct), requests and metadata (arrays
    in order of record id, empty if there are none).
    """
    shape = F.struct("record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to", "fields",
                     "content_length", "payload_bytes", "payload")
    kinds = ("response", "revisit", "resource")
    mains = records.where(F.col("record_type").isin(*kinds)).select(
        F.col("record_id").alias("anchor"), shape.alias("capture"), "concurrent_to")
    sides = records.where(F.col("record_type").isin("request", "metadata"))
    side = F.struct("record_id", "record_type", "target_uri", "date", "fields", "content_length")
    named = sides.select(F.explode("concurrent_to").alias("anchor"), side.alias("side"))
    naming = (mains.select("anchor", F.explode("concurrent_to").alias("record_id"))
              .join(sides.select("record_id", side.alias("side")), "record_id").select("anchor", "side"))
    pick = lambda kind: F.array_sort(F.filter("all", lambda x: x["record_type"] == kind),
                                     lambda a, b: F.when(a["record_id"] < b["record_id"], -1).otherwise(1))
    by_anchor = (named.unionByName(naming).groupBy("anchor").agg(F.collect_list("side").alias("all"))
                 .select("anchor", pick("request").alias("requests"), pick("metadata").alias("metadata")))
    none = F.filter(F.array(side_null()), lambda x: x.isNotNull())
    return mains.join(by_anchor, "anchor", "left").select(
        "capture", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))


def side_null():
    return F.lit(None).cast("struct<record_id:string, record_type:string, target_uri:string, date:string,"
                            " fields:map<string,string>, content_length:bigint>")


def resolve_revisits(found: DataFrame) -> DataFrame:
    """Page id, size, digest and kind per capture; a revisit takes size and page of the response of its digest.

    A revisit whose response is not among the captures keeps NULL size and refers_to.
    """
    flat = found.select(
        F.try_element_at(F.get("metadata", 0)["fields"], F.lit("page-id")).cast("long").alias("page_id"),
        F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.record_type").alias("record_type"),
        F.col("capture.payload_bytes").alias("own_bytes"))
    bodies = (flat.where("record_type = 'response'").groupBy("payload_digest")
              .agg(F.min("page_id").alias("first_page"), F.max("own_bytes").alias("full_bytes")))
    again = F.col("record_type") == "revisit"
    return flat.join(bodies, "payload_digest", "left").select(
        "page_id", F.when(again, F.col("full_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
        "payload_digest", "record_type", F.when(again, F.col("first_page")).alias("refers_to"))
