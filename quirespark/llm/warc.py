"""Web archives (WARC 1.1): pages as request, response or revisit, and metadata records; and captures put together again.

A transaction's records name one another by WARC-Concurrent-To. The reader takes records as they come and joins them by
those names into one nested row for each capture. Archives are gzip files, which Spark reads as streams: no file is held
whole, and a record's end is where its Content-Length says, whatever its block holds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.lookup import joined_back
from quirespark.llm.rows import keys_of
from quirespark.shared import freeze, new_path, table

#: What every record begins with, but for the last digit of the version.
MARK = b"WARC/1."
#: Fixed value of the standard.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ANCHORS = ("response", "revisit", "resource")

RECORD = (
    "record_id string, type string, date string, target_uri string, concurrent_to array<string>, refers_to string, content_type string, "
    "status int, fields map<string, string>, payload binary, payload_bytes long, payload_digest string"
)


def _name(role: str, key: Column, seed: str) -> Column:
    """A record id that is the same in every run."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws(":", F.lit(seed), F.lit(role), key.cast("string"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column | str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the line feed that ends it; headers whose value is null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit(MARK.decode() + "1"), F.concat(F.lit("WARC-Type: "), kind), *(F.concat(F.lit(f"{name}: "), value) for name, value in headers), F.concat(F.lit("Content-Length: "), F.octet_length(block))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def records_of(pages: DataFrame, least: int = 1000, date: str = "1970-01-01T00:00:00Z", seed: str = "pages", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """column value: the text of each WARC record but for its last line feed, three records a page, one after another.

    Of pages with equal payloads of `least` bytes or more the one with the largest id is stored; the others become revisit
    records that refer to it. A null payload is empty. Equal ids are ordered by the hash of their payloads, and missing
    ids come after all others. A null address gives records without a target; one with blanks or control characters is
    written percent-encoded. An empty table gives no records. Further columns are ignored.
    """
    own = keys_of(pages, id_col, payload_col, [url_col])[0]
    own = own.select("key", "id", F.col(f"rest.{url_col}").alias("url"), F.coalesce("text", F.lit("")).alias("payload"))
    # slim rows decide what is stored; payloads stay where they are read until then
    slim = own.where(F.octet_length("payload") >= least).select("key", F.sha2("payload", 256).alias("same"))
    stored = slim.groupBy("same").agg(F.max("key").alias("stored"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stored = freeze(stored, "repeated-payloads")
    total = stored.agg(F.sum("n")).first()[0] or 0
    again = joined_back(slim, stored, ["same"], "n", total).where("key < stored").select("key", "stored")
    # written, so that Spark knows its size: where it is small no payload is shuffled
    own = own.join(freeze(again, "revisits"), "key", "left")

    url = F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), F.url_encode("url")).otherwise(F.col("url"))
    request, response, about = (_name(x, F.col("key"), seed) for x in ("request", "response", "metadata"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", url)]
    digest = F.concat(F.lit("sha1:"), F.sha1("payload"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload"), F.lit("\r\n\r\n"))
    place = F.coalesce(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit(""))
    ask = F.concat(F.lit("GET "), F.when(F.startswith(place, F.lit("/")), place).otherwise(F.concat(F.lit("/"), place)), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")), F.lit("\r\n\r\n"))
    revisit = F.col("stored").isNotNull()
    answer = [("WARC-Record-ID", response), *common, ("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", digest)]
    answer += [("WARC-Profile", F.when(revisit, F.lit(SAME_PAYLOAD))), ("WARC-Refers-To", F.when(revisit, _name("response", F.col("stored"), seed)))]
    rows = F.array(
        _record("request", [("WARC-Record-ID", request), *common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http; msgtype=request"))], ask),
        _record(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), answer, F.when(revisit, head).otherwise(F.concat(head, "payload"))),
        _record("metadata", [("WARC-Record-ID", about), *common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("via: table\r\n"))),
    )
    return own.select(F.explode(rows).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write the records as gzip archives, one for each partition."""
    records.write.option("compression", "gzip").option("lineSep", "\n").text(path)


def _plain(digest: str | None) -> str | None:
    """A labelled SHA-1 in hexadecimal digits; archives write it in base 32 as well. None for other kinds."""
    label, _, value = (digest or "").partition(":")
    if label.strip().lower() != "sha1" or not value:
        return None
    value = value.strip()
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def _headers(raw: bytes) -> list[tuple[str, str]]:
    """Names (in lower case) and values; a line that begins with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def _body(http: dict[str, str], body: bytes) -> bytes:
    """The body of a message, whose chunks are put together."""
    if "chunked" not in http.get("transfer-encoding", "").lower():
        return body
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = int(body[at:end].split(b";")[0].strip() or b"0", 16)
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def _row(head: bytes, block: bytes, where: str) -> tuple:
    listed = _headers(head)
    known = dict(reversed(listed))
    kind, content = known.get("warc-type"), known.get("content-type", "")
    status, fields, payload = None, None, block
    if content.startswith("application/http"):
        start, _, body = block.partition(b"\r\n\r\n")
        line, _, rest = start.partition(b"\r\n")
        payload = _body(dict(_headers(rest)), body)
        word = line.split(b" ")
        status = int(word[1]) if kind in ("response", "revisit") and len(word) > 1 and word[1].isdigit() else None
    elif content.startswith("application/warc-fields"):
        fields = list(dict(_headers(block)).items())
    said, own = _plain(known.get("warc-payload-digest")), hashlib.sha1(payload).hexdigest()
    if kind == "revisit":
        payload, size, own = None, None, said
    else:
        size = len(payload)
        if said is not None and said != own:
            raise ValueError(f"the payload of {known.get('warc-record-id')} in {where} is damaged")
    others = [v for k, v in listed if k == "warc-concurrent-to"]
    return known.get("warc-record-id"), kind, known.get("warc-date"), known.get("warc-target-uri"), others, known.get("warc-refers-to"), content or None, status, fields, payload, size, own


def _split(pieces: Iterator[tuple[str, int, bytes]]) -> Iterator[tuple]:
    """Records of a stream that was cut at every MARK: pieces are put together until a record is as long as it says."""
    file, parts, held, need, at = None, [], 0, None, 0

    def done() -> tuple:
        whole = b"".join(parts)
        if need is None or held < need or whole[need:].strip(b"\r\n"):
            raise ValueError(f"a record of {file} ends in its middle")
        return _row(whole[:at], whole[at + 4 : need], file)

    for where, begin, piece in pieces:
        if where != file:
            if parts:
                yield done()
            if begin:
                raise ValueError(f"{where} is not compressed and larger than a split; compress it by gzip first")
            file, parts, held, need = where, [], 0, None
            if piece:
                raise ValueError(f"{where} does not begin with a record")
            continue
        if parts and need is not None and held >= need:
            yield done()
            parts, held, need = [], 0, None
        parts.append(MARK + piece)
        held += len(parts[-1])
        if need is None:
            whole = b"".join(parts)
            parts = [whole]
            at = whole.find(b"\r\n\r\n")
            if at >= 0:
                need = at + 4 + int(dict(_headers(whole[:at])).get("content-length", 0))
    if parts:
        yield done()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("target_uri", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("content_type", pa.string()),
                      ("status", pa.int32()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def pieces() -> Iterator[tuple[str, int, bytes]]:
        for batch in batches:
            for at in range(len(batch)):
                yield batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), batch.column(2)[at].as_py()

    rows, held = [], 0
    for row in _split(pieces()):
        rows.append(row)
        held += len(row[9] or b"") + 500
        if held > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzip archives, see RECORD. payload is the body of a message, or the block of other records; that of
    a revisit is null, and its digest is the one its header gives. fields has the lines of application/warc-fields.

    A payload whose SHA-1 is not the one its record gives is an error, as is a record that ends too early. A block may hold
    anything, other archives included. Archives that are not compressed must fit into one split.
    """
    raw = spark.read.option("lineSep", MARK.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("piece"))
    return raw.mapInArrow(_records, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each response, revisit or resource record: capture_id, target_uri, date, response (type, status,
    payload, payload_bytes, payload_digest, refers_to), request (record_id, payload), metadata (record_id, fields; by id).

    A record belongs to the capture that it names by WARC-Concurrent-To, or that names it, or to the one of a record
    that stands so to it. Where that leaves several captures it is the one of the smallest id. Of several requests the one
    with the smallest id is taken. A capture without request or metadata has null and an empty list; records of no
    capture, and records without an id, are left out. A capture's metadata are in one row, so in one task. The records are
    read several times; without their column payload the result has none either.
    """
    body = ["payload"] if "payload" in records.columns else []
    named = records.where(F.col("record_id").isNotNull())
    anchor = named.where(F.col("type").isin(*ANCHORS))
    ids = anchor.select(F.col("record_id").alias("capture"))
    said = named.select("record_id", F.explode("concurrent_to").alias("other"))
    links = said.unionByName(said.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct()
    first = links.join(ids, F.col("other") == F.col("capture")).select("record_id", "capture")
    second = links.join(first.withColumnRenamed("record_id", "middle"), F.col("other") == F.col("middle")).select("record_id", "capture")
    near = first.withColumn("far", F.lit(0)).unionByName(second.withColumn("far", F.lit(1)))
    belongs = near.groupBy("record_id").agg(F.min(F.struct("far", "capture")).getField("capture").alias("capture"))
    parts = named.where(F.col("type").isin("request", "metadata")).join(belongs, "record_id")
    request = parts.where("type = 'request'").groupBy("capture").agg(F.min_by(F.struct("record_id", *body), "record_id").alias("request"))
    about = parts.where("type = 'metadata'").groupBy("capture").agg(F.array_sort(F.collect_list(F.struct("record_id", F.map_entries("fields").alias("fields")))).alias("metadata"))
    about = about.select("capture", F.transform("metadata", lambda m: F.struct(m.record_id.alias("record_id"), F.map_from_entries(m.fields).alias("fields"))).alias("metadata"))
    answer = anchor.select(F.col("record_id").alias("capture"), "target_uri", "date", F.struct("type", "status", *body, "payload_bytes", "payload_digest", "refers_to").alias("response"))
    whole = answer.join(request, "capture", "left").join(about, "capture", "left")
    empty = F.array().cast("array<struct<record_id: string, fields: map<string, string>>>")
    return whole.select(F.col("capture").alias("capture_id"), "target_uri", "date", "response", "request", F.coalesce("metadata", empty).alias("metadata"))


def resolved(found: DataFrame) -> DataFrame:
    """Slim rows (capture, page, type, refers_to, bytes, digest) in which a revisit has the size and digest of the payload of
    the response that it refers to, and that response's page (to_page); null where that response is not there. The rows
    are read several times. A response that many revisits refer to is no hot key, see joined_back."""
    visits = found.where("type = 'revisit'")
    asked = visits.groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    stored = found.where("type != 'revisit'").select(F.col("capture").alias("refers_to"), F.col("page").alias("to_page"), F.col("bytes").alias("b"), F.col("digest").alias("d")).join(asked, "refers_to")
    back = joined_back(visits.drop("bytes", "digest"), stored, ["refers_to"], "n", visits.count(), "left")
    none = F.lit(None)
    others = found.where("type != 'revisit'").withColumn("to_page", none.cast(dict(found.dtypes)["page"]))
    return others.unionByName(back.withColumnsRenamed({"b": "bytes", "d": "digest"}))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = new_path(spark, "warc"), table(spark, sf_dir, "pages")
    write_warc(records_of(pages, least=1000), path)
    # payloads are checked and measured where they are read; what goes on is a row for each record
    records = freeze(read_warc(spark, path).drop("payload"), "records")
    c, kind = captures(records), dict(pages.dtypes)["page_id"]
    page = F.get("metadata", F.lit(0)).getField("fields").getItem("page-id").cast(kind)
    slim = c.select(F.col("capture_id").alias("capture"), page.alias("page"), "response.type", "response.refers_to", F.col("response.payload_bytes").alias("bytes"), F.col("response.payload_digest").alias("digest"))
    slim = freeze(slim, "captures")
    return resolved(slim).select(F.col("page").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("to_page").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT t, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY t)
SELECT page_id, n AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last > page_id THEN last END AS refers_to
FROM p LEFT JOIN g USING (t)
"""
