"""Operator 10: WARC archives, written and assembled into transactions.

Writing: every page becomes a request, a response (or revisit) and a metadata
record; the request and the metadata name the response in WARC-Concurrent-To.
Of pages with equal payloads of some length, the one with the largest page_id
is the response and the others are revisits without payload, with the digest,
the identifier of that response in WARC-Refers-To and the other fields of the
standard's identical-payload profile. Records are gzip members, one after
another, in archives of bounded size; an archive is a binary value in a Parquet
table, which Spark's writer commits whole.

Reading: archives are parsed into records, from that table or from files (see
`read_files`); records meet by the identifier of their response and make one
nested row per capture. A record that names several captures stands with each.

Defined cases in writing: a null html is an empty payload; a null url is an empty
target; a null page_id is kept as null; equal payloads whose largest page_id stands
on several rows have all of these as responses; payloads below the limit are never
revisits. Record identifiers are unique in a write, so repeated rows stay apart.

Defined cases in reading: what is damaged never stops a job. A gzip member that
can't be unpacked, a head that is cut or without a length, and a block that is
shorter than its length give a record whose `error` says so, and reading goes on
with the next member. A digest that is no SHA-1 is null. Fields of one name are
gathered in order. Records without identifiers, and damaged ones, are in no capture;
records whose response is missing make a capture without response. A null or empty
archive has no records.
"""

from __future__ import annotations

import base64
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

LEAST_PAYLOAD = 1000
ARCHIVE_BYTES = 8 << 20
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _record(kind: str, rid: str, block: bytes, **fields: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v]
    lines.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _line(text: str | None) -> str:
    """A header value on one line: line ends, and then percent signs, are percent-encoded."""
    return (text or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if text and ("\r" in text or "\n" in text) else (text or "")


def page_records(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, refers_url: str | None, named: bool, run_id: uuid.UUID, place: str) -> bytes:
    """The three records of one page, as gzip members. `place` is its own in this
    write; the response that revisits refer to is named after its payload."""
    rid = [uuid.uuid5(run_id, f"{place}/{kind}").urn for kind in ("response", "request", "metadata")]
    original = uuid.uuid5(run_id, f"payload/{sha1_hex}").urn
    if named:
        rid[0] = original
    target = _line(url)
    host, _, path = target.partition("://")[2].partition("/")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    about = {"WARC_Target_URI": target, "Content_Type": "application/http; msgtype=response", "WARC_Payload_Digest": digest}
    if refers_to is None:
        out = _record("response", rid[0], http + payload, **about)
    else:
        out = _record("revisit", rid[0], http, **about, WARC_Profile=PROFILE, WARC_Refers_To=f"<{original}>", WARC_Refers_To_Target_URI=_line(refers_url), WARC_Refers_To_Date=DATE)
    ask = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    out += _record("request", rid[1], ask, WARC_Target_URI=target, WARC_Concurrent_To=f"<{rid[0]}>", Content_Type="application/http; msgtype=request")
    facts = f"page-id: {'' if page_id is None else page_id}\r\n".encode()
    return out + _record("metadata", rid[2], facts, WARC_Target_URI=target, WARC_Concurrent_To=f"<{rid[0]}>", Content_Type="application/warc-fields")


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, data): the archives, read from what was written."""
    p = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"))
    # the id of a row follows from the files and their order; it only chooses among repeated rows
    p = p.withColumn("sha1", F.sha1("payload")).withColumn("uid", F.monotonically_increasing_id())
    # one row for every payload that occurs again; combined on the map side
    again = p.filter(F.octet_length("payload") >= least).groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("refers_to"), F.max_by("url", "page_id").alias("refers_url"), F.max_by("uid", "page_id").alias("last"))
    again = c.saved(again.filter("n > 1 and refers_to is not null").drop("n").withColumnRenamed("sha1", "again"), "repeated-payloads")
    p = p.join(again, (F.col("sha1") == F.col("again")) & (F.octet_length("payload") >= least), "left").drop("again")
    p = p.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")))
    p = p.withColumn("named", F.coalesce(F.col("uid") == F.col("last"), F.lit(False)))
    run_id = uuid.uuid4()

    def run(batches):
        part = TaskContext.get().partitionId()
        n, number, held, size = 0, 0, [], 0
        for batch in batches:
            cols = [batch.column(k) for k in range(7)]
            for i in range(batch.num_rows):
                made = page_records(*[cols[k][i].as_py() for k in range(7)], run_id, f"{part}/{n}")
                n += 1
                held.append(made)
                size += len(made)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"name": [f"pages-{part:05d}-{number:05d}.warc.gz"], "data": pa.array([b"".join(held)], pa.binary())})
                    held, size, number = [], 0, number + 1
        if held:
            yield pa.RecordBatch.from_pydict({"name": [f"pages-{part:05d}-{number:05d}.warc.gz"], "data": pa.array([b"".join(held)], pa.binary())})

    ready = p.select("page_id", "url", "payload", "sha1", "refers_to", "refers_url", "named")
    return c.saved(ready.mapInArrow(run, "name string, data binary"), "archives")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, data) for .warc and .warc.gz files in a folder that Spark reads."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), F.col("content").alias("data"))


def _fields(lines: list[bytes]) -> dict[str, list[str]]:
    """Values by lower-case name, in order; a line that begins with white space goes on with the one before."""
    out: dict[str, list[str]] = {}
    last = None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last][-1] += " " + text.strip()
            continue
        k, colon, v = text.partition(":")
        if colon:
            last = k.strip().lower()
            out.setdefault(last, []).append(v.strip())
    return out


def _plain_records(text: bytes):
    """(fields, block, error) of the records of unpacked bytes, by their lengths."""
    pos = 0
    while pos < len(text):
        if text[pos : pos + 5] != b"WARC/":
            found = text.find(b"WARC/", pos)
            gap = text[pos : found if found >= 0 else len(text)]
            if gap.strip():
                yield {}, b"", "bytes between records"
            if found < 0:
                return
            pos = found
        end = text.find(b"\r\n\r\n", pos)
        if end < 0:
            yield _fields(text[pos:].split(b"\r\n")[1:]), b"", "the head is cut"
            return
        head = _fields(text[pos:end].split(b"\r\n")[1:])
        said = head.get("content-length", [""])[0]
        if not (said.isascii() and said.isdigit()):
            yield head, b"", "no content length"
            pos = end + 4  # on to whatever looks like a record
            continue
        n = int(said)
        block = text[end + 4 : end + 4 + n]
        yield head, block, None if len(block) == n else "the block is cut"
        pos = end + 4 + n


def parse_records(data: bytes):
    """(fields by lower-case name, block, error or None) of each record."""
    view = memoryview(data)
    at, step = 0, 1 << 16
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b":
            # plain records up to the next member, or to the end
            next_member = data.find(b"\x1f\x8b\x08", at) if at else -1
            upto = next_member if next_member > 0 else len(data)
            yield from _plain_records(data[at:upto])
            at = upto
            continue
        # one member at a time, without copying the rest of the archive
        begin, unpack, got, error = at, zlib.decompressobj(31), [], None
        try:
            while not unpack.eof and at < len(data):
                part = view[at : at + step]
                got.append(unpack.decompress(part))
                at += len(part)
            at -= len(unpack.unused_data)
            error = None if unpack.eof else "the member is cut"
        except zlib.error as e:
            error = f"the member can't be unpacked: {e}"
            found = data.find(b"\x1f\x8b\x08", begin + 2)
            at = found if found > 0 else len(data)
        if error is None:
            yield from _plain_records(b"".join(got))
        else:
            head = next(iter(_plain_records(b"".join(got))), ({}, b"", None))[0]
            yield head, b"", error


_RECORD = "captures array<string>, kind string, record_id string, target_uri string, date string, digest string, refers_to string, http_head string, length bigint, payload binary, fields map<string,array<string>>, error string"
_RECORD_KINDS = [pa.list_(pa.string()), *[pa.string()] * 7, pa.int64(), pa.binary(), pa.map_(pa.string(), pa.list_(pa.string())), pa.string()]


def _sha1(said: str) -> str | None:
    """The hex digest of a field like sha1:BASE32 or sha1:hex, or null."""
    label, _, value = said.partition(":")
    if label.lower() != "sha1":
        return None
    try:
        raw = base64.b32decode(value.upper()) if len(value) == 32 else bytes.fromhex(value)
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def _record_row(head: dict[str, list[str]], block: bytes, error: str | None) -> tuple:
    one = lambda name: head.get(name, [""])[0]
    kind, rid = one("warc-type").lower(), one("warc-record-id").strip("<>")
    http, payload, fields, length = None, None, None, None
    if error is None and one("content-type").startswith("application/http"):
        first, _, payload = block.partition(b"\r\n\r\n")
        http = first.decode("utf-8", "replace")
        length = len(payload)
        if kind == "revisit":
            payload = None
            said = _fields(first.split(b"\r\n")[1:]).get("content-length", [""])[0]
            length = int(said) if said.isascii() and said.isdigit() and len(said) < 19 else None
    elif error is None and one("content-type").startswith("application/warc-fields"):
        fields = list(_fields(block.split(b"\r\n" if b"\r\n" in block else b"\n")).items())
    elif error is None:
        payload, length = block, len(block)
    captures = [rid] if kind in ("response", "revisit") else [x.strip("<>") for x in head.get("warc-concurrent-to", [])] or [rid]
    captures = [] if error else [x for x in dict.fromkeys(captures) if x]
    return captures, kind, rid or None, one("warc-target-uri") or None, one("warc-date") or None, _sha1(one("warc-payload-digest")), one("warc-refers-to").strip("<>") or None, http, length, payload, fields, error


def read_records(archives: DataFrame) -> DataFrame:
    """A row per record; captures are the identifiers of the responses that it belongs to."""
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def run(batches):
        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), _RECORD_KINDS)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for head, block, error in parse_records(batch.column(0)[k].as_py() or b""):
                    rows.append(_record_row(head, block, error))
                    size += len(block)
                    if size > 4 << 20 or len(rows) >= 5000:
                        yield flush(rows)
                        rows, size = [], 0
                if rows:
                    yield flush(rows)

    return archives.select("data").mapInArrow(run, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture, response, requests, metadata. There may be
    several requests and metadata records, which stand in the order of their identifiers."""
    is_response = F.col("kind").isin("response", "revisit")
    some = lambda kind, *cols: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*cols)))).alias
    parts = records.filter(is_response | F.col("kind").isin("request", "metadata")).select("*", F.explode("captures").alias("capture"))
    answer = F.struct("kind", "record_id", "target_uri", "date", "digest", "refers_to", "http_head", "length", F.sha1("payload").alias("payload_sha1"), "payload")
    pairs = F.map_entries("fields").alias("fields")  # maps have no order
    made = parts.groupBy("capture").agg(
        F.first(F.when(is_response, answer), ignorenulls=True).alias("response"), some("request", "record_id", "target_uri", "http_head")("requests"), some("metadata", "record_id", pairs)("metadata")
    )
    return made.withColumn("metadata", F.transform("metadata", lambda m: F.struct(m["record_id"].alias("record_id"), F.map_from_entries(m["fields"]).alias("fields"))))


def op10_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `pages`, written as archives and assembled again. A revisit's page is
    found through the identifier of the response that it refers to."""
    captures = assemble(read_records(write_archives(c.table(spark, sf_dir, "pages", spread=True))))
    page = F.get(F.try_element_at(F.get("metadata", 0)["fields"], F.lit("page-id")), 0).try_cast("long")
    found = c.saved(captures.select("capture", page.alias("page_id"), "response.kind", "response.length", F.coalesce("response.payload_sha1", "response.digest").alias("digest"), "response.refers_to"), "captures")
    # the responses that are referred to: one row for each payload that occurs again
    asked = found.select(F.col("refers_to").alias("capture")).dropna().distinct()
    named = asked.join(found.select("capture", F.col("page_id").alias("of_page")), "capture").withColumnRenamed("capture", "refers_to")
    return found.join(named, "refers_to", "left").select(
        "page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("of_page").alias("refers_to")
    )


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
w AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to FROM p LEFT JOIN w USING (d)
"""
