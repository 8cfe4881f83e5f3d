"""WARC archives of pages and their capture index of two levels.

Archives hold one gzip member a record, so a record is read by its byte range. The capture index sorts the records by reversed-host URL key into
compressed blocks of lines; each index part ends with a sparse directory, one entry a block, and the parts' first and last keys make up the level
above. A lookup searches parts, directory and block in turn by bisection and reads the ranges that it finds.

Executors write archives and index parts below a folder that all of them share, under names that no other attempt uses; the tables that name them are
committed by Spark, so files of lost or repeated attempts are never read. The folder may be on any file system that pyarrow opens by URI.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quartzline.llm.arrow import ARROW, map_rows, slices
from quartzline.llm.joins import near
from quartzline.session import shared_dir, written

#: Payloads from so many bytes on are stored once.
LEAST_SHARED = 100
#: An archive ends after the record that reaches so many bytes; a block of the index has so many lines.
ARCHIVE_BYTES, BLOCK_LINES = 64 << 20, 3000
#: Records are read in spans of so many bytes of an archive, one task each.
SPAN_BYTES = 16 << 20
#: Up to so many payloads that repeat are broadcast, with an id and a URL each.
SHARED_ROWS = 100_000
GZIP = 31

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MESSAGE = "application/http; msgtype=response"
END = b"\r\n\r\n"

CAPTURES = "key string, page_id long, record_type string, archive string, offset long, length long"
PARTS = "part string, first_key string, last_key string, directory_at long, directory_bytes long, lines long"
BLOCKS = "key string, part string, offset long, length long"
RECORDS = "page_id long, record_type string, uri string, refers_to long, digest string, payload binary"


def url_key(url: Column) -> Column:
    """com,example,www)/path?query: the host's labels in reverse, lower-cased, then the rest without fragment. Null gives an empty key, no :// no host."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = F.regexp_extract(F.regexp_replace(u, r"(?s)^.*?://[^/?#]*", ""), r"(?s)^([^#]*)", 1)
    return F.when(url.isNull(), "").otherwise(F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), rest))


def opener(folder: str) -> Callable:
    """open(name, write=False) of files in a folder. The file read last stays open, so ranges in order open each file once."""
    held: dict = {}

    def of(name: str, write: bool = False):
        if "fs" not in held:
            held["fs"], held["path"] = FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
            if write:
                held["fs"].create_dir(held["path"], recursive=True)
        if write:
            return held["fs"].open_output_stream(f"{held['path']}/{name}", compression=None)
        if held.get("name") != name:
            if "file" in held:
                held.pop("file").close()
            held["file"], held["name"] = held["fs"].open_input_file(f"{held['path']}/{name}"), name
        return held["file"]

    return of


def zipped(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return z.compress(data) + z.flush()


def record_name(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    """One gzip member. Headers of no value are left out; control characters in one are percent-escaped."""
    fields = {"WARC-Type": kind} | headers | {"Content-Length": str(len(block))}
    lines = [f"{k}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', v)}" for k, v in fields.items() if v is not None]
    return zipped("\r\n".join([VERSION, *lines]).encode() + END + block + END)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of a record."""
    data = zlib.decompress(member, GZIP)
    head, _, rest = data.partition(END)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    return headers, rest[: int(headers["content-length"])]


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(f.name, ARROW[f.dataType.simpleString()]) for f in StructType.fromDDL(schema)])


def batch_of(rows: list[tuple], into: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(into), into.types, strict=True)], schema=into)


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each page (page_id, url, html) and returns their captures, a written table.

    Of equal payloads of LEAST_SHARED bytes or more the one of the smallest page_id is a response and the others are revisits that refer to it; rows that
    repeat that id are responses too. Null html is an empty payload; a null id is never the smallest; a null url has no target header.
    """
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", url_key(F.col("url")).alias("key"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    d = d.withColumn("digest", F.sha2("payload", 256))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    shared = d.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(first, F.count("*").alias("rows")).where("rows > 1 AND first IS NOT NULL")
    shared = written(shared.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "shared-payloads")
    d = near(d, shared, "digest", "left", SHARED_ROWS).select("page_id", "url", "key", "payload", "digest", "first_id", "first_url")

    into = arrow_schema(CAPTURES)

    def run(batches):
        at, of = None, opener(folder)
        for batch in slices(batches):
            rows = []
            for page_id, url, key, payload, digest, first_id, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or at[2] >= ARCHIVE_BYTES:
                    if at:
                        at[1].close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    head = record("warcinfo", {"WARC-Date": date, "WARC-Record-ID": f"<urn:archive:{name}>", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                    at = [name, of(name, write=True), len(head)]
                    at[1].write(head)
                again = first_id is not None and page_id != first_id
                headers = {"WARC-Date": date, "WARC-Record-ID": record_name(page_id, digest), "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": MESSAGE}
                if again:
                    headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_name(first_id, digest), "WARC-Refers-To-Target-URI": first_url, "WARC-Refers-To-Date": date}
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
                kind = "revisit" if again else "response"
                member = record(kind, headers, http if again else http + payload)
                at[1].write(member)
                rows.append((key, page_id, kind, at[0], at[2], len(member)))
                at[2] += len(member)
            yield batch_of(rows, into)
        if at:
            at[1].close()

    return written(d.mapInArrow(run, CAPTURES), "captures")


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes the captures in key order as index parts and returns these, a written table of one row a part.

    A key that many captures share is cut between parts like any other rows.
    """
    order, into = ["key", "page_id", "archive", "offset"], arrow_schema(PARTS)

    def run(batches):
        out, directory, held, at, last = None, [], [], 0, None
        name = f"{uuid.uuid4().hex}.index"

        def put(block: list[tuple]) -> int:
            data = zipped("\n".join(json.dumps(x, ensure_ascii=False) for x in block).encode())
            directory.append((block[0][0], at, len(data)))
            out.write(data)
            return at + len(data)

        lines = 0
        for batch in slices(batches):
            out = out or opener(folder)(name, write=True)
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            lines, last = lines + batch.num_rows, held[-1][0]
            while len(held) >= BLOCK_LINES:
                at = put(held[:BLOCK_LINES])
                held = held[BLOCK_LINES:]
        if held:
            at = put(held)
        if out:
            data = zipped(json.dumps(directory, ensure_ascii=False).encode())
            out.write(data)
            out.close()
            yield batch_of([(name, directory[0][0], last, at, len(data), lines)], into)

    dealt = captures.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "page_id", "record_type", "archive", "offset", "length")
    return written(dealt.mapInArrow(run, PARTS), "index-parts")


def lookup(keys: DataFrame, parts: DataFrame, folder: str) -> DataFrame:
    """The captures of all keys (key), each once however often it is asked for. parts: of build_index, one row a part, and so known to the driver.

    Keys are asked for in order, so a task opens few parts. A key finds its blocks first and these are dealt over the tasks, so one key's captures may be
    read by many.
    """
    known = sorted((p["first_key"], p["last_key"], p["part"], p["directory_at"], p["directory_bytes"]) for p in parts.collect())
    firsts, lasts = [p[0] for p in known], [p[1] for p in known]
    find, read, held = opener(folder), opener(folder), {}

    def blocks(key: str) -> Iterator[tuple]:
        for _, _, part, at, size in known[bisect_left(lasts, key) : bisect_right(firsts, key)]:
            if held.get("part") != part:
                directory = json.loads(zlib.decompress(find(part).read_at(size, at), GZIP))
                held.update(part=part, directory=directory, keys=[x[0] for x in directory])
            here = held["keys"]
            for _, offset, length in held["directory"][max(bisect_left(here, key) - 1, 0) : bisect_right(here, key)]:
                yield key, part, offset, length

    def lines(key: str, part: str, offset: int, length: int) -> Iterator[tuple]:
        if held.get("block") != (part, offset):
            rows = [tuple(json.loads(x)) for x in zlib.decompress(read(part).read_at(length, offset), GZIP).decode().split("\n")]
            held.update(block=(part, offset), rows=rows, sorted=[r[0] for r in rows])
        yield from held["rows"][bisect_left(held["sorted"], key) : bisect_right(held["sorted"], key)]

    asked = keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    found = map_rows(asked, blocks, BLOCKS).repartition("part", "offset").sortWithinPartitions("part", "offset", "key")
    return map_rows(found, lines, CAPTURES)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """(page_id, record_type, uri, refers_to, digest, payload) of the captures' records, read by their byte ranges. A revisit has no payload."""
    of = opener(folder)

    def one(archive: str, offset: int, length: int) -> list[tuple]:
        headers, block = parsed(of(archive).read_at(length, offset))
        page = lambda name: None if name is None or name.split(":")[2] == "" else int(name.split(":")[2])
        kind = headers["warc-type"]
        payload = block.partition(END)[2] if kind == "response" else None
        return [(page(headers["warc-record-id"]), kind, headers.get("warc-target-uri"), page(headers.get("warc-refers-to")), headers["warc-payload-digest"].partition(":")[2], payload)]

    dealt = captures.withColumn("span", F.floor(F.col("offset") / SPAN_BYTES)).repartition("archive", "span").sortWithinPartitions("archive", "offset")
    return map_rows(dealt.select("archive", "offset", "length"), one, RECORDS)


def page_records(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from its record in the archives as the index finds it.

    Sizes and digests are of payloads read back; a revisit has those of the response that it refers to, and nulls if that were not found. Repeated
    rows have a record each; empty input gives empty output; other columns are ignored.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    captures = write_archives(pages, folder)
    parts = build_index(captures, folder)
    found = lookup(captures.select("key"), parts, folder)
    records = read_records(found, folder).select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    records = written(records, "records")
    responses, revisits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    wanted = written(revisits.select("refers_to", "digest").distinct(), "wanted")
    stored = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), "payload_bytes", "payload_digest").distinct()
    stored = written(near(stored, wanted, ["refers_to", "digest"], "left_semi", SHARED_ROWS), "stored")
    resolved = near(revisits, stored, ["refers_to", "digest"], "left", SHARED_ROWS)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*names).unionByName(resolved.select(*names))


OP12_SQL = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN refers THEN first_id END AS refers_to
FROM (
  SELECT *, coalesce(payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id, false) AS refers FROM (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first_id
    FROM pages
  )
)
"""
