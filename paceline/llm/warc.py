"""WARC archives of pages, and a reader that salvages what it can of damaged ones.

Writing: one file for each task, one gzip member for each record. Of pages with equal
payloads of at least `least_bytes`, that with the largest page_id is a response, the
others are revisits that name it and carry no payload.

Reading: each record must inflate (or stand plain), begin with a version line, be as
long as it says, and have the digests it says. Where one does not, the reader looks for
the next gzip member or version line from which a whole record can be read, goes on
there, and reports the bytes between as a gap with the reason. So a damaged record costs
that record only. A file is read record by record, not as a whole. Numbers are ASCII digits
of at most 18 places; a header that holds anything else is a damaged one. `recovered` writes
the gaps to a table, the quarantine log, and gives the records.

A null html is an empty payload, a null url has no target line. A null page_id is
written without one, read back as null, and is a revisit of any page with its payload.
Rows of one page_id and payload are alike: all response, or all revisit. An empty table
gives no file. Extra columns are left out. A task that runs again replaces its file.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import shared_folder, store_of, stored, table

LEAST_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"  # the tables have no fetch time
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
END = b"\r\n\r\n"
CHUNK = 1 << 16
SEARCH = 1 << 20
HEADER_LIMIT = 1 << 20
ROWS = 500
#: Fixed value: what counts as a number in a header; longer ones do not fit 64 bits.
NUMBER = re.compile(r"-?[0-9]{1,18}", re.ASCII)


def digest_line(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def name_of(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page: dict) -> bytes:
    """One record of a page with page_id, url, html, digest (hex), bytes and refers_to."""
    payload = page["html"] or b""
    revisit = page["revisit"]
    block = HTTP + f"Content-Length: {page['bytes']}".encode() + END + (b"" if revisit else payload)
    whole = "sha1:" + base64.b32encode(bytes.fromhex(page["digest"])).decode()
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name_of(page["page_id"], page["digest"])),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", page["url"] and re.sub(r"\s", "%20", page["url"])),
        ("WARC-Payload-Digest", whole),
        ("WARC-Block-Digest", digest_line(block)),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", name_of(page["refers_to"], page["digest"]) if revisit else None),
        ("X-Page-Id", page["page_id"]),
        ("X-Refers-To-Page-Id", page["refers_to"] if revisit else None),
        ("X-Payload-Length", page["bytes"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None)
    return VERSION + head.encode() + b"\r\n" + block + END


def writer(address: str):
    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(address)
        task = TaskContext.get()
        name = f"part-{task.partitionId():07d}.warc.gz"
        attempt, n = f"{folder}/{name}.{task.taskAttemptId()}", 0
        with store.open_output_stream(attempt) as out:
            for batch in rows:
                for at in range(0, len(batch), 200):
                    for page in batch.slice(at, 200).to_pylist():
                        member = zlib.compressobj(6, zlib.DEFLATED, 31)
                        out.write(member.compress(record(page)) + member.flush())
                        n += 1
        if not n:
            store.delete_file(attempt)
            return
        store.move(attempt, f"{folder}/{name}")
        yield pa.RecordBatch.from_pylist([{"file": name, "records": n}])

    return write


def write_archives(pages: DataFrame, address: str, least_bytes: int = LEAST_BYTES) -> list[str]:
    """Write a record for each page below the address; the files' names."""
    store, folder = store_of(address)
    store.create_dir(folder, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "bytes": F.octet_length("html").cast("long")})
    large = rows.where(F.col("bytes") >= least_bytes).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    # revisits are found on ids and digests alone; payloads are dealt out by page
    revisits = large.join(groups.drop("n"), "digest").where("page_id < refers_to or (page_id is null and refers_to is not null)")
    revisits = revisits.distinct().select(F.col("page_id").alias("page"), F.col("digest").alias("hash"), "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("hash"))
    revisit = F.col("refers_to").isNotNull()
    dealt = rows.join(revisits, same, "left").select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "bytes", "refers_to", revisit.alias("revisit")
    )
    made = dealt.sortWithinPartitions("page_id").mapInArrow(writer(address), "file string, records long")
    return sorted(x[0] for x in made.collect())  # one row for each file


class Damaged(ValueError):
    pass


@dataclass
class Source:
    """Reads of a file at any place."""

    file: pa.NativeFile
    size: int = field(init=False)

    def __post_init__(self) -> None:
        self.size = self.file.size()

    def at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)


def inflated(source: Source, start: int) -> tuple[bytes, int]:
    """The gzip member that begins at a place, and where it ends."""
    engine, out, at = zlib.decompressobj(31), [], start
    while not engine.eof:
        data = source.at(at, CHUNK)
        if not data:
            raise Damaged("cut off")
        try:
            out.append(engine.decompress(data))
        except zlib.error as wrong:
            raise Damaged("member does not inflate") from wrong
        at += len(data)
        if len(out) == 1 and len(out[0]) >= len(VERSION) and not out[0].startswith(VERSIONS):
            raise Damaged("no version line")
    return b"".join(out), at - len(engine.unused_data)


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def whole_number(found: dict[str, str], name: str) -> int | None:
    """A header's number, None if there is no such header."""
    if name not in found:
        return None
    if not NUMBER.fullmatch(found[name]):
        raise Damaged(f"{name} is no number")
    return int(found[name])


def stated_digest(line: str) -> str | None:
    """The hex digest that a digest header states, None if it states none by SHA-1."""
    if not line.startswith("sha1:"):
        return None
    try:
        digest = base64.b32decode(line[5:])
    except binascii.Error as wrong:
        raise Damaged("digest is not base32") from wrong
    if len(digest) != hashlib.sha1().digest_size:
        raise Damaged("digest is of another length")
    return digest.hex()


def plain(source: Source, start: int) -> tuple[bytes, int]:
    """The record that stands uncompressed at a place, and where it ends."""
    data = b""
    while END not in data:
        more = source.at(start + len(data), CHUNK)
        if not more or len(data) > HEADER_LIMIT:
            raise Damaged("no end of the header")
        data += more
    head = data.index(END)
    length = whole_number(headers(data[:head]), "content-length")
    if length is None or length < 0:
        raise Damaged("no length")
    end = start + head + len(END) + length + len(END)
    if end > source.size:
        raise Damaged("cut off")
    return source.at(start, end - start), end


def parsed(data: bytes) -> dict:
    """The page that a record's bytes hold; raises if a check fails."""
    if not data.startswith(VERSIONS):
        raise Damaged("no version line")
    head, _, rest = data.partition(END)
    if any(x in head[len(VERSION) :] + b"\r\n" for x in VERSIONS):
        raise Damaged("version line inside a header")
    found = headers(head)
    length = whole_number(found, "content-length")
    if length is None or len(rest) != length + len(END) or not rest.endswith(END):
        raise Damaged("length is wrong")
    block = rest[: -len(END)]
    if found.get("warc-block-digest", digest_line(block)) != digest_line(block):
        raise Damaged("block digest is wrong")
    kind, payload = found.get("warc-type"), None
    stated = found.get("warc-payload-digest", "")
    if kind == "response":
        payload = block.partition(END)[2]
        if stated and stated != digest_line(payload):
            raise Damaged("payload digest is wrong")
        stated = digest_line(payload)
    return {
        "record_type": kind,
        "page_id": whole_number(found, "x-page-id"),
        "payload_bytes": whole_number(found, "x-payload-length") if payload is None else len(payload),
        "payload_digest": stated_digest(stated),
        "refers_to": whole_number(found, "x-refers-to-page-id"),
        "target_uri": found.get("warc-target-uri"),
        "payload": payload,
    }


def record_at(source: Source, start: int) -> tuple[dict, int]:
    mark = source.at(start, len(VERSION))
    if mark.startswith(GZIP):
        data, end = inflated(source, start)
    elif mark in VERSIONS:
        data, end = plain(source, start)
    else:
        raise Damaged("neither a member nor a version line")
    return parsed(data), end


def next_record(source: Source, start: int) -> tuple[dict, int, int] | None:
    """The first whole record at or after a place: page, start, end."""
    mark = re.compile(re.escape(GZIP) + b"|" + b"|".join(map(re.escape, VERSIONS)))
    while start < source.size:
        data = source.at(start, SEARCH + len(VERSION))
        for found in mark.finditer(data):
            if found.start() < SEARCH:
                try:
                    page, end = record_at(source, start + found.start())
                    return page, start + found.start(), end
                except Damaged:
                    continue
        start += SEARCH
    return None


def salvaged(file: pa.NativeFile) -> Iterator[dict]:
    """Records and gaps of a file, in order; each has `start`, `end` and `gap` (a reason, or None)."""
    source, at = Source(file), 0
    while at < source.size:
        try:
            page, end = record_at(source, at)
            yield page | {"start": at, "end": end, "gap": None}
            at = end
        except Damaged as reason:
            found = next_record(source, at + 1)
            until = found[1] if found else source.size
            yield {"start": at, "end": until, "gap": str(reason)}
            if found:
                yield found[0] | {"start": until, "end": found[2], "gap": None}
            at = found[2] if found else source.size


ENTRY = (
    "file string, start long, end long, gap string, record_type string, page_id long, payload_bytes long, "
    "payload_digest string, refers_to long, target_uri string"
)


def reader(address: str, with_payload: bool):
    names = [x.split()[0] for x in ENTRY.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ENTRY.split(", ")] + [("payload", pa.binary())] * with_payload)

    def read(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(address)
        for name in (x for batch in files for x in batch.column(0).to_pylist()):
            rows: list[dict] = []
            with store.open_input_file(f"{folder}/{name}") as file:
                for entry in salvaged(file):
                    rows.append({k: entry.get(k) for k in names} | {"file": name} | ({"payload": entry.get("payload")} if with_payload else {}))
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_archives(spark: SparkSession, address: str, files: list[str], with_payload: bool = True) -> DataFrame:
    """A row for each record, and one for each gap (its `gap` says why), a task for each file."""
    todo = spark.createDataFrame([(x,) for x in files], "file string").repartitionByRange(max(1, len(files)), "file")
    return todo.mapInArrow(reader(address, with_payload), ENTRY + ", payload binary" * with_payload)


def recovered(entries: DataFrame, address: str) -> tuple[DataFrame, DataFrame]:
    """The records of read_archives(), and the quarantine log: file, start, end and reason of every gap.

    Both are written below the address, so that the archives are read once.
    """
    kept = stored(entries, f"{address}-entries")
    log = kept.where("gap IS NOT NULL").select("file", "start", "end", F.col("gap").alias("reason"))
    return kept.where("gap IS NULL").drop("gap"), stored(log, f"{address}-quarantine")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back; a gap in archives just written is an error."""
    address = shared_folder(spark, "warc")
    files = write_archives(table(spark, sf_dir, "pages"), address)
    records, log = recovered(read_archives(spark, address, files, with_payload=False), address)
    if not log.isEmpty():
        raise ValueError(f"archives are damaged, see {address}-quarantine")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


CHECK_OP3 = f"""
with p as (
  select page_id, coalesce(html, '') as body from pages
), d as (
  select page_id, octet_length(encode(body)) as n, sha1(body) as digest from p
), g as (
  select digest, max(page_id) as last from d where n >= {LEAST_BYTES} group by digest
)
select d.page_id, cast(n as bigint) as payload_bytes, d.digest as payload_digest,
       case when last > d.page_id then 'revisit' else 'response' end as record_type,
       case when last > d.page_id then last end as refers_to
from d left join g on d.digest = g.digest and d.n >= {LEAST_BYTES}
"""
