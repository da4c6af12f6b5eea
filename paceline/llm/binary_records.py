"""Token ids as length-delimited binary records with masked checksums and an offset index.

A data file is a row of frames: length (8 bytes), masked checksum of those 8 bytes
(4 bytes), the record, masked checksum of the record (4 bytes). A record holds a flag
byte (1: no doc_id; 2: ids of 4 bytes, else 2), the doc_id, the number of ids and the
ids; all numbers are little-endian. The index file beside it holds where each frame
begins and, last, where the file ends (8 bytes each), for reads in any order.

Files follow ascending doc_id, one pair for each range of ids; a null doc_id comes
first, equal ids go by text. A null text is an empty one. Extra columns are left out.
An empty table gives no file. A task that runs again replaces its pair of files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import partitions, shared_folder, store_of, table
from paceline.llm.crc32c import crc32c_many, masked
from paceline.llm.tokens import WORD_BPE, encoder

HEAD = struct.Struct("<BqQ")
END_ID = 1
#: Texts that are encoded together, in characters; bounds a task's memory.
BATCH_CHARS = 4_000_000
#: Rows of an Arrow batch that become Python objects together.
SLICE_ROWS = 500


def batches(rows: Iterator[pa.RecordBatch], columns: int = 2, chars: int | None = None) -> Iterator[list[tuple]]:
    """(doc_id, text) rows, and further columns, in runs of at most `chars` (BATCH_CHARS) characters, or one row."""
    run, held, most = [], 0, chars or BATCH_CHARS
    for part in (batch.slice(at, SLICE_ROWS) for batch in rows for at in range(0, batch.num_rows, SLICE_ROWS)):
        for row in zip(*(part.column(k).to_pylist() for k in range(columns)), strict=True):
            run.append((row[0], row[1] or "", *row[2:]))
            held += len(run[-1][1])
            if held >= most:
                yield run
                run, held = [], 0
    if run:
        yield run


def framed(records: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(x)) for x in records]
    sums = [masked(crc32c_many(x)).astype("<u4") for x in (lengths, records)]
    return [n + a.tobytes() + x + b.tobytes() for n, a, x, b in zip(lengths, sums[0], records, sums[1], strict=True)]


def record_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 65535
    head = HEAD.pack((doc_id is None) + 2 * wide, doc_id or 0, len(ids))
    return head + ids.astype("<u4" if wide else "<u2").tobytes()


def ids_of(record: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id, count = HEAD.unpack_from(record)
    ids = np.frombuffer(record, "<u4" if flags & 2 else "<u2", count, HEAD.size).astype("<u4")
    return None if flags & 1 else doc_id, ids


def writer(address: str, tokenizer: str, end_id: int):
    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(address)
        task = TaskContext.get()
        shard, name = task.partitionId(), f"{folder}/part-{task.partitionId():07d}"
        attempt = f"{name}.{task.taskAttemptId()}"
        offsets, ids_written, at = [], 0, 0
        coder = encoder(tokenizer)
        with store.open_output_stream(attempt) as out:
            for run in batches(rows):
                made = [np.frombuffer(x, "<u4") for x in coder.encode([text for _, text in run])]
                ids = [np.append(x, np.uint32(end_id)) for x in made]
                for frame in framed([record_of(d, x) for (d, _), x in zip(run, ids, strict=True)]):
                    offsets.append(at)
                    at += out.write(frame)
                ids_written += sum(map(len, ids))
        with store.open_output_stream(f"{attempt}.index") as out:
            out.write(np.array([*offsets, at], "<u8").tobytes())
        if not offsets:
            store.delete_file(attempt)
            store.delete_file(f"{attempt}.index")
            return
        store.move(f"{attempt}.index", f"{name}.index")
        store.move(attempt, f"{name}.records")
        yield pa.RecordBatch.from_pylist([{"shard": shard, "records": len(offsets), "ids": ids_written, "bytes": at}])

    return write


def write_records(docs: DataFrame, address: str, tokenizer: str = WORD_BPE, end_id: int = END_ID) -> list[tuple]:
    """Write all documents below the address; (shard, records, ids, bytes) of each file, in order."""
    store, folder = store_of(address)
    store.create_dir(folder, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = ["doc_id", "text"]
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions(*order)
    made = rows.mapInArrow(writer(address, tokenizer, end_id), "shard long, records long, ids long, bytes long")
    return sorted(tuple(x) for x in made.collect())  # one row for each file


def frames(store, path: str) -> Iterator[bytes]:
    """The records of a file, in order; a wrong checksum or a cut end raises."""
    with store.open_input_stream(path, buffer_size=1 << 20) as file:
        run: list[tuple[bytes, bytes, bytes]] = []
        held = 0
        while head := file.read(12):
            body = file.read(struct.unpack_from("<Q", head)[0] + 4) if len(head) == 12 else b""
            run.append((head, body[:-4], body[-4:]))
            held += len(body)
            if held > BATCH_CHARS:
                yield from checked(run, path)
                run, held = [], 0
        yield from checked(run, path)


def checked(run: list[tuple[bytes, bytes, bytes]], path: str) -> list[bytes]:
    heads = masked(crc32c_many([x[0][:8] for x in run])).astype("<u4")
    bodies = masked(crc32c_many([x[1] for x in run])).astype("<u4")
    for (head, _, tail), a, b in zip(run, heads, bodies, strict=True):
        if head[8:] != a.tobytes() or tail != b.tobytes():
            raise ValueError(f"checksum of a record in {path} is wrong")
    return [x[1] for x in run]


def read_at(address: str, shard: int, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in a file, through the offset index."""
    store, folder = store_of(address)
    name = f"{folder}/part-{shard:07d}"
    with store.open_input_file(f"{name}.index") as index:
        index.seek(8 * number)
        start, end = np.frombuffer(index.read(16), "<u8").tolist()
    with store.open_input_file(f"{name}.records") as data:
        data.seek(start)
        frame = data.read(end - start)
    return ids_of(checked([(frame[:12], frame[12:-4], frame[-4:])], name)[0])


def reader(address: str, with_ids: bool):
    def read(shards: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(address)
        for shard in (x for batch in shards for x in batch.to_pylist()):
            rows, held, start = [], 0, shard["start"]
            for record in frames(store, f"{folder}/part-{shard['shard']:07d}.records"):
                doc_id, ids = ids_of(record)
                row = {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
                rows.append(row | {"ids": ids} if with_ids else row)
                start, held = start + len(ids), held + len(ids) * with_ids + 32
                if held > BATCH_CHARS:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        return pa.RecordBatch.from_pylist(rows, pa.schema(kinds + [("ids", pa.list_(pa.int64()))] * with_ids))

    return read


def read_records(spark: SparkSession, address: str, files: list[tuple], with_ids: bool = True) -> DataFrame:
    """Every record of the files that write_records() named, a task for each file."""
    starts, at = [], 0
    for shard, _, ids, _ in files:
        starts.append((shard, at))
        at += ids
    todo = spark.createDataFrame(starts, "shard long, start long")
    todo = todo.repartitionByRange(max(1, len(starts)), "shard")
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return todo.mapInArrow(reader(address, with_ids), columns)


def op6_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as records and read back."""
    address = shared_folder(spark, "records")
    files = write_records(table(spark, sf_dir, "documents"), address)
    return read_records(spark, address, files, with_ids=False)
