from __future__ import annotations

import array
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from paceline.llm import binary_records as records
from paceline.llm.common import shared_folder, store_of, table
from paceline.llm.crc32c import byte_table, crc32c_many
from tests.conftest import SF_DIR


def one_by_one(data: bytes) -> int:
    value = 0xFFFFFFFF
    for b in data:
        value = int(byte_table()[(value ^ b) & 255]) ^ (value >> 8)
    return value ^ 0xFFFFFFFF


def test_checksums():
    assert crc32c_many([b"123456789"]).tolist() == [0xE3069283]  # the published check value
    rng = random.Random(1)
    parts = [os.urandom(rng.randint(0, 500)) for _ in range(200)] + [b"", b"a", b"abc"]
    assert crc32c_many(parts).tolist() == [one_by_one(x) for x in parts]


def expected(docs):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, out = 0, []
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(array.array("I", ids).tobytes())))
        start += len(ids)
    return out


def test_query_reads_back_every_document(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    rows = records.op6_binary_records(spark, SF_DIR).collect()
    assert sorted(map(tuple, rows)) == expected(docs)


@pytest.fixture(scope="module")
def written(spark, odd):
    address = shared_folder(spark, "test")
    return address, records.write_records(odd, address)


def test_nulls_repeats_and_long_texts(spark, odd, written):
    rows = records.read_records(spark, *written).drop("ids").orderBy("start").collect()
    assert [tuple(r) for r in rows] == expected(odd.select("doc_id", "text").collect())


def test_offset_index_gives_single_records(spark, written):
    address, files = written
    rows = records.read_records(spark, address, files).orderBy("start").collect()
    at = 0
    for shard, n, _, _ in files:
        for k in reversed(range(n)):
            doc_id, ids = records.read_at(address, shard, k)
            assert (doc_id, ids.tolist()) == (rows[at + k].doc_id, rows[at + k].ids)
        at += n


def test_a_changed_byte_is_found(written, tmp_path):
    store, folder = store_of(written[0])
    name = f"{folder}/part-{written[1][0][0]:07d}.records"
    data = bytearray(store.open_input_stream(name).read())
    data[30] ^= 1
    (tmp_path / "bad").write_bytes(data)
    with pytest.raises(ValueError, match="checksum"):
        list(records.frames(store, str(tmp_path / "bad")))


def test_wide_ids_and_no_id():
    ids = np.array([1, 70_000], "<u4")
    assert records.ids_of(records.record_of(None, ids))[0] is None
    assert records.ids_of(records.record_of(7, ids))[1].tolist() == [1, 70_000]


def test_empty_table(spark, none):
    address = shared_folder(spark, "test")
    files = records.write_records(none, address)
    assert files == [] and records.read_records(spark, address, files).count() == 0


def test_runs_are_the_same_however_a_batch_is_sliced(monkeypatch):
    rows = [(k, "x" * (k % 7) if k % 5 else None, k % 3) for k in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["doc_id", "text", "other"])
    monkeypatch.setattr(records, "BATCH_CHARS", 20)
    made = []
    for n in (3, 1000):
        monkeypatch.setattr(records, "SLICE_ROWS", n)
        made.append(list(records.batches(iter([batch, batch.slice(0, 0), batch]), 3)))
    assert made[0] == made[1] and [r for run in made[0] for r in run] == [(k, t or "", o) for k, t, o in rows] * 2
    assert all(20 <= sum(len(t) for _, t, _ in run) < 27 for run in made[0][:-1])
