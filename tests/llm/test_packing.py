from __future__ import annotations

import array
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paceline.llm import bins, packing
from paceline.llm.common import table
from paceline.llm.tokens import BYTE_BPE, WORD_BPE, encoder
from tests.conftest import SF_DIR


def fewest(items: list[int], capacity: int) -> int:
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i: int, rooms: list[int]) -> None:
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        tried = set()
        for k, room in enumerate(rooms):
            if room >= items[i] and room not in tried:
                tried.add(room)
                rooms[k] -= items[i]
                go(i + 1, rooms)
                rooms[k] += items[i]
        rooms.append(capacity - items[i])
        go(i + 1, rooms)
        rooms.pop()

    go(0, [])
    return best[0]


def test_bin_completion_finds_the_fewest_bins():
    rng = random.Random(1)
    for _ in range(120):
        capacity = rng.randint(10, 60)
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 10)))
        packed = bins.complete(counts, capacity)
        held = Counter()
        for filling, n in packed:
            assert sum(filling) <= capacity and n > 0
            for size in filling:
                held[size] += n
        least = fewest(list(counts.elements()), capacity)
        assert held == counts
        assert bins.bins_of(packed) == least >= bins.lower_bound(counts, capacity)


def test_search_improves_on_best_fit_for_many_items():
    rng = random.Random(2)
    counts = Counter(rng.randint(300, 1100) for _ in range(50_000))
    assert bins.bins_of(bins.complete(counts, 2048)) < bins.bins_of(bins.best_fit(counts, 2048))


def test_a_filling_dominates_what_fits_into_its_sizes():
    assert bins.dominates((5,), (3, 2)) and bins.dominates((4, 3), (3, 3)) and not bins.dominates((4,), (3, 2))


ODD = ["", " ", "a  b", "a   b", "a \n b\n\n  c", "don't <|endoftext|> x", "\x1c a \x85  b ", "Σας ΟΔΟΣ", "tail  ", "a　 　b"]
ODD += ["x\0 y  z", "123 45,6 ##", "a\t b \t c", "é ﬁ İ", "wörd," * 3, "…— «x»"]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_words_encode_as_whole_texts_do(name):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    wanted = [array.array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in ODD]
    assert encoder(name).encode(ODD) == wanted
    assert encoder(name).encode(ODD) == wanted  # from memory


PARTS = ["a", "b ", " ", "  ", "\n", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "é", "É", "日本", "ß", "İ", "́", "'s", "123", "...", " ", "　", "\x1c", "\x85"]
PARTS += ["🎉", "don't", "X", "\t", "ǅ", "ﬁ", "<|ENDOFTEXT|>", "\u200d", "\ufeff", "क्", "힣"]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_ids_are_the_library_s_own_over_odd_texts(name):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(4_000)]
    texts += ["a <|endoftext|> b", "<|startoftext|>x", "<|endoftext|><|endoftext|>", ""]
    wanted = [array.array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert encoder(name).encode(texts) == wanted


def check(docs, rows, capacity):
    whole = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    wanted = Counter()
    for doc_id, text in docs:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[doc_id, k, a, b - a, zlib.crc32(array.array("I", ids[a:b]).tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_query_places_every_piece(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    rows = packing.op1_best_fit_packing(spark, SF_DIR).collect()
    used = check(docs, rows, packing.CAPACITY)
    assert used <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1


def test_nulls_long_texts_repeats_and_foreign_columns(odd):
    rows = packing.pack_documents(odd).collect()
    check(odd.select("doc_id", "text").collect(), rows, packing.CAPACITY)


def test_empty_table(none):
    assert packing.pack_documents(none).count() == 0


def test_sequences_hold_their_pieces_ids(odd):
    packed = packing.pack(packing.cut_documents(odd, capacity=64, with_ids=True), 64)
    made = packing.sequences(packed)
    assert made.where(F.length("ids") != 4 * F.col("length")).count() == 0
    assert made.agg(F.sum("length")).first() == packed.agg(F.sum("length")).first()


def test_a_worker_forgets_its_words_where_asked():
    rows = [(1, "Some words, and more words.", "en"), (2, None, "de"), (None, "", None), (4, "end", "en")]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["doc_id", "text", "lang"])
    encoder.cache_clear()
    made = {}
    for remember in (True, False):
        cut = packing.cutter(BYTE_BPE, 4, 0, False, True, remember)
        made[remember] = [r for part in cut(iter([batch, batch])) for r in part.to_pylist()]
        assert encoder.cache_info().currsize == remember
    assert made[True] == made[False]
    check([(1, rows[0][1]), (2, None), (None, ""), (4, "end")] * 2, [Row(**r, sequence_id=k, offset=0) for k, r in enumerate(made[True])], 4)
