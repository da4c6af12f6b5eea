"""Best-fit packing of token sequences by bin completion.

Spark tokenizes and cuts the documents, counts the pieces of each length, and gives
every piece its place; only the count of each length (at most `capacity` numbers,
however many documents there are) goes through the search in bins.py, which answers
with fillings and how many sequences take each. Pieces of one length are
interchangeable: the k-th of them takes the k-th place for that length. Numbering them
is split by a hash, so that no task holds all pieces of a common length. Documents of unlike
languages can be packed apart; each language is then searched in a task of its own.

A null text is an empty one (its end id is packed). Repeated rows are packed once each.
An empty table gives no row. Extra columns are left out; a null doc_id is kept.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.binary_records import batches
from paceline.llm.bins import Packing, complete
from paceline.llm.common import partitions, release, shared_folder, stored, table
from paceline.llm.language_id import UNDETERMINED
from paceline.llm.tokens import BYTE_BPE, encoder, forget

CAPACITY = 2048
END_ID = 0
#: Words and characters that a worker holds at once where it leaves memory to other stages.
FEW_WORDS = 50_000
FEW_CHARS = 500_000
SLOT = "length long, low long, high long, each long, sequence long, at long"
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
KINDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def cutter(tokenizer: str, capacity: int, end_id: int, with_ids: bool, with_lang: bool, remember: bool = True):
    schema = pa.schema(KINDS + [("ids", pa.binary())] * with_ids + [("lang", pa.string())] * with_lang)
    end = end_id.to_bytes(4, "little")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer) if remember else encoder(tokenizer, FEW_WORDS)
        for run in batches(rows, 2 + with_lang, None if remember else FEW_CHARS):
            out: list[list] = [[] for _ in schema]
            for (doc_id, _, *lang), ids in zip(run, coder.encode([text for _, text, *_ in run]), strict=True):
                ids += end
                start, stop = 0, 4 * ((len(ids) // 4 - 1) % capacity + 1)
                for piece in range(-(-len(ids) // (4 * capacity))):
                    part = ids[start:stop]
                    row = (doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids, *lang)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start, stop = stop, stop + 4 * capacity
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
        if not remember:
            forget()
            release()

    return cut


def cut_documents(
    docs: DataFrame,
    tokenizer: str = BYTE_BPE,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    with_lang: bool = False,
    remember: bool = True,
) -> DataFrame:
    """Pieces of at most `capacity` tokens; of a longer document only the first may be shorter.

    with_ids adds `ids`: the piece's ids as little-endian 32-bit integers. with_lang adds the
    document's `lang`. Without `remember` a worker holds FEW_WORDS words it has met, and neither
    them nor the tokenizer beyond a task, which leaves memory to the other stages of a job.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col("lang").cast("string")] * with_lang)
    cut = cutter(tokenizer, capacity, end_id, with_ids, with_lang, remember)
    return rows.mapInArrow(cut, PIECE + ", ids binary" * with_ids + ", lang string" * with_lang)


def places(packing: Packing) -> list[tuple]:
    """(length, first rank, rank after the last, pieces in each sequence, first sequence, offset)."""
    out, taken, sequence = [], defaultdict(int), 0
    for filling, n in packing:
        offset = 0
        for length, each in sorted(Counter(filling).items(), reverse=True):
            out.append((length, taken[length], taken[length] + n * each, each, sequence, offset))
            taken[length] += n * each
            offset += length * each
        sequence += n
    return out


def ranked(pieces: DataFrame, parts: int, *apart: str) -> DataFrame:
    """`rank`: from 0, without gaps among the pieces of each length (and equal columns `apart`)."""
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))
    rows = pieces.withColumn("salt", salt)
    before = Window.partitionBy(*apart, "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*apart, "length", "salt").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy(*apart, "length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("within", F.row_number().over(within) - 1)
    return rows.join(base, [*apart, "length", "salt"]).withColumn("rank", F.col("base") + F.col("within")).drop("salt", "base", "within")


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = 4000) -> DataFrame:
    """`sequence_id` and `offset` of every piece; `pieces` must be cheap to read three times."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(places(complete(counts, capacity, nodes)), SLOT)
    # one row for each length: at most `capacity`
    return placed(ranked(pieces, partitions(spark)), F.broadcast(slots_of(slots, "length")), "length")


def pack_apart(pieces: DataFrame, address: str, capacity: int = CAPACITY, nodes: int = 4000) -> DataFrame:
    """pack() of each `lang` alone: no sequence holds pieces of two. A null one is a language too, `und`."""
    spark = pieces.sparkSession
    pieces = pieces.withColumn("apart", F.coalesce("lang", F.lit(UNDETERMINED)))

    def search(counts: pa.Table) -> pa.Table:
        """Slots of one language: its counts are at most `capacity` rows."""
        of = dict(zip(counts.column("length").to_pylist(), counts.column("n").to_pylist(), strict=True))
        found = places(complete(of, capacity, nodes))
        columns = [pa.array([row[k] for row in found], pa.int64()) for k in range(6)]
        name = pa.array([counts.column("apart")[0].as_py()] * len(found), pa.string())
        return pa.table([name, *columns], names=["apart", "length", "low", "high", "each", "sequence", "at"])

    counts = pieces.groupBy("apart", "length").agg(F.count("*").alias("n"))
    slots = stored(counts.groupBy("apart").applyInArrow(search, f"apart string, {SLOT}"), f"{address}/slots")
    # one row for each language
    used = slots.groupBy("apart").agg(F.max(F.expr("sequence + (high - low) div each")).alias("used"))
    before = Window.orderBy("apart").rowsBetween(Window.unboundedPreceding, -1)
    first = used.select("apart", F.coalesce(F.sum("used").over(before), F.lit(0)).alias("first"))
    slots = slots.join(first, "apart").withColumn("sequence", F.col("first") + F.col("sequence"))
    rows = ranked(pieces, partitions(spark), "apart")
    return placed(rows, stored(slots_of(slots, "apart", "length"), f"{address}/places"), "apart", "length").drop("apart")


def slots_of(slots: DataFrame, *key: str) -> DataFrame:
    return slots.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("low", "high", "each", "sequence", "at"))).alias("slots"))


def placed(ranks: DataFrame, slots: DataFrame, *key: str) -> DataFrame:
    """`sequence_id` and `offset` of every piece, from its rank and the slots of its key."""

    def holds(slot: Column) -> Column:
        return (slot["low"] <= F.col("rank")) & (F.col("rank") < slot["high"])

    slot = F.filter("slots", holds)[0]
    rows = ranks.join(slots, [*key]).withColumn("slot", slot)
    place = F.col("rank") - F.col("slot.low")
    each = F.col("slot.each")
    sequence = F.col("slot.sequence") + F.floor(place / each)
    offset = F.col("slot.at") + place % each * F.col("length")
    return rows.withColumns({"sequence_id": sequence.cast("long"), "offset": offset.cast("long")}).drop("slots", "slot", "rank")


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from pieces that carry ids: at most `capacity` ids a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_ids, x: F.concat(all_ids, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = stored(cut_documents(docs), shared_folder(docs.sparkSession, "pieces"))
    columns = [name for name, _ in KINDS]
    return pack(pieces).select(*columns, "sequence_id", "offset")


def pack_languages(docs: DataFrame) -> DataFrame:
    """pack_documents() with each sequence in one language, which is added: `lang`."""
    folder = shared_folder(docs.sparkSession, "pieces")
    pieces = stored(cut_documents(docs, with_lang=True, remember=False), f"{folder}/pieces")
    columns = [name for name, _ in KINDS]
    return pack_apart(pieces, folder).select(*columns, "sequence_id", "offset", "lang")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
