"""SimHash near-duplicates by multi-index hashing.

Fingerprints: every shingle's XXH64 votes on 64 bits. Linking: if two fingerprints
differ in at most three bits, one of their halves differs in at most one. So each
fingerprint looks up, for both halves, its own half and those one bit away; what it meets
there is held against the full distance. A half that many different fingerprints share
would make all their pairs; there the other half is indexed as well: fingerprints
meet at the values one bit (or two) away from them, which costs a fixed number of rows
each, whatever the size of the crowd. Both ways are exact.

Documents of one fingerprint count as one node, named by the smallest doc_id; components
come from rounds of large-star and small-star steps over written tables.

A null or wordless text has fingerprint zero. Rows with a null doc_id are fingerprinted
and linked, but never name a component (it stays null if no other row is in it). Repeated
rows give a row each. An empty table gives no row. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.binary_records import batches
from paceline.llm.common import shared_folder, stored, table

SHINGLE = 3
DISTANCE = 3
SEED = 42
HALF = 32
#: Different fingerprints of one half from which the other half is indexed as well.
CROWD = 64
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, shingle: int) -> list[int]:
    words = text.encode(errors="surrogatepass").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose hashes stand one after the other; counts: of each."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    ends = np.cumsum(counts[full])
    firsts = ends - counts[full]
    # byte lanes hold sums of up to 255 bits, so a document is summed in runs of 255
    runs = -(-counts[full] // 255)
    run_of = np.repeat(np.arange(len(full)), runs)
    place = np.arange(len(run_of)) - np.repeat(np.cumsum(runs) - runs, runs)
    cuts = firsts[run_of] + 255 * place
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, cuts)
        lanes = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
        votes = np.add.reduceat(lanes, np.cumsum(runs) - runs, axis=0)
        over = 2 * votes > counts[full][:, None]
        for lane in range(8):
            out[full] |= over[:, lane].astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def fingerprinter(shingle: int):
    def fingerprint(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in batches(rows):
            hashes = [np.array(shingle_hashes(text, shingle), np.uint64) for _, text in run]
            counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
            made = majority(np.concatenate(hashes), counts).view(np.int64)
            ids = pa.array([doc_id for doc_id, _ in run], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(made)], ["doc_id", "simhash"])

    return fingerprint


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit integer."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(fingerprinter(shingle), "doc_id long, simhash long")


def bits_between(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def one_bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def halves(nodes: DataFrame) -> DataFrame:
    """Two rows for each fingerprint: which half, its value, the other half's value."""
    low = F.col("simhash").bitwiseAND(0xFFFFFFFF)
    high = F.shiftrightunsigned("simhash", HALF)
    cut = F.array(
        F.struct(F.lit(0).alias("half"), high.alias("key"), low.alias("rest")),
        F.struct(F.lit(1).alias("half"), low.alias("key"), high.alias("rest")),
    )
    return nodes.select("simhash", F.inline(cut))


def probes(entries: DataFrame) -> DataFrame:
    """The entries, and for each bit that is not set in a key a row with that bit set (`bit` 1).

    Of two keys that differ in one bit only one sets it, so each pair meets once.
    """
    bits = F.sequence(F.lit(0), F.lit(HALF - 1))
    unset = F.filter(bits, lambda k: F.col("key").bitwiseAND(one_bit(k)) == 0)
    keys = F.concat(
        F.array(F.struct(F.col("key").alias("key"), F.lit(0).alias("bit"))),
        F.transform(unset, lambda k: F.struct(F.col("key").bitwiseOR(one_bit(k)).alias("key"), F.lit(1).alias("bit"))),
    )
    return entries.select("simhash", "half", "rest", F.inline(keys))


def near_pairs(asked: DataFrame, entries: DataFrame) -> DataFrame:
    held = entries.select("half", "key", F.col("simhash").alias("other"))
    met = asked.join(held, ["half", "key"])
    new = (F.col("bit") == 1) | (F.col("simhash") < F.col("other"))
    near = bits_between(F.col("simhash"), F.col("other")) <= DISTANCE
    return met.where(new & near).select(F.col("simhash").alias("a"), F.col("other").alias("b"))


def crowd_edges(asked: DataFrame) -> DataFrame:
    """Links inside crowded keys, as a star for each value of the other half that is met.

    Fingerprints of the key itself (bit 0) meet at values up to one bit from their other
    half (ring 1 or less) and at those two bits away (ring 2); those one bit beside the
    key (bit 1) at up to one. Whoever meets a value beside a bit 0 of ring 1 or less is
    within three bits of it, and any two within three bits meet at such a value. A value
    holds a fixed number of fingerprints at most.
    """
    bits = F.sequence(F.lit(0), F.lit(HALF - 1))

    def turned(k: Column) -> Column:
        return F.col("rest").bitwiseXOR(one_bit(k))

    ring = lambda n, value: F.struct(F.lit(n).alias("ring"), value.alias("value"))
    own = F.array(ring(0, F.col("rest")))
    first = F.transform(bits, lambda k: ring(1, turned(k)))
    second = F.flatten(
        F.transform(bits, lambda k: F.transform(F.sequence(F.lit(0), k), lambda j: ring(2, turned(k).bitwiseXOR(one_bit(j)))))
    )
    apart = F.filter(second, lambda x: x["value"] != F.col("rest"))
    values = F.when(F.col("bit") == 0, F.concat(own, first, apart)).otherwise(F.concat(own, first))
    met = asked.select("simhash", "half", "key", "bit", F.inline(values))
    inner = F.when((F.col("bit") == 0) & (F.col("ring") <= 1), F.col("simhash"))
    stars = met.groupBy("half", "key", "value").agg(F.min(inner).alias("b"), F.collect_set("simhash").alias("around"))
    stars = stars.where(F.col("b").isNotNull() & (F.size("around") > 1))
    return stars.select(F.explode("around").alias("a"), "b").where("a <> b")


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within DISTANCE bits."""
    entries = halves(nodes)
    asked = probes(entries)
    crowds = entries.groupBy("half", "key").count().where(F.col("count") > crowd).select("half", "key")
    pairs = near_pairs(asked.join(crowds, ["half", "key"], "left_anti"), entries)
    return pairs.unionByName(crowd_edges(asked.join(crowds, ["half", "key"], "left_semi"))).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def stars(edges: DataFrame, folder: str) -> DataFrame:
    """Each connected node `a` but the least of its component, with that least as `b`."""
    now, seen, turn = stored(edges, f"{folder}/edges-0"), None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if state == seen:
            return now
        seen, turn = state, turn + 1
        now = stored(small_star(large_star(now)), f"{folder}/edges-{turn}")


def near_groups(prints: DataFrame, folder: str, crowd: int = CROWD) -> DataFrame:
    """`component_id` of every row of doc_id and simhash; `prints` must be cheap to read again."""
    nodes = stored(prints.groupBy("simhash").agg(F.min("doc_id").alias("least")), f"{folder}/nodes")
    root = stars(links(nodes.select("simhash"), crowd), folder).select(F.col("a").alias("simhash"), F.col("b").alias("root"))
    linked = nodes.join(root, "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(names, "root").select("simhash", "component_id")
    return prints.join(named, "simhash")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    folder = shared_folder(docs.sparkSession, "simhash")
    prints = stored(fingerprints(docs, shingle), f"{folder}/prints")
    shown = F.lower(F.lpad(F.hex("simhash"), 16, "0"))
    return near_groups(prints, folder, crowd).select("doc_id", shown.alias("fingerprint"), "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
