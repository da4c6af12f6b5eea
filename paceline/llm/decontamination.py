"""Benchmark passages in documents, by latent semantic retrieval.

1. The words of every document become 32-bit hashes, written once.
2. Passages are windows of 32 words, 16 apart. The vocabulary is the benchmark's; how
   many passages of all documents hold each word is counted, and gives its weight. All
   other words weigh as one that no passage had.
3. The benchmark's TF-IDF passages are taken in parts of at most `rank`, and a randomised
   SVD of each part, the products A'(A X) spread over Spark's tasks, gives its latent
   space. A space so has room for all passages of its part, and a copy of any of them
   keeps its cosine however many passages the benchmark has.
4. Every passage of every document is projected into each part's space and held against
   its benchmark passages by cosine. For each of some groups of a part's passages (GROUPS
   in all, or one for each part), the most that a word adds to a product with any of them
   is known; passages whose words cannot reach the least cosine with any group of a part
   are left out before the projection into its space, which loses none.
5. What comes up is verified: the longest common subsequence with the item's words, and
   its answer (column `answer`, or else its last sentence) among them.

The benchmark is taken in blocks of `block` passages, so that what is sent to the tasks
(hashes, weights, latent vectors of one block) does not grow with it.

A null text has no words and neither leaks nor is leaked. Items of under 8 words are too
short to tell a leak and are not searched for. Repeated rows give rows each; a null
doc_id is reported as null. Empty tables give no row. Extra columns are left out.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.binary_records import batches
from paceline.llm.common import shared_folder, stored, table

STEP = 16
WINDOW = 2 * STEP
RANK = 256
OVERSAMPLE = 16
POWERS = 2
SEED = 42
LEAST_WORDS = 8
LEAST_COSINE = 0.25
#: Share of an item's words that occur in order: enough alone, and enough with the answer.
SURE_SHARE = 0.85
LEAST_SHARE = 0.6
LEAST_ANSWER = 0.5
BLOCK = 4000
GROUPS = 16
RUN_WORDS = 300_000
SPACED = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
SENTENCE = re.compile(r"(?<=[.?!])\s+")
FILTER_BITS = 20


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").lower().encode(errors="surrogatepass").translate(SPACED).split()
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in batches(rows):
        words = [word_hashes(text).tobytes() for _, text in run]
        ids = pa.array([doc_id for doc_id, _ in run], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.binary())], ["doc_id", "words"])


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    answer: np.ndarray


def items_of(rows: list) -> list[Item]:
    out = []
    for item_id, text, answer in rows:
        words = word_hashes(text)
        if len(words) >= LEAST_WORDS:
            last = word_hashes(answer) if answer else word_hashes(SENTENCE.split((text or "").strip())[-1])
            out.append(Item(item_id, words, last))
    return out


def passages_of(items: list[Item]) -> list[tuple[int, np.ndarray]]:
    """(place of the item, words) of each window; the last of an item may be shorter."""
    return [
        (k, x.words[at : at + WINDOW])
        for k, x in enumerate(items)
        for at in range(0, max(1, len(x.words) - WINDOW + STEP), STEP)
    ]


class Vocabulary:
    """The place of a hash among the benchmark's sorted hashes, -1 for any other."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[hashes & ((1 << FILTER_BITS) - 1)] = True

    def places(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, np.int32)
        hits = np.flatnonzero(self.maybe[words & ((1 << FILTER_BITS) - 1)])
        at = np.minimum(np.searchsorted(self.hashes, words[hits]), len(self.hashes) - 1)
        same = self.hashes[at] == words[hits]
        out[hits[same]] = at[same]
        return out


def documents_of(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Runs of documents: ids, all words one after the other, number of words of each.

    A run has at most RUN_WORDS words, or one document.
    """
    ids: list = []
    words: list[np.ndarray] = []
    held = 0
    for batch in rows:
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            words.append(np.frombuffer(data.as_buffer(), np.uint32))
            held += len(words[-1])
            if held >= RUN_WORDS:
                yield ids, np.concatenate(words), np.fromiter(map(len, words), np.int64, len(words))
                ids, words, held = [], [], 0
    if ids:
        yield ids, np.concatenate(words), np.fromiter(map(len, words), np.int64, len(words))


def steps_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step that each word is in (steps of all documents numbered through), and each document's first step."""
    steps = -(-sizes // STEP)
    first = np.cumsum(steps) - steps
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(first, sizes) + inside // STEP, first


def counter(hashes: np.ndarray):
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen, passages = Vocabulary(hashes), np.zeros(len(hashes), np.int64), 0
        for _, words, sizes in documents_of(rows):
            step, _ = steps_of(sizes)
            place = vocabulary.places(words)
            known = place >= 0
            pairs = np.unique(step[known] * len(hashes) + place[known])
            seen += np.bincount(pairs % len(hashes), minlength=len(hashes))
            passages += int(step[-1]) + 1 if len(step) else 0
        found = np.flatnonzero(seen)
        places, counts = np.append(found, -1), np.append(seen[found], passages)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(counts)], ["place", "n"])

    return count


def weights_of(words: DataFrame, hashes: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each vocabulary word by the steps of all documents that hold it, and of any other word."""
    made = words.mapInArrow(counter(hashes), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(hashes) + 1)
    for place, n in made:
        counts[place] = n
    total = counts[-1]
    return np.log((1 + total) / (1 + counts[:-1])) + 0.1, float(np.log(1 + total) + 0.1)


def product(passages: DataFrame, x: np.ndarray) -> np.ndarray:
    """A'(A X) over all passages: tasks add up their own rows, then groups of words are summed."""
    sent = passages.sparkSession.sparkContext.broadcast(x)

    def partial(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[int, np.ndarray] = {}
        for batch in rows:
            for places, weights in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                value = np.asarray(weights) @ sent.value[places]
                for p, w in zip(places, weights, strict=True):
                    now[p] = now.get(p, 0) + w * value
        if now:
            vectors = pa.array([v.astype(np.float64).tobytes() for v in now.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(now), pa.int64()), vectors], ["place", "vector"])

    def total(group: pd.DataFrame) -> pd.DataFrame:
        sums = group.groupby("place")["vector"].agg(lambda x: sum(np.frombuffer(v) for v in x).tobytes())
        return sums.reset_index()

    parts = passages.mapInArrow(partial, "place long, vector binary")
    summed = parts.groupBy(F.col("place") % 64).applyInPandas(total, "place long, vector binary")
    out = np.zeros_like(x)
    for place, vector in summed.toLocalIterator():
        out[place] = np.frombuffer(vector)
    return out


def latent_space(spark: SparkSession, rows: list[tuple[np.ndarray, np.ndarray]], words: int, rank: int) -> np.ndarray:
    """Right singular vectors (words x rank) of the passages, each given by places and weights."""
    frame = spark.createDataFrame([(p.tolist(), w.tolist()) for p, w in rows], "places array<long>, weights array<double>")
    frame = frame.repartition(max(1, len(rows) // 500))
    width = min(rank + OVERSAMPLE, len(rows), words)
    basis = np.random.default_rng(SEED).standard_normal((words, width))
    # where the basis is as wide as there are passages, the first product spans them all
    for _ in range(POWERS if width < len(rows) else 1):
        basis = np.linalg.qr(product(frame, basis))[0]
    values, turn = np.linalg.eigh(basis.T @ product(frame, basis))
    kept = np.argsort(values)[::-1][:rank]
    kept = kept[values[kept] > 1e-9 * max(values.max(), 1e-300)]
    return basis @ turn[:, kept]


def bag(places: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and their count times weight."""
    found, n = np.unique(places, return_counts=True)
    return found, n * weights[found]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence: one bit for each word of `a`."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        both = row & masks.get(x, 0)
        row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


@dataclass
class Part:
    """The latent space of at most `rank` passages."""

    own: np.ndarray  # row of the space of each word of the block, -1 for words of other parts
    space: np.ndarray  # words of the part x rank
    vectors: np.ndarray  # rank x passages, each of length one
    reach: list[np.ndarray]  # for each group of passages, the most that an occurrence of each word of the block adds to a product
    owner: np.ndarray  # item of each passage

    @classmethod
    def of(
        cls, spark: SparkSession, bags: list[tuple[np.ndarray, np.ndarray]], owner: np.ndarray, weights: np.ndarray, rank: int, groups: int
    ) -> Part:
        found = np.unique(np.concatenate([p for p, _ in bags]))
        own = np.full(len(weights), -1, np.int32)
        own[found] = np.arange(len(found))
        bags = [(own[p], w) for p, w in bags]
        space = latent_space(spark, bags, len(found), rank)
        vectors = np.stack([w @ space[p] for p, w in bags], axis=1)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=0), 1e-12)
        reach = []
        for some in np.array_split(np.arange(len(bags)), min(groups, len(bags))):
            most = np.zeros(len(weights))
            most[found] = weights[found] * np.abs(space @ vectors[:, some]).max(axis=1)
            reach.append(most)
        return cls(own, space.astype(np.float32), vectors.astype(np.float32), reach, owner)


@dataclass
class Index:
    """What a task needs to search for one block of benchmark items."""

    hashes: np.ndarray
    weights: np.ndarray
    other: float
    parts: list[Part]
    items: list[Item]


def searcher(sent, least_cosine: float):
    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        vocabulary = Vocabulary(index.hashes)
        for ids, words, sizes in documents_of(rows):
            if not len(words):
                continue
            step, first = steps_of(sizes)
            place = vocabulary.places(words)
            known = place >= 0
            energy = np.where(known, index.weights[place] ** 2, index.other**2)
            count = int(step[-1]) + 1
            whole = np.bincount(step, energy, count)
            # a window is a step and the next one of the same document
            last = np.zeros(count, bool)
            last[(first + -(-sizes // STEP) - 1)[sizes > 0]] = True
            follows = np.flatnonzero(~last) + 1
            whole[~last] += whole[follows]
            least = 0.999 * least_cosine * np.sqrt(whole)
            near_part = np.zeros((len(index.parts), count), bool)
            known_step, known_place = step[known], place[known]
            for part, windows in zip(index.parts, near_part, strict=True):
                for reach in part.reach:
                    product_bound = np.bincount(known_step, reach[known_place], count)
                    product_bound[~last] += product_bound[follows]
                    windows |= product_bound >= least
            bounds, starts = np.cumsum(sizes), np.cumsum(sizes) - sizes
            best: dict[tuple[int, int], tuple] = {}
            for window in np.flatnonzero(near_part.any(axis=0)).tolist():
                doc = int(np.searchsorted(first, window, "right")) - 1
                while not sizes[doc]:
                    doc -= 1
                at = int(starts[doc]) + STEP * (window - int(first[doc]))
                end = min(at + WINDOW, int(bounds[doc]))
                own = place[at:end]
                places, weights = bag(own[own >= 0], index.weights)
                others = np.unique(words[at:end][own < 0], return_counts=True)[1]
                norm = np.sqrt(weights @ weights + index.other**2 * (others @ others))
                cosine_of: dict[int, float] = {}  # an item's passages may be in two parts
                for part in map(index.parts.__getitem__, np.flatnonzero(near_part[:, window])):
                    at_part = part.own[places]
                    inside = at_part >= 0
                    cosines = (weights[inside] @ part.space[at_part[inside]]) @ part.vectors / norm
                    for passage in np.flatnonzero(cosines >= least_cosine):
                        item = int(part.owner[passage])
                        cosine_of[item] = max(cosine_of.get(item, 0.0), float(cosines[passage]))
                for item, cosine in cosine_of.items():
                    verdict = verified(index.items[item], words[int(starts[doc]) : int(bounds[doc])], at - int(starts[doc]))
                    if verdict:
                        row = (verdict[0], verdict[1], cosine, at - int(starts[doc]))
                        best[doc, item] = max(best.get((doc, item), row), row)
            if best:
                yield pa.RecordBatch.from_pylist(
                    [
                        {"doc_id": ids[d], "item_id": index.items[k].item_id, "share": s, "answer_share": a, "cosine": c, "word": w}
                        for (d, k), (s, a, c, w) in best.items()
                    ],
                    pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("share", pa.float64()), ("answer_share", pa.float64()), ("cosine", pa.float64()), ("word", pa.int64())]),
                )

    return search


def verified(item: Item, words: np.ndarray, at: int) -> tuple[float, float] | None:
    """Shares of the item's and its answer's words, in order, around a window; None if too few."""
    n = len(item.words)
    around = words[max(0, at - n) : at + WINDOW + n]
    share = common_subsequence(item.words, around) / n
    if share < LEAST_SHARE:
        return None
    answer = common_subsequence(item.answer, around) / max(1, len(item.answer))
    return (share, answer) if share >= SURE_SHARE or answer >= LEAST_ANSWER else None


FOUND = "doc_id long, item_id long, share double, answer_share double, cosine double, word long"


def indexes(docs: DataFrame, benchmark: DataFrame, rank: int, block: int) -> Iterator[tuple[DataFrame, Index]]:
    """The documents' word hashes, stored, and an index of each block of benchmark items."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "decontamination")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    words = stored(texts.mapInArrow(hashed, "doc_id long, words binary"), f"{folder}/words")
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    asked = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer)
    rows = asked.toLocalIterator()
    while block_rows := list(islice(rows, block)):
        items = items_of(block_rows)
        passages = passages_of(items)
        if not passages:
            continue
        hashes = np.unique(np.concatenate([x.words for x in items]))
        weights, other = weights_of(words, hashes)
        bags = [bag(np.searchsorted(hashes, x), weights) for _, x in passages]
        # of length one, or the space would leave out short items first
        bags = [(p, w / np.linalg.norm(w)) for p, w in bags]
        owner = np.array([k for k, _ in passages])
        groups = max(1, GROUPS * rank // len(bags))  # of each part
        parts = [
            Part.of(spark, bags[at : at + rank], owner[at : at + rank], weights, rank, groups) for at in range(0, len(bags), rank)
        ]
        yield words, Index(hashes, weights, other, parts, items)


def contamination(
    docs: DataFrame, benchmark: DataFrame, rank: int = RANK, least_cosine: float = LEAST_COSINE, block: int = BLOCK
) -> DataFrame:
    """doc_id, item_id, shares, cosine and first word of the best window of each item found in each document."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], FOUND)
    for words, index in indexes(docs, benchmark, rank, block):
        found = found.unionByName(words.mapInArrow(searcher(spark.sparkContext.broadcast(index), least_cosine), FOUND))
    return found


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, rank: int = RANK, least_cosine: float = LEAST_COSINE, block: int = BLOCK
) -> DataFrame:
    """The documents in which contamination() finds no item, whole; decided where the rows are, without a shuffle."""
    spark, columns = docs.sparkSession, docs.columns
    kept = docs
    for _, index in indexes(docs, benchmark, rank, block):
        search = searcher(spark.sparkContext.broadcast(index), least_cosine)

        def keep(rows: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                place = pa.array(np.arange(len(batch)))
                texts = pa.RecordBatch.from_arrays([place, batch.column("text")], names=["doc_id", "text"])
                found = [x.column("doc_id").to_numpy() for x in search(hashed(iter([texts])))]
                clean = np.ones(len(batch), bool)
                clean[np.concatenate(found or [np.zeros(0, np.int64)])] = False
                yield pa.RecordBatch.from_arrays(batch.column("row").flatten(), names=columns).filter(pa.array(clean))

        rows = kept.select(F.struct(*columns).alias("row"), F.col("text").cast("string").alias("text"))
        kept = rows.mapInArrow(keep, docs.schema)
    return kept


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
