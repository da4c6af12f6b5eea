"""Masked pseudo-likelihood scores from a bidirectional window network, trained in NumPy.

The network sees two words on either side of a place and predicts the word there: its
class first, then its number within the class. Every word of the corpus takes part: the
most frequent have a number of their own, the others share some numbers by their last
letters, and a word's share of its number is its count among all words of that number, over
the whole corpus. So what is gathered grows with the corpus: a count for every different
word. The chance of a word is that of its number times its share; over all words, and a
reserve in each shared number for words never seen, chances sum to one. A document's score
is the sum of the log-probabilities of all its words.

Words are split and coded once, in runs of documents, each with the list of its own words.
Those lists are counted; counts over one, and the numbers of frequent words, go back to the
runs that hold them, which hold no words by then but places and the words' shared numbers. Training and scoring then read written numbers.

Training reads every document once: each task runs AdaGrad over its own documents from
the same start, and the tasks' weights are averaged by words seen. That happens in
`rounds` rounds, each over its own share of the documents, from the last average.

A null or empty text has no words: sum 0, mean null. Repeated rows give rows each; a
null doc_id is kept. An empty table gives no row. Extra columns are left out.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.binary_records import batches
from paceline.llm.common import shared_folder, table

SIDE = 32  # classes, and words in each
WORDS = SIDE * SIDE
SHARED = 64  # numbers that rare words share
SIDES = 2  # words seen on either side
SIZE = 16
HIDDEN = 32
BATCH = 4096
SCORED = 1024  # words scored together: what they need stays in a processor's cache
RATE = 0.05
ROUNDS = 2
SEED = 42
SLICES = 64
LONGEST = 32  # bytes of a word with a number of its own
RUN_WORDS = 500_000  # words that are scored or trained on together
SHAPES = {
    "words": (WORDS, SIZE),
    "input": (2 * SIDES * SIZE, HIDDEN),
    "input_bias": (HIDDEN,),
    "classes": (HIDDEN, SIDE),
    "class_bias": (SIDE,),
    "within": (HIDDEN, SIDE),
    "within_bias": (SIDE, SIDE),
}
Weights = dict[str, np.ndarray]


def start_weights() -> Weights:
    rng = np.random.default_rng(SEED)
    return {k: (rng.standard_normal(s) * 0.1 if "bias" not in k else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def coded(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of some texts (A-Z lower-cased), the place of each word among them, and words of each text."""
    cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    found = cut.values.dictionary_encode()
    names = [x.lower() for x in found.dictionary.cast(pa.large_binary()).to_pylist()]
    places: dict[bytes, int] = {}
    # white space that begins or ends a text leaves an empty word
    place = np.array([places.setdefault(x, len(places)) if x else -1 for x in names], np.int64)
    codes = place[found.indices.to_numpy()]
    text = np.repeat(np.arange(len(texts)), cut.value_lengths().to_numpy())[codes >= 0]
    return list(places), codes[codes >= 0], np.bincount(text, minlength=len(texts))


def code(rows: Iterator[pa.RecordBatch], narrow: bool = False) -> Iterator[pa.RecordBatch]:
    """For each run of documents a row for each document and one with the run's words and their counts.

    narrow: places in 16 bits where they are enough, and for each word its shared number (`ends`).
    """
    words_type, counts_type = pa.list_(pa.binary()), pa.list_(pa.int64())
    for run in batches(rows):
        words, codes, sizes = coded([text for _, text in run])
        stops = np.cumsum(sizes)
        held = codes.astype(width(len(words)) if narrow else "<i4")
        parts = [held[a:b].tobytes() for a, b in zip(stops - sizes, stops, strict=True)]
        name, n = uuid.uuid4().int >> 65, len(run)
        counts = np.bincount(codes, minlength=len(words))
        made = {
            "run": pa.array([name] * (n + 1), pa.int64()),
            "doc_id": pa.array([doc_id for doc_id, _ in run] + [None], pa.int64()),
            "codes": pa.array([*parts, None], pa.binary()),
            "words": pa.array([None] * n + [words], words_type),
            "counts": pa.array([None] * n + [counts], counts_type),
        }
        if narrow:
            made["ends"] = pa.array([None] * n + [bytes([zlib.crc32(x[-3:]) % SHARED for x in words])], pa.binary())
        yield pa.RecordBatch.from_pydict(made)


NARROW = "run long, doc_id long, codes binary, words array<binary>, counts array<long>, ends binary"


def width(words: int) -> str:
    return "<u2" if words <= 1 << 16 else "<i4"


def word_counts(runs: DataFrame) -> DataFrame:
    """word and total: how often every word occurs in the corpus."""
    pairs = runs.where("words IS NOT NULL").select(F.inline(F.arrays_zip("words", "counts")))
    return pairs.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("total"))


def vocabulary(counts: DataFrame) -> dict[bytes, int]:
    """Numbers of the most frequent words, by falling count; 0 is outside a text."""
    top = counts.where(F.length("word") <= LONGEST).orderBy(F.desc("total"), "word").limit(WORDS - SHARED - 1)
    return {bytes(r[0]): k + 1 for k, r in enumerate(top.collect())}


def number_of(word: bytes, numbers: dict[bytes, int]) -> int:
    return numbers.get(word) or WORDS - SHARED + zlib.crc32(word[-3:]) % SHARED


def number_totals(counts: DataFrame, numbers: dict[bytes, int]) -> np.ndarray:
    """For each number how many words of the corpus have it, and one more for a shared one: the words never seen."""
    own = counts.sparkSession.createDataFrame(list(numbers.items()), "word binary, own int")  # under WORDS rows
    shared = F.lit(WORDS - SHARED) + F.crc32(F.expr("substring(word, -3)")) % SHARED
    numbered = counts.join(F.broadcast(own), "word", "left").groupBy(F.coalesce("own", shared.cast("int")).alias("number"))
    out = np.zeros(WORDS)
    for number, total in numbered.agg(F.sum("total")).collect():  # at most WORDS rows
        out[number] = total
    out[WORDS - SHARED :] += 1
    return out


def log_shares(words: list[bytes], counts: np.ndarray, numbers: dict[bytes, int], totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers, and the logs of their shares of them; a word with a number of its own has all of it."""
    number = np.array([number_of(w, numbers) for w in words], np.int64)
    return number, shares(counts, number, totals)


def shares(counts: np.ndarray, number: np.ndarray, totals: np.ndarray) -> np.ndarray:
    return np.where(number < WORDS - SHARED, 0.0, np.log(counts) - np.log(np.maximum(totals[number], 1)))


def numberer(sent):
    def number(rows: pa.Table, known: pa.Table) -> pa.Table:
        """The documents of a run with the numbers of their words, and the sum of the words' log shares."""
        totals = sent.value
        ends = np.frombuffer(next(x for x in rows.column("ends").to_pylist() if x is not None), np.uint8)
        place, told = (known.column(c).to_numpy() for c in ("place", "told"))
        counts, number = np.ones(len(ends)), WORDS - SHARED + ends.astype(np.int64)
        own = told < 0
        counts[place[~own]] = told[~own]
        number[place[own]] = -told[own]
        log_share = shares(counts, number, totals)
        docs = rows.filter(pc.is_valid(rows.column("codes")))
        codes = [np.frombuffer(x, width(len(ends))) for x in docs.column("codes").to_pylist()]
        short = number.astype("<i2")
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "numbers": pa.array([short[x].tobytes() for x in codes], pa.binary()),
                "log_share": pa.array([float(log_share[x].sum()) for x in codes], pa.float64()),
            }
        )

    return number


NUMBERED = "doc_id long, numbers binary, log_share double"


def packed(frame: DataFrame, address: str) -> DataFrame:
    """stored(), packed more tightly: codes and numbers make most of what is written here."""
    frame.write.mode("overwrite").option("compression", "zstd").parquet(address)
    return frame.sparkSession.read.schema(frame.schema).parquet(address)


def numbered(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, the numbers of all words (16-bit integers) and log_share of every document, written."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    runs = packed(rows.mapInArrow(partial(code, narrow=True), NARROW), f"{folder}/runs")
    counts = packed(word_counts(runs), f"{folder}/counts")
    numbers = vocabulary(counts)
    sent = spark.sparkContext.broadcast(number_totals(counts, numbers))
    own = spark.createDataFrame(list(numbers.items()), "word binary, own int")  # under WORDS rows
    # one number for each word: its count, or less than zero the number it has of its own; a word
    # that is there once has the count and the number that a run gives it itself
    told = F.when(F.col("own").isNotNull(), -F.col("own")).otherwise(F.col("total")).alias("told")
    often = counts.join(F.broadcast(own), "word", "left").where("total > 1 OR own IS NOT NULL").select("word", told)
    places = runs.where("words IS NOT NULL").select(F.col("run").alias("own_run"), F.posexplode("words").alias("place", "word"))
    known = places.join(often, "word").select("own_run", "place", "told")
    parts = runs.select("run", "doc_id", "codes", "ends")
    made = parts.groupBy("run").cogroup(known.groupBy("own_run")).applyInArrow(numberer(sent), NUMBERED)
    return packed(made, f"{folder}/numbered")


def run_arrays(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words with SIDES zeros around each text; places of the words; words of each text."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    places = np.arange(sizes.sum()) + SIDES * (1 + np.repeat(np.arange(len(words)), sizes))
    padded = np.zeros(len(places) + SIDES * (len(words) + 1), np.int64)
    padded[places] = np.concatenate(words) if words else []
    return padded, places, sizes


def written(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray], list[float]]]:
    """(doc_ids, numbers, log shares) of documents in runs of at most RUN_WORDS words, or one document."""
    ids, words, log_shares, held = [], [], [], 0
    for batch in rows:
        for doc_id, numbers, share in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids.append(doc_id)
            words.append(np.frombuffer(numbers, "<i2"))
            log_shares.append(share)
            held += len(words[-1])
            if held >= RUN_WORDS:
                yield ids, words, log_shares
                ids, words, log_shares, held = [], [], [], 0
    if ids:
        yield ids, words, log_shares


def exponentials(x: np.ndarray) -> np.ndarray:
    """In place, over rows; gives their sums, by which they are chances."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x.sum(axis=1, keepdims=True)


def seen_by(weights: Weights, padded: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Context words, their vectors, the hidden layer, two layers of exponentials (side by side) and the sums of each, for the words at the places."""
    offsets = [k for k in range(-SIDES, SIDES + 1) if k]
    context = np.stack([padded[places + k] for k in offsets], axis=1)
    given = weights["words"][context].reshape(len(places), -1)
    hidden = given @ weights["input"]
    hidden += weights["input_bias"]
    np.tanh(hidden, out=hidden)
    out = hidden @ both_layers(weights)
    out[:, :SIDE] += weights["class_bias"]
    out[:, SIDE:] += weights["within_bias"][padded[places] // SIDE]
    return context, given, hidden, out, exponentials(out[:, :SIDE]), exponentials(out[:, SIDE:])


def both_layers(weights: Weights) -> np.ndarray:
    return np.concatenate((weights["classes"], weights["within"]), axis=1)


def log_chances(weights: Weights, padded: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = np.empty(len(places))
    for at in range(0, len(places), SCORED):
        part = places[at : at + SCORED]
        *_, powers, classes, within = seen_by(weights, padded, part)
        word, row = padded[part], np.arange(len(part))
        chances = powers[row, word // SIDE] / classes[:, 0] * (powers[row, SIDE + word % SIDE] / within[:, 0])
        out[at : at + SCORED] = np.log(np.maximum(chances, 1e-30))
    return out


def summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of the value rows for each row number."""
    out = np.zeros((n, values.shape[1]), np.float32)
    order = np.argsort(rows.astype(np.int16), kind="stable")  # fits: n is at most WORDS
    ordered = rows[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    out[ordered[first]] = np.add.reduceat(values[order], first)
    return out


def gradient(weights: Weights, padded: np.ndarray, places: np.ndarray) -> Weights:
    context, given, hidden, out, classes, within = seen_by(weights, padded, places)
    out[:, :SIDE] /= classes
    out[:, SIDE:] /= within
    word, row = padded[places], np.arange(len(places))
    out[row, word // SIDE] -= 1
    out[row, SIDE + word % SIDE] -= 1
    out *= np.float32(1 / len(places))
    back = out @ both_layers(weights).T
    back *= 1 - hidden * hidden
    outer, bias = hidden.T @ out, out.sum(axis=0)
    return {
        "words": summed(context.ravel(), (back @ weights["input"].T).reshape(-1, SIZE), WORDS),
        "input": given.T @ back,
        "input_bias": back.sum(axis=0),
        "classes": outer[:, :SIDE],
        "class_bias": bias[:SIDE],
        "within": outer[:, SIDE:],
        "within_bias": summed(word // SIDE, out[:, SIDE:], SIDE),
    }


def trainer(sent):
    def train(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, words = shaped(sent.value), 0
        moved = {k: np.full(v.shape, 1e-6, np.float32) for k, v in weights.items()}
        rng = np.random.default_rng(SEED)
        for _, run, _ in written(rows):
            padded, places, _ = run_arrays(run)
            rng.shuffle(places)
            for first in range(0, len(places), BATCH):
                part = places[first : first + BATCH]
                for k, g in gradient(weights, padded, part).items():
                    moved[k] += g * g
                    weights[k] -= np.float32(RATE) * g / np.sqrt(moved[k])
            words += len(places)
        if words:
            parts = [x.astype(np.float32).tobytes() for x in np.array_split(flat(weights), SLICES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES)), pa.array(parts, pa.binary()), pa.array([words] * SLICES)], ["slice", "part", "words"]
            )

    return train


def averaged(parts: pd.DataFrame) -> pd.DataFrame:
    """One slice of all tasks' weights, averaged by the words that each has seen."""
    total = sum(np.frombuffer(p, np.float32).astype(np.float64) * n for p, n in zip(parts["part"], parts["words"], strict=True))
    part = (total / parts["words"].sum()).astype(np.float32).tobytes()
    return pd.DataFrame({"slice": parts["slice"].iloc[:1], "part": [part]})


def train(words: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights from numbered() documents."""
    spark, now = words.sparkSession, flat(start_weights())
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(now)
        own = words.where(F.pmod(F.xxhash64("numbers"), F.lit(rounds)) == k)
        parts = own.mapInArrow(trainer(sent), "slice long, part binary, words long")
        made = parts.groupBy("slice").applyInPandas(averaged, "slice long, part binary").collect()  # SLICES rows
        if made:
            now = np.concatenate([np.frombuffer(r[1], np.float32) for r in sorted(made)])
    return now


def scorer(sent, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = shaped(sent.value)
    for ids, run, log_shares in written(rows):
        padded, places, sizes = run_arrays(run)
        total = np.concatenate(([0.0], np.cumsum(log_chances(weights, padded, places))))
        ends = np.cumsum(sizes)
        sums = total[ends] - total[ends - sizes] + np.array(log_shares)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(sums)], ["doc_id", "n_words", "log_likelihood"])


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, log_likelihood and mean_log_likelihood of every document."""
    words = numbered(docs, shared_folder(docs.sparkSession, "language-model"))
    sent = docs.sparkSession.sparkContext.broadcast(train(words, rounds))
    made = words.mapInArrow(partial(scorer, sent), "doc_id long, n_words long, log_likelihood double")
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return made.withColumn("mean_log_likelihood", mean)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
