"""Language identification by a linear-chain conditional random field over words.

Each word (a run of letters) is labelled with a language; features are its affixes, its
two- and three-letter n-grams and itself (the lexicon), hashed into one weight table,
and transitions between neighbours are learned with them. Forward-backward gives every
word's probabilities, so a text that switches languages gets a share of each; the
document's language is the one with the largest share, which is also its score.

Learning takes at most `sample` labelled documents of each language, the first by a hash
of the id, and at most `SAMPLE_CHARS` characters of each, so that it costs the same at any
size; rows alike in id, language and text count as one. Their words are cut into spans, and
spans of one or of several languages are put together, so that switches are seen and
their cost is learned. Prediction covers every whole text and uses nothing but the text.

A null text or one without letters is `und` with score 0, as is every text if nothing
was learned. Equal shares go to the first language in alphabetical order. A null doc_id
is never learned from and counts as held out. Repeated rows give rows each. An empty
table gives no row. Extra columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.common import release, table

FOLDS = 5
SAMPLE = 300
SAMPLE_CHARS = 20_000
BUCKETS = 1 << 18
SPAN = 24
EPOCHS = 6
BATCH = 400
RATE = 0.3
SHRINK = 1e-4
SEED = 42
UNDETERMINED = "und"
#: Score from which a predicted language stands in for another one that a document is labelled with.
SURE = 0.8
#: Documents that must have been learned of a language before a label that names it is doubted.
KNOWN = 20
#: Characters whose features are made together, and characters labelled together.
CHUNK_CHARS = 300_000
RUN_CHARS = 1_000_000
#: Odd multipliers of the hashes, and the inverse of BASE modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
KINDS = {name: np.uint64(0xD1B54A32D192ED03 * (2 * k + 1) % (1 << 64)) for k, name in enumerate(("two", "three", "prefix", "suffix", "word"))}


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@lru_cache(maxsize=2)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def bucket(kind: str, value: np.ndarray) -> np.ndarray:
    mixed = (value + KINDS[kind]) * np.uint64(BASE)
    return ((mixed ^ (mixed >> np.uint64(29))) * KINDS["word"] >> np.uint64(46)).astype(np.int64)


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased text between two blanks, and each word's start and end there."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    inside = letters()[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return codes, edges[::2], edges[1::2]


def features(text: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """(word, bucket) arrays of the text's features, each in the order of words; the number of words."""
    codes, starts, ends = words_of(text)
    if not len(starts):
        return [], 0
    sizes = ends - starts
    word = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    wide = codes.astype(np.uint64)
    one, two = wide[at], wide[at - 1]
    first = np.repeat(starts, sizes) == at
    two = np.where(first, 1, two)
    three = np.where(first | (np.repeat(starts, sizes) + 1 == at), 1, wide[np.maximum(at - 2, 0)])
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(wide * powers(BASE, len(wide)))))
    whole = (sums[ends] - sums[starts]) * powers(INVERSE, len(wide) + 1)[starts]
    index = np.arange(len(starts))

    def letter(place: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return np.where(inside, wide[np.clip(place, 0, len(wide) - 1)], 1)

    prefix = wide[starts] | letter(starts + 1, sizes > 1) << np.uint64(21) | letter(starts + 2, sizes > 2) << np.uint64(42)
    suffix = wide[ends - 1] | letter(ends - 2, sizes > 1) << np.uint64(21) | letter(ends - 3, sizes > 2) << np.uint64(42)
    pair = one | two << np.uint64(21)
    return [
        (word, bucket("two", pair)),
        (word, bucket("three", pair | three << np.uint64(42))),
        (index, bucket("prefix", prefix)),
        (index, bucket("suffix", suffix)),
        (index, bucket("word", whole)),
    ], len(starts)


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    moves: np.ndarray  # language before x language
    documents: Counter[str]  # learned of each language


def emissions(field_weights: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    out = np.zeros((n, field_weights.shape[1]), np.float32)
    for word, place in found:
        values = field_weights[place]
        out += values if len(word) == n and word[-1] == n - 1 else np.add.reduceat(values, np.searchsorted(word, np.arange(n)))
    return out


def marginals(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probabilities of each word's label; chains stand one after the other, sizes > 0: of each.

    All chains take a step together, the longest first, so that those that still go on
    are always the first ones.
    """
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    active = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max()) + 1), "right")
    base = np.cumsum(active) - active
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = base[inside] + np.repeat(rank, sizes)
    likely = np.empty(scores.shape, np.float32)
    likely[place] = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves - moves.max()).astype(np.float32)
    forward, out = np.empty_like(likely), np.empty_like(likely)
    for t, (n, at) in enumerate(zip(active.tolist(), base.tolist(), strict=True)):
        now = likely[at : at + n] * (now[:n] @ step if t else 1)
        now /= now.sum(axis=1, keepdims=True)
        forward[at : at + n] = now
    back = np.ones((len(sizes), scores.shape[1]), np.float32)
    for n, at in zip(active[::-1].tolist(), base[::-1].tolist(), strict=True):
        both = forward[at : at + n] * back[:n]
        out[at : at + n] = both / both.sum(axis=1, keepdims=True)
        new = (likely[at : at + n] * back[:n]) @ step.T
        back[:n] = new / new.sum(axis=1, keepdims=True)
    return out[place]


def spans(texts: list[tuple[str, int]], rng: np.random.Generator) -> list[tuple[str, np.ndarray]]:
    """Texts of SPAN words with their labels: runs of 4 to SPAN words from random documents."""
    split = [(["".join(map(chr, c[a:b])) for a, b in zip(s, e, strict=True)], k) for t, k in texts for c, s, e in [words_of(t)]]
    split = [x for x in split if x[0]]
    out = []
    for _ in range(4 * len(split)):
        words, labels = [], []
        pure = rng.random() < 0.5
        own = split[rng.integers(len(split))]
        while len(words) < SPAN:
            source, label = own if pure else split[rng.integers(len(split))]
            at, n = int(rng.integers(len(source))), int(rng.integers(4, SPAN))
            run = source[at : at + n][: SPAN - len(words)]
            words += run
            labels += [label] * len(run)
        out.append((" ".join(words), np.array(labels)))
    return out


def learned(rows: list[tuple[str, str]]) -> Field | None:
    """The field that fits (text, language) rows, by AdaGrad on the likelihood of the spans."""
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(SEED)
    texts = [(text, languages.index(lang)) for text, lang in sorted(rows)]
    if not any(len(words_of(t)[1]) for t, _ in texts):
        return None
    examples, n = spans(texts, rng), len(languages)
    made = [(features(text)[0], labels) for text, labels in examples]
    weights, moves = np.zeros((BUCKETS, n), np.float32), np.zeros((n, n))
    seen, seen_moves = np.full((BUCKETS, n), 1e-6, np.float32), np.full((n, n), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(made))
        for at in range(0, len(order), BATCH):
            part = [made[k] for k in order[at : at + BATCH]]
            labels = np.stack([y for _, y in part])
            found = [
                (np.concatenate([f[k][0] + SPAN * i for i, (f, _) in enumerate(part)]), np.concatenate([f[k][1] for f, _ in part]))
                for k in range(len(KINDS))
            ]
            scores = emissions(weights, found, labels.size)
            gone, pairs = chain_gradient(scores.reshape(*labels.shape, n).astype(np.float64), labels, moves)
            grad = np.zeros_like(weights)
            flat = gone.reshape(-1, n)
            for word, place in found:
                for k in range(n):
                    grad[:, k] += np.bincount(place, flat[word, k], BUCKETS)
            grad = grad / len(part) + SHRINK * weights
            seen += grad**2
            weights -= RATE * grad / np.sqrt(seen)
            step = pairs / len(part)
            seen_moves += step**2
            moves -= RATE * step / np.sqrt(seen_moves)
    return Field(languages, weights, moves, Counter(lang for _, lang in rows))


def chain_gradient(scores: np.ndarray, labels: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log-likelihood by the scores (chains x words x languages) and the moves."""
    chains, words, n = scores.shape
    likely = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(moves - moves.max())
    forward, back = np.empty_like(likely), np.ones_like(likely)
    for t in range(words):
        now = likely[:, t] * (forward[:, t - 1] @ step if t else 1)
        forward[:, t] = now / now.sum(axis=1, keepdims=True)
    for t in range(words - 2, -1, -1):
        now = (likely[:, t + 1] * back[:, t + 1]) @ step.T
        back[:, t] = now / now.sum(axis=1, keepdims=True)
    gone = forward * back
    gone /= gone.sum(axis=2, keepdims=True)
    pairs = np.zeros((n, n))
    for t in range(words - 1):
        both = forward[:, t, :, None] * step * (likely[:, t + 1] * back[:, t + 1])[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    np.subtract.at(pairs, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
    gone[np.arange(chains)[:, None], np.arange(words), labels] -= 1
    return gone, pairs


def held_out() -> Column:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(True))


def learn(docs: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Field | None:
    row = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    known = row.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("text_hash", F.xxhash64("text"))
    key = ["doc_id", "lang", "text_hash"]
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash")
    # equal rows have one rank, so that copies of one document do not fill the sample
    picked = known.select(*key, F.dense_rank().over(order).alias("n")).where(F.col("n") <= sample).select(*key).distinct()
    rows = known.join(F.broadcast(picked), key).select(*key, F.left("text", F.lit(sample_chars)).alias("text")).dropDuplicates(key)
    taken = sorted((r.text, r.lang) for r in rows.select("text", "lang").collect())  # `sample` rows for each language
    return learned(taken) if taken else None


def labeller(sent):
    def label(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field | None = sent.value
        for batch in rows:
            ids, out, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            found = [x for a, b in runs_of([len(x or "") for x in texts]) for x in labelled(field, texts[a:b])]
            best, score = [x for x, _ in found], [x for _, x in found]
            yield pa.RecordBatch.from_arrays([ids, out, pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return label


def runs_of(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most RUN_CHARS characters (or bytes), or one text."""
    at = 0
    while at < len(sizes):
        end, held = at, 0
        while end < len(sizes) and (end == at or held < RUN_CHARS):
            held += sizes[end]
            end += 1
        yield at, end
        at = end


def labelled(field: Field | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text."""
    made, sizes = [], np.zeros(len(texts), np.int64)
    group: list[str] = []
    held = 0

    def flush() -> None:
        found, n = features(" ".join(group))
        if n:
            made.append(emissions(field.weights, found, n))

    for k, text in enumerate(texts if field else []):
        if not text:
            continue
        sizes[k] = len(words_of(text)[1])
        group.append(text)
        held += len(text)
        if held > CHUNK_CHARS:
            flush()
            group, held = [], 0
    if group:
        flush()
    if not sizes.any():
        return [(UNDETERMINED, 0.0)] * len(texts)
    full = np.flatnonzero(sizes)
    chances = marginals(np.concatenate(made), sizes[full], field.moves)
    starts = np.cumsum(sizes[full]) - sizes[full]
    shares = np.add.reduceat(chances.astype(np.float64), starts) / sizes[full][:, None]
    out = [(UNDETERMINED, 0.0)] * len(texts)
    for k, share in zip(full.tolist(), shares, strict=True):
        out[k] = (field.languages[int(share.argmax())], min(1.0, float(share.max())))
    return out


def identify(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(labeller(sent), "doc_id long, held_out boolean, lang_pred string, score double")


def has_letter(text: str | None) -> bool:
    return bool(text) and len(words_of(text)[1]) > 0


def as_text(column: pa.Array) -> pa.Array:
    kind = column.type
    return column if pa.types.is_string(kind) or pa.types.is_large_string(kind) else column.cast(pa.string())


def corrected(field: Field | None, label: str | None, found: tuple[str, float]) -> str | None:
    """The language of a text from its label and what labelled() says of it."""
    name, score = found
    if name == UNDETERMINED:
        return label
    doubted = score >= SURE and field.documents[label] >= KNOWN
    return name if label is None or doubted else label


def worded(docs: DataFrame, field: Field | None, lang: str = "lang") -> DataFrame:
    """The documents that have a letter, whole, with their language.

    The predicted one stands where `lang` is null, and where the text is in another language
    than that with a score of at least SURE, if KNOWN documents or more of the labelled one
    were learned. All other labels stay; if nothing was learned, null ones too. Decided row
    by row where the rows are: nothing is shuffled, and each text is sent to Python once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    docs = docs.withColumn(lang, F.col(lang).cast("string"))
    columns, at, text = docs.columns, docs.columns.index(lang), docs.columns.index("text")

    def keep(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Field | None = sent.value
        for batch in rows:
            held = batch.columns
            texts = as_text(held[text])
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for a, b in runs_of(sizes):
                some, out = texts.slice(a, b - a).to_pylist(), held[at].slice(a, b - a).to_pylist()
                out = [corrected(known, *x) for x in zip(out, labelled(known, some), strict=True)]
                kept = pa.array([k for k, x in enumerate(some) if has_letter(x)], pa.int64())
                made = [x.slice(a, b - a) for x in held]
                made[at] = pa.array(out, made[at].type)
                yield pa.RecordBatch.from_arrays([x.take(kept) for x in made], names=columns)
        release()

    return docs.mapInArrow(keep, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
