"""MinHash near-duplicates, candidates held against odd sketches, links confirmed on whole sets.

A document's set are the hashes of its shingles. MinHash takes SAMPLES minima of it; BANDS
bands of the first of them name the buckets in which similar sets meet. All samples are
folded into an odd sketch: every (place, minimum) turns over one of BITS bits, so that of two sketches
the bits that differ count the samples that differ, and the fewer there are the more
precisely. A pair goes on if its sketches differ in no more bits than two sets of the asked
similarity do (but for LOSS of them), and is confirmed on both whole sets.

Equal sets are one node. Buckets of up to CROWD nodes give all their pairs; of larger ones
every member is first held against a few pivots. Pairs are confirmed in two turns, one
likely pair of each node first; then all the others, but for those already connected, since
only components are wanted. What crowded buckets then still hold in different components is
compared block by block: the rest against the largest component and against itself, every
pair in the first bucket that it shares only. Sketches tell which nodes of a block may have
a link; only those get their text, and the block confirms its pairs itself, the closest of
each node first and more as long as they stay apart. It gives links, never candidates, so
what is made grows with nodes and blocks, not with the pairs of a crowd. So no link is lost
to a crowd, and no task holds one whole.

With the defaults two sets of similarity 0.8 share no bucket once in 20 million times; of
higher similarity, more rarely. Shingles are told apart by 64-bit hashes, in nodes too.

A null or wordless text has an empty set and no link: its component is its own doc_id. Rows
with a null doc_id are linked but never name a component (null, and kept, if it has no
other rows). Repeated rows give a row each. An empty table gives no row. Extra columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.common import shared_folder, stored, table
from paceline.llm.simhash import stars

SHINGLE = 2
PERCENT = 80
BANDS = 32
ROWS = 4
SAMPLES = 1024
BITS = 2048
WORDS = BITS // 64
SEED = 1
#: Chance that two sets of just the asked similarity are dropped by their sketches.
LOSS = 1e-4
#: Nodes of a bucket from which not all pairs are made at once.
CROWD = 16
#: Members of a crowded bucket that all others are held against first.
PIVOTS = 4
#: Rows that a task of a crowded bucket compares with as many others.
BLOCK = 256
#: Shingles of a block of long texts, of which it then has fewer.
BLOCK_SHINGLES = 1 << 20
#: Pairs that a node of a block gives in its first turn, and times as many in each turn after it.
FIRST_PAIRS = 1
MORE_PAIRS = 8
#: Bytes of text that are held together, and hashes that pass the minima together.
SLICE_BYTES = 8_000_000
SLICE_HASHES = 1 << 15
#: The multipliers of MurmurHash3's 64-bit finalizer.
MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_2
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    # a copy without an offset: Arrow's string functions do not respect that of a cast slice
    whole = pa.array(texts.to_pylist(), pa.large_string())
    cut = pc.ascii_split_whitespace(pc.fill_null(whole, ""))
    coded = cut.values.dictionary_encode()
    names = [x.lower() for x in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    # a word of no letters stands where white space begins or ends a text
    known = np.array([xxhash.xxh64_intdigest(x, SEED) for x in names], np.uint64)
    is_word = np.array([bool(x) for x in names], bool)
    at = coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), cut.value_lengths().to_numpy())
    text, at = text[is_word[at]], at[is_word[at]]
    words = known[at]
    edges = np.searchsorted(text, np.arange(len(texts) + 1))
    # the chain of a shingle's words: hash of the first, then each next one mixed in
    chains = [mixed(words)]
    for k in range(1, shingle):
        chains.append(mixed(chains[-1][: len(words) - k] + words[k:]))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        length = min(shingle, b - a)
        out.append(np.unique(chains[length - 1][a : b - length + 1]) if length else np.zeros(0, np.uint64))
    return out


@lru_cache(maxsize=1)
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(SEED).integers(0, 1 << 32, (2, SAMPLES), dtype=np.uint32)
    return drawn[0] | np.uint32(1), drawn[1]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES minima of each set; no set may be empty."""
    times, plus = multipliers()
    out = np.empty((len(sets), SAMPLES), np.uint32)
    first = 0
    while first < len(sets):
        last, held = first, 0
        while last < len(sets) and (last == first or held + len(sets[last]) <= SLICE_HASHES):
            held += len(sets[last])
            last += 1
        some = sets[first:last]
        hashes = (np.concatenate(some) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, some[:-1])])
        for i in range(SAMPLES):
            out[first:last, i] = np.minimum.reduceat(hashes * times[i] + plus[i], starts)
        first = last
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, in which the band's number is mixed."""
    keys = np.repeat(mixed(np.arange(1, BANDS + 1, dtype=np.uint64))[None], len(least), axis=0)
    cut = least[:, : BANDS * ROWS].reshape(len(least), BANDS, ROWS).astype(np.uint64)
    for row in range(ROWS):
        keys = mixed(keys + cut[:, :, row])
    return keys.view(np.int64)


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """BITS parities of how many (place, minimum) fall on each bit, as 64-bit words."""
    place = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
    bit = (mixed(least.astype(np.uint64) + place) % np.uint64(BITS)).astype(np.int64)
    flat = (np.arange(len(least))[:, None] * BITS + bit).ravel()
    odd = (np.bincount(flat, minlength=len(least) * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(least), BITS), axis=1, bitorder="little").view("<i8")


@lru_cache(maxsize=8)
def most_bits(percent: int, loss: float = LOSS) -> int:
    """The fewest bits that sketches of sets at least so similar exceed with the given chance only."""
    differ = 1 - percent / 100
    chance = np.zeros(BITS + 1)  # of so many bits set, after as many throws as have been made
    chance[0] = 1.0
    share, total = (1 - differ) ** SAMPLES, np.zeros(BITS + 1)
    steps = np.arange(BITS + 1) / BITS
    for k in range(SAMPLES + 1):
        total += share * chance
        if k == SAMPLES or differ == 0:
            break
        share *= (SAMPLES - k) / (k + 1) * differ / (1 - differ)
        for _ in range(2):  # a sample that differs turns over two bits
            up, down = chance * (1 - steps), chance * steps
            chance = np.concatenate(([0.0], up[:-1])) + np.concatenate((down[1:], [0.0]))
    beyond = np.cumsum(total[::-1])[::-1]  # of this many or more
    return int(np.flatnonzero(beyond <= loss)[0]) - 1


def slices(rows: Iterator[pa.RecordBatch], *texts: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most SLICE_BYTES of text, or one row."""
    for batch in rows:
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts)
        run = np.cumsum(size)
        first = 0
        while first < len(batch):
            base = int(run[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(run, base + SLICE_BYTES, "right")))
            yield batch.slice(first, last - first)
            first = last


def lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def printer(shingle: int):
    def prints(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in slices(rows, "text"):
            sets = shingle_sets(run.column("text"), shingle)
            size = np.array([len(x) for x in sets], np.int64)
            full = np.flatnonzero(size)
            least = np.zeros((len(sets), SAMPLES), np.uint32)
            least[full] = minima([sets[k] for k in full])
            node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            made = [pa.array(node, mask=size == 0), pa.array(size), lists(band_keys(least)), lists(odd_sketches(least))]
            yield pa.RecordBatch.from_arrays(
                [run.column("doc_id"), run.column("text_hash"), *made], ["doc_id", "text_hash", "node", "n", "bands", "sketch"]
            )

    return prints


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's hash: by both a text is found again."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def set_prints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """For each document its node (the hash of its set, null if empty), the set's size, band keys and sketch."""
    columns = "doc_id long, text_hash long, node long, n long, bands array<long>, sketch array<long>"
    return hashed(docs).mapInArrow(printer(shingle), columns)


def sketch_bits(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    each = [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(WORDS)]
    return sum(each[1:], each[0])


def close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow to be as similar as asked, with the bits d between them."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    met = pairs.join(one, "a").join(two, "b").withColumn("d", sketch_bits("sketch_a", "sketch_b"))
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return met.where(sizes & (F.col("d") <= most_bits(percent))).select("a", "b", "d")


def bucket_members(nodes: DataFrame) -> DataFrame:
    """A row for each node and bucket that it shares, with the number of members."""
    entries = nodes.select("node", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("members"))
    return entries.join(buckets.where("members > 1"), "key")


def first_pairs(members: DataFrame, crowd: int) -> DataFrame:
    """Pairs (a, b), a > b: all of the small buckets, those with the pivots (the least nodes) of the large ones."""
    small = members.where(F.col("members") <= crowd).groupBy("key").agg(F.collect_list("node").alias("nodes"))
    small = small.select(F.explode("nodes").alias("a"), "nodes")
    small = small.select("a", F.explode(F.filter("nodes", lambda x: x < F.col("a"))).alias("b"))
    large = members.where(F.col("members") > crowd).select("key", "node")
    # each task cuts its rows to the first of each bucket, so a crowd is not gathered
    place = F.row_number().over(Window.partitionBy("key").orderBy("node"))
    least = large.withColumn("place", place).where(F.col("place") <= PIVOTS).groupBy("key").agg(F.collect_list("node").alias("pivots"))
    star = large.join(least, "key").select(F.col("node").alias("a"), F.explode("pivots").alias("b")).where("a > b")
    pairs = small.unionByName(star)
    # dealt by a, equal pairs meet, and so do a and its node in close()
    return pairs.repartition("a").distinct()


def texts_of(docs: DataFrame, nodes: DataFrame, asked: DataFrame, address: str) -> DataFrame:
    """One text of each node asked for."""
    wanted = nodes.join(asked, "node", "left_semi").select("node", F.col("rep.text_hash").alias("hash_here"), F.col("rep.doc_id").alias("doc_here"))
    rows = hashed(docs)
    same = (rows["text_hash"] == wanted["hash_here"]) & rows["doc_id"].eqNullSafe(wanted["doc_here"])
    texts = stored(rows.join(wanted, same).select("node", "text"), address)
    if not texts.groupBy("node").count().where("count > 1").isEmpty():  # a document is there several times
        texts = stored(texts.dropDuplicates(["node"]), f"{address}-once")
    return texts


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmer(shingle: int, percent: int):
    def confirm(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in slices(rows, "text_a", "text_b"):
            names = run.column("b").to_numpy()
            known, at, which = np.unique(names, return_index=True, return_inverse=True)
            right = shingle_sets(run.column("text_b").take(pa.array(at)), shingle)
            left = shingle_sets(run.column("text_a"), shingle)
            kept = []
            for k, (x, w) in enumerate(zip(left, which.tolist(), strict=True)):
                if alike(x, right[w], percent):
                    kept.append(k)
            yield run.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return confirm


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are as similar as asked."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    met = pairs.select("a", "b").join(one, "a").join(two, "b")
    return met.mapInArrow(confirmer(shingle, percent), "a long, b long")


def rooted(frame: DataFrame, forest: DataFrame, node: str, root: str) -> DataFrame:
    """The frame with the component of a node; forest: (a, b), a node and the least of its component."""
    named = forest.select(F.col("a").alias(node), F.col("b").alias("root_here"))
    return frame.join(named, node, "left").withColumn(root, F.coalesce("root_here", node)).drop("root_here")


def pointed(links: DataFrame, address: str) -> DataFrame:
    """(a, root) for links (a, b), b < a, one for each a: every step doubles the way to the root."""
    now, turn = stored(links, f"{address}-0"), 0
    while True:
        up = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
        moved = now.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved"))
        turn += 1
        after = stored(moved, f"{address}-{turn}")
        if after.where("moved").isEmpty():
            return now
        now = after.select("a", "b")


def likely_forest(pairs: DataFrame, texts: DataFrame, folder: str, shingle: int, percent: int) -> DataFrame:
    """The forest of one confirmed pair for each node: with the least node that is likely similar, or else the closest."""
    unlikely = F.greatest(F.col("d") - most_bits(percent, 0.5), F.lit(0))
    chosen = pairs.groupBy("a").agg(F.min(F.struct(unlikely.alias("unlikely"), "b")).alias("near"))
    links = confirmed(chosen.select("a", F.col("near.b").alias("b")), texts, shingle, percent)
    return pointed(links, f"{folder}/likely")


def settled(pairs: DataFrame, texts: DataFrame, forest: DataFrame, folder: str, shingle: int, percent: int) -> DataFrame:
    """The forest after all pairs are confirmed or found to be connected."""
    apart = rooted(rooted(pairs, forest, "a", "root_a"), forest, "b", "root_b").where("root_a <> root_b")
    apart = stored(apart.select("a", "b", "root_a", "root_b"), f"{folder}/open")
    links = stored(confirmed(apart.select("a", "b"), texts, shingle, percent), f"{folder}/links")
    if links.isEmpty():
        return forest
    return connected(links.join(apart, ["a", "b"]), forest, folder)


def connected(links: DataFrame, forest: DataFrame, folder: str) -> DataFrame:
    """The forest with the components root_a and root_b of each link made one."""
    joined = stored(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), f"{folder}/joined")
    if joined.isEmpty():
        return forest
    merged = stars(joined, f"{folder}/stars")
    roots = rooted(forest, merged, "b", "root").select("a", F.col("root").alias("b"))
    return stored(roots.unionByName(merged), f"{folder}/forest")


def crowds(members: DataFrame, nodes: DataFrame, forest: DataFrame, crowd: int, block: int) -> DataFrame:
    """Rows of the tasks that compare what crowded buckets hold in different components.

    A bucket's largest component needs no comparison with itself: its blocks meet those
    of the rest only, which also meet each other.
    """
    rows = rooted(members.where(F.col("members") > crowd).select("key", "node"), forest, "node", "comp")
    rows = rows.join(nodes.select("node", "n", "sketch", "bands"), "node")
    counts = rows.groupBy("key", "comp").agg(F.count("*").alias("held"), F.sum("n").alias("long"))
    largest = F.max(F.struct("held", "comp", "long")).alias("most")
    open_ = counts.groupBy("key").agg(largest, *(F.sum(c).alias(f"all_{c}") for c in ("held", "long")), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n, long: F.ceil(F.greatest(n / block, long / BLOCK_SHINGLES)).cast("int")
    rest = [F.col(f"all_{c}") - F.col(f"most.{c}") for c in ("held", "long")]
    open_ = open_.select("key", F.col("most.comp").alias("main"), blocks(F.col("most.held"), F.col("most.long")).alias("mains"), blocks(*rest).alias("rests"))
    rows = rows.join(open_, "key").withColumn("in_rest", F.col("comp") != F.col("main"))
    parts = F.when(F.col("in_rest"), F.col("rests")).otherwise(F.col("mains"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.col("node"), F.lit("block")), parts).cast("int"))
    own = F.col("own")
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda k: pair("rest", F.least(own, k), F.greatest(own, k)))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda k: pair("main", own, k))
    for_main = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda k: pair("main", k, own))
    tasks = F.when(F.col("in_rest"), F.concat(with_rest, with_main)).otherwise(for_main)
    return rows.select("key", "node", "comp", "in_rest", "own", "n", "sketch", "bands", F.inline(tasks))


def block_pairs(percent: int, turn: int):
    """Compares the rows of one task; gives the turn's share of the closest pairs of each node.

    Shares are cut by the components of the first turn (comp), so that a later turn goes on
    where the one before ended; pairs that are connected by now are left out, as are those
    that an earlier band brings together as well. `more` tells that pairs are left for the
    next turn.
    """
    low = FIRST_PAIRS * (MORE_PAIRS**turn - 1) // (MORE_PAIRS - 1)
    high = low + FIRST_PAIRS * MORE_PAIRS**turn

    def compare(group: pa.Table) -> pa.Table:
        node, now = (column(group, c) for c in ("node", "now"))
        pairs, more = [], False
        for x, near in near_in_block(group, percent):
            apart = now[near] != now[x]
            some = near[low:high][apart[low:high]]
            more |= bool(apart[high:].any())
            pairs.append(np.column_stack((np.maximum(node[x], node[some]), np.minimum(node[x], node[some]))))
        made = np.concatenate(pairs or [np.zeros((0, 2), np.int64)])
        return pa.table([pa.array(made[:, 0]), pa.array(made[:, 1]), pa.array(np.full(len(made), more))], names=["a", "b", "more"])

    return compare


def column(group: pa.Table, name: str) -> np.ndarray:
    return group.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def near_in_block(group: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each left row of a block's task and the right rows of other components it may be linked with, the closest first."""
    most = most_bits(percent)
    lists_of = lambda name: group.column(name).combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
    node, comp, n, own = (column(group, c) for c in ("node", "comp", "n", "own"))
    sketch, bands = lists_of("sketch").view(np.uint64), lists_of("bands")
    bands = bands[:, : int(np.flatnonzero(bands[0] == column(group, "key")[0])[0])]  # those before this bucket's
    if group.column("kind")[0].as_py() == "main":
        left = np.flatnonzero(column(group, "in_rest"))
        right = np.flatnonzero(~column(group, "in_rest"))
    else:
        left, right = np.flatnonzero(own == column(group, "i")), np.flatnonzero(own == column(group, "j"))
    for x in left.tolist():
        y = right[comp[right] != comp[x]]
        bits = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int64)
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        near = np.flatnonzero((bits <= most) & (100 * small >= percent * large))
        near = near[~(bands[y[near]] == bands[x]).any(axis=1)]
        yield x, y[near[np.lexsort((node[y[near]], bits[near]))]]


def block_asked(percent: int):
    """The rows of one task that may have a link there."""

    def ask(group: pa.Table) -> pa.Table:
        asked = np.zeros(group.num_rows, bool)
        for x, near in near_in_block(group, percent):
            asked[near] = True
            asked[x] |= bool(len(near))
        return group.filter(pa.array(asked))

    return ask


def block_links(shingle: int, percent: int):
    """Links (a, b) that connect the components of one task's rows as far as whole sets do."""

    def link(group: pa.Table) -> pa.Table:
        names, comp = column(group, "node"), column(group, "comp")
        place = {x: k for k, x in enumerate(names.tolist())}
        texts = group.select(["text"]).combine_chunks().to_batches()
        sets = [x for run in slices(iter(texts), "text") for x in shingle_sets(run.column("text"), shingle)]
        group, now = group.drop_columns(["text"]), comp.copy()
        links, turn, more = [], 0, True
        while more:
            pairs = block_pairs(percent, turn)(group.append_column("now", pa.array(now)))
            for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
                x, y = place[a], place[b]
                if now[x] != now[y] and alike(sets[x], sets[y], percent):
                    links.append((a, b))
                    now[now == now[y]] = now[x]
            more, turn = any(pairs.column("more").to_pylist()), turn + 1
        made = np.array(links, np.int64).reshape(-1, 2)
        return pa.table([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])

    return link


def crowd_settled(members: DataFrame, nodes: DataFrame, texts: DataFrame, forest: DataFrame, folder: str, shingle: int, percent: int, crowd: int, block: int) -> DataFrame:
    """The forest after whatever crowded buckets hold in different components has been compared."""
    task = ["key", "kind", "i", "j"]
    rows = crowds(members, nodes, forest, crowd, block)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    asked = stored(rows.groupBy(*task).applyInArrow(block_asked(percent), kinds), f"{folder}/asked")
    found = asked.join(texts, "node").groupBy(*task).applyInArrow(block_links(shingle, percent), "a long, b long")
    return connected(rooted(rooted(found, forest, "a", "root_a"), forest, "b", "root_b"), forest, folder)


def similar_sets(prints: DataFrame, docs: DataFrame, folder: str, shingle: int, percent: int, crowd: int, block: int) -> DataFrame:
    """node and component_id of every set that is not empty; prints must be cheap to read again."""
    full = prints.where(F.col("node").isNotNull())
    one_of = F.min(F.struct("text_hash", "doc_id")).alias("rep")
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("least"), one_of, *(F.first(c).alias(c) for c in ("n", "bands", "sketch")))
    nodes = stored(nodes, f"{folder}/nodes")
    members = stored(bucket_members(nodes), f"{folder}/members")
    pairs = stored(close(first_pairs(members, crowd), nodes, percent), f"{folder}/pairs")
    large = members.where(F.col("members") > crowd).select("node")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large).distinct()
    texts = texts_of(docs, nodes, asked, f"{folder}/texts")
    forest = likely_forest(pairs, texts, folder, shingle, percent)
    forest = settled(pairs, texts, forest, f"{folder}/others", shingle, percent)
    forest = crowd_settled(members, nodes, texts, forest, f"{folder}/crowds", shingle, percent, crowd, block)
    linked = rooted(nodes.select("node", "least"), forest, "node", "root")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return linked.join(names, "root").select("node", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (names its component) of every document."""
    folder = shared_folder(docs.sparkSession, "odd-sketch")
    prints = stored(set_prints(docs, shingle), f"{folder}/prints")
    named = similar_sets(prints, docs, folder, shingle, percent, crowd, block)
    found = prints.select("doc_id", "n", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
