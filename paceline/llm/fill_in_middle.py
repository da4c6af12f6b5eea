"""Fill-in-middle transformation by displacement scatter.

The texts of a batch lie one after the other in one buffer of bytes. Each text that is
transformed is cut at two code points, drawn from a hash of its doc_id. A piece moves as a
whole, so the shift of a byte changes only where a piece begins: there a difference array
holds the change, its running sum is the shift of every byte, and one NumPy scatter writes
all outputs of the batch. restored() finds the sentinels in an output, which no
transformed text holds itself, and gathers the bytes back by the same arithmetic.

A text stays plain if it is empty, holds a sentinel, or is drawn to. A null text is an
empty one; a null doc_id is hashed as no digits. Repeated rows give a row each, equal ones.
Long texts are whole: a batch takes one text at least. An empty table gives no row. Extra
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import table

#: The sentinels before prefix, suffix and middle, by their letters.
LETTERS = {"P": ord("P"), "S": ord("S"), "M": ord("M")}
SENTINEL = 3
#: The order of the pieces (prefix 0, middle 1, suffix 2) in an output, and their sentinels' letters.
ORDER = {"psm": ((0, "P"), (2, "S"), (1, "M")), "spm": ((2, "S"), (0, "P"), (1, "M"))}
PLAIN = "plain"
#: Shares, in percent, of texts that are transformed, and of those that begin with the suffix.
FIM_PERCENT = 90
SPM_PERCENT = 20
SEED = 1
#: Bytes of text that are moved together; bounds a task's memory.
BATCH_BYTES = 8_000_000


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one buffer, and where each begins (and the last ends)."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    size = column.buffers()[2].size if column.buffers()[2] is not None else 0
    data = np.frombuffer(column.buffers()[2], np.uint8) if size else np.zeros(0, np.uint8)
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return data[edges[0] : edges[-1]], edges - edges[0]


def runs(rows: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most BATCH_BYTES of text, or one row."""
    for batch in rows:
        sizes = np.diff(texts_of(batch.column(text))[1])
        first = held = 0
        for k, size in enumerate(sizes.tolist()):
            if k > first and held + size > BATCH_BYTES:
                yield batch.slice(first, k - first)
                first, held = k, 0
            held += size
        if first < len(sizes):
            yield batch.slice(first)


def sentinels(data: np.ndarray) -> np.ndarray:
    """Where a sentinel begins in the buffer."""
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">"))) if len(data) > 2 else np.zeros(0, np.int64)
    return at[np.isin(data[at + 1], list(LETTERS.values()))]


def shifts(starts: np.ndarray, sizes: np.ndarray, moved: np.ndarray, total: int) -> np.ndarray:
    """For every byte of a buffer its shift, from pieces in order that cover it without gaps."""
    full = sizes > 0
    change = np.zeros(total + 1, np.int64)
    change[starts[full]] = np.diff(moved[full], prepend=0)
    return np.cumsum(change[:-1])


def inside(at: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each text whether a sentinel lies wholly in it."""
    text = np.searchsorted(edges, at, "right") - 1
    out = np.zeros(len(edges) - 1, bool)
    out[text[at + SENTINEL <= edges[text + 1]]] = True
    return out


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def scatter(data: np.ndarray, edges: np.ndarray, cuts: np.ndarray, spm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of all texts in one buffer and where each begins.

    cuts: the bytes before the first and the second cut of each text, -1 if it stays plain.
    """
    moves = cuts[:, 0] >= 0
    ends = np.where(moves[:, None], cuts, np.diff(edges)[:, None])
    bounds = np.column_stack((edges[:-1], edges[:-1] + ends[:, 0], edges[:-1] + ends[:, 1], edges[1:]))
    sizes = np.diff(bounds, axis=1)
    out_edges = np.concatenate(([0], np.cumsum(np.diff(edges) + len(ORDER["psm"]) * SENTINEL * moves)))
    places = np.repeat(out_edges[:-1, None], 3, axis=1)
    out = np.empty(out_edges[-1], np.uint8)
    for form, rows in (("psm", moves & ~spm), ("spm", moves & spm)):
        at = out_edges[:-1][rows]
        for piece, letter in ORDER[form]:
            for k, byte in enumerate((ord("<"), LETTERS[letter], ord(">"))):
                out[at + k] = byte
            places[rows, piece] = at + SENTINEL
            at = at + SENTINEL + sizes[rows, piece]
    starts = bounds[:, :3].ravel()
    shift = shifts(starts, sizes.ravel(), places.ravel() - starts, len(data))
    out[np.arange(len(data)) + shift] = data
    return out, out_edges


def gather(out: np.ndarray, edges: np.ndarray, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts behind the outputs, in one buffer, and where each begins."""
    form = np.array(forms, object)
    moves = form != PLAIN
    at = sentinels(out)
    text = np.searchsorted(edges, at, "right") - 1
    at = at[moves[text] & (at + SENTINEL <= edges[text + 1])]
    if len(at) != 3 * moves.sum():
        raise ValueError("an output does not hold its three sentinels once each")
    marks = np.full((len(forms), 3), -1, np.int64)
    marks[moves] = at.reshape(-1, 3)
    begins = np.repeat(edges[:-1, None], 3, axis=1)
    sizes = np.zeros((len(forms), 3), np.int64)
    sizes[~moves, 0] = np.diff(edges)[~moves]
    for name, order in ORDER.items():
        rows = form == name
        stops = np.column_stack((marks[rows, 1:], edges[1:][rows]))
        for k, (piece, letter) in enumerate(order):
            if (out[marks[rows, k] + 1] != LETTERS[letter]).any():
                raise ValueError("the sentinels of an output are not those of its form")
            begins[rows, piece] = marks[rows, k] + SENTINEL
            sizes[rows, piece] = stops[:, k] - marks[rows, k] - SENTINEL
    back = np.concatenate(([0], np.cumsum(sizes.sum(axis=1))))
    starts = back[:-1, None] + np.cumsum(sizes, axis=1) - sizes
    shift = shifts(starts.ravel(), sizes.ravel(), (begins - starts).ravel(), int(back[-1]))
    return out[np.arange(back[-1]) + shift], back


def strings(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    return pa.Array.from_buffers(pa.large_string(), len(made), made.buffers())


def transformer(seed: int, fim_percent: int, spm_percent: int):
    def transform(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(rows, "text"):
            data, edges = texts_of(run.column("text"))
            # one more than the last code point, so that a cut may follow it
            points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            first = np.searchsorted(points, edges)
            n = np.diff(first)
            drawn = np.array([draws(x, seed) for x in run.column("doc_id").to_pylist()], np.int64).reshape(-1, 4)
            ends = np.sort(drawn[:, :2] % (n[:, None] + 1), axis=1)
            plain = (n == 0) | inside(sentinels(data), edges) | (drawn[:, 2] % 100 >= fim_percent)
            spm = ~plain & (drawn[:, 3] % 100 < spm_percent)
            cuts = np.where(plain[:, None], -1, points[first[:-1, None] + ends] - edges[:-1, None])
            forms = np.where(plain, PLAIN, np.where(spm, "spm", "psm")).tolist()
            counts = [pa.array(x, pa.int64(), mask=plain) for x in (ends[:, 0], ends[:, 1] - ends[:, 0])]
            made = strings(*scatter(data, edges, cuts, spm))
            columns = [run.column("doc_id"), pa.array(n, pa.int64()), pa.array(forms), *counts, made]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return transform


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars and the output text of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    columns = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(transformer(seed, fim_percent, spm_percent), columns)


def restored(made: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep and the text, rebuilt from the columns output and form alone."""

    def restore(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(rows, "output"):
            back = strings(*gather(*texts_of(run.column("output")), run.column("form").to_pylist()))
            yield pa.RecordBatch.from_arrays([*(run.column(c) for c in keep), back], [*keep, "text"])

    kinds = dict(made.dtypes)
    rows = made.select(*keep, *(c for c in ("output", "form") if c not in keep))
    return rows.mapInArrow(restore, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", text string")


def sha256(text: str) -> Column:
    return F.sha2(F.col(text).cast("binary"), 256)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, cuts, and the digests of its output and of the text rebuilt from it."""
    made = fill_in_middle(table(spark, sf_dir, "documents")).withColumn("output_sha256", sha256("output"))
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return restored(made, kept).select(*kept, sha256("text").alias("restored_sha256"))


CHECK_OP13 = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
           list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), k, 8))::BIGINT) AS h
    FROM documents
), cut AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS p, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS q,
           CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), pieces AS (
    SELECT *, substring(t, 1, p) AS prefix, substring(t, p + 1, q - p) AS middle, substring(t, q + 1, n - q) AS suffix FROM cut
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM pieces
"""
