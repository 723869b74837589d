"""Best-fit-decreasing packing of token ids into fixed-length rows, with a segment tree over free space.

Documents are encoded, an end id is added, and what is longer than a row is split without loss. Pieces
are gathered up to a window of tokens, placed longest first into the row with the least space that
holds them, and written with what a training job needs: the padded id matrix, cumulative segment
lengths, positions that start again at every segment. The emptiest eighth of a window's rows is taken
apart again and packed with the next window, so only the last window of a task leaves gaps.

Everything happens where a text is read: no shuffle, and memory for one window.

Defined results: a null text is an empty document (its end id alone); repeated rows are packed as
often as they occur; a null doc_id is kept; equal lengths go in order of arrival; an empty table gives
no rows; other columns are ignored; an id beyond 16 bits stops the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtrace.llm.batches import record_batch, text_slices
from normtrace.llm.ids import VOCABULARY, id_bytes, piece_starts

LIMIT = 2048
END = 0
WINDOW_TOKENS = 1 << 22
CARRIED = 8

ROWS = "sequence_id long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"
ROW_TYPES = {"sequence_id": pa.int64(), "n_tokens": pa.int32(), "ids": pa.binary(), "positions": pa.binary(), "cu_seqlens": pa.list_(pa.int32()),
             "doc_ids": pa.list_(pa.int64()), "pieces": pa.list_(pa.int32()), "starts": pa.list_(pa.int64())}

Piece = tuple  # doc_id, piece number, start in the document, ids as unsigned 16-bit numbers


class FreeSpace:
    """Rows by free space, in a segment tree of counts: the least space that is enough, in log steps."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(limit + 1)]

    def _change(self, space: int, by: int) -> None:
        node = space + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        self._change(space, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The space and number of a row with the least space of at least ``least``; it is taken out."""
        node = least + self.size
        while not self.count[node]:
            while node & 1:  # a right child: everything to the right is above
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node *= 2
            node += not self.count[node]
        space = node - self.size
        self._change(space, -1)
        return space, self.rows[space].pop()


def pack_window(pieces: list[Piece], limit: int) -> list[list[Piece]]:
    """Rows of pieces, longest pieces first, each into the fullest row that holds it."""
    free, rows = FreeSpace(limit), []
    for piece in sorted(pieces, key=lambda p: -len(p[3])):
        size = len(piece[3])
        found = free.take(size)
        if found is None:
            found = limit, len(rows)
            rows.append([])
        space, row = found
        rows[row].append(piece)
        if space > size:
            free.put(space - size, row)
    return rows


def _space(row: list[Piece], limit: int) -> int:
    return limit - sum(len(p[3]) for p in row)


def pack_matrices(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY, end: int = END, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """One row per packed sequence of ``docs(doc_id, text)``.

    ``ids`` and ``positions`` hold ``limit`` little-endian unsigned 16-bit numbers, zeros after the last
    segment; segment i of a row covers ``cu_seqlens[i]`` to ``cu_seqlens[i + 1]`` and is piece
    ``pieces[i]`` of document ``doc_ids[i]``, from its id ``starts[i]`` on.
    """

    def matrix_row(sequence: int, row: list[Piece]) -> tuple:
        lengths = [len(p[3]) for p in row]
        bounds = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        ids, positions = np.zeros(limit, "<u2"), np.zeros(limit, "<u2")
        for piece, a, b in zip(row, bounds, bounds[1:]):
            ids[a:b] = piece[3]
            positions[a:b] = np.arange(b - a)
        return sequence, bounds[-1], ids.tobytes(), positions.tobytes(), bounds, [p[0] for p in row], [p[1] for p in row], [p[2] for p in row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_bytes(vocabulary)
        made, waiting, held = TaskContext.get().partitionId() << 40, [], 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, waiting, held
            rows = sorted(pack_window(waiting, limit), key=lambda r: _space(r, limit))
            kept = 0 if final else len(rows) // CARRIED
            ready, again = rows[:len(rows) - kept], rows[len(rows) - kept:]
            waiting = [p for row in again for p in row]
            held = sum(len(p[3]) for p in waiting)
            for first in range(0, len(ready), 256):
                part = ready[first:first + 256]
                yield record_batch(ROW_TYPES, [matrix_row(made + i, row) for i, row in enumerate(part)])
                made += len(part)

        for batch in batches:
            for keys, texts in text_slices(batch.column(0), batch.column(1)):
                for key, text in zip(keys, texts):
                    wide = np.append(np.frombuffer(encode(text), "<u4"), np.uint32(end))
                    if wide.max() >= 1 << 16:
                        raise ValueError("an id needs more than 16 bits")
                    ids = wide.astype("<u2")
                    starts = piece_starts(len(ids), limit)
                    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                        waiting.append((key, i, a, ids[a:b]))
                    held += len(ids)
                    if held >= window_tokens:
                        yield from flush(False)
        yield from flush(True)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROWS)


def unpack_matrices(packed: DataFrame) -> DataFrame:
    """``(doc_id, piece, start, ids)`` of every segment, ids as packed 16-bit numbers."""
    segment = F.posexplode("doc_ids").alias("i", "doc_id")
    at = lambda name: F.get(name, F.col("i"))
    bound = F.get("cu_seqlens", F.col("i"))
    return packed.select("*", segment).select(
        "doc_id", at("pieces").alias("piece"), at("starts").alias("start"),
        F.substr("ids", 2 * bound + 1, 2 * (F.get("cu_seqlens", F.col("i") + 1) - bound)).alias("ids"))
