"""Bounded-space online best-fit packing of documents into sequences of a fixed length.

Every document becomes its ids and an end id; only what is longer than a sequence is cut. Packing is
on line: a piece goes to the open sequence with the least free space that still holds it. A bitset of
free spaces finds that sequence; when too many are open, the fullest closes first.

Texts are encoded where they are read and never shuffled: packing needs lengths only.

Defined results: a null text is an empty document (its end id alone); repeated rows are packed as
often as they occur; a null doc_id is kept; ties go to the sequence that reached that free space
last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtrace.llm.batches import record_batch, text_slices
from normtrace.llm.ids import VOCABULARY, id_bytes, piece_starts
from normtrace.session import settle_packed

LIMIT = 2048
OPEN = 512
END = 0
PIECES_PER_TASK = 1 << 15

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_TYPES = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}


class OpenSequences:
    """A fixed number of open sequences, found by free space through one bitset."""

    def __init__(self, limit: int, most: int):
        self.limit, self.most = limit, most
        self.bits = 0
        self.at: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        at = self.at[free]
        sequence = at.pop()
        if not at:
            self.bits &= ~(1 << free)
        self.open -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        """The sequence that takes a piece of ``length``, and the offset there."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, sequence = self.limit, self.made
            self.made += 1
        left = free - length
        if left:
            self.at.setdefault(left, []).append(sequence)
            self.bits |= 1 << left
            self.open += 1
        return sequence, self.limit - free


def measure_pieces(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Pieces of every document with length and checksum; ``docs(doc_id, text)``."""
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_bytes(vocabulary)
        for batch in batches:
            for keys, texts in text_slices(batch.column(0), batch.column(1)):
                out: list[tuple] = []
                for key, text in zip(keys, texts):
                    ids = encode(text) + last
                    tokens = len(ids) // 4
                    starts = piece_starts(tokens, limit)
                    for i, (a, b) in enumerate(zip(starts, [*starts[1:], tokens])):
                        out.append((key, i, a, b - a, zlib.crc32(ids[4 * a:4 * b])))
                yield record_batch(PIECE_TYPES, out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack_pieces(pieces: DataFrame, tasks: int, limit: int = LIMIT, most_open: int = OPEN) -> DataFrame:
    """Deal pieces to ``tasks`` streams and pack each on line; adds sequence_id and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = OpenSequences(limit, most_open)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [packer.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                [*batch.schema.names, "sequence_id", "offset"])

    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32"))
    return dealt.sortWithinPartitions("doc_id", "piece", "ids_crc32").mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, limit: int = LIMIT, most_open: int = OPEN, vocabulary: str = VOCABULARY, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """One row per piece with its sequence and offset. Lengths are measured once and kept."""
    pieces = settle_packed(measure_pieces(docs, limit, vocabulary), "pieces")
    tasks = -(-max(1, pieces.count()) // pieces_per_task)
    return pack_pieces(pieces, tasks, limit, most_open)
