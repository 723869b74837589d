"""Fill-in-the-middle over seekable compressed frames.

A text is cut into frames of a fixed number of code points, each an independent zstandard frame of its
UTF-8 bytes, with the units (runs of ASCII letters, or single other characters) and code points that
stand before it. A unit belongs to the frame in which it begins, so a run of letters of any length may
stretch over frames. To cut a text at a unit, the frame is found in the cumulative counts and only that
one is decompressed; all other frames go into the output as they are, and the frames of an output in
their order are again one zstandard stream. The store is written once and serves any number of epochs,
which draw other cuts. Digests and restoring stream frame after frame; no text is ever put together.

The draws come from the SHA-256 of epoch and doc_id: where to cut, whether the text stays plain, and
the order of the parts. A text that holds a sentinel stays plain, so sentinels in an output are its own.

Defined results: a null text is empty, an empty one plain with no units; a null doc_id draws as an
empty name; repeated rows come out as often as they occur; very long texts are many frames; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtrace.llm.batches import record_batch, text_slices
from normtrace.session import settle_packed

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FRAME_CHARS = 1 << 15
LEVEL = 3
PLAIN_FROM = 90
SPM_BELOW = 20
ROWS_AT_ONCE = 256

FRAME = pa.struct([("units_before", pa.int64()), ("chars_before", pa.int64()), ("joined", pa.bool_()), ("data", pa.binary())])
STORE = {"doc_id": pa.int64(), "n": pa.int64(), "n_chars": pa.int64(), "marked": pa.bool_(), "frames": pa.list_(FRAME)}
STORE_DDL = "doc_id long, n long, n_chars long, marked boolean, frames array<struct<units_before: long, chars_before: long, joined: boolean, data: binary>>"
MADE = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.list_(pa.binary())}
MADE_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>"


def unit_starts(text: str, joined: bool) -> np.ndarray:
    """Which code points of a frame begin a unit; ``joined`` frames begin inside a run of letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = ((points | 32) - 97) < 26
    starts = np.ones(len(points), bool)
    starts[1:] = ~(letters[1:] & letters[:-1])
    if joined:
        starts[0] = False
    return starts


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def frames_of(text: str, compress, frame_chars: int = FRAME_CHARS) -> tuple[int, list[dict]]:
    """Number of units of a text, and its frames."""
    units, frames = 0, []
    for at in range(0, len(text), frame_chars):
        part = text[at:at + frame_chars]
        joined = at > 0 and _letter(text[at - 1]) and _letter(part[0])
        frames.append({"units_before": units, "chars_before": at, "joined": joined, "data": compress(part.encode("utf-8", "surrogatepass"))})
        units += int(unit_starts(part, joined).sum())
    return units, frames


def store_frames(docs: DataFrame, frame_chars: int = FRAME_CHARS) -> DataFrame:
    """The frame store ``(doc_id, n, n_chars, marked, frames)`` of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        marks = [m.decode() for m in (PREFIX, SUFFIX, MIDDLE)]
        for batch in batches:
            for keys, texts in text_slices(batch.column(0), batch.column(1)):
                rows = []
                for key, text in zip(keys, texts):
                    units, frames = frames_of(text, compress, frame_chars)
                    rows.append((key, units, len(text), any(m in text for m in marks), frames))
                yield record_batch(STORE, rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, STORE_DDL)


def draw(doc_id: int | None, epoch: int) -> list[int]:
    """Four numbers under 2^32 for a document and an epoch."""
    digest = hashlib.sha256(f"{epoch}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4)]


class Cutter:
    """Cuts stored texts at units; keeps the last frame it decompressed."""

    def __init__(self) -> None:
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.expand = zstandard.ZstdDecompressor().decompress

    def locate(self, frames: list[dict], unit: int, n: int, n_chars: int) -> tuple[int, int, int]:
        """Frame, byte in the frame, and code points before a unit; the end for ``unit == n``."""
        if unit == n:
            return len(frames), 0, n_chars
        at = bisect_right(frames, unit, key=lambda f: f["units_before"]) - 1
        text = self.expand(frames[at]["data"]).decode("utf-8", "surrogatepass")
        place = int(np.flatnonzero(unit_starts(text, frames[at]["joined"]))[unit - frames[at]["units_before"]])
        return at, len(text[:place].encode("utf-8", "surrogatepass")), frames[at]["chars_before"] + place

    def between(self, frames: list[dict], a: tuple, b: tuple) -> list[bytes]:
        """Frames of what lies between two places: whole ones as they are, cut ones compressed anew."""
        (first, skip, _), (last, upto, _) = a, b
        if first == last:
            return [self.compress(self.expand(frames[first]["data"])[skip:upto])] if upto > skip else []
        out = [frames[first]["data"] if not skip else self.compress(self.expand(frames[first]["data"])[skip:])]
        out += [f["data"] for f in frames[first + 1:last]]
        return out + ([self.compress(self.expand(frames[last]["data"])[:upto])] if upto else [])

    def transform(self, row: dict, epoch: int) -> tuple:
        """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of a stored text."""
        n, frames = row["n"], row["frames"]
        h1, h2, h3, h4 = draw(row["doc_id"], epoch)
        if not n or row["marked"] or h3 % 100 >= PLAIN_FROM:
            return row["doc_id"], n, "plain", None, None, [f["data"] for f in frames]
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        start, end = (0, 0, 0), (len(frames), 0, row["n_chars"])
        a, b = (self.locate(frames, unit, n, row["n_chars"]) for unit in (low, high))
        prefix, middle, suffix = self.between(frames, start, a), self.between(frames, a, b), self.between(frames, b, end)
        p, s, m = map(self.compress, (PREFIX, SUFFIX, MIDDLE))
        if h4 % 100 < SPM_BELOW:
            form, output = "spm", [s, *suffix, p, *prefix, m, *middle]
        else:
            form, output = "psm", [p, *prefix, s, *suffix, m, *middle]
        return row["doc_id"], n, form, a[2], b[2] - a[2], output


def fill_middle(store: DataFrame, epoch: int = 1) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, output as frames of one stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield record_batch(MADE, [cutter.transform(row, epoch) for row in batch.slice(at, ROWS_AT_ONCE).to_pylist()])

    return store.mapInArrow(run, MADE_DDL)


def stream(frames: list[bytes], start: int = 0, end: int | None = None) -> Iterator[bytes]:
    """The bytes from ``start`` to ``end`` of an output, frame by frame; frames outside stay compressed."""
    expand, at = zstandard.ZstdDecompressor().decompress, 0
    for data in frames:
        size = zstandard.frame_content_size(data)
        if at + size > start and (end is None or at < end):
            part = expand(data)
            yield part[max(0, start - at):None if end is None else end - at]
        at += size


def _find(frames: list[bytes], mark: bytes) -> int:
    """Where a sentinel stands in an output, also across the end of a frame."""
    at, rest = 0, b""
    for part in stream(frames):
        seen = rest + part
        place = seen.find(mark)
        if place >= 0:
            return at - len(rest) + place
        at, rest = at + len(part), seen[1 - len(mark):]
    raise ValueError(f"no {mark.decode()} in the output")


def restored(form: str, frames: list[bytes]) -> Iterator[bytes]:
    """The first text, read back from an output and its form."""
    if form == "plain":
        yield from stream(frames)
        return
    p, s, m = (_find(frames, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    ends = {"psm": (s, m), "spm": (m, p)}[form]
    yield from stream(frames, p + len(PREFIX), ends[0])
    yield from stream(frames, m + len(MIDDLE))
    yield from stream(frames, s + len(SUFFIX), ends[1])


def output_text(frames: list[bytes]) -> str:
    return b"".join(stream(frames)).decode("utf-8", "surrogatepass")


def with_digests(made: DataFrame) -> DataFrame:
    """``made`` with the SHA-256 of every output and of the text restored from it, instead of the output."""
    types = {**{k: v for k, v in MADE.items() if k != "output"}, "output_sha256": pa.string(), "restored_sha256": pa.string()}

    def digest(parts: Iterator[bytes]) -> str:
        total = hashlib.sha256()
        for part in parts:
            total.update(part)
        return total.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], digest(stream(r["output"])), digest(restored(r["form"], r["output"])))
                        for r in batch.slice(at, ROWS_AT_ONCE).to_pylist()]
                yield record_batch(types, rows)

    return made.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def digest_documents(docs: DataFrame, epoch: int = 1) -> DataFrame:
    """Store written once, outputs of one epoch, and their digests."""
    return with_digests(fill_middle(settle_packed(store_frames(docs), "frames"), epoch))
