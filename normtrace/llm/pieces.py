"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over a text once. Each position keeps the best way to end there and a pointer to
where its last piece began; candidates reach back no further than the longest piece. Whenever the
pointer paths of all positions that may still matter meet in one boundary, the ids before it are
final, are handed out, and their states are dropped.

What is best depends on the kind of model. A unigram model takes the path with the greatest sum of
scores. In a BPE model the scores are merge ranks, which no sum can compare; there a path is good when
every two neighbours on it stay apart if merged by themselves. Exactly one path has that, and it is the
result of the merges, so both kinds give the ids of the model's own library.

Paths of a BPE model also meet before every word (a space mark after another character, unless a piece
spans one), so its texts are searched word by word, and words seen before are looked up. Unigram texts
are searched as a whole: sums of equal paths differ by rounding, which depends on what was summed before.

Defined results: a null or empty text has no ids; characters outside the model become bytes, or, in a
model without bytes, one unknown id for each run; repeated rows come out as often as they occur; a null
doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtrace.llm.batches import loaded, record_batch, text_slices

MODEL = "piece_bpe_32k.model"
KEEP_WORDS = 800_000
KEEP_PAIRS = 1_000_000
KEEP_CHARS = 64

# Fixed values of the model format: the space mark, the model kinds, how unknown characters are scored.
SPACE = "▁"
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a serialized message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, message[at:at + size]
            at += size


def model_kind(serialized: bytes) -> int:
    """The kind of model, from its trainer settings; unigram where none is named."""
    for number, value in _fields(serialized):
        if number == 2:
            return next((v for n, v in _fields(value) if n == 3), UNIGRAM)
    return UNIGRAM


class Pieces:
    """Vocabulary of a model and the search over it."""

    def __init__(self, serialized: bytes):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=serialized)
        self.normalize: Callable[[str], str] = processor.normalize
        self.kind = model_kind(serialized)
        count = processor.get_piece_size()
        self.ids = {processor.id_to_piece(i): i for i in range(count) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))}
        self.packed = {piece: array("I", [i]).tobytes() for piece, i in self.ids.items()}
        self.scores = {piece: processor.get_score(i) for piece, i in self.ids.items()}
        self.unknown = processor.unk_id()
        self.bytes = {int(processor.id_to_piece(i)[3:5], 16): i for i in range(count) if processor.is_byte(i)}
        value = {i: b for b, i in self.bytes.items()}
        self.surface = [bytes([value[i]]) if i in value else b"" if processor.is_control(i) else " ⁇ ".encode() if processor.is_unknown(i) else processor.id_to_piece(i).replace(SPACE, " ").encode() for i in range(count)]
        self.longest = max(map(len, self.ids))
        self.begins = {piece[:n]: False for piece in self.ids for n in range(1, len(piece))} | dict.fromkeys(self.ids, True)
        self.lowest = float(np.float32(min(self.scores.values()) - UNKNOWN_PENALTY))
        whole = self.kind == UNIGRAM or any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.ids)
        self.words = re.compile("(?s:.+)" if whole else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.together: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.seen: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """A short text after all merges, the best first and the leftmost of equals."""
        parts, score, none = list(text), self.scores.get, -np.inf
        gains = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while gains and (best := max(gains)) > none:
            i = gains.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], none)
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], none)
        return parts

    def stays(self, before: str, piece: str) -> bool:
        """Whether two pieces (or nothing and a piece) come out of the merges as they are."""
        if self.pairs > KEEP_PAIRS:
            self.together.clear()
            self.pairs = 0
        found = self.merged(before + piece) == ([before, piece] if before else [piece])
        self.together.setdefault(before, {})[piece] = found
        self.pairs += 1
        return found

    def search(self, text: str) -> Iterator[str]:
        """Pieces of a normalized text, handed out as soon as they are final.

        ``last`` has for every position in reach the last piece of the best way to end there.
        """
        unigram, begins, longest, together = self.kind == UNIGRAM, self.begins, self.longest, self.together
        last, sums = {0: ""}, {0: 0.0}
        size, done = len(text), 0
        for start in range(size):
            before = last.get(start)
            if before is None:
                continue
            stays = together.get(before) or {}
            for end in range(start + 1, min(start + longest, size) + 1):
                piece = text[start:end]
                whole = begins.get(piece)  # true for a piece, false for the beginning of one
                if whole or end == start + 1:
                    if unigram:  # sums in single precision, as the library forms them
                        total = float(np.float32(sums[start] + self.scores.get(piece, self.lowest)))
                        if end not in last or total > sums[end]:
                            last[end], sums[end] = piece, total
                    elif end not in last:
                        good = stays.get(piece)
                        if good or good is None and self.stays(before, piece):
                            last[end] = piece
                if whole is None:
                    break
            if start - done >= 4 * longest and start % longest == 0:
                meet = self._meet(last, start, done)
                yield from self._path(last, meet, done)
                for gone in range(done, meet):
                    last.pop(gone, None)
                    sums.pop(gone, None)
                done = meet
        yield from self._path(last, size, done)

    def _meet(self, last: dict[int, str], at: int, done: int) -> int:
        """The last boundary that the paths of all positions still in reach have in common."""
        open_ = {i for i in range(at + 1, at + self.longest + 1) if i in last}
        while len(open_) > 1 or max(open_) > at:
            latest = max(open_)
            open_.remove(latest)
            open_.add(max(latest - len(last[latest]), done))
        return open_.pop()

    @staticmethod
    def _path(last: dict[int, str], at: int, done: int) -> list[str]:
        out = []
        while at > done:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def numbers(self, pieces: Iterable[str]) -> Iterator[int]:
        run = False
        for piece in pieces:
            known = self.ids.get(piece)
            if known is not None:
                yield known
            elif self.bytes:
                yield from (self.bytes[b] for b in piece.encode("utf-8", "surrogatepass"))
            elif not run:
                yield self.unknown
            run = known is None

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit numbers."""
        if len(self.seen) > KEEP_WORDS:
            self.seen.clear()
        seen, words = self.seen, self.words.findall(self.normalize(text))
        out = [seen.get(word) for word in words]
        for i, ids in enumerate(out):
            if ids is None:
                word = words[i]
                out[i] = ids = seen.get(word) or self.ids_of(word)
                if len(word) <= KEEP_CHARS:
                    seen[word] = ids
        return b"".join(out)

    def short(self, word: str) -> list[str]:
        """The path of :meth:`search` for a short word of a BPE model: done as soon as the end has its one good path."""
        begins, longest, together, size = self.begins, self.longest, self.together, len(word)
        last: list[str | None] = ["", *[None] * size]
        for start in range(size):
            before = last[start]
            if before is None:
                continue
            stays = together.get(before) or {}
            for end in range(start + 1, min(start + longest, size) + 1):
                piece = word[start:end]
                whole = begins.get(piece)
                if (whole or end == start + 1) and last[end] is None:
                    good = stays.get(piece)
                    if good or good is None and self.stays(before, piece):
                        last[end] = piece
                if whole is None:
                    break
            if last[size] is not None:
                break
        return self._path(last, size, 0)

    def ids_of(self, word: str) -> bytes:
        pieces = self.short(word) if self.kind == BPE and len(word) <= KEEP_CHARS else list(self.search(word))
        try:
            return b"".join([self.packed[piece] for piece in pieces])
        except KeyError:  # characters outside the model
            return array("I", self.numbers(pieces)).tobytes()

    def decode(self, packed: bytes) -> str:
        """The normalized text of packed ids."""
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def open_pieces(name: str = MODEL) -> Pieces:
    """The model of a file on the machine that asks; kept by the worker process."""
    kept = loaded()
    if ("pieces", name) not in kept:
        import public_tokenizers

        with open(public_tokenizers.path(name), "rb") as file:
            kept["pieces", name] = Pieces(file.read())
    return kept["pieces", name]


def encode_documents(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``docs(doc_id, text)``, ids packed as unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = open_pieces(name)
        for batch in batches:
            for keys, texts in text_slices(batch.column(0), batch.column(1)):
                yield record_batch({"doc_id": pa.int64(), "ids": pa.binary()}, [(k, pieces.encode(t)) for k, t in zip(keys, texts)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, name: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` back from ``encoded(doc_id, ids)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = open_pieces(name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces.decode(i or b"") for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """Per document the number of ids, their checksum, and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = open_pieces(name)
        types = {"doc_id": pa.int64(), "n_ids": pa.int64(), "ids_crc32": pa.int64(), "restored": pa.bool_()}
        for batch in batches:
            for keys, texts in text_slices(batch.column(0), batch.column(1)):
                coded = [pieces.encode(t) for t in texts]
                yield record_batch(types, [(k, len(c) // 4, zlib.crc32(c), pieces.decode(c) == t) for k, t, c in zip(keys, texts, coded)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, restored boolean")
