"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to a fixed order with the counts of what followed. The
code length of a byte is -log2 of its frequency in the longest context the tree knows, and an escape
is paid for every longer context that never saw that byte (method C: a context with N symbols seen, D
of them different, escapes with D / (N + D)); below order zero bytes are uniform. The statistics are
frozen, so code lengths are exact sums, the same for a text wherever it stands. The language with the
shortest code wins.

All languages share one table of byte strings (a context and its next byte), each with the code
lengths in every language. For each byte of a text the longest known string that ends there is found;
what it adds to the code depends on that string alone, so scoring is one lookup and one sum per byte.

Defined results: a null text or one without a letter is ``und`` with score zero; ties go to the
language that sorts first; repeated rows come out as often as they occur; a null doc_id is kept; with
nothing to learn from every row is ``und``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normtrace.llm.batches import struct_array, text_slices
from normtrace.session import settle_packed

ORDER = 4
SAMPLE_ROWS = 300
LEAST_SEEN = 2
UNDETERMINED = "und"
BYTES_AT_ONCE = 1 << 18
SCALE = 8.0

# Every ASCII character that is no letter reads as one space.
PLAIN = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def plain_bytes(text: str) -> bytes:
    """The bytes a text is read as: lower case, runs of anything but letters as one space."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(PLAIN).split())


def framed(text: bytes) -> bytes:
    """A text between spaces, after a zero byte that no known string holds: it cuts all contexts."""
    return b"\0 " + text + b" "


def _strings(data: np.ndarray, length: int) -> np.ndarray:
    """All byte strings of ``length``, as numbers, by their last byte."""
    out = data[: len(data) - length + 1].astype(np.uint64)
    for i in range(1, length):
        out = (out << np.uint64(8)) | data[i: len(data) - length + 1 + i]
    return out


def count_strings(samples: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, length, string, n)``: how often each byte string occurs in the texts of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(framed(plain_bytes(text)))
            for lang, texts in held.items():
                data = np.frombuffer(b"".join(texts), np.uint8)
                for length in range(1, order + 2):
                    zeros = np.lib.stride_tricks.sliding_window_view(data == 0, length).any(axis=1)
                    strings, n = np.unique(_strings(data, length)[~zeros], return_counts=True)
                    for a in range(0, len(strings), 1 << 16):
                        part = strings[a:a + (1 << 16)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(part)), pa.array(np.full(len(part), length, np.int32)), pa.array(part.view(np.int64)), pa.array(n[a:a + (1 << 16)])],
                            ["lang", "length", "string", "n"])

    counted = samples.select("lang", "text").mapInArrow(run, "lang string, length int, string long, n long")
    return counted.groupBy("lang", "length", "string").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Frozen statistics: a hash table of byte strings and what each adds to the code per language."""

    langs: list[str]
    order: int
    keys: np.ndarray
    slots: np.ndarray
    adds: np.ndarray
    owed: np.ndarray

    def longest(self, data: np.ndarray) -> np.ndarray:
        """For every byte the table row of the longest known string that ends there."""
        found = np.full(len(data), -1, np.int32)
        left = np.arange(len(data))
        for length in range(min(self.order + 1, len(data)), 0, -1):
            at = left[left >= length - 1]
            strings = _strings(data, length)[at - (length - 1)] | (np.uint64(length) << np.uint64(56))
            found[at] = self.find(strings)
            left = left[found[left] < 0]
            if not len(left):
                break
        return found

    def find(self, strings: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.slots) - 1)
        at = ((strings * MIX) >> np.uint64(40)) & mask
        rows = np.full(len(strings), -1, np.int32)
        open_ = np.arange(len(strings))
        while len(open_):
            slot = self.slots[at]
            same = (slot >= 0) & (self.keys[slot] == strings[open_])
            rows[open_[same]] = slot[same]
            go = (slot >= 0) & ~same
            open_, at = open_[go], (at[go] + np.uint64(1)) & mask
        return rows

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language, each text read between spaces and by itself."""
        out = np.zeros((len(texts), len(self.langs)))
        data = np.frombuffer(b"".join(map(framed, texts)), np.uint8)
        ends = np.cumsum([len(t) + 3 for t in texts])
        zero = self.find(np.array([np.uint64(1) << np.uint64(56)]))[0]
        for first in range(0, len(data), BYTES_AT_ONCE):
            back = min(self.order, first)
            rows = self.longest(data[first - back:first + BYTES_AT_ONCE])[back:]
            owner = np.repeat(np.arange(len(texts)), np.diff(np.clip(ends, first, first + len(rows)), prepend=first))
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            out[owner[cuts]] += np.add.reduceat(self.adds[rows], cuts, axis=0)
            last = (ends > first) & (ends <= first + len(rows))
            out[last] -= self.owed[rows[ends[last] - 1 - first]]
        return out + self.owed[zero] - self.adds[zero]


def freeze(counts: list[tuple[str, int, int, int]], order: int = ORDER, least_seen: int = LEAST_SEEN) -> Model:
    """Code lengths of every known byte string in every language; ``counts`` as ``count_strings`` gives them."""
    langs = sorted({c[0] for c in counts})
    keys, codes, escapes = [], [], []
    lang = np.array([langs.index(c[0]) for c in counts], np.int64)
    length, string, n = (np.array([c[i] for c in counts], np.int64) for i in (1, 2, 3))
    total = np.zeros((1, len(langs)))
    every = np.arange(256, dtype=np.int64)
    for size in range(1, order + 2):
        mine = (length == size) & (n >= (1 if size < 3 else least_seen))
        known = every if size == 1 else np.unique(string[mine])
        if size > 1:  # all parts of a known string are known
            known = known[np.isin(known >> 8, keys[-1]) & np.isin(known & ((1 << (8 * (size - 1))) - 1), keys[-1])]
        seen = np.zeros((len(known), len(langs)))
        at = np.searchsorted(known, string[mine])
        ok = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == string[mine]) if len(known) else np.zeros(mine.sum(), bool)
        seen[at[ok], lang[mine][ok]] = n[mine][ok]
        context = known >> 8
        up = np.zeros(len(known), np.int64) if size == 1 else np.searchsorted(keys[-1], context)
        contexts = 1 if size == 1 else len(keys[-1])
        symbols, kinds = np.zeros((contexts, len(langs))), np.zeros((contexts, len(langs)))
        np.add.at(symbols, up, seen)
        np.add.at(kinds, up, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(symbols > 0, -np.log2(kinds / (symbols + kinds)), 0.0)
            direct = -np.log2(seen / (symbols + kinds)[up])
        lower = np.full((len(known), len(langs)), 8.0) if size == 1 else codes[-1][np.searchsorted(keys[-1], known & ((1 << (8 * (size - 1))) - 1))]
        # escapes of a context and of all its shorter forms
        if size == 1:
            total = escape
        else:
            tail = keys[-1] & ((1 << (8 * (size - 2))) - 1) if size > 2 else np.zeros(len(keys[-1]), np.int64)
            below = total if size == 2 else total[np.searchsorted(keys[-2], tail)]
            total = escape + (below[np.zeros(len(keys[-1]), np.int64)] if size == 2 else below)
        keys.append(known)
        codes.append(np.where(seen > 0, direct, escape[up] + lower))
        escapes.append(total)
    # what a string adds: its code, less the escapes already in its own context, plus those of the context it makes
    adds, owed, all_keys = [], [], []
    for size in range(1, order + 2):
        known = keys[size - 1]
        own = escapes[size - 1][np.zeros(len(known), np.int64) if size == 1 else np.searchsorted(keys[size - 2], known >> 8)]
        if size <= order:
            makes = escapes[size]
        else:
            makes = escapes[order][np.searchsorted(keys[order - 1], known & ((1 << (8 * order)) - 1))]
        adds.append(codes[size - 1] - own + makes)
        owed.append(makes)
        all_keys.append(known.astype(np.uint64) | (np.uint64(size) << np.uint64(56)))
    flat = np.concatenate(all_keys)
    slots = np.full(1 << max(10, int(2 * len(flat)).bit_length()), -1, np.int32)
    mask = np.uint64(len(slots) - 1)
    at, rows = ((flat * MIX) >> np.uint64(40)) & mask, np.arange(len(flat), dtype=np.int32)
    while len(rows):
        free = slots[at] < 0
        slots[at[free]] = rows[free]  # one of those that meet in a slot stays
        lost = slots[at] != rows
        at, rows = (at[lost] + np.uint64(1)) & mask, rows[lost]
    return Model(langs, order, flat, slots, np.concatenate(adds), np.concatenate(owed))


def sample_texts(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(lang, text)``: ``sample_rows`` distinct texts of every language (all, if fewer), by a hash of text.

    Only hashes are counted and drawn, of those about twice as many as needed are ordered; the written
    choice, ``sample_rows`` hashes of a language, is then small enough to find its texts where they are.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    hashes = settle_packed(labelled.select("lang", "h").distinct(), "hashes")
    texts = settle_packed(hashes.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    draw = F.pmod(F.col("h"), F.lit(1 << 20))
    drawn = hashes.join(texts, "lang").where(draw * F.col("n") < F.lit((2 * sample_rows + 50) << 20).cast("long"))
    order = Window.partitionBy("lang").orderBy(draw, "h")
    chosen = settle_packed(drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample_rows).select("lang", "h"), "sample")
    # a language's sample is bounded: counted in one place, its strings come out once each
    return labelled.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text").repartition("lang")


def learn(docs: DataFrame, order: int = ORDER, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on ``sample_rows`` distinct whole texts of every language that is named, however few they are."""
    counts = count_strings(sample_texts(docs, sample_rows), order).where((F.col("length") < 3) | (F.col("n") >= LEAST_SEEN))
    table = counts.toArrow()
    if not table.num_rows:
        return None
    return freeze(list(zip(*[table.column(c).to_pylist() for c in ("lang", "length", "string", "n")])), order)


def language_of(model: Model | None) -> Callable[[str], Column]:
    """A column function: the best language of a text, how far it leads (0 to 1), its bits per byte."""

    types = {"lang_pred": pa.string(), "score": pa.float64(), "bits": pa.float64()}

    @F.arrow_udf("lang_pred string, score double, bits double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = []
            for _, texts in text_slices(pa.nulls(len(column)), column):
                read = [plain_bytes(t) for t in texts]
                bits = model.code_lengths(read) if model else None
                for i, text in enumerate(texts):
                    if bits is None or not any(map(str.isalpha, text)):
                        out.append((UNDETERMINED, 0.0, None))
                        continue
                    each = bits[i] / (len(read[i]) + 1)
                    best = int(each.argmin())
                    out.append((model.langs[best], float(1 / np.exp2(SCALE * (each[best] - each)).sum()), float(each[best])))
            yield struct_array(types, out)

    return judge


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score, bits)`` of every row of ``docs(doc_id, text)``."""
    return docs.select("doc_id", language_of(model)("text").alias("l")).select("doc_id", "l.lang_pred", "l.score", "l.bits")


def drop_unreadable(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without rows that no language claims; without a model, rows without a letter."""
    found = language_of(model)("text")
    readable = F.col("text").rlike(r"\p{L}") if model is None else found["lang_pred"] != UNDETERMINED
    return docs.where(readable)
