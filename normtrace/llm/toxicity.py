"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text has the features of its distinct words: the word, and for beginnings of 4 to 7 characters whether
one, two or three different words have them; and its length, as the doublings of its number of distinct words.
One weight vector serves all ordered thresholds: P(grade > k) = s(w.x - t_k), s the
logistic function, t_1 < t_2 < ... The expected grade, the sum of these probabilities, is the severity.

The features whose smoothed log-odds between toxic and clean texts are farthest from zero, in standard
errors, are chosen; there is no least value, so few labels give the best features there are, at any share
of toxic texts. Weights have either sign. A feature counts in proportion to its standard errors, so the
ridge penalty holds down the weak ones; features of clean texts and lengths count less (``CLEAN_SCALE``), as
lacking them makes no text toxic. The labels only tell
toxic from clean, so grades are drawn from the features: a clean text has grade 0, and toxic texts
are graded 1 to 3 by thirds of the number of words with a feature that mostly comes with the toxic label.
The fit uses a bounded sample of labelled rows (``SAMPLE_ROWS``,
those with the lowest hashes of doc_id), near copies in it counted once; scoring reads whole texts.

Defined results: a null text has no features; repeated rows are scored as often as they occur; of
contradicting labels of one doc_id toxic wins; rows with null labels teach nothing; without toxic and
clean labels every severity is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtrace.llm.batches import record_batch, struct_array, text_slices
from normtrace.session import settle_packed

SAMPLE_ROWS = 6000
GRADES = 4
MOST_FEATURES = 4096
LEAST_SHARE = 0.8
SMOOTHING = 0.5
CLEAN_SCALE = 0.1
ROUNDS = 600
RATE = 0.05
RIDGE = 1e-4
REJECT = 0.5
BEGINNINGS = (4, 5, 6, 7)
COPY_WORDS = 5
LEVELS = (1, 2, 3)
DOUBLINGS = 24
KEEP_WORDS = 100_000

WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    return ["=" + word, *[f"{n}{word[:n]}" for n in BEGINNINGS if len(word) >= n]]


def length_features(words: int) -> list[str]:
    """One for every doubling of the number of distinct words."""
    return [f"#{k}@1" for k in range(1, min(DOUBLINGS, words.bit_length() - 1) + 1)]


def copy_key(words: list[str]) -> int:
    """The least hash of the word shingles of a text; near copies mostly share it."""
    if len(words) <= COPY_WORDS:
        return zlib.crc32(" ".join(words).encode("utf-8", "surrogatepass"))
    return min(zlib.crc32(" ".join(words[i:i + COPY_WORDS]).encode("utf-8", "surrogatepass")) for i in range(len(words) - COPY_WORDS + 1))


@dataclass
class Model:
    """Weights by feature and ordered thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def exceeds(self, score: float) -> list[float]:
        """P(grade > k) for every threshold."""
        return [1 / (1 + float(np.exp(np.clip(t - score, -500, 500)))) for t in self.thresholds]

    def scorer(self):
        """Weighted sum of the features of a text; words are looked up once."""
        levels: dict[str, list[tuple[int, float]]] = {}
        for feature, weight in sorted(self.weights.items()):
            base, _, level = feature.rpartition("@")
            levels.setdefault(base, []).append((int(level), weight))
        seen: dict[str, tuple[str, ...]] = {}

        def score(text: str) -> float:
            if len(seen) > KEEP_WORDS:
                seen.clear()
            words: dict[str, int] = {}
            distinct = set(WORD.findall(text.lower()))
            for word in distinct:
                known = seen.get(word)
                if known is None:
                    known = tuple(f for f in word_features(word) if f in levels)
                    if len(word) < 64:
                        seen[word] = known
                for f in known:
                    words[f] = words.get(f, 0) + 1
            length = sum(self.weights.get(f, 0.0) for f in length_features(len(distinct)))
            return length + sum(weight for f in sorted(words) for level, weight in levels[f] if words[f] >= level)

        return score


def fit(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, features: int, levels: int = GRADES, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient steps on the ordinal likelihood; ``rows``/``columns`` tell present features.

    A present feature has the value ``scale`` gives it, or 1.
    """
    n = len(grades)
    scale = np.ones(features) if scale is None else scale
    w = np.zeros(features)
    above = np.array([max(1e-3, (grades > k).mean()) for k in range(levels - 1)])
    first = -np.log(above[0] / (1 - min(above[0], 1 - 1e-3)))
    logits = -np.log(above / (1 - np.minimum(above, 1 - 1e-3)))
    free = np.concatenate([[first], np.log(np.maximum(np.diff(logits), 0.05))])
    sizes = (features, levels - 1)
    moment, second = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    share = np.where(grades > 0, max(1, (grades > 0).sum()) ** -0.5, max(1, (grades == 0).sum()) ** -0.5)  # between rows and sides weighing the same
    share /= share.sum()
    for step in range(1, ROUNDS + 1):
        t = np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])
        bounds = np.concatenate([[-np.inf], t, [np.inf]])
        score = np.bincount(rows, (w * scale)[columns], n)
        high, low = sigmoid(bounds[grades + 1] - score), sigmoid(bounds[grades] - score)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        slope = (d_high - d_low) * share  # of the loss in the score
        g_w = np.bincount(columns, slope[rows], features) * scale + RIDGE * w
        g_t = np.zeros(levels + 1)
        np.add.at(g_t, grades + 1, -d_high * share)
        np.add.at(g_t, grades, d_low * share)
        g_t = g_t[1:-1]
        g_free = np.concatenate([[g_t.sum()], np.cumsum(g_t[::-1])[::-1][1:] * np.exp(free[1:])])
        for i, (value, g) in enumerate(((w, g_w), (free, g_free))):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            value -= RATE * (moment[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return w * scale, np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows of ``docs(doc_id, text)``, ``labels(doc_id, toxic)``."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for marks, texts in text_slices(batch.column(0), batch.column(1)):
                out = []
                for mark, text in zip(marks, texts):
                    words = WORD.findall(text.lower())
                    out.append((mark, copy_key(words), sorted(set(words))))
                yield record_batch({"toxic": pa.int32(), "copy": pa.int64(), "words": pa.list_(pa.string())}, out)

    # at most sample_rows narrow rows are broadcast
    drawn = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")
    texts = settle_packed(drawn.mapInArrow(read, "toxic int, copy long, words array<string>").dropDuplicates(["copy", "toxic"]), "labelled")
    word = F.explode("words").alias("word")
    begins = [F.when(F.length("word") >= n, F.concat(F.lit(str(n)), F.substring("word", 1, n))) for n in BEGINNINGS]
    numbered = texts.select("copy", "toxic", word).select("copy", "toxic", F.explode(F.array(F.concat(F.lit("="), "word"), *begins)).alias("feature")).where("feature IS NOT NULL")
    size = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not size.n or not 0 < size.toxic < size.n:
        return Model()
    clean, toxic = size.n - size.toxic, size.toxic
    in_toxic, in_clean = F.col("t") + SMOOTHING, F.col("n") - F.col("t") + SMOOTHING
    odds = F.log(in_toxic / (toxic + 2 * SMOOTHING)) - F.log(in_clean / (clean + 2 * SMOOTHING))
    level = F.explode(F.filter(F.array(*map(F.lit, LEVELS)), lambda k: k <= F.col("words")))
    leveled = numbered.groupBy("copy", "toxic", "feature").agg(F.count("*").alias("words")).withColumn("level", level)
    present = leveled.select("toxic", F.concat("feature", F.lit("@"), "level").alias("feature"))
    found = (present.groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
             .withColumn("tie", F.abs(odds / F.sqrt(1 / in_toxic + 1 / in_clean))))
    ties = found.orderBy(F.desc("tie"), "feature").limit(MOST_FEATURES).collect()
    place = {r.feature: i for i, r in enumerate(ties)}
    leaning = {r.feature.rpartition("@")[0] for r in ties if r.t >= LEAST_SHARE * r.n}
    place |= {f: len(ties) + i for i, f in enumerate(length_features(1 << DOUBLINGS))}
    most = max([r.tie for r in ties], default=1.0) or 1.0
    scale = np.array([r.tie / most * (1.0 if r.t * size.n > r.n * toxic else CLEAN_SCALE) for r in ties] + [CLEAN_SCALE] * DOUBLINGS)
    evidence = _evidence(texts, place, leaning)
    marks, hits = (evidence.column(c).to_numpy() for c in ("toxic", "hits"))
    lists = evidence.column("present").combine_chunks()
    rows = np.repeat(np.arange(len(marks)), lists.value_lengths().to_numpy())
    cuts = np.quantile(hits[marks > 0], [k / (GRADES - 1) for k in range(1, GRADES - 1)])
    grades = np.where(marks > 0, 1 + (hits[:, None] > cuts).sum(axis=1), 0)
    w, t = fit(rows, lists.flatten().to_numpy(), grades, len(place), scale=scale)
    return Model({f: float(w[i]) for f, i in place.items()}, tuple(float(x) for x in t))


def _evidence(texts: DataFrame, place: dict[str, int], leaning: set[str]) -> pa.Table:
    """Of every sampled text, in a fixed order: its label, chosen features and words that have a ``leaning`` one."""
    bases = {feature.rpartition("@")[0] for feature in place}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for copy, toxic, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
                each = [[f for f in word_features(word) if f in bases] for word in words]
                count = Counter(f for fs in each for f in fs)
                present = {place[x] for f, n in count.items() for k in LEVELS if k <= n and (x := f"{f}@{k}") in place}
                present.update(place[f] for f in length_features(len(words)))
                out.append((copy, toxic, sorted(present), sum(not leaning.isdisjoint(fs) for fs in each)))
            yield record_batch({"copy": pa.int64(), "toxic": pa.int32(), "present": pa.list_(pa.int32()), "hits": pa.int32()}, out)

    found = texts.select("copy", "toxic", "words").mapInArrow(read, "copy long, toxic int, present array<int>, hits int")
    return found.orderBy("copy", "toxic").toArrow()


def severity_of(model: Model) -> Callable[[str], Column]:
    """A column function: severity, probability of being toxic, and the decision for a text column."""

    types = {"severity": pa.float64(), "p_toxic": pa.float64(), "toxic": pa.bool_()}

    @F.arrow_udf("severity double, p_toxic double, toxic boolean")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weigh = model.scorer()
        for column in batches:
            above = [model.exceeds(weigh(text)) or [0.0] for _, texts in text_slices(pa.nulls(len(column)), column) for text in texts]
            yield struct_array(types, [(sum(a), a[0], a[0] >= REJECT) for a in above])

    return judge


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, severity, p_toxic, toxic)`` of every row of ``docs(doc_id, text)``."""
    return docs.select("doc_id", severity_of(model)("text").alias("s")).select("doc_id", "s.severity", "s.p_toxic", "s.toxic")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that are judged toxic, all columns kept."""
    return docs.where(~severity_of(model)("text")["toxic"])
