"""Model calls as one batch operator: metrics, retries, sentinels, and the upsert of retried rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtrace.functions.text import NO_TEXT, is_blank, strip

# Status texts, the mark of a rate limit, the number of tries and the pause between.
SUCCESS = "Succès"
FAILURE_PREFIX = "Erreur: "
EXTRACTION_FAILURE_PREFIX = "Erreur d'extraction : "
RATE_LIMIT_MARK = "429"
MAX_TRIES = 3
PAUSE_SECONDS = 5.0
AT_ONCE = 8
CHARS_AT_ONCE = 2**20  # of prompts whose answers a worker holds before it gives them back
STAYED_LIMITED = "rate-limited to the end"
EMPTY_REPORT = "Error: The model returned an empty or malformed audit report."

METRICS = (
    "text string, latency_s double, prompt_tokens int, completion_tokens int, total_tokens int, "
    "finish_reason string, status string"
)
METRIC_NAMES = [part.split()[0] for part in METRICS.split(", ")]

# A model takes a prompt and gives {"text", "prompt_tokens", "completion_tokens", "total_tokens",
# "finish_reason"}. One that has a method ``batch`` takes a list of prompts instead and gives a list of
# such answers, or exceptions, in order. A loader makes a model, once per worker stream.
Model = Callable[[str], dict]
Loader = Callable[[], Model]


def _row(answer: dict | Exception, seconds: float) -> dict:
    """The metrics of a call; a failing one is a row with its error."""
    try:
        if isinstance(answer, Exception):
            raise answer
        row = {name: answer.get(name) for name in METRIC_NAMES}
        row["text"] = answer["text"].strip()
        row["status"] = SUCCESS
    except Exception as problem:
        row = dict.fromkeys(METRIC_NAMES)
        row["status"] = f"{FAILURE_PREFIX}{problem}"
    row["latency_s"] = round(seconds, 2)
    return row


def _call(model: Model, prompt: str) -> dict:
    began = time.monotonic()
    try:
        answer = model(prompt)
    except Exception as problem:
        answer = problem
    return _row(answer, time.monotonic() - began)


def _call_all(model: Model, prompts: list[str], pool: ThreadPoolExecutor) -> list[dict]:
    """One row per prompt, in order: a list at once where the model can, else several calls at a time."""
    if not hasattr(model, "batch"):
        rows, waiting = [None] * len(prompts), iter(range(len(prompts)))

        def answer_some() -> None:
            for i in waiting:  # each thread takes the next that nobody has; a task per prompt costs more than a quick call
                rows[i] = _call(model, prompts[i])

        for done in [pool.submit(answer_some) for _ in range(min(pool._max_workers, len(prompts)))]:
            done.result()
        return rows
    began = time.monotonic()
    try:
        answers = list(model.batch(prompts))
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
    except Exception as problem:
        answers = [problem] * len(prompts)
    return [_row(a, time.monotonic() - began) for a in answers]


def _limited(row: dict) -> bool:
    return row["status"] != SUCCESS and RATE_LIMIT_MARK in row["status"]


def _call_with_retries(model: Model, prompts: list[str], pool: ThreadPoolExecutor, tries: int, pause: float) -> list[dict]:
    rows = _call_all(model, prompts, pool)
    for _ in range(1, tries):
        again = [i for i, row in enumerate(rows) if _limited(row)]
        if not again:
            break
        time.sleep(pause)
        for i, row in zip(again, _call_all(model, [prompts[i] for i in again], pool)):
            rows[i] = row
    if tries > 1:  # rate-limited to the end: nothing to record
        rows = [dict.fromkeys(METRIC_NAMES) if _limited(row) else row for row in rows]
    return rows


def _slices(prompts: pd.Series, most: int = CHARS_AT_ONCE) -> Iterator[pd.Series]:
    """A batch in parts, in order; one begins with each prompt that reaches a further multiple of ``most`` characters."""
    passed = prompts.str.len().fillna(0).cumsum().to_numpy() // most
    ends = [i + 1 for i in range(len(prompts) - 1) if passed[i] < passed[i + 1]]
    for begin, end in zip([0, *ends], [*ends, len(prompts)]):
        yield prompts.iloc[begin:end]


def generate(
    df: DataFrame, prompt: str, loader: Loader, tries: int = 1, pause: float = PAUSE_SECONDS,
    out: str = "generation", at_once: int = AT_ONCE,
) -> DataFrame:
    """Add a struct with the answer and its metrics; only the prompt column goes to Python.

    A model of single prompts gets up to ``at_once`` calls at a time per worker, so it must bear that;
    a null prompt is not asked and has null metrics. With ``tries`` above 1 rate-limited calls are
    repeated after a pause; a row that stays rate-limited has a null status, and :func:`upsert` then
    keeps what was known before.
    """
    @F.pandas_udf(METRICS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loader()
        with ThreadPoolExecutor(at_once) as pool:
            for batch in (part for whole in batches for part in _slices(whole)):
                asked = batch.notna()
                rows = [dict.fromkeys(METRIC_NAMES)] * len(batch)
                for i, row in zip(asked.to_numpy().nonzero()[0], _call_with_retries(model, batch[asked].tolist(), pool, tries, pause)):
                    rows[i] = row
                frame = pd.DataFrame(rows, columns=METRIC_NAMES)
                for name in ("prompt_tokens", "completion_tokens", "total_tokens"):
                    frame[name] = frame[name].astype("Int32")
                yield frame

    # Non-deterministic, so that the optimizer never calls the model twice for one row.
    return df.withColumn(out, run.asNondeterministic()(F.col(prompt)))


def failure(generation: str) -> Column:
    """Why a call failed: its error, or that it stayed rate-limited; null for a success."""
    status = F.col(f"{generation}.status")
    error = F.substr(status, F.lit(len(FAILURE_PREFIX) + 1))
    return F.when(status.isNull(), F.lit(STAYED_LIMITED)).when(status != SUCCESS, error)


def generate_flat(df: DataFrame, prompt: str, loader: Loader, **options) -> DataFrame:
    """Like :func:`generate`, with the metrics as columns (``text`` is the answer)."""
    done = generate(df, prompt, loader, out="_g", **options)
    kept = [c for c in df.columns if c not in METRIC_NAMES]
    return done.select(*kept, "_g.*")


def extract_triplets(df: DataFrame, text: str, loader: Loader, prompt: Column | None = None,
                     out: str = "extraction") -> DataFrame:
    """Extraction text per row; a blank text gives the sentinel, a failing call its error text."""
    asked = df.withColumn("_p", F.when(~is_blank(F.col(text)), F.col(text) if prompt is None else prompt))
    done = generate(asked, "_p", loader, out="_g")
    value = (
        F.when(F.col("_p").isNull(), F.lit(NO_TEXT))
        .when(F.col("_g.status") == SUCCESS, F.col("_g.text"))
        .otherwise(F.concat(F.lit(EXTRACTION_FAILURE_PREFIX), failure("_g")))
    )
    return done.withColumn(out, value).drop("_p", "_g")


def explain(df: DataFrame, prompt: str, loader: Loader, out: str = "explanation", **options) -> DataFrame:
    """Report text per row; a failed or empty answer gives a fixed sentence."""
    done = generate(df, prompt, loader, out="_g", **options)
    text = F.nullif(F.col("_g.text"), F.lit(""))
    return done.withColumn(out, strip(F.coalesce(text, F.lit(EMPTY_REPORT)))).drop("_g")


def unsuccessful(generations: DataFrame) -> DataFrame:
    """Rows to try again: every status but success, null included."""
    return generations.where(~F.col("status").eqNullSafe(F.lit(SUCCESS)))


def upsert(old: DataFrame, retried: DataFrame, keys: list[str], columns: list[str] | None = None, attempt: str | None = None) -> DataFrame:
    """Retried rows over old ones; a retry that ended rate-limited (null status) changes nothing.

    Of several retries of a key one counts: the last by ``attempt`` (any order, null first), then a
    success before a failure, then the greatest hash. Old rows stay as many as they are.
    """
    columns = columns or [c for c in METRIC_NAMES if c in old.columns]
    order = F.struct(*([attempt] if attempt else []), F.col("status") == SUCCESS, F.xxhash64(*columns))
    new = retried.where(F.col("status").isNotNull() & ~_rate_limited(F.col("status"))).groupBy(*keys).agg(
        F.lit(True).alias("_new"), F.max_by(F.struct(*columns), order).alias("_last"))
    pick = lambda c: F.when(F.col("_new"), F.col(f"_last.{c}")).otherwise(F.col(c)).alias(c)
    rest = [c for c in old.columns if c not in keys and c not in columns]
    return old.join(new, keys, "left").select(*keys, *rest, *[pick(c) for c in columns])


def _rate_limited(status: Column) -> Column:
    return (status != SUCCESS) & status.contains(RATE_LIMIT_MARK)
