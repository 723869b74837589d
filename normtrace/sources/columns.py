"""Column plumbing of wide model tables: discovery, long form, renames, attaching, row picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the wide tables, metric stem + model suffix.
TEXT_PREFIX = "texte_reformule_"
EXTRACTION_SUFFIX = "_extr_llama_3_3_70b"
WIDE_TO_LONG = {
    "texte_reformule": "text",
    "latence_secondes": "latency_s",
    "prompt_tokens": "prompt_tokens",
    "completion_tokens": "completion_tokens",
    "total_tokens": "total_tokens",
    "finish_reason": "finish_reason",
    "statut": "status",
}


def text_columns(columns: list[str], prefix: str = TEXT_PREFIX, suffix: str = EXTRACTION_SUFFIX) -> dict[str, str]:
    """``{model: text column}`` for every text column whose extraction column is there too."""
    found = [c for c in columns if c.startswith(prefix) and not c.endswith(suffix)]
    if not found:
        raise ValueError(f"no column starts with {prefix!r}")
    lacking = [c for c in found if c + suffix not in columns]
    if len(lacking) == len(found):
        raise ValueError(f"no extraction column {lacking[0] + suffix!r}")
    return {c[len(prefix):]: c for c in found if c + suffix in columns}


def long_extractions(wide: DataFrame, keys: list[str], prefix: str = TEXT_PREFIX,
                     suffix: str = EXTRACTION_SUFFIX) -> DataFrame:
    """``keys, model, text, extraction``: every model's pair of columns as a row, in one scan."""
    pairs = F.array(*[
        F.struct(F.lit(model).alias("model"), F.col(f"`{c}`").alias("text"),
                 F.col(f"`{c}{suffix}`").alias("extraction"))
        for model, c in text_columns(wide.columns, prefix, suffix).items()
    ])
    return wide.select(*keys, F.inline(pairs))


def long_generations(wide: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """``keys, model, text, latency_s, ..., status`` from metric columns with a model suffix.

    A model none of whose columns is there gives no rows; a single metric that is not there is null.
    """
    names, types = set(wide.columns), {f.name: f.dataType for f in wide.schema.fields}

    def kind(stem: str) -> T.DataType:
        present = [types[f"{stem}_{m}"] for m in models if f"{stem}_{m}" in names]
        return present[0] if present else T.StringType()

    rows = [
        F.struct(F.lit(model).alias("model"), *[
            (F.col(f"`{stem}_{model}`") if f"{stem}_{model}" in names else F.lit(None).cast(kind(stem))).alias(name)
            for stem, name in WIDE_TO_LONG.items()
        ])
        for model in dict.fromkeys(models) if f"statut_{model}" in names
    ]
    return wide.select(*keys, F.inline(F.array(*rows)))


def add_null_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in columns.items()})


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename by map; names that are not there are ignored."""
    return df.withColumnsRenamed(names)


def suffix_metrics(df: DataFrame, model: str) -> DataFrame:
    """Give the plain metric columns the suffix of their model."""
    return rename(df, {stem: f"{stem}_{model}" for stem in WIDE_TO_LONG})


def attach(df: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Put metric columns beside their rows, by key."""
    return df.join(metrics, keys, "left")


def first_row(df: DataFrame, order_by: list[str]) -> DataFrame:
    """The one row a single-document run would take."""
    return df.orderBy(*order_by).limit(1)
