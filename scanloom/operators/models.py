"""Rules around language models. A model is a function of a text that the caller passes in; its failure never ends a job."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

Model = Callable[[str], str | None]

# Characters that a model is shown, by purpose; the shortest text that is translated; the text without a model.
SAMPLES = {"language": 850, "entities": 100_000, "ocr_language": 500, "field_class": 200}
LEAST_TRANSLATED = 3
NO_MODEL = "Analiza niedostępna - Gemini nie skonfigurowany"


def sample(text: Column, purpose: str) -> Column:
    return F.substring(text, 1, SAMPLES[purpose])


def asked(text: Column, model: Model, on_error: str | None = None) -> Column:
    """The model's answer without white space around it; on_error where it fails; null texts are not asked about."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            answer = model(t)
            return None if answer is None else answer.strip()
        except Exception:
            return on_error

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action=None).astype(object)

    return ask(text)


def field_class(value: Column, model: Model | None = None) -> Column:
    """Curation's class by patterns; where none fits the model's on a sample of the value, Unknown without model or if it fails."""
    known = T.field_type(value, default=None)
    if model is None:
        return F.coalesce(known, F.lit("Unknown"))
    return F.coalesce(known, asked(F.when(known.isNull(), sample(value, "field_class")), model, "Unknown"))


def translated(text: Column, model: Model) -> Column:
    """Texts of fewer than three characters as they are, others as the model has them, or as they are where it fails."""
    long = F.length(text) >= LEAST_TRANSLATED
    return F.coalesce(asked(F.when(long, text), model), text)


def summaries(rows: DataFrame, model: Model | None, prompt_col: str = "prompt", text_col: str = "text") -> DataFrame:
    """rows with summary: without stars; null for blank texts, empty answers and failures; a fixed text without a model."""
    if model is None:
        return rows.withColumn("summary", F.lit(NO_MODEL))
    some = F.coalesce(T.strip(F.col(text_col)), F.lit("")) != ""
    answer = F.nullif(asked(F.when(some, F.col(prompt_col)), model), F.lit(""))
    return rows.withColumn("summary", T.without_stars(answer))
