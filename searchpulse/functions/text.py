"""Tokenising in plain SQL expressions, equal to the ML tokenizer's output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased tokens split on single whitespace characters, empty ones dropped."""
    return F.array_remove(F.split(F.lower(text), r"\s"), "")


def without_stop_words(words: Column, stop_words: list[str]) -> Column:
    """Drop stop words but keep order and repeats (``array_except`` would remove repeats)."""
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(words, lambda w: ~F.array_contains(stops, w))


def normalised_label(label: Column) -> Column:
    """Trimmed, lower-cased label; a missing one becomes ``other``."""
    return F.coalesce(F.lower(F.trim(label)), F.lit("other"))
