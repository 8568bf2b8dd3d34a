"""Process records assembled from card pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edictal.functions.classify import matches
from edictal.functions.extract import integer
from edictal.functions.text import fold, found

# Stages whose own dates are the application term.
APPLICATION = r"bases y apertura|apertura de plazo|solicitudes|ampliacion del? plazo|convocatoria"


def assemble_process(cards: DataFrame) -> DataFrame:
    """Application term and year of a card: the dates of the current stage when it takes
    applications, else those read from its past application stages, else none.

    ``cards``: title, stage, opens, closes (of the current stage), term_opens, term_closes, bulletin_date.
    """
    staged = cards.withColumn("application", matches(fold(F.coalesce("stage", F.lit(""))), APPLICATION))
    own = F.col("application")
    year = integer(found(F.lower("title"), r"\b(?:convocatoria\s+)?\d+/(\d{2})\b"))
    return staged.withColumns(
        {
            "opens": F.when(own, F.col("opens")).otherwise(F.col("term_opens")),
            "closes": F.when(own, F.col("closes")).otherwise(F.col("term_closes")),
            "year": F.coalesce(year + 2000, F.year("bulletin_date")),
        }
    )


def head_of(text) -> object:
    """Part of a card text above its basic information."""
    return F.split_part(F.split_part(text, F.lit("Información básica"), F.lit(1)), F.lit("Informació bàsica"), F.lit(1))


