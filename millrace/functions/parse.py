"""Provenance strings, identifiers and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of source files and partition names.
SOURCE = r"^([A-Z0-9]+)\.(\d+)\.(\d+)$"
CONFIG = r"^(.*)_([a-z]{3})$"


def parse_source(source: Column) -> dict[str, Column]:
    """book, chapter, version; a value of another form is its own book, chapter -1, version ''."""
    source = F.coalesce(source, F.lit(""))
    fits = source.rlike(SOURCE)
    return {
        "book": F.when(fits, F.regexp_extract(source, SOURCE, 1)).otherwise(source),
        "chapter": F.when(fits, F.regexp_extract(source, SOURCE, 2).try_cast("int")).otherwise(-1),
        "version": F.when(fits, F.regexp_extract(source, SOURCE, 3)).otherwise(""),
    }


def parse_config(config: Column) -> dict[str, Column]:
    fits = config.rlike(CONFIG)
    return {
        "language": F.when(fits, F.regexp_extract(config, CONFIG, 1)).otherwise(config),
        "iso": F.when(fits, F.regexp_extract(config, CONFIG, 2)).otherwise(""),
    }


def iso_of(config: Column) -> Column:
    return F.substring_index(config, "_", -1)


def pretty(config: Column) -> Column:
    """'Some_Name_iso' as 'Some Name (iso)'; without an underscore the name part is empty."""
    name = F.regexp_replace(F.regexp_extract(config, r"^(.*)_[^_]*$", 1), "_", " ")
    return F.concat(name, F.lit(" ("), iso_of(config), F.lit(")"))


def duration_of(milliseconds: Column, audio_bytes: Column, header: int = 44, bytes_per_second: float = 32000.0) -> Column:
    """Seconds from a millisecond string, else from the size of 16-bit mono audio."""
    given = milliseconds.try_cast("double") / 1000
    return F.coalesce(given, F.greatest(audio_bytes - header, F.lit(0)) / F.lit(bytes_per_second))
