"""Cleanup of metadata tables: names, keys, flags, tolerant parsing, first and last rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: German column names of overview files and their English ones.
OVERVIEW_COLUMNS = {
    "AufnahmeID": "recording_id",
    "AufnahmeTyp": "recording_type",
    "AufnahmeDatum": "recording_date",
    "Diagnose": "diagnosis_de",
    "SprecherID": "speaker_id",
    "Geburtsdatum": "birth_date",
    "Geschlecht": "sex",
    "Pathologien": "pathologies_de",
}
#: German class names, in composed Unicode, and their English ones.
PATHOLOGIES = {
    "healthy": "healthy",
    "Morbus Parkinson": "parkinson's disease",
    "Phonationsknötchen": "vocal fold nodules",
    "Reinke Ödem": "reinke's edema",
    "Rekurrensparese": "recurrent laryngeal nerve paralysis",
    "Spasmodische Dysphonie": "spasmodic dysphonia",
    "Stimmlippenpolyp": "vocal fold polyp",
    "Hyperfunktionelle Dysphonie": "hyperfunctional dysphonia",
    "Funktionelle Dysphonie": "functional dysphonia",
    "Psychogene Dysphonie": "psychogenic dysphonia",
    "Hypotone Dysphonie": "hypotonic dysphonia",
    "Laryngitis": "laryngitis",
}
ACCEPTED_TRUE = ("1", "true")


def composed(column: Column | str) -> Column:
    """Text with a, o and u and a combining diaeresis written as one letter, as in PATHOLOGIES."""
    column = F.col(column) if isinstance(column, str) else column
    for plain, letter in zip("aouAOU", "äöüÄÖÜ", strict=True):
        column = F.replace(column, F.lit(plain + "\u0308"), F.lit(letter))
    return column


def english(column: Column | str) -> Column:
    """A class name in English; one that isn't known stays."""
    return mapped(composed(column), PATHOLOGIES)


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def blank_to_null(column: Column | str) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(column), F.lit(""))


def nan_to_null(column: Column | str) -> Column:
    return F.nanvl(F.col(column) if isinstance(column, str) else column, F.lit(None).cast("double"))


def composite_key(*parts: Column | str) -> Column:
    return F.concat_ws("::", *parts)


def sample_token(stem: Column | str, recording_id: Column | str) -> Column:
    """The stem without the leading id and hyphen, if it has them."""
    stem = F.col(stem) if isinstance(stem, str) else stem
    prefix = F.concat(recording_id if isinstance(recording_id, Column) else F.col(recording_id), F.lit("-"))
    return F.when(F.startswith(stem, prefix), F.substr(stem, F.length(prefix) + 1)).otherwise(stem)


def mapped(column: Column | str, names: Mapping[str, str], default: Column | None = None) -> Column:
    """Looked up in a small literal map; what isn't there becomes the default, or stays as it is."""
    column = F.col(column) if isinstance(column, str) else column
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.element_at(pairs, column), column if default is None else default)


def as_flag(column: Column | str) -> Column:
    return F.coalesce(F.lower(F.col(column).cast("string") if isinstance(column, str) else column).isin(*ACCEPTED_TRUE), F.lit(False))


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in a total order; reversed orders keep the last."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("first_rank", rank).where("first_rank = 1").drop("first_rank")


def overlap_flag(df: DataFrame, ident: str, group: str, name: str) -> DataFrame:
    """Whether a non-blank id is in more than one group, over the whole table: never over an increment alone."""
    many = df.where(blank_to_null(F.col(ident).cast("string")).isNotNull()).groupBy(ident).agg((F.countDistinct(group) > 1).alias(name))
    return df.join(many, ident, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def years_between(later: Column, earlier: Column) -> Column:
    """Whole elapsed days over 365.25, one decimal, halves to even."""
    days = F.floor((later.cast("timestamp").cast("double") - earlier.cast("timestamp").cast("double")) / 86400)
    return F.bround(days / F.lit(365.25), 1)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
