"""Cleaning of scraped text. Unicode forms and entities have no Spark function, so that step is an Arrow batch in Python."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TAG = re.compile("<[^>]*>")


@F.pandas_udf(StringType())
def visible(text: pd.Series) -> pd.Series:
    """NFKC, tags as blanks, entities decoded; null becomes empty."""
    return text.map(lambda t: html.unescape(TAG.sub(" ", unicodedata.normalize("NFKC", t or ""))))


def flat_map(value: Column) -> Column:
    """'key. value' of each entry; null becomes empty."""
    return F.coalesce(F.array_join(F.transform(F.map_entries(value), lambda e: F.concat(e["key"], F.lit(". "), e["value"].cast("string"))), " "), F.lit(""))


def flat_list(value: Column) -> Column:
    return F.coalesce(F.array_join(value.cast("array<string>"), " "), F.lit(""))


def clean(text: Column) -> Column:
    """Visible text without zero-width spaces and without characters outside the allowed classes."""
    return F.regexp_replace(F.replace(visible(text), F.lit("\u200b"), F.lit("")), r"[^\p{L}\p{N}_\s,.!?;:\-À-ɏḀ-ỿ\n]", "")
