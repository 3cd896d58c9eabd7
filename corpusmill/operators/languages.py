"""The language dimension and the grid of generation requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from corpusmill.functions.text import hash01

# Code, English name, own name, resource tier.
LANGUAGES = [
    ("eng", "English", "English", "high"),
    ("yor", "Yoruba", "Yorùbá", "medium"),
    ("hau", "Hausa", "Hausa", "medium"),
    ("ibo", "Igbo", "Igbo", "medium"),
    ("efi", "Efik", "Efịk", "low"),
    ("urh", "Urhobo", "Urhobo", "low"),
    ("twi", "Twi", "Twi", "medium"),
    ("fon", "Fon", "Fɔ̀ngbè", "low"),
    ("pcm", "Nigerian Pidgin", "Naija", "high"),
    ("ewe", "Ewe", "Èʋegbe", "low"),
    ("aka", "Akan", "Akan", "medium"),
    ("ful", "Fulah", "Pulaar/Fulfulde", "low"),
    ("fuv", "Fulfulde", "Fulfulde", "low"),
]


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "code string, english_name string, endonym string, resource_tier string")


def grid(spark: SparkSession, per_language: int) -> DataFrame:
    """Every language with every index below ``per_language``."""
    return dimension(spark).crossJoin(spark.range(per_language).withColumnRenamed("id", "i"))


def hard_case(seed: Column, code: Column, index: Column, share: float = 0.2) -> Column:
    return hash01(seed, code, index.cast("string")) < share
