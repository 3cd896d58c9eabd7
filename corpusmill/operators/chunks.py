"""Document chunking: paragraphs, long ones split at sentences, packed greedily up to a number of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import let, space_words, strip_spaces

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def _greedy(parts: Column, most: int, joiner: str) -> Column:
    """Neighbouring parts joined while their words fit; the words of each part are counted once."""
    counted = F.transform(parts, lambda p: F.struct(p.alias("text"), F.size(space_words(p)).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        full = acc["held"].isNotNull() & (acc["n"] + p["n"] > most)
        begin = F.struct(F.when(acc["held"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["held"]))).alias("done"), p["text"].alias("held"), p["n"].alias("n"))
        grown = F.struct(acc["done"].alias("done"), F.concat(acc["held"], F.lit(joiner), p["text"]).alias("held"), (acc["n"] + p["n"]).alias("n"))
        return F.when(full | acc["held"].isNull(), begin).otherwise(grown)

    return F.aggregate(counted, start, step, lambda acc: F.when(acc["held"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["held"]))))


def _pieces(paragraph: Column, most: int) -> Column:
    """A paragraph as pieces: whole, at sentences, or every ``most`` words if it is one long sentence."""

    def of(words: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(words), F.lit(1)) - 1) / most)), lambda i: F.array_join(F.slice(words, (i * most + 1).cast("int"), F.lit(most)), " "))
        sentences = F.split(paragraph, f"(?<=[.!?]){SPACE}+")
        return F.when(F.size(words) <= most, F.array(paragraph)).when(F.size(sentences) <= 1, cuts).otherwise(_greedy(sentences, most, " "))

    return let(space_words(paragraph), of)


def chunk_text(text: Column, most: int = 180) -> Column:
    """Array of chunks; chunk ids are their places, from 0."""
    stripped = F.transform(F.split(strip_spaces(text), rf"\n{SPACE}*\n+"), strip_spaces)
    paragraphs = F.filter(stripped, lambda p: p != "")
    return _greedy(F.flatten(F.transform(paragraphs, lambda p: _pieces(p, most))), most, "\n")
