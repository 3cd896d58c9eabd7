"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. A trigram abc is bound to  shift2(A) * shift1(B) * C  (shift
permutes a vector's places), a text is the bundle (sum) of its trigrams' vectors, and a language's
prototype is the bundle of all its training texts. A text gets the language whose prototype has the
largest cosine with it. Trigrams are taken within words, with one space before and after each.

Letters are lower-cased; a-z and the space have a symbol each, all other letters share 101
symbols by code point. So a text is counts over 128^3 trigrams at most, summed as
sum over (a,b) of shift2(A)*shift1(B) * (sum over c of count(a,b,c) * C): two small matrix products.

Learning is a sum of integer vectors, so it does not depend on order or partitioning: each Arrow
batch bundles its texts by language, and Spark adds the vectors place by place. What reaches the
driver is one vector per language. Languages that share a vector base differ from one another only in
part; prototypes are therefore centred on their mean before comparison.

Defined results: null text, or text without a letter, gets ``und`` and score 0; without any training
row all texts get ``und``; rows with null lang are predicted but never learned from; a tie goes to the
first language by name; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = 128


def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for a non-letter, 1-26 for a-z, 27-127 for other letters."""
    found = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or not chr(c).isalpha():
            continue
        low = chr(c).lower()
        k = ord(low[0])
        found[c] = k - 96 if 97 <= k <= 122 else 27 + k % 101
    return found


class Space:
    """The letter vectors and what is derived from them."""

    def __init__(self, dimensions: int, seed: int) -> None:
        letters = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (SYMBOLS, dimensions)).astype(np.float32) * 2 - 1
        self.letters, self.symbols = letters, symbol_table()
        self.first, self.second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of a text (as numbers in base SYMBOLS) and their counts."""
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        s = np.concatenate([[0], self.symbols[raw], [0]]).astype(np.int64)
        keep = (s[:-2] | s[1:-1] | s[2:] != 0) & (s[1:-1] != 0)  # the middle is a letter
        return np.unique((s[:-2] * SYMBOLS + s[1:-1])[keep] * SYMBOLS + s[2:][keep], return_counts=True)

    def bundle(self, trigrams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        pairs, row = np.unique(trigrams // SYMBOLS, return_inverse=True)
        table = np.zeros((len(pairs), SYMBOLS), np.float32)
        table[row, trigrams % SYMBOLS] = counts
        used = np.flatnonzero(table.any(axis=0))
        inner = table[:, used] @ self.letters[used]
        return np.einsum("ij,ij,ij->j", self.first[pairs // SYMBOLS], self.second[pairs % SYMBOLS], inner)


_spaces: dict[tuple[int, int], Space] = {}


def space(dimensions: int, seed: int) -> Space:
    if (dimensions, seed) not in _spaces:
        _spaces[dimensions, seed] = Space(dimensions, seed)
    return _spaces[dimensions, seed]


def held_out(doc_id: int | None, folds: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def learn(docs: DataFrame, dimensions: int = 512, seed: int = 7, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Prototype vector of each language of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = space(dimensions, seed)
        for batch in batches:
            seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen.setdefault(lang, []).append(here.trigrams(text.as_py()))
            for lang, parts in seen.items():
                at, row = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
                total = np.bincount(row, np.concatenate([c for _, c in parts]), len(at)).astype(np.int64)
                vector = np.zeros(dimensions, np.int64)  # integers add exactly, in any order
                for i in range(0, len(at), 512):
                    a, bc = at[i : i + 512] // SYMBOLS**2, at[i : i + 512] % SYMBOLS**2
                    bound = here.first[a] * here.second[bc // SYMBOLS] * here.letters[bc % SYMBOLS]
                    vector += (bound.astype(np.int64) * total[i : i + 512, None]).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(vector)], names=["lang", "place", "value"])

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sums = known.mapInArrow(run, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():  # ``dimensions`` rows for each language
        found.setdefault(r["lang"], np.zeros(dimensions))[r["place"]] = r["value"]
    return dict(sorted(found.items()))


def identify(docs: DataFrame, folds: int = 5, dimensions: int = 512, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, after learning from the documents that are not held out."""
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
    prototypes = learn(docs.where(~held), dimensions, seed, lang_col, text_col)
    names = list(prototypes)
    matrix = np.array([prototypes[n] / max(1.0, np.linalg.norm(prototypes[n])) for n in names]).reshape(-1, dimensions)
    centred = matrix - matrix.mean(axis=0) if len(names) > 1 else matrix
    lengths = np.linalg.norm(centred, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = space(dimensions, seed)
        mean = matrix.mean(axis=0) if len(names) > 1 else np.zeros(dimensions)
        for batch in batches:
            found = []
            for text in batch.column(1):
                trigrams, counts = here.trigrams(text.as_py() or "")
                best, score = "und", 0.0
                if len(trigrams) and names:
                    vector = here.bundle(trigrams, counts).astype(np.float64)
                    vector /= np.linalg.norm(vector) or 1.0
                    vector -= mean
                    cosines = centred @ vector / np.maximum(1e-12, lengths * np.linalg.norm(vector))
                    k = int(np.argmax(cosines))
                    best, score = names[k], float(min(1.0, max(0.0, cosines[k])))
                found.append((best, score))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
