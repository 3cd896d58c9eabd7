"""Quality rules: compression bands over whole texts and fixed chunks, beside plain text counts.

zstandard's ratio (compressed bytes / bytes) is low for repetitive text, listings and symbols strewn between words, and near 1
for text without structure (encoded data, keys). What is normal depends on the length, since a short
text leaves the compressor little to refer back to, and on the corpus. So the limits are a function of the length,
fitted to the corpus: of all texts that pass the base rule, an exact histogram by length class (a quarter of an octave) and
ratio is counted; a smooth curve through the classes' medians is the normal ratio, another through their
quartile ranges the normal spread. Classes count alike, whether a few hundred or a billion texts fall in them, so one
huge group of copies moves its own class only; where there are few texts, the curves lean to those of ordinary prose.

A text must lie inside the band of its length, ``low`` spreads below the curve to ``high`` above, and no more than
``max_bad`` of its bytes may be in chunks outside the band of theirs, which finds a repetitive
or encoded stretch in a text whose overall ratio looks normal. Chunks have a fixed size; a rest under a quarter
of it belongs to the last one.

Defined results: null text counts as empty and has no words, hence fails the base rule; the rows are
independent given the limits, so ties and repeated rows get equal results; an empty table gives an empty result; only
the id and text columns are read. Whole texts are read, one Arrow batch in memory at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import map_rows, materialise, quoted

SYMBOLS = b"#*$%&|<>"
STEPS = 4  # length classes in an octave


@dataclass(frozen=True)
class Rules:
    """Widths of the bands in spreads, the chunks, and what the curves are where there are no texts.

    The curves are polynomials in log2(bytes / 1024), of the logarithm of the normal ratio and of its relative spread."""

    low: float = 3.5
    high: float = 5.0
    max_bad: float = 0.25
    chunk_bytes: int = 1024
    level: int = 3
    prose: tuple[float, ...] = (-0.6, -0.1, 0.01, 0.0)
    spread: tuple[float, ...] = (-3.5, -0.3, 0.0)
    least_spread: float = 0.012
    most_spread: float = 0.06
    #: Texts at which a class counts half, and the weight of the curves of prose against a class.
    half: int = 50
    lean: float = 0.05


@dataclass(frozen=True)
class Limits:
    """The fitted curves, and the lengths between which they hold (in log2(bytes / 1024))."""

    normal: tuple[float, ...]
    spread: tuple[float, ...]
    shortest: float
    longest: float
    rules: Rules

    def score(self, size: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """How many spreads each ratio lies above the curve."""
        at = np.clip(np.log2(np.maximum(size, 1)) - 10, self.shortest, self.longest)
        normal, spread = (sum(c * at**k for k, c in enumerate(curve)) for curve in (self.normal, self.spread))
        return (np.log(np.maximum(packed, 1) / np.maximum(size, 1)) - normal) / np.clip(np.exp(spread), self.rules.least_spread, self.rules.most_spread)

    def outside(self, size: np.ndarray, packed: np.ndarray) -> np.ndarray:
        z = self.score(size, packed)
        return (z < -self.rules.low) | (z > self.rules.high)


def fit_limits(histogram: Iterable[tuple[int, int, int]], rules: Rules) -> Limits:
    """From (length class, ratio in thousandths, texts)."""
    by_class: dict[int, list[tuple[int, int]]] = {}
    for c, r, n in histogram:
        by_class.setdefault(c, []).append((r, n))
    at, weight, middle, spread = [], [], [], []
    for c, found in sorted(by_class.items()):
        r, n = np.array(sorted(found), np.float64).T
        share = (np.cumsum(n) - n / 2) / n.sum()
        low, mid, high = np.log(np.interp([0.25, 0.5, 0.75], share, np.maximum(r, 1) / 1000))
        at.append((c + 0.5) / STEPS - 10)
        weight.append(n.sum() / (n.sum() + rules.half))
        middle.append(mid)
        spread.append(np.log(max((high - low) / 1.349, rules.least_spread / 2)))

    def curve(y: list[float], prior: tuple[float, ...]) -> tuple[float, ...]:
        powers = np.array([[x**k for k in range(len(prior))] for x in at]).reshape(-1, len(prior))
        w = np.array(weight)[:, None]
        return tuple(np.linalg.solve((powers * w).T @ powers + rules.lean * np.eye(len(prior)), (powers * w).T @ np.array(y) + rules.lean * np.array(prior)).tolist())

    return Limits(curve(middle, rules.prose), curve(spread, rules.spread), min([-3.0, *at]), max([3.0, *at]), rules)


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() breaks at exactly \x20 and \x09-\x0D
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0  # first word that no repeated window has covered yet
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def chunk_sizes(n: int, chunk: int) -> list[int]:
    """Bytes of each chunk of a text of ``n`` bytes."""
    full, rest = divmod(n, chunk)
    if full and rest < chunk // 4:
        return [chunk] * (full - 1) + [chunk + rest]
    return [chunk] * full + [rest] * (rest > 0)


def packed_sizes(packer: zstandard.ZstdCompressor, raw: bytes, chunk: int) -> list[int]:
    """Compressed bytes of the whole text, then of each chunk."""
    found, at = [len(packer.compress(raw))], 0
    for n in chunk_sizes(len(raw), chunk):
        found.append(len(packer.compress(raw[at : at + n])) if n < len(raw) else found[0])
        at += n
    return found


GAUGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, bytes long, packed array<long>, length_class int, ratio_bin int"


def gauge(text: str | None, packer: zstandard.ZstdCompressor, rules: Rules) -> tuple:
    """The columns of GAUGED after the id."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    found = counts(text)
    failed = found[0] < 50 or 100 * found[4] > 50 * found[0]
    packed = packed_sizes(packer, raw, rules.chunk_bytes)
    return *found, failed, len(raw), packed, int(np.floor(np.log2(max(1, len(raw))) * STEPS)), round(1000 * packed[0] / max(1, len(raw)))


def verdict(failed: bool, size: int, packed: list[int], limits: Limits) -> tuple[bool, int]:
    """Whether the text is kept, and how many of its chunks lie outside their band."""
    sizes = np.array([size, *chunk_sizes(size, limits.rules.chunk_bytes)])
    outside = limits.outside(sizes, np.array(packed))
    bad = outside[1:]
    return bool(not failed and not outside[0] and sizes[1:][bad].sum() <= limits.rules.max_bad * size), int(bad.sum())


def limits_of(gauged: DataFrame, rules: Rules) -> Limits:
    """From all texts that pass the base rule; at most some hundred classes by some thousand ratios reach the driver."""
    found = gauged.where("not base_failed").groupBy("length_class", "ratio_bin").agg(F.count(F.lit(1)).alias("n")).collect()
    return fit_limits([tuple(r) for r in found], rules)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """One row per document with its counts, ratio and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=rules.level)
        for batch in batches:
            rows = [gauge(x.as_py(), packer, rules) for x in batch.column(1)]
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=[x.split()[0] for x in GAUGED.split(", ")])

    gauged = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, GAUGED), "gauged")
    limits = limits_of(gauged, rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 3
            found = [verdict(*row, limits) for row in zip(*(c.to_pylist() for c in batch.columns[n:]), strict=True)]
            chunks = pa.array([len(x) - 1 for x in batch.column(n + 2).to_pylist()], pa.int64())
            ratio = pa.array([x[0] / max(1, b) for x, b in zip(batch.column(n + 2).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)], pa.float64())
            more = [pa.array([k for k, _ in found], pa.bool_()), ratio, chunks, pa.array([b for _, b in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], *more], names=[*batch.schema.names[: n + 1], "kept", "zstd_ratio", "n_chunks", "n_bad_chunks"])

    counted = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    return gauged.select(*[x.split()[0] for x in counted.split(", ")], "bytes", "packed").mapInArrow(judge, counted + ", kept boolean, zstd_ratio double, n_chunks long, n_bad_chunks long")


def keep_good(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """``docs`` without what the rules reject, all columns and repeated rows kept. Texts are read twice: for the limits, then judged."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = zstandard.ZstdCompressor(level=rules.level), Counter()
        for batch in batches:
            for x in batch.column(0):
                text = x.as_py() or ""
                raw, (n, *_, repeated) = text.encode("utf-8", "surrogatepass"), counts(text)
                if n >= 50 and 100 * repeated <= 50 * n:
                    seen[int(np.floor(np.log2(len(raw)) * STEPS)), round(1000 * len(packer.compress(raw)) / len(raw))] += 1
        rows = [(*k, n) for k, n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["c", "r", "n"])

    found = docs.select(F.col(quoted(text_col)).alias("text")).mapInArrow(tally, "c long, r long, n long").groupBy("c", "r").agg(F.sum("n").alias("n")).collect()
    limits, at = fit_limits([tuple(r) for r in found], rules), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=rules.level)
        for batch in batches:
            gauged = [gauge(x.as_py(), packer, rules) for x in batch.column(at)]
            yield batch.filter(pa.array([verdict(*g[5:8], limits)[0] for g in gauged], pa.bool_()))

    return map_rows(docs, run)
