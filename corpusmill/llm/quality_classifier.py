"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every whole text. A text's votes are one of
3^L patterns; the counts of patterns over all texts are all that expectation-maximisation needs. It
estimates, for both hidden classes, how often each labeller votes bad, and the posterior of every pattern. A hashed linear scorer (byte trigrams in 2^16 buckets, square-root counts of unit
length) is then trained by logistic regression on the posterior labels of about ``sample`` texts, chosen by a
hash of their id and text. Their features are computed where the texts are; in the order of that hash, as many as hold
``sample_features`` features in all reach the driver (each takes 8 bytes, some 50 MB for 10,000 ordinary texts): both bounds are parameters. Every whole text is scored.

Defined results: null text counts as empty: its labellers abstain or vote as on empty text; a null id
hashes as the empty string; repeated rows get equal results and count once in the sample; an empty table gives an empty result; other columns
are not read. Ties (score exactly 0.5) are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Workspace

BUCKETS = 1 << 16
LABELLERS = ("length", "symbols", "capitals", "lines", "windows", "word_length", "sentences", "shouting", "clean_words")
GOOD, ABSTAIN, BAD = 2, 1, 0
#: Bytes of plain words: letters (and all of other scripts), and the punctuation that goes with them.
PLAIN = bytes(b for b in range(256) if b >= 128 or chr(b).isalpha() or chr(b) in "'\"-.,;:!?()")


def band(value: float, good: tuple[float, float], fair: tuple[float, float]) -> int:
    """Good inside the first interval, abstain inside the second, else bad."""
    return GOOD if good[0] <= value <= good[1] else ABSTAIN if fair[0] <= value <= fair[1] else BAD


def votes(text: str | None) -> tuple[int, ...]:
    """The vote of each labeller, in the order of LABELLERS."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if n < 5:
        return (ABSTAIN if n else BAD, *[ABSTAIN] * (len(LABELLERS) - 1))
    letters = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    return (
        band(n, (20, 1e18), (5, 1e18)),
        band(symbols / n, (0, 0.02), (0, 0.10)),
        band(capitals / max(1, letters), (0, 0.15), (0, 0.30)),
        ABSTAIN if len(lines) < 3 else band(1 - len(set(lines)) / len(lines), (0, 0.10), (0, 0.30)),
        band(1 - len(set(windows)) / len(windows), (0, 0.10), (0, 0.30)),
        band(len(text) / n, (3, 11), (2, 14)),
        ABSTAIN if n < 30 else band(sum(w[-1] in b".!?" for w in words) / n, (0.02, 0.35), (0.005, 0.5)),
        band(raw.count(b"!") / n, (0, 0.02), (0, 0.10)),
        band(len(raw.translate(None, PLAIN).split()) / n, (0, 0.10), (0, 0.30)),
    )


def pattern(found: tuple[int, ...]) -> int:
    return sum(v * 3**k for k, v in enumerate(found))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM: (posterior of good for each of all patterns, chance of a bad vote [class, labeller], share of good).

    Bad texts are bad in different ways, so a labeller that sees nothing wrong says little; only how often it
    votes bad in either class counts: its hit rate in class 0 and its false alarms in class 1.
    """
    every = np.arange(3 ** len(LABELLERS))
    fires = every[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 == BAD
    seen = fires[patterns]
    good = np.array([0.95, 0.3, 0.05])[np.minimum(2, seen.sum(axis=1))]
    chance, share = np.zeros((2, len(LABELLERS))), 0.5
    for _ in range(rounds):
        before = good
        for k, belief in enumerate((1 - good, good)):
            weight = belief * counts
            chance[k] = (weight @ seen + 0.5) / (weight.sum() + 1.0)
        share = float((good * counts).sum() / counts.sum())
        good = posterior(seen, chance, share)
        if np.abs(good - before).max() < 1e-9:
            break
    return posterior(fires, chance, share), chance, share


def posterior(fires: np.ndarray, chance: np.ndarray, share: float) -> np.ndarray:
    logs = fires @ np.log(chance).T + ~fires @ np.log(1 - chance).T + np.log([1 - share + 1e-12, share + 1e-12])
    return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text's byte trigrams."""
    raw = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    code = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)
    buckets, n = np.unique(code >> np.uint32(16), return_counts=True)
    weights = np.sqrt(n.astype(np.float32))
    return buckets.astype(np.int32), weights / np.linalg.norm(weights)


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 200, rate: float = 4.0, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression with soft targets by full-batch gradient descent with momentum."""
    w, bias = np.zeros(BUCKETS), 0.0
    if not len(rows):
        return w, bias
    at = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    buckets, values = np.concatenate([b for b, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float64)
    speed, push = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        guess = 1 / (1 + np.exp(-np.clip(np.bincount(at, values * w[buckets], len(rows)) + bias, -30, 30)))
        error = guess - target
        speed = 0.9 * speed - rate * (np.bincount(buckets, values * error[at], BUCKETS) / len(rows) + ridge * w)
        push = 0.9 * push - rate * error.mean()
        w, bias = w + speed, bias + push
    return w, bias


def classify(docs: DataFrame, sample: int = 10_000, sample_features: int = 20_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, weak_label (posterior of the votes), score and kept for every text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(x.as_py())) for x in batch.column(0)], pa.int32())], names=["pattern"])

    seen = rows.select("text").mapInArrow(vote, "pattern int").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).toArrow()
    if not len(seen):
        good = np.full(3 ** len(LABELLERS), 0.5)
    else:
        good, _, _ = estimate(seen["pattern"].to_numpy(), seen["n"].to_numpy().astype(np.float64))
    total = int(seen["n"].to_numpy().sum()) if len(seen) else 0

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            found = [features(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(b) for b, _ in found], pa.int64()), pa.array([b for b, _ in found], pa.list_(pa.int32())),
                    pa.array([w for _, w in found], pa.list_(pa.float32())), pa.array([good[pattern(votes(t))] for t in texts], pa.float64()),
                ],
                names=["key", "size", "buckets", "weights", "target"],
            )

    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    chosen = F.pmod(key, F.lit(1 << 20)) < int(min(1.0, sample / max(1, total)) * (1 << 20))
    drawn = rows.select(key.alias("key"), "text").where(chosen.cast("boolean")).dropDuplicates(["key"])
    space = Workspace(docs.sparkSession, "classifier")
    found = space.table(drawn.mapInArrow(featurise, "key long, size long, buckets array<int>, weights array<float>, target double"), "features")
    sizes = found.select("key", "size").orderBy("key").limit(2 * sample).toArrow()
    fits = np.flatnonzero(np.cumsum(sizes["size"].to_numpy()) <= sample_features)
    last = sizes["key"][int(fits[-1])].as_py() if len(fits) else -(1 << 63)
    taken = found.where(F.col("key") <= last).orderBy("key").toArrow()
    pairs = [(b.values.to_numpy(), w.values.to_numpy()) for b, w in zip(taken["buckets"], taken["weights"], strict=True) if len(b)]
    target = np.array([t for b, t in zip(taken["buckets"], taken["target"].to_numpy(), strict=True) if len(b)])
    space.close()
    w, bias = train(pairs, target)
    w = w.astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weak, found = [], []
            for x in batch.column(1):
                text = x.as_py()
                buckets, weights = features(text)
                weak.append(float(good[pattern(votes(text))]))
                found.append(1 / (1 + np.exp(-np.clip(float(weights @ w[buckets]) + bias, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak), pa.array(found, pa.float64()), pa.array([s >= 0.5 for s in found], pa.bool_())], names=["doc_id", "weak_label", "score", "kept"])

    return rows.mapInArrow(score, "doc_id long, weak_label double, score double, kept boolean")
