"""Packing token sequences by best-fit decreasing.

A document's ids (with one closing id) are first cut into full windows; what remains, shorter than a
window, goes by decreasing length to the open window it fits most tightly. A segment tree indexed by
remaining capacity finds that window. Documents are packed in blocks as their partition streams by,
so nothing is shuffled, memory holds one block, and a lost task repeats only its own partition. A
block of thousands of documents leaves little padding; only its last few windows stay part empty.

A tokenizer whose file says that it drops white space, never joins across it, and splits and lower-cases as
WORD_SETTINGS has it, gives a text the ids of its words put together; then ids are cached by word in each Python worker,
in two generations of bounded size: when the young one is full it becomes the old one, so frequent words stay. Any
other tokenizer encodes whole texts.

Defined results: null text counts as empty and has the closing id alone; repeated rows are packed
each on their own, as pieces of equal doc_id; null ids stay null; an empty table gives an empty result; other
columns are not read. sequence_id numbers are unique, from the partition and a counter in it.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Bounds of a worker's cache: words in a generation, bytes in a word, bytes in a word of several pieces.
CACHE_WORDS = 500_000
CACHE_BYTES = 64
CACHE_JOINED = 8


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaves are capacities 0..size."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the smallest capacity that is at least ``need``, taken out of the tree."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each piece (length 1..size), and the number of windows."""
    window_of, offset_of = [0] * len(lengths), [0] * len(lengths)
    tree, made = OpenWindows(size), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take_tightest(lengths[i])
        if found is None:
            found, made = (size, made), made + 1
        capacity, window = found
        window_of[i], offset_of[i] = window, size - capacity
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], window)
    return window_of, offset_of, made


#: How the tokenizer splits lower-cased text before it merges (white space goes): fixed values.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What a tokenizer file must say for its texts to be taken word by word: fixed values.
WORD_SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
}
LATIN = 0x180  # below, each letter lower-cases on its own


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in the vocabulary: visible Latin-1 ones for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}


def word_by_word(path: str) -> bool:
    """Whether the file's settings are those of WORD_SETTINGS, its special tokens begin with ``<|`` and its merges are certain."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model = found["model"]
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and not model.get("continuing_subword_prefix")
    return plain and all(found.get(k) == v for k, v in WORD_SETTINGS.items()) and all(t["content"].startswith("<|") for t in found["added_tokens"])


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, cached by word and piece.

    A word that is new goes to the tokenizer's merge model piece by piece, if it is plain Latin text
    whose split, lower-casing and normal form are certain; else to the tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one worker, one core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.by_word = word_by_word(path)
        self.merge = self.tokenizer.model.tokenize
        self.pieces = regex.compile(PIECES).findall
        self.letters = byte_letters()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        if not self.by_word or b"<|" in raw:  # may hold special tokens, which are looked for before all else
            return self.whole(raw)
        # Unless a combining mark follows, an ASCII letter may be lower-cased before the rest.
        words = (raw if b"\xcc" in raw or b"\xcd" in raw else raw.lower()).split()
        parts = list(map(self.young.get, words))
        if None in parts:
            parts = [self.word(w) if p is None else p for w, p in zip(words, parts, strict=True)]
        return b"".join(parts)

    def whole(self, raw: bytes) -> bytes:
        return array("I", self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def word(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            text = word.decode("utf-8", "replace")
            if not text.isascii() and (ord(max(text)) >= LATIN or not unicodedata.is_normalized("NFC", text)):
                found = self.whole(word)
            elif word.isalpha():  # ASCII letters, in lower case but for rare texts with combining marks
                found = self.piece(text.lower())
            else:
                pieces = self.pieces(text.lower())
                if len(pieces) != 1 or pieces[0] != text:
                    young = self.young
                    found = b"".join([young.get(p) or self.word(p) for p in map(str.encode, pieces)])
                    if len(word) > CACHE_JOINED:  # its pieces are cached; together they are rarely met again
                        return found
                else:
                    found = self.piece(text)
        if len(word) <= CACHE_BYTES:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(spelled)]).tobytes()


_tokenizers: dict[str, WordTokenizer] = {}


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, closing_id: int = 1, block_tokens: int = 1 << 23, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""
    closing = np.array([closing_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = WordTokenizer(tokenizer_path)
        encode = _tokenizers[tokenizer_path].encode
        first = TaskContext.get().partitionId() << 38
        block, tokens = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + closing
                block.append((doc, ids))
                tokens += len(ids) // 4
                if tokens >= block_tokens:
                    first, tokens = (yield from emit(block, first)), 0
                    block = []
        yield from emit(block, first)

    def emit(block: list[tuple[int | None, bytes]], first: int) -> Iterator[pa.RecordBatch]:
        rows, rests = [], []  # rests: indices in rows
        for doc, ids in block:
            n = len(ids) // 4
            for start in range(0, n, size):
                length = min(size, n - start)
                if length < size:
                    rests.append(len(rows))
                rows.append([doc, start, length, ids[4 * start : 4 * (start + length)], n, first, 0])
                first += length == size
        windows, offsets, made = best_fit([rows[i][2] for i in rests], size)
        for i, w, o in zip(rests, windows, offsets, strict=True):
            rows[i][5:] = first + w, o
        for i in range(0, len(rows), 4096):
            part = list(zip(*rows[i : i + 4096], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(part)], names=[x.split()[0] for x in SCHEMA.split(", ")])
        return first + made

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def with_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
