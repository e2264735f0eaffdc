"""Problem 8: token ids of whole texts with a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelforge.plans.workers import ship

#: Folder of the public vocabularies; a parameter of every operator here.
TOKENIZERS = os.environ.get("PANELFORGE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: how the vocabulary's own pre-tokenizer cuts a text, in alternation order.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Places where PATTERN cuts whatever stands before or after: no piece holds a letter and then something else, a digit
#: and then something else, or a visible sign and then white space.
CUT = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=\s)"

#: Characters in a leaf of the tree; a text within one leaf is encoded at once.
LEAF = 8192

#: Tokens after which a batch of results is passed on.
FLUSH = 2_000_000

_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Byte-level BPE by a table of ranks, with exact joins of separately encoded neighbours."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._bpe = tiktoken.Encoding("panelforge", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._cut = regex.compile(CUT)
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each token
        self.bytes_of = [b""] * len(self.widths)
        for token, i in ranks.items():
            self.widths[i] = len(token)
            self.bytes_of[i] = token

    def leaf(self, text: str) -> np.ndarray:
        return self._bpe.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str | None, leaf: int = LEAF) -> np.ndarray:
        """Ids of the whole text; none for a null or empty text. The result doesn't depend on ``leaf``."""
        if not text:
            return np.empty(0, np.uint32)
        return self._tree(text, 0, len(text), max(leaf, 1))

    def _tree(self, text: str, start: int, end: int, leaf: int) -> np.ndarray:
        if end - start <= leaf:
            return self.leaf(text[start:end])
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._tree(text, start, middle, leaf), self._tree(text, middle, end, leaf))

    def _join(self, text: str, start: int, middle: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of text[start:end] from those of its halves.

        A window around the middle grows until each end is a place where every context cuts (CUT), or the end of the
        halves. Tokens don't cross such places, so those outside the window stand; only the window is encoded anew.
        """
        a, b = self._cut_before(text, start, middle), self._cut_after(text, middle, end)
        kept = left[: self._tokens_of(left[::-1], text, a, middle, len(left))]
        rest = right[len(right) - self._tokens_of(right, text, middle, b, len(right)) :]
        return np.concatenate((kept, self.leaf(text[a:b]), rest))

    def _cut_before(self, text: str, start: int, middle: int) -> int:
        reach = 32
        while True:
            lo = max(start, middle - reach)
            # a place needs the signs on both of its sides; those of the window's own edges are looked at as well
            last = None
            for m in self._cut.finditer(text, lo + 1, middle):
                last = m.start()
            if last is not None:
                return last
            if lo == start:
                return start
            reach *= 4

    def _cut_after(self, text: str, middle: int, end: int) -> int:
        reach = 32
        while True:
            hi = min(end, middle + reach)
            m = self._cut.search(text, middle + 1, hi)
            if m and m.start() < end:
                return m.start()
            if hi == end:
                return end
            reach *= 4

    def _tokens_of(self, ids: np.ndarray, text: str, a: int, b: int, n: int) -> int:
        """How many of the n tokens remain once text[a:b], which ``ids`` begins with, is taken off."""
        size = len(text[a:b].encode("utf-8"))
        if not size:
            return n
        first = 64
        while True:
            sums = np.cumsum(self.widths[ids[:first]])
            k = int(np.searchsorted(sums, size))
            if k < len(sums):
                if sums[k] != size:
                    raise AssertionError("a place to cut isn't the end of a token")
                return n - k - 1
            first *= 8

    def decode(self, ids) -> str:
        """The text of ids: halves are decoded to bytes and concatenated up the tree; broken ends become U+FFFD."""

        def tree(a: int, b: int) -> bytes:
            if b - a <= LEAF:
                return b"".join(self.bytes_of[i] for i in ids[a:b])
            return tree(a, (a + b) // 2) + tree((a + b) // 2, b)

        return tree(0, len(ids)).decode("utf-8", "replace")


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of a vocabulary file, loaded once in each Python process."""
    path = os.path.join(folder, vocabulary)
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32)))


def encode_texts(df: DataFrame, item: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, leaf: int = LEAF, flush: int = FLUSH) -> DataFrame:
    """item, ids (array<int>) of every row of ``df``, without special tokens; what looks like one is ordinary text.

    Null and empty texts have an empty list. Rows keep their number: repeated and null items come out as they are. Each
    row is encoded where it was read, without a shuffle; only the two columns are read.
    """
    name = df.schema[item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for batch in batches:
            done, ids, size = 0, [], 0
            for i, t in enumerate(batch.column(1), 1):
                ids.append(enc.encode(t.as_py(), leaf))
                size += len(ids[-1])
                if size > flush or i == batch.num_rows:  # long texts leave in smaller batches
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(ids)), _lists(ids)], names=[name.name, "ids"])
                    done, ids, size = i, [], 0

    schema = T.StructType([T.StructField(name.name, name.dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    ship(df.sparkSession)
    return df.select(item, text).mapInArrow(run, schema)


def decode_ids(df: DataFrame, item: str, ids: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """item, text: the inverse of ``encode_texts``; null ids give an empty text."""
    name = df.schema[item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for batch in batches:
            texts = [enc.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[name.name, "text"])

    ship(df.sparkSession)
    return df.select(item, ids).mapInArrow(run, T.StructType([T.StructField(name.name, name.dataType), T.StructField("text", T.StringType())]))


def count_tokens(df: DataFrame, item: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """item, n_tokens of every row; 0 for null and empty texts. Ids never leave the Python process."""
    name = df.schema[item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for batch in batches:
            n = [len(enc.encode(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[name.name, "n_tokens"])

    ship(df.sparkSession)
    return df.select(item, text).mapInArrow(run, T.StructType([T.StructField(name.name, name.dataType), T.StructField("n_tokens", T.LongType())]))
