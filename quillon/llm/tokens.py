"""Encoding of texts with a public byte-pair tokenizer, as a monoid reduced over a tree.

An element is a text with its ids. Joining two encodes only a window about their seam anew; the window grows until both its ends are
safe cuts, places at which the tokenizer's pattern splits whatever stands around. Ids outside the window can't change then: the
pattern looks back over nothing, and merges never cross its pieces. Long texts are encoded by halves and joined up the tree; decoding
concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k"
#: Fixed value: the public pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters up to which a text is encoded in one piece.
LEAF = 8192
#: Places before which a piece of the pattern always ends: after a visible ASCII character before a blank or line end, after a CJK stop before a letter.
SAFE = re.compile(r"[!-~](?=[ \n])|[。、](?=[^\W_])")


class Tokenizer:
    """A byte-level BPE vocabulary in rank form."""

    def __init__(self, folder: str, name: str, pattern: str | None = None):
        import tiktoken

        ranks = {}
        for line in Path(folder, f"{name}.tiktoken").read_bytes().splitlines():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.sizes = np.array([len(t) for t in self.bytes_of])
        self._encoding = tiktoken.Encoding(name, pat_str=PATTERN if pattern is None else pattern, mergeable_ranks=ranks, special_tokens={})
        self._core = self._encoding._core_bpe

    def leaf(self, text: str) -> np.ndarray:
        return np.frombuffer(self._core.encode_to_tiktoken_buffer(text, set()), dtype=np.uint32).astype(np.int32)

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """Ids of left + right from the ids of either."""
        if not left or not right:
            return b if not left else a
        reach, start, end = 64, None, None
        while start is None or end is None:
            if start is None:
                cuts = [m.end() for m in SAFE.finditer(left, max(0, len(left) - reach))]
                start = cuts[-1] if cuts else 0 if reach >= len(left) else None
            if end is None:
                m = SAFE.search(right, 0, min(len(right), reach))
                end = m.end() if m else len(right) if reach >= len(right) else None
            reach *= 4
        kept_left = self._tokens_for(a[::-1], len(left[start:].encode()))
        kept_right = self._tokens_for(b, len(right[:end].encode()))
        middle = self.leaf(left[start:] + right[:end])
        return np.concatenate([a[: len(a) - kept_left], middle, b[kept_right:]])

    def _tokens_for(self, ids: np.ndarray, size: int) -> int:
        """How many tokens make up so many bytes."""
        if not size:
            return 0
        n = 64
        while True:
            ends = np.cumsum(self.sizes[ids[:n]])
            if len(ends) and ends[-1] >= size or n >= len(ids):
                k = int(np.searchsorted(ends, size))
                if k >= len(ends) or ends[k] != size:
                    raise ValueError("a safe cut lies inside a token")
                return k + 1
            n *= 4

    def encode(self, text: str | None, leaf: int = LEAF) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        if len(text) <= leaf:
            return self.leaf(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left, leaf), right, self.encode(right, leaf))

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(self.bytes_of[i] for i in ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def tokenizer(folder: str = TOKENIZERS, name: str = BYTE_BPE_50K) -> Tokenizer:
    """One for each worker process."""
    return Tokenizer(folder, name)


def encode_texts(df: DataFrame, id: str = "doc_id", text: str = "text", *, name: str = BYTE_BPE_50K, folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids): the ids of each text, without special tokens; one row for each row of df, repeated ids and texts included.

    Null and empty texts have an empty list. Strings that look like special tokens are ordinary text. Whole texts, of any length; nothing is
    shuffled. Further columns are dropped, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(folder, name)
        for b in batches:
            ids = [t.encode(x) for x in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], ["id", "ids"])

    kind = df.select(F.col(id).alias("id")).schema["id"].dataType.simpleString()
    return df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id)


LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def prose_tokens(ids: np.ndarray, sizes: np.ndarray, text: str, share: float) -> int:
    """How many ids begin in a line of prose: one in which at least this share of the visible bytes belongs to letters."""
    if not len(ids):
        return 0
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    line = np.cumsum(raw == 10)
    visible, letters = np.bincount(line, raw > 32), np.bincount(line, LETTER[raw])
    begins = np.cumsum(sizes[ids]) - sizes[ids]
    return int((letters >= share * np.maximum(visible, 1))[line[begins]].sum())


def count_tokens(df: DataFrame, id: str = "doc_id", text: str = "text", *, name: str = BYTE_BPE_50K, folder: str = TOKENIZERS, prose_share: float = 0.7) -> DataFrame:
    """(id, n_tokens, n_prose): how many ids encode_texts would give, and how many of them begin in lines of prose; 0 for null and empty texts.

    Lines of data, logs, commands and code have few letters among their visible signs; prose has at least prose_share (measured in bytes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(folder, name)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [t.encode(x) for x in texts]
            prose = [prose_tokens(i, t.sizes, x, prose_share) for i, x in zip(ids, texts, strict=True)]
            yield pa.record_batch([b.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(prose, pa.int64())], ["id", "n_tokens", "n_prose"])

    kind = df.select(F.col(id).alias("id")).schema["id"].dataType.simpleString()
    return df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, n_prose long").withColumnRenamed("id", id)


def decode_ids(df: DataFrame, id: str = "doc_id", ids: str = "ids", *, name: str = BYTE_BPE_50K, folder: str = TOKENIZERS) -> DataFrame:
    """(id, text): the text of each list of ids; bytes that are no UTF-8 become U+FFFD; a null list gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(folder, name)
        for b in batches:
            texts = [None if x is None else t.decode(np.array(x, dtype=np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = df.select(F.col(id).alias("id")).schema["id"].dataType.simpleString()
    return df.select(F.col(id).alias("id"), F.col(ids).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id)
