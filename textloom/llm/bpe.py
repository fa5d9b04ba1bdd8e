"""Byte-level BPE: encoding by a heap of merge ranks over a linked symbol list, decoding by joining vocabulary strings."""

from __future__ import annotations

import base64
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as A
from textloom.runtime import require

#: Rank files and the pattern that cuts texts into pieces are those of public tokenizers; the path is a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Pieces whose ids a worker remembers; others are merged each time they occur, with the same result.
REMEMBERED = 600_000

#: The same pattern for the standard library's faster engine; right for texts of Latin letters without the odd numerals.
_LATIN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]++| ?\d++| ?(?:[^\s\w]|_)++|\s++$|\s+(?!\S)|\s").findall
_NOT_LATIN = re.compile("[^\t-\r -\u024f]|[\xb2\xb3\xb9\xbc-\xbe]").search


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank (and id) of each vocabulary string, from a file of base64 strings and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece.

    Symbols form a doubly linked list by start position. The heap holds (rank, start, length) of neighbouring pairs;
    an entry whose pair has been merged away or has grown since is stale and skipped. Lowest rank first, leftmost
    among equals.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, length = heappop(heap)
        j = after[i]
        if size[i] == 0 or j >= n or size[i] + size[j] != length:
            continue
        size[i], size[j] = length, 0
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : k + size[k]])) is not None:
                heappush(heap, (r, i, length + size[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h : i + length])) is not None:
            heappush(heap, (r, h, size[h] + length))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : i + size[i]]])
        i = after[i]
    return out


class _Pieces(dict):
    """Ids of a piece as int32 bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        known = self.ranks.get(raw)
        ids = array("i", (known,) if known is not None else merge(raw, self.ranks)).tobytes()
        if len(self) < REMEMBERED:
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.cut = regex.compile(pattern).findall
        self.latin = _LATIN if pattern == PATTERN else self.cut
        self.pieces = _Pieces(ranks)
        self.strings = [b""] * (max(ranks.values()) + 1)
        for s, r in ranks.items():
            self.strings[r] = s

    def encode(self, text: str) -> bytes:
        """The ids as int32 bytes."""
        cut = self.cut if _NOT_LATIN(text) else self.latin
        return b"".join(map(self.pieces.__getitem__, cut(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip): the ids of each whole text, and whether decoding them gives it back.

    One pass without a shuffle. A null text has null results, an empty one no tokens; rows are answered one by one,
    so repeated rows and null ids stay as they are. Other columns are not read. The vocabulary is read once, on the
    driver; its size is fixed, so it is broadcast.
    """
    require(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches):
        codec = Codec(sent.value)
        for batch in batches:
            for s in A.slices(batch, "text"):
                texts = A.column(s, "text").to_pylist()
                coded = [None if t is None else codec.encode(t) for t in texts]
                ids = np.frombuffer(b"".join(c for c in coded if c), np.int32)
                ends = np.cumsum([0 if c is None else len(c) // 4 for c in coded])
                offsets = np.r_[0, ends].astype(np.int32)
                null = np.array([c is None for c in coded])
                same = [None if t is None else codec.decode(ids[a:b].tolist()) == t.encode() for t, a, b in zip(texts, offsets, offsets[1:])]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids), mask=pa.array(null) if null.any() else None)
                yield pa.RecordBatch.from_arrays(
                    [A.column(s, "doc_id"), lists, pa.array(np.diff(offsets).astype(np.int64), mask=null), pa.array(same, pa.bool_())],
                    ["doc_id", "token_ids", "n_tokens", "round_trip"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, token_ids array<int>, n_tokens long, round_trip boolean"
    )


def decode_ids(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from lists of ids: the vocabulary strings end to end, as UTF-8 (bad bytes become U+FFFD).

    A null list gives a null text, an empty one an empty text; null ids within a list are skipped.
    """
    require(tokens, id_col, ids_col)
    sent = tokens.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches):
        codec = Codec(sent.value)
        for batch in batches:
            out = [None if x is None else codec.decode(i for i in x if i is not None).decode("utf-8", "replace") for x in A.column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([A.column(batch, "doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
