"""Whole-batch numpy views of Arrow string columns: bytes, word spans and word hashes without a Python loop per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textloom.runtime import released  # noqa: F401

#: Bytes of text handled at once; bounds a worker's temporary arrays at about 50 MB whatever the batch size is.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW = {"n": 0}

#: Letters and digits of ASCII and every byte of a multi-byte character are word bytes.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
WORD[95] = True


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a record batch so that each piece has at most ``limit`` bytes in ``column`` (one row may have more)."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size) - size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows end to end, and the n + 1 offsets; null rows are empty."""
    arr = pc.fill_null(arr, "") if arr.null_count else arr
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = arr.buffers()
    offs = np.frombuffer(buffers[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offs[0] : offs[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, n at least."""
    if _POW["n"] < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("pow", _BASE), ("inv", _INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POW[name] = np.cumprod(a, dtype=np.uint64)
        _POW["n"] = size
    return _POW["pow"], _POW["inv"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans; they depend on the bytes alone, not on where the span lies."""
    pw, inv = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row each is in. A word never crosses rows."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    is_word = WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = is_word[:-1], is_word[1:]
    edges = offs[1:-1]
    before[edges[edges < len(data)]] = False
    last = edges[edges > 0] - 1
    after[last] = False
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def row_starts(rows: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets of the runs of a sorted row index."""
    return np.searchsorted(rows, np.arange(n + 1))
