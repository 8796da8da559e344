"""Vectorised words, hashes and windows over Arrow text columns.

A batch is walked in chunks of half a MB, so that the arrays made from it (about 50 times a chunk)
stay small whatever the batch size; one text is never cut.  Words are runs of bytes of a class: no class splits a
UTF-8 sequence, as every byte over 0x7F is in the same class.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_U = np.uint64


def _class(outside: list[tuple[int, int]]) -> np.ndarray:
    inside = np.ones(256, bool)
    for lo, hi in outside:
        inside[lo : hi + 1] = False
    return inside


#: Bytes of a word: everything but the six ASCII white-space characters.
NON_SPACE = _class([(0x20, 0x20), (0x09, 0x0D)])
#: Digits, a-z and everything beyond ASCII (to be used on lower-cased bytes).
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: a-z and everything beyond ASCII.
LETTERS = _class([(0x00, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 32)) * _U(0x9E3779B97F4A7C15))


_BYTE = stream(11, 256)
_AT = stream(12, 4096) | _U(1)


def _places(n: int) -> np.ndarray:
    global _AT
    if n > len(_AT):
        _AT = stream(12, 2 * n) | _U(1)
    return _AT


@dataclass
class Chunk:
    lo: int  # rows lo..hi of the batch
    hi: int
    data: np.ndarray  # bytes
    offs: np.ndarray  # of the rows in data, one more than rows


@dataclass
class Words:
    starts: np.ndarray  # in bytes
    ends: np.ndarray
    ptr: np.ndarray  # first word of each row, one more than rows
    hashes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def release() -> None:
    """Give freed memory back to the system; a worker that later stages use again would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    n = len(texts)
    if not n:
        return
    release()
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield Chunk(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def split(c: Chunk, data: np.ndarray, inside: np.ndarray) -> Words:
    m = inside[data]
    n = len(m)
    if not n:
        return Words(*(np.zeros(0, np.int64),) * 2, np.zeros(len(c.offs), np.int64))
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    edge = c.offs[:-1][c.offs[:-1] < n]
    first[edge] = m[edge]
    edge = c.offs[1:][c.offs[1:] > 0] - 1
    last[edge] = m[edge]
    starts = np.flatnonzero(first)
    return Words(starts, np.flatnonzero(last) + 1, np.searchsorted(starts, c.offs))


def hash_words(w: Words, data: np.ndarray) -> np.ndarray:
    """64-bit multilinear hashes of the words' bytes."""
    if not len(w.starts):
        return np.zeros(0, _U)
    size = w.ends - w.starts
    at = np.cumsum(size)
    total = int(at[-1])
    at -= size
    if total == len(data):
        kept = data
    else:
        step = np.ones(total, np.int64)
        step[0] = w.starts[0]
        step[at[1:]] = w.starts[1:] - w.ends[:-1] + 1
        kept = data[np.cumsum(step)]
    place = np.arange(total, dtype=np.int64) - np.repeat(at, size)
    with np.errstate(over="ignore"):
        value = _BYTE[kept] * _places(int(size.max()))[place]
        return mix(np.add.reduceat(value, at) + size.astype(_U) * _U(0x9E3779B97F4A7C15))


def words(c: Chunk, inside: np.ndarray, lower: bool) -> Words:
    data = LOWER[c.data] if lower else c.data
    w = split(c, data, inside)
    w.hashes = hash_words(w, data)
    return w


def windows(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    q = stream(seed, k) | _U(1)
    with np.errstate(over="ignore"):
        out = hashes[:n] * q[0]
        for j in range(1, k):
            out += hashes[j : n + j] * q[j]
    return mix(out)


def whole(w: Words, k: int) -> np.ndarray:
    """For each start of windows(): does the window stay in its row?"""
    n = len(w.starts) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    return np.arange(n) + k <= np.repeat(w.ptr[1:], w.counts)[:n]


def spread(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of the starts."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1) if len(starts) < 64 else d.__iadd__(np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int32))
    ends = np.minimum(starts + k, n)
    d -= np.bincount(ends, minlength=n + 1)[: n + 1].astype(np.int32)
    return np.cumsum(d[:-1]) > 0


_ZSTD = pa.Codec("zstd", compression_level=1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned integers as zstd of the byte planes of their differences."""
    if not len(keys):
        return b""
    d = np.diff(keys, prepend=_U(0)).astype("<u8")
    planes = d.view(np.uint8).reshape(-1, 8).T
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    raw = np.ascontiguousarray(planes[:used]).tobytes()
    return bytes([used]) + np.int64(len(keys)).tobytes() + _ZSTD.compress(raw, asbytes=True)


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, _U)
    used, n = blob[0], int(np.frombuffer(blob[1:9], np.int64)[0])
    raw = np.frombuffer(_ZSTD.decompress(blob[9:], decompressed_size=used * n, asbytes=True), np.uint8).reshape(used, n)
    d = np.zeros((n, 8), np.uint8)
    d[:, :used] = raw.T
    return np.cumsum(d.view("<u8").ravel().astype(_U), dtype=_U)


def pack_ints(values: np.ndarray) -> bytes:
    """Signed integers as zstd of the byte planes of their zigzag codes."""
    v = values.astype(np.int64)
    z = ((v << 1) ^ (v >> 63)).astype("<u8")
    planes = np.ascontiguousarray(z.view(np.uint8).reshape(-1, 8).T)
    return np.int64(len(v)).tobytes() + _ZSTD.compress(planes.tobytes(), asbytes=True)


def unpack_ints(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob[:8], np.int64)[0])
    planes = np.frombuffer(_ZSTD.decompress(blob[8:], decompressed_size=8 * n, asbytes=True), np.uint8).reshape(8, n)
    z = np.ascontiguousarray(planes.T).view("<u8").ravel()
    return (z >> _U(1)).astype(np.int64) ^ -(z & _U(1)).astype(np.int64)


def pack_bits(*flags: np.ndarray) -> bytes:
    return b"".join(np.packbits(f).tobytes() for f in flags)


def unpack_bits(blob: bytes, n: int, k: int = 1) -> list[np.ndarray]:
    size = (n + 7) // 8
    return [np.unpackbits(np.frombuffer(blob, np.uint8)[i * size : (i + 1) * size], count=n).astype(bool) for i in range(k)]
