"""Numpy primitives over whole batches of text: code points, character classes, prefix hashes.

A batch of texts becomes one flat array of code points with document offsets, so that word
boundaries, rolling hashes and window minima are array passes and no Python loop runs per
character or per word. Batches are cut into slices of a bounded number of characters, because a
worker's memory must not grow with the rows of a batch; a longer text is a slice of its own.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_CHARS = 400_000
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
_MIX = U64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}
_tables: dict[str, np.ndarray] = {}

#: White space as the Unicode property White_Space has it (fixed values).
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n; grown by doubling and kept in the worker."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        with np.errstate(over="ignore"):
            p, q = np.full(size, BASE, U64), np.full(size, pow(BASE, -1, 1 << 64), U64)
            p[0] = q[0] = 1
            _powers["p"], _powers["q"] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers["p"][:n], _powers["q"][:n]


def class_table() -> np.ndarray:
    """Class of every code point: letter (L*), number (N*), white space, other."""
    if "class" not in _tables:
        t = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = unicodedata.category(chr(i))[0]
            if c in "LN":
                t[i] = LETTER if c == "L" else NUMBER
        t[WHITE] = SPACE
        _tables["class"] = t
    return _tables["class"]


def lower_table() -> np.ndarray:
    """Lower-case code point of every code point; one whose lower case has several stays itself."""
    if "lower" not in _tables:
        t = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            if 0xD800 <= i < 0xE000:
                continue
            x = chr(i).lower()
            if len(x) == 1:
                t[i] = ord(x)
        _tables["lower"] = t
    return _tables["lower"]


def packed_tables(*names: str) -> bytes:
    """The named tables, built once on the driver and shipped to the workers (a few kB)."""
    make = {"class": class_table, "lower": lower_table}
    return zlib.compress(b"".join(make[n]().tobytes() for n in names), 6)


def unpack_tables(data: bytes, *names: str) -> None:
    if all(n in _tables for n in names):
        return
    raw, at = zlib.decompress(data), 0
    for n in names:
        kind = np.uint8 if n == "class" else np.uint32
        size = 0x110000 * np.dtype(kind).itemsize
        _tables[n] = np.frombuffer(raw, kind, 0x110000, at)
        at += size


def strings(column: pa.Array) -> pa.StringArray:
    """The column as one plain string array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def utf8(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All bytes of a string array and the n + 1 byte offsets from 0; a null is as an empty text."""
    a = strings(column).fill_null("")
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int32, len(a) + 1, a.offset * 4).astype(np.int64)
    raw = data[int(off[0]) : int(off[-1])].to_pybytes() if data is not None and off[-1] > off[0] else b""
    return raw, off - off[0]


def points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)


def decode(raw: bytes, byte_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the bytes, and the offsets in characters."""
    cp = points(raw)
    if len(cp) == len(raw):
        return cp, byte_off
    b = np.frombuffer(raw, np.uint8)
    starts = np.zeros(len(b) + 1, np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=starts[1:])
    return cp, starts[byte_off]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Row slices of the batch whose texts have at most `limit` bytes together, or one row each."""
    off = np.frombuffer(strings(batch.column(column)).buffers()[1], np.int32, batch.num_rows + 1, batch.column(column).offset * 4) if batch.num_rows else np.zeros(1, np.int32)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(off, int(off[at]) + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of mix(values[j]) * BASE**j over j < i, modulo 2**64."""
    with np.errstate(over="ignore"):
        v = (values.astype(U64) + U64(1)) * _MIX
        v ^= v >> U64(29)
        v *= powers(len(v))[0]
        out = np.zeros(len(v) + 1, U64)
        np.cumsum(v, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of values[start:end] for arrays of starts and ends."""
    with np.errstate(over="ignore"):
        return scramble((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose high bits depend on all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
        return h ^ (h >> U64(29))


def words(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters and digits; no run goes past a text's end."""
    alnum = np.zeros(len(cp) + 2, np.bool_)
    k = _tables["class"][cp] if "class" in _tables else class_table()[cp]
    alnum[1:-1] = (k == LETTER) | (k == NUMBER)
    begin = alnum[1:-1] & ~alnum[:-2]
    end = alnum[1:-1] & ~alnum[2:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(cp))]
    begin[inner] = alnum[1:-1][inner]
    end[inner - 1] = alnum[1:-1][inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all the spans [start, start + length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling: about 2 log2(w) passes."""
    have, out = 1, values
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        rest = w - have
        out = np.minimum(out[:-rest], out[rest:])
    return out
