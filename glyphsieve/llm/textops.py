"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on Arrow string buffers as numpy byte arrays: no Python
object is made per document or per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_POW = np.ones(1, dtype=U64)
_INV = np.ones(1, dtype=U64)

#: Bytes of a word: ASCII letters and digits, and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 20)
        for name, base in (("_POW", _BASE), ("_INV", _BASE_INV)):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _POW[:n], _INV[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def distinct(values: np.ndarray) -> np.ndarray:
    """np.unique(values), by a sort: on many different numbers np.unique's own hashing takes many times as long."""
    values = np.sort(values)
    on = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=on[1:])
    return values[on]


def ascending(hashes: np.ndarray) -> np.ndarray:
    """np.argsort(hashes, kind="stable") of 64-bit numbers that seldom agree in their leading bits alone.

    What is sorted is (leading bits, place) in one number; where the rest decides, it is put in order after that."""
    bits = U64(len(hashes).bit_length())
    packed = (hashes >> bits << bits) | np.arange(len(hashes), dtype=U64)
    packed.sort()
    order = (packed & ((U64(1) << bits) - U64(1))).astype(np.int64)
    values = hashes[order]
    wrong = np.flatnonzero(values[1:] < values[:-1])
    if len(wrong) > 1000:
        return np.argsort(hashes, kind="stable")
    packed >>= bits
    for lead in distinct(packed[wrong]):
        run = slice(*np.searchsorted(packed, [lead, lead + U64(1)]))
        order[run] = order[run][np.argsort(values[run], kind="stable")]
    return order


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most_bytes: int = 1 << 20, most_rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole rows of at most so many bytes (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1
        j = min(max(j, i + 1), n, i + most_rows)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word. Rows are taken as apart even where their bytes touch."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    is_word = WORD_BYTE[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0], edge[-1] = is_word[0], is_word[-1]
    np.not_equal(is_word[1:], is_word[:-1], out=edge[1:-1])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    inner = cut[is_word[cut] & is_word[cut - 1] & ~edge[cut]]  # a word that would run over a row's end
    at = np.flatnonzero(edge)
    if len(inner):
        inner = np.unique(inner)
        at = np.sort(np.concatenate([at, inner, inner]))
    start, end = at[0::2], at[1::2]
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U64))


def word_ngrams(word_hash: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every n-gram of words inside a row.

    A row with fewer than n words, but one at least, has one gram: all its words."""
    m = len(word_hash)
    if not m:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    gram = np.zeros(m, dtype=U64)
    for j in range(n):
        part = word_hash[j:] * U64((0x9E3779B97F4A7C15 * (2 * j + 3)) & (2**64 - 1))
        part ^= part >> U64(29)
        gram[: m - j] += np.where(row[j:] == row[: m - j], part, U64(0)) if j else part
    keep = np.zeros(m, dtype=bool)
    if m >= n:
        keep[: m - n + 1] = row[n - 1 :] == row[: m - n + 1]
    first = np.ones(m, dtype=bool)
    first[1:] = row[1:] != row[:-1]
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, m))
    keep[at[count < n]] = True
    index = np.flatnonzero(keep)
    return mix(gram[index]), index


def char_index(data: np.ndarray) -> np.ndarray:
    """Number of characters that begin before each byte (one more entry than bytes)."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list array with so many of the values in each row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, in UTF-8, byte for byte."""
    out = _LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    b = data[after]
    after = after[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]
    out[after] |= 0x20
    return out


def squeezed(values: np.ndarray) -> bytes:
    """64-bit numbers as differences, in planes of bytes, compressed."""
    d = np.diff(values.view(np.int64), prepend=np.int64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def expanded(blob: bytes) -> np.ndarray:
    """What ``squeezed`` was given, as signed numbers."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())
