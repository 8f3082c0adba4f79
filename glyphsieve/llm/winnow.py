"""Document fingerprints by winnowing.

The text is read as its word characters (ASCII letters and digits, every
non-ASCII character), case folded. Each run of ``k`` of them has the rolling hash

    sum(code point[i] * BASE ** (k - 1 - i))  mod  2 ** 31 - 1

and of every ``window`` neighbouring hashes the least is a fingerprint, of equal
ones the rightmost. Any two texts that share ``window + k - 1`` word characters
share a fingerprint; a shared run of less than k characters is never matched.

Defined results:

* a null or empty text, or one of fewer than k word characters, has none;
* a text with at least k characters but fewer than a window has one;
* repeated rows each get their fingerprints, a null key included;
* positions are characters of the given text, at the gram's first character;
* a very long text is read whole, in pieces that overlap so that no window is lost;
* other columns are not read; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsieve.llm.textops import buffers, lists, slices

K = 25
WINDOW = 40
BASE = 257
PRIME = (1 << 31) - 1
FOUND = "array<struct<hash:bigint,position:int>>"
FIELDS = [pa.field("hash", pa.int64()), pa.field("position", pa.int32())]
#: Hashes that are compared at once: a hash and its place share 64 bits.
PIECE = 1 << 24


def _folded() -> np.ndarray:
    table = np.arange(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table


_FOLD: np.ndarray | None = None


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


def word_characters(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, folded code points) of the word characters."""
    global _FOLD
    if _FOLD is None:
        _FOLD = _folded()
    on = points >= 128
    on |= (points >= 48) & (points < 58)
    on |= ((points | 32) >= 97) & ((points | 32) < 123)
    at = np.flatnonzero(on)
    p = points[at]
    return at, np.where(p < 0x10000, _FOLD[np.minimum(p, 0xFFFF)], p)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """The rolling hash of every k neighbours, by doubling the length of what is hashed."""
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prime = np.uint64(PRIME)
    power = points.astype(np.uint64) % prime  # hashes of `length` neighbours
    length, out, have = 1, None, 0
    rest = k
    while True:
        if rest & 1:
            if out is None:
                out = power
            else:  # what is hashed so far, then `length` more
                m = len(points) - have - length + 1
                out = (out[:m] * np.uint64(pow(BASE, length, PRIME)) + power[have : have + m]) % prime
            have += length
        rest >>= 1
        if not rest:
            return out
        m = len(power) - length
        power = (power[:m] * np.uint64(pow(BASE, length, PRIME)) + power[length:]) % prime
        length *= 2


def window_least(key: np.ndarray, window: int) -> np.ndarray:
    """The least of every ``window`` neighbours."""
    n = len(key) - window + 1
    length, out = 1, key
    while length * 2 <= window:
        out = np.minimum(out[:-length], out[length:])
        length *= 2
    rest = window - length
    return np.minimum(out[: len(out) - rest], out[rest:])[:n] if rest else out[:n]


def chosen(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Indices of the hashes that some window chooses; first and last: of the gram's row, the first and last gram.

    No window reaches over its row. A row of fewer grams than a window is one window."""
    out = []
    n = len(hashes)
    for i in range(0, n, PIECE - window):
        part = hashes[i : i + PIECE]
        m = len(part)
        place = np.arange(m, dtype=np.uint64)
        key = (part << np.uint64(24)) | (np.uint64(PIECE - 1) - place)  # of equal hashes the rightmost is least
        if m >= window:
            least = window_least(key, window)
            inside = last[i : i + len(least)] >= np.arange(i + window - 1, i + window - 1 + len(least))
            out.append(i + (PIECE - 1 - (least[inside] & np.uint64(PIECE - 1)).astype(np.int64)))
        if i + m >= n:
            break
    starts = np.flatnonzero(first == np.arange(n)) if n else np.zeros(0, np.int64)
    small = starts[last[starts] - starts + 1 < window]
    if len(small):
        width = np.arange(window)
        at = small[:, None] + width
        inside = at <= last[small][:, None]
        key = np.where(inside, (hashes[np.minimum(at, n - 1)] << np.uint64(24)) | (window - width).astype(np.uint64), np.uint64(2**64 - 1))
        out.append(small + key.argmin(1))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, position) of the fingerprints of UTF-8 rows."""
    none = (np.zeros(0, np.int64),) * 3
    points = code_points(data)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    bounds = before[offsets]  # the rows' first characters
    at, folded = word_characters(points)
    if len(at) < k:
        return none
    row = np.searchsorted(bounds, at, side="right") - 1
    hashes = gram_hashes(folded, k)
    gram = np.flatnonzero(row[: len(hashes)] == row[k - 1 : k - 1 + len(hashes)])
    if not len(gram):
        return none
    r = row[gram]
    cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    run = np.diff(np.append(cut, len(r)))
    pick = chosen(hashes[gram], np.repeat(cut, run), np.repeat(cut + run - 1, run), window)
    g = gram[pick]
    return row[g], hashes[g].astype(np.int64), at[g] - bounds[row[g]]


def finder(k: int = K, window: int = WINDOW):
    """An Arrow UDF from a text to its fingerprints in order."""

    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = buffers(texts)
            got = []
            for i, j in slices(offsets, 1 << 20):
                row, value, position = fingerprints_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k, window)
                got.append((row + i, value, position))
            row, value, position = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
            yield lists(pa.StructArray.from_arrays([pa.array(value, pa.int64()), pa.array(position, pa.int32())], fields=FIELDS), np.bincount(row, minlength=len(texts)))

    return find


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """(key, hash, position): one row for each fingerprint."""
    if k < 1 or window < 1:
        raise ValueError("k and window are 1 at least")
    found = docs.select(docs[key].alias("k"), F.explode(finder(k, window)(docs[text])).alias("f"))
    return found.select(F.col("k").alias(key), "f.*")


def oracle(k: int = K, window: int = WINDOW) -> str:
    """The same rows in DuckDB's SQL, for texts of Latin letters."""
    power = " + ".join(f"lead(c, {i}) OVER w * {pow(BASE, k - 1 - i, PRIME)}" for i in range(k))
    return f"""
WITH chars AS (
  SELECT doc_id, u.p AS p, CAST(ord(u.ch) AS BIGINT) AS c FROM (SELECT doc_id, string_split(lower(text), '') AS l FROM documents) d,
  LATERAL (SELECT unnest(l) AS ch, generate_subscripts(l, 1) - 1 AS p) u
  WHERE ord(u.ch) >= 128 OR u.ch SIMILAR TO '[a-z0-9]'
), grams AS (
  SELECT doc_id, p, CAST(({power}) % {PRIME} AS BIGINT) AS h FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), kept AS (
  SELECT doc_id, p, h, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM grams WHERE h IS NOT NULL
), least AS (
  SELECT doc_id, i, n, min(h * 33554432 + (33554431 - p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS m FROM kept
)
SELECT DISTINCT doc_id, m // 33554432 AS hash, CAST(33554431 - m % 33554432 AS INTEGER) AS position FROM least WHERE i >= least(n, {window})
"""
